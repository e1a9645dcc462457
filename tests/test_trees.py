import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.functions import basis, curve
from cellgrove.functions.octant import Grid, exterior_orientations
from cellgrove.operators import elements, nodes, order, tree, vectors
from cellgrove.plans import queries
from cellgrove.plans.work import materialise
from cellgrove.sources import files, generators
from cellgrove.sources.raster import rasterise_field
from tests.conftest import SF


def frame(spark, grid, rows):
    return spark.createDataFrame(rows, grid.schema)


def model_tree(points, dim, depth, most):
    """Plain recursive construction."""
    out = []

    def split(lev, at, own):
        if lev and (len(own) <= most or lev == depth):
            out.append((lev, *at))
            return
        half = 1 << depth - lev - 1
        for c in range(1 << dim):
            low = [a + half * (c >> d & 1) for d, a in enumerate(at)]
            split(lev + 1, low, [p for p in own if all(lo <= x < lo + half for x, lo in zip(p, low))])

    if points:
        split(0, [0] * dim, points)
    return sorted(out)


def model_gap(leaves, dim, depth):
    """The largest difference of level between leaves whose closed cells meet."""
    worst = 0
    for a, b in itertools.combinations(leaves, 2):
        sa, sb = 1 << depth - a[0], 1 << depth - b[0]
        if all(x <= y + sb and y <= x + sa for x, y in zip(a[1:], b[1:])):
            worst = max(worst, abs(a[0] - b[0]))
    return worst


@pytest.mark.parametrize("dim", [2, 3])
def test_construction_and_balance_against_a_model(spark, dim):
    rng = random.Random(dim)
    depth = 5
    pts = [tuple(min(31, int(rng.random() ** 3 * 32)) for _ in range(dim)) for _ in range(60)]
    g = Grid(dim, depth)
    df = frame(spark, g, [(depth, *p) for p in pts])
    got = sorted(map(tuple, tree.construct(df, g, 2).collect()))
    assert got == model_tree(pts, dim, depth, 2)
    even = materialise(tree.balance(df, g, 2))
    rows = sorted(map(tuple, even.collect()))
    assert model_gap(got, dim, depth) > 1 >= model_gap(rows, dim, depth)
    assert sum(2.0 ** (-dim * r[0]) for r in rows) == 1
    assert tree.balance_violations(even, g).count() == 0
    assert sorted(map(tuple, tree.balance(even, g, constructed=True).collect())) == rows


def test_no_points_give_no_tree(spark):
    g = Grid(2, 4)
    assert tree.construct(frame(spark, g, []), g).count() == 0


def test_unbalanced_pair_is_reported(spark):
    g = Grid(2, 4)
    df = frame(spark, g, [(1, 0, 0), (3, 8, 0)])
    assert tree.balance_violations(df, g).count() > 0


def test_golden_counts(spark):
    hist = {r.lev: r.n for r in queries.QUERIES["tree_level_histogram"](spark, SF).collect()}
    assert hist == {4: 80, 5: 398, 6: 827, 7: 1191, 8: 1588}
    even = materialise(queries.balanced(spark, SF))
    assert {r.lev: r.n for r in tree.level_histogram(even).collect()} == {4: 1, 5: 187, 6: 2224, 7: 4035, 8: 1588}
    assert [nodes.unique_nodes(even, queries.G, p).count() for p in (1, 2, 3)] == [6615, 29299, 68053]
    assert nodes.unique_nodes(even, queries.G, 2, nodes.resolve_by_count).count() == 29299


@pytest.mark.parametrize("dim,end", [(2, 3), (2, 4), (3, 3)])
@pytest.mark.parametrize("p", [1, 2, 3])
def test_closed_form_node_counts(spark, dim, end, p):
    g = Grid(dim, 12)
    uniform = (2**end * p + 1) ** dim
    want = {
        "centre": (end - 2) * ((4 * p - 1) ** dim - (2 * p - 1) ** dim) + (4 * p + 1) ** dim,
        "uniform": uniform,
        "boundary": uniform + sum(((2**l - 2) * p + 1) ** dim - ((2 ** (l + 1) - 4) * p + 1) ** dim for l in range(2, end)),
    }
    made = {"centre": generators.centre_refined(spark, g, end), "uniform": generators.uniform_tree(spark, g, end), "boundary": generators.boundary_refined(spark, g, end)}
    assert {k: nodes.unique_nodes(t, g, p).count() for k, t in made.items()} == want


@pytest.mark.parametrize("dim,depth,states", [(2, 6, 4), (3, 4, 24), (4, 3, 192)])
def test_hilbert_curve_visits_neighbours(spark, dim, depth, states):
    g = Grid(dim, depth)
    assert len(curve.hilbert_tables(dim)[0]) == states
    rows = [tuple(r) for r in generators.uniform_tree(spark, g, depth).select(curve.hilbert_key(g).alias("k"), curve.hilbert_path(g).alias("p"), *g.axes).orderBy("k").collect()]
    assert [r[0] for r in rows] == list(range(1 << dim * depth)) and [r[1] for r in rows] == sorted(r[1] for r in rows)
    steps = np.abs(np.diff(np.array([r[2:] for r in rows]), axis=0)).sum(1)
    assert (steps == 1).all()


def test_keys_and_paths_agree(spark):
    g = Grid(3, 10)
    df = generators.gaussian_octants(spark, g, 500, 3, (1, 10)).select(*g.row(g.lev(), [F.least(x, F.lit(1023)) for x in g.x()])).select(*g.row(g.lev(), g.lower())).distinct()
    rows = df.select(g.morton_key().alias("k"), "lev", g.path(root=False).alias("p")).collect()
    assert [r.p for r in sorted(rows, key=lambda r: (r.k, r.lev))] == sorted(r.p for r in rows)


def test_order_and_partitions(spark):
    g = Grid(2, 8)
    df = materialise(tree.construct(generators.gaussian_octants(spark, g, 400, 5).select("lev", *(F.least(x, F.lit(255)).alias(a) for a, x in zip(g.axes, g.x()))), g, 4))
    ranked = sorted(map(tuple, order.with_rank(df, g).select("rank", g.path(root=False)).collect()))
    assert [r[0] for r in ranked] == list(range(df.count())) and [r[1] for r in ranked] == sorted(r[1] for r in ranked)
    sizes = [30, 1, df.count() - 31]
    got = {r.part: r["count"] for r in order.scatter_to_sizes(df, g, sizes).groupBy("part").count().collect()}
    assert got == dict(enumerate(sizes))
    assert [r[0] for r in order.curve_sort(df, g).select(g.path(root=False)).collect()] == [r[1] for r in ranked]


def test_both_ways_of_point_location_agree(spark, monkeypatch):
    g = Grid(2, 8)
    pts = generators.gaussian_octants(spark, g, 300, 9)
    splits = materialise(order.splitters(order.partition_ranges(generators.uniform_tree(spark, g, 3), g, 7), g))
    key = lambda df: sorted(map(tuple, df.select("pid", "part").collect()))
    small = key(order.containing_part(pts, splits, g))
    monkeypatch.setattr(order, "BROADCAST_ROWS", 0)
    assert small == key(order.containing_part(pts, splits, g)) and len(small) == 300


def test_identity_operator_on_ones(spark):
    g = Grid(2, 10)
    mesh = elements.build_mesh(generators.centre_refined(spark, g, 3), g, 1)
    ones = vectors.fill(mesh.nodes, 1.0)
    count = lambda y: {r.v: r["count"] for r in y.groupBy(F.round("v", 6).alias("v")).count().collect()}
    assert count(elements.apply_operator(mesh, ones, None)) == {1.0: 4, 2.0: 12, 4.0: 9, 6.0: 8}
    assert count(elements.apply_operator(mesh, ones, elements.identity_kernel)) == {1.0: 4, 2.0: 12, 4.0: 9, 6.0: 8}
    assert count(elements.apply_operator(mesh, ones, None, compat_backinterp=True)) == {1.0: 4, 2.0: 12, 4.0: 9, 5.0: 8}


@pytest.mark.parametrize("p", [1, 2])
def test_mass_and_assembly(spark, p):
    g = Grid(2, 10)
    mesh = elements.build_mesh(generators.centre_refined(spark, g, 3), g, p)
    ones = vectors.fill(mesh.nodes, 1.0)
    y = elements.apply_operator(mesh, ones, elements.mass_kernel(2, p))
    assert y.agg(F.sum("v")).first()[0] == pytest.approx(1.0)
    flat = elements.apply_operator(mesh, ones, elements.stiffness_kernel(2, p))
    assert flat.agg(F.max(F.abs("v"))).first()[0] < 1e-9
    a = elements.assembled(mesh, elements.ReferenceElement(2, p).mass(), 2)
    by_row = {r.row: r.v for r in a.groupBy("row").agg(F.sum("val").alias("v")).collect()}
    assert all(by_row[r.node_id] == pytest.approx(r.v) for r in y.collect())
    # linear fields have no inner flux, hanging nodes or not
    x = vectors.by_function(mesh.nodes, [mesh.coordinates()[0]])
    flux = elements.apply_operator(mesh, x, elements.stiffness_kernel(2, p), None, elements.zero_boundary(mesh))
    assert flux.agg(F.max(F.abs("v"))).first()[0] < 1e-9


def test_heat_equation(spark):
    g = Grid(2, 10)
    mesh = elements.uniform_mesh(spark, g, 3, 2)
    x, y = mesh.coordinates()
    shape = F.sin(x * np.pi) * F.sin(y * np.pi)
    f = vectors.by_function(mesh.nodes, [2 * np.pi**2 * shape])
    u, steps, residual, ok = elements.conjugate_gradients(elements.HeatStiffness(mesh), elements.HeatRightSide(mesh)(f), 1e-4, 30)
    assert ok and residual <= 1e-4 and steps <= 30
    assert vectors.distance(u, vectors.by_function(mesh.nodes, [shape])).first().linf < 5e-3


def test_reference_element():
    ref = elements.ReferenceElement(3, 2)
    assert ref.mass().sum() == pytest.approx(1) and np.abs(ref.stiffness().sum(1)).max() < 1e-12
    u = np.random.default_rng(0).normal(size=(4, 27))
    assert np.allclose(ref.contract([ref.mass_1d] * 3, u), u @ ref.mass().T)
    for p in (1, 2, 4):
        assert np.allclose(elements.half_interpolation(p, 1).sum(1), 1)
        assert np.allclose(elements.half_interpolation(p, 0) @ (np.arange(p + 1) / p), np.arange(p + 1) / p / 2)
    assert np.allclose(elements.ReferenceElement(1, 3).lobatto, [0, (1 - 5**-0.5) / 2, (1 + 5**-0.5) / 2, 1])


def test_known_interpolation_weights():
    assert np.allclose(elements.half_interpolation(1, 0), [[1, 0], [0.5, 0.5]])
    assert np.allclose(elements.half_interpolation(2, 0), [[1, 0, 0], [3 / 8, 3 / 4, -1 / 8], [0, 1, 0]])
    assert np.allclose(elements.half_interpolation(2, 1), [[0, 1, 0], [-1 / 8, 3 / 4, 3 / 8], [0, 0, 1]])


@pytest.mark.parametrize("a,b", [(0, 0), (1, 1), (0.5, 2), (-0.5, -0.5)])
def test_jacobi_polynomials(a, b):
    x, w = basis.gauss(a, b, 7)
    p = np.stack([basis.jacobi(x, a, b, n) for n in range(6)])
    assert np.allclose(p * w @ p.T, np.eye(6))
    h = 1e-6
    assert np.allclose(basis.jacobi_slope(x, a, b, 4), (basis.jacobi(x + h, a, b, 4) - basis.jacobi(x - h, a, b, 4)) / (2 * h), atol=1e-5)
    assert np.allclose(basis.jacobi_slope(basis.lobatto(0, 0, 5)[1:-1], 0, 0, 5), 0)
    assert np.linalg.matrix_rank(basis.vandermonde(x, 7)) == 8


def test_exterior_orientations():
    assert exterior_orientations(3) == [3, 5, 6, 1, 2, 4, 0] and exterior_orientations(2, False) == [0, 1, 2]


def test_fields_on_rasters(spark):
    g = Grid(2, 10)
    for p in (1, 2):
        mesh = elements.build_mesh(generators.centre_refined(spark, g, 3), g, p)
        x, y = mesh.coordinates()
        got = rasterise_field(mesh, vectors.by_function(mesh.nodes, [x * 2 - y]), 4).collect()
        assert len(got) == 256 and all(r.v == pytest.approx((r.i0 + 0.5) / 8 - (r.i1 + 0.5) / 16) for r in got)


def test_refinement_by_function(spark):
    g = Grid(2, 12)
    flat = generators.refine_by_function(spark, g, lambda x: x[:, 0], 1, 1e-6, 6)
    assert tree.level_histogram(flat).collect() == [(1, 4)]
    mesh = elements.function_mesh(spark, g, lambda x: np.exp(-200 * ((x - 0.3) ** 2).sum(1)), 1, 0.05, 5)
    sizes = mesh.sizes()
    assert sizes["elements"] > 30 and tree.completeness(mesh.tree.select(*g.keys), g).first()[1:] == (1.0, 0)


def test_files(spark, tmp_path):
    g = Grid(3, 6)
    own = materialise(generators.boundary_refined(spark, g, 3))
    files.write_tree(own, g, str(tmp_path / "tree"), by_level=True)
    assert sorted(files.read_tree(spark, g, str(tmp_path / "tree")).collect()) == sorted(own.collect())
    v = own.select(F.monotonically_increasing_id().alias("node_id"), F.rand(1).alias("v"))
    v = materialise(v)
    files.write_vector(v, str(tmp_path / "v"))
    both = files.read_vectors(spark, str(tmp_path / "v"), str(tmp_path / "v"))
    assert both.filter("v0 <> v1").count() == 0 and both.count() == own.count()
    assert files.as_text(own, g).first()[0].count(" ") == 4
    parts = order.partition_ranges(own, g, 3)
    names = files.write_vtu(parts, g, str(tmp_path / "vtu"), "binary")
    assert len(names) >= 3 and all(n in files.pvtu_index(names) for n in names)
    bodies = [r.body for r in files.vtu_pieces(parts, g, "ascii").collect()]
    assert sum(int(b.split('NumberOfCells="')[1].split('"')[0]) for b in bodies) == own.count()
    ranges = files.box_ranges(g, [0, 0, 0], [20, 10, 63])
    marked = own.withColumn("p", g.path(root=False)).withColumn("inside", F.expr("x0 <= 20 and x1 <= 10"))
    anchored = marked.select(*g.row(g.depth, g.lower()), "inside").withColumn("p", g.path(root=False))
    assert anchored.filter("inside").filter(~files.in_ranges("p", ranges)).count() == 0


def test_base_nodes_and_gather_counts(spark):
    g = Grid(2, 6)
    node = frame(spark, g, [(3, 8, 4)])
    assert nodes.base_nodes(node, g).count() >= 1
    own = generators.uniform_tree(spark, g, 2)
    splits = materialise(order.splitters(order.partition_ranges(own, g, 4), g))
    moved = materialise(nodes.scatter_map(nodes.unique_nodes(own, g, 1), splits, g))
    a = {(r.src, r.dst): r.n for r in nodes.scatter_counts(moved).collect()}
    b = {(r.src, r.dst): r.n for r in nodes.gather_counts(moved).collect()}
    assert a == b and all(s != d for s, d in a)


def test_one_point_repeated_takes_many_ranges(spark):
    """A million equal points are ranked without one task getting them all."""
    grid = Grid(2, 20)
    points = spark.range(1_000_000, numPartitions=8).select(F.lit(20).alias("lev"), F.lit(7).cast("long").alias("x0"), F.lit(9).cast("long").alias("x1"))
    ranked = materialise(order.with_rank(points, grid))
    assert ranked.agg(F.countDistinct("rank"), F.max("rank")).first() == (1_000_000, 999_999)
    assert ranked.groupBy("part").count().agg(F.max("count")).first()[0] < 600_000
    keys = points.selectExpr("x0 AS k").unionByName(spark.range(10).selectExpr("id AS k"))
    found = order.max_lower_bound(keys, points.limit(100_000).selectExpr("x0 AS v"), "k", "v")
    assert {(r.k, r.v): r["count"] for r in found.groupBy("k", "v").count().collect()} == {(7, 7): 1_000_001, (8, 7): 1, (9, 7): 1} | {(k, None): 1 for k in range(7)}


def test_owners_across_a_coarse_face(spark):
    """A node in the middle of a coarse cell's face sees the owners around it; one that stands alone those at the centres of the faces around."""
    grid = Grid(2, 4)
    node = frame(spark, grid, [(1, 8, 4)])  # in the open face x0 = 8 of level 1
    near = {(r.x0, r.x1) for r in nodes.neighbour_keys(node, grid).collect()}
    assert near == {(8 + a, 4 + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b}
    off = {(r.x0, r.x1) for r in nodes.neighbour_keys(frame(spark, grid, [(1, 8, 3)]), grid, 1).collect()}
    assert off == {(8 + a, y + b) for y in (3, 4) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b}
    assert {(r.x0, r.x1) for r in nodes.neighbour_keys(frame(spark, grid, [(1, 8, 0)]), grid, 3).collect()} == {(8 + a, b) for a in (-1, 0, 1) for b in (0, 1) if a or b}
    single = {(r.x0, r.x1) for r in nodes.neighbour_keys(node, grid, single=True).collect()}
    assert single == {(8 + 4 * a - c, 4 + 4 * b - d) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (0, 1) for d in (0, 1) if 4 + 4 * b - d >= 0}
