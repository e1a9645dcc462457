"""Nodes of elements: generation, unique (conforming) nodes, boundary, owners, and maps between partitions.

A node row has the octant's columns with the coordinates of the node; ``lev`` is the level of the element that made it.
Order 1 nodes are resolved by counting, order 2 and up by an anti-join on open k-faces (``resolve_by_count`` serves order 2, too). Nodes on the domain's
boundary are kept once each without a hanging test unless ``strict_boundary`` is asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.functions.octant import Grid, all_of
from cellgrove.operators.order import containing_part


def element_nodes(tree: DataFrame, grid: Grid, order: int, *keep: str) -> DataFrame:
    """All (order + 1)^D nodes of every element, with ``slot`` in lexicographic order; coordinates by integer division."""
    rows = tree.select(*keep, *grid.keys, F.explode(F.sequence(F.lit(0), F.lit((order + 1) ** grid.dim - 1))).alias("slot"))
    place = [F.call_function("div", F.col("slot"), F.lit((order + 1) ** d)) % (order + 1) for d in range(grid.dim)]
    side = grid.side(grid.lev())
    xs = [x + F.call_function("div", side * i, F.lit(order)) for x, i in zip(grid.lower(), place)]
    return rows.select(*keep, *grid.row(grid.lev(), xs), "slot")


def _inner(grid: Grid, order: int) -> Column:
    place = [F.call_function("div", F.col("slot"), F.lit((order + 1) ** d)) % (order + 1) for d in range(grid.dim)]
    return all_of([(i > 0) & (i < order) for i in place])


def interior_nodes(tree: DataFrame, grid: Grid, order: int, *keep: str) -> DataFrame:
    return element_nodes(tree, grid, order, *keep).filter(_inner(grid, order))


def exterior_nodes(tree: DataFrame, grid: Grid, order: int, *keep: str) -> DataFrame:
    return element_nodes(tree, grid, order, *keep).filter(~_inner(grid, order))


def k_faces(tree: DataFrame, grid: Grid, *keep: str) -> DataFrame:
    """The 3^D open faces of every octant, itself included: orientation (axes in the face's volume) and the face's own anchor."""
    kinds = [[k // 3**d % 3 for d in range(grid.dim)] for k in range(3**grid.dim)]  # 0 lower face, 1 inside, 2 upper face
    rows = tree.select(*keep, *grid.keys, F.explode(F.array(*(F.array(*map(F.lit, k)) for k in kinds))).alias("_k"))
    side = grid.side(grid.lev())
    orient = reduce(lambda a, b: a + b, [F.when(F.col("_k")[d] == 1, 1 << d).otherwise(0) for d in range(grid.dim)])
    return rows.select(*keep, *grid.row(grid.lev(), [x + F.when(F.col("_k")[d] == 2, side).otherwise(0) for d, x in enumerate(grid.lower())]), orient.cast("int").alias("orient"))


def base_nodes(nodes: DataFrame, grid: Grid, *keep: str) -> DataFrame:
    """Corners of the parent-level cell face that a node lies in: the nodes that it may hang on."""
    up = F.greatest(grid.lev() - 1, F.lit(0))
    side = grid.side(up)
    rows = nodes.select(*keep, *grid.keys, F.explode(F.array(*map(F.lit, range(grid.children)))).alias("_c"))
    orient = grid.orientation(up)
    corner = [grid.mask(x, up) + F.when((F.col("_c").bitwiseAND(F.lit(1 << d)) != 0), side).otherwise(0) for d, x in enumerate(grid.x())]
    own = rows.filter(F.col("_c").bitwiseAND(F.bitwise_not(orient)) == 0)  # only along the face's own axes
    return own.select(*keep, *grid.row(up, corner))


def with_instances(nodes: DataFrame, grid: Grid) -> DataFrame:
    """Equal nodes of one level once, with how often they came."""
    return nodes.groupBy(*grid.keys).agg(F.count("*").alias("n_inst"))


def locations(nodes: DataFrame, grid: Grid) -> DataFrame:
    """(x.., n_inst, coarsest, finest) of every place; ``n_inst`` is 0 where levels mix."""
    out = nodes.groupBy(*grid.axes).agg(F.count("*").alias("n"), F.min("lev").alias("coarsest"), F.max("lev").alias("finest"))
    return out.select(*grid.axes, F.when(F.col("coarsest") == F.col("finest"), F.col("n")).otherwise(0).cast("long").alias("n_inst"), "coarsest", "finest")


def resolve_by_count(nodes: DataFrame, grid: Grid) -> DataFrame:
    """Orders 1 and 2: a place is a node where levels mix, or where as many elements meet as its open cell has neighbours, or on the boundary."""
    place = locations(nodes, grid)
    full = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(grid.dim) - F.bit_count(grid.orientation(F.col("coarsest"))))
    keep = grid.on_boundary() | (F.col("coarsest") != F.col("finest")) | (F.col("n_inst") == full)
    return place.filter(keep).select(F.col("coarsest").alias("lev"), *grid.axes)


def _face_key(grid: Grid, level: Column) -> list[Column]:
    return [level.cast("int").alias("k_lev"), grid.orientation(level).alias("k_orient"), *(grid.mask(x, level).alias(f"k_{a}") for a, x in zip(grid.axes, grid.x()))]


def resolve_by_faces(nodes: DataFrame, grid: Grid, strict_boundary: bool = False) -> DataFrame:
    """Orders 2 and up: a node hangs, and is dropped, if a node of the level above lies in the same open face of that level."""
    names = ["k_lev", "k_orient", *(f"k_{a}" for a in grid.axes)]
    own = nodes.select(*grid.keys).distinct()
    inner = own if strict_boundary else own.filter(~grid.on_boundary())
    coarse = inner.select(*_face_key(grid, grid.lev())).distinct()
    kept = inner.select(*grid.keys, *_face_key(grid, grid.lev() - 1)).join(coarse, names, "left_anti").select(*grid.keys)
    if not strict_boundary:
        kept = kept.unionByName(own.filter(grid.on_boundary()))
    return kept.groupBy(*grid.axes).agg(F.min("lev").alias("lev")).select(*grid.keys)


def unique_nodes(tree: DataFrame, grid: Grid, order: int, resolver=None) -> DataFrame:
    """The conforming nodes of a balanced tree: exterior nodes resolved, interior ones added. ``resolver`` takes nodes and grid; by default it goes by the order.

    From order 3 on, only exterior nodes are resolved; interior nodes are in one element and always stay.
    """
    if resolver is None:
        resolver = resolve_by_count if order <= 1 else resolve_by_faces
    outer = resolver(exterior_nodes(tree, grid, order), grid)
    if order < 2:
        return outer
    return outer.unionByName(interior_nodes(tree, grid, order).select(*grid.keys))


def boundary_nodes(nodes: DataFrame, grid: Grid) -> DataFrame:
    return nodes.filter(grid.on_boundary())


def with_node_ids(nodes: DataFrame, grid: Grid) -> DataFrame:
    """Nodes numbered from 0 in the order of the curve."""
    from cellgrove.operators.order import with_rank

    return with_rank(nodes, grid, "node_id", order=[_node_order(grid)]).drop("part")


def _node_order(grid: Grid) -> Column:
    """Morton order of node coordinates, upper faces of the domain included: one digit more on top."""
    bits = lambda k: sum((F.call_function("shiftleft", F.call_function("shiftright", x, F.lit(k)).bitwiseAND(F.lit(1).cast("long")), F.lit(d)) for d, x in enumerate(grid.x())), F.lit(0).cast("long"))
    return F.concat(*(F.lower(F.hex(bits(k))) for k in range(grid.depth, -1, -1)))


def owners(nodes: DataFrame, splits: DataFrame, grid: Grid) -> DataFrame:
    """``nodes`` with the part that holds the finest cell at their place."""
    fine = nodes.select("*", F.lit(grid.depth).alias("_lev")).withColumnRenamed("lev", "_node_lev").withColumnRenamed("_lev", "lev")
    out = containing_part(fine, splits, grid, "owner")
    return out.drop("lev").withColumnRenamed("_node_lev", "lev").select(*nodes.columns, "owner")


def neighbour_keys(nodes: DataFrame, grid: Grid, order: int = 1, single: bool = False, *keep: str) -> DataFrame:
    """(keep.., lev, x..): points of the finest level whose owners hold elements at each node.

    These are the 3^D - 1 points around the node and, for a node inside an open face of its level and near the face's centre (for
    ``order`` 1 and 2 any), those around that centre: finer elements across a coarse face meet there. With ``single``, for a node
    whose elements' other nodes are not at hand, it is the 2^D cells at the centres of the node's face and of all faces around it.
    """
    level, side = grid.lev(), grid.side(grid.lev())
    lower = [grid.mask(x, level) for x in grid.x()]
    inside = [x != a for x, a in zip(grid.x(), lower)]
    centre = [a + F.when(i, F.call_function("div", side, F.lit(2))).otherwise(0) for a, i in zip(lower, inside)]
    array = lambda xs: F.array(*(x.cast("long") for x in xs))
    if single:
        half = F.call_function("div", side, F.lit(2))
        around = F.array(*(array([c + half * k for c, k in zip(centre, o)]) for o in grid.offsets(own=True)))
        shifts = [[-(k >> d & 1) for d in range(grid.dim)] for k in range(grid.children)]
    else:
        near = all_of([~i | (F.abs(x - a - F.call_function("div", side, F.lit(2))) * order < side) for x, a, i in zip(grid.x(), lower, inside)]) & (grid.orientation(level) != 0)
        around = F.array(array(grid.x()), F.when(near, array(centre)))
        shifts = grid.offsets()
    rows = nodes.select(*keep, F.explode(around).alias("_p")).filter("_p is not null")
    rows = rows.select(*keep, "_p", F.explode(F.array(*(F.array(*map(F.lit, o)) for o in shifts))).alias("_d"))
    rows = rows.select(*keep, F.lit(grid.depth).alias("lev"), *((F.col("_p")[d] + F.col("_d")[d]).cast("long").alias(a) for d, a in enumerate(grid.axes)))
    return rows.filter(all_of([(x >= 0) & (x <= 1 << grid.depth) for x in grid.x()])).distinct()


def neighbour_parts(nodes: DataFrame, splits: DataFrame, grid: Grid, *keep: str, order: int = 1, single: bool = False) -> DataFrame:
    """(keep.., part): the distinct parts that own elements at each node."""
    return containing_part(neighbour_keys(nodes, grid, order, single, *keep), splits, grid, "part").select(*keep, "part").distinct()


def scatter_map(nodes: DataFrame, splits: DataFrame, grid: Grid, order: int = 1, single: bool = False) -> DataFrame:
    """(x.., src, dst): every owned node with each other part around it."""
    named = nodes.select(*grid.axes, *(F.col(a).alias(f"n_{a}") for a in grid.axes), F.col("lev").alias("n_lev"), F.lit(grid.depth).alias("lev"))
    owned = containing_part(named, splits, grid, "src").select(*(f"n_{a}" for a in grid.axes), F.col("n_lev").alias("lev"), *grid.axes, "src")
    near = neighbour_parts(owned, splits, grid, *(f"n_{a}" for a in grid.axes), "src", order=order, single=single)
    return near.filter("part <> src").select(*(F.col(f"n_{a}").alias(a) for a in grid.axes), "src", F.col("part").alias("dst"))


def scatter_counts(scatter: DataFrame) -> DataFrame:
    return scatter.groupBy("src", "dst").agg(F.count("*").alias("n"))


def gather_counts(scatter: DataFrame) -> DataFrame:
    """(dst, src, n): what every part gets from every other."""
    return scatter.groupBy("dst", "src").agg(F.count("*").alias("n"))


__all__ = ["element_nodes", "interior_nodes", "exterior_nodes", "k_faces", "base_nodes", "with_instances", "locations", "resolve_by_count", "resolve_by_faces", "unique_nodes", "boundary_nodes", "with_node_ids", "owners", "neighbour_keys", "neighbour_parts", "scatter_map", "scatter_counts", "gather_counts"]
