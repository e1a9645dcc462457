"""Registered queries over the test tables, one or more for each operator, each with the same question in DuckDB's SQL.

Most work on three relations. ``pts``: line items as points, quantity by discount, on 2^8 cells an axis of a grid of depth 20.
``octs``: the same as octants of levels 1 to 7, by line number. ``tree`` and ``balanced``: the adaptive tree of ``pts`` with
at most 8 points a leaf down to level 8, and its 2:1 balanced refinement.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrove.functions import bits, curve, points
from cellgrove.functions.octant import DIGITS, Grid
from cellgrove.operators import elements, nodes, order, tree, vectors
from cellgrove.plans.work import materialise
from cellgrove.sources import generators
from cellgrove.sources.raster import rasterise

G = Grid(2, 20)
CAP, POINTS = 8, 8
G3, G4 = Grid(3, 5), Grid(4, 6)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the depth-8 grid, as cells of depth 20."""
    coarse = generators.lineitem_points(read(spark, sf_dir, "lineitem"), Grid(2, CAP))
    return coarse.select(*G.row(G.depth, [F.col(a) * (1 << G.depth - CAP) for a in G.axes]))


def octs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem")
    units = [(F.col("l_quantity") - 1) / 50.0, F.col("l_discount") / 0.11]
    raw = items.select(F.col("l_linenumber").alias("lev"), *((F.floor(u * float(1 << CAP)).cast("long") * (1 << G.depth - CAP)).alias(a) for a, u in zip(G.axes, units)))
    return raw.select(*G.row(G.lev(), G.lower())).distinct()


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.construct(pts(spark, sf_dir), G, POINTS, CAP)


def balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.balance(pts(spark, sf_dir), G, POINTS, CAP)


# ---- the same relations in SQL -------------------------------------------------------------------------------------


def cut(x: str, level: str, depth: int = 20) -> str:
    return f"(({x} >> ({depth} - ({level}))::INT) << ({depth} - ({level}))::INT)"


def side(level: str, depth: int = 20) -> str:
    return f"(1::BIGINT << ({depth} - ({level}))::INT)"


X = ["x0", "x1"]
UNITS = ["floor((l_quantity - 1) / 50.0 * 256)::BIGINT * 4096", "floor(l_discount / 0.11 * 256)::BIGINT * 4096"]
NUMBER = lambda level, d=2, m=20: "(" + " + ".join(f"(((x{i} >> ({m} - ({level}))::INT) & 1) << {i})" for i in range(d)) + ")"


def children_sql(source: str, d: int = 2, m: int = 20) -> str:
    return f"SELECT lev + 1 AS lev, {', '.join(f'x{i} + ((c >> {i}) & 1) * ' + side('lev + 1', m) + f' AS x{i}' for i in range(d))} FROM {source}, unnest(range({1 << d})) u(c)"


def construct_sql(source: str, prefix: str, top: int, most: int, d: int = 2, m: int = 20) -> str:
    """CTEs ``{prefix}split`` and ``{prefix}`` with the leaves, from points in ``source``."""
    xs = ", ".join(f"x{i}" for i in range(d))
    up = ", ".join(f"{cut(f'x{i}', 'l', m)} AS x{i}" for i in range(d))
    return (
        f"{prefix}_up AS (SELECT l::INT AS lev, {up}, count(*) AS n FROM {source}, unnest(range(1, {top})) u(l) WHERE l <= lev GROUP BY ALL), "
        f"{prefix}_split AS (SELECT 0 AS lev, {', '.join(f'0::BIGINT AS x{i}' for i in range(d))} WHERE EXISTS (FROM {source}) UNION ALL SELECT lev, {xs} FROM {prefix}_up WHERE n > {most}), "
        f"{prefix} AS (SELECT lev::INT AS lev, {xs} FROM ({children_sql(f'{prefix}_split', d, m)}) k ANTI JOIN (FROM {prefix}_split WHERE lev > 0) s USING (lev, {xs}))"
    )


PTS = f"pts AS (SELECT 20 AS lev, {UNITS[0]} AS x0, {UNITS[1]} AS x1 FROM lineitem)"
OCTS = f"octs AS (SELECT DISTINCT l_linenumber::INT AS lev, {cut(UNITS[0], 'l_linenumber')} AS x0, {cut(UNITS[1], 'l_linenumber')} AS x1 FROM lineitem)"
TREE = f"{PTS}, {construct_sql('pts', 'tree', CAP, POINTS)}"
AROUND = "around AS (SELECT a - 1 AS o0, b - 1 AS o1 FROM unnest(range(3)) u(a), unnest(range(3)) v(b))"
INSIDE = "y0 >= 0 AND y0 < 1048576 AND y1 >= 0 AND y1 < 1048576"
CLOSURE = (
    f"closure AS (SELECT lev, x0, x1 FROM tree UNION SELECT lev, y0, y1 FROM (SELECT (lev - 1)::INT AS lev, {cut('x0', 'lev - 1')} + o0 * {side('lev - 1')} AS y0, {cut('x1', 'lev - 1')} + o1 * {side('lev - 1')} AS y1 FROM closure, around WHERE lev > 0) k WHERE {INSIDE})"
)
BALANCED = f"{TREE}, {AROUND}, {CLOSURE}, {construct_sql('closure', 'balanced', 20, 1)}"
SLOTS = lambda p: f"slots AS (SELECT *, s % {p + 1} AS i0, s // {p + 1} AS i1 FROM unnest(range({(p + 1) ** 2})) u(s))"
ELEMENT = lambda p, source: f"SELECT e.lev, e.x0 + ({side('e.lev')} * i0) // {p} AS x0, e.x1 + ({side('e.lev')} * i1) // {p} AS x1, s AS slot, i0, i1 FROM {source} e, slots"
ON_EDGE = "(x0 = 0 OR x1 = 0 OR x0 = 1048576 OR x1 = 1048576)"
ORIENT = lambda level: f"(CASE WHEN x0 = {cut('x0', level)} THEN 0 ELSE 1 END + CASE WHEN x1 = {cut('x1', level)} THEN 0 ELSE 2 END)"


def cg_sql(p: int, source: str = "balanced") -> str:
    """CTE ``cg``: unique nodes of order p."""
    out = f"{SLOTS(p)}, every AS ({ELEMENT(p, source)}), outer_ AS (SELECT * FROM every WHERE i0 = 0 OR i1 = 0 OR i0 = {p} OR i1 = {p}), "
    if p == 1:
        return out + f"place AS (SELECT x0, x1, count(*) AS n, min(lev) AS lo, max(lev) AS hi FROM outer_ GROUP BY ALL), cg AS (SELECT lo AS lev, x0, x1 FROM place WHERE {ON_EDGE} OR lo <> hi OR n = (1 << (2 - bit_count({ORIENT('lo')}))::INT))"
    key = lambda level: f"{level} AS kl, {ORIENT(level)} AS ko, {cut('x0', level)} AS k0, {cut('x1', level)} AS k1"
    return out + (
        f"own AS (SELECT DISTINCT lev, x0, x1 FROM outer_), keyed AS (SELECT lev, x0, x1, {key('lev - 1')} FROM own WHERE NOT {ON_EDGE}), coarse AS (SELECT DISTINCT {key('lev')} FROM own WHERE NOT {ON_EDGE}), "
        f"kept AS (SELECT lev, x0, x1 FROM keyed ANTI JOIN coarse USING (kl, ko, k0, k1) UNION ALL SELECT lev, x0, x1 FROM own WHERE {ON_EDGE}), "
        f"cg AS (SELECT min(lev)::INT AS lev, x0, x1 FROM kept GROUP BY x0, x1 UNION ALL SELECT lev::INT, x0, x1 FROM every WHERE i0 > 0 AND i1 > 0 AND i0 < {p} AND i1 < {p})"
    )


def hilbert_sql(source: str, levels: int) -> str:
    """CTEs up to ``hil`` with the 2-D Hilbert key ``k`` of the first levels."""
    place, nxt = curve.hilbert_tables(2)
    flat = lambda t: str([v for row in t for v in row])
    out = [f"hil0 AS (SELECT *, 0::BIGINT AS k, 0 AS s FROM {source})"]
    for level in range(1, levels + 1):
        at = f"s * 4 + {NUMBER(str(level))} + 1"
        out.append(f"hil{level} AS (SELECT * REPLACE (CASE WHEN lev >= {level} THEN k * 4 + {flat(place)}[({at})::INT] ELSE k * 4 END AS k, CASE WHEN lev >= {level} THEN {flat(nxt)}[({at})::INT] ELSE s END AS s) FROM hil{level - 1})")
    return ", ".join(out)


PATH = "array_to_string([substr('" + DIGITS + "', (" + NUMBER("l") + " + 1)::INT, 1) FOR l IN range(1, lev + 1)], '')"

# ---- functions on octants ------------------------------------------------------------------------------------------


@query(
    f"""WITH {OCTS} SELECT lev, x0, x1, {NUMBER('lev')}::INT AS child, {side('lev')} AS side, x0 + {side('lev')} AS u0, x1 + {side('lev')} AS u1,
    (x0 = 0 OR x1 = 0 OR x0 + {side('lev')} = 1048576 OR x1 + {side('lev')} = 1048576) AS touches, {ON_EDGE} AS on_face, lev = 0 AS root,
    (CASE WHEN x0 = {cut('x0', 'lev - 1')} THEN 0 WHEN x1 = {cut('x1', 'lev - 1')} THEN 1 ELSE 2 END)::INT AS hyperplane,
    ((x0 = {cut('x0', 'lev - 1')})::INT + (x1 = {cut('x1', 'lev - 1')})::INT)::INT AS aligned, {ORIENT('lev - 1')}::INT AS orient,
    ({ORIENT('lev')} <> {ORIENT('lev - 1')}) AS crossing, CASE WHEN {ON_EDGE} THEN -1 ELSE 19 - greatest(bit_count((x0 & -x0) - 1), bit_count((x1 & -x1) - 1)) END::INT AS container,
    '0' || {PATH} AS path FROM octs"""
)
def octant_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = F.col("lev") - 1
    return octs(spark, sf_dir).select(
        *G.keys, G.child_number(F.col("lev")).alias("child"), G.side(F.col("lev")).alias("side"), *(u.alias(f"u{d}") for d, u in enumerate(G.upper())), G.touches_boundary().alias("touches"), G.on_boundary().alias("on_face"), G.is_root().alias("root"),
        G.first_hyperplane(up).alias("hyperplane"), G.aligned_axes(up).alias("aligned"), G.orientation(up).alias("orient"), G.is_crossing().alias("crossing"), G.container_level().alias("container"), G.path().alias("path"),
    )


@query(f"WITH {OCTS} SELECT lev, x0, x1, (lev - 1)::INT AS p_lev, {cut('x0', 'lev - 1')} AS p_x0, {cut('x1', 'lev - 1')} AS p_x1, least(lev, 2)::INT AS a_lev, {cut('x0', 'least(lev, 2)')} AS a_x0, {cut('x1', 'least(lev, 2)')} AS a_x1 FROM octs")
def octant_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda cols, p: [c.alias(f"{p}_{k}") for c, k in zip(cols, G.keys)]
    return octs(spark, sf_dir).select(*G.keys, *named(G.parent(), "p"), *named(G.ancestor(F.least(F.col("lev"), F.lit(2))), "a"))


@query(f"WITH {OCTS} {children_sql('octs')}")
def octant_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.with_children(octs(spark, sf_dir))


@query(f"WITH {OCTS} SELECT lev, x0, x1, x0 AS f0, x1 AS f1, x0 + {side('lev')} - 1 AS l0, x1 + {side('lev')} - 1 AS l1, x0 - (((x0 >> (20 - lev)::INT) & 1) << (20 - lev)::INT) + {side('lev')} AS s0, x1 - (((x1 >> (20 - lev)::INT) & 1) << (20 - lev)::INT) AS s1 FROM octs")
def octant_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last descendants, and the sibling with child number 1."""
    pick = lambda cols, p: [c.alias(f"{p}{d}") for d, c in enumerate(cols[1:])]
    return octs(spark, sf_dir).select(*G.keys, *pick(G.first_descendant(), "f"), *pick(G.last_descendant(), "l"), *pick(G.with_child_number(1), "s"))


@query(f"WITH {OCTS}, {AROUND} SELECT lev, y0 AS x0, y1 AS x1, a0, a1 FROM (SELECT lev, x0 AS a0, x1 AS a1, x0 + o0 * {side('lev')} AS y0, x1 + o1 * {side('lev')} AS y1 FROM octs, around WHERE NOT (o0 = 0 AND o1 = 0)) k WHERE {INSIDE}")
def octant_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = octs(spark, sf_dir).select("*", F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    return G.with_neighbours(named, "a0", "a1").select(*G.keys, "a0", "a1")


@query(f"WITH {OCTS} SELECT lev, x0, x1, lev AS n_lev, x0 + {side('lev')} AS n_x0, x1 AS n_x1 FROM octs WHERE x0 + {side('lev')} < 1048576")
def octant_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return octs(spark, sf_dir).select(*G.keys, *(c.alias(f"n_{k}") for c, k in zip(G.neighbour([1, 0]), G.keys))).filter("n_lev is not null")


@query(f"WITH {OCTS} SELECT lev, x0, x1, (SELECT max(l) FROM unnest(range(0, 21)) u(l) WHERE l <= lev AND {cut('x0', 'l')} = {cut('x1', 'l')})::INT AS depth FROM octs")
def common_ancestor_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every octant and its mirror image."""
    rows = octs(spark, sf_dir).select(*G.keys, *(F.col(k).alias(f"a_{k}") for k in G.keys), F.col("lev").alias("b_lev"), F.col("x1").alias("b_x0"), F.col("x0").alias("b_x1"))
    return rows.select(*G.keys, G.common_ancestor_depth("a_", "b_").alias("depth"))


@query(f"WITH {OCTS} SELECT lev, x0, x1, {PATH} AS path FROM octs")
def morton_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return octs(spark, sf_dir).select(*G.keys, G.path(root=False).alias("path"))


@query(f"WITH {OCTS} SELECT lev, x0, x1, (row_number() OVER (ORDER BY {PATH}) - 1)::BIGINT AS rank FROM octs")
def morton_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.with_rank(octs(spark, sf_dir), G).drop("part")


@query(f"WITH {OCTS}, {hilbert_sql('octs', 7)} SELECT lev, x0, x1, k AS hilbert, (row_number() OVER (ORDER BY k, lev) - 1)::BIGINT AS rank FROM hil7")
def hilbert_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = Grid(2, 7)
    rows = octs(spark, sf_dir).select("lev", *((F.col(a) / (1 << 13)).cast("long").alias(a) for a in G.axes)).withColumn("hilbert", curve.hilbert_key(small))
    return order.with_rank(rows, small, curve="hilbert").select("lev", *((F.col(a) * (1 << 13)).alias(a) for a in G.axes), "hilbert", "rank")


@query(f"WITH {OCTS} SELECT a.lev, a.x0, a.x1, count(*) AS n FROM octs a, octs b WHERE a.lev < b.lev AND a.x0 = {cut('b.x0', 'a.lev')} AND a.x1 = {cut('b.x1', 'a.lev')} GROUP BY ALL")
def pred_is_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Octants with the number of others that they hold: an equi-join on laid-out ancestors."""
    own = octs(spark, sf_dir)
    up = own.filter("lev > 1").select(*G.axes, F.explode(F.sequence(F.lit(1), F.col("lev") - 1)).alias("l")).select(*G.row(F.col("l"), [G.mask(x, F.col("l")) for x in G.x()]))
    return up.groupBy(*G.keys).agg(F.count("*").alias("n")).join(own, G.keys, "left_semi")


@query(f"WITH {OCTS} SELECT lev, count(*) FILTER (x0 = 0 OR x1 = 0 OR x0 + {side('lev')} = 1048576 OR x1 + {side('lev')} = 1048576) AS touching, count(*) AS n FROM octs GROUP BY lev")
def pred_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return octs(spark, sf_dir).groupBy("lev").agg(F.count_if(G.touches_boundary()).alias("touching"), F.count("*").alias("n"))


BITS = "SELECT p_partkey, (p_size > 0 AND bit_count(p_size) = 1) AS power, length(bin(p_size))::INT AS width, CASE WHEN p_size > 0 THEN floor(log2(p_size))::INT END AS log2, lpad(bin(p_size), 8, '0') AS binary, CASE WHEN p_size <= 1 THEN 1 ELSE 1::BIGINT << length(bin(p_size - 1))::INT END AS up, CASE WHEN p_size >= 1 THEN 1::BIGINT << (length(bin(p_size)) - 1)::INT END AS down, (p_size | 4)::BIGINT AS with4, ((p_size >> 1) & 1)::INT AS bit1 FROM part"


@query(BITS)
def bit_utilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("p_size").cast("long")
    return read(spark, sf_dir, "part").select("p_partkey", bits.is_power_of_two(x).alias("power"), bits.bit_length(x).alias("width"), bits.floor_log2(x).alias("log2"), bits.to_binary(x, 8).alias("binary"), bits.next_power_of_two(x).alias("up"), bits.previous_power_of_two(x).alias("down"), bits.set_bit(x, 2).alias("with4"), bits.get_bit(x, 1).cast("int").alias("bit1"))


@query("SELECT l_orderkey, l_linenumber, round(a0*b0 + a1*b1 + a2*b2, 6) AS dot, round(a1*b2 - a2*b1, 6) AS c0, round(a2*b0 - a0*b2, 6) AS c1, round(a0*b1 - a1*b0, 6) AS c2, round(sqrt(a0*a0 + a1*a1 + a2*a2), 6) AS size, round(a0 + b0, 6) AS s0, round((a0 - b0) / 2, 6) AS d0 FROM (SELECT l_orderkey, l_linenumber, l_quantity AS a0, l_discount AS a1, l_tax AS a2, l_tax AS b0, l_quantity AS b1, l_discount AS b2 FROM lineitem)")
def point_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = [F.col(c) for c in ("l_quantity", "l_discount", "l_tax")]
    b = [a[2], a[0], a[1]]
    c = points.cross(a, b)
    r = lambda x: F.round(x, 6)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r(points.dot(a, b)).alias("dot"), *(r(x).alias(f"c{i}") for i, x in enumerate(c)), r(points.magnitude(a)).alias("size"), r(points.add(a, b)[0]).alias("s0"), r(points.divide(points.subtract(a, b), 2)[0]).alias("d0"))


# ---- trees ---------------------------------------------------------------------------------------------------------


@query(f"WITH {TREE} SELECT lev, x0, x1 FROM tree")
def tree_construct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(spark, sf_dir)


@query(f"WITH {TREE} SELECT lev, count(*) AS n FROM tree GROUP BY lev")
def tree_level_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.level_histogram(leaves(spark, sf_dir))


PTS3 = "pts AS (SELECT 5 AS lev, floor((l_quantity - 1) / 50.0 * 32)::BIGINT AS x0, floor(l_discount / 0.11 * 32)::BIGINT AS x1, floor(l_tax / 0.09 * 32)::BIGINT AS x2 FROM lineitem)"
PTS4 = "pts AS (SELECT 6 AS lev, (l_quantity::BIGINT - 1) * 64 // 50 AS x0, round(l_extendedprice * 100)::BIGINT * 64 // 10500001 AS x1, round(l_discount * 100)::BIGINT * 64 // 11 AS x2, date_diff('day', DATE '1995-01-01', l_shipdate::DATE) * 64 // 2560 AS x3 FROM lineitem)"


@query(f"WITH {PTS3}, {construct_sql('pts', 'tree', 5, 16, 3, 5)} SELECT lev, x0, x1, x2 FROM tree")
def tree_construct_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.construct(generators.lineitem_points(read(spark, sf_dir, "lineitem"), G3), G3, 16)


@query(f"WITH {PTS4}, {construct_sql('pts', 'tree', 6, 8, 4, 6)} SELECT lev, x0, x1, x2, x3 FROM tree")
def tree_construct_4d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.construct(generators.lineitem_points(read(spark, sf_dir, "lineitem"), G4), G4, 8)


EVENTS = "pts AS (SELECT 6 AS lev, least(63, greatest(0, floor(user_id / 1500.0 * 64)))::BIGINT AS x0, least(63, greatest(0, floor(value / 600.0 * 64)))::BIGINT AS x1, least(63, greatest(0, floor((epoch(ts)::BIGINT - epoch(TIMESTAMP '2024-01-01')::BIGINT) / 2678400.0 * 64)))::BIGINT AS x2 FROM events)"


@query(f"WITH {EVENTS}, {construct_sql('pts', 'tree', 6, 4, 3, 6)} SELECT lev, x0, x1, x2 FROM tree")
def tree_construct_space_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Grid(3, 6)
    return tree.construct(generators.event_points(read(spark, sf_dir, "events"), g, 1500, 600.0), g, 4)


@query(f"WITH {TREE} SELECT (SELECT count(*) FROM tree) AS leaves, (SELECT sum(pow(0.5, lev * 2)) FROM tree) AS measure, (SELECT count(*) FROM tree a WHERE EXISTS (FROM tree b WHERE b.lev > a.lev AND a.x0 = {cut('b.x0', 'a.lev')} AND a.x1 = {cut('b.x1', 'a.lev')})) AS overlaps")
def tree_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.completeness(materialise(leaves(spark, sf_dir)), G)


@query(f"WITH {OCTS} SELECT DISTINCT lev, x0, x1 FROM octs")
def dedup_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = octs(spark, sf_dir)
    return tree.remove_duplicates(both.unionByName(both), G)


@query(f"WITH {OCTS} SELECT lev, x0, x1 FROM octs a WHERE NOT EXISTS (FROM octs b WHERE b.lev > a.lev AND a.x0 = {cut('b.x0', 'a.lev')} AND a.x1 = {cut('b.x1', 'a.lev')})")
def dedup_keep_finest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.remove_ancestors(octs(spark, sf_dir), G)


@query(f"WITH RECURSIVE {TREE}, {AROUND}, {CLOSURE} SELECT lev, x0, x1 FROM closure")
def propagate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.propagate_neighbours(leaves(spark, sf_dir), G)


@query(f"WITH RECURSIVE {BALANCED} SELECT lev, x0, x1 FROM balanced")
def tree_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced(spark, sf_dir)


@query(
    f"""WITH {TREE}, {AROUND}, near AS (SELECT DISTINCT a_lev, a_x0, a_x1, l::INT AS lev, {cut('y0', 'l')} AS x0, {cut('y1', 'l')} AS x1 FROM (SELECT lev AS a_lev, x0 AS a_x0, x1 AS a_x1, x0 + o0 * {side('lev')} AS y0, x1 + o1 * {side('lev')} AS y1 FROM tree, around WHERE lev >= 2), unnest(range(0, a_lev - 1)) u(l) WHERE {INSIDE})
    SELECT a_lev AS lev, a_x0 AS x0, a_x1 AS x1, lev AS near_lev, x0 AS near_x0, x1 AS near_x1 FROM near JOIN tree USING (lev, x0, x1)"""
)
def balance_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.balance_violations(materialise(leaves(spark, sf_dir)), G)


@query(f"WITH {TREE} SELECT lev, x0, x1 FROM tree WHERE x0 <= 524288 AND 524288 <= x0 + {side('lev')}")
def slice_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.slice_tree(leaves(spark, sf_dir), G, 0, 1 << 19)


@query(f"WITH {TREE} SELECT lev, x0 FROM tree WHERE x1 <= 524288 AND 524288 <= x1 + {side('lev')}")
def project_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.project_slice(leaves(spark, sf_dir), G, 1, 1 << 19)


@query(f"WITH {TREE}, up AS (SELECT l::INT AS lev, {cut('x0', 'l')} AS x0, {cut('x1', 'l')} AS x1, count(*) AS n FROM tree, unnest(range(1, 9)) u(l) WHERE l <= lev GROUP BY ALL) SELECT lev, max(n) AS most FROM up GROUP BY lev")
def subtree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.subtree_sizes(leaves(spark, sf_dir), G)


@query(f"WITH {TREE} SELECT lev, x1 AS x0, x0 AS x1 FROM tree")
def permute_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.permute_axes(leaves(spark, sf_dir), [1, 0])


@query(f"WITH {TREE} SELECT lev, x0, x1, CASE WHEN lev <= 5 THEN 0 WHEN lev = 6 THEN 1 ELSE 2 END AS stratum FROM tree")
def stratify_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = tree.stratify(materialise(leaves(spark, sf_dir)), range(5, 8))
    out = [p.withColumn("stratum", F.lit(i)) for i, p in enumerate(parts)]
    return out[0].unionByName(out[1]).unionByName(out[2])


RUNS = f"ranked AS (SELECT lev, x0, x1, row_number() OVER (ORDER BY {PATH}) - 1 AS r, lag(lev) OVER (ORDER BY {PATH}) AS before FROM tree), runs AS (SELECT *, sum(CASE WHEN before = lev THEN 0 ELSE 1 END) OVER (ORDER BY r) - 1 AS seg FROM ranked)"


@query(f"WITH {TREE}, {RUNS} SELECT seg::BIGINT AS seg, min(lev)::INT AS lev, max(r)::BIGINT AS end_rank FROM runs GROUP BY seg")
def compress_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.compress_levels(leaves(spark, sf_dir), G)[0]


@query(f"WITH {TREE}, {RUNS} SELECT seg::BIGINT AS seg, lev, x0, x1 FROM runs WHERE before IS NULL OR before <> lev")
def compress_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.compress_levels(leaves(spark, sf_dir), G)[1]


BUCKETS = f"SELECT (CASE WHEN lev < 3 THEN -1 ELSE {NUMBER('3')} END)::INT AS child, count(*) AS n FROM octs GROUP BY ALL"


@query(f"WITH {OCTS} {BUCKETS}")
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.bucket_counts(octs(spark, sf_dir), G, 3)


@query(f"WITH {OCTS}, b AS ({BUCKETS}) SELECT child, n, (sum(n) OVER (ORDER BY child) - n)::BIGINT AS start, (sum(n) OVER (ORDER BY child))::BIGINT AS \"end\" FROM b")
def bucket_prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.bucket_offsets(octs(spark, sf_dir), G, 3)


# ---- partitions ----------------------------------------------------------------------------------------------------

PARTS = 8
RANGES = f"ranges AS (SELECT lev, x0, x1, {PATH} AS path, (((row_number() OVER (ORDER BY {PATH}) - 1) * {PARTS}) // count(*) OVER ())::INT AS part FROM tree)"
SPLITS = "splits AS (SELECT part, min(path) AS path FROM ranges GROUP BY part)"


@query(f"WITH {TREE}, {RANGES} SELECT lev, x0, x1, part FROM ranges")
def partition_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.partition_ranges(leaves(spark, sf_dir), G, PARTS)


@query(f"WITH {TREE}, w AS (SELECT *, sum(lev) OVER (ORDER BY {PATH}) - lev / 2.0 AS mid, sum(lev) OVER () AS total FROM tree) SELECT lev, x0, x1, least({PARTS - 1}, floor(mid * {PARTS} / total))::INT AS part FROM w")
def partition_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.partition_weighted(leaves(spark, sf_dir), G, F.col("lev"), PARTS)


@query(f"WITH {TREE}, {RANGES} SELECT part, lev, x0, x1 FROM ranges QUALIFY row_number() OVER (PARTITION BY part ORDER BY path) = 1")
def splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.splitters(order.partition_ranges(leaves(spark, sf_dir), G, PARTS), G)


def _splits(spark: SparkSession, sf_dir: str, of: DataFrame) -> DataFrame:
    return materialise(order.splitters(order.partition_ranges(of, G, PARTS), G))


@query(f"WITH {TREE}, {RANGES}, {SPLITS}, p AS (SELECT x0, x1, {PATH} AS path FROM pts) SELECT part, count(*) AS n FROM p ASOF JOIN splits s ON p.path >= s.path GROUP BY part")
def containing_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.containing_part(pts(spark, sf_dir), _splits(spark, sf_dir, leaves(spark, sf_dir)), G).groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT l_extendedprice, k AS o_totalprice FROM lineitem l ASOF LEFT JOIN (SELECT o_totalprice AS k FROM orders) o ON l.l_extendedprice >= o.k")
def max_lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Looked up in all orders; null where no order is as cheap."""
    return order.max_lower_bound(read(spark, sf_dir, "lineitem").select("l_extendedprice"), read(spark, sf_dir, "orders"), "l_extendedprice", "o_totalprice")


@query("SELECT price, k AS o_totalprice FROM (SELECT l_extendedprice * 8 AS price FROM lineitem) l ASOF LEFT JOIN (SELECT o_totalprice AS k FROM orders) o ON l.price < o.k")
def min_upper_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Looked up in all orders; null where no order is dearer."""
    return order.min_upper_bound(read(spark, sf_dir, "lineitem").select(F.expr("l_extendedprice * 8").alias("price")), read(spark, sf_dir, "orders"), "price", "o_totalprice")


@query(f"WITH {TREE}, {RANGES} SELECT lev, x0, x1 FROM ranges WHERE part = 3")
def prune_to_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.prune_to_part(leaves(spark, sf_dir), G, 3, PARTS)


FACE = ", ".join(f"{cut(f'x{i}', 'lev')} + CASE WHEN x{i} <> {cut(f'x{i}', 'lev')} THEN {side('lev')} // 2 ELSE 0 END AS c{i}" for i in range(2))
CLOSED = "y0 >= 0 AND y1 >= 0 AND y0 <= 1048576 AND y1 <= 1048576"
CLAMPED = f"SELECT n0, n1, {PATH} AS path FROM (SELECT n0, n1, least(y0, 1048575) AS x0, least(y1, 1048575) AS x1, 20 AS lev FROM {{}})"
NEAR_NODES = (
    f"{cg_sql(1)}, {RANGES.replace('FROM tree', 'FROM balanced')}, {SPLITS}, faces AS (SELECT *, {FACE} FROM cg), "
    f"spots AS (SELECT x0 AS n0, x1 AS n1, x0 AS p0, x1 AS p1 FROM faces UNION ALL SELECT x0, x1, c0, c1 FROM faces WHERE {ORIENT('lev')} <> 0), "
    f"keys AS (SELECT n0, n1, p0 + o0 AS y0, p1 + o1 AS y1 FROM spots, around WHERE (o0 <> 0 OR o1 <> 0) AND {CLOSED}), "
    f"near AS (SELECT DISTINCT n0, n1, part FROM ({CLAMPED.format('keys')}) c ASOF JOIN splits s ON c.path >= s.path), "
    f"single_keys AS (SELECT x0 AS n0, x1 AS n1, c0 + o0 * ({side('lev')} // 2) - (k & 1) AS y0, c1 + o1 * ({side('lev')} // 2) - (k >> 1) AS y1 FROM faces, around, unnest(range(4)) u(k) WHERE {CLOSED}), "
    f"single AS (SELECT DISTINCT n0, n1, part FROM ({CLAMPED.format('single_keys')}) c ASOF JOIN splits s ON c.path >= s.path), "
    f"owned AS (SELECT n0, n1, part AS src FROM ({CLAMPED.format('(SELECT x0 AS n0, x1 AS n1, x0 AS y0, x1 AS y1 FROM cg)')}) c ASOF JOIN splits s ON c.path >= s.path)"
)


@query(f"WITH RECURSIVE {BALANCED}, {NEAR_NODES} SELECT src, part AS dst, count(*) AS n FROM near JOIN owned USING (n0, n1) WHERE part <> src GROUP BY ALL")
def scatter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = materialise(balanced(spark, sf_dir))
    return nodes.scatter_counts(nodes.scatter_map(nodes.unique_nodes(own, G, 1), _splits(spark, sf_dir, own), G))


@query(f"WITH RECURSIVE {BALANCED}, {NEAR_NODES} SELECT src, part AS dst, count(*) AS n FROM single JOIN owned USING (n0, n1) WHERE part <> src GROUP BY ALL")
def scatter_counts_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the keys of nodes that stand alone."""
    own = materialise(balanced(spark, sf_dir))
    return nodes.scatter_counts(nodes.scatter_map(nodes.unique_nodes(own, G, 1), _splits(spark, sf_dir, own), G, single=True))


@query(f"WITH RECURSIVE {BALANCED}, {NEAR_NODES} SELECT src AS owner, count(*) AS n FROM owned GROUP BY src")
def node_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = materialise(balanced(spark, sf_dir))
    return nodes.owners(nodes.unique_nodes(own, G, 1), _splits(spark, sf_dir, own), G).groupBy("owner").agg(F.count("*").alias("n"))


# ---- nodes ---------------------------------------------------------------------------------------------------------


@query(f"WITH {TREE}, {SLOTS(2)} SELECT lev, x0, x1, slot::INT AS slot FROM ({ELEMENT(2, 'tree')})")
def element_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.element_nodes(leaves(spark, sf_dir), G, 2)


@query(f"WITH {TREE}, {SLOTS(3)} SELECT lev, x0, x1, slot::INT AS slot FROM ({ELEMENT(3, 'tree')}) WHERE i0 = 0 OR i1 = 0 OR i0 = 3 OR i1 = 3")
def exterior_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.exterior_nodes(leaves(spark, sf_dir), G, 3)


@query(f"WITH {TREE}, {SLOTS(3)} SELECT lev, x0, x1, slot::INT AS slot FROM ({ELEMENT(3, 'tree')}) WHERE i0 > 0 AND i1 > 0 AND i0 < 3 AND i1 < 3")
def interior_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.interior_nodes(leaves(spark, sf_dir), G, 3)


@query(f"WITH {TREE} SELECT lev, x0 + (a // 2) * {side('lev')} AS x0, x1 + (b // 2) * {side('lev')} AS x1, ((a = 1)::INT + 2 * (b = 1)::INT)::INT AS orient FROM tree, unnest(range(3)) u(a), unnest(range(3)) v(b)")
def k_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.k_faces(leaves(spark, sf_dir), G)


@query(f"WITH {TREE}, {SLOTS(1)} SELECT lev, x0, x1, count(*) AS n_inst FROM ({ELEMENT(1, 'tree')}) GROUP BY ALL")
def node_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.with_instances(nodes.exterior_nodes(leaves(spark, sf_dir), G, 1), G)


@query(f"WITH {TREE}, {SLOTS(1)} SELECT x0, x1, CASE WHEN min(lev) = max(lev) THEN count(*) ELSE 0 END AS n_inst, min(lev)::INT AS coarsest, max(lev)::INT AS finest FROM ({ELEMENT(1, 'tree')}) GROUP BY x0, x1")
def node_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.locations(nodes.exterior_nodes(leaves(spark, sf_dir), G, 1), G)


def _cg(p: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nodes.unique_nodes(balanced(spark, sf_dir), G, p)

    run.__name__ = f"cg_nodes_order{p}"
    query(f"WITH RECURSIVE {BALANCED}, {cg_sql(p)} SELECT lev::INT AS lev, x0, x1 FROM cg")(run)


for _p in (1, 2, 3):
    _cg(_p)


@query(f"WITH RECURSIVE {BALANCED}, {cg_sql(1)} SELECT lev::INT AS lev, x0, x1 FROM cg WHERE {ON_EDGE}")
def boundary_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.boundary_nodes(nodes.unique_nodes(balanced(spark, sf_dir), G, 1), G)


# ---- fields --------------------------------------------------------------------------------------------------------


def _field(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node_id"), F.col(column).cast("double").alias("v"))


@query("SELECT round(sqrt(sum(v * v)), 4) AS l2, max(abs(v)) AS linf, min(v) AS least, max(v) AS most FROM (SELECT o_totalprice AS v FROM orders)")
def vec_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.norms(_field(spark, sf_dir, "o_totalprice")).withColumn("l2", F.round("l2", 4))


@query("SELECT round(sum(o_totalprice * o_custkey), 2) AS dot FROM orders")
def vec_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.dot(_field(spark, sf_dir, "o_totalprice"), _field(spark, sf_dir, "o_custkey")).select(F.round("dot", 2).alias("dot"))


@query("SELECT o_orderkey AS node_id, o_totalprice * 2.5::DOUBLE + o_custkey AS v FROM orders")
def vec_axpy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.axpy(2.5, _field(spark, sf_dir, "o_totalprice"), _field(spark, sf_dir, "o_custkey"))


@query("SELECT round(sum(v), 2) AS sum, min(v) AS least, round(avg(v), 4) AS mean, max(v) AS most, bool_and(v <> 0) AS every, bool_or(v <> 0) AS some FROM (SELECT o_totalprice AS v FROM orders)")
def vec_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.reduced(_field(spark, sf_dir, "o_totalprice")).withColumn("sum", F.round("sum", 2)).withColumn("mean", F.round("mean", 4))


@query("SELECT l_orderkey AS node_id, sum(l_quantity) AS v FROM lineitem GROUP BY ALL")
def vec_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.accumulate(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node_id"), F.col("l_quantity").alias("v")))


Q1 = (
    f"{cg_sql(1)}, el AS (SELECT e.lev, e.x0 AS e0, e.x1 AS e1, i0, i1, e.x0 + {side('e.lev')} * i0 AS x0, e.x1 + {side('e.lev')} * i1 AS x1 FROM balanced e, slots), "
    f"direct AS (SELECT lev, e0, e1, i0, i1, x0 AS n0, x1 AS n1, 1.0::DOUBLE AS w FROM el SEMI JOIN cg USING (x0, x1)), "
    f"hanging AS (SELECT lev, e0, e1, i0, i1, {cut('e0', 'lev - 1')} AS p0, {cut('e1', 'lev - 1')} AS p1, x0, x1 FROM el ANTI JOIN cg USING (x0, x1)), "
    f"spread AS (SELECT h.lev, e0, e1, h.i0, h.i1, p0 + s.i0 * {side('h.lev - 1')} AS n0, p1 + s.i1 * {side('h.lev - 1')} AS n1, (1 - abs((h.x0 - p0)::DOUBLE / {side('h.lev - 1')} - s.i0)) * (1 - abs((h.x1 - p1)::DOUBLE / {side('h.lev - 1')} - s.i1)) AS w FROM hanging h, slots s), "
    "q AS (FROM direct UNION ALL SELECT * FROM spread WHERE w > 0), u AS (SELECT lev, e0, e1, i0, i1, sum(w) AS v FROM q GROUP BY ALL)"
)


@query(f"WITH RECURSIVE {BALANCED}, {Q1} SELECT n0 AS x0, n1 AS x1, round(sum(w * v), 6) AS v FROM q JOIN u USING (lev, e0, e1, i0, i1) GROUP BY n0, n1")
def matvec_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity element operator on ones, with hanging nodes."""
    mesh = elements.build_mesh(balanced(spark, sf_dir), G, 1)
    y = elements.apply_operator(mesh, vectors.fill(mesh.nodes, 1.0), None)
    return mesh.nodes.join(y, "node_id").select(*G.axes, F.round("v", 6).alias("v"))


@query(f"WITH RECURSIVE {BALANCED}, {Q1} SELECT lev::INT AS lev, count(*) AS slots, round(sum(v), 6) AS total FROM u GROUP BY lev")
def gather_ones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element values of a constant field are the constant, hanging or not."""
    mesh = elements.build_mesh(balanced(spark, sf_dir), G, 1)
    return elements.gather(mesh, vectors.fill(mesh.nodes, 1.0)).groupBy("lev").agg(F.count("*").alias("slots"), F.round(F.sum("v"), 6).alias("total"))


NODE_ORDER = "row_number() OVER (ORDER BY {}) - 1"


def node_key(d: int, m: int) -> str:
    return " + ".join(f"(((x{i} >> {k}) & 1)::HUGEINT << {k * d + i})" for k in range(m + 1) for i in range(d))


def balanced_sql(points: str, d: int, m: int, top: int, most: int) -> str:
    """CTEs up to ``balanced`` in any dimension."""
    xs = ", ".join(f"x{i}" for i in range(d))
    around = f"around AS (SELECT {', '.join(f'(i // {3**k}) % 3 - 1 AS o{k}' for k in range(d))} FROM unnest(range({3**d})) u(i))"
    up = f"SELECT DISTINCT (lev - 1)::INT AS lev, {', '.join(cut(x, 'lev - 1', m) + f' AS {x}' for x in xs.split(', '))} FROM closure WHERE lev > 0"
    moved = ", ".join(f"x{k} + o{k} * {side('lev', m)} AS x{k}" for k in range(d))
    inside = " AND ".join(f"x{k} >= 0 AND x{k} < {1 << m}" for k in range(d))
    closure = f"closure AS (SELECT lev, {xs} FROM tree UNION SELECT * FROM (SELECT lev, {moved} FROM ({up}) p, around) k WHERE {inside})"
    return f"{points}, {construct_sql('pts', 'tree', top, most, d, m)}, {around}, {closure}, {construct_sql('closure', 'balanced', m, 1, d, m)}"


def nodes_sql(p: int, d: int, m: int) -> str:
    """CTE ``cg`` in any dimension, orders 1 and 2: by counting, or by open faces."""
    xs = [f"x{i}" for i in range(d)]
    names, axes = ", ".join(xs), range(d)
    edge = "(" + " OR ".join(f"{x} = 0 OR {x} = {1 << m}" for x in xs) + ")"
    orient = lambda level: "(" + " + ".join(f"CASE WHEN {x} = {cut(x, level, m)} THEN 0 ELSE {1 << i} END" for i, x in enumerate(xs)) + ")"
    slots = f"slots AS (SELECT s::INT AS s, {', '.join(f'(s // {(p + 1) ** i}) % {p + 1} AS i{i}' for i in axes)} FROM unnest(range({(p + 1) ** d})) u(s))"
    width = side("e.lev", m)
    every = f"every AS (SELECT e.lev, {', '.join(f'e.{x} AS e{i}' for i, x in enumerate(xs))}, s AS slot, {', '.join(f'i{i}' for i in axes)}, {', '.join(f'e.{x} + ({width} * i{i}) // {p} AS {x}' for i, x in enumerate(xs))} FROM balanced e, slots)"
    inner = " AND ".join(f"i{i} > 0 AND i{i} < {p}" for i in axes)
    if p == 1:
        return f"{slots}, {every}, place AS (SELECT {names}, count(*) AS n, min(lev) AS lo, max(lev) AS hi FROM every GROUP BY ALL), cg AS (SELECT lo::INT AS lev, {names} FROM place WHERE {edge} OR lo <> hi OR n = (1 << ({d} - bit_count({orient('lo')}))::INT))"
    key = lambda level: f"{level} AS kl, {orient(level)} AS ko, {', '.join(f'{cut(x, level, m)} AS k{i}' for i, x in enumerate(xs))}"
    return (
        f"{slots}, {every}, own AS (SELECT DISTINCT lev, {names} FROM every WHERE NOT ({inner})), keyed AS (SELECT lev, {names}, {key('lev - 1')} FROM own WHERE NOT {edge}), coarse AS (SELECT DISTINCT {key('lev')} FROM own WHERE NOT {edge}), "
        f"kept AS (SELECT lev, {names} FROM keyed ANTI JOIN coarse USING (kl, ko, {', '.join(f'k{i}' for i in axes)}) UNION ALL SELECT lev, {names} FROM own WHERE {edge}), "
        f"cg AS (SELECT min(lev)::INT AS lev, {names} FROM kept GROUP BY {names} UNION ALL SELECT lev::INT, {names} FROM every WHERE {inner})"
    )


def incidence_sql(p: int, d: int, m: int) -> str:
    """CTEs after ``cg``: ``q`` with an element's slot, the node (n0..) it takes and the weight; hanging slots take their parent's."""
    axes, xs = range(d), [f"x{i}" for i in range(d)]
    element, at = ", ".join(["lev", *(f"e{i}" for i in axes)]), ", ".join(xs)
    up = side("h.lev - 1", m)
    t = lambda i: f"((h.x{i} - p{i})::DOUBLE / {up})"
    weight = lambda i: f"(1 - abs({t(i)} - s.i{i}))" if p == 1 else f"(CASE s.i{i} WHEN 0 THEN 2 * ({t(i)} - 0.5) * ({t(i)} - 1) WHEN 1 THEN 4 * {t(i)} * (1 - {t(i)}) ELSE 2 * {t(i)} * ({t(i)} - 0.5) END)"
    return (
        f"direct AS (SELECT {element}, slot, {', '.join(f'x{i} AS n{i}' for i in axes)}, 1.0::DOUBLE AS w FROM every SEMI JOIN cg USING ({at})), "
        f"hanging AS (SELECT {element}, slot, {', '.join(cut(f'e{i}', 'lev - 1', m) + f' AS p{i}' for i in axes)}, {at} FROM every ANTI JOIN cg USING ({at})), "
        f"spread AS (SELECT {', '.join(f'h.{c}' for c in element.split(', '))}, h.slot, {', '.join(f'p{i} + (s.i{i} * {up}) // {p} AS n{i}' for i in axes)}, {' * '.join(weight(i) for i in axes)} AS w FROM hanging h, slots s), "
        f"q AS (FROM direct UNION ALL SELECT * FROM spread WHERE abs(w) > 1e-14)"
    )


MASS_TREE = f"pts AS (SELECT 20 AS lev, {', '.join(f'floor({x})::BIGINT AS x{i}' for i, x in enumerate(('(l_quantity - 1) / 50.0 * 1048576', 'l_discount / 0.11 * 1048576')))} FROM lineitem)"
SIMPSON = " * ".join(f"(CASE (slot // {3**i}) % 3 WHEN 1 THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END / 6)" for i in range(2))


@query(f"WITH RECURSIVE {balanced_sql(MASS_TREE, 2, 20, 4, 64)}, {nodes_sql(2, 2, 20)}, {incidence_sql(2, 2, 20)}, ids AS (SELECT x0 AS n0, x1 AS n1, ({NODE_ORDER.format(node_key(2, 20))})::BIGINT AS node_id FROM cg) SELECT node_id, round(sum(w * {SIMPSON} * pow(0.25, lev)), 12) AS v FROM q JOIN ids USING (n0, n1) GROUP BY node_id")
def matvec_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mass operator of order 2 on ones: every element's own part is its area by Simpson's weights, spread over hanging nodes' parents."""
    mesh = elements.build_mesh(tree.balance(generators.lineitem_points(read(spark, sf_dir, "lineitem"), G), G, 64, 4), G, 2)
    y = elements.apply_operator(mesh, vectors.fill(mesh.nodes, 1.0), elements.mass_kernel(2, 2))
    return y.select("node_id", F.round("v", 12).alias("v"))


#: On a uniform mesh the forcing is an eigenvector of both element operators, so the solution is known and one step finds it.
HEAT = "SELECT " + NODE_ORDER.format(node_key(2, 3)) + " AS node_id, round(CASE WHEN x0 IN (0, 8) OR x1 IN (0, 8) THEN 0 ELSE pi() * pi() * ((4 + 2 * cos(pi() / 8)) / 48) / ((2 - 2 * cos(pi() / 8)) * 8) * sin(pi() * x0 / 8) * sin(pi() * x1 / 8) END, 8) AS v, 1 AS steps, true AS converged FROM (SELECT i % 9 AS x0, i // 9 AS x1 FROM unnest(range(81)) u(i))"


@query(HEAT)
def cg_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heat equation on a uniform mesh: -u'' = f with zero boundary values, by conjugate gradients."""
    g = Grid(2, 10)
    mesh = elements.uniform_mesh(spark, g, 3, 1)
    x, y = mesh.coordinates()
    forcing = vectors.by_function(mesh.nodes, [2 * np.pi**2 * F.sin(x * np.pi) * F.sin(y * np.pi)])
    u, steps, residual, ok = elements.conjugate_gradients(elements.HeatStiffness(mesh), elements.HeatRightSide(mesh)(forcing), 1e-6, 50)
    return u.select("node_id", F.round("v", 8).alias("v"), F.lit(steps).alias("steps"), F.lit(ok).alias("converged"))


# ---- four dimensions -----------------------------------------------------------------------------------------------

TOP4, MOST4 = 4, 64
BALANCED4 = balanced_sql(PTS4, 4, 6, TOP4, MOST4)
X4 = "x0, x1, x2, x3"


def balanced4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.balance(generators.lineitem_points(read(spark, sf_dir, "lineitem"), G4), G4, MOST4, TOP4)


@query(f"WITH RECURSIVE {BALANCED4} SELECT lev, {X4} FROM balanced")
def tree_balance_4d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced4(spark, sf_dir)


@query(f"WITH RECURSIVE {BALANCED4}, {nodes_sql(1, 4, 6)} SELECT lev, {X4} FROM cg")
def cg_nodes_4d_order1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.unique_nodes(balanced4(spark, sf_dir), G4, 1)


@query(f"WITH RECURSIVE {BALANCED4}, {nodes_sql(2, 4, 6)} SELECT lev, {X4} FROM cg")
def cg_nodes_4d_order2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.unique_nodes(balanced4(spark, sf_dir), G4, 2)


@query(f"WITH RECURSIVE {BALANCED4}, {nodes_sql(1, 4, 6)}, {incidence_sql(1, 4, 6)}, u AS (SELECT lev, e0, e1, e2, e3, slot, sum(w) AS v FROM q GROUP BY ALL) SELECT n0 AS x0, n1 AS x1, n2 AS x2, n3 AS x3, round(sum(w * v), 6) AS v FROM q JOIN u USING (lev, e0, e1, e2, e3, slot) GROUP BY ALL")
def matvec_4d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity element operator on ones in 4-D, with hanging nodes."""
    mesh = elements.build_mesh(balanced4(spark, sf_dir), G4, 1)
    y = elements.apply_operator(mesh, vectors.fill(mesh.nodes, 1.0), None)
    return mesh.nodes.join(y, "node_id").select(*G4.axes, F.round("v", 6).alias("v"))


@query()
def function_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.refine_by_function(spark, Grid(2, 20), lambda x: np.sin(2 * np.pi * x[:, 0]) * np.sin(2 * np.pi * x[:, 1]), 1, 0.01, 7)


# ---- generators and sinks ------------------------------------------------------------------------------------------


@query("SELECT 4 AS lev, (i % 16)::BIGINT * 65536 AS x0, (i // 16)::BIGINT * 65536 AS x1 FROM unnest(range(256)) u(i)")
def uniform_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.uniform_tree(spark, G, 4)


@query("SELECT 5 AS lev, (i % 32)::BIGINT * 32768 AS x0, (i // 32)::BIGINT * 32768 AS x1 FROM unnest(range(1024)) u(i)")
def regular_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.regular_grid(spark, G, 1000)


SPLIT_LOOP = lambda test: f"WITH RECURSIVE grown AS (SELECT 1 AS lev, (i % 2)::BIGINT * 524288 AS x0, (i // 2)::BIGINT * 524288 AS x1 FROM unnest(range(4)) u(i) UNION ALL SELECT * FROM ({children_sql(f'(FROM grown WHERE lev < 5 AND {test})')})) SELECT lev::INT AS lev, x0, x1 FROM grown WHERE lev = 5 OR NOT ({test})"
CENTRE = f"(x0 <= 524288 AND x0 + {side('lev')} >= 524288 AND x1 <= 524288 AND x1 + {side('lev')} >= 524288)"
RIM = f"(x0 = 0 OR x1 = 0 OR x0 + {side('lev')} = 1048576 OR x1 + {side('lev')} = 1048576)"


@query(SPLIT_LOOP(CENTRE))
def centre_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.centre_refined(spark, G, 5)


@query(SPLIT_LOOP(RIM))
def boundary_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.boundary_refined(spark, G, 5)


@query()
def gaussian_octants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.gaussian_octants(spark, Grid(4, 10), 1000, 1, (1, 4))


@query()
def moving_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Grid(4, 8)
    return tree.construct(generators.moving_sphere(spark, g, 2000, 1), g, 16)


@query(f"WITH {TREE} SELECT (i % 64)::INT AS i0, (i // 64)::INT AS i1, t.lev FROM unnest(range(4096)) u(i), unnest(range(0, 9)) v(l) JOIN tree t ON t.lev = l AND t.x0 = {cut('((i % 64) * 16384 + 8192)', 'l')} AND t.x1 = {cut('((i // 64) * 16384 + 8192)', 'l')}")
def raster_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree sampled on a dense grid of 64 x 64 cell centres."""
    return rasterise(leaves(spark, sf_dir), G, 6, "lev")
