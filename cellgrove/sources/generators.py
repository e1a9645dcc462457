"""Generators of octants and points. All are seeded and made by the executors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrove.functions.octant import Grid, all_of, shl
from cellgrove.plans.work import materialise


def gaussian_octants(spark: SparkSession, grid: Grid, n: int, seed: int = 0, levels: tuple[int, int] | None = None) -> DataFrame:
    """n octants whose coordinates are normal around the centre (deviation: the domain's width / 25), clamped to the domain; levels uniform in ``levels``, both ends in it (default: the finest)."""
    lo, hi = levels or (grid.depth, grid.depth)
    width = 1 << grid.depth
    lev = (F.lit(lo) + F.floor(F.rand(seed) * (hi - lo + 1))).cast("int")
    raw = [F.greatest(F.lit(0.0), F.least(F.lit(float(width)), F.randn(seed + 1 + d) * (width / 25) + width / 2)).cast("long").alias(f"x{d}") for d in range(grid.dim)]
    return spark.range(n).select(F.col("id").alias("pid"), lev.alias("lev"), *raw)


def regular_grid(spark: SparkSession, grid: Grid, least_cells: int) -> DataFrame:
    """The coarsest uniform tree, of level 1 at least, with ``least_cells`` cells or more."""
    level = max(1, math.ceil(math.log(max(1, least_cells), grid.children) - 1e-12))
    return uniform_tree(spark, grid, level)


def uniform_tree(spark: SparkSession, grid: Grid, level: int) -> DataFrame:
    """All octants of a level."""
    if not 0 <= level <= grid.depth:
        raise ValueError("the level is not one of the grid's")
    side = 1 << grid.depth - level
    xs = [F.expr(f"(id div {(1 << level) ** d}) % {1 << level}") * side for d in range(grid.dim)]
    return spark.range(1 << level * grid.dim).select(*grid.row(level, xs))


def centre_refined(spark: SparkSession, grid: Grid, end: int) -> DataFrame:
    """The least balanced tree that is refined to level ``end`` at the domain's centre: level by level, the octants that touch it are split."""
    mid = 1 << grid.depth - 1
    return _refined(spark, grid, end, lambda: all_of([(a <= mid) & (mid <= b) for a, b in zip(grid.lower(), grid.upper())]))


def boundary_refined(spark: SparkSession, grid: Grid, end: int) -> DataFrame:
    """A tree that is refined to level ``end`` along the domain's boundary."""
    return _refined(spark, grid, end, grid.touches_boundary)


def _refined(spark: SparkSession, grid: Grid, end: int, splits: Callable[[], Column]) -> DataFrame:
    now, done = uniform_tree(spark, grid, min(1, end)), []
    for _ in range(1, end):
        done.append(now.filter(~splits()))
        now = grid.with_children(now.filter(splits()))
    for part in done:
        now = now.unionByName(part)
    return now


def moving_sphere(spark: SparkSession, grid: Grid, n: int, seed: int = 0) -> DataFrame:
    """Points in space-time: on a sphere of radius 1/4 around (1/4, 1/4 + t/2, 1/4), at times uniform in [0, 1]."""
    if grid.dim != 4:
        raise ValueError("three axes of space and one of time are needed")
    rows = spark.range(n).select(F.col("id").alias("pid"), F.rand(seed).alias("t"), (F.rand(seed + 1) * 2 * math.pi).alias("a"), (F.rand(seed + 2) * 2 - 1).alias("z"))
    ring = F.sqrt(1 - F.col("z") * F.col("z")) / 4
    unit = [F.lit(0.25) + ring * F.cos("a"), F.lit(0.25) + ring * F.sin("a") + F.col("t") / 2, F.lit(0.25) + F.col("z") / 4, F.col("t")]
    top = (1 << grid.depth) - 1
    return rows.select("pid", F.lit(grid.depth).alias("lev"), *(F.greatest(F.lit(0), F.least(F.lit(top), F.floor(u * (1 << grid.depth)))).cast("long").alias(f"x{d}") for d, u in enumerate(unit)))


def refine_by_function(spark: SparkSession, grid: Grid, f: Callable[[np.ndarray], np.ndarray], order: int, tolerance: float, leaf_depth: int | None = None) -> DataFrame:
    """A tree that resolves ``f``: an octant is split if interpolating the values at its nodes to the nodes of any child misses ``f`` there by more than ``tolerance`` in any variable.

    ``f`` takes coordinates in [0, 1], one row a point, and gives one row of values (or one value) a point. The root is always split.
    """
    from cellgrove.operators.elements import interpolation

    top = min(leaf_depth or grid.depth, grid.depth)
    ref = np.stack(np.meshgrid(*([np.arange(order + 1) / order] * grid.dim), indexing="ij"), -1).reshape(-1, grid.dim)[:, ::-1]
    half = [interpolation(order, grid.dim, c) for c in range(grid.children)]
    scale = float(1 << grid.depth)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lev = batch.column(0).to_numpy()
            xs = np.stack([batch.column(1 + d).to_numpy() for d in range(grid.dim)], 1)
            side = np.exp2(grid.depth - lev)
            values = lambda anchor, width: np.asarray(f(((anchor[:, None, :] + ref[None] * width[:, None, None]) / scale).reshape(-1, grid.dim)), float).reshape(len(lev), len(ref), -1)
            own = values(xs, side)
            worst = np.zeros(len(lev))
            for c in range(grid.children):
                at = xs + np.array([c >> d & 1 for d in range(grid.dim)]) * (side / 2)[:, None]
                worst = np.maximum(worst, np.abs(np.einsum("ij,njv->niv", half[c], own) - values(at, side / 2)).max((1, 2), initial=0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(worst > tolerance)], [*grid.keys, "_split"])

    kind = ", ".join(["lev int", *(f"{a} long" for a in grid.axes), "_split boolean"])
    now, leaves = uniform_tree(spark, grid, 1), None
    for level in range(1, top + 1):
        marked = materialise(now.select(*grid.keys).mapInArrow(marks, kind)) if level < top else now.withColumn("_split", F.lit(False))
        part = marked.filter("not _split").select(*grid.keys)
        leaves = part if leaves is None else leaves.unionByName(part)
        now = grid.with_children(marked.filter("_split"))
        if level < top and marked.filter("_split").isEmpty():
            break
    return leaves


def quantise(df: DataFrame, grid: Grid, units: list[Column], *keep: str) -> DataFrame:
    """Points from columns scaled to [0, 1): each as a cell of the finest level, clamped to the grid."""
    top = (1 << grid.depth) - 1
    return df.select(*keep, *grid.row(grid.depth, [F.least(F.lit(top).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor(u * float(1 << grid.depth)).cast("long"))) for u in units]))


def quantise_integers(df: DataFrame, grid: Grid, parts: list[tuple[Column, int]], *keep: str) -> DataFrame:
    """Points from integer columns with their widths, by integer arithmetic only."""
    return df.select(*keep, *grid.row(grid.depth, [F.call_function("div", shl(v, grid.depth), F.lit(w).cast("long")) for v, w in parts]))


def lineitem_points(lineitem: DataFrame, grid: Grid) -> DataFrame:
    """Quantity and discount (2-D), and tax (3-D); or in 4-D quantity, price, discount and date, by integer arithmetic."""
    if grid.dim == 4:
        days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
        return quantise_integers(lineitem, grid, [(F.col("l_quantity").cast("long") - 1, 50), (F.round(F.col("l_extendedprice") * 100).cast("long"), 10500001), (F.round(F.col("l_discount") * 100).cast("long"), 11), (days, 2560)])
    width = float(1 << grid.depth)
    raw = [(F.col("l_quantity") - 1) / 50.0 * width, F.col("l_discount") / 0.11 * width, F.col("l_tax") / 0.09 * width][: grid.dim]
    return lineitem.select(*grid.row(grid.depth, [F.floor(x).cast("long") for x in raw]))


def event_points(events: DataFrame, grid: Grid, users: int, top: float) -> DataFrame:
    """Space-time of events: user, value and time within January 2024, clamped."""
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))
    return quantise(events, grid, [F.col("user_id") / float(users), F.col("value") / float(top), seconds / float(31 * 86400)][: grid.dim])


__all__ = ["gaussian_octants", "regular_grid", "uniform_tree", "centre_refined", "boundary_refined", "moving_sphere", "refine_by_function", "quantise", "quantise_integers", "lineitem_points", "event_points"]
