"""Adaptive trees: construction by density, duplicates and ancestors, 2:1 balance, slices, runs of levels, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellgrove.functions.octant import Grid
from cellgrove.plans.work import materialise


def _root_if_any(df: DataFrame, grid: Grid) -> DataFrame:
    return df.limit(1).select(*grid.row(0, [F.lit(0)] * grid.dim))


def ancestors(df: DataFrame, grid: Grid, first: int, below: int, last: int, *keep: str) -> DataFrame:
    """(keep.., lev, x..): every octant's ancestors of the levels ``first`` to ``last`` that are ``below`` levels coarser or more (0: itself too)."""
    above = [F.when(F.col("lev") - below >= k, F.struct(*grid.ancestor(k))) for k in range(first, last + 1)] or [F.when(F.lit(False), F.struct(*grid.ancestor(0)))]
    return df.select(*keep, F.explode(F.array(*above)).alias("_a")).filter("_a is not null").select(*keep, *(F.col(f"_a.{k}").alias(k) for k in grid.keys))


def level_counts(points: DataFrame, grid: Grid, last: int) -> DataFrame:
    """(lev, x.., n): points in every occupied cell of the levels 1 .. ``last``. A coarse octant counts for its own level and above only.

    Equal points are summed before their ancestors are laid out, so what is shuffled is bounded by distinct cells.
    """
    cells = points.groupBy(*grid.keys).agg(F.count("*").alias("n"))
    return ancestors(cells, grid, 1, 0, last, "n").groupBy(*grid.keys).agg(F.sum("n").alias("n"))


def construct(points: DataFrame, grid: Grid, max_points: int = 1, leaf_depth: int | None = None) -> DataFrame:
    """The complete linear tree whose cells with more than ``max_points`` points are split, down to ``leaf_depth``; the root always is; no points give no tree.

    A cell with too many points has ancestors with as many, so one aggregate finds all splits and leaves are the children that are not split.
    """
    top = min(leaf_depth or grid.depth, grid.depth)
    split = _root_if_any(points, grid)
    if top > 1:
        split = split.unionByName(level_counts(points, grid, top - 1).filter(F.col("n") > max_points).select(*grid.keys))
    return grid.with_children(split).join(split.filter(F.col("lev") > 0), grid.keys, "left_anti").select(*grid.keys)


def remove_duplicates(octants: DataFrame, grid: Grid) -> DataFrame:
    """Equal octants once; ancestors stay."""
    return octants.select(*grid.row(grid.lev(), grid.lower())).distinct()


def remove_ancestors(octants: DataFrame, grid: Grid) -> DataFrame:
    """The finest octants: duplicates and every octant that holds another are dropped."""
    own = remove_duplicates(octants, grid)
    above = ancestors(own, grid, 0, 1, grid.depth - 1).distinct()
    return own.join(above, grid.keys, "left_anti")


def propagate_neighbours(octants: DataFrame, grid: Grid, finest: int | None = None) -> DataFrame:
    """The closure under parents and their neighbours: from the finest level up, every octant adds its parent and the parent's neighbours. Each level is a table in the shared folder."""
    own = materialise(octants.select(*grid.keys).distinct())
    if finest is None:
        finest = own.agg(F.max("lev")).first()[0] or 0
    out = now = own.filter(F.col("lev") == finest)
    for level in range(finest, 0, -1):
        parents = now.select(*grid.parent()).distinct()
        near = grid.with_neighbours(parents, own=True)
        now = materialise(own.filter(F.col("lev") == level - 1).unionByName(near).distinct())
        out = out.unionByName(now)
    return out


def balance(octants: DataFrame, grid: Grid, max_points: int = 1, leaf_depth: int | None = None, constructed: bool = False) -> DataFrame:
    """The complete tree of ``octants`` (or, if ``constructed``, of the tree that they are), refined until neighbours differ by one level at most, over faces, edges and corners."""
    tree = octants if constructed else construct(octants, grid, max_points, leaf_depth)
    # the closure holds every octant's parent, so the cells that are split are just these parents
    split = materialise(propagate_neighbours(tree, grid).filter(F.col("lev") > 0).select(*grid.parent()).distinct())
    return grid.with_children(split).join(split.filter(F.col("lev") > 0), grid.keys, "left_anti").select(*grid.keys)


def balance_violations(tree: DataFrame, grid: Grid) -> DataFrame:
    """Leaves with a neighbour that is more than one level coarser: (lev, x.., near_lev, near_x..).

    The cell two levels up around each neighbour must not be covered by a leaf of that level or coarser.
    """
    cols = [f"a_{k}" for k in grid.keys]
    own = tree.select(*grid.keys, *(F.col(k).alias(c) for k, c in zip(grid.keys, cols)))
    near = grid.with_neighbours(own.filter(F.col("lev") >= 2), *cols)
    above = ancestors(near, grid, 0, 2, grid.depth - 2, *cols).distinct()
    return above.join(tree.select(*grid.keys), grid.keys).select(*(F.col(c).alias(k) for k, c in zip(grid.keys, cols)), *(F.col(k).alias(f"near_{k}") for k in grid.keys))


def completeness(tree: DataFrame, grid: Grid) -> DataFrame:
    """(leaves, measure, overlaps): a complete tree has measure 1 and no leaf that holds another."""
    above = ancestors(tree, grid, 0, 1, grid.depth - 1).distinct()
    overlaps = tree.join(above, grid.keys, "left_semi").agg(F.count("*").alias("overlaps"))
    total = tree.agg(F.count("*").alias("leaves"), F.coalesce(F.sum(F.pow(F.lit(0.5), F.col("lev") * grid.dim)), F.lit(0.0)).alias("measure"))
    return total.crossJoin(F.broadcast(overlaps))  # one row each


def subtree_sizes(tree: DataFrame, grid: Grid) -> DataFrame:
    """(lev, most): the most leaves under one cell of each level that has any."""
    return level_counts(tree, grid, grid.depth).groupBy("lev").agg(F.max("n").alias("most"))


def level_histogram(tree: DataFrame) -> DataFrame:
    return tree.groupBy("lev").agg(F.count("*").alias("n"))


def stratify(tree: DataFrame, levels: range) -> list[DataFrame]:
    """One DataFrame a level, the first for all coarser ones too, the last for all finer ones."""
    cuts = list(levels)
    if len(cuts) < 2:
        return [tree]
    return [tree.filter(F.col("lev") <= cuts[0]), *(tree.filter(F.col("lev") == k) for k in cuts[1:-1]), tree.filter(F.col("lev") >= cuts[-1])]


def slice_tree(tree: DataFrame, grid: Grid, axis: int, value: int) -> DataFrame:
    """Octants whose closed cell holds the plane."""
    return tree.filter(grid.in_slice(axis, value))


def permute_axes(tree: DataFrame, axes: list[int], *keep: str) -> DataFrame:
    """Axes taken in another order, or fewer of them."""
    return tree.select("lev", *(F.col(f"x{a}").alias(f"x{i}") for i, a in enumerate(axes)), *keep)


def project_slice(tree: DataFrame, grid: Grid, axis: int, value: int) -> DataFrame:
    """A slice without its axis; octants that fall together stay apart."""
    return permute_axes(slice_tree(tree, grid, axis, value), [a for a in range(grid.dim) if a != axis])


def compress_levels(tree: DataFrame, grid: Grid) -> tuple[DataFrame, DataFrame]:
    """Runs of equal level along the Morton order: (seg, lev, end_rank) with inclusive ends counted from 0, and (seg, lev, x..) with each run's first octant.

    Ranks come from counts per range partition, so no task sees the whole tree.
    """
    from cellgrove.operators.order import with_rank

    ranked = materialise(with_rank(tree.select(*grid.keys), grid))
    before = ranked.select((F.col("rank") + 1).alias("rank"), F.col("lev").alias("before"))
    starts = ranked.join(before, "rank", "left").filter(F.col("before").isNull() | (F.col("before") != F.col("lev")))
    starts = materialise(with_rank(starts.drop("before", "part"), grid, "seg", order=["rank"]))
    following = starts.select((F.col("seg") - 1).alias("seg"), (F.col("rank") - 1).alias("end_rank"))
    last = ranked.agg(F.max("rank").alias("_last"))
    segments = starts.join(following, "seg", "left").crossJoin(F.broadcast(last)).select("seg", "lev", F.coalesce("end_rank", "_last").alias("end_rank"))
    return segments, starts.select("seg", *grid.keys)


def bucket_counts(octants: DataFrame, grid: Grid, level: int) -> DataFrame:
    """(child, n): octants by the digit of a level; those that are coarser are in bucket -1."""
    child = F.when(F.col("lev") < level, -1).otherwise(grid.child_number(level))
    return octants.groupBy(child.cast("int").alias("child")).agg(F.count("*").alias("n"))


def bucket_offsets(octants: DataFrame, grid: Grid, level: int) -> DataFrame:
    """(child, n, start, end): bucket counts with their prefix sums. There are at most 2^D + 1 buckets."""
    w = Window.partitionBy(F.lit(0)).orderBy("child").rowsBetween(Window.unboundedPreceding, 0)
    out = bucket_counts(octants, grid, level).withColumn("end", F.sum("n").over(w))
    return out.select("child", "n", (F.col("end") - F.col("n")).alias("start"), "end")
