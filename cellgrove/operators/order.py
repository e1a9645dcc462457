"""Order along a curve: sorts, ranks, range partitions, weighted partitions, as-of lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrove.functions.curve import sort_key, sort_path
from cellgrove.functions.octant import Grid
from cellgrove.plans.work import BROADCAST_ROWS, materialise


def curve_sort(octants: DataFrame, grid: Grid, curve: str = "morton", until: int | None = None) -> DataFrame:
    """Octants in the order of the curve, ancestors first; of equal octants, as the other columns have it. With ``until``, only levels up to that one count."""
    return octants.orderBy(F.substring(sort_path(grid, curve), 1, until) if until else sort_key(grid, curve))


def with_rank(df: DataFrame, grid: Grid, name: str = "rank", order: list[str | Column] | None = None, curve: str = "morton") -> DataFrame:
    """``df`` with each row's place in the order, from 0, and the range partition ``part`` it was counted in.

    Rows are dealt into ranges and counted; a range's start is the running sum over the few ranges; places within are a
    window over one range. No task sees more than its range: equal keys are told apart by where they were read, so that one key
    may take many ranges.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order] if order else [sort_key(grid, curve)]
    own = df.select("*", *(k.alias(f"_k{i}") for i, k in enumerate([*keys, F.monotonically_increasing_id()])))
    cols = [f"_k{i}" for i in range(len(keys) + 1)]
    dealt = materialise(own.repartitionByRange(*cols).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("_n"))
    starts = sizes.select("part", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_start"))
    w = Window.partitionBy("part").orderBy(*cols)
    return dealt.withColumn("_row", F.row_number().over(w)).join(F.broadcast(starts), "part").select(*df.columns, (F.col("_start") + F.col("_row") - 1).cast("long").alias(name), "part")


def partition_ranges(octants: DataFrame, grid: Grid, parts: int) -> DataFrame:
    """(lev, x.., part): the order cut into ``parts`` runs whose sizes differ by one at most."""
    ranked = materialise(with_rank(octants.select(*grid.keys), grid).drop("part"))
    n = F.broadcast(ranked.agg(F.count("*").alias("_n")))
    return ranked.crossJoin(n).select(*grid.keys, F.floor(F.col("rank") * parts / F.col("_n")).cast("int").alias("part"))


def partition_weighted(df: DataFrame, grid: Grid, weight: Column, parts: int, name: str = "part") -> DataFrame:
    """The order cut into ``parts`` runs of about equal weight: a row goes where the middle of its weight lies."""
    ranked = materialise(with_rank(df.withColumn("_w", weight.cast("double")), grid, "_rank", curve="morton"))
    sums = ranked.groupBy("part").agg(F.sum("_w").alias("_sum"))
    running = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    starts = sums.select("part", (F.sum("_sum").over(running) - F.col("_sum")).alias("_before"), F.sum("_sum").over(Window.partitionBy(F.lit(0))).alias("_total"))
    w = Window.partitionBy("part").orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    mid = F.col("_before") + F.sum("_w").over(w) - F.col("_w") / 2
    out = ranked.join(F.broadcast(starts), "part").withColumn("_part", F.least(F.lit(parts - 1), F.floor(mid * parts / F.col("_total"))).cast("int"))
    return out.select(*df.columns, F.col("_part").alias(name))


def scatter_to_sizes(df: DataFrame, grid: Grid, sizes: list[int], name: str = "part") -> DataFrame:
    """The order cut into runs of given sizes; they must add up to the rows."""
    ends, total = [], 0
    for n in sizes:
        total += n
        ends.append(total)
    cut = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("_rank")))
    return with_rank(df, grid, "_rank").withColumn(name, cut).select(*df.columns, *([] if name in df.columns else [name]))


def splitters(partitioned: DataFrame, grid: Grid) -> DataFrame:
    """(part, lev, x..): the first octant of every part."""
    path = sort_key(grid)
    first = partitioned.groupBy("part").agg(F.min_by(F.struct(*grid.keys), path).alias("s"))
    return first.select("part", "s.*")


def containing_part(points: DataFrame, splits: DataFrame, grid: Grid, name: str = "part") -> DataFrame:
    """``points`` with the part whose splitter is the last that does not come after them: an as-of join along the curve. Points on upper faces belong to the last cell inside.

    Few splitters (their number is checked) are searched by each row by halves; more are merged into the points' order by a window over ranges.
    """
    ordered = splits.select("part", sort_key(grid).alias("_path"))
    inside = points.select("*", *(c.alias(f"_c_{k}") for k, c in zip(grid.keys, [grid.lev(), *grid.clamped()])))
    path = sort_key(grid, p="_c_")
    n = ordered.count()
    if n <= min(BROADCAST_ROWS, 20_000):
        rows = sorted(((r._path, r.part) for r in ordered.collect()))
        if not rows:
            return points.withColumn(name, F.lit(None).cast("int"))
        table = points.sparkSession.createDataFrame([([p for p, _ in rows], [int(k) for _, k in rows])], f"_paths array<{ordered.schema['_path'].dataType.simpleString()}>, _parts array<int>")
        found = inside.crossJoin(F.broadcast(table))  # one row; beyond the join the coordinates are columns, not expressions written out for each bit
        if n <= 256:
            found_part = lambda own: _halves(own, rows).cast("int")
        else:
            mid = lambda s: F.shiftright(s["a"] + s["b"], 1)
            halve = lambda own: lambda s, _: F.when(s["a"] >= s["b"], s).when(F.get(F.col("_paths"), mid(s)) <= own, F.struct((mid(s) + 1).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), mid(s).alias("b")))
            start = F.struct(F.lit(0).alias("a"), F.size("_paths").alias("b"))
            found_part = lambda own: F.get(F.col("_parts"), F.aggregate(F.sequence(F.lit(0), F.lit(n.bit_length())), start, halve(own), lambda s: s["a"]) - 1)
        return found.select(*points.columns, F.get(F.transform(F.array(path), found_part), 0).alias(name))
    both = inside.select(path.alias("_path"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_row"), F.lit(None).cast("int").alias("_part"))
    marks = ordered.select("_path", F.lit(0).alias("_kind"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), F.col("part").cast("int").alias("_part"))
    dealt = materialise(both.unionByName(marks).withColumn("_t", F.monotonically_increasing_id()).repartitionByRange("_path", "_kind", "_t").withColumn("_range", F.spark_partition_id()))
    lasts = dealt.groupBy("_range").agg(F.max_by("_part", F.when(F.col("_kind") == 0, F.col("_path"))).alias("_last"))
    carried = lasts.select("_range", F.last("_last", True).over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    w = Window.partitionBy("_range").orderBy("_path", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumn("_found", F.last("_part", True).over(w)).filter("_kind = 1").join(F.broadcast(carried), "_range")
    return own.select("_row.*", F.coalesce("_found", "_carried").alias(name))


def _halves(value: Column, rows: list[tuple]) -> Column:
    """The part of the last of few sorted splitters that is not above ``value``, as a tree of comparisons; null below the first."""
    if len(rows) == 1:
        return F.when(value >= rows[0][0], rows[0][1])
    half = len(rows) // 2
    return F.when(value >= rows[half][0], _halves(value, rows[half:])).otherwise(_halves(value, rows[:half]))


def prune_to_part(octants: DataFrame, grid: Grid, part: int, parts: int) -> DataFrame:
    """One of ``parts`` equal runs of the order."""
    return partition_ranges(octants, grid, parts).filter(F.col("part") == part).drop("part")


def _bound(keys: DataFrame, values: DataFrame, key: str, value: str, above: bool) -> DataFrame:
    """A merge of keys and values in one order, dealt into ranges: each range's window, and what is carried into it from the ranges before."""
    sign = -1 if above else 1
    own = 0 if above else 1  # of equal keys and values, values come first looking down, keys looking strictly up
    both = keys.select(F.col(key).alias("_v"), F.lit(own).alias("_kind")).unionByName(values.filter(F.col(value).isNotNull()).select(F.col(value).alias("_v"), F.lit(1 - own).alias("_kind")))
    dealt = materialise(both.withColumn("_o", F.col("_v") * sign).withColumn("_t", F.monotonically_increasing_id()).repartitionByRange("_o", "_kind", "_t").withColumn("_range", F.spark_partition_id()))
    seen = F.max(F.when(F.col("_kind") != own, F.col("_o")))
    ranges = dealt.groupBy("_range").agg(seen.alias("_last"))
    carried = ranges.select("_range", F.max("_last").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    w = Window.partitionBy("_range").orderBy("_o", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumn("_found", seen.over(w)).filter(F.col("_kind") == own).join(F.broadcast(carried), "_range")
    return found.select(F.col("_v").alias(key), (F.coalesce("_found", "_carried") * sign).alias(value))


def max_lower_bound(keys: DataFrame, values: DataFrame, key: str, value: str) -> DataFrame:
    """For every key the largest value that is not above it; null if there is none."""
    return _bound(keys, values, key, value, False)


def min_upper_bound(keys: DataFrame, values: DataFrame, key: str, value: str) -> DataFrame:
    """For every key the least value that is above it; null if there is none."""
    return _bound(keys, values, key, value, True)
