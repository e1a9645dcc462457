"""Line deduplication over levelled sorted runs of line hashes, in DataFrame operations only.

A store holds runs: tables sorted by the 128-bit hash of a line's key. Each new batch of documents is merged with the runs by an
anti-join: keys that no run has are added as the batch's own run, with the number of documents that hold them and the largest of their
ids, so every key stands in one run only. Keys that some run has are written as updates, which are few. When a level has ``FANOUT`` runs they are
compacted into one run of the next level, so the runs stay few. A key's count is that of its run and its updates: only keys with
updates, or common within their own batch, can be common at all.

Batches are ranges of the ids, in their order (of hashes of the ids, where these are no numbers), as documents arrive.

The key of a line is the line with ``[ \\t-\\r]`` stripped at both ends and A-Z lower-cased. Keys of at least
``MIN_CHARS`` code points in at least ``MIN_DOCUMENTS`` documents lose all their lines except in the largest id.

Defined results: a null text is one empty line; a document is an id, so rows that repeat an id count once; rows
without an id count as one document, which is the largest only if no other holds the line; every line of a key in the
largest document stays. A line that very many documents hold is counted with partial sums, and its lines are joined
through tables, which adaptive execution splits. Columns beyond id and text pass through.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from cellgrove.llm.common import ascii_lower, free_name, scratch, written

MIN_CHARS, MIN_DOCUMENTS = 20, 3
BATCHES, FANOUT = 4, 3
WHITE = " \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


@dataclass
class LineRuns:
    """The store. ``levels[k]`` are the paths of the runs of level k, ``updates`` those of counts to add; all are in the shared folder."""

    spark: SparkSession
    fanout: int = FANOUT
    levels: list[list[str]] = field(default_factory=lambda: [[]])
    updates: list[str] = field(default_factory=list)

    def runs(self) -> DataFrame | None:
        paths = [p for level in self.levels for p in level]
        return self.spark.read.parquet(*paths) if paths else None

    def add(self, batch: DataFrame) -> None:
        """Takes in (h1, h2, id) of a batch, each document's keys once. No document may come in two batches."""
        own = batch.groupBy(*HASH).agg(F.count("*").alias("n"), F.max("id").alias("top"))
        path, runs = scratch(self.spark), self.runs()
        if runs is None:
            own.sortWithinPartitions(*HASH).write.parquet(path)
            self.levels[0].append(path)
            return
        # one merge gives both sides: a key without a partner is fresh, as an anti-join has it
        partner = runs.select(*HASH, F.lit(True).alias("known"))
        merged = own.join(partner, HASH, "left").select(*HASH, "n", "top", F.col("known").isNull().cast("int").alias("fresh"))
        merged.sortWithinPartitions("fresh", *HASH).write.partitionBy("fresh").parquet(path)
        found = {r.fresh for r in self.spark.read.schema(merged.schema).parquet(path).select("fresh").distinct().collect()}
        if 1 in found:
            self.levels[0].append(f"{path}/fresh=1")
        if 0 in found:
            self.updates.append(f"{path}/fresh=0")
        self._compact()

    def _compact(self) -> None:
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                path = scratch(self.spark)
                self.spark.read.parquet(*self.levels[k]).repartition(*HASH).sortWithinPartitions(*HASH).write.parquet(path)
                self.levels[k + 1].append(path)
                self.levels[k] = []

    def common(self, least: int) -> DataFrame:
        """(h1, h2, n, top) of the keys that ``least`` documents hold or more."""
        runs = self.runs()
        if not self.updates:
            return runs.filter(F.col("n") >= least)
        added = self.spark.read.parquet(*self.updates).groupBy(*HASH).agg(F.sum("n").alias("more"), F.max("top").alias("later"))
        n = F.col("n") + F.coalesce("more", F.lit(0))
        return runs.join(added, HASH, "left").select(*HASH, n.alias("n"), F.greatest("top", "later").alias("top")).filter(F.col("n") >= least)


def line_hashes(df: DataFrame, key: str, text: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, body, line, h1, h2): every line whose key is long enough; ``body`` is a hash of the text, ``line`` counts from 0."""
    keys = F.transform(lines_of(ascii_lower(F.col(text))), lambda x: F.btrim(x, F.lit(WHITE)))
    rows = df.select(F.col(key).alias("id"), F.xxhash64(text).alias("body"), F.posexplode(keys).alias("line", "line_key"))
    return rows.filter(F.char_length("line_key") >= min_chars).select("id", "body", "line", F.xxhash64("line_key").alias("h1"), F.xxhash64(F.lit(1), "line_key").alias("h2"))


def _batch(df: DataFrame, key: str, batches: int) -> Column:
    """The batch of an ``id``: the range of the ids, of about equal numbers, that it stands in. Rows without an id are in the first."""
    if isinstance(df.schema[key].dataType, NumericType) and batches > 1:
        cuts = df.agg(F.percentile_approx(key, [k / batches for k in range(1, batches)])).first()[0] or []
        return F.coalesce(sum(((F.col("id") > F.lit(c)).cast("int") for c in cuts), F.lit(0)), F.lit(0))
    return F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, batches: int = BATCHES) -> DataFrame:
    """``df`` with its lines reduced, and ``n_lines`` (before) and ``n_dropped``."""
    spark = df.sparkSession
    found = written(line_hashes(df, key, text, min_chars).withColumn("batch", _batch(df, key, batches)), "batch")
    store = LineRuns(spark)
    for k in range(batches):
        store.add(found.filter(F.col("batch") == k).select(*HASH, "id").distinct())
    common = written(store.common(min_documents).select(*HASH, "top"))
    lost = found.join(common, HASH).filter(~F.col("id").eqNullSafe(F.col("top"))).select("id", "body", "line")
    lost = written(lost.groupBy("id", "body").agg(F.sort_array(F.collect_set("line")).alias("lost")))

    names = {x: free_name(df, x) for x in ("body", "lines", "lost")}
    docs = df.withColumn(names["body"], F.xxhash64(text))
    lost = lost.select(F.col("id").alias("_lost_id"), F.col("body").alias("_lost_body"), F.col("lost").alias(names["lost"]))
    out = docs.join(lost, docs[key].eqNullSafe(lost["_lost_id"]) & (docs[names["body"]] == lost["_lost_body"]), "left").drop("_lost_id", "_lost_body")
    lines, gone = lines_of(F.col(text)), F.col(names["lost"])
    # between one lost line and the next, the lines are taken as a slice
    at = lambda k: F.when(k < 0, -1).when(k >= F.size(gone), F.size(lines)).otherwise(F.get(gone, k))
    rest = F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda k: F.slice(lines, at(k - 1) + 2, at(k) - at(k - 1) - 1)))
    kept = F.when(gone.isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(rest, "\n"))
    return out.select(*(kept.alias(c) if c == text else F.col(c) for c in df.columns), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"), gone.alias("_gone")).withColumn("n_dropped", F.when(F.col("_gone").isNull(), 0).otherwise(F.col("n_dropped"))).drop("_gone")
