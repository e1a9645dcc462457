"""What the text operators share: table access, a shared scratch folder, bounded Arrow batches, ASCII folding."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Rows and bytes that one Arrow batch may carry to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """The application's folder under ``spark.checkpoint.dir``, which all executors share. Where that is unset, a local master gets a temporary one, and others an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = f"file://{tempfile.gettempdir()}/cellgrove-checkpoints"
    return f"{base.rstrip('/')}/cellgrove-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession) -> str:
    """A new path in the application's folder."""
    return f"{folder(spark)}/{uuid.uuid4().hex}"


def discard(spark: SparkSession) -> None:
    """Deletes all tables that this application wrote there, of the core operators too; DataFrames that read them are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, so that long texts do not add up in a worker. It is a setting of the session, read when a query runs, so it stays."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def runs(items: Iterable[tuple[int, object]], most: int) -> Iterator[list]:
    """Groups of items whose sizes add up to about ``most``; a larger item stands alone."""
    group, total = [], 0
    for size, item in items:
        if group and total + size > most:
            yield group
            group, total = [], 0
        group.append(item)
        total += size
    if group:
        yield group


def residue(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id has remainder 0."""
    return F.pmod(F.coalesce(F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")), F.lit(0)), F.lit(modulus))


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores before it if a column of that name is there."""
    while wanted.lower() in {c.lower() for c in df.columns}:
        wanted = f"_{wanted}"
    return wanted
