"""Tables in the shared folder, for loops: they cut the lineage and outlive executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a table that may be sent to every task; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The application's folder under ``spark.checkpoint.dir``, which all executors share. Where that is unset, a local master gets a temporary one, and others an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = f"file://{tempfile.gettempdir()}/cellgrove-checkpoints"
    return f"{base.rstrip('/')}/cellgrove-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def discard(spark: SparkSession) -> None:
    """Deletes all tables that this application wrote; DataFrames that read them are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
