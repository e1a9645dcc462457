"""Vectors as rows ``(node_id, v)`` (more values a node: v0, v1, ..): arithmetic by key, reductions as partial and final aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fill(nodes: DataFrame, value: float, dof: int = 1, key: str = "node_id") -> DataFrame:
    """The same value everywhere."""
    return nodes.select(key, *(F.lit(float(value)).alias(n) for n in values_of(dof)))


def by_function(nodes: DataFrame, values: list[Column], key: str = "node_id") -> DataFrame:
    """Values as expressions of the nodes' coordinates."""
    return nodes.select(key, *(c.cast("double").alias(n) for c, n in zip(values, values_of(len(values)))))


def values_of(dof: int) -> list[str]:
    return ["v"] if dof == 1 else [f"v{i}" for i in range(dof)]


def component(vector: DataFrame, i: int, key: str = "node_id") -> DataFrame:
    return vector.select(key, F.col(f"v{i}").alias("v"))


def axpy(a: float, x: DataFrame, y: DataFrame, key: str = "node_id") -> DataFrame:
    """a x + y."""
    return x.select(key, F.col("v").alias("_x")).join(y, key).select(key, (F.col("_x") * a + F.col("v")).alias("v"))


def dot(x: DataFrame, y: DataFrame, key: str = "node_id") -> DataFrame:
    return x.select(key, F.col("v").alias("_x")).join(y, key).agg(F.sum(F.col("_x") * F.col("v")).alias("dot"))


def norms(x: DataFrame) -> DataFrame:
    """(l2, linf, least, most) in one pass."""
    v = F.col("v")
    return x.agg(F.sqrt(F.sum(v * v)).alias("l2"), F.max(F.abs(v)).alias("linf"), F.min(v).alias("least"), F.max(v).alias("most"))


def distance(x: DataFrame, y: DataFrame, key: str = "node_id") -> DataFrame:
    """(l2, linf) of the difference."""
    return norms(axpy(-1.0, y, x, key)).select("l2", "linf")


def reduced(x: DataFrame, by: str | None = None) -> DataFrame:
    """(sum, least, mean, most, every, some) of v: the reductions of partial results; the last two of v <> 0."""
    v = F.col("v")
    aggs = [F.sum(v).alias("sum"), F.min(v).alias("least"), F.avg(v).alias("mean"), F.max(v).alias("most"), F.bool_and(v != 0).alias("every"), F.bool_or(v != 0).alias("some")]
    return x.groupBy(by).agg(*aggs) if by else x.agg(*aggs)


def accumulate(parts: DataFrame, key: str = "node_id") -> DataFrame:
    """Contributions of many elements to a node, summed."""
    return parts.groupBy(key).agg(F.sum("v").alias("v"))
