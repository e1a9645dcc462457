"""The corpus pipeline: five stages over ``documents``, each a table that the next one reads.

Every stage works on all that the one before kept. Language identification rejects documents without a recognisable
language; lines that many documents share go; one document of each near-duplicate group stays; documents with benchmark passages
go; the rest is drawn to the target mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrove.llm import decontaminate, language, lines, mixing, simhash
from cellgrove.llm.common import residue, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what is ``und``: null texts and texts without letters. Mixed texts stay."""
    model = language.fit(docs, residue("doc_id", 4) != 2)
    return language.identify(docs.select(*COLUMNS), model, keep=True)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared lines stay in the largest id only; ``n_chars`` follows the text. Documents left without text stay here; as equals of one another, one of them stays in the next stage."""
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs).select(*COLUMNS)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).filter("selected").select(*COLUMNS, "n_tokens", "topic_group", F.round("weight", 9).alias("weight"), F.round("probability", 9).alias("probability"))


STAGES = [("language", identify_languages), ("lines", dedup_lines), ("near_duplicates", dedup_documents), ("benchmark", remove_benchmark), ("mixture", mix_sources)]

#: The mixture-inference and SimHash stages have no SQL form; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
