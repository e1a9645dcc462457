"""The thin queries over the test tables, one for each text operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrove.llm import decontaminate, html_text, language, lattice, lines, matroska, mixing, pii, simhash, toxicity
from cellgrove.llm.common import residue, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), residue("doc_id", 4) != 2)
    return toxicity.score(docs, model).select("doc_id", (residue("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.coalesce("longest.words", F.lit(0)).alias("n_longest"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = residue("doc_id", 5) == 1
    return lattice.score(table(spark, sf_dir, "documents"), ~held_out).withColumn("held_out", held_out)


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rate`` and ``off`` are the attained rate and the largest difference of an attained marginal from its target."""
    r = lambda c: F.round(c, 9).alias(c)
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source_group", "lang_group", "topic_group", "n_tokens", r("weight"), r("probability"), r("rate"), r("off"), "selected")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digests(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, residue("doc_id", 4) != 2)
    return language.identify(docs, model).select("doc_id", (residue("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", F.size("languages").alias("n_languages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_pii, op3_lattice, op4_decontaminate, op5_lines, op6_mixing, op7_simhash, op8_media, op9_html, op10_language)}


#: Words of benchmark items and documents, windows by length, and the words that windows cover; the longest matches are unbroken diagonals of windows.
OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT *, row_number() OVER (ORDER BY item, ws) AS r FROM (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark)),
suf AS (SELECT item, r, i AS j, least(10, len(ws)) AS k, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS win FROM b, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) u(i) WHERE len(ws) > 0),
win AS (SELECT DISTINCT item, k, win FROM suf),
ks AS (SELECT DISTINCT k FROM win),
places AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS win FROM w, ks, unnest(range(1, len(ws) - k + 2)) u(i)),
hit AS (SELECT doc_id, item, places.k, i FROM places JOIN win USING (k, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, k, i FROM hit) h, unnest(range(i, i + k)) u(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id),
pairs AS (SELECT doc_id, r, k, i, i - j AS diagonal, i - row_number() OVER (PARTITION BY doc_id, r, k, i - j ORDER BY i) AS island FROM places JOIN suf USING (k, win)),
longest AS (SELECT doc_id, max(n) AS n_longest FROM (SELECT doc_id, count(*) + k - 1 AS n FROM pairs GROUP BY doc_id, r, k, diagonal, island) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_longest, 0)::BIGINT AS n_longest
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""


#: Every line with its document and place; keys that enough documents hold and the largest of these; what stays.
OP5_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM docs, unnest(range(1, len(ls) + 1)) u(i)),
common AS (SELECT k, max(doc_id) AS top FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
kept AS (SELECT l.*, c.k IS NULL OR l.doc_id = c.top AS stays FROM lines l LEFT JOIN common c USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (NOT stays)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""

OP6_SQL = f"WITH {mixing.mix_sql()} SELECT doc_id, source_group, lang_group, topic_group, n_tokens, round(weight, 9) AS weight, round(probability, 9) AS probability, round(rate, 9) AS rate, round(off, 9) AS off, selected FROM mixed"


def oracle_sql() -> dict[str, str]:
    return {"op4_decontaminate": OP4_SQL, "op5_lines": OP5_SQL, "op6_mixing": OP6_SQL}
