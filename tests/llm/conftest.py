import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, ties and repeats, and columns whose names clash with those that operators use inside."""
    long_text = "\n".join(f"line {i} of a very long text with 192.168.0.{i % 256} in it" for i in range(3000))
    rows = [
        (1, "The same line that three documents share.\nOwn line of the first document here.", "en", "a", 70),
        (2, "the same line that three documents share.  \nshort", "en", "a", 50),
        (3, "The same line that three documents share.", None, None, None),
        (4, None, None, None, None),
        (5, "", "en", "b", 0),
        (6, " \t\n ", "en", "b", 4),
        (7, long_text, "de", "a", len(long_text)),
        (8, "### 123 $$$", "fr", "a", 11),
        (9, "été naïve ÉTÉ 日本語 \U0001f600 x@y.org", "fr", "b", 20),
        (None, "a text without an id, alone in the world of texts", "en", "c", 48),
        (1, "The same line that three documents share.\nOwn line of the first document here.", "en", "a", 70),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    extra = ("lines", "lost", "body", "n_tokens", "id", "row", "label", "media", "_n", "fp", "h1")
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(extra)))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
