import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names the operators use themselves.
CLASHES = ["_rid", "_tag", "size", "words", "key", "node", "h", "n", "doc", "spans", "places", "shard", "score", "group"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text[, lang, source]) tuples, with clashing extra columns."""

    def make(rows, extra=True):
        full = [(r[0], r[1], *(r[2:] if len(r) > 2 else ("en", "s")), len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.select("*", *[F.lit(f"x{c}").alias(c) for c in CLASHES]) if extra else df

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """NULLs in every column, empty, blank and very long texts, repeated rows, ties."""
    base = " ".join(f"word{i % 97} tail{i % 31}" for i in range(60))
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, base, "en", "a"), (4, base, "en", "a"),
        (5, base + " end", "en", None), (None, base, None, "b"), (None, "other words here", "de", "b"),
        (6, " ".join(f"w{i}" for i in range(20000)), "en", "a"), (7, "x" * 50000, "en", "b"), (8, "é ü 漢字 😀 ok", None, "b"),
        (9, "The mail is a@b.co and 10.0.0.1.", "fr", "b"), (10, "A\x00b\x85c d e", "fr", "a"),
    ]
    return make_docs(rows)
