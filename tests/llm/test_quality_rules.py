import re
from collections import Counter

from lexmill.llm import QUERIES
from lexmill.llm.quality_rules import bucket, bucket_start, fences, quality_rules, signals, sketches
from lexmill.llm.sql import QUALITY_RULES
from pyspark.sql import functions as F
from tests.oracle import compare, duck


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeat = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat),
    )


CASES = ["a b c a b c", "a a a a", "a b c d a b", "x\nx\n \ny\nx", "", None, " \x0b ", "é|ü <b> $", "a b", "a b c", "one\r\none"]


def test_counts(make_docs, odd_docs):
    for df in (make_docs(list(enumerate(CASES))), odd_docs):
        texts = df.select("doc_id", "text").collect()
        got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
                      for r in signals(df).collect())
        assert got == Counter((t["doc_id"], *plain_counts(t["text"])) for t in texts)


def test_sketch_buckets(spark):
    rows = spark.range(0, 200000, 7).select("id", bucket(F.col("id")).alias("b")).withColumn("s", bucket_start(F.col("b")))
    assert rows.where("s > id or id - s > id / 32").count() == 0
    assert rows.where("id < 64 and s <> id").count() == 0


def test_thresholds_follow_their_group(make_docs):
    def text(i, symbol):
        return " ".join(f"w{i}x{k}{symbol}" for k in range(60))

    # a source where one symbol a word is usual keeps it; one where it is not drops it
    rows = [(i, text(i, "%"), "en", "code") for i in range(30)] + [(100 + i, text(i, ""), "en", "prose") for i in range(30)]
    rows += [(200, text(200, "%"), "en", "prose"), (201, text(201, "%"), None, None)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules(make_docs(rows), min_docs=20).collect()}
    assert all(got[i] for i in range(30)) and all(got[100 + i] for i in range(30))
    assert not got[200]


def test_fences_of_the_given_table_differ_between_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = fences(sketches(signals(docs)), min_docs=20).collect()
    # every signal whose values have a spread in the groups has fences of its own there
    for name in ("most_repeats", "most_word_length", "least_word_length"):
        assert len({r[name] for r in rows}) > 1, name


def test_fences_against_sorting(make_docs):
    text = lambda i, n: " ".join(f"w{i}x{k}" for k in range(100)) + " " + " ".join(["#"] * n)
    rows = [(i, text(i, i % 9), "en", "a") for i in range(40)] + [(100 + i, text(i, i % 3), "en", "b") for i in range(40)]
    got = {r["source_key"]: r["most_symbols"] for r in fences(sketches(signals(make_docs(rows))), min_docs=20).collect()}
    for source, most in (("a", 9), ("b", 3)):
        values = sorted(10000 * (i % most) // (100 + i % most) for i in range(40))

        def low(v):
            shift = max(v.bit_length() - 6, 0)
            return (v >> shift) << shift

        middle, high = low(values[19]), values[35]
        step = 1 << max(high.bit_length() - 6, 0)
        assert got["=" + source] == middle + 3 * (low(high) + step - 1 - middle)


def test_odd_and_empty(odd_docs):
    rows = quality_rules(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 50)
    assert quality_rules(odd_docs.limit(0)).count() == 0


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert not compare(QUERIES["op1_quality_rules"](spark, sf), duck(sf), QUALITY_RULES)[0]
