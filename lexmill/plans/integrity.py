"""Corpus integrity and vector drift queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import integrity
from ..sources.tables import spread, table
from .registry import query

# a line shipped before 1996 lost its parent key, one without discount its second key;
# parents are the orders that are not pending
LINES = """
lines AS (SELECT l_orderkey * 8 + l_linenumber AS child_id, CASE WHEN l_shipdate >= TIMESTAMP '1996-01-01' THEN l_orderkey END AS parent_id,
  CASE WHEN l_discount > 0 THEN l_suppkey END AS second_id FROM lineitem),
parents AS (SELECT o_orderkey AS parent_id, o_orderpriority AS title FROM orders WHERE o_orderstatus <> 'P')"""


def lines(spark, d):
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("child_id"),
        F.when(F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz"), F.col("l_orderkey")).alias("parent_id"),
        F.when(F.col("l_discount") > 0, F.col("l_suppkey")).alias("second_id"))


def parents(spark, d):
    return table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("parent_id"), F.col("o_orderpriority").alias("title"))


REASON = """CASE WHEN l.parent_id IS NULL THEN 'missing_parent' WHEN second_id IS NULL THEN 'missing_second_key' WHEN p.parent_id IS NULL THEN 'unknown_parent' END"""


@query("orphan_rows", "WITH " + LINES + f"""
SELECT child_id, reason FROM (SELECT child_id, {REASON} AS reason FROM lines l LEFT JOIN parents p USING (parent_id)) WHERE reason IS NOT NULL""")
def orphan_rows(spark, d):
    out = integrity.orphan_reason(lines(spark, d), parents(spark, d), "parent_id", "second_id")
    return out.where("reason IS NOT NULL").select("child_id", "reason")


@query("childless_parents", """
SELECT c_custkey AS parent_id, c_name AS title FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def childless_parents(spark, d):
    """Customers without an urgent order."""
    owners = table(spark, d, "customer").select(F.col("c_custkey").alias("parent_id"), F.col("c_name").alias("title"))
    children = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("parent_id"))
    return integrity.childless(owners, children, "parent_id")


@query("children_per_parent", "WITH " + LINES + "SELECT parent_id, count(*) AS n FROM lines WHERE second_id IS NOT NULL AND parent_id IN (SELECT parent_id FROM parents) GROUP BY 1")
def children_per_parent(spark, d):
    return integrity.children_count(lines(spark, d), parents(spark, d), "parent_id", "second_id")


@query("duplicate_keys", """
WITH k AS (SELECT sha256(text) AS key, doc_id FROM documents), n AS (SELECT key, count(*) AS n FROM k GROUP BY 1 HAVING count(*) > 1)
SELECT key, n, doc_id FROM k JOIN n USING (key)""")
def duplicate_keys(spark, d):
    rows = spread(table(spark, d, "documents"), "doc_id").select("doc_id", F.sha2("text", 256).alias("key"))
    return integrity.duplicate_members(rows, "key", "doc_id")


@query("corpus_report", "WITH " + LINES + f""",
r AS (SELECT {REASON} AS reason FROM lines l LEFT JOIN parents p USING (parent_id)),
d AS (SELECT count(*) AS n FROM (SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(*) > 1)),
z AS (SELECT count(*) AS n FROM parents WHERE parent_id NOT IN (SELECT parent_id FROM lines WHERE parent_id IS NOT NULL AND second_id IS NOT NULL))
SELECT 'children' AS "check", count(*) AS n, FALSE AS violation FROM lines
UNION ALL SELECT 'parents', count(*), FALSE FROM parents
UNION ALL SELECT 'childless_parents', n, FALSE FROM z
UNION ALL SELECT 'duplicate_keys', n, n > 0 FROM d
UNION ALL SELECT 'orphan:' || k, count(reason), count(reason) > 0 FROM (VALUES ('missing_parent'), ('missing_second_key'), ('unknown_parent')) AS t(k) LEFT JOIN r ON r.reason = k GROUP BY k""")
def corpus_report(spark, d):
    """Every check as a row; childless parents are reported but break nothing."""
    children, owners = lines(spark, d), parents(spark, d)
    reasons = integrity.orphan_reason(children, owners, "parent_id", "second_id")
    kinds = ["missing_parent", "missing_second_key", "unknown_parent"]
    counted = reasons.agg(F.count("*").alias("children"), *[F.count_if(F.col("reason") == k).alias(k) for k in kinds])
    spreadsheet = F.array(F.struct(F.lit("children").alias("check"), F.col("children").alias("n")),
                          *[F.struct(F.lit(f"orphan:{k}").alias("check"), F.col(k).alias("n")) for k in kinds])
    valid = children.where("parent_id IS NOT NULL AND second_id IS NOT NULL")
    keys = spread(table(spark, d, "documents"), "doc_id").groupBy(F.sha2("text", 256).alias("key")).agg(F.count("*").alias("n"))
    parts = [
        counted.select(F.explode(spreadsheet).alias("c")).select("c.*"),
        owners.agg(F.count("*").alias("n")).select(F.lit("parents").alias("check"), "n"),
        integrity.childless(owners, valid, "parent_id").agg(F.count("*").alias("n")).select(F.lit("childless_parents").alias("check"), "n"),
        keys.where("n > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate_keys").alias("check"), "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    harmless = ["children", "parents", "childless_parents"]
    return out.select("check", "n", (~F.col("check").isin(harmless) & (F.col("n") > 0)).alias("violation"))


# labels from 5 up are stored in another space than the rest: shifted by a constant
SHIFT = 0.6
STORED = f"stored AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE + CASE WHEN label >= 5 THEN {SHIFT} ELSE 0 END) AS vec FROM embeddings)"


def stored(spark, d):
    shift = F.when(F.col("label") >= 5, F.lit(SHIFT)).otherwise(0.0)
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double") + shift).alias("vec"))


UNIT = "list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y))))"


@query("centroid_gap_split", "WITH " + STORED + f""",
u AS MATERIALIZED (SELECT id, {UNIT.format(v='vec')} AS u FROM stored),
m AS (SELECT i, avg(x) AS x FROM (SELECT unnest(u) AS x, generate_subscripts(u, 1) AS i FROM u) GROUP BY i),
c AS (SELECT list(x ORDER BY i) AS c FROM m),
s AS MATERIALIZED (SELECT id, round(list_cosine_similarity(u, c), 6) AS cosine FROM u, c),
g AS (SELECT cosine AS low, round(lead(cosine) OVER (ORDER BY cosine) - cosine, 6) AS gap FROM (SELECT DISTINCT cosine FROM s)),
w AS (SELECT low, gap FROM g WHERE gap IS NOT NULL ORDER BY gap DESC, low LIMIT 1)
SELECT id, cosine, CASE WHEN gap >= {C.DRIFT_GAP} THEN CASE WHEN cosine <= low THEN 'low' ELSE 'high' END END AS side FROM s, w""")
def centroid_gap_split(spark, d):
    rows = stored(spark, d)
    dim = rows.select(F.size("vec")).first()[0]
    return integrity.centroid_split(rows, "vec", dim)


@query("embedding_cluster_direction", "WITH " + STORED + f""",
k AS (SELECT CASE WHEN label >= 5 THEN 'high' ELSE 'low' END AS side, id FROM stored),
p AS (SELECT side, id FROM (SELECT side, id, row_number() OVER (PARTITION BY side ORDER BY id) AS rank FROM k) WHERE rank <= {C.DRIFT_SAMPLE}),
m AS (SELECT side, round(avg(list_cosine_similarity(s.vec, e.embedding::DOUBLE[])), 6) AS mean_cosine FROM p JOIN stored s USING (id) JOIN embeddings e ON e.vec_id = p.id GROUP BY side)
SELECT side, mean_cosine, side = (SELECT arg_max(side, (mean_cosine, side)) FROM m) AS migrated FROM m""")
def embedding_cluster_direction(spark, d):
    """The stored store is compared with fresh vectors on three rows of each side."""
    rows = stored(spark, d)
    side = F.when(F.col("label") >= 5, "high").otherwise("low")
    order = Window.partitionBy("side").orderBy("id")
    picked = rows.select(side.alias("side"), "id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= C.DRIFT_SAMPLE)
    fresh = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return integrity.migrated_side(picked, rows, fresh)
