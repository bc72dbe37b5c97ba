"""Helpers the operators share: rows that must be told apart, bounded running sums, pieces of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import parallelism
from ..sources.tables import materialize, table  # noqa: F401  used by the operators

Query = Callable[[SparkSession, str], DataFrame]

#: Documents without a NULL in doc_id and without repeated ids need no more than the id; others
#: are told apart by 31 bits of a hash of the text, and its lowest bit says that the id is NULL.
ROW_KEY = ["_rid", "_tag"]


def with_row_key(docs: DataFrame, plain: bool = False) -> DataFrame:
    """Adds _rid and _tag.  Rows with equal keys hold the same id and text, so they share every result.

    ``plain`` says that doc_id alone is a key (see ``ids_are_keys``); the tag, which takes space in
    every shuffle, is then 0.
    """
    tag = F.xxhash64(F.col("text")).bitwiseAND(F.lit(0x7FFFFFFE)).bitwiseOR(F.col("doc_id").isNull().cast("bigint"))
    tag = F.lit(0) if plain else tag
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("_rid"), tag.cast("int").alias("_tag"), *docs.columns
    )


def ids_are_keys(docs: DataFrame) -> bool:
    """No NULL and no repeated doc_id."""
    repeats = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    return repeats.isEmpty()


def key_to_id() -> Column:
    return F.when(F.col("_tag").bitwiseAND(F.lit(1)) == 0, F.col("_rid")).alias("doc_id")


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, in the total order given, the sum of each measure over all rows before.

    Rows are sorted into ranges, each range is summed, and every row gets the total of the
    ranges before its own.  No task sees more than its range; what is broadcast has one row
    per range.  Rows that tie in ``order`` must be equal for the result to be unique.
    """
    spark = rows.sparkSession
    n = parallelism(spark)
    ranged = materialize(
        rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges"
    )
    totals = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    # one row per range, at most ``n``
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums]
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(offsets), "_part").select(
        *rows.columns,
        *[(F.col(f"_o_{k}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(k) for k, c in sums.items()],
    )
