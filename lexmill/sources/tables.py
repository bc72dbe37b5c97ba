"""Reading tables, JSON Lines exchange and idempotent writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import parallelism, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a DataFrame, in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, *keys: str, split: int = 128 << 20) -> DataFrame:
    """Give a small scan enough tasks for heavy per-row work.

    A small file is one split, so one core would do all the text work.  A scan
    that already yields a split per core is left alone: no shuffle at scale.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if plan_bytes(df) >= split * cores:
        return df
    return df.repartition(parallelism(spark), *keys)


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("error").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read JSON Lines; blank lines hold no record and are skipped by the reader."""
    return spark.read.schema(schema).json(path)


def insert_if_absent(target: DataFrame, batch: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(new table, inserted rows): rows of the batch whose key is not stored yet.

    Of repeats of a new key inside the batch the smallest row is inserted.
    """
    rest = [c for c in batch.columns if c != key]
    once = batch.groupBy(key).agg(F.min(F.struct(*rest)).alias("row")).select(key, "row.*").select(*batch.columns)
    inserted = once.join(target.select(key), key, "left_anti")
    return target.unionByName(inserted), inserted


def overwrite_by_key(versions: DataFrame, key: str, order: list) -> DataFrame:
    """Last write wins.  max_by combines map-side, so a hot key stays cheap."""
    rest = [c for c in versions.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return versions.groupBy(key).agg(newest.alias("row")).select(key, "row.*")


def pending(todo: DataFrame, done: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """Work still open: not logged, or logged with every measure NULL."""
    usable = F.coalesce(*[F.col(m).cast("string") for m in measures]).isNotNull()
    return todo.join(done.where(usable).select(key), key, "left_anti")
