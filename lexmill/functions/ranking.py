"""Global order statistics without a global sort in one task.

A window without partition keys, ``percentile`` and ``median`` all gather a
whole column in one task.  Here values are first counted per distinct value
(combined map-side), dealt into ranges at sampled bounds, summed per range, and
shifted by the totals of the ranges before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import parallelism
from ..sources.tables import materialize

def ordered_stats(dist: DataFrame, value: str, measures: list[str]) -> DataFrame:
    """Running sums in rising order of ``value``, one input row per distinct value.

    Adds ``cum_<m>`` (up to and including the row), ``tot_<m>`` and ``next_<value>`` (the next
    larger value).  Values are dealt into as many ranges as the session has shuffle partitions;
    one row per range, its first value and sums, is what is put together in one place.
    """
    ranges = parallelism(dist.sparkSession)
    dealt = dist.repartitionByRange(ranges, value).withColumn("_range", F.spark_partition_id())
    parts = materialize(dealt, "ordered")
    totals = parts.groupBy("_range").agg(
        F.min(value).alias("_first"), *[F.sum(m).alias(f"_s_{m}") for m in measures]
    )
    # at most ``ranges`` rows from here on
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "_range",
        F.lead("_first").over(Window.orderBy("_range")).alias("_next_first"),
        *[F.coalesce(F.sum(f"_s_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures],
        *[F.sum(f"_s_{m}").over(everything).alias(f"tot_{m}") for m in measures],
    )
    inside = Window.partitionBy("_range").orderBy(value)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (
        parts.join(F.broadcast(offsets), "_range")
        .select(
            *dist.columns,
            F.coalesce(F.lead(value).over(inside), F.col("_next_first")).alias(f"next_{value}"),
            *[(F.col(f"_o_{m}") + F.sum(m).over(upto)).alias(f"cum_{m}") for m in measures],
            *[F.col(f"tot_{m}") for m in measures],
        )
    )


def value_counts(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))


def interpolated(stats: DataFrame, value: str, probs: dict[str, float]) -> list:
    """Aggregates giving linearly interpolated quantiles over ordered_stats rows."""
    out = []
    for name, p in probs.items():
        k = (F.col("tot_n") - 1) * F.lit(p)
        low, high = F.floor(k), F.ceil(k)
        at_low = F.min(F.when(F.col("cum_n") > low, F.col(value)))
        at_high = F.min(F.when(F.col("cum_n") > high, F.col(value)))
        frac = F.max(k - low)
        out.append((at_low + (at_high - at_low) * frac).alias(name))
    return out


def nearest_rank(value: str, probs: dict[str, float]) -> list:
    """Aggregates giving nearest-rank quantiles over ordered_stats rows."""
    return [
        F.min(F.when(F.col("cum_n") >= F.ceil(F.col("tot_n") * F.lit(p)), F.col(value))).alias(name)
        for name, p in probs.items()
    ]
