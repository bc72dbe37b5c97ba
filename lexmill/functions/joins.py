"""Joins that hold up when one key carries a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import plan_bytes

SALTS = 16  # a power of two
#: Estimated bytes of the small side up to which Spark may broadcast its SALTS copies.  The estimate is that of
#: compressed files and knows nothing of the copies.
BROADCAST_BYTES = 256 << 10


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread_by: str, how: str = "inner") -> DataFrame:
    """Join with the big side of every key cut into SALTS parts.

    The small side (an aggregate or a query table) is repeated once per salt,
    so a hot key is worked on by SALTS tasks.  A small side of up to BROADCAST_BYTES may
    be broadcast; a larger one never is, for its copies would fill the driver.
    """
    # a bit mask, unlike a remainder, is never NULL: no filter is added that would set
    # this reader of a shared shuffle apart from the others
    left = big.withColumn("_salt", F.xxhash64(spread_by).bitwiseAND(F.lit(SALTS - 1).cast("bigint")).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    if plan_bytes(small) > BROADCAST_BYTES:
        right = right.hint("merge")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
