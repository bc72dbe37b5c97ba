"""Numbers as the SQL's engine gives them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, digits: int) -> Column:
    """Half away from zero of the scaled double, as DuckDB rounds.

    Spark's round works on the decimal notation, so that 57 / 800 = 0.07125 becomes 0.0713; times 10,000 it is a
    little less than 712.5, and DuckDB's round gives 0.0712.  For numbers that are below 2^63 when scaled.
    """
    scale = 10.0**digits
    return F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale
