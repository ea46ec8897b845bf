"""Vector and time helpers as Spark Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two equal-length numeric arrays (cosine for unit vectors).

    Summed left to right in double precision, like a sequential NumPy dot.
    """
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def epoch_seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970-01-01 of a TIMESTAMP_NTZ, independent of the
    session time zone (monotonic, so it can drive range buckets)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ (time-zone independent)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def bucket_of(ts: Column | str, bucket_seconds: int) -> Column:
    return F.floor(epoch_seconds(ts) / F.lit(bucket_seconds)).cast("bigint")

