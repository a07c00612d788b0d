"""Nanosecond keys beside Spark's microsecond timestamps. The session's time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAST_NS = (1 << 63) - 1


def to_ns(ts: Column | str) -> Column:
    """A timestamp, with or without zone, as nanoseconds since the epoch."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")) * 1000


def to_timestamp(ts_ns: Column | str) -> Column:
    return F.timestamp_micros(F.floor((F.col(ts_ns) if isinstance(ts_ns, str) else ts_ns) / F.lit(1000)))


def rfc3339(ts_ns: Column | str) -> Column:
    """UTC seconds, '2024-01-01T00:00:07Z'."""
    seconds = F.expr(f"{ts_ns} div 1000000000") if isinstance(ts_ns, str) else F.floor(ts_ns / F.lit(10**9))
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def between_ns(df: DataFrame, start: int, end: int, native: str = "ts") -> DataFrame:
    """Rows with start <= ts_ns <= end.

    A range on a derived ts_ns does not reach the Parquet scan; where the frame also has its native timestamp
    column, the same range in whole microseconds, widened to be safe, is added for pushdown.
    """
    out = df.where(F.col("ts_ns").between(start, end))
    kind = dict((f.name, f.dataType) for f in df.schema).get(native)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        name = "timestamp_ntz" if isinstance(kind, T.TimestampNTZType) else "timestamp"
        for op, micros in ((">=", start // 1000), ("<=", -(-end // 1000))):
            if abs(micros) < 250_000_000_000_000_000:
                literal = F.timestamp_micros(F.lit(micros)).cast(name)
                out = out.where(F.col(native) >= literal if op == ">=" else F.col(native) <= literal)
    return out
