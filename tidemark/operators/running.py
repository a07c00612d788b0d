"""Running maxima without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.names import unused
from tidemark.operators.parts import PART_ROWS, key_cuts, part_of


def running_max(df: DataFrame, by: str, order: list[Column], value: Column, name: str, inclusive: bool, part_rows: int = PART_ROWS) -> DataFrame:
    """Adds the largest value over all rows before (or up to) each row, in order; `by` is the order's leading column.

    Rows are ordered inside parts of about equal size; only one row a part, 1024 at most, goes through the window
    over all parts and is then sent to all tasks.
    """
    cuts = key_cuts(df, by, part_rows)
    part, near, base, top = unused([*df.columns, name], "part", "near", "base", "top")
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    cut = df.withColumn(part, part_of(F.col(by), cuts))
    found = cut.withColumn(near, F.max(value).over(inside))
    if not cuts:
        return found.withColumn(name, F.col(near)).drop(part, near)
    tops = cut.groupBy(part).agg(F.max(value).alias(top))
    before = tops.select(part, F.max(top).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)).alias(base))
    return found.join(F.broadcast(before), part).withColumn(name, F.greatest(near, base)).drop(part, near, base)


def ordering_guard(arrivals: DataFrame, arrival: str = "arrival", newest_ns: int | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """Adds accepted: ts_ns is positive and larger than every earlier arrival's (and than what is stored).

    A rejected row is no larger than the running maximum, so the plain maximum over all arrivals is right.
    """
    (seen,) = unused(arrivals.columns, "seen")
    guarded = running_max(arrivals, arrival, [F.col(arrival)], F.col("ts_ns"), seen, False, part_rows)
    least = F.coalesce(F.col(seen), F.lit(0)) if newest_ns is None else F.greatest(F.coalesce(F.col(seen), F.lit(0)), F.lit(newest_ns))
    return guarded.withColumn("accepted", (F.col("ts_ns") > 0) & (F.col("ts_ns") > least)).drop(seen)


def floor_blocks(blocks: DataFrame, probes: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """For each probe ts_ns the block with the last first_ts at or before it; before all blocks, the oldest one.

    blocks has block_num and first_ts; first_ts is unique. What is carried along is the block itself, so blocks are
    not joined again. Without blocks no probe has one.
    """
    block = F.struct("first_ts", "block_num")
    marks = blocks.select(F.col("first_ts").alias("t"), F.lit(0).alias("is_probe"), block.alias("block"))
    kind = marks.schema["block"].dataType
    asks = probes.select(F.col("ts_ns").alias("t"), F.lit(1).alias("is_probe"), F.lit(None).cast(kind).alias("block"))
    found = running_max(marks.union(asks), "t", [F.col("t"), F.col("is_probe")], F.col("block"), "found", True, part_rows)
    oldest = blocks.select(F.min(block)).scalar()
    asked = found.where("is_probe = 1").select(F.col("t").alias("ts_ns"), F.coalesce("found", oldest).alias("found"))
    return asked.where("found is not null").select("ts_ns", "found.block_num", "found.first_ts")
