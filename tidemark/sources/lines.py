"""Ingest from JSON lines, envelopes and journal exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.names import unused
from tidemark.functions.timeconv import rfc3339
from tidemark.functions.values import json_valid
from tidemark.operators.parts import PART_ROWS, key_cuts, part_of


def envelopes(lines: DataFrame, now_ns: int, line: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """{"timestamp"?, "data"} lines as ts_ns, payload and error; a missing or zero timestamp is now_ns.

    Works on batch frames and on text or socket streams alike; columns to `keep` come first.
    """
    record = F.when(json_valid(F.col(line)), F.try_parse_json(F.col(line)))
    data = F.try_variant_get(record, "$.data", "variant")
    stamp = F.coalesce(F.try_variant_get(record, "$.timestamp", "long"), F.lit(0))
    error = F.when(record.isNull(), "invalid JSON").when(data.isNull(), "no data").when(stamp < 0, "invalid timestamp")
    return lines.select(*keep, F.when(stamp == 0, F.lit(now_ns).cast("long")).otherwise(stamp).alias("ts_ns"), F.to_json(data).alias("payload"), error.alias("error"))


def line_documents(lines: DataFrame, now_ns: int, line: str = "value") -> DataFrame:
    """One JSON document a line, as a local socket sends them; keys rise from now_ns on. QUIT ends nothing here.

    On a stream the keys of one batch would come again in the next: there give each batch its own present, as
    append_lines() of a store does in foreachBatch (store_sink).
    """
    if lines.isStreaming:
        raise ValueError("the lines of a stream get their keys batch by batch")
    valid = lines.where((F.col(line) != "QUIT") & json_valid(F.col(line)))
    return valid.select((F.lit(now_ns) + F.monotonically_increasing_id()).alias("ts_ns"), F.col(line).alias("payload"))


def integer(text: Column) -> Column:
    """What is no integer counts as 0."""
    return F.coalesce(text.try_cast("int"), F.lit(0))


def journal_records(df: DataFrame) -> DataFrame:
    """Journal export columns (all strings) to ts_ns, time, host, unit, ident, msg, pri and pid."""
    micros = F.coalesce(F.col("__REALTIME_TIMESTAMP").try_cast("long"), F.lit(0))
    named = lambda c: F.nullif(F.col(c), F.lit(""))
    out = df.select(
        (micros * 1000).alias("ts_ns"),
        named("_HOSTNAME").alias("host"), named("_SYSTEMD_UNIT").alias("unit"),
        F.coalesce(named("SYSLOG_IDENTIFIER"), named("_COMM")).alias("ident"), F.col("MESSAGE").alias("msg"),
        integer(F.col("PRIORITY")).alias("pri"), integer(F.col("_PID")).alias("pid"),
    )
    return out.withColumn("time", rfc3339("ts_ns"))


def with_previous(df: DataFrame, columns: list[str], name: str, part_rows: int = PART_ROWS, ties: Sequence[str] = ()) -> DataFrame:
    """Adds the record before, by ts_ns, as a struct of ts_ns and these columns; null for the first.

    Records of one key are ordered by the columns `ties`. The record before the first of a part is carried over from
    the last of the part before, so no task sees all rows.
    """
    cuts = key_cuts(df, "ts_ns", part_rows)
    part, own, before, last = unused([*df.columns, name], "part", "own", "before", "last_row")
    record, order = F.struct("ts_ns", *columns), ["ts_ns", *ties]
    cut = df.withColumn(part, part_of(F.col("ts_ns"), cuts))
    found = cut.withColumn(own, F.lag(record).over(Window.partitionBy(part).orderBy(*order)))
    if not cuts:
        return found.drop(part).withColumnRenamed(own, name)
    lasts = cut.groupBy(part).agg(F.max_by(record, F.struct(*order)).alias(last))
    found = found.join(F.broadcast(lasts.select(part, F.lag(last).over(Window.orderBy(part)).alias(before))), part)
    return found.withColumn(name, F.coalesce(own, before)).drop(part, own, before)


def rates(df: DataFrame, counters: list[str], part_rows: int = PART_ROWS, ties: Sequence[str] = ()) -> DataFrame:
    """Per-second rates of rising counters against the record before; the first record, and falls, have 0.

    Between two records of one key, ordered by the columns `ties`, the rate is that of floating-point division by
    zero: infinite for a rise, not a number for none.
    """
    (previous,) = unused(df.columns, "previous")
    seconds = (F.col("ts_ns") - F.col(f"{previous}.ts_ns")) / 1e9

    def rate(counter: str) -> Column:
        rise = F.col(counter) - F.col(f"{previous}.{counter}")
        at_once = F.when(rise > 0, F.lit(float("inf"))).when(rise == 0, F.lit(float("nan")))
        return F.coalesce(F.greatest(F.when(seconds == 0, at_once).otherwise(F.try_divide(rise, seconds)), F.lit(0.0)), F.lit(0.0))

    return with_previous(df, counters, previous, part_rows, ties).withColumns({f"{c}_per_sec": rate(c) for c in counters}).drop(previous)


def system_stats(samples: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """ts_ns and the thirteen flat fields of a system-stats record, from raw samples; the first sample gives none.

    samples has ts_ns and, as longs, cpu_total, cpu_idle, memory_total, memory_available, disk_read, disk_write,
    network_rx, network_tx, space_total and space_available. Rates are whole bytes a second, percentages whole and
    rounded down; of nothing they are 0. Samples of one key are ordered by cpu_total.
    """
    counters = ["cpu_total", "cpu_idle", "disk_read", "disk_write", "network_rx", "network_tx"]
    found = with_previous(samples, counters, "previous", part_rows, ["cpu_total"]).where("previous is not null")
    delta = lambda c: f"({c} - previous.{c})"
    per_second = lambda c: f"{delta(c)} div greatest(1, (ts_ns - previous.ts_ns) div 1000000000)"
    percent = lambda part, whole: f"case when {whole} > 0 then int({part} * 100 div {whole}) else 0 end"
    fields = {
        "cpu.pct": percent(f"({delta('cpu_total')} - {delta('cpu_idle')})", delta("cpu_total")),
        "memory.total": "memory_total", "memory.used": "memory_total - memory_available", "memory.available": "memory_available",
        "memory.pct": percent("(memory_total - memory_available)", "memory_total"),
        "disk_io.read_bytes_sec": per_second("disk_read"), "disk_io.write_bytes_sec": per_second("disk_write"),
        "network.rx_bytes_sec": per_second("network_rx"), "network.tx_bytes_sec": per_second("network_tx"),
        "disk_space.total": "space_total", "disk_space.used": "space_total - space_available", "disk_space.available": "space_available",
        "disk_space.pct": percent("(space_total - space_available)", "space_total"),
    }
    return found.select("ts_ns", *[F.expr(e).alias(n) for n, e in fields.items()])
