"""How records, aggregates and alerts are rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import json_valid
from tidemark.operators.schema import SchemaRegistry


def payload_size(payload: Column) -> Column:
    return F.octet_length(payload).cast("long")


def rendered(payload: Column, kind: str, registry: SchemaRegistry | None = None, compact: bool = False) -> Column:
    """By the store's data type: base64, text, JSON as stored, or expanded; what cannot expand stays as stored."""
    if kind == "binary":
        return F.translate(F.base64(payload), "\r\n", "")
    text = payload.cast("string")
    return F.coalesce(registry.expand(text), text) if kind == "schema" and registry and not compact else text


def response(df: DataFrame, include_data: bool, kind: str = "json", registry: SchemaRegistry | None = None, compact: bool = False) -> DataFrame:
    """timestamp, block_num (of a store's records), size and, if asked for, data; without it the payload's bytes are not kept."""
    place = ["block_num"] if "block_num" in df.columns else []
    columns = [F.col("ts_ns").alias("timestamp"), *place, payload_size(F.col("payload")).alias("size")]
    return df.select(*columns, *([rendered(F.col("payload"), kind, registry, compact).alias("data")] if include_data else []))


def data_envelope(ts_ns: Column, data: Column, kind: str | None = "data") -> Column:
    """{"type":"data","timestamp":..,"data":..} with data as a JSON string; without a type, the broker's envelope."""
    parts = [F.lit(kind).alias("type")] if kind else []
    return F.to_json(F.struct(*parts, ts_ns.alias("timestamp"), data.alias("data")))


def record_envelope(ts_ns: Column, record: Column, kind: str | None = "data") -> Column:
    """The same around a record that is JSON, which stands in it as it is; what is no JSON stands in it as a string."""
    quoted = F.to_json(F.array(record))
    quoted = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    value = F.when(json_valid(record), record).otherwise(quoted)
    head = F.lit(f'{{"type":"{kind}","timestamp":' if kind else '{"timestamp":')
    return F.concat(head, ts_ns.cast("string"), F.lit(',"data":'), value, F.lit("}"))


def alert_envelope(alerts: DataFrame, json: bool = False) -> DataFrame:
    """ts_ns and message; `json` says that the alerts' data are JSON records, which then stand in it as objects."""
    data = F.coalesce(F.try_parse_json("data"), F.col("data").cast("variant")) if json else F.col("data")
    body = F.struct("rule_name", "condition", F.col("ts_ns").alias("timestamp"), data.alias("data"), "store_name")
    envelope = F.struct(F.lit("alert").alias("type"), F.col("ts_ns").alias("timestamp"), body.alias("alert"))
    return alerts.select("ts_ns", F.to_json(envelope).alias("message"))


def compact_aggregates(df: DataFrame, registry: SchemaRegistry) -> tuple[dict[str, str], DataFrame]:
    """The header (index to name) and the rows with plain field names replaced by indexes; suffixed names stay."""
    header = {str(f.index): f.name for f in registry.fields() if f.name in df.columns}
    return header, df.withColumnsRenamed({name: index for index, name in header.items()})


def key_hash(key: Column) -> Column:
    return F.sha2(key, 256)
