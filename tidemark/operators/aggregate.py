"""Tumbling windows over time: sum, avg, max, min, count and last of record fields."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.durations import parse_duration
from tidemark.functions.values import NUMBER_KINDS, is_number_type

FUNCTIONS = ("sum", "avg", "max", "min", "count", "last")


@dataclass
class AggSpec:
    """A window width in nanoseconds, functions by field, and the defaults of numeric fields."""

    window_ns: int
    fields: dict[str, list[str]] = field(default_factory=dict)
    default: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, window: str | int, fields: str = "", default: str = "") -> AggSpec:
        """fields such as 'cpu:avg+max,disk:sum', default such as 'avg,sum'; a field's last mention counts."""
        width = parse_duration(window) if isinstance(window, str) else window
        if width <= 0:
            raise ValueError("a window must be longer than zero")
        found = {}
        for part in filter(None, (p.strip() for p in fields.split(","))):
            name, colon, names = part.rpartition(":")
            if not colon or not name.strip():
                raise ValueError(f"no function for field {part!r}")
            found[name.strip()] = _functions(names.split("+"))
        return cls(width, found, _functions(default.split(",")) if default.strip() else [])

    def functions(self, name: str, numeric: bool) -> list[str]:
        """What a field gets: its own functions, else the defaults if it is numeric, else its last value."""
        return self.fields.get(name) or (self.default if numeric and self.default else ["last"])


def _functions(names: list[str]) -> list[str]:
    out = [n.strip() for n in names]
    if bad := [n for n in out if n not in FUNCTIONS]:
        raise ValueError(f"unknown functions: {bad}")
    return out


#: Columns that every result has beside its outputs.
RESERVED = ("window_end", "record_count", "partial")


def output_name(name: str, fn: str, many: bool) -> str:
    return f"{name}_{fn}" if many else name


def output_columns(spec: AggSpec, kinds: dict[str, T.DataType], names: list[str], by: Sequence[str] = ()) -> list[tuple[str, str, str]]:
    """(field, function, column) of every output.

    A field called like a column of the result, or like a key of `by`, gets 'field_' before its name; two outputs
    of one name are an error, so none is lost.
    """
    out = []
    for name in names:
        fns = spec.functions(name, is_number_type(kinds[name]))
        for fn in fns:
            column = output_name(name, fn, len(fns) > 1)
            out.append((name, fn, f"field_{column}" if column.lower() in (*RESERVED, *(b.lower() for b in by)) else column))
    columns = [c.lower() for *_, c in out]
    if twice := sorted({c for c in columns if columns.count(c) > 1}):
        raise ValueError(f"several outputs are called {twice}")
    return out


def output_value(fn: str, value: Column, numeric: bool, ts_ns: str) -> Column:
    """What one function makes of a field; a null is a missing field, and avg divides by all present values."""
    number = value.cast("double") if numeric else F.lit(None).cast("double")
    return {
        "sum": lambda: F.sum(number), "avg": lambda: F.sum(number) / F.count(value), "max": lambda: F.max(number), "min": lambda: F.min(number),
        "count": lambda: F.count(value), "last": lambda: F.max_by(value, F.when(value.isNotNull(), F.col(ts_ns))),
    }[fn]()


def window_end(width: int, ts_ns: str = "ts_ns") -> Column:
    """The exclusive end of the epoch-aligned window of a key."""
    return F.expr(f"({ts_ns} div {width} + 1) * {width}")


def aggregate(df: DataFrame, spec: AggSpec, names: list[str], limit: int = 0, by: Sequence[str] = (), ts_ns: str = "ts_ns") -> DataFrame:
    """Typed records: window_end, record_count, partial and one column for each output, ascending.

    A null is a missing field. avg divides by all present values. The last window is partial, and sums of a
    partial window are null, since more records may come. The window that is last is read from the keys alone.
    With `by`, windows are kept apart by more columns. Names of outputs follow output_columns().
    """
    kinds = {f.name: f.dataType for f in df.schema}
    outputs = output_columns(spec, kinds, names, by)
    made = [output_value(fn, F.col(f"`{name}`"), is_number_type(kinds[name]), ts_ns).alias(column) for name, fn, column in outputs]
    newest = df.select(F.max(window_end(spec.window_ns, ts_ns))).scalar()
    grouped = df.groupBy(*by, window_end(spec.window_ns, ts_ns).alias("window_end")).agg(F.count(F.lit(1)).alias("record_count"), *made)
    out = grouped.withColumn("partial", F.col("window_end") == newest)
    out = out.withColumns({c: F.when(~F.col("partial"), F.col(f"`{c}`")) for _, fn, c in outputs if fn == "sum"})
    out = out.select(*by, *RESERVED, *[f"`{c}`" for *_, c in outputs])
    return out.orderBy("window_end").limit(limit) if limit > 0 else out


def aggregate_json(df: DataFrame, spec: AggSpec, payload: str = "payload", limit: int = 0) -> DataFrame:
    """Schemaless records in long form: window_end, record_count, partial, name, number, value (JSON of 'last').

    A field of a window is numeric if its first present value there is. Explicit nulls are present. Texts that
    are no JSON objects are no records, but the JSON null is an empty one. limit keeps the first windows.

    The payload is read and parsed once: a record counts where its first field (or the gap of an empty one) does,
    and the newest window is read from the grouped rows, whose exchange is reused.
    """
    parsed = df.select("ts_ns", F.try_parse_json(F.col(payload).cast("string")).alias("record"))
    spark = df.sparkSession
    fields = parsed.lateralJoin(spark.tvf.variant_explode_outer(F.col("record").outer()))
    # an exploded array has no keys, a scalar no rows of its own: only objects and null are records
    fields = fields.where("key is not null or schema_of_variant(record) in ('VOID', 'OBJECT<>')")
    kind = F.schema_of_variant("value")
    number = F.when(kind.rlike(NUMBER_KINDS), F.try_variant_get("value", "$", "double"))
    stats = fields.groupBy(window_end(spec.window_ns).alias("window_end"), "key").agg(
        F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("records"), F.min_by(kind, "ts_ns").rlike(NUMBER_KINDS).alias("numeric"),
        F.sum(number).alias("sum"), F.count(F.lit(1)).alias("count"), F.max(number).alias("max"), F.min(number).alias("min"),
        F.max_by(F.to_json("value"), "ts_ns").alias("last"),
    )
    each = F.struct("key", "numeric", "sum", "count", "max", "min", "last")
    windows = stats.groupBy("window_end").agg(F.sum("records").alias("record_count"), F.collect_list(each).alias("fields"))
    newest = windows.select(F.max(F.when(F.col("record_count") + F.size("fields") > 0, F.col("window_end")))).scalar()
    windows = windows.withColumn("partial", F.col("window_end") == newest)
    if limit > 0:
        windows = windows.orderBy("window_end").limit(limit)
    wanted = F.lit(None).cast("array<string>")
    for name, fns in spec.fields.items():
        wanted = F.when(F.col("f.key") == name, F.array(*map(F.lit, fns))).otherwise(wanted)
    default = F.array(*map(F.lit, spec.default or ["last"]))
    wanted = F.coalesce(wanted, F.when(F.col("f.numeric"), default).otherwise(F.array(F.lit("last"))))
    rows = windows.select(*RESERVED, F.explode("fields").alias("f")).where("f.key is not null")
    rows = rows.select("*", wanted.alias("fns")).select("*", F.explode("fns").alias("fn"))
    number = (
        F.when(F.col("fn") == "sum", F.when(~F.col("partial"), F.col("f.sum")))
        .when(F.col("fn") == "avg", F.col("f.sum") / F.col("f.count"))
        .when(F.col("fn") == "max", F.col("f.max"))
        .when(F.col("fn") == "min", F.col("f.min"))
        .when(F.col("fn") == "count", F.col("f.count").cast("double"))
    )
    name = F.when(F.size("fns") > 1, F.concat("f.key", F.lit("_"), "fn")).otherwise(F.col("f.key"))
    return rows.select(*RESERVED, name.alias("name"), number.alias("number"), F.when(F.col("fn") == "last", F.col("f.last")).alias("value"))


def numeric_map(schema: T.StructType) -> dict[str, bool]:
    return {f.name: is_number_type(f.dataType) for f in schema}
