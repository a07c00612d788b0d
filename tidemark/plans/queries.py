"""The registered queries of the engine's own operators, and the same results as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.durations import parse_duration
from tidemark.functions.timeconv import rfc3339, to_ns
from tidemark.functions.values import number_text
from tidemark.functions.workdir import scratch_folder
from tidemark.operators import output, retention, running, scans
from tidemark.operators.aggregate import AggSpec, aggregate, aggregate_json
from tidemark.operators.rules import Condition, Rule, alerts, with_cooldown
from tidemark.operators.schema import Field, SchemaRegistry
from tidemark.sources.lines import journal_records, rates, system_stats
from tidemark.sources.store import Config, Engine, Handle, Store, describe, usage
from tidemark.streaming.push import data_messages, parquet_sink, push
from tidemark.streaming.windows import closed_windows, record_windows

HOUR, DAY = 3600 * 10**9, 86_400 * 10**9
START = 1_704_067_200 * 10**9  # 2024-01-01
NOW = START + 30 * DAY

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a store: ts_ns beside its columns."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.withColumn("ts_ns", to_ns("ts"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw JSON records."""
    return events(spark, sf_dir).select("ts", "ts_ns", "event_id", F.to_json(F.struct("event_type", "user_id", "value", "props")).alias("payload"))


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("ts_ns", to_ns("l_shipdate"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Sums of doubles depend on their order in the last digits. Rounding is SQL's, of the millionfold in doubles:
    of values beyond 1e7 or so the sixth digit comes out otherwise by decimals."""
    near = lambda x: F.round(x * 1e6) / 1e6
    return df.withColumns({n: F.when(F.abs(n) < 1e300, near(F.col(n))).otherwise(F.col(n)) for n in names})


def windowed(columns: str, width: int, where: str = "true", table: str = "events", ts: str = "ts", tail: str = "") -> str:
    """SQL twin of aggregate(): `columns` may use p for 'this window is the last'."""
    return f"""
with e as (select *, epoch_ns({ts}) as ts_ns, (epoch_ns({ts}) // {width} + 1) * {width} as window_end from {table} where {where}),
m as (select max(window_end) as w from e)
select window_end, count(*) as record_count, window_end = any_value(w) as partial, {columns}
from e, m group by window_end {tail}"""


@query(windowed(
    "case when window_end < any_value(w) then round(sum(value), 6) end as value_sum, round(avg(value), 6) as value_avg,"
    " arg_max(event_type, ts_ns) as event_type", HOUR))  # fmt: skip
def agg_hourly_flagship(spark, sf_dir):
    spec = AggSpec.parse("1h", "value:sum+avg")
    return rounded(aggregate(events(spark, sf_dir), spec, ["value", "event_type"]), "value_sum", "value_avg")


@query(windowed("case when window_end < any_value(w) then round(sum(l_quantity), 4) end as l_quantity", 7 * DAY, table="lineitem", ts="l_shipdate"))
def agg_sum(spark, sf_dir):
    return aggregate(lineitems(spark, sf_dir), AggSpec.parse("1w", default="sum"), ["l_quantity"]).withColumn("l_quantity", F.round("l_quantity", 4))


@query(windowed("round(avg(l_extendedprice), 4) as l_extendedprice", DAY, table="lineitem", ts="l_shipdate"))
def agg_avg(spark, sf_dir):
    out = aggregate(lineitems(spark, sf_dir), AggSpec.parse("1d", default="avg"), ["l_extendedprice"])
    return out.withColumn("l_extendedprice", F.round("l_extendedprice", 4))


@query(windowed("max(value) as value", 6 * HOUR))
def agg_max(spark, sf_dir):
    return aggregate(events(spark, sf_dir), AggSpec.parse("6h", "value:max"), ["value"])


@query(windowed("min(o_totalprice) as o_totalprice", 7 * DAY, table="orders", ts="o_orderdate"))
def agg_min(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("ts_ns", to_ns("o_orderdate"))
    return aggregate(orders, AggSpec.parse("7d", "o_totalprice:min"), ["o_totalprice"])


@query(windowed("count(event_type) as event_type, count(value) as value", HOUR // 2))
def agg_count(spark, sf_dir):
    return aggregate(events(spark, sf_dir), AggSpec.parse("30m", "event_type:count,value:count"), ["event_type", "value"])


@query(windowed("arg_max(user_id, ts_ns) as user_id, arg_max(event_type, ts_ns) as event_type", HOUR))
def agg_last(spark, sf_dir):
    return aggregate(events(spark, sf_dir), AggSpec.parse("1h", default="last"), ["user_id", "event_type"])


@query(windowed(
    "round(avg(value), 6) as value_avg, case when window_end < any_value(w) then round(sum(value), 6) end as value_sum,"
    " min(value) as value_min, max(value) as value_max, arg_max(event_type, ts_ns) as event_type", 12 * HOUR))  # fmt: skip
def agg_multi_default(spark, sf_dir):
    spec = AggSpec.parse("12h", default="avg,sum,min,max")
    return rounded(aggregate(events(spark, sf_dir), spec, ["value", "event_type"]), "value_avg", "value_sum")


@query(windowed(
    "round(avg(value), 6) as value_avg, min(value) as value_min, max(value) as value_max,"
    " case when window_end < any_value(w) then round(sum(user_id), 6) end as user_id, arg_max(event_type, ts_ns) as event_type", 5400 * 10**9))  # fmt: skip
def agg_per_field_multi(spark, sf_dir):
    spec = AggSpec.parse("1h30m", "value:avg + min + max,user_id:sum", "last")
    return rounded(aggregate(events(spark, sf_dir), spec, ["value", "user_id", "event_type"]), "value_avg", "user_id")


@query(windowed("round(avg(value), 6) as value", 7 * DAY))
def agg_weekly(spark, sf_dir):
    return rounded(aggregate(events(spark, sf_dir), AggSpec.parse("1w", default="avg"), ["value"]), "value")


@query(windowed("round(avg(value), 6) as value", DAY, f"epoch_ns(ts) between {START + 5 * DAY} and {START + 12 * DAY}"))
def agg_daily_range(spark, sf_dir):
    rows = scans.between_ns(events(spark, sf_dir), START + 5 * DAY, START + 12 * DAY)
    return rounded(aggregate(rows, AggSpec.parse("1d", default="avg"), ["value"]), "value")


@query(windowed("max(value) as value", DAY, tail="order by window_end limit 7"))
def agg_limit_windows(spark, sf_dir):
    return aggregate(events(spark, sf_dir), AggSpec.parse("1d", default="max"), ["value"], limit=7)


@query(windowed("round(avg(value), 6) as value", DAY, "contains(event_type, 'urch')"))
def agg_filtered(spark, sf_dir):
    rows = scans.contains_text(events(spark, sf_dir), "urch", column="event_type")
    return rounded(aggregate(rows, AggSpec.parse("1d", default="avg"), ["value"]), "value")


@query(windowed("max(value) as value", DAY, "contains(event_type, 'click')", table="(select * from events order by ts limit 5000)"))
def agg_raw_cap(spark, sf_dir):
    """The reference's safety valve as an option: the first rows of the scan, before the filter."""
    rows = scans.contains_text(scans.first_rows(events(spark, sf_dir), 5000), "click", column="event_type")
    return aggregate(rows, AggSpec.parse("1d", default="max"), ["value"])


@query(windowed("round(avg(value), 6) as value, arg_max(user_id, ts_ns) as user_id", DAY).replace(
    "select window_end, count", "select event_type, window_end, count").replace("group by window_end", "group by event_type, window_end"))
def agg_by_key(spark, sf_dir):
    spec = AggSpec.parse("1d", "value:avg,user_id:last")
    return rounded(aggregate(events(spark, sf_dir), spec, ["value", "user_id"], by=["event_type"]), "value")


def schemaless_sql(field: str, width: int) -> str:
    return f"""
with e as (select epoch_ns(ts) as ts_ns, (epoch_ns(ts) // {width} + 1) * {width} as window_end, cast(json_extract({field}, '$.k') as double) as k from events),
m as (select max(window_end) as w from e),
a as (select window_end, count(*) as record_count, window_end = any_value(w) as partial, sum(k) as s, avg(k) as a, max(k) as x, count(k) as c,
  cast(cast(arg_max(k, ts_ns) as bigint) as varchar) as l from e, m group by window_end)
select window_end, record_count, partial, 'k_sum' as name, case when not partial then s end as number, null::varchar as value from a
union all select window_end, record_count, partial, 'k_avg', round(a, 6), null from a
union all select window_end, record_count, partial, 'k_max', x, null from a
union all select window_end, record_count, partial, 'k_count', c, null from a
union all select window_end, record_count, partial, 'k_last', null, l from a"""


@query(schemaless_sql("props", DAY))
def agg_schemaless_props(spark, sf_dir):
    rows = events(spark, sf_dir).select("ts_ns", F.col("props").alias("payload"))
    return rounded(aggregate_json(rows, AggSpec.parse("1d", "k:sum+avg+max+count+last")), "number")


ROW = "event_id, epoch_ns(ts) as ts_ns, event_type, value"


def row(df: DataFrame) -> DataFrame:
    return df.select("event_id", "ts_ns", "event_type", "value")


@query(f"select {ROW} from events order by ts limit 10")
def scan_oldest(spark, sf_dir):
    return row(scans.oldest(events(spark, sf_dir)))


@query(f"select {ROW} from events order by ts desc limit 25")
def scan_newest(spark, sf_dir):
    return row(scans.newest(events(spark, sf_dir), scans.limit_or("25", scans.NEWEST_LIMIT)))


@query(f"select {ROW} from events where epoch_ns(ts) = {START + 7_179_575_000}")
def scan_at_time(spark, sf_dir):
    return row(scans.at_time(events(spark, sf_dir), START + 7_179_575_000))


@query(f"select {ROW} from events where epoch_ns(ts) between {START + 2 * DAY} and {START + 3 * DAY} order by ts limit 100")
def scan_range(spark, sf_dir):
    return row(scans.time_range(events(spark, sf_dir), START + 2 * DAY, START + 3 * DAY, limit=100, now_ns=NOW))


@query(f"select {ROW} from events where epoch_ns(ts) >= {START + 29 * DAY} and epoch_ns(ts) <= {NOW}")
def scan_range_open_end(spark, sf_dir):
    return row(scans.time_range(events(spark, sf_dir), START + 29 * DAY, now_ns=NOW))


@query(f"select {ROW} from events where epoch_ns(ts) between {NOW - 36 * HOUR} and {NOW} order by ts limit 40")
def scan_since(spark, sf_dir):
    return row(scans.time_range(events(spark, sf_dir), since="1.5d", limit=40, now_ns=NOW))


@query(f"select {ROW} from events where epoch_ns(ts) > {START + DAY} and epoch_ns(ts) <= {NOW} order by ts limit 50")
def scan_after(spark, sf_dir):
    return row(scans.time_range(events(spark, sf_dir), after=START + DAY, limit=50, now_ns=NOW))


@query(f"select {ROW} from events where epoch_ns(ts) between {NOW - 20 * DAY} and {NOW - 10 * DAY} order by ts limit 15")
def scan_newest_since_ascending(spark, sf_dir):
    """The reference's order for newest with since: the span's oldest."""
    return row(scans.newest(events(spark, sf_dir), 15, since="10d", now_ns=NOW - 10 * DAY, order="asc"))


@query(f"select {ROW} from events where epoch_ns(ts) between {NOW - 20 * DAY} and {NOW - 10 * DAY} order by ts desc limit 15")
def scan_newest_since(spark, sf_dir):
    return row(scans.newest(events(spark, sf_dir), 15, since=parse_duration("10d"), now_ns=NOW - 10 * DAY))


@query("""
select ts_ns, doc_id from (
  select doc_id + 1 as ts_ns, doc_id, case when doc_id % 3 = 0 then text else '{"id": ' || doc_id || '}' end as payload from documents order by 1 limit 150)
where doc_id % 3 <> 0 or try_cast(payload as json) is not null""")
def scan_json_valid(spark, sf_dir):
    """The limit comes before rows without JSON are dropped."""
    payload = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit('{"id": '), "doc_id", F.lit("}")))
    rows = documents(spark, sf_dir).select((F.col("doc_id") + 1).alias("ts_ns"), "doc_id", payload.alias("payload"))
    return scans.json_only(scans.first_rows(rows, 150)).select("ts_ns", "doc_id")


@query("""
select doc_id from (select doc_id, case when doc_id % 3 = 0 then text else '{"id": ' || doc_id || '}' end as payload from documents)
where doc_id % 3 <> 0 or try_cast(payload as json) is not null""")
def scan_json_valid_all(spark, sf_dir):
    payload = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit('{"id": '), "doc_id", F.lit("}")))
    return scans.json_only(documents(spark, sf_dir).select("doc_id", payload.alias("payload"))).select("doc_id")


@query("select doc_id, lang from documents where contains(text, 'tion')")
def filter_text(spark, sf_dir):
    return scans.contains_text(documents(spark, sf_dir), "tion", column="text").select("doc_id", "lang")


@query("select page_id, url from pages where contains(lower(html), 'the of')")
def filter_text_ignore_case(spark, sf_dir):
    return scans.contains_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), "The OF", True, "html").select("page_id", "url")


@query(f"select {ROW} from events where contains(event_type, 'error') order by ts limit 30")
def filter_limit(spark, sf_dir):
    return row(scans.first_rows(scans.contains_text(events(spark, sf_dir), "error", column="event_type"), 30))


def rule_query(name: str, condition: str, sql: str) -> None:
    def run(spark, sf_dir):
        df = events(spark, sf_dir)
        return df.where(Condition.parse(condition).typed(df)).select("event_id", "event_type", "value")

    run.__name__ = name
    query(f"select event_id, event_type, value from events where {sql}")(run)


for rule_name, rule_text, rule_sql in (
    ("rule_equal", 'event_type == "error"', "event_type = 'error'"),
    ("rule_not_equal", "event_type != error", "event_type <> 'error'"),
    ("rule_greater", "value > 150", "value > 150"),
    ("rule_greater_equal", "user_id >= 100", "user_id >= 100"),
    ("rule_less", "value < 0.5", "value < 0.5"),
    ("rule_less_equal", "value <= 10.25", "value <= 10.25"),
    ("rule_text_order", 'event_type > "error"', "event_type > 'error'"),
    ("rule_number_as_text", 'user_id == "42"', "user_id = 42"),
    ("rule_contains", 'props contains "7}"', "contains(props, '7}')"),
    ("rule_and", 'value > 100 AND event_type == "click"', "value > 100 and event_type = 'click'"),
    ("rule_or", "value > 300 OR user_id == 7", "value > 300 or user_id = 7"),
    ("rule_missing", "nothing != 5", "false"),
):
    rule_query(rule_name, rule_text, rule_sql)


@query("select event_id from events where cast(json_extract(props, '$.k') as double) >= 50 and value < 20")
def rule_on_json(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("record", F.try_parse_json(F.concat(F.rtrim("props", F.lit("}")), F.lit(', "value": '), F.col("value").cast("string"), F.lit("}"))))
    return df.where(Condition.parse("k >= 50 AND value < 20").on_json(F.col("record"))).select("event_id")


ALERT_RULES = (Rule("high", "value > 150", HOUR), Rule("errors", 'event_type == "error" AND value > 50', 6 * HOUR))
ALERT_SQL = """
hits as (
  select 'high' as rule_name, 'value > 150' as condition, {h}::bigint as cooldown_ns, epoch_ns(ts) as ts_ns, event_id from events where value > 150
  union all select 'errors', 'event_type == "error" AND value > 50', {s}::bigint, epoch_ns(ts), event_id from events where event_type = 'error' and value > 50)
""".format(h=HOUR, s=6 * HOUR)


def found_alerts(spark, sf_dir):
    df = events(spark, sf_dir)
    return alerts(df, ALERT_RULES, F.col("event_id"), "events").withColumnRenamed("data", "event_id")


@query(f"with {ALERT_SQL} select *, 'events' as store_name from hits")
def alerts_all(spark, sf_dir):
    return found_alerts(spark, sf_dir)


@query(f"""
with recursive {ALERT_SQL},
fired as (
  select rule_name, cooldown_ns, min(ts_ns) as ts_ns from hits group by 1, 2
  union all
  select f.rule_name, f.cooldown_ns, (select min(h.ts_ns) from hits h where h.rule_name = f.rule_name and h.ts_ns >= f.ts_ns + f.cooldown_ns)
  from fired f where exists (select 1 from hits h where h.rule_name = f.rule_name and h.ts_ns >= f.ts_ns + f.cooldown_ns))
select h.*, 'events' as store_name from hits h join fired using (rule_name, ts_ns)""")
def alerts_cooldown(spark, sf_dir):
    return with_cooldown(found_alerts(spark, sf_dir))


def registry() -> SchemaRegistry:
    out = SchemaRegistry()
    out.add([Field(1, "event_type", "string"), Field(2, "user_id", "int64")])
    out.add([Field(1, "event_type", "string"), Field(2, "user_id", "int64"), Field(3, "k", "int32")])
    return out


FULL = """'{"event_type":"' || event_type || '","user_id":' || user_id || ',"k":' || json_extract_string(props, '$.k') || '}'"""
COMPACT = """'{"1":"' || event_type || '","2":' || user_id || ',"3":' || json_extract_string(props, '$.k') || '}'"""


def typed_objects(spark, sf_dir) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int").alias("k")
    return events(spark, sf_dir).select("event_id", F.to_json(F.struct("event_type", "user_id", k)).alias("payload"))


@query(f"select event_id, {COMPACT} as payload from events")
def schema_compact(spark, sf_dir):
    return typed_objects(spark, sf_dir).withColumn("payload", registry().compact(F.col("payload")))


@query(f"select event_id, {FULL} as payload from events")
def schema_expand(spark, sf_dir):
    compact = typed_objects(spark, sf_dir).withColumn("payload", registry().compact(F.col("payload")))
    return compact.withColumn("payload", registry().expand(F.col("payload")))


@query("""select event_id, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' as payload from events""")
def schema_expand_old_version(spark, sf_dir):
    """Read with version 1: the index that it does not know is skipped."""
    compact = typed_objects(spark, sf_dir).withColumn("payload", registry().compact(F.col("payload")))
    return compact.withColumn("payload", registry().expand(F.col("payload"), 1))


@query("select event_id, event_id % 4 <> 3 as valid from events")
def schema_validate(spark, sf_dir):
    odd = F.when(F.col("event_id") % 4 == 3, F.regexp_replace("payload", '"k"', '"unknown"')).when(F.col("event_id") % 4 == 1, registry().compact(F.col("payload"))).otherwise(F.col("payload"))
    return typed_objects(spark, sf_dir).select("event_id", registry().validate(odd).alias("valid"))


@query(f"select {ROW} from events order by ts desc limit 1000")
def retention_last_n(spark, sf_dir):
    return row(retention.keep_newest_rows(events(spark, sf_dir), 1000))


def sized_documents(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select((F.col("doc_id") + 1).alias("ts_ns"), F.octet_length("text").cast("long").alias("size"))


PACKED_SQL = """
sized as (select doc_id + 1 as ts_ns, octet_length(encode(text))::bigint as size, row_number() over (order by doc_id) as i from documents),
packed as (
  select ts_ns, i, size, case when size + 24 > 4072 then 1 + (size - 4048 + 4071) // 4072 else 1 end as span_count, 0::bigint as block_seq, 0::bigint as "offset",
    case when size + 24 > 4072 then 4072 else size + 24 end as used,
    case when size + 24 > 4072 then (size - 4048 + 4071) // 4072 else 0 end as block_end from sized where i = 1
  union all
  select s.ts_ns, s.i, s.size,
    case when s.size + 24 > 4072 then 1 + (s.size - 4048 + 4071) // 4072 else 1 end,
    case when s.size + 24 > 4072 or p.used + s.size + 24 > 4072 then p.block_end + 1 else p.block_end end,
    case when s.size + 24 > 4072 or p.used + s.size + 24 > 4072 then 0 else p.used end,
    case when s.size + 24 > 4072 then 4072 when p.used + s.size + 24 > 4072 then s.size + 24 else p.used + s.size + 24 end,
    case when s.size + 24 > 4072 then p.block_end + 1 + (s.size - 4048 + 4071) // 4072 when p.used + s.size + 24 > 4072 then p.block_end + 1 else p.block_end end
  from packed p join sized s on s.i = p.i + 1)
"""


@query(f"""with recursive {PACKED_SQL} select ts_ns, size, block_seq, "offset", span_count::bigint as span_count from packed""")
def packing_next_fit(spark, sf_dir):
    return retention.packed(sized_documents(spark, sf_dir), 4096)


@query(f"""with recursive {PACKED_SQL}, e as (select max(block_seq + span_count) as e from packed)
select ts_ns, size, block_seq, "offset", span_count::bigint as span_count from packed, e where block_seq >= e - 200""")
def retention_packed(spark, sf_dir):
    return retention.packed(sized_documents(spark, sf_dir), 4096, newest=200)


@query("""select doc_id, octet_length(encode(text))::bigint as size,
  (case when octet_length(encode(text)) <= 464 then 1 else 1 + (octet_length(encode(text)) - 464 + 487) // 488 end)::bigint as span_count from documents""")
def span_count(spark, sf_dir):
    sized = documents(spark, sf_dir).select("doc_id", F.octet_length("text").cast("long").alias("size"))
    return sized.withColumn("span_count", retention.span_count(F.col("size"), 512))


@query(f"""with recursive {PACKED_SQL}, t as (select block_seq as block_num, min(ts_ns) as first_ts, count(*) as records from packed group by 1)
select * from t where first_ts between 100 and 600""")
def blocks_in_range(spark, sf_dir):
    return retention.blocks_in_range(retention.block_table(retention.packed(sized_documents(spark, sf_dir), 4096)), 100, 600)


@query(f"""with recursive {PACKED_SQL} select ts_ns, size, block_seq from packed where block_seq = 20 order by ts_ns limit 1""")
def block_first_record(spark, sf_dir):
    found = retention.packed(sized_documents(spark, sf_dir), 4096)
    return retention.first_of_block(found, 20).select("ts_ns", "size", "block_seq")


@query("""
with blocks as (select event_id // 50 as block_num, min(epoch_ns(ts)) as first_ts from events group by 1),
probes as (select epoch_ns(o_orderdate) + 31104000000000000 * (o_orderkey % 13) as ts_ns from orders),
p as (select distinct ts_ns from probes)
select p.ts_ns, coalesce(a.block_num, (select arg_min(block_num, first_ts) from blocks)) as block_num,
  coalesce(a.first_ts, (select min(first_ts) from blocks)) as first_ts
from p asof left join blocks a on p.ts_ns >= a.first_ts""")
def asof_floor(spark, sf_dir):
    blocks = events(spark, sf_dir).groupBy(F.expr("event_id div 50").alias("block_num")).agg(F.min("ts_ns").alias("first_ts"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    probes = orders.select((to_ns("o_orderdate") + F.lit(31104000000000000) * (F.col("o_orderkey") % 13)).alias("ts_ns")).distinct()
    return running.floor_blocks(blocks, probes)


@query("""
with a as (select event_id as arrival, epoch_ns(ts) - case when event_id % 7 = 3 then 3600000000000 else 0 end as ts_ns from events),
m as (select *, max(ts_ns) over (order by arrival rows between unbounded preceding and 1 preceding) as seen from a)
select arrival, ts_ns, ts_ns > 0 and ts_ns > coalesce(seen, 0) as accepted from m""")
def ordering_guard(spark, sf_dir):
    late = F.when(F.col("event_id") % 7 == 3, F.lit(HOUR)).otherwise(F.lit(0))
    arrivals = events(spark, sf_dir).select(F.col("event_id").alias("arrival"), (F.col("ts_ns") - late).alias("ts_ns"))
    return running.ordering_guard(arrivals, part_rows=1000)


@query(f"select {ROW} from events where event_id % 10 <> 4")
def delete_tombstone(spark, sf_dir):
    """Tombstones name one record each; another one of the same time stays."""
    df = events(spark, sf_dir)
    return row(df.join(df.where("event_id % 10 = 4").select("ts_ns", "event_id"), ["ts_ns", "event_id"], "left_anti"))


@query("""select 'events' as store, count(*) as records, sum(octet_length(encode(props)))::bigint as bytes, min(epoch_ns(ts)) as oldest_ns, max(epoch_ns(ts)) as newest_ns,
  strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') as oldest, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') as newest from events""")
def stats(spark, sf_dir):
    return describe(events(spark, sf_dir), "events", "props")


STATUS_SQL = " union all ".join(
    f"select '{t}' as store, count(*) as records, sum(octet_length(encode({p})))::bigint as bytes, min(epoch_ns({ts})) as oldest_ns, max(epoch_ns({ts})) as newest_ns from {t}"
    for t, p, ts in (("events", "props", "ts"), ("lineitem", "l_returnflag", "l_shipdate"), ("orders", "o_orderstatus", "o_orderdate")))


@query(f"""select *, (1024 * 4072)::bigint as capacity_bytes, least(round((bytes + 24 * records) * 100.0 / (1024 * 4072), 2), 100.0) as used_percent from ({STATUS_SQL})""")
def status_report(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("ts_ns", to_ns("o_orderdate"))
    frames = (("events", events(spark, sf_dir), "props"), ("lineitem", lineitems(spark, sf_dir), "l_returnflag"), ("orders", orders, "o_orderstatus"))
    parts = [usage(describe(df, name, payload), 1024, 4096).drop("oldest", "newest") for name, df, payload in frames]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select doc_id, to_base64(encode(text)) as data, octet_length(encode(text))::bigint as size from documents")
def render_base64(spark, sf_dir):
    payload = F.encode("text", "UTF-8")
    return documents(spark, sf_dir).select("doc_id", output.rendered(payload, "binary").alias("data"), output.payload_size(payload).alias("size"))


@query("""select event_id, '{"type":"data","timestamp":' || epoch_ns(ts) || ',"data":"' || event_type || '"}' as message from events""")
def render_envelope(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", output.data_envelope(F.col("ts_ns"), F.col("event_type")).alias("message"))


@query("""select epoch_ns(ts) as timestamp, octet_length(encode(props))::bigint as size from events order by 1 limit 100""")
def render_without_data(spark, sf_dir):
    rows = events(spark, sf_dir).select("ts", "ts_ns", F.col("props").alias("payload"))
    return output.response(scans.first_rows(rows, scans.RANGE_LIMIT), False)


@query("""select epoch_ns(ts) as timestamp, octet_length(encode(props))::bigint as size, props as data from events order by 1 limit 10""")
def render_with_data(spark, sf_dir):
    rows = events(spark, sf_dir).select("ts", "ts_ns", F.col("props").alias("payload"))
    return output.response(scans.oldest(rows), True)


@query("select epoch_ns(ts) as timestamp, octet_length(encode(props))::bigint as size from events")
def render_all_without_data(spark, sf_dir):
    return output.response(events(spark, sf_dir).select("ts", "ts_ns", F.col("props").alias("payload")), False)


@query("select epoch_ns(ts) as timestamp, octet_length(encode(props))::bigint as size, props as data from events")
def render_all_with_data(spark, sf_dir):
    return output.response(events(spark, sf_dir).select("ts", "ts_ns", F.col("props").alias("payload")), True)


@query("""with a as (select 'high' as rule_name, epoch_ns(ts) as t, event_id from events where value > 300)
select '{"type":"alert","timestamp":' || t || ',"alert":{"rule_name":"high","condition":"value > 300","timestamp":' || t || ',"data":"' || event_id || '","store_name":"events"}}' as message from a""")
def render_alert(spark, sf_dir):
    df = events(spark, sf_dir)
    return output.alert_envelope(alerts(df, [Rule("high", "value > 300")], F.col("event_id").cast("string"), "events")).select("message")


@query("""
with e as (select (epoch_ns(ts) // 86400000000000 + 1) * 86400000000000 as window_end, * from events), m as (select max(window_end) as w from e)
select window_end, count(*) as record_count, window_end = any_value(w) as partial, arg_max(event_type, ts) as "1", max(user_id)::double as "2" from e, m group by window_end""")
def render_compact_aggregates(spark, sf_dir):
    out = aggregate(events(spark, sf_dir), AggSpec.parse("1d", "user_id:max"), ["event_type", "user_id"])
    return output.compact_aggregates(out, registry())[1]


@query("select doc_id, sha256(source) as key_hash from documents")
def key_hash(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", output.key_hash(F.col("source")).alias("key_hash"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as at from events")
def time_rfc3339(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", rfc3339("ts_ns").alias("at"))


@query("""select event_id, case when value = floor(value) then cast(cast(value as bigint) as varchar) else cast(value as varchar) end as shown from events""")
def number_as_text(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", number_text(F.col("value")).alias("shown"))


@query("""
select p_partkey, p_size, (1024 * 4096 + 1024 * 16 + 64)::bigint as footprint, (4072 // (p_size * 100 + 24))::bigint as records_per_block,
  (case when p_size * 100 <= 4048 then 1 else 1 + (p_size * 100 - 4048 + 4071) // 4072 end)::bigint as blocks_per_record from part""")
def capacity_calculator(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    return retention.capacity_plan(parts, 1024, F.lit(4096), F.col("p_size") * 100)


@query("""select doc_id, case when n >= 1048576 then printf('%.2f MB', n / 1048576.0) when n >= 1024 then printf('%.2f KB', n / 1024.0) else n || ' B' end as shown
from (select doc_id, octet_length(encode(text)) * 100 as n from documents)""")
def bytes_as_text(spark, sf_dir):
    n = F.octet_length("text") * 100
    return documents(spark, sf_dir).select("doc_id", retention.bytes_text(n).alias("shown"))


@query("""select epoch_ns(ts) as ts_ns, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as time, 'host' as host, null::varchar as unit,
  case when event_id % 3 = 0 then event_type else 'comm' end as ident, props as msg, (user_id)::int as pri, 0 as pid from events""")
def journal_transform(spark, sf_dir):
    micros = F.unix_micros(F.col("ts").cast("timestamp")).cast("string")
    ident = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.lit(""))
    raw = events(spark, sf_dir).select(
        micros.alias("__REALTIME_TIMESTAMP"), F.lit("host").alias("_HOSTNAME"), F.lit("").alias("_SYSTEMD_UNIT"), ident.alias("SYSLOG_IDENTIFIER"),
        F.lit("comm").alias("_COMM"), F.col("props").alias("MESSAGE"), F.col("user_id").cast("string").alias("PRIORITY"), F.lit("no number").alias("_PID"),
    )
    return journal_records(raw)


@query("""select event_id, epoch_ns(ts) as ts_ns, counter, round(coalesce(greatest((counter - lag(counter) over (order by ts)) / ((epoch_ns(ts) - lag(epoch_ns(ts)) over (order by ts)) / 1e9), 0), 0), 6) as counter_per_sec
from (select *, user_id * 1000 as counter from events)""")
def counter_rates(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "ts_ns", (F.col("user_id") * 1000).alias("counter"))
    return rounded(rates(rows, ["counter"], ties=["event_id"]), "counter_per_sec")


@query(f"""
with e as (select (epoch_ns(ts) // {DAY} + 1) * {DAY} as window_end, value, event_type, ts from events)
select window_end, count(*) as record_count, false as partial, round(avg(value), 6) as value, arg_max(event_type, ts) as event_type from e
where window_end < (select max(window_end) from e) group by window_end""")
def stream_closed_windows(spark, sf_dir):
    """A stream over the table, run to its end: every closed window once, the open one not."""
    path = scratch_folder(spark, "stream")
    source = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(source).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts_ns", to_ns("ts"))
    out = closed_windows(stream, AggSpec.parse("1d", "value:avg"), ["value", "event_type"])
    push(out, parquet_sink(f"{path}/out"), f"{path}/checkpoint", None).awaitTermination()
    return rounded(spark.read.schema(out.schema).parquet(f"{path}/out/*"), "value")


@query(f"""
with e as (select (epoch_ns(ts) // {DAY} + 1) * {DAY} as window_end, value, event_type, user_id, ts from events)
select window_end, count(*) as record_count, false as partial, round(avg(value), 6) as value_avg, max(user_id)::double as user_id, arg_max(event_type, ts) as event_type from e
where window_end < (select max(window_end) from e) group by window_end""")
def stream_record_windows(spark, sf_dir):
    """All fields of JSON records in one stateful pass, as a connection sends them; the open window stays."""
    path, spec = scratch_folder(spark, "stream"), AggSpec.parse("1d", "value:avg,user_id:max", "last")
    source = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(source).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts_ns", to_ns("ts"))
    payload = F.to_json(F.struct(F.col("value"), "user_id", "event_type"))
    out = record_windows(stream.select("ts_ns", payload.alias("payload")), spec)
    push(out, parquet_sink(f"{path}/out"), f"{path}/checkpoint", None).awaitTermination()
    data = F.from_json("data", "value double, user_id double, event_type string")
    rows = spark.read.schema(out.schema).parquet(f"{path}/out/*").withColumn("d", data)
    return rows.select("window_end", "record_count", "partial", F.round("d.value", 6).alias("value_avg"), "d.user_id", "d.event_type")


@query("""select '{"type":"data","timestamp":' || epoch_ns(ts) || ',"data":{"event_type":"' || event_type || '","user_id":' || user_id || '}}' as message
from events where contains('"1":"' || event_type, '"1":"c')""")
def stream_schema_messages(spark, sf_dir):
    """Compact records filtered as they are stored, sent out with their names."""
    path, source = scratch_folder(spark, "stream"), spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(source).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts_ns", to_ns("ts"))
    compact = registry().compact(F.to_json(F.struct("event_type", "user_id")))
    out = data_messages(stream.select("ts_ns", compact.alias("payload")), '"1":"c', registry=registry())
    push(out, parquet_sink(f"{path}/out"), f"{path}/checkpoint", None).awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out/*").select("message")


@query("select event_id, event_type, value from events where event_id % 5 <> 0 and value > 50")
def rule_not_a_number(spark, sf_dir):
    """Nothing compares to a NaN, though Spark sorts it above all."""
    df = events(spark, sf_dir).withColumn("v", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return df.where(Condition.parse("v > 50").typed(df)).select("event_id", "event_type", "value")


@query("select event_id, event_type, value from events where event_id % 7 not in (0, 1)")
def rule_infinite_literal(spark, sf_dir):
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("inf"))).when(F.col("event_id") % 7 == 1, F.lit(float("nan"))).otherwise(F.col("value"))
    df = events(spark, sf_dir).withColumn("v", v)
    return df.where(Condition.parse("v != +Inf and v > -infinity AND event_id != NaN").typed(df)).select("event_id", "event_type", "value")


@query("""select l_orderkey, l_linenumber, regexp_replace(cast(l_extendedprice / (l_quantity + l_linenumber * 1.7e0) as varchar), '\\.0$', '') as shown from lineitem""")
def number_as_text_long(spark, sf_dir):
    """Quotients need all their seventeen digits."""
    quotient = F.col("l_extendedprice").cast("double") / (F.col("l_quantity").cast("double") + F.col("l_linenumber") * F.lit(1.7))
    return lineitems(spark, sf_dir).select("l_orderkey", "l_linenumber", number_text(quotient).alias("shown"))


@query(windowed("max(value) as field_partial, min(user_id)::double as field_record_count", DAY))
def agg_reserved_names(spark, sf_dir):
    df = events(spark, sf_dir).select("ts_ns", F.col("value").alias("partial"), F.col("user_id").alias("record_count"))
    return aggregate(df, AggSpec.parse("1d", "partial:max,record_count:min"), ["partial", "record_count"])


@query("""
with s as (select epoch_ns(ts) as ts_ns, event_id * 100 as t, event_id * 37 + user_id % 30 as i, event_id * 4096 as r, event_id * 512 + user_id as w, 8000000 as mt, 1000 * user_id as ma from events),
p as (select *, lag(ts_ns) over (order by ts_ns) as q, t - lag(t) over (order by ts_ns) as dt, i - lag(i) over (order by ts_ns) as di, r - lag(r) over (order by ts_ns) as dr, w - lag(w) over (order by ts_ns) as dw from s)
select ts_ns, ((dt - di) * 100 // dt)::int as "cpu.pct", mt::bigint as "memory.total", (mt - ma)::bigint as "memory.used", ma::bigint as "memory.available", ((mt - ma) * 100 // mt)::int as "memory.pct",
  (dr // greatest(1, (ts_ns - q) // 1000000000))::bigint as "disk_io.read_bytes_sec", (dw // greatest(1, (ts_ns - q) // 1000000000))::bigint as "disk_io.write_bytes_sec",
  (dr // greatest(1, (ts_ns - q) // 1000000000))::bigint as "network.rx_bytes_sec", (dr // greatest(1, (ts_ns - q) // 1000000000))::bigint as "network.tx_bytes_sec",
  0::bigint as "disk_space.total", 0::bigint as "disk_space.used", 0::bigint as "disk_space.available", 0 as "disk_space.pct" from p where q is not null""")
def system_stats_records(spark, sf_dir):
    e = F.col("event_id")
    raw = events(spark, sf_dir).select(
        "ts_ns", (e * 100).alias("cpu_total"), (e * 37 + F.col("user_id") % 30).alias("cpu_idle"), F.lit(8_000_000).cast("long").alias("memory_total"),
        (F.col("user_id") * 1000).cast("long").alias("memory_available"), (e * 4096).alias("disk_read"), (e * 512 + F.col("user_id")).alias("disk_write"),
        (e * 4096).alias("network_rx"), (e * 4096).alias("network_tx"), F.lit(0).cast("long").alias("space_total"), F.lit(0).cast("long").alias("space_available"),
    )
    return system_stats(raw)


STORE_SQL = f"""with recursive {PACKED_SQL}, e as (select max(block_seq + span_count) as e from packed),
held as (select ts_ns, size, (block_seq % {{n}})::bigint as block_num, block_seq::bigint as block_seq, "offset", span_count::bigint as span_count from packed, e where block_seq >= e - {{n}})"""


#: Blocks of a ring that keeps all records of any table; it takes no space before records come.
ROOM = 1 << 40


def document_store(spark: SparkSession, sf_dir: str, blocks: int) -> Store:
    """A text store of all documents, keyed by doc_id + 1; of so many blocks, it holds the newest."""
    store = Engine(spark, scratch_folder(spark, "store")).create(Config("documents", blocks, kind="text"))
    store.append(documents(spark, sf_dir).select((F.col("doc_id") + 1).alias("ts_ns"), F.col("text").alias("payload")))
    return store


def placed(records: DataFrame) -> DataFrame:
    return records.select("ts_ns", output.payload_size(F.col("payload")).alias("size"), "block_num", "block_seq", "offset", "span_count")


@query(STORE_SQL.format(n=50) + " select * from held")
def store_capacity(spark, sf_dir):
    """What a full store still holds, read by a range of blocks."""
    return placed(document_store(spark, sf_dir, 50).records())


def some_handle(store: Store) -> Handle:
    """Of the fifth-newest record."""
    r = placed(store.newest(5)).orderBy("ts_ns").first()
    return Handle(r.ts_ns, r.block_seq, r.offset, r["size"], r.span_count)


FIFTH = "(select min(ts_ns) from (select ts_ns from held order by ts_ns desc limit 5))"


@query(STORE_SQL.format(n=50) + f" select * from held where ts_ns = {FIFTH}")
def store_get_by_handle(spark, sf_dir):
    store = document_store(spark, sf_dir, 50)
    return placed(store.get(some_handle(store)))


@query(STORE_SQL.format(n=50) + " select * from held where block_num = 7 order by ts_ns limit 1")
def store_get_by_block(spark, sf_dir):
    return placed(document_store(spark, sf_dir, 50).of_block(7))


BLOCKS_SQL = ", blocks as (select block_num, block_seq, min(ts_ns) as first_ts, count(*) as records from held group by 1, 2)"


@query(STORE_SQL.format(n=50) + BLOCKS_SQL + " select * from blocks")
def store_blocks(spark, sf_dir):
    return document_store(spark, sf_dir, 50).blocks()


@query(STORE_SQL.format(n=50) + BLOCKS_SQL + f" select * from blocks where first_ts = (select max(first_ts) from blocks where first_ts <= {FIFTH})")
def store_exact_block(spark, sf_dir):
    """The block that holds the fifth-newest record, by the floor of its key and again by its first key."""
    store = document_store(spark, sf_dir, 50)
    return store.exact_block(store.floor_block(some_handle(store).ts_ns).first().first_ts)


@query(STORE_SQL.format(n=50) + f" select * from held where ts_ns <> {FIFTH}")
def store_delete_by_handle(spark, sf_dir):
    store = document_store(spark, sf_dir, 50)
    store.delete_handle(some_handle(store))
    return placed(store.records())


@query("select doc_id + 1 as ts_ns, case when doc_id = 7 then 'again' else text end as payload from documents")
def store_reinsert(spark, sf_dir):
    """A key that was deleted comes again, after a compaction too."""
    store = document_store(spark, sf_dir, ROOM)
    store.delete(8)
    store.compact()
    store.insert("once more", 8)
    store.delete(8)
    store.insert("again", 8)
    return store.records().select("ts_ns", "payload")


@query("""
with m as (select event_id as arrival, case when event_id % 9 = 4 then 1 else epoch_ns(ts) end as t, event_id % 11 = 3 as broken from events),
s as (select *, max(case when not broken then t end) over (order by arrival rows between unbounded preceding and 1 preceding) as seen from m)
select arrival, case when broken then null when t <= coalesce(seen, 0) then null else t end as stored from s""")
def store_messages(spark, sf_dir):
    """Envelope lines taken or refused one by one: broken ones, and those that go back in time."""
    at = F.when(F.col("event_id") % 9 == 4, F.lit(1)).otherwise(F.col("ts_ns"))
    line = F.when(F.col("event_id") % 11 == 3, F.lit("broken")).otherwise(F.format_string('{"timestamp":%d,"data":{"v":1}}', at))
    store = Engine(spark, scratch_folder(spark, "store")).create(Config("messages", ROOM))
    done = store.append_messages(events(spark, sf_dir).select(F.col("event_id").alias("n"), line.alias("value")), arrival="n")
    return done.join(store.records().select(F.col("ts_ns").alias("stored")), (F.col("ts_ns") == F.col("stored")) & F.col("error").isNull(), "left").select("arrival", "stored")
