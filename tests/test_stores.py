"""Stores, scans, schemas, retention, rendering, ingest."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import output, retention, running, scans
from tidemark.operators.schema import Field, SchemaRegistry
from tidemark.sources.lines import envelopes, journal_records, line_documents, rates, system_stats
from tidemark.sources.store import Config, Engine, Store

S = 10**9


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "stores"))


def frame(spark, rows):
    return spark.createDataFrame(rows, "ts_ns long, payload string")


def test_life_of_a_store(spark, engine):
    store = engine.create(Config("a"))
    with pytest.raises(FileExistsError):
        engine.create(Config("a"))
    assert store.stats().first().records == 0 and store.newest_ns() is None and store.range(now_ns=9).count() == 0
    store.append(frame(spark, [(t, json.dumps({"i": t})) for t in range(1000, 5001, 1000)]))
    assert [r.ts_ns for r in store.range(start=2000, end=4000).collect()] == [2000, 3000, 4000]
    assert [r.ts_ns for r in store.oldest(3).collect()] == [1000, 2000, 3000] and [r.ts_ns for r in store.newest(3).collect()] == [5000, 4000, 3000]
    assert store.at(3000).first().payload == '{"i": 3000}' and store.at(3001).count() == 0
    for bad in ([(5000, "{}")], [(500, "{}")], [(6000, "{}"), (6000, "{}")], [(0, "{}")], [(7000, "{")]):
        with pytest.raises(ValueError):
            store.append(frame(spark, bad))
    store.put({"x": 1}, 6000)
    store.delete(3000)
    with pytest.raises(KeyError):
        store.delete(3000)
    assert [r.ts_ns for r in store.records().orderBy("ts_ns").collect()] == [1000, 2000, 4000, 5000, 6000]
    assert store.stats().first().oldest == "1970-01-01T00:00:00Z" and store.oldest_ns() == 1000
    assert [r.ts_ns for r in store.newest(9, text='"I"', ignore_case=True).collect()] == [5000, 4000, 2000, 1000]
    assert [r.ts_ns for r in store.newest(9, text='"I"').collect()] == []
    store.compact()
    assert store.records().count() == 5
    store.reset()
    store.put({"x": 2}, 500)
    assert [r.ts_ns for r in store.records().collect()] == [500]
    store.insert("{}", 400)
    for payload, key in (("{}", 400), ("{}", 0), ("x" * 4073, 900)):
        with pytest.raises(ValueError):
            store.insert(payload, key)
    store.delete(400)
    engine.create(Config("b", kind="text"))
    assert engine.names() == ["a", "b"] and {r.store: r.records for r in engine.status().collect()} == {"a": 1, "b": 0}
    engine.close()
    assert engine.open("a").records().count() == 1
    engine.delete("a")
    assert engine.names() == ["b"]
    with pytest.raises(FileNotFoundError):
        engine.open("a")


def test_places_of_a_store(spark, engine):
    store = engine.create(Config("p", num_blocks=10, block_size=512))
    handles = [store.put('"' + "x" * 398 + '"', k) for k in range(1, 4)]
    rows = store.append(frame(spark, [(k, '"' + "x" * 398 + '"') for k in range(4, 16)]))
    assert sorted(r.block_seq for r in rows.collect()) == list(range(3, 15)) and handles[1].block_seq == 1
    assert sorted(r.ts_ns for r in store.records().collect()) == list(range(6, 16))
    assert store.get(handles[1]).count() == 0 and store.oldest_ns() == 6
    assert {(r.ts_ns, r.block_num) for r in store.records().collect()} == {(k, (k - 1) % 10) for k in range(6, 16)}
    assert store.of_block(4).first().ts_ns == 15 and store.of_block(5).first().ts_ns == 6
    for n in (-1, 10):
        for look in (store.of_block, store.inspect):
            with pytest.raises(IndexError):
                look(n)
    assert store.exact_block(9).first().block_num == 8 and store.exact_block(99).count() == 0
    assert [store.floor_block(t).first().first_ts for t in (1, 6, 9, 99)] == [6, 6, 9, 15]
    assert sorted(r.first_ts for r in store.blocks_in_range(7, 9).collect()) == [7, 8, 9]
    with pytest.raises(ValueError):
        store.blocks_in_range(9, 7)
    big = store.put('"' + "x" * 1074 + '"', 20)
    assert (big.block_seq, big.span_count) == (15, 3) and [r.ts_ns for r in store.oldest(1).collect()] == [9]
    small = [store.put("{}", 21), store.put("{}", 22)]
    assert [(h.block_seq, h.offset) for h in small] == [(18, 0), (18, 26)] and store.get(small[1]).first().ts_ns == 22
    assert [(r.offset, r.ts_ns, r.size, r.first_ts, r.payload) for r in store.inspect(8).collect()] == [(0, 21, 2, 21, "{}"), (26, 22, 2, 21, "{}")]
    store.delete_handle(small[1])
    with pytest.raises(KeyError):
        store.delete_handle(small[1])
    assert [r.ts_ns for r in store.newest(2).collect()] == [21, 20]
    ring = store.stats().first()
    assert (ring.active_blocks, ring.head_block, ring.tail_block, ring.write_offset, ring.records) == (10, 8, 9, 52, 8)
    shown = output.response(store.records(), True).where("timestamp = 21").first()
    assert (shown.block_num, shown.size, shown.data) == (8, 2, "{}")
    row = engine.status().first()
    assert (row.records, row.connections, row.capacity_bytes) == (8, 0, 4880) and 0 < row.used_percent <= 100


def test_a_key_comes_again_after_its_delete(spark, engine):
    store = engine.create(Config("again"))
    store.put({"a": 1}, 100)
    store.delete(100)
    store.insert('{"a":2}', 100)
    assert [r.payload for r in store.at(100).collect()] == ['{"a":2}']
    store.delete(100)
    assert store.records().count() == 0


def test_writers_that_die_leave_the_store_as_it_was(spark, engine, monkeypatch):
    store = engine.create(Config("safe"))
    store.append(frame(spark, [(k, "{}") for k in range(1, 6)]))
    store.delete(3)
    want = sorted(r.ts_ns for r in store.records().collect())

    def dies(*_, **__):
        raise OSError("power cut")

    for work in (lambda: store.compact(), lambda: store.append(frame(spark, [(9, "{}")])), lambda: store.put("{}", 9), lambda: store.delete(2), lambda: store.reset()):
        monkeypatch.setattr(store, "commit", dies)
        with pytest.raises(OSError):
            work()
        monkeypatch.undo()
        engine.close()
        store = engine.open("safe")
        assert sorted(r.ts_ns for r in store.records().collect()) == want and store.recover() == []
    first, second = engine.open("safe"), Store(spark, store.path, store.config, store.registry)
    stale = second.state()
    first.put("{}", 50)
    with pytest.raises(Exception, match="exist"):
        second.commit(stale, records=[])
    assert store.at(50).count() == 1


def test_rows_are_computed_once(spark, engine):
    store = engine.create(Config("once"))
    random_rows = spark.range(1, 200, numPartitions=3).select(F.col("id").alias("ts_ns"), F.concat(F.lit('{"v":'), F.rand().cast("string"), F.lit("}")).alias("payload"))
    calls = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    store.append(random_rows.mapInArrow(count, random_rows.schema))
    assert calls.value == 199 == store.records().count()


def test_messages_are_taken_one_by_one(spark, engine):
    lines = ['{"timestamp":5,"data":{"a":1}}', "broken", '{"timestamp":4,"data":{}}', '{"data":{"b":2}}', '{"timestamp":6,"data":{}}', '{"timestamp":9000,"data":{}}', '{"data":{}}']
    store = engine.create(Config("m"))
    done = store.append_messages(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1), now_ns=1000).orderBy("arrival").collect()
    late = "keys must be larger than what is stored and before them"
    assert [(r.ts_ns, r.error) for r in done] == [(5, None), (1001, "invalid JSON"), (4, late), (1003, None), (6, late), (9000, None), (1006, late)]
    assert sorted((r.ts_ns, r.payload) for r in store.records().collect()) == [(5, '{"a":1}'), (1003, '{"b":2}'), (9000, "{}")]
    many = spark.range(0, 400, numPartitions=7).select(F.lit('{"data":{}}').alias("value"))
    assert store.append_messages(many, now_ns=20_000).where("error is null").count() == 400 and store.newest_ns() == 20_399
    schema = engine.create(Config("ms", kind="schema"))
    schema.set_schema([Field(1, "a", "int32")])
    done = schema.append_messages(spark.createDataFrame([('{"timestamp":1,"data":{"a":1}}',), ('{"timestamp":2,"data":{"z":1}}',)], "value string").coalesce(1))
    assert [r.error for r in done.orderBy("ts_ns").collect()] == [None, "a record has fields that the schema lacks"]
    assert schema.at(1).first().payload == '{"1":1}' and schema.get_schema()["version"] == 1
    schema.append_messages(spark.createDataFrame([('{"timestamp":3,"data":{"1":7}}',)], "value string"), compact=True)
    assert schema.at(3).first().payload == '{"1":7}'


def test_requests_are_dispatched_by_type(spark, engine):
    json_store, text = engine.create(Config("rj")), engine.create(Config("rt", kind="text"))
    assert json_store.post('{"timestamp":7,"data":{"a":1}}', "application/json; charset=utf-8").ts_ns == 7
    assert json_store.post(b'{"data":2}', "application/json", now_ns=9).ts_ns == 9 and text.post("a b", "text/plain", now_ns=5).size == 3
    for store, body, kind in ((json_store, "{}", "text/plain"), (json_store, "no", "application/json"), (json_store, '{"x":1}', "application/json"), (text, "x", "application/json")):
        with pytest.raises(ValueError):
            store.post(body, kind, now_ns=99)


def test_schema_store(spark, engine):
    store = engine.create(Config("s", kind="schema"))
    store.set_schema([Field(1, "temperature", "float32"), Field(2, "sensor", "string")])
    store.append(frame(spark, [(1, '{"temperature":72.5,"sensor":"x"}'), (2, '{"1":70.5}'), (3, '{"sensor":"y"}')]))
    assert store.at(1).first().payload == '{"1":72.5,"2":"x"}'
    with pytest.raises(ValueError):
        store.append(frame(spark, [(9, '{"unknown":1}')]))
    row = store.aggregate("1m", default="avg").first()
    assert (row.record_count, row.temperature, row.sensor) == (3, 71.5, "y")
    assert store.aggregate("1m", default="max", text="X", ignore_case=True).first().record_count == 1
    assert store.aggregate("1m", default="max", start=2, now_ns=9).first().record_count == 2
    header, rows = store.aggregate_compact("1m", default="max")
    assert header == {"1": "temperature", "2": "sensor"} and rows.first()["1"] == 72.5
    engine.close()
    assert engine.open("s").registry.fields()[1].name == "sensor"
    shown = output.response(engine.open("s").records(), True, "schema", store.registry).collect()
    assert {r.timestamp: r.data for r in shown}[2] == '{"temperature":70.5}'


@pytest.mark.parametrize("bad", [{"name": ""}, {"name": "a/b"}, {"name": "a", "num_blocks": 0}, {"name": "a", "block_size": 100}, {"name": "a", "block_size": 32}, {"name": "a", "kind": "x"}])
def test_configs(bad):
    with pytest.raises(ValueError):
        Config(**bad)


def test_range_rules(spark):
    df = frame(spark, [(i * S, str(i)) for i in range(1, 21)])
    assert scans.time_range(df, 5 * S, 15 * S).count() == 11
    assert [r.ts_ns for r in scans.time_range(df, since="3s", now_ns=10 * S, limit=2).collect()] == [7 * S, 8 * S]
    assert [r.ts_ns for r in scans.time_range(df, after=18 * S, now_ns=19 * S).collect()] == [19 * S]
    assert scans.time_range(df, start=1, since="1s", after=5, now_ns=20 * S).count() == 2
    assert [r.ts_ns for r in scans.newest(df, 2, since="5s", now_ns=10 * S).collect()] == [10 * S, 9 * S]
    with pytest.raises(ValueError):
        scans.time_range(df, 5, 4)
    assert [scans.limit_or(x, 10) for x in ("5", "0", "-1", "x", None, 7)] == [5, 10, 10, 10, 10, 7]


def test_time_ranges_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    from tidemark.functions.timeconv import between_ns, to_ns

    plan = between_ns(df.withColumn("ts_ns", to_ns("ts")), 1_704_100_000 * S, 1_704_200_000 * S)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan


@pytest.mark.parametrize(
    ("payload", "needle", "ignore", "want"),
    [('{"sensor": "temp-01"}', "temp-01", False, True), ('{"sensor": "temp-01"}', "TEMP-01", False, False), ('{"sensor": "temp-01"}', "TEMP-01", True, True),
     ('{"sensor": "temp-01"}', "", False, True), ('{"sensor": "temp-01"}', "humidity", False, False), ('{"building": "BUILDING A", "floor": 3}', "BUILDING", False, True),
     ('{"building": "BUILDING A", "floor": 3}', "building a", True, True), ("", "test", False, False), ("", "", False, True)],
)
def test_substring(spark, payload, needle, ignore, want):
    df = frame(spark, [(1, payload)])
    assert bool(scans.contains_text(df, needle, ignore).count()) == want
    assert bool(scans.contains_text(df.withColumn("payload", F.encode("payload", "UTF-8")), needle, ignore).count()) == want


def test_schemas(spark):
    reg = SchemaRegistry()
    base = [Field(1, "temperature", "float32"), Field(2, "humidity", "float32"), Field(3, "sensor_id", "string")]
    assert reg.add(base) == 1 and reg.add([*base, Field(4, "pressure", "float64")]) == 2
    for bad in ([], [Field(0, "a", "bool")], [*base, Field(3, "x", "bool")], [*base, Field(5, "humidity", "bool")], [Field(1, "renamed", "float32")], [Field(1, "a", "nope")], base):
        with pytest.raises(ValueError):
            reg.add(bad)
    full = '{"temperature":72.5,"humidity":45,"sensor_id":"living-room"}'
    df = spark.createDataFrame([(full,), ('{"1":72.5,"2":45,"3":"living-room"}',), ('{"humidity":1}',), ('{"nope":1}',), ('{"99":1}',), ("[1]",), (None,)], "p string")
    got = df.select(reg.compact(F.col("p")), reg.validate(F.col("p")), reg.expand(F.col("p"))).collect()
    assert [r[0] for r in got] == ['{"1":72.5,"2":45,"3":"living-room"}'] * 2 + ['{"2":1}', None, None, None, None]
    assert [r[1] for r in got] == [True, True, True, False, False, False, False]
    assert got[1][2] == full and got[4][2] == "{}" and got[0][2] is None
    assert SchemaRegistry.loads(reg.dumps()).fields(1) == base and reg.numeric()["sensor_id"] is False and reg.struct(1).names == ["temperature", "humidity", "sensor_id"]
    with pytest.raises(KeyError):
        reg.fields(3)


def next_fit(sizes, block):
    room, at, used, out = block - 24, -1, block - 24, []
    for n in sizes:
        if n + 24 > room:
            spans = 1
            rest = n - (block - 48)
            while rest > 0:
                spans, rest = spans + 1, rest - room
            out.append((at + 1, 0, spans))
            at, used = at + spans, room
        else:
            if used + n + 24 > room:
                at, used = at + 1, 0
            out.append((at, used, 1))
            used += n + 24
    return out


def test_packing_and_retention(spark):
    rng = random.Random(1)
    sizes = [rng.choice([0, 14, 122, 244, 464, 465, 1076, 3000]) for _ in range(400)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "ts_ns long, size long")
    got = retention.packed(df, 512).orderBy("ts_ns").collect()
    assert [(r.block_seq, r.offset, r.span_count) for r in got] == next_fit(sizes, 512)
    assert df.select(retention.span_count(F.lit(1076), 512)).first()[0] == 3
    kept = retention.keep_newest_blocks(retention.packed(df, 512), 10).collect()
    last = max(r.block_seq + r.span_count for r in got)
    assert {r.ts_ns for r in kept} == {r.ts_ns for r in got if r.block_seq >= last - 10}
    one_each = spark.createDataFrame([(i, 400) for i in range(15)], "ts_ns long, size long")
    assert sorted(r.ts_ns for r in retention.keep_newest_blocks(retention.packed(one_each, 512), 10).collect()) == list(range(5, 15))
    with pytest.raises(ValueError):
        retention.packed(df, 500)
    for rows, newest in ((60, 0), (60, 10), (1, 7), (1000, 10), (399, 400)):
        parts = retention.packed(df.withColumns({"offset": F.lit("x"), "block_seq": F.lit("y"), "part": F.lit("z")}), 512, newest=newest, part_rows=rows)
        want = [(i, *x) for i, x in enumerate(next_fit(sizes, 512)) if not newest or x[0] >= last - newest]
        assert [(r.ts_ns, r.block_seq, r.offset, r.span_count) for r in parts.orderBy("ts_ns").collect()] == want and parts.columns[:3] == ["ts_ns", "size", "part"]
    half = 200
    first = next_fit(sizes[:half], 512)[-1]
    need = sizes[half - 1] + 24
    state = (first[0] + first[2] - 1, 488 if need > 488 else first[1] + need)
    rest = retention.packed(df.where(F.col("ts_ns") >= half), 512, last=state, part_rows=50).orderBy("ts_ns").collect()
    assert [(r.block_seq, r.offset, r.span_count) for r in rest] == next_fit(sizes, 512)[half:]
    two = df.withColumn("s", F.col("ts_ns") % 2)
    for rows in (1000, 30):
        both = retention.packed(two, 512, store="s", part_rows=rows).orderBy("ts_ns").collect()
        for k in (0, 1):
            assert [(r.block_seq, r.offset, r.span_count) for r in both if r.s == k] == next_fit(sizes[k::2], 512)
    assert sorted((r.s, r.block_seq) for r in retention.packed(two, 512, store="s").collect())[0] == (0, 0)


def test_ordering_guard(spark):
    rng = random.Random(3)
    keys = [1000, 500, 1000, 2000, -5, 0] + [rng.randint(1, 5000) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(keys)), "arrival long, ts_ns long")
    for newest in (None, 1500):
        seen, want = newest or 0, {}
        for i, t in enumerate(keys):
            want[i] = t > 0 and t > seen
            seen = max(seen, t)
        got = {r.arrival: r.accepted for r in running.ordering_guard(df, newest_ns=newest, part_rows=7).collect()}
        assert got == want


def test_floor_blocks_in_parts(spark):
    rng = random.Random(5)
    firsts, asked = sorted(rng.sample(range(50, 5000), 60)), [rng.randint(1, 5200) for _ in range(150)]
    blocks = spark.createDataFrame([(i, t) for i, t in enumerate(firsts)], "block_num long, first_ts long")
    probes = spark.createDataFrame([(t,) for t in asked], "ts_ns long")
    want = sorted((t, max((i for i, f in enumerate(firsts) if f <= t), default=0)) for t in asked)
    for rows in (20, 10**6):
        assert sorted((r.ts_ns, r.block_num) for r in running.floor_blocks(blocks, probes, rows).collect()) == want
    assert running.floor_blocks(blocks.limit(0), probes).collect() == []


def test_rates_and_system_stats(spark):
    rng = random.Random(6)
    columns = ["cpu_total", "cpu_idle", "memory_total", "memory_available", "disk_read", "disk_write", "network_rx", "network_tx", "space_total", "space_available"]
    rows, at = [], [0] * 10
    for k in range(50):
        at = [a + rng.randint(0, 9000) for a in at]
        at[1] = at[0] // 2
        rows.append((k * 5 * S + 7, *at[:2], 8000, 3000, *at[4:8], 0 if k % 2 else 900, 0 if k % 2 else 300))
    df = spark.createDataFrame(rows, "ts_ns long, " + ", ".join(f"{c} long" for c in columns))
    for n in (7, 1000):
        got = system_stats(df, n).orderBy("ts_ns").collect()
        assert len(got) == 49 and len(got[0]) == 14
        for r, (before, now) in zip(got, zip(rows, rows[1:], strict=False), strict=True):
            total, idle = now[1] - before[1], now[2] - before[2]
            assert r["cpu.pct"] == ((total - idle) * 100 // total if total else 0) and r["memory.used"] == 5000 and r["memory.pct"] == 62
            assert r["disk_io.read_bytes_sec"] == (now[5] - before[5]) // 5 and r["disk_space.pct"] == (66 if now[9] else 0)
        per = {r.ts_ns: r.disk_read_per_sec for r in rates(df, ["disk_read"], n).collect()}
        assert per[7] == 0 and all(per[b[0]] == (b[5] - a[5]) / 5 for a, b in zip(rows, rows[1:], strict=False))


def test_ingest(spark):
    lines = spark.createDataFrame([('{"timestamp":5,"data":{"a":1}}',), ('{"data":[1]}',), ("oops",), ('{"timestamp":-1,"data":1}',), ('{"timestamp":3}',)], "value string")
    got = [(r.ts_ns, r.payload, r.error) for r in envelopes(lines, 99).collect()]
    assert got == [(5, '{"a":1}', None), (99, "[1]", None), (99, None, "invalid JSON"), (-1, "1", "invalid timestamp"), (3, None, "no data")]
    docs = line_documents(spark.createDataFrame([("{}",), ("QUIT",), ("x",), ("1",)], "value string"), 50).collect()
    assert len(docs) == 2 and len({r.ts_ns for r in docs}) == 2 and min(r.ts_ns for r in docs) >= 50
    columns = ["__REALTIME_TIMESTAMP", "_HOSTNAME", "_SYSTEMD_UNIT", "SYSLOG_IDENTIFIER", "_COMM", "MESSAGE", "PRIORITY", "_PID"]
    raw = spark.createDataFrame([("1704067200000001", "h", "", "", "sshd", "m", "6", "x"), ("bad", "h", "u", "i", "c", "m", "", None)], ", ".join(f"`{c}` string" for c in columns))
    rows = journal_records(raw).collect()
    assert (rows[0].ts_ns, rows[0].time, rows[0].ident, rows[0].unit, rows[0].pri, rows[0].pid) == (1_704_067_200_000_001_000, "2024-01-01T00:00:00Z", "sshd", None, 6, 0)
    assert (rows[1].ts_ns, rows[1].ident, rows[1].pri, rows[1].pid) == (0, "i", 0, 0)


def test_compact_aggregates(spark):
    reg = SchemaRegistry()
    reg.add([Field(1, "a", "int32"), Field(2, "b", "string")])
    header, df = output.compact_aggregates(spark.createDataFrame([(1, 2, 3)], "window_end long, a int, a_max int"), reg)
    assert header == {"1": "a"} and df.columns == ["window_end", "1", "a_max"]


def test_binary_is_base64_on_one_line(spark):
    df = spark.createDataFrame([(1, bytearray(b"x" * 300))], "ts_ns long, payload binary")
    assert "\n" not in output.response(df, True, "binary").first().data
