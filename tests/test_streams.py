"""Streams run to their end: closed windows, flushes, cooldown, connections, a pull source."""

import http.server
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.operators.aggregate import AggSpec, aggregate_json
from tidemark.operators.rules import Rule, alerts, fires
from tidemark.operators.schema import Field
from tidemark.sources.envelope_source import EnvelopeSource
from tidemark.sources.store import Config, Engine
from tidemark.streaming import push as p
from tidemark.streaming.push import Connections
from tidemark.streaming.windows import closed_windows, record_windows, stream_cooldown

M = 60 * 10**9


def stored(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, "ts_ns long, payload string").coalesce(1).write.mode("append").parquet(path)
    return p.stored_stream(spark, path, "ts_ns long, payload string")


def finish(df, path, mode="append"):
    p.push(df, p.parquet_sink(f"{path}/out"), f"{path}/cp", None, mode).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out/*").collect()


def test_closed_windows(spark, tmp_path):
    rows = [(1, 10.0), (2, 20.0), (M + 1, 100.0), (2 * M + 5, 1.0)]
    spark.createDataFrame(rows, "ts_ns long, val double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts_ns long, val double").parquet(str(tmp_path / "in"))
    got = finish(closed_windows(stream, AggSpec.parse("1m", "val:avg+sum"), ["val"]), tmp_path)
    assert sorted((r.window_end, r.record_count, r.partial, r.val_avg, r.val_sum) for r in got) == [(M, 2, False, 15.0, 30.0), (2 * M, 1, False, 100.0, 100.0)]
    with pytest.raises(ValueError):
        closed_windows(stream, AggSpec(1500), ["val"])


def collected(rows):
    """A sink that keeps what it gets, by batch."""
    return lambda batch, number: rows.extend(batch.collect())


def until(test, seconds=60):
    for _ in range(int(seconds / 0.2)):
        if test():
            return
        threading.Event().wait(0.2)
    raise AssertionError("it did not come")


def test_flushes_emit_only_what_came_since(spark, tmp_path):
    """Several idle flushes give no row; a window that goes on after a flush comes again with the rest alone."""
    path, rows = str(tmp_path / "in"), []
    spark.createDataFrame([(1, '{"v":10}'), (2, '{"v":20,"s":"x"}'), (M + 1, '{"v":100}'), (M + 2, "[1]"), (M + 3, "null")], "ts_ns long, payload string").coalesce(1).write.parquet(path)
    stream = p.stored_stream(spark, path, "ts_ns long, payload string")
    spec = AggSpec.parse("1m", "v:sum+avg+count")
    query = p.push(record_windows(stream, spec, "300ms", store="st"), collected(rows), str(tmp_path / "cp"), "100 milliseconds")
    until(lambda: len(rows) == 2)
    threading.Event().wait(3)  # ten flushes long
    assert len(rows) == 2
    spark.createDataFrame([(M + 9, '{"v":1}')], "ts_ns long, payload string").write.mode("append").parquet(path)
    until(lambda: len(rows) == 3)
    threading.Event().wait(1)
    query.stop()
    got = [(r.store, r.window_end, r.record_count, r.partial, json.loads(r.data)) for r in rows]
    assert got == [
        ("st", M, 2, False, {"v_sum": 30.0, "v_avg": 15.0, "v_count": 2, "s": "x"}),
        ("st", 2 * M, 2, True, {"v_sum": None, "v_avg": 100.0, "v_count": 1}),
        ("st", 2 * M, 1, True, {"v_sum": None, "v_avg": 1.0, "v_count": 1}),
    ]


def test_open_windows_equal_the_batch(spark, tmp_path):
    rng = random.Random(3)
    records = [(t, {k: rng.choice([1, 2.5, "x", None, True]) for k in rng.sample("abcd", 2)}) for t in sorted(rng.sample(range(1, 30 * M), 200))]
    rows = [(t, json.dumps(r)) for t, r in records]
    spec = AggSpec.parse("2m", "a:count+last", "avg,max")
    want = {(r.window_end, r.name): r.number if r.value is None else json.loads(r.value) for r in aggregate_json(spark.createDataFrame(rows, "ts_ns long, payload string"), spec).where("not partial").collect()}
    stream = stored(spark, str(tmp_path / "in"), [rows[:120], rows[120:]])
    got = {(r.window_end, k): v for r in finish(record_windows(stream, spec), tmp_path) for k, v in json.loads(r.data).items()}
    assert got.keys() == want.keys() and all(got[k] == v or got[k] == pytest.approx(v) for k, v in want.items())


def test_stream_cooldown_equals_batch(spark, tmp_path):
    times = [1, 2, 7, 8, 13, 20, 21, 26]
    stream = stored(spark, str(tmp_path / "in"), [[(t, '{"v":1}') for t in times[:3]], [(t, '{"v":1}') for t in times[3:]]])
    got = finish(stream_cooldown(alerts(stream, [Rule("r", "v == 1", 5)], F.col("payload"), json="payload")), tmp_path)
    assert sorted(r.ts_ns for r in got) == [t for t, f in zip(times, fires(times, 5), strict=True) if f]


def test_cursor_and_filter(spark, tmp_path):
    stored(spark, str(tmp_path / "in"), [[(1, "abc"), (2, "xyz"), (3, "abd")]])
    stream = p.stored_stream(spark, str(tmp_path / "in"), "ts_ns long, payload string", from_ns=1, files=1)
    got = finish(p.data_messages(stream, "AB", True), tmp_path)
    assert [json.loads(r.message) for r in got] == [{"type": "data", "timestamp": 3, "data": "abd"}]


class Remote(http.server.BaseHTTPRequestHandler):
    posts: list = []
    failures = 1
    asked: list = []
    ranges = True
    lines = b""

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"]))
        fail = Remote.failures > 0
        Remote.failures -= 1
        if not fail:
            Remote.posts.append((self.path, json.loads(body)))
        self.send_response(500 if fail else 204)
        self.end_headers()

    def do_GET(self):
        a, z = (int(x) for x in self.headers["Range"].removeprefix("bytes=").split("-"))
        body = Remote.lines[a : z + 1]
        Remote.asked.append(len(body))
        self.send_response((206 if body else 416) if Remote.ranges else 200)
        if Remote.ranges:
            self.send_header("Content-Range", f"bytes {a}-{z}/{len(Remote.lines)}")
        self.end_headers()
        self.wfile.write(body if Remote.ranges else Remote.lines)

    def log_message(self, *_):
        pass


@pytest.fixture
def remote():
    Remote.posts, Remote.asked, Remote.failures, Remote.ranges = [], [], 1, True
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Remote)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def opened(spark, tmp_path, name="s", **kind):
    return Engine(spark, str(tmp_path / "stores")).create(Config(name, **kind))


def run(connections, name, **how):
    for q in connections.start(name, every=None, **how):
        q.awaitTermination()


def test_connections_post_data_and_alerts(spark, tmp_path, remote):
    store = opened(spark, tmp_path, kind="schema")
    store.set_schema([Field(1, "v", "float64"), Field(2, "name", "string")])
    store.append(spark.createDataFrame([(1, '{"v":1,"name":"a"}'), (2, '{"v":90}'), (3, '{"v":95}')], "ts_ns long, payload string"))
    connections = Connections(store)
    rule = {"name": "high", "condition": "v > 80", "cooldown": "5m", "webhook": f"{remote}hook"}
    connections.create(p.Connection("c", f"{remote}in", rules=[rule]))
    with pytest.raises(FileExistsError):
        connections.create(p.Connection("c", remote))
    run(connections, "c", sink=p.post_json(f"{remote}in", wait=0.01))
    data = sorted((m["timestamp"], m["data"]["v"]) for at, m in Remote.posts if at == "/in" and m["type"] == "data")
    assert data == [(1, 1), (2, 90), (3, 95)]
    alarms = [m["alert"] for at, m in Remote.posts if at == "/in" and m["type"] == "alert"]
    assert [(a["timestamp"], a["rule_name"], a["data"], a["store_name"]) for a in alarms] == [(2, "high", {"v": 90}, "s")]
    assert [m["condition"] for at, m in Remote.posts if at == "/hook"] == ["v > 80"]
    status = connections.status("c")
    assert (status["status"], status["messages_sent"], status["alerts_fired"], status["last_timestamp"], status["rules_count"], status["last_error"]) == ("disconnected", 3, 1, 3, 1, None)
    store.append(spark.createDataFrame([(4, '{"v":2}')], "ts_ns long, payload string"))
    again = Connections(store)
    run(again, "c", sink=p.post_json(f"{remote}in", wait=0.01))
    assert sum(m.get("type") == "data" for _, m in Remote.posts) == 4 and again.kept["c"].rules[0]["name"] == "high"
    again.delete("c")
    assert not Connections(store).kept
    for bad in ({"mode": "both"}, {"format": "x"}, {"agg_window": "0s"}, {"rules": [{"name": "r", "condition": "v"}]}):
        with pytest.raises(ValueError):
            p.Connection("d", remote, **bad)


@pytest.mark.parametrize(("how", "want"), [
    ({"format": "compact"}, {"type": "data", "timestamp": 7, "data": {"1": 5}}), ({"envelope": "timestamp"}, {"timestamp": 7, "data": {"v": 5}}),
    ({"envelope": "none"}, {"v": 5}), ({"text": '"1"'}, {"type": "data", "timestamp": 7, "data": {"v": 5}}),
])
def test_formats_of_messages(spark, tmp_path, how, want):
    store, rows = opened(spark, tmp_path, kind="schema"), []
    store.set_schema([Field(1, "v", "float64"), Field(2, "w", "float64")])
    store.append(spark.createDataFrame([(7, '{"v":5}'), (8, '{"w":6}')], "ts_ns long, payload string"))
    connections = Connections(store)
    connections.create(p.Connection("c", "http://nowhere", **how))
    run(connections, "c", sink=collected(rows))
    assert json.loads(rows[0].message) == want and len(rows) == (1 if "text" in how else 2)


def test_windows_of_a_connection_are_flushed_at_its_stop(spark, tmp_path):
    store, rows = opened(spark, tmp_path), []
    store.append(spark.createDataFrame([(1, '{"v":1}'), (2, '{"v":3}'), (M + 1, '{"v":8}')], "ts_ns long, payload string"))
    connections = Connections(store)
    connections.create(p.Connection("w", "http://nowhere", agg_window="1m", agg_default="avg,sum"))
    connections.start("w", collected(rows), flush="1h")
    until(lambda: len(rows) == 1)
    connections.stop("w")
    got = [json.loads(r.message) for r in rows]
    assert got == [{"type": "data", "timestamp": M, "data": {"v_avg": 2.0, "v_sum": 4.0}}, {"type": "data", "timestamp": 2 * M, "data": {"v_avg": 8.0, "v_sum": None}}]
    store.append(spark.createDataFrame([(M + 5, '{"v":2}'), (2 * M + 1, '{"v":0}')], "ts_ns long, payload string"))
    later = Connections(store)  # what was flushed does not come again
    later.start("w", collected(rows), flush="1h")
    until(lambda: len(rows) == 3)
    later.stop("w")
    assert [json.loads(r.message)["data"]["v_sum"] for r in rows[2:]] == [2.0, None]


def test_pull_connection_writes_to_its_store(spark, tmp_path, remote):
    Remote.lines = b"\n".join([b'{"timestamp":5,"data":{"a":1}}', b"broken", b'{"timestamp":6,"data":2}', b'{"timestamp":2,"data":3}', b'{"timestamp":7,"da'])
    store = opened(spark, tmp_path)
    connections = Connections(store)
    connections.create(p.Connection("pull", remote, mode="pull"))
    run(connections, "pull")
    assert sorted((r.ts_ns, r.payload) for r in store.records().collect()) == [(5, '{"a":1}'), (6, "2")]
    status = connections.status("pull")
    assert (status["messages_received"], status["errors"], status["last_timestamp"]) == (2, 2, 6) and status["last_error"]
    Remote.lines += b'ta":4}\n'
    connections.start_all(every=None)
    for q, *_ in connections.running["pull"]:
        q.awaitTermination()
    assert sorted(r.ts_ns for r in store.records().collect()) == [5, 6, 7]


def test_lines_of_a_socket_go_to_a_store(spark, tmp_path):
    """Keys go on from batch to batch; a broken line is refused by itself."""
    store, acks = opened(spark, tmp_path), []
    for k, lines in enumerate((['{"a":1}', "broken", "QUIT"], ['{"a":2}', "3"])):
        (tmp_path / "lines").mkdir(exist_ok=True)
        (tmp_path / "lines" / f"{k}.txt").write_text("\n".join(lines))
        stream = spark.readStream.text(str(tmp_path / "lines"))
        p.push(stream, p.store_sink(store, collected(acks), documents=True), str(tmp_path / "cp"), None).awaitTermination()
    rows = store.records().orderBy("ts_ns").collect()
    assert [r.payload for r in rows] == ['{"a":1}', '{"a":2}', "3"] and len({r.ts_ns for r in rows}) == 3
    assert sorted(str(r.error) for r in acks) == ["None", "None", "None", "invalid JSON"]


def test_failed_queries_are_started_again(spark, tmp_path):
    store, rows, calls = opened(spark, tmp_path), [], []
    store.put({"v": 1}, 5)

    def weak(batch, number):
        calls.append(number)
        if len(calls) < 3:
            raise OSError("remote is away")
        rows.extend(batch.collect())

    connections = Connections(store)
    connections.create(p.Connection("c", "http://nowhere"))
    connections.start("c", weak)
    stop = threading.Event()
    thread = connections.tend(stop, wait=0.1)
    until(lambda: rows)
    stop.set()
    thread.join()
    assert connections.status("c")["errors"] >= 2 and json.loads(rows[0].message)["timestamp"] == 5
    connections.stop("c")


@pytest.mark.parametrize("ranges", [True, False])
def test_pull_source(spark, tmp_path, remote, ranges):
    Remote.ranges = ranges
    Remote.lines = b"\n".join([b'{"timestamp":5,"data":{"a":1}}', b"broken", b'{"timestamp":6,"data":2}', b""] + [b'{"timestamp":%d,"data":"%s"}' % (k, b"x" * (k % 50)) for k in range(10, 400)] + [b""])
    spark.dataSource.register(EnvelopeSource)
    stream = spark.readStream.format("envelopes").option("url", remote).option("bytesPerPartition", "1000").load()
    got = sorted((r.ts_ns, r.payload) for r in finish(stream, tmp_path))
    assert got == [(5, '{"a": 1}'), (6, "2")] + [(k, json.dumps("x" * (k % 50))) for k in range(10, 400)]
    if ranges:
        assert max(Remote.asked) <= 1 << 16
