"""Continuous push and pull: records, windows and alerts to sinks, messages into stores, and the registry of such connections."""

from __future__ import annotations

import json
import threading
import time
import urllib.request
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.durations import parse_duration
from tidemark.operators.aggregate import AggSpec
from tidemark.operators.output import alert_envelope, record_envelope
from tidemark.operators.rules import Rule, alerts
from tidemark.operators.scans import contains_text
from tidemark.operators.schema import SchemaRegistry
from tidemark.sources.envelope_source import EnvelopeSource
from tidemark.sources.store import Store
from tidemark.streaming.windows import open_windows, record_windows, stream_cooldown

Sink = Callable[[DataFrame, int], None]


def stored_stream(spark: SparkSession, path: str, schema: str, from_ns: int = 0, files: int | None = None) -> DataFrame:
    """Records of a folder of Parquet files as they come, after from_ns; 0 starts at the oldest, -1 at the present."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    start = time.time_ns() if from_ns < 0 else from_ns
    rows = reader.parquet(path)
    return rows.where(F.col("ts_ns") > start) if start else rows


def expanded(payload: Column, registry: SchemaRegistry | None) -> Column:
    """Records of a schema store with their names; what does not expand, and other records, as they are."""
    return F.coalesce(registry.expand(payload), payload) if registry and registry.versions else payload


def data_messages(
    stream: DataFrame, text: str = "", ignore_case: bool = False, payload: str = "payload", registry: SchemaRegistry | None = None, kind: str | None = "data"
) -> DataFrame:
    """Envelopes of the records that hold the text (as they are stored); with a registry they are expanded."""
    found = contains_text(stream, text, ignore_case, payload)
    return found.select("ts_ns", record_envelope(F.col("ts_ns"), expanded(F.col(payload), registry), kind).alias("message"))


def window_messages(windows: DataFrame, kind: str | None = "data") -> DataFrame:
    return windows.select(F.col("window_end").alias("ts_ns"), record_envelope(F.col("window_end"), F.col("data"), kind).alias("message"))


def fired_alerts(stream: DataFrame, rules: list[Rule], store: str = "", payload: str = "payload") -> DataFrame:
    """Alerts on raw records, after cooldown."""
    return stream_cooldown(alerts(stream, rules, F.col(payload), store, json=payload))


def post_json(url: str, timeout: float = 10.0, attempts: int = 3, wait: float = 1.0, headers: dict[str, str] | None = None) -> Sink:
    """A sink that posts each message; other answers than 2xx are errors. It waits twice as long after each failure,
    a minute at most. A batch that fails in the end is sent again when the query is: at least once, never dropped."""

    def send(rows) -> None:
        for row in rows:
            pause = wait
            for attempt in range(attempts):
                try:
                    request = urllib.request.Request(url, row.message.encode(), {"Content-Type": "application/json", **(headers or {})})
                    with urllib.request.urlopen(request, timeout=timeout) as answer:
                        if 200 <= answer.status < 300:
                            break
                        raise OSError(f"status {answer.status}")
                except OSError:
                    if attempt == attempts - 1:
                        raise
                    time.sleep(pause)
                    pause = min(60.0, 2 * pause)

    return lambda batch, _: batch.select("message").foreachPartition(send)


def parquet_sink(path: str) -> Sink:
    """Each batch in a folder of its own number, so a batch that runs again replaces itself."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def store_sink(store: Store, acks: Sink | None = None, compact: bool = False, documents: bool = False) -> Sink:
    """Writes each batch of message lines (column value) to a store; what became of each message goes to `acks`.

    Messages that are refused do not stop the others. With `documents` a line is the record itself, at its present.
    """

    def write(batch: DataFrame, number: int) -> None:
        lines = batch.select("value")
        done = store.append_lines(lines) if documents else store.append_messages(lines, compact=compact)
        if acks:
            acks(done, number)

    return write


def push(stream: DataFrame, sink: Sink, checkpoint: str, every: str | None = "100 milliseconds", mode: str = "append") -> StreamingQuery:
    """Start the query; `every` None takes what is there and stops."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class Counted:
    """A sink that counts the messages that went through it, and those with an error, and knows the newest key."""

    def __init__(self, sink: Sink):
        self.sink, self.messages, self.errors, self.newest, self.last_error = sink, 0, 0, None, None

    def __call__(self, batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            self.sink(kept, number)
            error = F.col("error") if "error" in kept.columns else F.lit(None).cast("string")
            found = kept.agg(F.count_if(error.isNull()).alias("n"), F.count(error).alias("bad"), F.max(F.when(error.isNull(), F.col("ts_ns"))).alias("newest"), F.max(error).alias("error")).first()
            self.messages += found.n
            self.errors += found.bad
            self.newest = max((x for x in (self.newest, found.newest) if x is not None), default=None)
            self.last_error = found.error or self.last_error
        finally:
            kept.unpersist()


@dataclass
class Connection:
    """What a push or pull needs, as it is kept on disk.

    rules are {"name", "condition", "cooldown" or "cooldown_ns", "webhook", "webhook_headers"}. format says whether
    records of a schema store go out with names ("full") or as stored, and whether pulled ones come so. envelope is
    "data" (with a type), "timestamp" (without) or "none". Without persist a start begins at from_ns again.
    """

    id: str
    url: str
    mode: str = "push"
    text: str = ""
    ignore_case: bool = False
    rules: list[dict] = field(default_factory=list)
    from_ns: int = 0
    format: str = "full"
    agg_window: str = ""
    agg_fields: str = ""
    agg_default: str = ""
    envelope: str = "data"
    persist: bool = True
    run: int = 0

    def __post_init__(self):
        if self.mode not in ("push", "pull") or self.format not in ("full", "compact") or self.envelope not in ("data", "timestamp", "none"):
            raise ValueError("a connection pushes or pulls, full or compact, in a known envelope")
        if self.agg_window:
            AggSpec.parse(self.agg_window, self.agg_fields, self.agg_default)
        self.parsed_rules()

    def parsed_rules(self) -> list[Rule]:
        waits = lambda r: r.get("cooldown_ns") or (parse_duration(r["cooldown"]) if r.get("cooldown") else 0)
        return [Rule(r["name"], r["condition"], waits(r)) for r in self.rules]


class Connections:
    """A store's named connections: kept as JSON, run as streaming queries, started again when they fail."""

    def __init__(self, store: Store):
        self.store, self.path, self.files = store, f"{store.path}/connections.json", store.files
        self.kept = {c["id"]: Connection(**c) for c in (json.loads(self.files.read(self.path)) if self.files.exists(self.path) else [])}
        self.running: dict[str, list[tuple[StreamingQuery, Counted, Callable[[], StreamingQuery]]]] = {}
        self.spec: dict[str, AggSpec] = {}
        self.restarts: dict[str, int] = {}

    def _save(self) -> None:
        self.files.write(self.path, json.dumps([asdict(c) for c in self.kept.values()]))

    def create(self, connection: Connection) -> Connection:
        if connection.id in self.kept:
            raise FileExistsError(connection.id)
        self.kept[connection.id] = connection
        self._save()
        return connection

    def names(self) -> list[str]:
        return sorted(self.kept)

    def checkpoint(self, name: str, part: str) -> str:
        run = "" if self.kept[name].persist else f"-{uuid.uuid4().hex}"
        return f"{self.store.path}/connections/{name}/{part}{run}"

    def start(self, name: str, sink: Sink | None = None, every: str | None = "100 milliseconds", flush: str | None = None) -> list[StreamingQuery]:
        """Run a connection: its data (or windows) and, if there are rules, its alerts, each with its own checkpoint.

        Messages go to `sink`, by default as posts to the connection's address. Open windows are flushed once for each
        window length by the wall clock, or at `flush`.
        """
        c, spark = self.kept[name], self.store.spark
        if c.mode == "pull":
            spark.dataSource.register(EnvelopeSource)
            lines = spark.readStream.format("envelopes").option("url", c.url).option("raw", "true").load()
            counted = Counted(lambda batch, number: None)
            parts = [("pull", lines, store_sink(self.store, counted, c.format == "compact"), counted)]
        else:
            parts = self._pushed(c, sink or post_json(c.url), flush)
        self.running[name] = []
        for part, stream, to, counted in parts:
            at = self.checkpoint(name, part)
            again = lambda stream=stream, to=to, at=at: push(stream, to, at, every)
            self.running[name].append((again(), counted, again))
        return [q for q, *_ in self.running[name]]

    def _pushed(self, c: Connection, sink: Sink, flush: str | None) -> list[tuple[str, DataFrame, Sink, Counted]]:
        store, registry = self.store, self.store.registry if self.store.config.kind == "schema" else None
        kind = "data" if c.envelope == "data" else None
        found = contains_text(store.stream(c.from_ns), c.text, c.ignore_case)
        named = found.withColumn("payload", expanded(F.col("payload"), registry))
        if c.agg_window:
            spec = AggSpec.parse(c.agg_window, c.agg_fields, c.agg_default)
            windows = record_windows(named, spec, flush or c.agg_window, registry.numeric() if registry else None, store.config.name, run=c.run)
            self.spec[c.id] = spec
            messages = window_messages(windows, kind) if c.envelope != "none" else windows.select(F.col("window_end").alias("ts_ns"), F.col("data").alias("message"))
        elif c.envelope == "none":
            messages = (found if c.format == "compact" else named).select("ts_ns", F.col("payload").alias("message"))
        else:
            messages = data_messages(found, registry=None if c.format == "compact" else registry, kind=kind)
        counted = Counted(sink)
        parts = [("windows" if c.agg_window else "data", messages, counted, counted)]
        if c.rules:
            hooks = {r["name"]: post_json(r["webhook"], headers=r.get("webhook_headers")) for r in c.rules if r.get("webhook")}

            def alarm(batch: DataFrame, number: int) -> None:
                sink(alert_envelope(batch, json=True), number)
                for rule, hook in hooks.items():
                    body = F.struct("rule_name", "condition", F.col("ts_ns").alias("timestamp"), F.coalesce(F.try_parse_json("data"), F.col("data").cast("variant")).alias("data"), "store_name")
                    hook(batch.where(F.col("rule_name") == rule).select(F.to_json(body).alias("message")), number)

            rang = Counted(alarm)
            parts.append(("alerts", fired_alerts(named, c.parsed_rules(), store.config.name), rang, rang))
        return parts

    def start_all(self, every: str | None = "100 milliseconds") -> None:
        """As at the opening of a store: run what is kept and not running."""
        for name in self.names():
            if not any(q.isActive for q, *_ in self.running.get(name, [])):
                self.start(name, every=every)

    def tend(self, stop: threading.Event, wait: float = 1.0, most: float = 60.0) -> threading.Thread:
        """Until `stop` is set, start queries again that failed: after `wait` seconds, twice as long after each failure in
        a row, `most` at the longest; a query that runs again longer than that has its first wait again."""

        def watch() -> None:
            pause, since = wait, time.time()
            while not stop.wait(min(pause, 0.2)):
                dead = [(name, k) for name, runs in self.running.items() for k, (q, *_) in enumerate(runs) if q.exception()]
                if not dead:
                    if time.time() - since > most:
                        pause = wait
                    continue
                if stop.wait(pause):
                    return
                pause, since = min(most, 2 * pause), time.time()
                for name, k in dead:
                    _, counted, again = self.running[name][k]
                    self.running[name][k] = (again(), counted, again)
                    self.restarts[name] = self.restarts.get(name, 0) + 1

        thread = threading.Thread(target=watch, daemon=True)
        thread.start()
        return thread

    def status(self, name: str) -> dict:
        """The connection as it is kept, with its state and counters since the start."""
        c, runs = self.kept[name], self.running.get(name, [])
        failed = next((str(q.exception()) for q, *_ in runs if q.exception()), None)
        state = "error" if failed else "connected" if any(q.isActive for q, *_ in runs) else "disconnected"
        counted = runs[0][1] if runs else Counted(lambda *_: None)
        sent = {"messages_sent": counted.messages} if c.mode == "push" else {"messages_received": counted.messages}
        alarms = runs[1][1].messages if len(runs) > 1 else 0
        kept = {k: v for k, v in asdict(c).items() if k not in ("rules", "run")}
        return {
            **kept, "rules_count": len(c.rules), "alerts_fired": alarms, "status": state, "last_timestamp": counted.newest, **sent,
            "errors": counted.errors + self.restarts.get(name, 0) + bool(failed), "last_error": failed or counted.last_error,
        }

    def stop(self, name: str, sink: Sink | None = None) -> None:
        """Stop a connection. Open windows go out as partial ones, and a later start begins new windows."""
        c, runs = self.kept[name], self.running.pop(name, [])
        ended = lambda q: (q.lastProgress or {}).get("batchId", -1)
        for q, *_ in runs:
            before, limit = ended(q), time.time() + 60
            while q.isActive and q.status["isTriggerActive"] and ended(q) == before and time.time() < limit:  # let a batch end that has begun
                time.sleep(0.02)
            q.stop()
        if c.agg_window and runs and c.persist and runs[0][0].lastProgress:
            spark = self.store.spark
            state = spark.read.format("statestore").load(f"{self.store.path}/connections/{name}/windows")
            held = state.select(F.col("key.store").alias("store"), F.col("value.groupState.held").alias("held"))
            left = open_windows(held, self.spec[name], c.run)
            if left:
                rows = spark.createDataFrame(left, "store string, window_end long, record_count long, partial boolean, data string")
                (sink or runs[0][1])(window_messages(rows, "data" if c.envelope == "data" else None), -1)
                c.run += 1
                self._save()

    def delete(self, name: str) -> None:
        self.stop(name)
        del self.kept[name]
        self.files.delete(f"{self.store.path}/connections/{name}")
        self._save()
