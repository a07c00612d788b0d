"""Stores on any file system that Spark reads: create, append, scan, delete, reset, compact, describe.

A store is a folder. What it holds is named by its latest commit, a small file in `log` that lists the folders of
records and of tombstones and says where packing stands. New folders are written first and named afterwards, so a
writer that dies leaves the store as it was; folders that no commit names are swept by recover(). A commit file
can be created once only: of two writers one fails. Records carry their place (block_seq, offset, span_count) from
the time they are written, so that a store of fixed capacity reads its newest blocks by a range, and a deleted
place is no obstacle to a new record with the same key.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.names import unused
from tidemark.functions.timeconv import rfc3339
from tidemark.functions.values import json_valid
from tidemark.operators import scans
from tidemark.operators.aggregate import AggSpec, aggregate, aggregate_json
from tidemark.operators.output import compact_aggregates
from tidemark.operators.parts import PART_BYTES
from tidemark.operators.retention import BLOCK_HEADER, RECORD_HEADER, packed, valid_block_size
from tidemark.operators.running import ordering_guard
from tidemark.operators.schema import Field, SchemaRegistry
from tidemark.sources.lines import envelopes

#: The data types, and the content type that each accepts.
CONTENT_TYPES = {"binary": "application/octet-stream", "text": "text/plain", "json": "application/json", "schema": "application/json"}
KINDS = tuple(CONTENT_TYPES)
PLACE = ("block_seq", "offset", "span_count")


@dataclass
class Config:
    """Defaults: 1024 blocks of 4096 bytes of JSON."""

    name: str
    num_blocks: int = 1024
    block_size: int = 4096
    kind: str = "json"

    def __post_init__(self):
        if not self.name or "/" in self.name:
            raise ValueError("a store needs a plain name")
        if self.num_blocks <= 0 or not valid_block_size(self.block_size):
            raise ValueError("blocks must be positive in number, and in size a power of two, 64 at least")
        if self.kind not in KINDS:
            raise ValueError(f"unknown data type {self.kind!r}")


@dataclass(frozen=True)
class Handle:
    """Where a record is: its key, block (counted on without end), place in it, size, and blocks taken."""

    ts_ns: int
    block_seq: int
    offset: int
    size: int
    span_count: int = 1


class Files:
    """The few file operations that a registry needs, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark.sparkContext._jvm

    def _at(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def delete(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.delete(at, True)

    def make(self, path: str) -> None:
        fs, at = self._at(path)
        fs.mkdirs(at)

    def move(self, path: str, to: str) -> None:
        fs, at = self._at(path)
        if not fs.rename(at, self._at(to)[1]):
            raise OSError(f"cannot move {path} to {to}")

    def names(self, path: str) -> list[str]:
        fs, at = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def write(self, path: str, text: str, replace: bool = True) -> None:
        """Without `replace` a file that exists is an error."""
        fs, at = self._at(path)
        out = fs.create(at, replace)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, path: str) -> str:
        fs, at = self._at(path)
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


class Store:
    """One time series: ts_ns (ascending, unique) and payload. Deletes are tombstones; scans leave them out.

    Scans show the records of the newest `num_blocks` blocks, with block_num, the place of a record's block in the
    ring of blocks, and PLACE beside ts_ns and payload.
    """

    def __init__(self, spark: SparkSession, path: str, config: Config, registry: SchemaRegistry):
        self.spark, self.path, self.config, self.registry, self.files = spark, path, config, registry, Files(spark)
        self.room = config.block_size - BLOCK_HEADER

    # --- commits ---

    def state(self) -> dict:
        """The latest commit: number, folders of records and tombstones, the last block, its used bytes, the newest key."""
        found = self.files.names(f"{self.path}/log")
        if not found:
            return {"number": 0, "records": [], "tombstones": [], "block": -1, "used": self.room, "newest": None}
        return json.loads(self.files.read(f"{self.path}/log/{found[-1]}"))

    def commit(self, state: dict, **changes) -> None:
        """The next commit; it fails if another writer made one since `state`."""
        new = {**state, **changes, "number": state["number"] + 1}
        self.files.write(f"{self.path}/log/{new['number']:020d}.json", json.dumps(new), replace=False)

    def recover(self) -> list[str]:
        """Sweep what no commit names: the folders of writers that died. Not while another writer is at work."""
        state, swept = self.state(), []
        named = {*state["records"], *state["tombstones"]}
        for part in ("staging", "data", "packed", "tombstones"):
            swept += [f"{part}/{n}" for n in self.files.names(f"{self.path}/{part}") if f"{part}/{n}" not in named]
        for folder in swept:
            self.files.delete(f"{self.path}/{folder}")
        return swept

    @property
    def payload_type(self) -> str:
        return "binary" if self.config.kind == "binary" else "string"

    @property
    def schema(self) -> str:
        return f"ts_ns long, payload {self.payload_type}, block_seq long, `offset` long, span_count long"

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, part: str) -> str:
        """A new folder of rows, complete before it stands in its place; its name under the store's path."""
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/staging/{name}")
        self.files.make(f"{self.path}/{part}")
        self.files.move(f"{self.path}/staging/{name}", f"{self.path}/{part}/{name}")
        return f"{part}/{name}"

    # --- reading ---

    def first_block(self, state: dict) -> int:
        return max(0, state["block"] + 1 - self.config.num_blocks)

    def records(self) -> DataFrame:
        """What the store holds: the newest blocks, without deleted records."""
        state = self.state()
        rows = self._read(state["records"], self.schema).where(F.col("block_seq") >= self.first_block(state))
        if state["tombstones"]:
            rows = rows.join(self._read(state["tombstones"], "block_seq long, `offset` long"), ["block_seq", "offset"], "left_anti")
        return rows.select("ts_ns", "payload", (F.col("block_seq") % self.config.num_blocks).alias("block_num"), *PLACE)

    def stream(self, from_ns: int = 0, files: int | None = None) -> DataFrame:
        """Records as they are appended, ts_ns and payload, after from_ns; 0 starts at the oldest, -1 at the present."""
        reader = self.spark.readStream.schema(self.schema).option("recursiveFileLookup", True)
        if files:
            reader = reader.option("maxFilesPerTrigger", files)
        self.files.make(f"{self.path}/data")
        start = scans.now() if from_ns < 0 else from_ns
        rows = reader.parquet(f"{self.path}/data").select("ts_ns", "payload")
        return rows.where(F.col("ts_ns") > start) if start else rows

    def newest_ns(self) -> int | None:
        return self.records().agg(F.max("ts_ns")).first()[0]

    def oldest_ns(self) -> int | None:
        return self.records().agg(F.min("ts_ns")).first()[0]

    def at(self, ts_ns: int) -> DataFrame:
        return scans.at_time(self.records(), ts_ns)

    def get(self, handle: Handle) -> DataFrame:
        return self.records().where((F.col("block_seq") == handle.block_seq) & (F.col("offset") == handle.offset) & (F.col("ts_ns") == handle.ts_ns))

    def of_block(self, block_num: int) -> DataFrame:
        """The first record of a block of the ring; IndexError beyond the ring."""
        if not 0 <= block_num < self.config.num_blocks:
            raise IndexError(f"block {block_num} of {self.config.num_blocks}")
        return self.records().where(F.col("block_num") == block_num).orderBy("ts_ns").limit(1)

    def inspect(self, block_num: int) -> DataFrame:
        """What stands in a block of the ring, in order: the record headers, payloads, and the block's index entry."""
        if not 0 <= block_num < self.config.num_blocks:
            raise IndexError(f"block {block_num} of {self.config.num_blocks}")
        rows = self.records().where(F.col("block_num") == block_num).withColumn("size", F.octet_length("payload"))
        first = F.min("ts_ns").over(Window.partitionBy("block_seq"))
        return rows.select("block_num", "block_seq", "offset", "ts_ns", "size", "span_count", first.alias("first_ts"), "payload").orderBy("offset")

    def blocks(self) -> DataFrame:
        """block_num, block_seq, first_ts and records of each block in which a record starts."""
        grouped = self.records().groupBy("block_num", "block_seq")
        return grouped.agg(F.min("ts_ns").alias("first_ts"), F.count(F.lit(1)).alias("records"))

    def exact_block(self, ts_ns: int) -> DataFrame:
        """The block whose first record has this key."""
        return self.blocks().where(F.col("first_ts") == ts_ns)

    def floor_block(self, ts_ns: int) -> DataFrame:
        """The last block that begins at or before the key, else the oldest one; none in an empty store."""
        order = F.struct((F.col("first_ts") <= ts_ns).alias("before"), F.when(F.col("first_ts") <= ts_ns, F.col("first_ts")).otherwise(-F.col("first_ts")))
        return self.blocks().orderBy(F.desc(order)).limit(1)

    def blocks_in_range(self, start: int, end: int) -> DataFrame:
        if start > end:
            raise ValueError("the range starts after its end")
        return self.blocks().where(F.col("first_ts").between(start, end))

    def oldest(self, limit: int = scans.OLDEST_LIMIT, text: str = "", ignore_case: bool = False) -> DataFrame:
        return scans.oldest(scans.contains_text(self.records(), text, ignore_case), limit)

    def newest(self, limit: int = scans.NEWEST_LIMIT, text: str = "", ignore_case: bool = False, **span) -> DataFrame:
        return scans.newest(scans.contains_text(self.records(), text, ignore_case), limit, **span)

    def range(self, limit: int = scans.RANGE_LIMIT, text: str = "", ignore_case: bool = False, **span) -> DataFrame:
        return scans.time_range(scans.contains_text(self.records(), text, ignore_case), limit=limit, **span)

    def aggregate(
        self, window: str, fields: str = "", default: str = "", text: str = "", limit: int = 0, raw_cap: int = 0, ignore_case: bool = False, **span
    ) -> DataFrame:
        """Windows over records that hold the text. Schema stores give a column an output, JSON stores rows.

        span takes the arguments of range(). raw_cap keeps only the first records, before the filter; it is off
        unless asked for.
        """
        if self.config.kind not in ("json", "schema"):
            raise ValueError("only JSON and schema stores aggregate")
        rows = scans.time_range(self.records(), **span) if span else self.records()
        rows = scans.first_rows(rows, raw_cap) if raw_cap else rows
        rows, spec = scans.contains_text(rows, text, ignore_case), AggSpec.parse(window, fields, default)
        if self.config.kind == "json":
            return aggregate_json(rows, spec, limit=limit)
        kinds = self.registry.struct()
        (key,) = unused(kinds.names, "ts_ns")
        record = F.from_json(self.registry.expand(F.col("payload")), kinds)
        typed = rows.select(F.col("ts_ns").alias(key), record.alias("r")).select(key, *[F.col("r").getField(n).alias(n) for n in kinds.names])
        return aggregate(typed, spec, kinds.names, limit, ts_ns=key)

    def aggregate_compact(self, *args, **kwargs) -> tuple[dict[str, str], DataFrame]:
        """Of a schema store: the header (index to name), and aggregate() with field names as indexes."""
        return compact_aggregates(self.aggregate(*args, **kwargs), self.registry)

    # --- writing ---

    def prepared(self, rows: DataFrame) -> DataFrame:
        """ts_ns, payload as it is stored, and error: why a record is refused by itself."""
        payload, kind = F.col("payload"), self.config.kind
        error = F.lit(None).cast("string")
        if kind == "schema":
            error = F.when(~self.registry.validate(payload), "a record has fields that the schema lacks")
            payload = self.registry.compact(payload)
        elif kind == "json":
            text = payload.cast("string")
            error = F.when(~json_valid(text) | F.try_parse_json(text).isNull(), "a record is no JSON")
        error = F.when(F.col("ts_ns").isNull() | (F.col("ts_ns") <= 0), "a key must be positive").otherwise(error)
        return rows.select(F.col("ts_ns").cast("long").alias("ts_ns"), payload.cast(self.payload_type).alias("payload"), error.alias("error"))

    def append(self, rows: DataFrame) -> DataFrame:
        """Write rows (ts_ns, payload) after what is stored; raises if a key is not positive, repeats or goes back.

        Schema stores take full or compact objects and keep them compact. The rows are computed once, into a staging
        folder that is checked, then packed. Returns ts_ns, size, block_num and PLACE.
        """
        return self._publish(self._staged(self.prepared(rows)))

    def _publish(self, staged: DataFrame) -> DataFrame:
        state = self.state()
        found = staged.agg(
            F.min("ts_ns").alias("least"), F.count(F.lit(1)).alias("n"), F.count_distinct("ts_ns").alias("different"), F.max("error").alias("error")
        ).first()
        if found.error:
            raise ValueError(found.error)
        if found.n and (found.different < found.n or state["newest"] is not None and found.least <= state["newest"]):
            raise ValueError("keys must be larger than what is stored and before them")
        size = F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long")
        folder = self._write(packed(
            staged.select("ts_ns", "payload", size.alias("size")), self.config.block_size, last=(state["block"], state["used"]), part_bytes=PART_BYTES).drop("size"), "data")
        written = self._read([folder], self.schema)
        end = written.orderBy(F.desc("ts_ns")).limit(1).select("ts_ns", *PLACE, size.alias("size")).collect()
        if end:
            last, need = end[0], end[0]["size"] + RECORD_HEADER
            used = self.room if need > self.room else last["offset"] + need
            self.commit(state, records=[*state["records"], folder], block=last.block_seq + last.span_count - 1, used=used, newest=last.ts_ns)
        return written.select("ts_ns", size.alias("size"), (F.col("block_seq") % self.config.num_blocks).alias("block_num"), *PLACE)

    def append_objects(self, rows: DataFrame, *columns: str) -> DataFrame:
        """Marshal columns to JSON objects and append them."""
        return self.append(rows.select("ts_ns", F.to_json(F.struct(*columns)).alias("payload")))

    def append_messages(self, lines: DataFrame, now_ns: int | None = None, compact: bool = False, arrival: str | None = None) -> DataFrame:
        """Write {"timestamp"?, "data"} lines (column value) one by one: each is taken or refused by itself.

        Messages count in the order of `arrival`, by default that of the frame; without a timestamp the n-th is at
        now_ns + n. Those that are no envelopes, do not fit the schema, or do not go forward in time are refused.
        With `compact` a schema store trusts objects to be compact. Returns arrival, ts_ns and error, null for those
        stored; read it before the store is compacted or opened again. A batch of timed messages that is sent again
        is refused as a whole, so streams may repeat it.
        """
        now, lacking = scans.now() if now_ns is None else now_ns, "a record has fields that the schema lacks"
        order = F.col(arrival) if arrival else F.monotonically_increasing_id()
        found = envelopes(lines.withColumn("arrival", order.cast("long")), 0, keep=["arrival"])
        if self.config.kind == "schema" and not compact:
            fits = F.coalesce(self.registry.validate(F.col("payload")), F.lit(False))
            found = found.withColumn("error", F.coalesce("error", F.when(~fits, lacking)))
            found = found.withColumn("payload", F.coalesce(self.registry.compact(F.col("payload")), "payload"))
        read = self._staged(found)
        if not arrival:  # ids leap from partition to partition: count through
            sizes = read.groupBy(F.shiftright("arrival", 33).alias("p")).count()
            base = F.coalesce(F.sum("count").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            read = read.withColumn("p", F.shiftright("arrival", 33)).join(F.broadcast(sizes.select("p", base.alias("base"))), "p")
            read = read.withColumn("arrival", F.col("base") + F.col("arrival") % F.lit(1 << 33)).drop("p", "base")
        read = read.withColumn("ts_ns", F.when(F.col("ts_ns") == 0, F.lit(now) + F.col("arrival")).otherwise(F.col("ts_ns")))
        good = read.where("error is null").select("arrival", "ts_ns")
        accepted = ordering_guard(good, newest_ns=self.state()["newest"]).where("accepted").select("arrival", "accepted")
        late = F.when(F.col("accepted").isNull(), "keys must be larger than what is stored and before them")
        judged = self._staged(read.join(accepted, "arrival", "left").withColumn("error", F.coalesce("error", late)).drop("accepted"))
        self._publish(judged.where("error is null").select("ts_ns", F.col("payload").cast(self.payload_type).alias("payload"), "error"))
        return judged.select("arrival", "ts_ns", "error")

    def append_lines(self, lines: DataFrame, now_ns: int | None = None) -> DataFrame:
        """Write one JSON document a line (column value), as a local socket sends them, each at its own present; QUIT lines
        are no documents. Returns what append_messages() does; streams call it batch by batch."""
        wrapped = F.when(json_valid(F.col("value")), F.concat(F.lit('{"data":'), F.col("value"), F.lit("}"))).otherwise(F.lit("no JSON"))
        return self.append_messages(lines.where("trim(value) <> 'QUIT'").select(wrapped.alias("value")), now_ns)

    def _staged(self, df: DataFrame) -> DataFrame:
        """The rows, computed once; the folder is swept with what no commit names."""
        path = f"{self.path}/staging/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def put(self, payload: object, ts_ns: int | None = None) -> Handle:
        """One record, at the present time by default; its place is found here, so one small file is all that is written."""
        at = scans.now() if ts_ns is None else ts_ns
        value = json.dumps(payload) if isinstance(payload, dict | list) else payload
        row = self.prepared(self.spark.createDataFrame([(at, value)], f"ts_ns long, payload {self.payload_type}")).first()
        state = self.state()
        if row.error:
            raise ValueError(row.error)
        if state["newest"] is not None and at <= state["newest"]:
            raise ValueError("keys must be larger than what is stored")
        size = len(row.payload.encode() if isinstance(row.payload, str) else row.payload)
        need, block, used = size + RECORD_HEADER, state["block"], state["used"]
        if need > self.room:
            spans = 1 + -(-(need - self.room) // self.room)
            handle, block, used = Handle(at, block + 1, 0, size, spans), block + spans, self.room
        elif used + need > self.room:
            handle, block, used = Handle(at, block + 1, 0, size), block + 1, need
        else:
            handle, used = Handle(at, block, used, size), used + need
        self._add(state, handle, row.payload, block, used, at)
        return handle

    def _add(self, state: dict, handle: Handle, payload: str | bytes, block: int, used: int, newest: int) -> None:
        row = (handle.ts_ns, payload, handle.block_seq, handle.offset, handle.span_count)
        folder = self._write(self.spark.createDataFrame([row], self.schema).coalesce(1), "data")
        self.commit(state, records=[*state["records"], folder], block=block, used=used, newest=newest)

    def insert(self, payload: str | bytes, ts_ns: int | None = None) -> Handle:
        """The older way to add one record: it must fit a block of its own, and its key may be any that is free."""
        at = scans.now() if ts_ns is None else ts_ns
        size = len(payload.encode() if isinstance(payload, str) else payload)
        if size > self.room:
            raise ValueError("the record does not fit a block")
        if at <= 0 or self.at(at).limit(1).count():
            raise ValueError("a key must be positive and free")
        state = self.state()
        handle = Handle(at, state["block"] + 1, 0, size)
        self._add(state, handle, payload, handle.block_seq, self.room, max(at, state["newest"] or 0))
        return handle

    def post(self, body: str | bytes, content_type: str, now_ns: int | None = None) -> Handle:
        """What a request brings: its content type must be the store's. JSON is an envelope {"timestamp"?, "data"};
        text and binary are the record itself, at the present time."""
        if content_type.partition(";")[0].strip().lower() != CONTENT_TYPES[self.config.kind]:
            raise ValueError(f"a {self.config.kind} store takes {CONTENT_TYPES[self.config.kind]}")
        now = scans.now() if now_ns is None else now_ns
        if self.config.kind in ("binary", "text"):
            return self.put(body, now)
        row = envelopes(self.spark.createDataFrame([(body.decode() if isinstance(body, bytes) else body,)], "value string"), now).first()
        if row.error:
            raise ValueError(row.error)
        return self.put(row.payload, row.ts_ns)

    def delete(self, ts_ns: int) -> None:
        """A tombstone for the record with this key; KeyError if there is none."""
        self._bury(self.at(ts_ns), ts_ns)

    def delete_handle(self, handle: Handle) -> None:
        """A tombstone for the record at this place; KeyError if there is none."""
        self._bury(self.get(handle), handle)

    def _bury(self, rows: DataFrame, name: object) -> None:
        state, found = self.state(), rows.select("block_seq", "offset").collect()  # keys and places are unique
        if not found:
            raise KeyError(name)
        folder = self._write(self.spark.createDataFrame([tuple(r) for r in found], "block_seq long, `offset` long").coalesce(1), "tombstones")
        self.commit(state, tombstones=[*state["tombstones"], folder])

    def compact(self) -> None:
        """Rewrite what the store holds as one folder; places and so handles stay. Old folders go after the commit."""
        state = self.state()
        rows = self.records().select("ts_ns", "payload", *PLACE)
        folder = self._write(rows.repartitionByRange("ts_ns").sortWithinPartitions("ts_ns"), "packed")
        self.commit(state, records=[folder], tombstones=[])
        self.recover()
        for old in self.files.names(f"{self.path}/log")[:-10]:
            self.files.delete(f"{self.path}/log/{old}")

    def reset(self) -> None:
        """Drop all records; configuration and schema stay, and any key may come again."""
        self.commit(self.state(), records=[], tombstones=[], block=-1, used=self.room, newest=None)
        self.recover()

    # --- schema and description ---

    def set_schema(self, fields: list[Field]) -> int:
        version = self.registry.add(fields)
        self.files.write(f"{self.path}/schema.json", self.registry.dumps())
        return version

    def get_schema(self) -> dict:
        """The current version with its fields, and all versions; KeyError where none is set."""
        return {"version": len(self.registry.versions), "fields": [asdict(f) for f in self.registry.fields()], "versions": [[asdict(f) for f in v] for v in self.registry.versions]}

    def stats(self) -> DataFrame:
        """One row: describe() with the configuration and where the ring stands; an empty store has no active blocks."""
        state = self.state()
        ring = {
            "num_blocks": self.config.num_blocks, "block_size": self.config.block_size, "data_type": self.config.kind,
            "tail_block": self.first_block(state) % self.config.num_blocks, "head_block": max(0, state["block"]) % self.config.num_blocks,
            "write_offset": state["used"] if state["block"] >= 0 else 0, "active_blocks": state["block"] + 1 - self.first_block(state),
        }
        return describe(self.records(), self.config.name).select("*", *[F.lit(v).alias(k) for k, v in ring.items()])


def describe(records: DataFrame, name: str, payload: str = "payload") -> DataFrame:
    """One row: store, records, bytes, oldest and newest key, and both as RFC 3339. An empty store has nulls and zeros."""
    found = records.agg(
        F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(F.octet_length(payload)), F.lit(0)).cast("long").alias("bytes"),
        F.min("ts_ns").alias("oldest_ns"), F.max("ts_ns").alias("newest_ns"),
    )
    return found.select(F.lit(name).alias("store"), "*", rfc3339("oldest_ns").alias("oldest"), rfc3339("newest_ns").alias("newest"))


def usage(described: DataFrame, num_blocks: int, block_size: int) -> DataFrame:
    """Adds capacity_bytes and used_percent (of records with their headers, 100 at most) to rows of describe()."""
    capacity = num_blocks * (block_size - BLOCK_HEADER)
    used = (F.col("bytes") + RECORD_HEADER * F.col("records")) * 100.0 / capacity
    return described.withColumn("capacity_bytes", F.lit(capacity).cast("long")).withColumn("used_percent", F.least(F.round(used, 2), F.lit(100.0)))


class Engine:
    """The stores under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self.opened: dict[str, Store] = {}

    def create(self, config: Config) -> Store:
        path = f"{self.root}/{config.name}"
        if self.files.exists(path):
            raise FileExistsError(path)
        self.files.write(f"{path}/store.json", json.dumps(asdict(config)))
        return self.open(config.name)

    def open(self, name: str, recover: bool = True) -> Store:
        """The store, swept of what a writer left that died; without `recover` for a second process beside a writer."""
        if name not in self.opened:
            path = f"{self.root}/{name}"
            if not self.files.exists(f"{path}/store.json"):
                raise FileNotFoundError(path)
            schema = f"{path}/schema.json"
            registry = SchemaRegistry.loads(self.files.read(schema)) if self.files.exists(schema) else SchemaRegistry()
            self.opened[name] = Store(self.spark, path, Config(**json.loads(self.files.read(f"{path}/store.json"))), registry)
            if recover:
                self.opened[name].recover()
        return self.opened[name]

    def close(self) -> None:
        self.opened.clear()

    def delete(self, name: str) -> None:
        self.opened.pop(name, None)
        self.files.delete(f"{self.root}/{name}")

    def names(self) -> list[str]:
        return [n for n in self.files.names(self.root) if self.files.exists(f"{self.root}/{n}/store.json")]

    def status(self) -> DataFrame:
        """Stats of all stores with their capacity, how much of it is used, and how many connections they have."""
        out = None
        for name in self.names():
            store = self.open(name, recover=False)
            kept = f"{store.path}/connections.json"
            n = len(json.loads(self.files.read(kept))) if self.files.exists(kept) else 0
            row = usage(store.stats(), store.config.num_blocks, store.config.block_size).withColumn("connections", F.lit(n))
            out = row if out is None else out.unionByName(row)
        return out if out is not None else describe(self.spark.createDataFrame([], "ts_ns long, payload string"), "").limit(0)
