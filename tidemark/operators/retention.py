"""Capacity: packing records into fixed blocks, keeping the newest blocks, and sizing a store."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.functions.names import unused
from tidemark.operators.parts import PART_ROWS, by_key, key_cuts, part_of, weighted_cuts

#: Bytes of a block header, of a record header, of an index entry and of the store's metadata.
BLOCK_HEADER, RECORD_HEADER, INDEX_ENTRY, META = 24, 24, 16, 64
LEAST_BLOCK = 64


def valid_block_size(size: int) -> bool:
    return size >= LEAST_BLOCK and size & (size - 1) == 0


def span_count(size: Column, block_size: int) -> Column:
    """Blocks that a record of `size` bytes takes: the first holds block_size - 48 of them, each further one block_size - 24."""
    first, more = block_size - BLOCK_HEADER - RECORD_HEADER, block_size - BLOCK_HEADER
    return F.when(size <= first, 1).otherwise(1 + F.ceil((size - first) / F.lit(more))).cast("long")


def largest_single_payload(block_size: int) -> int:
    """The documented bound of an unspanned payload, less the block's header only."""
    return block_size - BLOCK_HEADER


def openings(need: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For records of these needs (header included): running totals with 0 first, the record that opens the next block
    after one opened by each record, and the blocks that an opening takes."""
    total, n = np.r_[0, np.cumsum(need)], len(need)
    large = need > room
    follow = np.searchsorted(total[1:], total[:-1] + room, "right")  # the first that does not fit
    next_large = np.minimum.accumulate(np.r_[np.where(large, np.arange(n), n), n][::-1])[::-1][1:]
    follow = np.where(large, np.arange(1, n + 1), np.minimum(follow, next_large))
    spans = np.where(large, 1 + -(-(need - room) // room), 1)
    return total, follow, spans


def next_fit(need: np.ndarray, room: int, block: int, used: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """block, offset and span of each record after a last block with `used` bytes, and that state after all of them."""
    total, follow, spans = openings(need, room)
    fits = int(np.searchsorted(total[1:], room - used, "right"))
    large = np.flatnonzero(need > room)
    at = min(fits, int(large[0])) if len(large) else fits
    found = []
    while at < len(need):
        found.append(at)
        at = int(follow[at])
    opened = np.array(found, np.int64)
    last = block + np.cumsum(spans[opened])
    which = np.searchsorted(opened, np.arange(len(need)), "right") - 1
    begun = which >= 0
    blocks, offsets = np.full(len(need), block), used + total[:-1]
    blocks[begun] = (last - spans[opened] + 1)[which[begun]]
    offsets[begun] = total[:-1][begun] - total[opened][which[begun]]
    if not found:
        return blocks, offsets, np.where(begun, spans, 1), block, used + int(total[-1])
    end = found[-1]
    return blocks, offsets, spans, int(last[-1]), room if need[end] > room else int(total[-1] - total[end])


def packing_map(need: np.ndarray, room: int) -> tuple[list[int], list[int], list[int]]:
    """What these records make of any state before them: totals up to each record that may be the first to open a block,
    and for each of these the blocks that are taken and the bytes used in the last one.

    All later blocks follow from the first that is opened, and that is one of the few records that fit in one block.
    """
    total, follow, spans = openings(need, room)
    most = int(np.searchsorted(total[1:], room, "right"))
    large = np.flatnonzero(need > room)
    firsts = range(min(len(need), (min(most, int(large[0])) if len(large) else most) + 1))
    known: dict[int, tuple[int, int]] = {}
    for first in firsts:
        path, at = [], first
        while at < len(need) and at not in known:
            path.append(at)
            at = int(follow[at])
        for k in reversed(path):
            after = known.get(int(follow[k]))
            known[k] = (int(spans[k]) + after[0], after[1]) if after else (int(spans[k]), room if need[k] > room else int(total[-1] - total[k]))
    ends = [int(total[-1]) + room + 1 if need[k] > room else int(total[k + 1]) for k in firsts]
    return ends, [known[k][0] for k in firsts], [known[k][1] for k in firsts]


def dealt(keyed: DataFrame, parts: int, store: str, part: str, order: str) -> DataFrame:
    """A task for each part, in order; by the part itself, since hashes of parts would put several into one task."""
    return keyed.repartitionById(parts, part).sortWithinPartitions(store, part, order)


def packing_states(keyed: DataFrame, parts: int, store: str, part: str, order: str, size: str, room: int, first: tuple[int, int]) -> DataFrame:
    """(store, part, block, used, end): the state of a store before each of its parts, and its last block plus one.

    Parts are summed up apart from each other, from sizes alone; only the sums of a store meet, in order.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [None, []]

        def row() -> pa.RecordBatch:
            (name, number), need = held[0], np.concatenate(held[1])
            ends, blocks, used = packing_map(need, room)
            values = [[name], [number], [ends], [blocks], [used], [int(need.sum())]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names)

        for key, rows in by_key(batches, store, part):
            if key != held[0]:
                if held[1]:
                    yield row()
                held[:] = [key, []]
            held[1].append(rows.column(size).to_numpy() + RECORD_HEADER)
        if held[1]:
            yield row()

    types = [pa.string(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.int64()]
    names = [store, part, "ends", "blocks", "used", "total"]
    sums = dealt(keyed.select(store, part, order, size), parts, store, part, order).mapInArrow(summed, f"{store} string, {part} int, ends array<long>, blocks array<long>, used array<long>, total long")

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        name, (block, used) = None, first

        def rows(end: int) -> pa.RecordBatch:
            columns = [*zip(*held, strict=True), [end] * len(held)]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [store, part, "block", "used", "end"])

        for batch in batches:
            for at, number, ends, blocks, after, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != name:
                    if held:
                        yield rows(block + 1)
                    held, name, (block, used) = [], at, first
                held.append((at, number, block, used))
                k = bisect_right(ends, room - used)
                if k < len(ends):
                    block, used = block + blocks[k], after[k]
                else:
                    used += total
        if held:
            yield rows(block + 1)

    return sums.repartition(store).sortWithinPartitions(store, part).mapInArrow(chained, f"{store} string, {part} int, block long, used long, `end` long")


def packed(
    df: DataFrame, block_size: int, size: str = "size", order: str = "ts_ns", store: str | None = None, newest: int = 0,
    last: tuple[int, int] | None = None, part_rows: int = PART_ROWS, part_bytes: int = 0,
) -> DataFrame:
    """Adds block_seq, offset and span_count by next-fit packing in time order; columns of these names are replaced.

    A record with its header goes into the open block if it fits, else into a new one; a spanning record takes
    blocks of its own and leaves none open. Where a record lands depends on all before it in its store. So time is
    cut into parts, each part is first summed up (what it makes of any state before it), the sums are chained, and
    then all parts are packed side by side, each as a stream with two numbers of state.

    `newest` keeps the records of the newest so many blocks only; parts that lie before them are not packed.
    `last` is the block and the bytes used in it where packing goes on, by default a new store. Where rows carry their
    payloads, `part_bytes` bounds the bytes of a part.
    """
    if not valid_block_size(block_size):
        raise ValueError("a block size is a power of two, 64 at least")
    room = block_size - BLOCK_HEADER
    df = df.drop("block_seq", "offset", "span_count")
    cuts = weighted_cuts(df, order, size, part_rows, part_bytes) if part_bytes else key_cuts(df, order, part_rows)
    name, part, need, block, used, end = unused(df.columns, "store_name", "part", "need", "last_block", "used_bytes", "end_block")
    keyed = df.withColumns({name: F.coalesce(F.col(store).cast("string"), F.lit("")) if store else F.lit(""), part: part_of(F.col(order), cuts).cast("int"), need: F.col(size).cast("long")})
    first = last or (-1, room)
    if newest or cuts:
        states = packing_states(keyed, len(cuts) + 1, name, part, order, need, room, first).toDF(name, part, block, used, end)
        if newest:  # a part ends where the next one of its store begins
            after = F.lead(block).over(Window.partitionBy(name).orderBy(part))
            states = states.withColumn("after", F.coalesce(after, F.col(end))).where(F.col("after") >= F.col(end) - newest).drop("after")
        keyed = keyed.join(states if store else F.broadcast(states), [name, part])
    else:
        keyed = keyed.withColumns({block: F.lit(first[0]).cast("long"), used: F.lit(first[1]).cast("long"), end: F.lit(0).cast("long")})
    spread = dealt(keyed, len(cuts) + 1, name, part, order)
    added = ("block_seq", "offset", "span_count")
    out = T.StructType([*spread.schema.fields, *(T.StructField(n, T.LongType()) for n in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, (-1, room)
        for key, rows in by_key(batches, name, part):
            if key != at:
                at, state = key, (rows.column(block)[0].as_py(), rows.column(used)[0].as_py())
            blocks, offsets, spans, *state = next_fit(rows.column(need).to_numpy() + RECORD_HEADER, room, *state)
            columns = [pa.array(c, pa.int64()) for c in (blocks, offsets, spans)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *columns], [*rows.schema.names, *added])

    done = spread.mapInArrow(run, out)
    if newest:
        done = done.where(F.col("block_seq") >= F.col(end) - newest)
    return done.drop(name, part, need, block, used, end)


def keep_newest_blocks(blocks: DataFrame, capacity: int) -> DataFrame:
    """Of packed records those of the newest `capacity` blocks; a spanning record goes when its first block is reclaimed.

    For records not yet packed, packed(..., newest=capacity) does both in one pass.
    """
    end = blocks.select(F.max(F.col("block_seq") + F.col("span_count"))).scalar()
    return blocks.where(F.col("block_seq") >= end - capacity)


def keep_newest_rows(df: DataFrame, capacity: int, order: str = "ts_ns") -> DataFrame:
    """One record a block: the newest `capacity` records. Only the newest keys are sorted."""
    cut = df.select(order).orderBy(F.desc(order)).limit(capacity).select(F.min(order)).scalar()
    return df.where(F.col(order) >= cut)


def block_table(blocks: DataFrame) -> DataFrame:
    """block_num, first_ts and first payload size of each block that starts a record."""
    return blocks.groupBy(F.col("block_seq").alias("block_num")).agg(F.min("ts_ns").alias("first_ts"), F.count(F.lit(1)).alias("records"))


def blocks_in_range(table: DataFrame, start: int, end: int) -> DataFrame:
    if start > end:
        raise ValueError("the range starts after its end")
    return table.where(F.col("first_ts").between(start, end))


def first_of_block(blocks: DataFrame, block_num: int) -> DataFrame:
    return blocks.where(F.col("block_seq") == block_num).orderBy("ts_ns").limit(1)


def capacity_plan(df: DataFrame, blocks: int | Column, block_size: Column, record_size: Column) -> DataFrame:
    """footprint, records_per_block and blocks_per_record for columns of sizes."""
    n = F.lit(blocks) if isinstance(blocks, int) else blocks
    first, more = block_size - BLOCK_HEADER - RECORD_HEADER, block_size - BLOCK_HEADER
    spans = F.when(record_size <= first, 1).otherwise(1 + F.ceil((record_size - first) / more)).cast("long")
    return df.withColumns({
        "footprint": (n * block_size + n * INDEX_ENTRY + META).cast("long"),
        "records_per_block": F.floor(more / (record_size + RECORD_HEADER)).cast("long"),
        "blocks_per_record": spans,
    })


def bytes_text(n: Column) -> Column:
    """'512 B', '1.50 KB', '2.00 GB'."""
    shown = lambda unit, name: F.concat(F.format_string("%.2f", F.bround(n / float(unit), 2)), F.lit(f" {name}"))
    return (
        F.when(n >= 1 << 30, shown(1 << 30, "GB")).when(n >= 1 << 20, shown(1 << 20, "MB")).when(n >= 1 << 10, shown(1 << 10, "KB"))
        .otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


def number_text_with_commas(n: Column) -> Column:
    return F.format_number(n, 0)
