"""Document fingerprints by content-defined chunking.

A gear hash rolls over the text's bytes: 32 bits, each new byte shifts the older ones out, so it depends on the
last 32 bytes alone. A chunk ends where the hash's high bits are zero; before `normal` bytes more bits must be
zero than after it (normalised chunking), and no chunk is shorter than `least` or longer than `most`. Boundaries
follow the content, so text that shifts keeps its chunks. A fingerprint is the set of chunk digests with their
lengths; the containment of one text in another is the share of its chunk bytes whose chunks both have.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

LEAST, NORMAL, MOST = 8, 32, 128
#: A fixed pseudo-random number for each byte, by rule.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 20) for b in range(256)], np.uint32)
HARD_BITS, EASY_BITS = 6, 4
#: Rows of a range of ids, as long as there are no more ranges than that; a range is a sorted stream in one task.
RANGE_ROWS, MOST_RANGES = 100_000, 8192


def gear_hashes(data: bytes) -> np.ndarray:
    """The rolling hash at every byte, by doubling: five steps cover 32 bytes."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        older = np.zeros_like(h)
        older[k:] = h[:-k] << np.uint32(k)
        h = h + older
    return h


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks end; the last end is the length. No bytes, no chunks."""
    n = len(data)
    if not n:
        return []
    h = gear_hashes(data)
    easy_at = np.flatnonzero(h >> np.uint32(32 - EASY_BITS) == 0)
    hard = (np.flatnonzero(h[easy_at] >> np.uint32(32 - HARD_BITS) == 0)).tolist()
    easy = (easy_at + 1).tolist()
    hard = [easy[i] for i in hard]
    ends, at, i, j = [], 0, 0, 0
    while at < n:
        i = bisect_left(hard, at + LEAST, i)
        if i < len(hard) and hard[i] < at + NORMAL:
            end = hard[i]
        else:
            j = bisect_left(easy, at + NORMAL, j)
            end = min(easy[j] if j < len(easy) else n, at + MOST)
        at = min(end, n)
        ends.append(at)
    return ends


def chunk_set(text: str) -> dict[int, int]:
    """Digest to length of the different chunks."""
    data = text.encode("utf-8", "surrogatepass")
    digest, out, start = xxhash.xxh32_intdigest, {}, 0
    for end in chunk_ends(data):
        out[digest(data[start:end])] = end - start
        start = end
    return out


def as_string(chunks: dict[int, int]) -> str:
    """Ten hex digits a chunk, eight of its digest and two of its length, in order."""
    keys = sorted(chunks)
    rows = np.zeros((len(keys), 5), np.uint8)
    rows[:, :4] = np.array(keys, ">u4").view(np.uint8).reshape(-1, 4)
    rows[:, 4] = [chunks[k] for k in keys]
    return rows.tobytes().hex()


def from_string(fingerprint: str) -> dict[int, int]:
    rows = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 5)
    return dict(zip(rows[:, :4].copy().view(">u4").ravel().tolist(), rows[:, 4].tolist(), strict=True))


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of a's chunk bytes that b has too; two empty sets are alike, one empty set is not."""
    if not a or not b:
        return float(not a and not b)
    return sum(a[k] for k in a.keys() & b.keys()) / sum(a.values())


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many code points from the start of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next smaller doc_id (after the last: the first); null ids come
    last, and rows with one doc_id are ordered by their text's hash. A null text counts as empty. One row is
    its own next; an empty table stays empty; other columns are ignored.

    Texts move once: they are dealt by ranges of doc_id, cut at quantiles of the ids alone, and the first
    row of a range is also sent to the range before it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    low = -(1 << 63)
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("key", F.coalesce("doc_id", F.lit(low)))
    ids = own.select("key")
    ranges = min(MOST_RANGES, max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), ids.count() // RANGE_ROWS))
    quantiles = F.percentile_approx("key", [k / ranges for k in range(1, ranges)], 10 * ranges)
    cuts = np.array(sorted(set(ids.agg(quantiles.alias("q")).first()["q"] or [])), np.int64)

    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, keys.to_numpy(), side="right"), dtype="int32")

    at = F.pandas_udf(place, "int")
    tops = {r["b"]: r["top"] for r in ids.select("key", at("key").alias("b")).groupBy("b").agg(F.max("key").alias("top")).collect()}
    filled = sorted(tops)  # at most one for each range
    # the largest id of a range follows the smallest of the range above; the largest of all follows the smallest of all
    heads = [(tops[b], filled[k + 1] if k + 1 < len(filled) else filled[0]) for k, b in enumerate(filled)]
    guests = F.broadcast(spark.createDataFrame(heads, "key long, above int"))
    homes = own.withColumn("home", at("key")).withColumn("order", F.xxhash64("text")).join(guests, "key", "left")
    here, there = (F.struct(F.col(c).alias("range"), F.lit(g).alias("guest")) for g, c in enumerate(("home", "above")))
    to = F.explode(F.when(F.col("above").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("to")
    placed = homes.select("doc_id", "text", "key", "order", to).select("doc_id", "text", "key", "order", "to.range", "to.guest")
    dealt = placed.repartition("range").sortWithinPartitions("range", "guest", F.desc("key"), "order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, doc_id, text, chunks) of the row that waits for the next one
        for batch in batches:
            out = []
            for doc_id, text, place, is_guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "guest")), strict=True):
                if is_guest and (held is None or held[0] != place):
                    continue  # a further guest with the same id
                chunks = chunk_set(text)
                if held is not None and held[0] == place:
                    out.append(report(*held[1:], text, chunks))
                held = None if is_guest else (place, doc_id, text, chunks)
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def report(doc_id, text: str, chunks: dict[int, int], following: str, its: dict[int, int]) -> tuple:
        changed = edited(text, following)
        other = chunk_set(changed)
        digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), digest, as_string(chunks), as_string(other), containment(chunks, other), containment(chunks, its)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(run, schema)
