"""Repeated passages by recompression.

Words are symbols. A round first names maximal runs of one symbol, then halves the alphabet by a bit of each
name and names every pair of a left and a right symbol next to each other. A name is a hash of what it stands
for, so it is the same in every task without a dictionary, and equal passages get equal symbols except near
their ends. How near is tracked exactly: each symbol carries the span of words on which its name and bounds
depend. Every window of `width` words thus has a set of interior symbols (span inside the window) that is the
same wherever the window stands; the one with the least name is its anchor.

Consecutive windows with one anchor are one row: about one row for 19 words. `core` hashes the anchor's span,
`whole` all words of the row's windows. A core seen in one document only cannot repeat. For shared cores the
rows of equal `whole` form a class: its rows beyond the least doc_id repeat entirely. Only where a core has
several classes are the windows of each class's first row compared one by one. Windows without an interior
symbol (inside long runs) stand for themselves.

Rows that are alike in one text, as a repeated line gives them, travel as one with all their places.

Words have two independent 64-bit hashes. Names, spans and cores come from the first and only bring rows
together; whether rows or windows are equal is decided by hashes over the second. So two words that share a
name, or two cores that collide, cannot make different passages pass for equal.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_whole_rows, materialize, release, settled, small_batches, spread, unused

#: Fixed odd multipliers of the hashes.
MIX, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SLICE_WORDS = 300_000
#: Bits of the filters that pass over rows with unshared cores: at most 32 MB; fuller filters cost time only.
MOST_BITS = 1 << 28
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * BASE
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_WORDS * 2)
        for k, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


class Spans:
    """Hashes of any span of a sequence of word hashes."""

    def __init__(self, ids: np.ndarray):
        up, self.down = powers(len(ids) + 1)
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(ids * up[: len(ids)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * MIX)


def recompress(ids: np.ndarray, bounds: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name and dependence span [low, high) of every symbol after some rounds, over texts ids[bounds[k]:bounds[k+1]].

    A span that sticks out of its text marks a symbol that what stands beyond the text's end might change.
    """
    name = mix(ids)
    n = len(ids)
    low, high = np.arange(n), np.arange(1, n + 1)
    first = np.zeros(n, bool)
    first[bounds[:-1][bounds[:-1] < n]] = True
    for k in range(rounds):
        if not len(name):
            break
        # runs
        starts = np.flatnonzero(first | np.r_[True, name[1:] != name[:-1]])
        ends = np.r_[starts[1:], len(name)]
        length = (ends - starts).astype(np.uint64)
        at_start, at_end = first[starts], np.r_[first[starts[1:]], True]
        new_low = np.where(at_start, low[starts] - 1, low[np.maximum(starts - 1, 0)])
        new_high = np.where(at_end, high[ends - 1] + 1, high[np.minimum(ends, len(name) - 1)])
        name = np.where(length > 1, mix(name[starts] + length * MIX), name[starts])
        low, high, first = new_low, new_high, at_start
        # pairs
        right = (mix(name ^ np.uint64(k + 1)) >> np.uint64(63)).astype(bool)
        last = np.r_[first[1:], True]
        joins = np.zeros(len(name), bool)  # with the next one
        joins[:-1] = ~right[:-1] & right[1:] & ~first[1:]
        joined = np.r_[False, joins[:-1]]
        after, before = np.minimum(np.arange(len(name)) + 1, len(name) - 1), np.maximum(np.arange(len(name)) - 1, 0)
        alone = ~joins & ~joined
        high2 = np.where(joins, high[after], np.where(alone & ~right, np.where(last, high + 1, high[after]), high))
        low2 = np.where(alone & right, np.where(first, low - 1, low[before]), low)
        name = np.where(joins, mix(name * BASE + mix(name[after])), name)
        keep = ~joined
        name, low, high, first = name[keep], low2[keep], high2[keep], first[keep]
    return name, low, high


def least_symbols(name: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each range [lo, hi) of symbols the leftmost with the least name; -1 for empty ranges."""
    count = hi - lo
    out = np.full(len(lo), -1, np.int64)
    table, level = np.arange(len(name)), 0
    while True:
        size = 1 << level
        now = np.flatnonzero((count >= size) & (count < 2 * size))
        if len(now):
            a, b = table[lo[now]], table[hi[now] - size]
            out[now] = np.where(name[b] < name[a], b, a)
        if not (count >= 2 * size).any():
            return out
        other = np.r_[table[size:], np.full(min(size, len(table)), len(name) - 1)][: len(table)]
        table = np.where(name[other] < name[table], other, table)
        level += 1


def window_rows(both: np.ndarray, bounds: np.ndarray, width: int, rounds: int) -> dict[str, np.ndarray]:
    """Rows (text, first and last window start, core, whole) that hold every window of every text once.

    both has a row for each of the words' two hashes; `spans` hashes spans of the second.
    """
    ids = both[0]
    spans, checks = Spans(ids), Spans(both[1])
    name, low, high = recompress(ids, bounds, rounds)
    n = len(ids)
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.arange(n)
    starts = starts[starts + width <= bounds[1:][text]]
    below = np.cumsum(np.bincount(np.clip(low + 1, 0, n), minlength=n + 1))  # symbols with low < p
    upto = np.cumsum(np.bincount(np.clip(high, 0, n + 1), minlength=n + 2))  # symbols with high <= p
    lo, hi = below[starts], upto[starts + width]
    anchor = least_symbols(name, lo, np.maximum(hi, lo))
    bare = anchor < 0
    mark = np.where(bare, spans.hash(starts, starts + width).view(np.int64), anchor)
    t = text[starts]
    cut = np.r_[True, (mark[1:] != mark[:-1]) | (bare[1:] != bare[:-1]) | (t[1:] != t[:-1])] if len(starts) else np.zeros(0, bool)
    a = np.flatnonzero(cut)
    z = np.r_[a[1:], len(starts)] - 1
    p0, p1, lone = starts[a], starts[z] if len(a) else starts[:0], bare[a]
    symbol = np.where(lone, 0, anchor[a])
    s0, s1 = (np.where(lone, p0, low[symbol]), np.where(lone, p0 + width, high[symbol])) if len(name) else (p0, p0 + width)
    core = spans.hash(s0, s1) ^ (np.where(lone, np.uint64(1), name[symbol]) if len(name) else np.uint64(1))
    whole = checks.hash(p0, np.where(lone, p0, p1) + width)
    return {"text": t[a], "p0": p0, "p1": p1, "core": core, "whole": whole, "lone": lone, "spans": checks}


def merge_lone(r: dict[str, np.ndarray], width: int) -> dict[str, np.ndarray]:
    """Rows of windows without an anchor that are alike and overlap, as in a repeated line, become one row.

    It reaches from the first such window to the last; those between that are not alike have rows of their own.
    All words it covers are covered by windows that are alike.
    """
    at = np.flatnonzero(r["lone"])
    if len(at) < 2:
        return r
    at = at[np.lexsort((r["p0"][at], r["whole"][at], r["text"][at]))]
    same = (r["whole"][at[1:]] == r["whole"][at[:-1]]) & (r["text"][at[1:]] == r["text"][at[:-1]])
    starts = np.flatnonzero(np.r_[True, ~(same & (r["p0"][at[1:]] - r["p1"][at[:-1]] <= width))])
    keep = np.r_[np.flatnonzero(~r["lone"]), at[starts]]
    last = np.r_[r["p1"][~r["lone"]], r["p1"][at[np.r_[starts[1:], len(at)] - 1]]]
    return {k: v[keep] for k, v in r.items() if k not in ("p1", "spans")} | {"p1": last, "spans": r["spans"]}


def alike_rows(r: dict[str, np.ndarray], some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some rows in the order of text, core, whole and place, and the bounds of those that share the first three.

    A line that a text repeats gives the same row again and again; such rows travel as one.
    """
    order = some[np.lexsort(tuple(r[c][some] for c in ("p0", "whole", "core", "text")))]
    text, core, whole = (r[c][order] for c in ("text", "core", "whole"))
    new = (text[1:] != text[:-1]) | (core[1:] != core[:-1]) | (whole[1:] != whole[:-1])
    return order, np.r_[np.flatnonzero(np.r_[True, new]), len(order)] if len(order) else np.zeros(1, np.int64)


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of all words (rows), and each text's bounds among the words (columns)."""
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    bounds = np.r_[0, np.cumsum(full)][offsets]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    digest = xxhash.xxh3_128_digest
    joined = b"".join([digest(w, 7) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()])
    known = np.frombuffer(joined, np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(known[coded.indices.to_numpy()].T), bounds


def sliced(texts: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Indexes of the texts with at least width words, their word hashes and bounds, a bounded number of words at once."""
    size = pc.binary_length(texts).to_numpy()
    at = 0
    while at < len(texts):
        end = max(at + 1, at + int(np.searchsorted(np.cumsum(size[at:]), SLICE_WORDS * 6)))
        ids, bounds = word_ids(texts.slice(at, end - at))
        long = np.flatnonzero(np.diff(bounds) >= width)
        if len(long):
            keep = np.zeros(len(bounds) - 1, bool)
            keep[long] = True
            sizes = np.diff(bounds)
            yield at + long, ids[:, np.repeat(keep, sizes)], np.r_[0, np.cumsum(sizes[long])]
        at = end


def bits_of(core: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    x = core.view(np.uint64)
    return (x & np.uint64(size - 1)).astype(np.int64), (mix(x) & np.uint64(size - 1)).astype(np.int64)


def build_filter(cores: DataFrame, size: int) -> np.ndarray:
    """A Bloom filter of `size` bits (two a core), made in parts on the executors."""
    part = min(size, 1 << 19)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for at in bits_of(batch.column("core").to_numpy(), size):
                np.bitwise_or.at(found, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        parts = found.reshape(-1, part // 8)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([parts[k].tobytes() for k in some], pa.binary())], ["part", "bits"])

    def together(table: pa.Table) -> pa.Table:
        out = np.zeros(part // 8, np.uint8)
        for b in table.column("bits").to_pylist():
            out |= np.frombuffer(b, np.uint8)
        return pa.table({"part": table.column("part")[:1], "bits": [out.tobytes()]})

    rows = cores.select("core").mapInArrow(run, "part long, bits binary").groupBy("part").applyInArrow(together, "part long, bits binary")
    out = np.zeros((size // part, part // 8), np.uint8)
    for r in rows.collect():  # size / 8 bytes in all
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def inside(bits: np.ndarray, core: np.ndarray) -> np.ndarray:
    found = np.ones(len(core), bool)
    for at in bits_of(core, len(bits) * 8):
        found &= (bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
    return found


def repeated_spans(docs: DataFrame, width: int, rounds: int) -> DataFrame:
    """(doc_id, row_key, spans): word spans covered by windows that also start in a smaller doc_id."""
    spark = docs.sparkSession

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id = batch.column("doc_id").to_numpy()
            for which, ids, bounds in sliced(batch.column("text").cast(pa.large_string()), width):
                r = merge_lone(window_rows(ids, bounds, width, rounds), width)
                order, edges = alike_rows(r, np.arange(len(r["p0"])))
                one = order[edges[:-1]]
                columns = [r["core"][one].view(np.int64), r["whole"][one].view(np.int64), doc_id[which[r["text"][one]]]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["core", "whole", "doc_id"])

    known = spread(docs.where("doc_id is not null and text is not null").select("doc_id", "text"))
    seen = known.mapInArrow(cores, "core long, whole long, doc_id long")
    shared = (
        seen.groupBy("core")
        .agg(*(f(c).alias(f"{n}_{c}") for c in ("doc_id", "whole") for n, f in (("least", F.min), ("most", F.max))))
        .where("least_doc_id < most_doc_id")
        .select("core", (F.col("least_whole") != F.col("most_whole")).alias("contested"))
    )
    shared = materialize(shared, "shared-cores")
    filters = []
    for part in (shared, shared.where("contested")):
        bits = 1 << max(19, (12 * part.count()).bit_length())
        filters.append(build_filter(part, min(bits, MOST_BITS)))
    sent = spark.sparkContext.broadcast(filters)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared_bits, contested_bits = sent.value
        for batch in batches:
            doc_id, row_key = batch.column("doc_id").to_numpy(), batch.column("row_key").to_numpy()
            for which, ids, bounds in sliced(batch.column("text").cast(pa.large_string()), width):
                r = merge_lone(window_rows(ids, bounds, width, rounds), width)
                order, edges = alike_rows(r, np.flatnonzero(inside(shared_bits, r["core"])))
                core, whole, text, lone = (r[c][order[edges[:-1]]] for c in ("core", "whole", "text", "lone"))
                contested = inside(contested_bits, core) & ~lone
                base = bounds[r["text"][order]]
                places = r["p0"][order] - base
                # all places of a row as spans; those that touch are one
                group = np.repeat(np.arange(len(core)), np.diff(edges))
                ends = r["p1"][order] - base + width
                begins = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (places[1:] > ends[:-1])]) if len(order) else np.zeros(0, np.int64)
                lists = np.searchsorted(begins, edges).astype(np.int32)
                starts = pa.ListArray.from_arrays(pa.array(lists), pa.array(places[begins]))
                last = np.maximum.reduceat(ends, begins) if len(begins) else ends
                stops = pa.ListArray.from_arrays(pa.array(lists), pa.array(last))
                # where classes contest a core, the hashes of the windows of one place, and all places
                one = order[edges[:-1]]
                counts = np.where(contested, r["p1"][one] - r["p0"][one] + 1, 0)
                upto = np.cumsum(counts)
                at = np.repeat(r["p0"][one] - (upto - counts), counts) + np.arange(upto[-1] if len(upto) else 0)
                windows = pa.ListArray.from_arrays(pa.array(np.r_[0, upto].astype(np.int32)), pa.array(r["spans"].hash(at, at + width).view(np.int64)))
                held = np.repeat(contested, np.diff(edges))
                kept = pa.array(np.r_[0, np.cumsum(np.where(contested, np.diff(edges), 0))].astype(np.int32))
                columns = [core.view(np.int64), whole.view(np.int64), doc_id[which[text]], row_key[which[text]]]
                arrays = [*map(pa.array, columns), starts, stops, pa.ListArray.from_arrays(kept, pa.array(places[held])), windows]
                yield pa.RecordBatch.from_arrays(arrays, ["core", "whole", "doc_id", "row_key", "starts", "ends", "places", "windows"])

    schema = "core long, whole long, doc_id long, row_key long, starts array<long>, ends array<long>, places array<long>, windows array<long>"
    keyed = known.withColumn("row_key", F.xxhash64("text")).select("doc_id", "text", "row_key")
    found = materialize(keyed.mapInArrow(rows, schema), "shared-rows")
    release(shared)
    firsts = found.groupBy("core", "whole").agg(F.min("doc_id").alias("least"))
    classed = found.join(firsts, ["core", "whole"])
    span = lambda lo, hi: F.struct(lo.alias("start"), hi.alias("end"))
    whole = classed.where("least < doc_id").select("doc_id", "row_key", F.zip_with("starts", "ends", span).alias("spans"))
    single = classed.where("least = doc_id and size(windows) > 0").select("core", "doc_id", "row_key", "places", F.posexplode("windows").alias("k", "window"))
    at = F.transform("places", lambda p: p + F.col("k")).alias("places")
    single = materialize(single.select("core", "window", "doc_id", "row_key", at), "single-windows")
    least = single.groupBy("core", "window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    late = single.join(least.select("core", "window", "least"), ["core", "window"]).where("least < doc_id")
    late = late.select("doc_id", "row_key", F.transform("places", lambda p: span(p, p + width)).alias("spans"))
    spans = whole.union(late).groupBy("doc_id", "row_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    return spans.select("doc_id", "row_key", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))


def kept_words(words: list[bytes], starts: list[int] | None, ends: list[int] | None) -> list[bytes]:
    kept, at = [], 0
    for lo, hi in zip(starts or (), ends or (), strict=True):
        if lo > at:
            kept += words[at:lo]
        at = max(at, hi)
    return kept + words[at:] if at else words


def _joined(docs: DataFrame, width: int, rounds: int, *more: str) -> tuple[DataFrame, str, str]:
    """doc_id as long, text and `more` with the starts and ends of the repeated spans, and the names of these two columns."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more)
    spans = settled("repeated-spans", lambda: repeated_spans(own.select("doc_id", "text"), width, rounds))
    doc_id, row_key, starts, ends = unused(own.columns, "of_doc", "of_row", "starts", "ends")
    spans = spans.toDF(doc_id, row_key, starts, ends)
    found = own.join(spans, (F.col("doc_id") == F.col(doc_id)) & (F.xxhash64("text") == F.col(row_key)), "left")
    return found.drop(doc_id, row_key), starts, ends


def dedup_report(docs: DataFrame, width: int = 50, rounds: int = 3) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    A word goes if a window of `width` words over it also starts in a document with a smaller doc_id. A null
    text has no words. Rows with one doc_id never remove from each other; a null doc_id is not smaller or
    larger than any, so such rows keep all words. An empty table stays empty; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                kept = kept_words(words, starts, ends)
                out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, types, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256"]
            )

    found, starts, ends = _joined(docs, width, rounds)
    found = found.select("doc_id", "text", starts, ends)
    return found.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_texts(docs: DataFrame, width: int = 50, rounds: int = 3) -> DataFrame:
    """The documents with repeated words cut out of the text; n_chars follows where the column exists.

    A text that loses no word stays as it is, white space included; others keep the text between removed words.
    Every row stays, also one whose text loses all its words, and keeps its other columns, whatever their names and
    types. A null text stays null; a null doc_id takes no part; rows with one doc_id never remove from each other; an
    empty table stays empty.
    """
    kept = docs.columns
    found, starts, ends = _joined(docs, width, rounds, *[f"`{c}`" for c in kept if c not in ("doc_id", "text")])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        for i, (lo, hi) in enumerate(zip(batch.column(starts).to_pylist(), batch.column(ends).to_pylist(), strict=True)):
            if lo:
                texts[i] = cut_text(texts[i], lo, hi)
        return batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    out = map_whole_rows(found, cut, (starts, ends)).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    if "n_chars" in kept:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in kept])


def cut_text(text: str, starts: list[int], ends: list[int]) -> str:
    words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    parts, at = [], 0
    for lo, hi in zip(starts, ends, strict=True):
        if lo > at:
            parts.append(text[words[at][0] : words[lo - 1][1]])
        at = max(at, hi)
    if at < len(words):
        parts.append(text[words[at][0] : words[-1][1]])
    return "\n".join(parts)
