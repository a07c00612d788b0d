"""Benchmark decontamination by the q-gram lemma.

Texts and items are folded: lower case, white space as single spaces. An item of m characters may be changed
by up to e = m // 10 - 1 edits. Cut into e + 1 parts, one part of at least ten characters must then stand
unchanged in the text; such seeds, found by one rolling hash over every text, place an item near a diagonal.
Around it the shared q-grams are counted in overlapping bands of diagonals; by the lemma a region within e
edits shares at least m + 1 - q - q * e of them within one band. What meets the bound is verified by banded
alignment. No step can lose a region within the budget.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_whole_rows, small_batches, spread

SEED, Q = 10, 6
#: Characters of items that one pass over the documents carries along; more items take more passes.
BLOCK_CHARS = 4_000_000
SLICE_CHARS = 2_000_000
#: Hits of seeds that are looked at together.
HITS = 1_000_000
BASE, MIX = np.uint64(0xD1342543DE82EF95), np.uint64(0x9E3779B97F4A7C15)


def fold(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(code: np.ndarray, q: int) -> np.ndarray:
    """A hash of every q characters, by doubling."""
    n = len(code) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, width, power, done = None, 1, np.array([BASE]), 0
    step = code.astype(np.uint64) * MIX
    while True:
        if q >> width.bit_length() - 1 & 1:
            if out is None:
                out, shift = step, power
            else:
                out = out[: len(step) - done] + shift * step[done : len(out) + done][: len(step) - done]
                shift = shift * power
            done += width
        width *= 2
        if width > q:
            return out[:n] * MIX
        step = step[: -(width // 2)] + power * step[width // 2 :]
        power = power * power


def budget(m: int) -> int:
    return max(0, m // SEED - 1)


def banded_distance(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int] | None:
    """Least edits that turn the item into some part of text, with (edits, end), on diagonals low..high; None over most.

    A diagonal is the place in text minus the place in the item; the part may begin on any of them.
    """
    width, big = high - low + 1, 1 << 20
    places = np.arange(width) + low
    row = np.where((places >= 0) & (places <= len(text)), 0, big)
    ramp = np.arange(width)
    for i in range(1, len(item) + 1):
        at = places + i  # columns reached
        ok = (at >= 1) & (at <= len(text))
        same = np.zeros(width, bool)
        same[ok] = text[at[ok] - 1] == item[i - 1]
        new = np.where(ok, row + ~same, big)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)  # a character of the item left out
        new[(at < 0) | (at > len(text))] = big
        row = np.minimum.accumulate(new - ramp) + ramp  # characters of the text put in
        row[(at < 0) | (at > len(text))] = big
        if row.min() > most:
            return None
    k = int(row.argmin())
    return int(row[k]), int(places[k] + len(item))


class Items:
    """A block of benchmark items with their seeds."""

    def __init__(self, rows: list[tuple]):
        self.ids, self.texts = [], []
        for item_id, text in rows:
            if folded := fold(text):
                self.ids.append(item_id)
                self.texts.append(folded)
        self.codes = [codes(t) for t in self.texts]
        self.grams = [grams(c, Q) for c in self.codes]
        self.short = [k for k, t in enumerate(self.texts) if len(t) < SEED]
        seeds, owner, place = [], [], []
        for k, c in enumerate(self.codes):
            if len(c) >= SEED:
                parts = budget(len(c)) + 1
                starts = (np.arange(parts) * len(c)) // parts
                seeds.append(grams(c, SEED)[starts])
                owner += [k] * parts
                place += starts.tolist()
        found = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(found, kind="stable")
        self.seeds, self.owner, self.place = found[order], np.array(owner, np.int64)[order], np.array(place, np.int64)[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.seeds >> np.uint64(42)).astype(np.int64)] = True

    def seeded(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in code, first seed, seeds): the places that have a seed, and where its items stand among the seeds."""
        h = grams(code, SEED)
        at = np.flatnonzero(self.bits[(h >> np.uint64(42)).astype(np.int64)])
        lo, hi = np.searchsorted(self.seeds, h[at], "left"), np.searchsorted(self.seeds, h[at], "right")
        some = hi > lo
        return at[some], lo[some], (hi - lo)[some]

    def hits(self, at: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in code, item, diagonal) of every seed at these places."""
        at, ends = np.repeat(at, n), np.cumsum(n)
        which = np.repeat(lo - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        return at, self.owner[which], at - self.place[which]

    def regions(self, text: str, code: np.ndarray, items: np.ndarray, diagonals: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item, start or -1 where only the end is known, end, edits) of the best region of each item that has one."""
        order = np.lexsort((diagonals, items))
        items, diagonals = items[order], diagonals[order]
        found, edges = np.unique(items, return_index=True)
        for k, a, z in zip(found.tolist(), edges.tolist(), np.r_[edges, len(items)][1:].tolist(), strict=True):
            item, own = self.codes[k], diagonals[a:z]
            m, e = len(item), budget(len(item))
            at = text.find(self.texts[k])
            if at >= 0:
                yield k, at, at + m, 0
                continue
            best = None
            bound = m + 1 - Q - Q * e
            tried = -(1 << 60)
            for d in np.unique(own).tolist():
                if d - e <= tried:
                    continue  # the band before covers it
                # each seed's diagonal is at most e off the region's others; bands of 4e + 1 overlap by half
                low, high = d - e, d + 3 * e
                tried = d + e
                a, z = max(0, low), min(len(code), high + m)
                if self.shared(k, code[a:z], low - a, high - a) < bound:
                    continue
                found = banded_distance(item, code[a:z], low - a, high - a, e)
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], found[1] + a)
            if best:
                yield k, -1, best[1], best[0]

    def shared(self, k: int, region: np.ndarray, low: int, high: int) -> int:
        """The item's q-grams that the region has on the diagonals low..high."""
        own, theirs = self.grams[k], grams(region, Q)
        if not len(theirs):
            return 0
        order = np.argsort(theirs, kind="stable")
        ranked = theirs[order]
        lo, hi = np.searchsorted(ranked, own, "left"), np.searchsorted(ranked, own, "right")
        n = hi - lo
        place = np.repeat(np.arange(len(own)), n)
        ends = np.cumsum(n)
        which = np.repeat(lo - (ends - n), n) + np.arange(ends[-1])
        diagonal = order[which] - place
        return len(np.unique(place[(diagonal >= low) & (diagonal <= high)]))

    def leaks(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) for the texts, in order."""
        folded = [fold(t) for t in texts]
        at = 0
        while at < len(folded):
            end, size = at, 0
            while end < len(folded) and (end == at or size + len(folded[end]) <= SLICE_CHARS):
                size += len(folded[end]) + 1
                end += 1
            part = folded[at:end]
            starts = np.cumsum([0] + [len(t) + 1 for t in part])
            code = codes("\n".join(part))  # folded texts have no line feed
            place, first, count = self.seeded(code)
            doc = np.searchsorted(starts, place, "right") - 1
            cuts = np.searchsorted(doc, np.arange(len(part) + 1))  # of each text's places
            total = np.r_[0, np.cumsum(count)]
            for i in np.unique(doc).tolist() if not self.short else range(len(part)):
                own = code[starts[i] : starts[i] + len(part[i])]
                pairs = np.zeros((0, 2), np.int64)
                a, z = int(cuts[i]), int(cuts[i + 1])
                while a < z:  # common seeds have many items: a bounded number of hits at once, alike ones once
                    stop = min(z, max(a + 1, int(np.searchsorted(total, total[a] + HITS, "right")) - 1))
                    s = slice(a, stop)
                    _, item, diagonal = self.hits(place[s] - starts[i], first[s], count[s])
                    pairs = np.unique(np.r_[pairs, np.c_[item, diagonal]], axis=0)
                    a = stop
                for k, a, z, edits in self.regions(part[i], own, pairs[:, 0], pairs[:, 1]):
                    yield at + i, k, a, z, edits
                for k in self.short:
                    if f" {self.texts[k]} " in f" {part[i]} ":
                        a = f" {part[i]} ".index(f" {self.texts[k]} ")
                        yield at + i, k, a, a + len(self.texts[k]), 0
            at = end


def item_blocks(benchmark: DataFrame) -> list:
    """The benchmark in blocks of bounded size, each broadcast."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    spark = benchmark.sparkSession
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield spark.sparkContext.broadcast(Items(sorted(map(tuple, part.collect()), key=str)))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document row and benchmark item found in it: doc_id, item_id, end_char, edits, exact.

    end_char is where the best region ends in the folded text. Items of fewer than ten characters must stand
    as whole words. Null or empty texts and items match nothing; repeated rows repeat; ids may be null.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, item_id long, end_char long, edits int, exact boolean"
    out = docs.sparkSession.createDataFrame([], schema)
    own = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    for sent in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[i], items.ids[k], z, e, e == 0) for i, k, _, z, e in items.leaks(batch.column("text").to_pylist())]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "end_char", "edits", "exact"]
                )

        out = out.union(own.mapInArrow(run, schema))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item is found, with all their columns.

    A null or empty text holds no item, so its row stays, as do rows with a null id; rows that repeat go or stay
    alike. Other columns are untouched, whatever their names. Without items all documents stay; an empty table
    stays empty.
    """
    small_batches(docs.sparkSession)
    docs = spread(docs)
    for sent in item_blocks(benchmark):

        def clean(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            keep = np.ones(batch.num_rows, bool)
            for i, *_ in sent.value.leaks(batch.column("text").to_pylist()):
                keep[i] = False
            return batch.filter(pa.array(keep))

        docs = map_whole_rows(docs, clean)
    return docs
