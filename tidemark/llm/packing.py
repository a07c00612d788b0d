"""Cutting-stock packing of token sequences by column generation.

A document is cut into full sequences and one remainder. Remainder lengths, rounded up to `grain` tokens,
form a histogram of at most capacity / grain classes. A linear program over patterns (multisets of classes
that fit a sequence) is solved by column generation: the simplex duals price the classes, and an unbounded
knapsack dynamic program finds the pattern that improves most. Patterns are taken the rounded-down number of
times; the few left-over pieces, a number that depends on the classes and not on the corpus, go first-fit by
falling length. Pieces, ranked within their class over salts, then take the patterns' places.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import Generations, materialize, salted_rank, small_batches, spread


def price(duals: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """The best pattern for these duals: its value and how often it holds each class 1..units."""
    best, pick = np.zeros(units + 1), np.zeros(units + 1, np.int64)
    for c in range(1, units + 1):
        values = duals[:c] + best[c - 1 :: -1]
        k = int(values.argmax())
        if values[k] > best[c - 1]:
            best[c], pick[c] = values[k], k + 1
        else:
            best[c], pick[c] = best[c - 1], 0
    pattern, c = np.zeros(units, np.int64), units
    while c:
        if pick[c]:
            pattern[pick[c] - 1] += 1
            c -= pick[c]
        else:
            c -= 1
    return float(best[units]), pattern


def solve_patterns(counts: np.ndarray, units: int, rounds: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often the linear program uses each. counts[i] pieces have length i + 1 units."""
    used = np.flatnonzero(counts)
    m = len(used)
    if not m:
        return []
    demand = counts[used].astype(float)
    basis = np.zeros((m, units), np.int64)
    for r, k in enumerate(used):
        basis[r, k] = units // (k + 1)
    inverse = np.diag(1.0 / basis[np.arange(m), used])
    level = inverse @ demand
    for step in range(rounds):
        duals = np.zeros(units)
        duals[used] = np.maximum(0.0, inverse.sum(axis=0))
        value, pattern = price(duals, units)
        if value <= 1 + 1e-7:
            break
        column = inverse @ pattern[used]
        able = column > 1e-9
        if not able.any():
            break
        ratio = np.full(m, np.inf)
        ratio[able] = level[able] / column[able]
        r = int(ratio.argmin())
        inverse[r] /= column[r]
        level[r] /= column[r]
        others = np.arange(m) != r
        inverse[others] -= np.outer(column[others], inverse[r])
        level[others] -= column[others] * level[r]
        basis[r] = pattern
        if step % 200 == 199:  # against drift
            inverse = np.linalg.inv(basis[:, used].T.astype(float))
            level = inverse @ demand
        level = np.maximum(level, 0)
    return [(basis[r], float(level[r])) for r in range(m) if level[r] > 1e-9]


def plan_sequences(counts: np.ndarray, units: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that hold each piece exactly once."""
    left = counts.astype(np.int64).copy()
    plan: list[tuple[np.ndarray, int]] = []
    for pattern, level in sorted(solve_patterns(counts, units), key=lambda x: -x[1]):
        held = pattern > 0
        times = min(int(level + 1e-6), int((left[held] // pattern[held]).min()))
        if times > 0:
            plan.append((pattern, times))
            left -= pattern * times
    while left.any():  # first fit by falling length, on the histogram
        pattern, room = np.zeros(units, np.int64), units
        for k in range(units - 1, -1, -1):
            n = min(int(left[k]), room // (k + 1))
            if n:
                pattern[k] = n
                room -= n * (k + 1)
        held = pattern > 0
        times = int((left[held] // pattern[held]).min())
        plan.append((pattern, times))
        left -= pattern * times
    return plan


#: A Latin word with marks behind it: the vocabulary's pattern cuts it right there and nowhere else.
_simple = re.compile("([A-Za-z\u00c0-\u024f]+)([.,;:!?#$%&*|-]*)")


@lru_cache(maxsize=2)
def chunk_ids(path: str) -> Generations:
    """Ids of white-space-free chunks as little-endian bytes; the library encodes each word once.

    Words in Latin letters go to the library many in one text, without regard to case, which the vocabulary
    drops; every word then ends with a word-end token, by which the ids are told apart. Other chunks go alone.
    """
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    ends = np.zeros(library.get_vocab_size(with_added_tokens=True) + 1, bool)
    ends[[i for t, i in library.get_vocab().items() if t.endswith("</w>")]] = True

    def alone(chunks: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in library.encode_batch_fast(chunks, add_special_tokens=False)]

    def together(words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        parts = [words[k : k + 400] for k in range(0, len(words), 400)]
        for part, e in zip(parts, library.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            cuts = np.flatnonzero(ends[ids]) + 1
            if len(cuts) != len(part):
                out += alone(part)
                continue
            data, bounds = ids.tobytes(), (4 * np.r_[0, cuts]).tolist()
            out += [data[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]
        return out

    words, others = Generations(together, 150_000), Generations(alone, 150_000)

    def encode(chunks: list[str]) -> list[bytes]:
        cut = [m if (m := _simple.fullmatch(c)) and m[1].isalpha() and "\u0130" not in c else None for c in chunks]
        heads = list({m[1].lower() for m in cut if m})
        rest = list({m[2] if m else c for m, c in zip(cut, chunks, strict=True)} - {""})
        head_ids, rest_ids = dict(zip(heads, words.many(heads), strict=True)), dict(zip(rest, others.many(rest), strict=True))
        rest_ids[""] = b""
        return [head_ids[m[1].lower()] + rest_ids[m[2]] if m else rest_ids[c] for m, c in zip(cut, chunks, strict=True)]

    return Generations(encode, 100_000)


def encode_texts(texts: pa.Array, vocabulary: str) -> tuple[memoryview, np.ndarray]:
    """All ids of the texts in one buffer, and each text's bounds in it, in bytes.

    This vocabulary drops white space and no token crosses it, so the chunks between can be encoded apart.
    """
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    known = pa.array(chunk_ids(vocabulary).many(coded.dictionary.to_pylist()), pa.large_binary())
    joined = known.take(coded.indices)
    ends = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, joined.offset * 8) if len(joined) else np.zeros(1, np.int64)
    return memoryview(joined.buffers()[2] or b""), ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32, doc_tokens."""
    small_batches(docs.sparkSession)
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in batches:
            rows: list[tuple] = []
            ids, bounds = encode_texts(pc.fill_null(batch.column("text").cast(pa.large_string()), ""), vocabulary)
            for doc_id, lo, hi in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                n = (hi - lo) // 4 + 1
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    crc = zlib.crc32(ids[lo + 4 * start : min(hi, lo + 4 * (start + length))])
                    rows.append((doc_id, start, length, zlib.crc32(end, crc) if start + length == n else crc, n))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 4096, grain: int = 8) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the single id end_id. Each row is packed on its own, also when it repeats
    another; null ids are kept; an empty table gives no pieces; other columns are ignored.
    """
    spark, units = docs.sparkSession, capacity // grain
    pieces = materialize(token_pieces(docs, vocabulary, end_id, capacity), "pieces")
    classed = pieces.withColumn("class", F.ceil(F.col("length") / grain).cast("int"))
    counts = np.zeros(units, np.int64)
    for r in classed.groupBy("class").count().collect():  # at most capacity / grain rows
        counts[r["class"] - 1] = r["count"]
    places, first, taken = [], 0, np.zeros(units, np.int64)
    for p, (pattern, times) in enumerate(plan_sequences(counts, units)):
        for k in np.flatnonzero(pattern):
            places.append((int(k) + 1, int(taken[k]), int(pattern[k]), first))
            taken[k] += int(pattern[k]) * times
        first += times
    # one row a class and pattern: which ranks of the class it takes, how many a sequence, its first sequence
    table = spark.createDataFrame(places, "class int, from_rank long, per_sequence int, first_sequence long")
    spans = table.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("from_rank", "per_sequence", "first_sequence"))).alias("spans"))
    order = [F.col(c) for c in ("length", "doc_id", "start", "ids_crc32")]
    ranked = salted_rank(classed, ["class"], order, F.struct("doc_id", "start", "ids_crc32"), int(counts.sum()), "rank")
    at = F.element_at(F.filter("spans", lambda s: s["from_rank"] <= F.col("rank")), -1)
    placed = (
        ranked.join(F.broadcast(spans), "class")
        .withColumn("at", at)
        .withColumn("sequence_id", F.col("at.first_sequence") + F.floor((F.col("rank") - F.col("at.from_rank")) / F.col("at.per_sequence")))
    )
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long").alias("sequence_id"),
        F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"),
    )
