"""SimHash near-duplicates with BK-trees.

Every text has a 64-bit fingerprint; equal fingerprints are collapsed first, so copies cost one row. Two
fingerprints within `radius` differing bits agree on `agree` of `radius + agree` blocks, whichever the bits;
so each fingerprint joins the shard of every choice of blocks, and a shard holds all that share those bits.
A shard is searched with a BK-tree: a child hangs at its integer Hamming distance from its parent, and a
search follows only edges within the radius. The trees are built where their shard lies and are not sent
about, since all fingerprints together have no size bound. A subtree already known to lie in the searched
fingerprint's component is passed over, so a crowd of near copies costs about linear time and gives a
spanning set of links, never all pairs. Shards over `heavy` rows are cut again by the remaining bits, level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, materialize, release, settled, small_batches, spread

HEAVY = 20_000
#: Keys of crowded shards (8 bytes each) are sent to all tasks up to this count; masks of cut shards are constants of a plan.
BROADCAST_KEYS, MOST_MASKS = 500_000, 5000


def fingerprint(text: str, words: int) -> int:
    """Unsigned: each bit set in over half of the shingles' XXH64 (seed 42); shingles repeat as they occur.

    ASCII letters are lowered, words are split at ASCII white space; fewer words are one shingle, none give 0.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_digest
    if len(parts) <= words:
        return int.from_bytes(digest(b" ".join(parts), 42))
    hashes = b"".join([digest(b" ".join(s), 42) for s in zip(*(parts[k:] for k in range(words)), strict=False)])
    n = len(hashes) // 8
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        bits = np.unpackbits(np.frombuffer(hashes[8 * at : 8 * (at + 4096)], np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes())


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py() or "", words) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, fp long")


def block_masks(bits: list[int], blocks: int, agree: int) -> list[int]:
    """A mask for each choice of `agree` of `blocks` runs of these bit positions, as signed longs."""
    runs = [sum(1 << int(b) for b in part) for part in np.array_split(np.array(bits), blocks)]
    masks = [sum(choice) for choice in combinations(runs, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (positions) that span the components of values within radius, from one BK-tree. Values differ."""
    boss = list(range(len(values)))
    children: list[dict[int, int]] = []
    alike: list[int] = []  # a member of the one component that a node's whole subtree lies in, or -1
    links = []

    def find(x: int) -> int:
        while boss[x] != x:
            boss[x] = boss[boss[x]]
            x = boss[x]
        return x

    for i, value in enumerate(values):
        stack = [0] if i else []
        while stack:
            node = stack.pop()
            if alike[node] >= 0 and find(alike[node]) == find(i):
                continue
            d = (value ^ values[node]).bit_count()
            if d <= radius and (a := find(node)) != (b := find(i)):
                boss[max(a, b)] = min(a, b)
                links.append((i, node))
            stack += [c for e, c in children[node].items() if d - radius <= e <= d + radius]
        path, node = [], 0
        while i:
            path.append(node)
            d = (value ^ values[node]).bit_count()
            if d not in children[node]:
                children[node][d] = i
                break
            node = children[node][d]
        children.append({})
        alike.append(i)
        for node in reversed(path):
            root = find(node)
            alike[node] = root if all(alike[c] >= 0 and find(alike[c]) == root for c in children[node].values()) else -1
    return links


def shard_links(shards: DataFrame, radius: int) -> DataFrame:
    """Spanning links (u, v) of each shard; shards has key and fp and is dealt and sorted by key here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last group may go on
            if last:
                yield links_of(*(np.concatenate(c) for c in zip(*held, (key[:last], fp[:last]), strict=True)))
                held = []
            if len(key):
                held.append((key[last:], fp[last:]))
        if held:
            yield links_of(*(np.concatenate(c) for c in zip(*held, strict=True)))

    def links_of(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(key)])
        twos = starts[sizes == 2]
        near = np.bitwise_count((fp[twos] ^ fp[twos + 1]).view(np.uint64)) <= radius
        u, v = [fp[twos][near]], [fp[twos + 1][near]]
        for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            group = fp[at : at + n]
            links = tree_links(group.view(np.uint64).tolist(), radius)
            if links:
                pairs = np.array(links)
                u.append(group[pairs[:, 0]])
                v.append(group[pairs[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    return shards.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "u long, v long")


def shards(rows: DataFrame, masks: list[int], radius: int, heavy: int, levels: int = 3) -> DataFrame:
    """The rows (with a column fp) once for each mask, with key, the shard of what agrees on the mask's bits.

    A shard of over `heavy` rows is dealt again by each of radius + 1 runs of the bits that its rows do not share yet:
    rows within the radius agree on one of them, so whatever meets in a shard still meets. That goes on level by level.
    """
    carried = rows.columns
    deal = lambda df, *more: df.select(*carried, "t", F.xxhash64(*more, F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    dealt = deal(rows.select(*carried, F.posexplode(F.array(*map(F.lit, masks))).alias("t", "mask")), "t")
    shared, out = list(masks), None  # by t: the bits that agree
    for level in range(levels):
        crowded = materialize(dealt.groupBy("key").count().where(F.col("count") > heavy).select("key"), "crowded-shards")
        n = crowded.count()
        if not n:
            release(crowded)
            break
        if n <= BROADCAST_KEYS:  # else both joins shuffle
            crowded = F.broadcast(crowded)
        runs = [block_masks([b for b in range(64) if not m >> b & 1], radius + 1, 1) for m in shared]
        light = dealt.join(crowded, "key", "left_anti").select(*carried, "key")
        out = light if out is None else out.union(light)
        choice = F.posexplode(F.element_at(F.array(*[F.array(*map(F.lit, r)) for r in runs]), F.col("t") + 1)).alias("s", "mask")
        cut = dealt.join(crowded, "key", "left_semi").select(*carried, "t", "key", choice)
        cut = cut.withColumn("t", F.col("t") * (radius + 1) + F.col("s"))
        dealt = deal(cut, "key", "t")
        shared = [m | x for m, r in zip(shared, runs, strict=True) for x in r]
        if len(shared) > MOST_MASKS or min((~m & (1 << 64) - 1).bit_count() for m in shared) <= radius:
            break
    dealt = dealt.select(*carried, "key")
    return dealt if out is None else out.union(dealt)


def fingerprint_components(fps: DataFrame, radius: int = 3, agree: int = 2, heavy: int = HEAVY) -> DataFrame:
    """(fp, root) for every different fp of a column fp: root is shared by all that chains of links reach."""
    different = materialize(fps.select("fp").distinct(), "fingerprints")
    masks = block_masks(list(range(64)), radius + agree, agree)
    links = shard_links(shards(different, masks, radius, heavy), radius)
    found = connected_components(links).withColumnsRenamed({"node": "fp", "component": "root"})
    return different.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach).

    A null text counts as empty, and all texts without words share fingerprint zero. Repeated rows are
    linked like any copies; a component of null ids only has a null id; an empty table stays empty.
    """
    fps = materialize(fingerprints(docs, words), "document-fingerprints")
    roots = settled("roots", lambda: fingerprint_components(fps, radius))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    known = least.join(roots, "fp")
    groups = known.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = known.join(groups, "root").select("fp", "component_id")
    named = fps.join(by_fp, "fp")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
