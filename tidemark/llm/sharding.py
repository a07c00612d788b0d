"""Balanced shards of indivisible groups by Karmarkar-Karp differencing.

Rows with equal texts form a group that may not be divided. Groups of at least total / (2 * bundles) bytes
are items of their own, so there are at most 2 * bundles of them; all lighter groups fall by digest into
`bundles` bundles. Only these at most 3 * bundles items, whatever the table's size, reach the driver, where
differencing combines the two partial partitions with the largest spread in opposite order until one is left.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, salted_rank

BUNDLES = 8192


def karmarkar_karp(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item. Ties go to the item that comes first; no items give no shards."""
    if not sizes:
        return []
    parent: list[tuple[int, int] | None] = [None] * len(sizes)
    heap = []
    for i, s in enumerate(sizes):
        loads = [s] + [0] * (shards - 1)  # descending
        heap.append((-s, i, loads, [i] + [-1] * (shards - 1)))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, la, na = heapq.heappop(heap)
        _, _, lb, nb = heapq.heappop(heap)
        merged = []
        for k in range(shards):
            a, b = na[k], nb[shards - 1 - k]
            if a < 0 or b < 0:
                node = max(a, b)
            else:
                node = len(parent)
                parent.append((a, b))
            merged.append((la[k] + lb[shards - 1 - k], node))
        merged.sort(key=lambda x: -x[0])
        least = merged[-1][0]
        loads = [x[0] - least for x in merged]
        heapq.heappush(heap, (-loads[0], serial, loads, [x[1] for x in merged]))
        serial += 1
    out = [0] * len(sizes)
    for shard, node in enumerate(heap[0][3]):
        stack = [node] if node >= 0 else []
        while stack:
            x = stack.pop()
            if parent[x] is None:
                out[x] = shard
            else:
                stack += parent[x]
    return out


def shard_documents(docs: DataFrame, shards: int, bundles: int = BUNDLES) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    size is the text's UTF-8 bytes plus 8; a null text has none and groups with empty ones. A group that
    outweighs a fair share has a shard nearly to itself. slot is gapless from 0 in each shard. Repeated
    rows are rows of their own; null ids keep a slot; other columns are ignored; an empty table stays empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.md5(text).alias("digest"),
        ),
        "shard-rows",
    )
    whole = base.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    groups = base.groupBy("digest").agg(F.sum("size").alias("size"))
    bundle = F.pmod(F.xxhash64("digest"), F.lit(bundles)).cast("int")
    heavy = F.col("size") * (2 * bundles) >= F.lit(whole.bytes)
    items = groups.select(F.when(heavy, F.col("digest")).alias("digest"), bundle.alias("bundle"), "size")
    items = items.groupBy("digest", F.when(F.col("digest").isNull(), F.col("bundle")).alias("bundle")).agg(F.sum("size").alias("size"))
    found = sorted(items.collect(), key=lambda r: (-r["size"], r["digest"] or "", r["bundle"] if r["bundle"] is not None else -1))
    placed = karmarkar_karp([r["size"] for r in found], shards)
    spark = docs.sparkSession
    big = spark.createDataFrame(
        [(r["digest"], s) for r, s in zip(found, placed, strict=True) if r["digest"] is not None], "digest string, big_shard int"
    )
    small = spark.createDataFrame(
        [(r["bundle"], s) for r, s in zip(found, placed, strict=True) if r["digest"] is None], "bundle int, small_shard int"
    )
    dealt = (
        base.withColumn("bundle", bundle)
        .join(F.broadcast(big), "digest", "left")
        .join(F.broadcast(small), "bundle", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("big_shard", "small_shard").alias("shard"))
    )
    ranked = salted_rank(dealt, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], F.struct("doc_id", "text_crc32"), whole.n, "slot")
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
