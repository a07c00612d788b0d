"""SimHash near-duplicates of a wide radius, each link confirmed exactly on five-word shingles.

SimHash of five-word shingles spreads texts of similarity 0.8 over some ten bits, too far for shards of
agreeing bits. Two-word shingles change less by scattered edits: such texts differ in six bits, give or take 2.4,
unrelated ones rarely in under fifteen. So candidates are found by the fingerprint of a text's different
two-word shingles. Blocks make sure of links within eight bits (`sure`); texts up to twelve bits apart
(`radius`) still agree on two of the ten blocks nine times in ten. An appended, inserted or cut-off passage
changes two-word shingles as much as five-word ones and moves the fingerprint farther. So texts are candidates
too where a band of minima of their five-word shingles agrees, which depends on similarity alone. 
A sketch of the five-word shingles, 256 one-bit minima of which a fraction (1 - similarity) / 2 differ on
average, travels with the fingerprint and drops candidates far from alike where they are found. What is left
proposes groups. In each the texts meet again, and only pairs whose different five-word shingles really have the
similarity link. A group is larger than what its links join, so no link is missed for one that failed: in small
groups all texts meet; in large ones each text first meets two of its candidates, for some rounds, and only texts
that are then still apart from the body of their group meet all of it.

A shard's BK-tree is cut by integer Hamming distance to pivots down to leaves that are compared as arrays.
Queries go down in blocks, along edges within the radius. A leaf that lies in one component drops the
queries of this component, so a crowd of near copies gives a spanning set of links and never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, materialize, settled, small_batches, spread, unused
from tidemark.llm.near_dedup import block_masks, shards

SKETCH_BITS = 256
#: Texts of similarity 0.8 agree in none of 24 bands of 4 minima once in 300,000 pairs, wherever their edits lie.
BANDS, BAND = 24, 4
#: Texts of similarity 0.8 differ in 25.6 of 256 bits, give or take 4.8: over five times that is allowed.
SKETCH_SLACK = 25
#: Texts are compared block against block, each pair of blocks in a task of its own. Groups of at most SMALL blocks
#: are compared whole, so no text is sent more than SMALL times; larger ones link by candidates in ROUNDS first.
BLOCK, SMALL, ROUNDS = 1000, 4, 3
LEAF, QUERIES, HEAVY = 512, 64, 20_000
_random = np.random.default_rng(20)
_FLIPS = _random.integers(0, 1 << 32, SKETCH_BITS, dtype=np.uint32)[:, None]
_FACTORS = (_random.integers(0, 1 << 31, SKETCH_BITS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """The different XXH64 (seed 42) of the shingles; fewer words are one shingle, none give none."""
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        return np.frombuffer(digest(b" ".join(words), 42), ">u8").astype(np.uint64)
    joined = b"".join([digest(b" ".join(s), 42) for s in zip(*(words[k:] for k in range(width)), strict=False)])
    return np.unique(np.frombuffer(joined, ">u8").astype(np.uint64))


def simhash(hashes: np.ndarray) -> int:
    """Each bit is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes())


def minima(hashes: np.ndarray) -> np.ndarray:
    """256 minima over the hashes, each in an order of its own."""
    least = np.full(SKETCH_BITS, 0xFFFFFFFF, np.uint32)
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(low), 2048):
        part = (low[None, at : at + 2048] ^ _FLIPS) * _FACTORS
        np.minimum(least, part.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> list[int]:
    """One key for each band of the minima; equal minima of a band give equal keys."""
    raw, step = least[: BANDS * BAND].astype("<u4").tobytes(), BAND * 4
    keys = [xxhash.xxh64_intdigest(raw[t * step : (t + 1) * step], t) for t in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def sketch(hashes: np.ndarray) -> bytes:
    """One bit of each of 256 minima over the hashes; zero without hashes."""
    return sketch_bits(minima(hashes)) if len(hashes) else bytes(SKETCH_BITS // 8)


def sketch_bits(least: np.ndarray) -> bytes:
    least = least ^ least >> np.uint32(15)
    least *= np.uint32(0x2C1B3C6D)  # any odd factor: the top bit then depends on all bits of the minimum
    least ^= least >> np.uint32(13)
    least *= np.uint32(0x297A2D39)
    return np.packbits(least >> np.uint32(31)).tobytes()


def words_of(text: str) -> list[bytes]:
    """ASCII letters are lowered, words are split at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def outline(text: str, find_width: int, like_width: int) -> tuple[int, int, bytes, list[int]]:
    """The hash of the text's different shingles, their sketch and band keys, and between them its fingerprint."""
    words = words_of(text)
    like = shingle_hashes(words, like_width)
    least = minima(like)
    node = xxhash.xxh64_intdigest(like.tobytes(), 42)
    return node, simhash(shingle_hashes(words, find_width)), sketch_bits(least) if len(like) else sketch(like), band_keys(least)


def sketch_limit(similarity: float) -> int:
    """How many bits of two sketches may differ for their texts to be compared."""
    return int(SKETCH_BITS * (1 - similarity) / 2) + SKETCH_SLACK


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def grow(values: np.ndarray) -> list:
    """A BK-tree as nested lists: [pivot, {distance: child}] or an array of positions."""
    root: list = [None, {0: np.arange(len(values))}]
    todo = [(root, 0)]
    while todo:
        above, edge = todo.pop()
        at = above[1][edge]
        if len(at) <= LEAF:
            continue
        d = bits_apart(values[at], values[at[0]])
        if not d.any():  # equal fingerprints stay together
            continue
        node = [int(at[0]), {int(e): at[d == e] for e in np.unique(d)}]
        above[1][edge] = node
        todo += [(node, e) for e in node[1]]
    return root[1][0]


def tree_links(values: np.ndarray, sketches: np.ndarray, radius: int, limit: int) -> list[tuple[int, int]]:
    """Links (positions) that span the components of a shard: within radius bits and limit bits of the sketch."""
    boss = np.arange(len(values))
    links: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while boss[x] != x:
            boss[x] = boss[boss[x]]
            x = int(boss[x])
        return x

    def compare(queries: np.ndarray, leaf: np.ndarray) -> None:
        home = boss[leaf]
        for start in range(0, len(leaf), LEAF):
            near, of = leaf[start : start + LEAF], home[start : start + LEAF]
            mine = queries if (of != of[0]).any() else queries[boss[queries] != of[0]]
            if not len(mine):
                continue
            hit = bits_apart(values[mine][:, None], values[near][None, :]) <= radius
            q, m = np.nonzero(hit & (near[None, :] < mine[:, None]) & (boss[mine][:, None] != of[None, :]))
            q, m = mine[q], near[m]
            like = bits_apart(sketches[q], sketches[m]).sum(axis=1) <= limit
            for a, b in zip(q[like].tolist(), m[like].tolist(), strict=True):
                x, y = find(a), find(b)
                if x != y:
                    boss[max(x, y)] = min(x, y)
                    links.append((a, b))

    tree = grow(values)
    for start in range(0, len(values), QUERIES):
        stack = [(tree, np.arange(start, min(start + QUERIES, len(values))))]
        while stack:
            node, queries = stack.pop()
            if isinstance(node, np.ndarray):
                compare(queries, node)
                continue
            d = bits_apart(values[queries], values[node[0]]).astype(int)
            stack += [(c, some) for e, c in node[1].items() if len(some := queries[abs(d - e) <= radius])]
        while (boss[boss] != boss).any():
            boss = boss[boss]
    return links


def shard_links(dealt: DataFrame, radius: int, limit: int) -> DataFrame:
    """Spanning links (u, v) of each shard of key, node, fp and sketch; dealt and sorted by key here."""

    def links_of(key: np.ndarray, node: np.ndarray, fp: np.ndarray, sk: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(key)])
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        # Small shards side by side: each row against the next ones of its shard, no tree is worth its while.
        # reach[x] is a row that links found so far lead to from x: rows of one reach need no further link.
        small, reach = np.repeat(sizes <= QUERIES, sizes), np.arange(len(key))
        for step in range(1, min(QUERIES, int(sizes.max(initial=1)))):
            a = np.flatnonzero(small[step:] & (key[step:] == key[:-step]))
            a = a[(bits_apart(fp[a], fp[a + step]) <= radius) & (reach[a] != reach[a + step])]
            a = a[bits_apart(sk[a], sk[a + step]).sum(axis=1) <= limit]
            reach[a + step] = reach[a]
            u.append(node[a])
            v.append(node[a + step])
        for at, n in zip(starts[sizes > QUERIES].tolist(), sizes[sizes > QUERIES].tolist(), strict=True):
            links = np.array(tree_links(fp[at : at + n], sk[at : at + n], radius, limit), np.int64).reshape(-1, 2) + at
            u.append(node[links[:, 0]])
            v.append(node[links[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            got = pa.Table.from_batches([batch])
            sk = np.frombuffer(b"".join(got["sketch"].to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)
            rows = (got["key"].to_numpy(), got["node"].to_numpy(), got["fp"].to_numpy().view(np.uint64), sk)
            last = int(np.searchsorted(rows[0], rows[0][-1]))  # the last shard may go on
            if last:
                yield links_of(*(np.concatenate(c) for c in zip(*held, tuple(c[:last] for c in rows), strict=True)))
                held = []
            held.append(tuple(c[last:] for c in rows))
        if held:
            yield links_of(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return dealt.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "u long, v long")


def candidate_links(outlines: DataFrame, radius: int, sure: int, limit: int, agree: int = 2, heavy: int = HEAVY) -> DataFrame:
    """(u, v): links that span what is alike among the different outlines of columns node, fp, sketch, by their sketches.

    No link within `sure` bits is lost; of those up to `radius` bits, the ones whose fingerprints meet in a shard.
    Crowded shards are cut by runs of their other bits, so whatever met in one still meets. With a column `bands`,
    outlines that share a band key are linked by their sketches alone, however far apart their fingerprints are.
    """
    banded = "bands" in outlines.columns
    firsts = [F.first(c).alias(c) for c in ("fp", "sketch", *(["bands"] if banded else []))]
    different = materialize(outlines.groupBy("node").agg(*firsts), "outlines")
    masks = block_masks(list(range(64)), sure + agree, agree)
    links = shard_links(shards(different.select("node", "fp", "sketch"), masks, radius, heavy), radius, limit)
    if banded:
        links = links.union(shard_links(different.select(F.explode("bands").alias("key"), "node", "fp", "sketch"), 64, limit))
    return materialize(links.distinct(), "candidate-links")


def roots_of(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) for every node: links reach all that share a root."""
    found = connected_components(links).withColumnRenamed("component", "root")
    return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def exact_links(sets: list[np.ndarray], sketches: np.ndarray, similarity: float, limit: int, home: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (positions) that span the components of these sets of hashes under Jaccard similarity.

    Sets of one `home` are known to be linked already.
    """
    boss = np.arange(len(sets)) if home is None else np.unique(home, return_inverse=True)[1]
    sizes = np.array([len(x) for x in sets])
    links: list[tuple[int, int]] = []
    for b in range(1, len(sets)):
        other = np.flatnonzero(boss[:b] != boss[b])
        fits = np.minimum(sizes[other], sizes[b]) >= similarity * np.maximum(sizes[other], sizes[b])
        off = bits_apart(sketches[other], sketches[b]).sum(axis=1)
        near = other[(off <= limit) & fits]
        near = near[np.argsort(off[(off <= limit) & fits], kind="stable")]
        while len(near):
            a, near = int(near[0]), near[1:]
            if alike(sets[a], sets[b], similarity):
                boss[boss == boss[a]] = boss[b]
                near = near[boss[near] != boss[b]]
                links.append((a, b))
    return links


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets of hashes have this Jaccard similarity; an empty set is like none."""
    both = len(a) + len(b)
    shared = both - len(np.union1d(a, b))
    return bool(shared) and shared / (both - shared) >= similarity


def link_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(columns[:, 0]), pa.array(columns[:, 1])], ["u", "v"])


def compared_blocks(rows: DataFrame, similarity: float, like_width: int, limit: int) -> DataFrame:
    """(u, v): links that span what is alike among the rows of each key: key, node, home, sketch, text."""

    def links_of(group: dict[int, tuple]) -> pa.RecordBatch:
        nodes, sketches = list(group), np.frombuffer(b"".join(x[1] for x in group.values()), np.uint64).reshape(-1, SKETCH_BITS // 64)
        found = exact_links([x[2] for x in group.values()], sketches, similarity, limit, np.array([x[0] for x in group.values()]))
        return link_batch([(nodes[a], nodes[b]) for a, b in found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, {}
        for batch in batches:
            for k, node, home, sk, text in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "home", "sketch", "text")), strict=True):
                if k != key:
                    if len(group) > 1:
                        yield links_of(group)
                    key, group = k, {}
                if node not in group:
                    group[node] = (home, sk, shingle_hashes(words_of(text or ""), like_width))
        if len(group) > 1:
            yield links_of(group)

    columns = rows.select("key", "node", "home", "sketch", "text")
    return columns.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "u long, v long")


def compared_pairs(pairs: DataFrame, texts: DataFrame, similarity: float, like_width: int) -> DataFrame:
    """Of different pairs (u, v) of nodes those whose texts are alike; texts has node and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, first = None, None
        for batch in batches:
            found = []
            for u, v, text in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "text")), strict=True):
                own = shingle_hashes(words_of(text or ""), like_width)
                if (u, v) == pair and alike(first, own, similarity):
                    found.append(pair)
                pair, first = (u, v), own
            yield link_batch(found)

    ends = pairs.select("u", "v", F.explode(F.array("u", "v")).alias("node")).join(texts, "node").select("u", "v", "text")
    return ends.repartition("u", "v").sortWithinPartitions("u", "v").mapInArrow(run, "u long, v long")


def confirmed_roots(docs: DataFrame, outlines: DataFrame, links: DataFrame, similarity: float, like_width: int, limit: int) -> DataFrame:
    """(node, root) where groups are joined by links of exact similarity only; `links` says which texts may be alike.

    docs has text and the columns doc_id and row_key of outlines; rows that share both are one text.
    """
    proposed = materialize(roots_of(outlines, links), "proposed-groups")
    sizes = proposed.groupBy("root").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    own = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key", "sketch")).alias("own")
    members = outlines.groupBy("node").agg(own).join(proposed, "node").join(sizes, "root").select("root", "node", "size", "own.doc_id", "own.row_key", "own.sketch")
    members = materialize(members, "group-members")
    member = members.select(F.col("doc_id").alias("m"), F.col("row_key").alias("r"), "node")
    texts = docs.select("doc_id", "row_key", "text").join(member, F.col("doc_id").eqNullSafe(F.col("m")) & (F.col("row_key") == F.col("r"))).select("node", "text")
    small = members.where(F.col("size") <= SMALL * BLOCK).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("long"))
    # block x of y meets every block, itself among them
    at = small.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    at = at.select(F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "node", F.col("node").alias("home"), "sketch")
    found = compared_blocks(at.join(texts, "node"), similarity, like_width, limit)
    large = members.where(F.col("size") > SMALL * BLOCK)
    if large.limit(1).count():
        found = found.union(large_group_links(large, links, materialize(texts.join(large.select("node").distinct(), "node").dropDuplicates(["node"]), "group-texts"), similarity, like_width, limit))
    return roots_of(outlines, found)


def large_group_links(members: DataFrame, links: DataFrame, texts: DataFrame, similarity: float, like_width: int, limit: int) -> DataFrame:
    """(u, v): links of exact similarity that span what is alike in each large group (root, node, size, sketch).

    In each round every text meets two of the candidates that are not yet linked to it. Copies of one text are soon one
    body. Then the texts outside their group's largest body meet all of the group, block against block.
    """
    inside = links.join(members.select(F.col("node").alias("u")), "u", "left_semi")
    homes = members.select("node", F.col("node").alias("home"))
    good = None
    for k in range(ROUNDS):
        apart = inside
        if good is not None:
            of = lambda side: homes.select(F.col("node").alias(side), F.col("home").alias(f"home_{side}"))  # noqa: B023, E731
            apart = inside.join(of("u"), "u").join(of("v"), "v").where("home_u <> home_v").select("u", "v")
        chance = F.struct(F.xxhash64(F.lit(k), F.least("u", "v"), F.greatest("u", "v")).alias("h"), F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        each = apart.select(F.explode(F.array("u", "v")).alias("node"), chance.alias("link"))
        picked = each.groupBy("node").agg(F.array(F.min("link"), F.max("link")).alias("links")).select(F.explode("links").alias("link"))
        picked = materialize(picked.select("link.u", "link.v").distinct(), "picked-links")
        if not picked.limit(1).count():
            break
        new = compared_pairs(picked, texts, similarity, like_width)
        good = materialize(new if good is None else good.union(new), "confirmed-links")
        homes = materialize(roots_of(members, good).withColumnRenamed("root", "home"), "homes")
    placed = members.join(homes, "node")
    bodies = placed.groupBy("root", "home").agg(F.count(F.lit(1)).alias("n")).groupBy("root").agg(F.max(F.struct("n", "home")).alias("body"), F.sum("n").alias("all"))
    bodies = bodies.select("root", F.col("body.home").alias("body"), F.ceil(F.col("all") / BLOCK).cast("long").alias("blocks"), F.ceil((F.col("all") - F.col("body.n")) / BLOCK).cast("long").alias("stray_blocks"))
    placed = placed.join(bodies.where("stray_blocks > 0"), "root")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    strays = placed.where("home <> body").select("root", "node", "home", "sketch", block("stray_blocks").alias("s"), spread("blocks").alias("g"))
    whole = placed.select("root", "node", "home", "sketch", spread("stray_blocks").alias("s"), block("blocks").alias("g"))
    rows = strays.union(whole).select(F.xxhash64("root", "s", "g").alias("key"), "node", "home", "sketch").join(texts, "node")
    met = compared_blocks(rows, similarity, like_width, limit)
    return met if good is None else good.union(met)


def keep_first_alike(docs: DataFrame, similarity: float = 0.8, find_width: int = 2, like_width: int = 5, radius: int = 12, sure: int = 8) -> DataFrame:
    """The documents with the smallest doc_id of each group of like texts, with all their columns.

    A null text counts as empty, and texts without words are alike. Of rows that share the smallest doc_id the
    text whose hash is smallest stays; rows that repeat both id and text are one document. A null id stays only
    where its group has no other. An empty table stays empty.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [outline(t.as_py() or "", find_width, like_width) for t in batch.column("text")]
            nodes, fps = (np.array([m[k] for m in made], np.uint64).view(np.int64) for k in (0, 1))
            columns = [batch.column("doc_id"), batch.column("row_key"), pa.array(nodes), pa.array(fps), pa.array([m[2] for m in made], pa.binary())]
            columns.append(pa.array([m[3] for m in made], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "node", "fp", "sketch", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text")
    made = spread(rows).mapInArrow(run, "doc_id long, row_key long, node long, fp long, sketch binary, bands array<long>")
    outlines = materialize(made, "document-outlines")
    limit = sketch_limit(similarity)
    roots = settled("roots", lambda: confirmed_roots(rows, outlines, candidate_links(outlines, radius, sure, limit), similarity, like_width, limit))
    least = outlines.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("least"))
    of_doc, of_row = unused(docs.columns, "of_doc", "of_row")
    stay = least.join(roots, "node").groupBy("root").agg(F.min("least").alias("s")).select(F.col("s.doc_id").alias(of_doc), F.col("s.row_key").alias(of_row))
    return docs.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col(of_doc)) & (F.xxhash64("text") == F.col(of_row)), "left_semi")
