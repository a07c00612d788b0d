"""Fingerprints and components against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import near_dedup as nd
from tidemark.llm.common import connected_components


def brute_fingerprint(text, words=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, near):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if near(a, b) and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_tree_links_span_components():
    rng = random.Random(1)
    for trial in range(30):
        centre = rng.getrandbits(64)
        values = {rng.getrandbits(64) for _ in range(5)}
        while len(values) < 60:
            v = rng.choice(sorted(values) + [centre])
            for _ in range(rng.randint(1, 5)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
        values = sorted(values) if trial % 2 else list(values)
        links = nd.tree_links(values, 3)
        near = lambda a, b: (a ^ b).bit_count() <= 3
        assert all(near(values[a], values[b]) for a, b in links)
        joined = {frozenset((values[a], values[b])) for a, b in links}
        assert brute_components(values, near) == brute_components(values, lambda a, b: frozenset((a, b)) in joined)


def test_crowd_of_near_copies_is_quick():
    rng = np.random.default_rng(2)
    crowd = sorted({int(x) for x in rng.integers(0, 1 << 14, 6000)})
    assert len(nd.tree_links(crowd, 3)) == len(crowd) - 1


def test_near_duplicates(spark):
    rng = random.Random(7)
    word = lambda: rng.choice(["alpha", "Beta", "gamma", "δelta", "x"]) + str(rng.randint(0, 40))
    texts = [" ".join(word() for _ in range(200)) for _ in range(25)]
    for t in list(texts):
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts += [" ".join(w), t.upper(), t.replace(" ", "\n", 3)]
    texts += ["", None, " \t\n", "one", "One two", "a b c", "\x1ca b\x85c d e", "w " * 30_000]
    rows = [(i * 3 + 5, t) for i, t in enumerate(texts)] + [(2, texts[3]), (2, texts[3]), (None, texts[4])]
    want = {i: brute_fingerprint(t) for i, (_, t) in enumerate(rows)}
    label = brute_components(sorted(set(want.values())), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[label[want[i]]] = min(doc_id, least.get(label[want[i]], 1 << 60))
    expect = sorted((d or -1, f"{want[i]:016x}", least[label[want[i]]]) for i, (d, _) in enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id")
    assert sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in nd.near_duplicates(docs).collect()) == expect
    assert nd.near_duplicates(docs.limit(0)).collect() == []


def test_crowded_shards_are_cut_without_losing_links(spark):
    rng = random.Random(8)
    values = {rng.getrandbits(64) for _ in range(10)}
    while len(values) < 150:
        v = rng.choice(sorted(values))
        for _ in range(rng.randint(1, 4)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = nd.fingerprint_components(spark.createDataFrame([(v,) for v in signed], "fp long"), heavy=3).collect()
    masks = nd.block_masks(list(range(64)), 5, 2)
    rows = spark.createDataFrame([(v,) for v in signed], "fp long")
    keys = [nd.shards(rows, masks, 3, 3, levels).groupBy("key").count().agg({"count": "max"}).first()[0] for levels in (0, 1, 2, 3)]
    assert keys[0] > keys[3] and keys == sorted(keys, reverse=True)  # crowded shards are cut again
    want = brute_components(sorted(signed), lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3)
    groups = {}
    for r in got:
        groups.setdefault(r.root, set()).add(r.fp)
    assert {frozenset(g) for g in groups.values()} == {frozenset(k for k in want if want[k] == c) for c in set(want.values())}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, 200 + i) for i in range(1, 40)] + [(400, 399), (399, 400), (500, 500)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{200 + i: 200 for i in range(40)}, 399: 399, 400: 399}
    assert connected_components(spark.createDataFrame([], "u long, v long").where(F.lit(True))).count() == 0


def test_query_over_the_given_documents(spark):
    import pandas as pd

    from tidemark.llm.queries import op7_near_dedup

    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    fps = {d: brute_fingerprint(t) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    label = brute_components(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for d, f in fps.items():
        least[label[f]] = min(d, least.get(label[f], d))
    want = sorted((d, f"{f:016x}", least[label[f]]) for d, f in fps.items())
    assert sorted(map(tuple, op7_near_dedup(spark, "/root/testdata/sf0.001").select("doc_id", "fingerprint", "component_id").collect())) == want
