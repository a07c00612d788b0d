"""Wide-radius near-duplicates: trees and sketches against brute force, kept documents against exact similarity."""

import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_near_dedup import brute_components
from tidemark.llm import alike_texts as at
from tidemark.llm import near_dedup


def exact(a, b, width=5):
    sets = []
    for text in (a, b):
        w = text.lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def edited(rng, words, share):
    """Words with this share of them replaced, each far enough from the next to spoil five shingles."""
    out = list(words)
    for i in range(3, len(out), max(1, round(1 / share))):
        out[i] = f"new{rng.randrange(10**6)}"
    return out


def values_and_sketches(rng, n, flips):
    values, sketches = [], []
    for _ in range(n):
        k = rng.randrange(len(values)) if values and rng.random() < 0.8 else None
        v = rng.getrandbits(64) if k is None else values[k]
        s = rng.getrandbits(256) if k is None else sketches[k]
        for _ in range(rng.randint(0, flips)):
            v ^= 1 << rng.randrange(64)
            s ^= 1 << rng.randrange(256)
            s ^= 1 << rng.randrange(256)
        values.append(v)
        sketches.append(s)
    raw = b"".join(s.to_bytes(32, "little") for s in sketches)
    return values, sketches, np.array(values, np.uint64), np.frombuffer(raw, np.uint64).reshape(-1, 4)


def test_tree_links_span_confirmed_components(monkeypatch):
    monkeypatch.setattr(at, "LEAF", 4)
    rng = random.Random(3)
    for flips in (3, 6, 9):
        values, sketches, v, s = values_and_sketches(rng, 120, flips)
        near = lambda a, b: (values[a] ^ values[b]).bit_count() <= 5 and (sketches[a] ^ sketches[b]).bit_count() <= 8  # noqa: B023, E731
        links = at.tree_links(v, s, 5, 8)
        assert all(near(a, b) for a, b in links)
        joined = {frozenset(x) for x in links}
        assert brute_components(range(120), near) == brute_components(range(120), lambda a, b: frozenset((a, b)) in joined)  # noqa: B023


def test_crowd_of_like_outlines_is_quick():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 1 << 8, 8000).astype(np.uint64)
    assert len(at.tree_links(values, np.zeros((8000, 4), np.uint64), 8, 32)) == 7999


def test_sketches_estimate_similarity():
    rng = random.Random(5)
    for size, shared in ((1, 0), (3, 0), (40, 0), (300, 290), (300, 240), (5000, 4000)):
        off = []
        for _ in range(8):
            pool = np.array([rng.getrandbits(64) for _ in range(2 * size - shared)], np.uint64)
            a, b = (np.frombuffer(at.sketch(x), np.uint64) for x in (pool[:size], pool[size - shared :]))
            off.append(int(at.bits_apart(a, b).sum()))
        want = 128 * (1 - shared / (2 * size - shared))
        assert abs(np.mean(off) - want) < 10
    assert at.sketch(np.zeros(0, np.uint64)) == bytes(32)


def test_roots_hold_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    values, sketches, v, s = values_and_sketches(rng, 150, 4)
    rows = [(i, int(f), bytes(memoryview(x))) for i, (f, x) in enumerate(zip(v.view(np.int64), s, strict=True))]
    outlines = spark.createDataFrame(rows, "node long, fp long, sketch binary")
    want = brute_components(range(150), lambda a, b: (values[a] ^ values[b]).bit_count() <= 8 and (sketches[a] ^ sketches[b]).bit_count() <= 10)
    groups = {frozenset(k for k in want if want[k] == c) for c in set(want.values())}
    for heavy, keys in ((3, near_dedup.BROADCAST_KEYS), (3, 0), (at.HEAVY, near_dedup.BROADCAST_KEYS)):
        monkeypatch.setattr(near_dedup, "BROADCAST_KEYS", keys)
        got = {}
        for r in at.roots_of(outlines, at.candidate_links(outlines, 8, 8, 10, heavy=heavy)).collect():
            got.setdefault(r.root, set()).add(r.node)
        assert {frozenset(g) for g in got.values()} == groups


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(7)
    words = [[f"w{rng.randrange(900)}" for _ in range(rng.randint(200, 400))] for _ in range(40)]
    rows, copies, others = [], [], []
    for i, w in enumerate(words):
        rows.append((i, " ".join(w)))
        near, far = " ".join(edited(rng, w, 0.01)), " ".join(edited(rng, w, 0.2))
        assert exact(rows[-1][1], near) >= 0.85 and exact(rows[-1][1], far) < 0.4
        copies += [(100 + i, near), (200 + i, rows[-1][1].upper())]
        others.append((300 + i, far))
    rows += copies + others
    edge = [(400, None), (401, ""), (402, " \t\n"), (403, "one"), (404, "ONE"), (405, "one two"), (406, "w " * 30_000), (407, "w " * 29_000)]
    rows += [*edge, (0, rows[0][1]), (0, rows[0][1]), (500, "same id one"), (500, "another text of this id"), (None, rows[1][1]), (None, "only a null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as node", "3 as row_key", "4 as key")
    got = at.keep_first_alike(docs).collect()
    kept = [r.doc_id for r in got]
    assert got[0].__fields__ == docs.columns
    want = [*range(40), 400, 403, 405, 406, *range(300, 340), 500, 500, None]
    assert kept.count(0) == 3 and sorted(set(kept) - {0, None}) == sorted(set(want) - {0, None})
    assert kept.count(500) == 2 and kept.count(None) == 1
    assert at.keep_first_alike(docs.limit(0)).collect() == []
    assert at.keep_first_alike(docs.where(F.col("doc_id") == 5)).count() == 1


def passage_copies(rng, n, words, least, most):
    """(id, text) of texts, and under id + 1000 a copy with one passage appended, cut off or inserted: similarity least to most."""
    rows = []
    for i in range(n):
        w = [f"w{rng.randrange(3000)}" for _ in range(words)]
        s = rng.uniform(least, most)
        new = [f"n{rng.randrange(10**6)}" for _ in range(int((words - 4) * (1 / s - 1)))]
        mid = rng.randrange(10, words - 10)
        cut, longer = w[: words - int((words - 4) * (1 - s))], new[: len(new) - 4]
        copy = [w + new, cut, w[:mid] + longer[4:] + w[mid:]][i % 3]
        assert least <= exact(" ".join(w), " ".join(copy)) < most + 0.03
        rows += [(i, " ".join(w)), (i + 1000, " ".join(copy))]
    return rows


def test_copies_with_another_passage_are_candidates(spark, monkeypatch):
    monkeypatch.setattr(at, "SKETCH_SLACK", 25)
    rows = passage_copies(random.Random(11), 150, 300, 0.8, 0.85)
    kept = at.keep_first_alike(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == list(range(150))


def test_links_are_exactly_those_of_the_similarity(spark, monkeypatch):
    """Chains of texts a little above or below 0.8, in whole groups and in blocks."""
    rng = random.Random(12)
    texts = [w for _ in range(12) for w in [[f"w{rng.randrange(3000)}" for _ in range(200)]]]
    for w in list(texts):
        for _ in range(9):
            k = rng.randrange(18, 60)  # 196 shingles: k new words at the end leave similarity (196 - k) / (196 + k)
            w = w[: 200 - k // 2] + [f"n{rng.randrange(10**6)}" for _ in range(k // 2)]
            texts.append(w)
    texts = [" ".join(w) for w in texts]
    rng.shuffle(texts)
    want = brute_components(range(len(texts)), lambda a, b: exact(texts[a], texts[b]) >= 0.8)
    assert 20 < len(set(want.values())) < 100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block, small in ((4, 1000), (4, 2)):
        monkeypatch.setattr(at, "BLOCK", block)
        monkeypatch.setattr(at, "SMALL", small)
        assert sorted(r.doc_id for r in at.keep_first_alike(docs).collect()) == sorted(set(want.values()))


def test_exact_similarity_at_the_limit():
    a, sketches = np.arange(100, dtype=np.uint64), np.zeros((2, 4), np.uint64)
    for size, links in ((80, [(0, 1)]), (79, [])):
        assert at.exact_links([a, a[:size]], sketches, 0.8, 50) == links
        assert at.exact_links([a, a[:size]], sketches, 0.8, 50, np.array([5, 5])) == []
    assert at.exact_links([a, a[:0]], sketches, 0.8, 50) == [] == at.exact_links([a, a + np.uint64(100)], sketches, 0.8, 50)


def test_cut_shards_hold_the_links_of_uncut_ones(spark):
    rng = random.Random(13)
    rows = []
    for i in range(400):
        v = rng.getrandbits(64)
        for k, x in enumerate((v, v ^ sum(1 << b for b in rng.sample(range(64), 9 + i % 4)))):
            rows.append((2 * i + k, x - (1 << 64) if x >> 63 else x, bytes(32)))
    outlines = spark.createDataFrame(rows, "node long, fp long, sketch binary")
    roots = lambda heavy: sorted(at.roots_of(outlines, at.candidate_links(outlines, 12, 8, 0, heavy=heavy)).collect())
    assert roots(0) == roots(at.HEAVY)


def test_a_large_group_of_copies_does_not_meet_pair_by_pair(spark, monkeypatch):
    """A crowd of near copies is confirmed by about two links a text; strays at 0.75 of it are left out."""
    monkeypatch.setattr(at, "BLOCK", 20)
    monkeypatch.setattr(at, "SMALL", 1)
    rng = random.Random(14)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = [(i, " ".join(base + [f"own{i}"])) for i in range(300)] + [(500 + i, " ".join(base[:114] + [f"far{i}"])) for i in range(5)]
    counted = spark.sparkContext.accumulator(0)
    plain = at.alike

    def counting(*args):
        counted.add(1)
        return plain(*args)

    monkeypatch.setattr(at, "alike", counting)
    kept = {r.doc_id for r in at.keep_first_alike(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert exact(rows[0][1], rows[300][1]) < 0.8 < exact(rows[300][1], rows[301][1]) and kept == {0, 500}
    assert 300 < counted.value < 300 * 12


def test_clashing_columns(spark):
    names = ["__d", "__k", "of_doc", "of_row", "node", "root", "sketch", "m", "r"]
    docs = spark.createDataFrame([(1, "a b c", *names), (2, "A b c", *names), (None, None, *names)], "doc_id int, text string, " + ", ".join(f"{n} string" for n in names))
    got = at.keep_first_alike(docs)
    assert got.schema == docs.schema and sorted((r.doc_id or 0) for r in got.collect()) == [0, 1]
