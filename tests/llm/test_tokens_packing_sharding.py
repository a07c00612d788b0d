"""Counts against the library at every prefix; packing and sharding against their contracts."""

import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing, sharding
from tidemark.llm.token_counts import PrefixCounter, count_tokens, truncate_texts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  ", "a", "it's we'll 've", "x   y \n\n z", "\t\ta  b", "<|endoftext|>", "a <|endoftext|>b", "é́ñ 漢字 🙂🙂", "!!!!??''''s", "12345 6789", "\x1c\x1da b", "a  b", "ΑΣ ΑΣ", "Ⅷ ²", "<|startoftext|> X", "\u0000￾"]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    parts = [*ODD, " ", "\n", "the", "'", "s", "ing", "THE", "ß", "..", "<|", "|>", "tion "]
    return [*ODD, *("".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(n))]


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_counts_equal_the_library_at_every_prefix():
    counter, library = PrefixCounter(BYTES), Tokenizer.from_file(BYTES)
    want = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for text in odd_texts(250):
        index = counter.index(text)
        got = [index.count(i) for i in range(len(text) + 1)]
        assert got == [want(text[:i]) for i in range(len(text) + 1)], repr(text)
        assert counter.count(text) == got[-1] == index.total
        for budget in (0, 1, 3, 7):
            assert index.truncate(budget) == max(i for i, n in enumerate(got) if n <= budget), (text, budget)
            assert index.fits(budget) == (got[-1] <= budget)


def test_count_tokens_edges(spark):
    rows = [(1, None), (None, "a b"), (3, "x" * 100_000), (3, "x" * 100_000), (4, "wörd " * 600)]
    out = count_tokens(table(spark, rows).selectExpr("*", "7 as n_tokens", "text as n_bytes", "1 as fit_chars"), BYTES, 512).collect()
    library = Tokenizer.from_file(BYTES)
    for r in out:
        text = next(t for d, t in rows if d == r.doc_id) or ""
        assert r.fit_chars == (len(text) if not r.over_limit else max(i for i in range(1, 9000) if len(library.encode(text[:i], add_special_tokens=False).ids) <= 512))
    assert sorted((r.doc_id or 0, r.n_bytes, r.over_limit) for r in out) == [(0, 3, False), (1, 0, False), (3, 100_000, True), (3, 100_000, True), (4, 3600, True)]
    assert count_tokens(table(spark, []), BYTES, 512).collect() == []


def test_chunkwise_ids_equal_the_library():
    library = Tokenizer.from_file(WORDS)
    texts = odd_texts(400, 2)
    for many in (texts, texts[:0], [""], ["", "a"]):
        ids, bounds = packing.encode_texts(pa.array(many, pa.large_string()), WORDS)
        assert len(bounds) == len(many) + 1
        for t, lo, hi in zip(many, bounds[:-1], bounds[1:], strict=True):
            assert np.frombuffer(ids[lo:hi], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_batches_equal_the_library():
    counter, library = PrefixCounter(BYTES), Tokenizer.from_file(BYTES)
    texts = odd_texts(3000, 9) + ["plain words here\nand\nthere", "It's 'll we'", "a\nb c", "x" * 3000, "word"]
    for many in (texts, [], ["a b"], ["  "]):
        want = [len(library.encode(t, add_special_tokens=False).ids) for t in many]
        assert counter.count_batch(pa.array(many, pa.large_string()), 5)[0].tolist() == want


def test_prefixes_of_a_budget_equal_the_library():
    counter, library = PrefixCounter(BYTES), Tokenizer.from_file(BYTES)
    rng = random.Random(10)
    words = ["plain", "don't", "it's", "x7", "été", "12345", "...", "漢字", "unbelievably", "a", "'ll", "It's"]
    texts = odd_texts(300, 11) + ["".join(rng.choice([" ", "\n", " "]) + rng.choice(words) for _ in range(rng.randint(1, 30)))[1:] for _ in range(300)]
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for budget in (0, 1, 4, 9):
        got = counter.count_batch(pa.array(texts, pa.large_string()), budget)[1].tolist()
        for text, n in zip(texts, got, strict=True):
            assert n == max(i for i in range(len(text) + 1) if count(text[:i]) <= budget), (text, budget)


def test_truncate_texts(spark):
    library = Tokenizer.from_file(BYTES)
    rows = [(1, None, "a"), (2, "", "b"), (3, "one two three four five six", "c"), (None, "x " * 50_000, None), (3, "one two three four five six", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `fit.chars` string")
    got = truncate_texts(docs, BYTES, 4)
    assert got.columns == docs.columns and sorted(((r[0] or 0, r[1] or "") for r in got.collect())) == [(0, "x x x x"), (1, ""), (2, ""), (3, "one two three four"), (3, "one two three four")]
    assert len(library.encode("x x x x ", add_special_tokens=False).ids) == 5
    assert truncate_texts(docs.limit(0), BYTES, 4).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_each_piece_once_with_little_padding(seed):
    rng = np.random.default_rng(seed)
    units = 64
    counts = np.bincount(rng.integers(0, units, 5000) if seed else np.full(5000, 20), minlength=units)
    plan = packing.plan_sequences(counts, units)
    sizes = np.arange(1, units + 1)
    assert (sum(p * t for p, t in plan) == counts).all() and all((p * sizes).sum() <= units for p, _ in plan)
    least = (counts * sizes).sum() / units if seed else 5000 / 3
    assert sum(t for _, t in plan) <= least * 1.02 + 2
    assert packing.plan_sequences(np.zeros(units, int), units) == []


def test_price_finds_the_best_pattern():
    rng = np.random.default_rng(0)
    for _ in range(5):
        duals = rng.random(6)
        value, pattern = packing.price(duals, 6)
        best = max(duals @ np.array(p) for p in np.ndindex(7, 4, 3, 2, 2, 2) if np.dot(p, np.arange(1, 7)) <= 6)
        assert np.isclose(value, best) and np.isclose(value, duals @ pattern)


def test_pack_documents(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["one", "Two", "three!"]) for _ in range(rng.choice([0, 3, 50, 700, 5000])))) for i in range(120)]
    rows += [(7, None), (7, None), (None, "one"), (500, "one " * 4095), (501, "one " * 4096)]
    got = packing.pack_documents(table(spark, rows).selectExpr("*", "1 as start", "2 as length"), WORDS).toPandas()
    library = Tokenizer.from_file(WORDS)
    want = []
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        for at in range(0, len(ids), 4 * 4096):
            piece = ids[at : at + 4 * 4096]
            want.append((-1 if doc_id is None else doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4))
    seen = got.fillna({"doc_id": -1}).astype({"doc_id": int})[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]]
    assert sorted(map(tuple, seen.values.tolist())) == sorted(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        ends = (g.offset + g.length).tolist()
        assert g.offset.iloc[0] == 0 and ends[-1] <= 4096 and all(a == b for a, b in zip(ends, g.offset.tolist()[1:], strict=False))
    bins = []  # first fit by falling length
    for n in sorted(got.length, reverse=True):
        k = next((k for k, room in enumerate(bins) if room >= n), None)
        if k is None:
            bins.append(4096 - n)
        else:
            bins[k] -= n
    sequences = got.sequence_id.nunique()
    assert sequences <= len(bins) + 1 and set(got.sequence_id) == set(range(sequences))
    assert packing.pack_documents(table(spark, []), WORDS).collect() == []


def test_differencing():
    rng = random.Random(3)
    sizes = [rng.randint(1, 10_000) for _ in range(600)]
    loads = [0] * 7
    for s, k in zip(sizes, sharding.karmarkar_karp(sizes, 7), strict=True):
        loads[k] += s
    assert max(loads) - min(loads) <= 50
    assert sharding.karmarkar_karp([], 3) == [] and sorted(sharding.karmarkar_karp([5, 5], 2)) == [0, 1]
    assert len(set(sharding.karmarkar_karp([4, 5, 6, 7, 8], 2))) == 2


def test_sharding_of_given_documents_keeps_its_law(spark):
    """The whole query over the smallest table: every row once, sizes and digests as they are, groups whole, loads near equal."""
    from tidemark.llm.queries import op10_sharding

    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    out = op10_sharding(spark, "/root/testdata/sf0.001").toPandas().sort_values("doc_id").reset_index(drop=True)
    text = docs.sort_values("doc_id").text.fillna("").str.encode("utf-8").tolist()
    assert out.doc_id.tolist() == sorted(docs.doc_id) and out["size"].tolist() == [len(t) + 8 for t in text] and out.text_crc32.tolist() == [zlib.crc32(t) for t in text]
    homes = {}
    assert all(homes.setdefault(t, s) == s for t, s in zip(text, out["shard"], strict=True))
    loads, heaviest = [0] * 24, {}
    for t, s, n in zip(text, out["shard"], out["size"], strict=True):
        loads[s] += n
        heaviest[t] = heaviest.get(t, 0) + n
    # the best that whole groups allow, within the heaviest group: no shard is above the mean by more than differencing leaves
    assert max(loads) <= max(max(heaviest.values()), sum(loads) / 24 * 1.02) and sorted(set(out["shard"])) == list(range(24))
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_sharding_of_very_long_texts(spark):
    rows = [(i, "w" * n) for i, n in enumerate([3_000_000, 1_000_000, 1_000_000, 1_000_000, 0, 1])]
    out = sharding.shard_documents(table(spark, rows), 2).toPandas()
    assert sorted(out.groupby("shard")["size"].sum()) == [3_000_024, 3_000_025]


def test_shard_documents(spark):
    rng = random.Random(4)
    rows = [(i, "w" * rng.randint(0, 400)) for i in range(800)] + [(1, None), (None, "é"), (9, "same"), (9, "same")]
    out = sharding.shard_documents(table(spark, rows).selectExpr("*", "1 as shard", "2 as slot"), 5, bundles=64).toPandas()
    assert len(out) == len(rows) and out.law.eq("bytes").all() and out.grown_shard.isna().all()
    loads = out.groupby("shard")["size"].sum()
    assert len(loads) == 5 and loads.max() - loads.min() <= 40
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert out.groupby(["size", "text_crc32"]).shard.nunique().max() == 1
    assert sorted(out.text_crc32) == sorted(zlib.crc32((t or "").encode()) for _, t in rows)
    assert sharding.shard_documents(table(spark, []), 5).collect() == []
