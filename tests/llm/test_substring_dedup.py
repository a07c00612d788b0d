"""Repeated passages against brute force over all windows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import substring_dedup as sd


def brute(rows, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, words, strict=True):
        for p in range(len(w) - width + 1):
            if d is not None:
                key = tuple(w[p : p + width])
                least[key] = min(d, least.get(key, 1 << 60))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for p in range(len(w) - width + 1):
            if d is not None and least[tuple(w[p : p + width])] < d:
                gone |= set(range(p, p + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d if d is not None else -1, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def texts(seed, n, size, vocabulary):
    rng = random.Random(seed)
    pool = [[rng.choice(vocabulary) for _ in range(rng.randint(1, size))] for _ in range(6)]
    made = []
    for _ in range(n):
        w = []
        for _ in range(rng.randint(0, 6)):
            if rng.random() < 0.5:
                p = rng.choice(pool)
                a = rng.randrange(len(p))
                w += p[a : a + rng.randint(1, size)]
            else:
                w += [rng.choice(vocabulary) for _ in range(rng.randint(0, 25))]
        made.append(w)
    return made


@pytest.mark.parametrize("vocabulary", ["ab", "abcdefgh", [f"w{i}" for i in range(300)]])
@pytest.mark.parametrize("width", [8, 50])
def test_windows_have_content_determined_anchors(vocabulary, width):
    seen = {}
    for w in texts(3, 60, 120, vocabulary):
        ids, bounds = sd.word_ids(pa.array([" ".join(w)], pa.large_string()))
        r = sd.window_rows(ids, bounds, width, 3)
        got = []
        for p0, p1, core in zip(r["p0"], r["p1"], r["core"], strict=True):
            for p in range(p0, p1 + 1):
                got.append(p)
                assert seen.setdefault(tuple(w[p : p + width]), core) == core
        assert got == list(range(max(0, len(w) - width + 1)))


def test_rows_are_few():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 1 << 62, (2, 100_000)).astype(np.uint64)
    assert len(sd.window_rows(ids, np.array([0, 100_000]), 50, 3)["p0"]) < 100_000 / 12


@pytest.mark.parametrize(("width", "vocabulary"), [(5, "abcd"), (12, [f"w{i}" for i in range(60)]), (50, [f"w{i}" for i in range(400)])])
def test_report_equals_brute_force(spark, width, vocabulary):
    rows = [(i % 70, " ".join(w)) for i, w in enumerate(texts(width, 80, 130, vocabulary))]
    rows += [(90, rows[3][1]), (91, rows[3][1]), (None, rows[3][1]), (92, None), (93, ""), (94, " a\x1cb\x85c \n"), (95, "run " * 3000), (96, "run " * 400), (97, "x y " * 500), (2, rows[4][1]), (2, rows[4][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as starts", "2 as n_words", "'x' as core")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in sd.dedup_report(docs, width).collect())
    assert got == brute(rows, width)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert sd.dedup_report(docs).collect() == [] and sd.dedup_texts(docs).collect() == []


def test_texts_lose_the_repeats(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"start {passage} end", "a", 7), (2, f"other\tbegin {passage}  my end", "b", 7), (3, f"short\n text", None, 7), (4, passage, "d", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, starts string, n_chars int")
    got = {r.doc_id: r for r in sd.dedup_texts(docs).collect()}
    assert [got[k].text for k in (1, 2, 3, 4)] == [rows[0][1], "other\tbegin\nmy end", "short\n text", ""]
    assert [got[k].n_chars for k in (1, 2, 3, 4)] == [len(got[k].text) for k in (1, 2, 3, 4)] and got[2].starts == "b"


def test_equality_does_not_rest_on_the_names(spark, monkeypatch):
    """Words that share their first hash, and with it all names and cores, are still told apart."""
    whole = sd.word_ids

    def colliding(column):
        ids, bounds = whole(column)
        ids[0] %= np.uint64(7)
        return ids, bounds

    rows = [(i, " ".join(w)) for i, w in enumerate(texts(4, 30, 60, [f"w{i}" for i in range(40)]))]
    monkeypatch.setattr(sd, "word_ids", colliding)
    found = set()
    for w in rows:
        for _, ids, bounds in sd.sliced(pa.array([w[1]], pa.large_string()), 8):
            r = sd.window_rows(ids, bounds, 8, 3)
            words = w[1].split()
            for p0, p1, lone, value in zip(r["p0"], r["p1"], r["lone"], r["whole"], strict=True):
                found.add((int(value), tuple(words[p0 : (p0 if lone else p1) + 8])))
    assert len(found) == len({v for v, _ in found}) == len({t for _, t in found}) > 100


def test_repeated_lines_give_few_rows(spark):
    """A line repeated in many texts: rows by texts, not by places."""
    rng = random.Random(5)
    line = " ".join(f"v{rng.randrange(50)}" for _ in range(12))
    rows = [(i, " ".join([f"own{i}"] + [line] * 200 + [f"tail{i}"] + [line] * (i % 3))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in sd.dedup_report(docs, 50).collect())
    assert got == brute(rows, 50)
    for _, ids, bounds in sd.sliced(pa.array([rows[0][1]], pa.large_string()), 50):
        r = sd.merge_lone(sd.window_rows(ids, bounds, 50, 3), 50)
        assert len(r["p0"]) > 100 and len(sd.alike_rows(r, np.arange(len(r["p0"])))[1]) < 20


def test_clashing_columns_and_types(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    names = ["__starts", "starts", "ends", "of_doc", "of_row", "__doc_id", "__row_key", "spans", "a.b"]
    schema = "doc_id int, text string, " + ", ".join(f"`{n}` string" for n in names)
    rows = [(1, passage, *names), (2, f"x {passage} y", *names), (2, f"x {passage} y", *names), (None, passage, *names), (3, None, *names)]
    docs = spark.createDataFrame(rows, schema)
    got = sd.dedup_texts(docs)
    assert got.schema == docs.schema and all(list(r)[2:] == names for r in got.collect())
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [(0, passage), (1, passage), (2, "x\ny"), (2, "x\ny"), (3, "")]


def test_report_equals_its_sql(spark):
    import duckdb

    from tidemark.llm.queries import ORACLES, op3_substring_dedup

    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(ORACLES["op3_substring_dedup"]).fetchall()
    got = op3_substring_dedup(spark, "/root/testdata/sf0.001").select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_filters_have_all_members(spark):
    cores = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 4000)
    bits = sd.build_filter(spark.createDataFrame([(int(c),) for c in cores], "core long"), 1 << 20)
    assert sd.inside(bits, cores).all()
    assert sd.inside(bits, cores + 1).mean() < 0.01
