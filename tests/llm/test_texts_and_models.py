"""Extraction, fingerprints, decontamination, classifiers and the pipeline against brute force or held-out labels."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import chunk_fingerprints as cf
from tidemark.llm import decontamination as dc
from tidemark.llm import html_text, quality, toxicity

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href=x>Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy this now, a long text of an advert.</div>
<div class="cookie-notice">We use cookies</div>{article}<aside>Side</aside><form>Name <input></form>
<section id="comments"><p>What a good article, says a reader at great length.</p></section><footer>&copy; end</footer></body></html>"""


@pytest.mark.parametrize(
    ("article", "want"),
    [
        ("<article><h1>A &amp; B</h1><p><b>one\n two<br><p>caf&eacute;&nbsp;x</p><p>Be.</p></article>", "A & B\none two\ncafé x\nBe."),
        ("<div class='content'><p>A long first paragraph, with much to say about it.</p><p>Be.</p></div>", "A long first paragraph, with much to say about it.\nBe."),
        ("<main><ul><li>i<li>j</ul><table><tr><td>c<td>d</table><div class='share'>S</div>&lt;p&gt;</main>", "i\nj\nc\nd\n<p>"),
        ("", ""),
    ],
)
def test_main_text(article, want):
    assert html_text.main_text(PAGE.replace("{article}", article)) == want


@pytest.mark.parametrize("broken", ["<![foo bar]>", "<![ x]>", "<![ endif]>"])
def test_text_after_a_broken_declaration(broken):
    assert html_text.main_text(f"<p>a</p>{broken}<p>b</p>") == "a\nb"


@pytest.mark.parametrize(
    "page",
    [
        '<div class="has-sidebar"><article><p>Its text.</p></article></div>',
        '<main class="no-sidebar"><p>Its text.</p></main>',
        '<article class="post category-social"><p>Its text.</p></article>',
        '<div class="sidebar"><main class="social"><p>Its text.</p></main></div><div class="related"><article><p>Other</p></article></div>',
        '<article><p>Its text.</p></article><div class="comments"><article class="comment"><p>Other</p></article></div>',
    ],
)
def test_layout_words_do_not_leave_out_the_article(page):
    assert html_text.main_text(page) == "Its text."


def test_links_within_an_article_stay():
    page = "<article><p>Its text.</p><section><a href=x>A source of it</a></section><table><tr><td><a href=y>cell</a></table><div>See <a href=z>this long link</a></div></article>"
    assert html_text.main_text(page) == "Its text.\nA source of it\ncell\nSee this long link"


def test_extract_pages_edges(spark):
    rows = [(1, "u", None), (None, None, "<p>x"), (2, "v", ""), (2, "v", ""), (3, "w", "<article>" + "<p>a b</p>" * 5000), (4, "x", "plain <![if bad"), (5, "y", "<div" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = html_text.extract_pages(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got}[3] == "\n".join(["a b"] * 5000) and {r.page_id: r.text for r in got}[None] == "x"
    assert html_text.extract_pages(pages.limit(0)).collect() == []


def test_smoothing_and_threshold():
    assert np.allclose(html_text.smooth(np.ones(9)), 1) and html_text.smooth(np.zeros(1)).tolist() == [0]
    assert 2 < html_text.threshold(np.array([1.0, 2, 1, 90, 80])) < 80 and html_text.threshold(np.array([5.0, 6])) == 5


def slow_chunks(data):
    ends, at, h = [], 0, 0
    hashes = []
    for b in data:
        h = ((h << 1) + int(cf.GEAR[b])) & 0xFFFFFFFF
        hashes.append(h)
    while at < len(data):
        end = min(len(data), at + cf.MOST)
        for z in range(at + cf.LEAST, min(len(data), at + cf.MOST) + 1):
            bits = cf.HARD_BITS if z < at + cf.NORMAL else cf.EASY_BITS
            if hashes[z - 1] >> 32 - bits == 0:
                end = z
                break
        ends.append(end)
        at = end
    return ends


def test_chunks_equal_the_rolling_hash():
    rng = random.Random(1)
    for n in [0, 1, 7, 8, 31, 33, 500, 5000]:
        data = bytes(rng.choice(b"abcdefgh \xc3\xa9") for _ in range(n))
        assert cf.chunk_ends(data) == slow_chunks(data)
    text = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    chunks = cf.chunk_set(text)
    assert cf.from_string(cf.as_string(chunks)) == chunks and cf.containment(chunks, cf.chunk_set("shifted " + text)) > 0.9
    assert cf.containment({}, {}) == 1 and cf.containment({}, chunks) == 0 == cf.containment(chunks, {})


@pytest.mark.parametrize("n", [0, 1, 2, 90])
def test_fingerprint_report(spark, n):
    rng = random.Random(n)
    texts = ["".join(rng.choice("abc déf") for _ in range(rng.randint(0, 900))) for _ in range(n)]
    rows = [(rng.randrange(-500, 10_000) * 100 + i, t) for i, t in enumerate(texts)]
    if n > 2:
        rows += [(None, "the last"), (77, None)]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    got = {r.doc_id: r for r in cf.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as range")).collect()}
    assert len(got) == len(rows)
    for k, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        changed = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
        a, b, c = (cf.chunk_set(t) for t in (text, changed, following))
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (cf.as_string(a), cf.as_string(b))
        assert r.near_edited == pytest.approx(cf.containment(a, b)) and r.near_next == pytest.approx(cf.containment(a, c))


def test_fingerprint_report_with_repeated_ids(spark):
    rows = [(5, "a b c"), (5, "a b c"), (5, "x y z"), (9, "q" * 300), (1, "w" * 50)] * 2
    assert len(cf.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == len(rows)


def test_fingerprints_of_very_long_texts(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefghij klmnö") for _ in range(400_000))
    got = {r.doc_id: r for r in cf.fingerprint_report(spark.createDataFrame([(2, long), (1, "start " + long)], "doc_id long, text string")).collect()}
    assert got[2].n_chars == 400_000 and got[2].near_next > 0.99 and 0.6 < got[2].near_edited <= 1
    assert cf.from_string(got[2].fingerprint) == cf.chunk_set(long)


def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def damaged(rng, text, edits):
    t = list(text)
    for _ in range(edits):
        k = rng.randrange(len(t))
        t[k : k + 1] = rng.choice([[], [rng.choice("abcxyz")], [t[k], rng.choice("abcxyz")]])
    return "".join(t)


def test_leaks_equal_brute_force():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    items = [" ".join(word() for _ in range(n)) for n in (1, 2, 4, 8, 20, 40, 60)] + ["", "Ab C"]
    texts = []
    for _ in range(120):
        item = dc.fold(rng.choice(items[2:7]))
        inner = damaged(rng, item, rng.randint(0, 2 + dc.budget(len(item)))) if item else ""
        texts.append(" ".join(word() for _ in range(rng.randint(0, 20))) + " " + inner + " " + " ".join(word() for _ in range(rng.randint(0, 20))))
    block = dc.Items(list(enumerate(items)))
    got = {(i, block.ids[k]): e for i, k, _, _, e in block.leaks([*texts, None, ""])}
    want = {}
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            item = dc.fold(item)
            if len(item) >= dc.SEED and (e := least_edits(item, dc.fold(t))) <= dc.budget(len(item)):
                want[i, k] = e
            elif item and len(item) < dc.SEED and f" {item} " in f" {dc.fold(t)} ":
                want[i, k] = 0
    assert got == want


def test_items_with_a_common_beginning_and_few_hits_at_once(monkeypatch):
    """Many items share their seeds; hits are looked at a few at a time."""
    rng = random.Random(12)
    prompt = "choose the right answer to the question that follows here: "
    items = [prompt + " ".join(rng.choice("abcdefgh") * 4 for _ in range(6)) for _ in range(40)]
    texts = [prompt * 30 + items[3][len(prompt) :], items[5], "x " + damaged(rng, items[9], 3), prompt]
    want = {(i, k): least_edits(dc.fold(item), dc.fold(t)) for i, t in enumerate(texts) for k, item in enumerate(items)}
    want = {p: e for p, e in want.items() if e <= dc.budget(len(dc.fold(items[p[1]])))}
    for hits in (1, 7, dc.HITS):
        monkeypatch.setattr(dc, "HITS", hits)
        assert {(i, k): e for i, k, _, _, e in dc.Items(list(enumerate(items))).leaks(texts)} == want


def test_find_and_drop_leaks(spark):
    item = "the quick brown fox jumps over the lazy dog and then it sleeps in the sun for an hour or two"
    rows = [(1, f"intro {item.upper()} outro", "x"), (2, "nothing here at all", None), (None, item.replace("quick", "quack"), "y"), (3, None, "z"), (3, None, "z"), (4, "a " * 60_000 + item, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(10, item), (11, None), (12, "")], "item_id long, text string")
    assert sorted((r.doc_id or -1, r.item_id, r.edits, r.exact) for r in dc.find_leaks(docs, bench).collect()) == [(-1, 10, 1, False), (1, 10, 0, True), (4, 10, 0, True)]
    left = dc.drop_leaks(docs, bench)
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 3] and left.columns == docs.columns
    assert dc.find_leaks(docs, bench.limit(0)).collect() == [] and dc.find_leaks(docs.limit(0), bench).collect() == []


def test_chains_equal_enumeration():
    rng = np.random.default_rng(3)
    emission, move, bounds = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([0, 4, 5, 7])
    good, pairs = quality.marginals(emission, move, bounds)
    want, want_pairs = np.zeros(7), np.zeros((2, 2))
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        total, one, two = 0.0, np.zeros(z - a), np.zeros((2, 2))
        for states in np.ndindex(*[2] * (z - a)):
            p = np.exp(sum(emission[a + i] for i, s in enumerate(states) if s) + sum(move[s, t] for s, t in zip(states, states[1:], strict=False)))
            total += p
            one += p * np.array(states)
            for s, t in zip(states, states[1:], strict=False):
                two[s, t] += p
        want[a:z], want_pairs = one / total, want_pairs + two / total
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs)


def test_positive_unlabelled_risk_is_not_negative():
    rng = np.random.default_rng(0)
    x_pos, x_all = rng.normal(1, 1, (40, 3)), rng.normal(0, 1, (90, 3))
    w = rng.normal(size=3)
    risk, grad = toxicity.pu_gradient(x_pos, x_all, w, 0.3)
    for k in range(3):
        step = np.zeros(3)
        step[k] = 1e-6
        up, down = (toxicity.pu_gradient(x_pos, x_all, w + d, 0.3)[0] for d in (step, -step))
        assert grad[k] == pytest.approx((up - down) / 2e-6, abs=1e-5)
    assert toxicity.pu_gradient(x_pos, x_all[:1] - 50, np.ones(3), 0.9)[0] >= 0


def synthetic(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.25
        words = [rng.choice(["plain", "words", "of", "prose", "run", "along"]) + rng.choice(["", "s", "er"]) for _ in range(rng.randint(20, 80))]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vilely", "viler"])
        text = " ".join(words)
        text = text.upper().replace(" ", "!! ") if bad else text[:40] + "\n" + text[40:]
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def test_classifiers_on_held_out_rows(spark):
    rows, labels = synthetic(600, 5)
    docs = spark.createDataFrame(rows + [(None, "x"), (9_000, None), (9_001, ""), (9_002, "ok " * 40_000)], "doc_id long, text string").selectExpr("*", "1 as score", "0 as held_out")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {d: (q, t) for d, q, t in labels}
    for k, run in ((0, quality.score_quality), (1, toxicity.score_toxicity)):
        got = run(docs, marks).collect()
        assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 for r in got)
        for r in got:
            assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        held = [r for r in got if r.held_out and r.doc_id in truth]
        assert sum(r.predicted == truth[r.doc_id][k] for r in held) / len(held) > 0.97
        empty = run(docs, marks.limit(0)).collect()
        assert len({r.score for r in empty}) == 1
        assert run(docs.limit(0), marks).collect() == []
    kept = {r.doc_id for r in quality.keep_good(docs, marks).collect()}
    assert sum((d in kept) == bool(q) for d, (q, _) in truth.items()) > 0.97 * len(truth)


def test_scores_do_not_depend_on_labels_held_out(spark):
    rows, labels = synthetic(200, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    lied = [(d, 1 - q, 1 - t) if held(d) else (d, q, t) for d, q, t in labels]
    for run in (quality.score_quality, toxicity.score_toxicity):
        a, b = (sorted(run(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (labels, lied))
        assert a == b


def test_empty_text_features():
    x, size, bounds = quality.line_features(pa.array(["", "a\n\nb b", "\n"], pa.large_string()))
    assert len(x) == 6 and size.tolist() == [0, 1, 0, 3, 0, 0] and bounds.tolist() == [0, 1, 4, 6]


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def first_of_each_group(texts):
    """The smallest id of each chain of texts with five-word similarity 0.8 or more; texts without words are alike."""
    sets, label = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and label[a] != label[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((label[a], label[b]))
                label = {d: x if c == y else c for d, c in label.items()}
    return set(label.values())


def cut_of_repeats(texts, width=50):
    """The words of each text that no window which also starts in a smaller id covers."""
    words, least = {d: (t or "").split() for d, t in texts.items()}, {}
    for d, w in words.items():
        for p in range(len(w) - width + 1):
            least[tuple(w[p : p + width])] = min(d, least.get(tuple(w[p : p + width]), d))
    gone = {d: {i for p in range(len(w) - width + 1) if least[tuple(w[p : p + width])] < d for i in range(p, p + width)} for d, w in words.items()}
    return {d: [x for i, x in enumerate(w) if i not in gone[d]] for d, w in words.items()}


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    import corpus_pipeline

    rows, labels = synthetic(90, 8)
    rows = [(d, f"{t} unique{d} tail{d} word{d * 7}") for d, t in rows]
    good = [d for d, q, _ in labels if q]
    passage, item = " ".join(f"p{i}" for i in range(70)), "the benchmark item that everybody knows by heart"
    rng = random.Random(9)
    tail = " ".join(f"q{i}" for i in range(60))
    rows += [(500, passage + " and own words"), (501, f"other start {passage} {tail}"), (502, rows[good[0]][1]), (503, f"see {item} here"), (504, None), (504, None), (505, "")]
    for k in range(6):  # near copies: a word more at the end, or one in the middle
        w = rows[good[k]][1].split()
        rows.append((510 + k, " ".join([*w, "more"] if k % 2 else [*w[:2], f"x{k}", *w[3:]])))
    rows += [(530, "see " + damaged(rng, item, 3) + " here"), (531, "the word benchmark is by no means an item")]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert not {d for d, q, _ in labels if not q} & seen["quality"].keys() and set(good) <= seen["quality"].keys()
    assert seen["near_dedup"].keys() == first_of_each_group(seen["quality"])
    assert {d: (t or "").split() for d, t in seen["substring_dedup"].items()} == cut_of_repeats(seen["near_dedup"])
    assert seen["substring_dedup"][501] == f"other start\n{tail}" and seen["substring_dedup"][500] == passage + " and own words"
    held = lambda t: least_edits(dc.fold(item), dc.fold(t)) <= dc.budget(len(dc.fold(item)))
    assert seen["decontamination"].keys() == {d for d, t in seen["substring_dedup"].items() if not held(t)}
    assert 503 in seen["substring_dedup"] and 503 not in seen["decontamination"] and 531 in seen["decontamination"]
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    ids = {d: t for d, t in seen["decontamination"].items()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = packed.groupby("doc_id").length.sum().to_dict()
    assert {d: n for d, n in lengths.items() if d != 504} == {d: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in ids.items() if d != 504}


def test_pipeline_stages_take_odd_tables(spark):
    """Nulls in every column, repeated rows, clashing extra columns, no rows at all."""
    import corpus_pipeline

    names = ["score", "held_out", "fp", "node", "__starts", "key", "offset"]
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
    rows = [(1, "one two three", *names), (1, "one two three", *names), (None, None, *[None] * len(names)), (2, "", *names), (None, "only words " * 4000, *names)]
    docs, data = spark.createDataFrame(rows, schema), "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        assert stage(spark, docs.limit(0), data).collect() == []
        got = out.collect()
        if name != "packing":
            assert out.schema.names == docs.schema.names and {r.doc_id for r in got} <= {1, 2, None}
        if name in ("substring_dedup", "decontamination"):
            assert sorted(map(str, got)) == sorted(map(str, docs.collect()))
