"""Extraction against a slow reader of the given pages, with and without its threshold, and on common markup."""

import html
import re

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import html_text

PAGES = pd.read_parquet("/root/testdata/sf0.001/pages.parquet").html.tolist()


def slow_text(page):
    """The given pages have one article; what is between its block tags are its lines."""
    page = re.sub(r"(?s)<!--.*?-->|<(script|style|title|nav|footer|form)\b.*?</\1>|<div class=.?ad.*?</div>", "", page)
    article = re.search(r"(?s)<article.*?>(.*?)</article>", page)
    lines = re.split(r"</?(?:p|h1|br|ul|li|div)\b[^>]*>", article[1] if article else "")
    lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in lines]
    return "\n".join(x for x in lines if x)


def test_all_given_pages_equal_the_slow_reader():
    assert PAGES
    for page in PAGES:
        assert html_text.main_text(page) == slow_text(page)


def test_the_threshold_decides(monkeypatch):
    """Without it every given page keeps its menu, advert and footer; with too high a one none keeps its article."""
    want = [html_text.main_text(p) for p in PAGES]
    monkeypatch.setattr(html_text, "upper_cluster", lambda lines: lines)
    assert all(html_text.main_text(p) != w for p, w in zip(PAGES, want, strict=True))
    monkeypatch.undo()
    monkeypatch.setattr(html_text, "threshold", lambda values: 1e9)
    assert not any(html_text.main_text(p) for p in PAGES)


TEXT = "<p>A long first paragraph of the text, with much to say about it.</p>"
LINE = "A long first paragraph of the text, with much to say about it."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<div class="layout has-sidebar"><article>{TEXT}</article></div>', LINE),
        (f'<div class="content with-sidebar">{TEXT}</div>', LINE),
        (f'<article><h2 class="section-header">Part</h2>{TEXT}</article>', f"Part\n{LINE}"),
        (f'<article><p class="post-header-text">Lead</p><p class="header">Head</p>{TEXT}</article>', f"Lead\nHead\n{LINE}"),
        (f'<article class="social-science-article">{TEXT}</article>', LINE),
        (f"<article><p>Press <label>this</label> or <button>that</button> now.</p>{TEXT}</article>", f"Press this or that now.\n{LINE}"),
        (f"<article>{TEXT}<button>Share</button><p>End.</p></article>", f"{LINE}\nEnd."),
        (f'<article>{TEXT}<p>Go <span class="ad">buy now</span>on.</p></article>', f"{LINE}\nGo on."),
        (f"<article>{TEXT}</article><div>A long text beside the article, as long as it is, on something else.</div>", LINE),
        (f"<title>t<nav><a href=x>Home</a></nav>{TEXT}", ""),
        (f"<head><meta charset=utf-8><nav><a href=x>Home</a></nav>{TEXT}", LINE),
        ("<nav><a href=x>Home</a></nav><footer>Foot</footer>", ""),
        (f'<article>{"<img src=x>" * 300}<p>a</p>{TEXT}<ul class="comment-list"><li>{"Nice. " * 200}</ul></article>', f"a\n{LINE}"),
        (f"{TEXT}<p>Short.</p><div><a href=x>one</a></div><div><a href=y>two links</a></div>", f"{LINE}\nShort."),
    ],
)
def test_markup(page, want):
    assert html_text.main_text(page) == want


def test_ratios_alone_decide_on_pages_without_marks():
    """Nothing is named here: lines of many tags and little text go, but for those that smoothing joins to the text."""
    menu = "".join(f"<div><b><i>w{i}</i></b></div>" for i in range(12))
    got = html_text.main_text(f"{menu}<div>{TEXT}<p>And more of the text here.</p></div>{menu}").split("\n")
    assert [x for x in got if len(x) > 3] == [LINE, "And more of the text here."] and len(got) <= 4


def test_smoothing_is_a_normalised_gaussian():
    got = html_text.smooth(np.array([0.0, 0, 8, 0, 0]), 1.0)
    assert got.argmax() == 2 and np.allclose(got, got[::-1]) and html_text.smooth(np.full(4, 3.0)) == pytest.approx(3.0)
