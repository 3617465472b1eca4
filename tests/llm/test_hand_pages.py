"""The block labeller on pages of other make than those that taught it, by the words of their main text."""

from collections import Counter

import pytest

from tallyspark.llm import html

from .hand_pages import PAGES


def f1(got, want):
    a, b = Counter(got.split()), Counter(want.split())
    common = sum((a & b).values())
    return 2 * common / max(1, a.total() + b.total())


@pytest.fixture(scope="module")
def model():
    m = html.Labeller()
    m.w = html.train()
    return m


def test_words_of_hand_written_pages(model):
    pages = [html.blocks(p) for p, _ in PAGES]
    texts = [" ".join(b.text for b, ok in zip(p, keep, strict=True) if ok) for p, keep in zip(pages, html.label(model, pages), strict=True)]
    scores = [f1(t, w) for t, (_, w) in zip(texts, PAGES, strict=True)]
    assert sum(scores) / len(scores) >= 0.9, [(round(s, 2), t) for s, t in zip(scores, texts, strict=True) if s < 0.9]
    assert sum(s >= 0.8 for s in scores) >= 17


def test_very_long_page(model):
    page = "<html><body><nav><a href=/>x</a></nav><article><h1>Title</h1>" + "<p>Some sentence of the story, one of many.</p>" * 20_000 + "</article></body></html>"
    found = html.blocks(page)
    keep = html.label(model, [found])[0]
    assert len(found) == 20_002 and keep[1:].mean() > 0.99
