from __future__ import annotations

from dataclasses import fields
from html.parser import HTMLParser

import numpy as np

from quillon.llm.html import blocks, extracted, fit, gradients, labelled, new_labeller, scores, target, train, vectors_of

from .conftest import DATA


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{x:"</p>"}</style><script>var t="</p><p>no";</script></head><body>
    <!-- <p>hidden</p> --><nav><ul><li><a href="/x?a=1>2">one</a></li><li>two</ul></nav><article class="main x" id=y><p>First <b>bold</b> text<br>line<p>Second
    </article></div><footer>&copy; me"""
    assert [(p[-1], t) for p, t in blocks(page)] == [("title", "A & B"), ("li", "one"), ("li", "two"), ("p", "First bold text"), ("p", "line"), ("p", "Second"), ("footer", "© me")]
    assert blocks(page)[3][0] == ("html", "body", "article main x y", "p")
    assert blocks("") == [] and blocks("a < b") == [((), "a < b")] and blocks("<p") == [((), "<p")] and blocks("<script>x") == []
    assert [target(p) for p, _ in blocks(page)] == [False, False, False, True, True, True, False]


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    net = new_labeller(5, 3)
    x, y = rng.normal(size=(6, 4, 5)), (rng.random((6, 4)) > 0.5).astype(float)
    mask = np.arange(6)[:, None] < np.array([6, 2, 1, 4])
    grad = gradients(net, x, mask, y)[1]
    for f in fields(net):
        p = getattr(net, f.name)
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in p.shape)
            old, e = p[at], 1e-5
            p[at] = old + e
            up = gradients(net, x, mask, y)[0]
            p[at] = old - e
            down = gradients(net, x, mask, y)[0]
            p[at] = old
            assert abs((up - down) / (2 * e) - getattr(grad, f.name)[at]) < 1e-6


def test_padding_does_not_matter():
    rng = np.random.default_rng(1)
    net = new_labeller(5, 3)
    x = rng.normal(size=(4, 1, 5))
    alone = scores(net, x, np.ones((4, 1), bool))[0][:, 0]
    wide = np.concatenate([np.concatenate([x, rng.normal(size=(3, 1, 5))]), rng.normal(size=(7, 1, 5))], 1)
    mask = np.ones((7, 2), bool)
    mask[4:, 0] = False
    assert np.allclose(scores(net, wide, mask)[0][:4, 0], alone)


class Plain(HTMLParser):
    """The text in article, by another parser."""

    def __init__(self) -> None:
        super().__init__()
        self.on, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.on += tag == "article"

    def handle_endtag(self, tag):
        self.on -= tag == "article" and self.on > 0

    def handle_data(self, data):
        if self.on:
            self.out.append(data)


def test_held_out_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    rows = {r.page_id: r.html for r in pages.collect()}
    net = train(pages, most=60)
    out = {r.page_id: r for r in extracted(pages, net).collect()}
    assert out.keys() == rows.keys()
    same = 0
    for k, page in rows.items():
        p = Plain()
        p.feed(page)
        same += "".join("".join(p.out).split()) == "".join(out[k].text.split())
    assert same > 0.95 * len(rows)
    bare = [[(("html", "body"), t) for _, t in blocks(h)] for h in list(rows.values())[:100]]  # no tag path at all
    want = [np.array([target(p) for p, _ in blocks(h)]) for h in list(rows.values())[:100]]
    got = labelled(net, bare)
    assert np.concatenate([a == b for a, b in zip(got, want)]).mean() > 0.8
    assert [len(v) for v in vectors_of(bare[:3])] == [len(b) for b in bare[:3]]


def test_edges(spark):
    big = "<article>" + "<p>para graph.</p>" * 20_000 + "</article>"
    pages = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "no tags at all", "k"), (4, big, "k"), (4, big, "k"), (None, "<nav>x</nav>", "k"), (5, "<p>&#0;&bogus; <<>> é", "k")], "page_id long, html string, text string")
    net = fit([blocks("<nav>a b</nav><article><p>Some words here.</p></article>")] * 5)
    out = extracted(pages, net).collect()
    assert len(out) == 7 and [r.text for r in out if r.page_id == 1] == [None] and [r.text for r in out if r.page_id == 2] == [""]
    assert {r.n_blocks for r in out if r.page_id == 4} == {20_000}
    plain = {r.page_id: r.text for r in extracted(pages, train(pages.limit(0))).collect()}
    assert plain[3] == "no tags at all" and plain[None] == "x"
    assert extracted(pages.limit(0), net).count() == 0
