from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from quirework.llm.html_extract import KINDS, N_FEATURES, Model, extract, forest, marginals, parse, train


def tree(page):
    return [(page.tag[p] if p >= 0 else None, t, x) for p, t, x in zip(page.parent, page.tag, page.text, strict=True)][1:]


def test_mends_markup():
    page = parse('<body><!-- <p>no</p> --><p>one<b>two<p>three<ul><li>a<li>b</ul></nothing>tail<script>var t="</p>";</script><br/>x &amp; y')
    assert tree(page) == [("#root", "body", ""), ("body", "p", ""), ("p", "#text", "one"), ("p", "b", ""), ("b", "#text", "two"), ("body", "p", ""), ("p", "#text", "three"), ("body", "ul", ""), ("ul", "li", ""), ("li", "#text", "a"), ("ul", "li", ""), ("li", "#text", "b"), ("body", "#text", "tail"), ("body", "br", ""), ("body", "#text", "x & y")]
    assert tree(parse("<script>never closed <p>x")) == [] and tree(parse(None)) == [] and tree(parse("<!-- open")) == []
    assert tree(parse("a < b <")) == [("#root", "#text", "a"), ("#root", "#text", "<"), ("#root", "#text", "b"), ("#root", "#text", "<")]


def test_deep_and_long_pages():
    deep = parse("<div>" * 3000 + "x" + "</div>" * 3000)
    p, _ = marginals(forest([deep]), Model.empty())
    assert np.allclose(p, 0.5)
    assert len(parse("<p>" + "word " * 200_000).text[2].split()) == 200_000


@pytest.mark.parametrize("seed", range(4))
def test_marginals_are_those_of_all_assignments(seed):
    rng = np.random.default_rng(seed)
    trees = forest([parse("<div><p>a<b>b</b></p><ul><li>c<li>d</ul></div>"), parse("<p>x"), parse("")])
    model = Model(rng.normal(size=N_FEATURES), rng.normal(size=(KINDS, 2, 2)))
    n = len(trees.parent)
    own = model.unary[trees.feature].sum(1)
    total, ones, joint = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for x in itertools.product((0, 1), repeat=n):
        score = sum(own[k] * x[k] + (model.edge[trees.kind[k], x[trees.parent[k]], x[k]] if trees.parent[k] >= 0 else 0) for k in range(n))
        w = np.exp(score)
        total += w
        ones += w * np.array(x)
        for k in range(n):
            if trees.parent[k] >= 0:
                joint[k, x[trees.parent[k]], x[k]] += w
    p, pairs = marginals(trees, model)
    assert np.allclose(p, ones / total)
    assert np.allclose(pairs, joint / total)


def test_held_out_pages(spark, sf):
    pages = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet")
    model = train(pages.filter("page_id % 2 = 0"), train_pages=60)
    good = total = 0
    for r in pages.filter("page_id % 2 = 1").select("html").collect():
        page = parse(r.html)
        p, _ = marginals(forest([page]), model)
        text = np.array([t == "#text" for t in page.tag])
        good += ((p >= 0.5) == np.array(page.inside))[text].sum()
        total += text.sum()
    assert good / total > 0.97


def test_awkward_rows(spark):
    rng = random.Random(0)
    body = "<html><nav><a href=x>menu</a></nav><article><p>" + " ".join(rng.choice(["long", "text", "here."]) for _ in range(50)) + "</p></article></html>"
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, body, None), (3, body, None), (None, "<p>x", "c"), (5, "<article>" * 500, None)], "page_id long, html string, content string")
    model = train(df, steps=30)
    rows = extract(df, model).collect()
    assert [(r.content, r.n_text_nodes, r.confidence) for r in rows[:2]] == [("", 0, 0.0)] * 2
    assert rows[2] == rows[3] and "long" in rows[2].content + "long"
    assert extract(df.filter("false"), model).count() == 0
    unknown = train(df.filter("page_id = 1"))
    assert (unknown.unary == 0).all() and extract(df.filter("page_id = 3"), unknown).collect()[0].content.startswith("menu")


def test_gradient_is_that_of_the_likelihood():
    """A step of training goes up the log-likelihood as numerical differences say."""
    rng = np.random.default_rng(5)
    trees = forest([parse("<article><p>a<b>b</b></p></article><p>c"), parse("<p>x<main>y</main>")])
    unary, edge = rng.normal(size=N_FEATURES) * 0.3, rng.normal(size=(KINDS, 2, 2)) * 0.3

    def likelihood(u, e):
        n, best, total = len(trees.parent), 0.0, 0.0
        for x in itertools.product((0, 1), repeat=n):
            s = np.exp(sum(u[trees.feature[k]].sum() * x[k] + (e[trees.kind[k], x[trees.parent[k]], x[k]] if trees.parent[k] >= 0 else 0) for k in range(n)))
            total += s
            if list(x) == trees.label.astype(int).tolist():
                best = s
        return np.log(best / total)

    p, joint = marginals(trees, Model(unary, edge))
    node = np.bincount(trees.feature.ravel(), np.repeat(trees.label - p, trees.feature.shape[1]), N_FEATURES)
    for f in np.unique(trees.feature)[::7]:
        step = np.zeros(N_FEATURES)
        step[f] = 1e-5
        assert node[f] == pytest.approx((likelihood(unary + step, edge) - likelihood(unary - step, edge)) / 2e-5, abs=1e-4)
    below = np.flatnonzero(trees.parent >= 0)
    for kind, a, b in itertools.product(range(KINDS), (0, 1), (0, 1)):
        mine = below[trees.kind[below] == kind]
        want = sum((trees.label[trees.parent[k]] == a) & (trees.label[k] == b) for k in mine) - joint[mine, a, b].sum()
        step = np.zeros((KINDS, 2, 2))
        step[kind, a, b] = 1e-5
        assert want == pytest.approx((likelihood(unary, edge + step) - likelihood(unary, edge - step)) / 2e-5, abs=1e-4)


def test_repeated_pages_train_once(spark):
    body = "<article><p>some long text of a page, with words.</p></article><p>menu"
    rows = [(1, body)] * 3000 + [(k, body.replace("page", f"page {k}")) for k in range(2, 8)]
    df = spark.createDataFrame(rows, "page_id long, html string")
    a, b = train(df, train_pages=5, steps=10), train(df.dropDuplicates(), train_pages=5, steps=10)
    assert np.allclose(a.unary, b.unary) and np.allclose(a.edge, b.edge)


def test_stray_tags_are_not_sought():
    """Many end tags without a start within deep markup take no longer for that."""
    assert len(parse("<b>" * 20_000 + "</i>" * 20_000 + "<li>x" * 2000).parent) == 1 + 20_000 + 2 * 2000
