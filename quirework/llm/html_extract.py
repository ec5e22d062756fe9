"""HTML extraction: a tree-structured graphical model of the DOM, with sum-product message passing.

Nodes of a page's DOM, elements and text runs, are binary variables: content or not.  Potentials of a node
come from its features (tag, class and id, length, link density, punctuation, depth, place), those of an edge
from the kind of the child (block, inline, text).  Messages go up and down the tree, all pages of a batch at
once, level by level; they give the exact marginals of every node and edge.  The same marginals give the
gradient of the likelihood, which training follows with Adam steps.

Labelled pages are those that mark their content up as ``article`` or ``main``; these two tags, and the
attributes of such elements, are hidden from the features, so that the model carries over to pages without
them.  Training sees at most ``train_pages`` of them, those with the least hash of seed, identifier and HTML.
Extraction gives the text runs with a marginal of a half and more, in order, one line per block element.

Broken markup is mended: paragraphs, list items and table cells end where the next begins, end tags without
a start are dropped, unclosed comments, scripts and tags run to the end.  Scripts, styles and comments have
no text.  Null and empty pages, and those without text, have no nodes, empty content and a confidence of 0.
Without labelled pages no marginal is above a half by more than its tie, and all text is content.
Repeated rows are extracted each, and train as one page; a marginal of exactly a half (a tie) is content.  Very long
pages are read whole.  Empty tables give empty ones.  Other columns stay, whatever their names; those with the names
of results are replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework.llm.common import unused

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg iframe".split())
BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
#: Elements that end at the start of another: its name, and what they don't reach beyond.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CONTENT = frozenset(("article", "main"))
TAGS = "#text a b body div em footer form h1 h2 h3 h4 head header html i li nav ol p pre section span strong table td th title tr ul aside figure figcaption blockquote button label".split()
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
_ATTRIBUTES = 64
#: Where each group of features begins: tag, parent's tag, grandparent's tag, class and id, length, link density, ends of sentences, depth, children, place.
_SIZES = (len(TAGS) + 1, len(TAGS) + 1, len(TAGS) + 1, _ATTRIBUTES + 1, 12, 6, 6, 12, 6, 6)
_BEGIN = np.r_[0, np.cumsum(_SIZES)].astype(np.int64)
N_FEATURES = int(_BEGIN[-1])
KINDS = 3
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)|[^<]+|<""", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Page(NamedTuple):
    """The DOM in document order; parents come before their children, the first is the root."""

    parent: list[int]
    tag: list[str]
    names: list[int]
    text: list[str]
    inside: list[bool]


def _bucket(names: str) -> int:
    """A bucket of class and identifier, 0 for none: a plain polynomial, the same everywhere."""
    h = 0
    for b in names.lower().encode():
        h = (h * 131 + b) % 1_000_003
    return 1 + h % _ATTRIBUTES


def parse(source: str | None) -> Page:
    """The mended DOM of a page; a page without text or elements has no nodes."""
    parent, tag, names, text, inside = [-1], ["#root"], [0], [""], [False]
    stack, where, source = [0], 0, source or ""
    opened: dict[str, int] = {}  # how many elements of each name are open: nothing is sought in vain

    def close(k: int) -> None:
        for node in stack[k:]:
            opened[tag[node]] -= 1
        del stack[k:]

    while where < len(source):
        m = TOKEN.match(source, where)
        if m is None:
            break
        where, name = m.end(), m.group(2)
        if name is None:
            piece = m.group()
            if piece[0] != "<" or piece == "<":
                line = " ".join(html.unescape(piece).split())
                if line:
                    parent.append(stack[-1])
                    tag.append("#text")
                    names.append(0)
                    text.append(line)
                    inside.append(inside[stack[-1]])
            continue
        name = name.lower()
        if m.group(1):
            if opened.get(name):
                close(next(k for k in range(len(stack) - 1, 0, -1) if tag[stack[k]] == name))
            continue
        attributes = m.group(3)
        if name in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(source, where)
                where = end.end() if end else len(source)
            continue
        if name in BLOCK and opened.get("p"):
            for k in range(len(stack) - 1, 0, -1):
                if tag[stack[k]] == "p":
                    close(k)
                    break
                if tag[stack[k]] in BLOCK:
                    break
        if name in CLOSES:
            ends, bounds = CLOSES[name]
            for k in range(len(stack) - 1, 0, -1) if any(map(opened.get, ends)) else ():
                if tag[stack[k]] in ends:
                    close(k)
                    break
                if tag[stack[k]] in bounds:
                    break
        found = [a or b or c for a, b, c in NAMES.findall(attributes)] if attributes else []
        parent.append(stack[-1])
        tag.append(name)
        names.append(_bucket(" ".join(found)) if found and name not in CONTENT else 0)
        text.append("")
        inside.append(inside[stack[-1]] or name in CONTENT)
        if name not in VOID and not attributes.endswith("/"):
            stack.append(len(parent) - 1)
            opened[name] = opened.get(name, 0) + 1
    return Page(parent, tag, names, text, inside)


class Forest(NamedTuple):
    """The trees of several pages, as arrays; levels are the nodes of each depth below the roots."""

    parent: np.ndarray
    feature: np.ndarray
    kind: np.ndarray
    levels: list[np.ndarray]
    label: np.ndarray
    page: np.ndarray


def forest(pages: list[Page]) -> Forest:
    begin = np.r_[0, np.cumsum([len(p.parent) for p in pages])].astype(np.int64)
    parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + b) for p, b in zip(pages, begin, strict=False)])
    n = len(parent)
    page = np.repeat(np.arange(len(pages)), np.diff(begin))
    tag = np.array([_TAG_AT.get("div" if t in CONTENT else t, len(TAGS)) for p in pages for t in p.tag])
    names = np.array([x for p in pages for x in p.names])
    size = np.array([len(x) for p in pages for x in p.text], float)
    stops = np.array([x.count(".") + x.count("!") + x.count("?") + x.count(",") for p in pages for x in p.text], float)
    kind = np.array([2 if t == "#text" else 0 if t in BLOCK else 1 for p in pages for t in p.tag])
    up = np.maximum(parent, 0)
    depth, level, levels = np.zeros(n, np.int64), np.flatnonzero(parent < 0), []
    by_parent = np.argsort(parent, kind="stable")
    lo, hi = (np.searchsorted(parent[by_parent], np.arange(n), side=s) for s in ("left", "right"))
    while len(level):
        count = hi[level] - lo[level]
        total = int(count.sum())
        level = by_parent[np.repeat(lo[level] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(total)] if total else np.zeros(0, np.int64)
        if total:
            levels.append(level)
            depth[level] = len(levels)
    in_link = np.where(tag == _TAG_AT["a"], 1, 0)
    for nodes in levels:
        in_link[nodes] |= in_link[parent[nodes]]
    linked = np.where(in_link == 1, size, 0.0)
    for nodes in reversed(levels):
        for values in (size, stops, linked):
            np.add.at(values, parent[nodes], values[nodes])
    children = np.bincount(parent[parent >= 0], minlength=n)
    order = np.arange(n) - begin[page]
    place = order / np.maximum(1, np.diff(begin)[page])

    def log(x: np.ndarray, most: int) -> np.ndarray:
        return np.minimum(most - 1, np.log2(1 + x)).astype(np.int64)

    groups = (tag, tag[up], tag[up[up]], names, log(size, 12), np.minimum(5, 5.999 * linked / np.maximum(1, size)).astype(np.int64), log(stops, 6), np.minimum(11, depth), log(children, 6), np.minimum(5, 6 * place).astype(np.int64))
    feature = np.stack(groups, 1) + _BEGIN[:-1]
    return Forest(parent, feature, kind, levels, np.array([x for p in pages for x in p.inside], np.int64), page)


class Model(NamedTuple):
    unary: np.ndarray
    edge: np.ndarray

    @staticmethod
    def empty() -> Model:
        return Model(np.zeros(N_FEATURES), np.zeros((KINDS, 2, 2)))


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(-1)
    return top + np.log(np.exp(x - top[..., None]).sum(-1))


def marginals(trees: Forest, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """P(content) of every node, and the joint marginals (parent, child) of the edge above every node."""
    n = len(trees.parent)
    own = np.zeros((n, 2))
    own[:, 1] = model.unary[trees.feature].sum(1)
    edge = model.edge[trees.kind]
    belief, message = own.copy(), np.zeros((n, 2))
    for nodes in reversed(trees.levels):
        m = _log_sum(edge[nodes] + belief[nodes][:, None, :])
        message[nodes] = m - m.max(1, keepdims=True)
        np.add.at(belief, trees.parent[nodes], message[nodes])
    joint = np.zeros((n, 2, 2))
    for nodes in trees.levels:
        above = trees.parent[nodes]
        rest = belief[above] - message[nodes]
        pair = rest[:, :, None] + edge[nodes] + belief[nodes][:, None, :]
        p = np.exp(pair - pair.max((1, 2), keepdims=True))
        joint[nodes] = p / p.sum((1, 2), keepdims=True)
        down = _log_sum((rest[:, :, None] + edge[nodes]).swapaxes(1, 2))
        belief[nodes] += down - down.max(1, keepdims=True)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint


def fit(trees: Forest, steps: int = 120, rate: float = 0.1, penalty: float = 1e-3) -> Model:
    """Maximum likelihood, with a quadratic penalty, by Adam."""
    model, k = Model.empty(), KINDS * 4
    x, m, v = np.zeros(N_FEATURES + k), np.zeros(N_FEATURES + k), np.zeros(N_FEATURES + k)
    below = np.flatnonzero(trees.parent >= 0)
    y, n = trees.label.astype(float), max(1, len(trees.parent))
    cell = trees.kind[below] * 4 + trees.label[trees.parent[below]] * 2 + trees.label[below]
    seen = np.bincount(cell, minlength=k)
    for t in range(1, steps + 1):
        p, joint = marginals(trees, model)
        node = np.bincount(trees.feature.ravel(), np.repeat(y - p, trees.feature.shape[1]), N_FEATURES)
        expected = np.zeros((KINDS, 2, 2))
        np.add.at(expected, trees.kind[below], joint[below])
        g = np.r_[node, seen - expected.ravel()] / n - penalty * x
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        model = Model(x[:N_FEATURES], x[N_FEATURES:].reshape(KINDS, 2, 2))
    return model


def train(pages: DataFrame, train_pages: int = 400, seed: int = 0, steps: int = 120) -> Model:
    """A model of the labelled pages among ``pages`` (``page_id, html``); one task learns it from the sample."""
    labelled = pages.select(F.xxhash64(F.lit(seed), F.col("page_id").cast("long"), "html").alias("_place"), F.col("html").alias("_html")).filter(F.col("_html").rlike(r"(?i)<(article|main)[\s>]"))
    # the sample is drawn from the hashes alone, so that pages that aren't in it are not moved; at most train_pages numbers are sent
    sample = labelled.select("_place").orderBy("_place").limit(train_pages).distinct()
    # repeated rows are one page, so that train_pages bounds the rows of the one task as well
    found = labelled.join(F.broadcast(sample), "_place").groupBy("_place").agg(F.min("_html").alias("_html")).repartition(1)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources = [x for _, x in sorted((p, x) for b in batches for p, x in zip(b.column("_place").to_pylist(), b.column("_html").to_pylist(), strict=True))]
        if sources:
            model = fit(forest([parse(x) for x in sources]), steps)
            yield pa.RecordBatch.from_arrays([pa.array([model.unary.tobytes()], pa.binary()), pa.array([model.edge.tobytes()], pa.binary())], ["unary", "edge"])

    for r in found.mapInArrow(learn, "unary binary, edge binary").collect():
        return Model(np.frombuffer(r["unary"]), np.frombuffer(r["edge"]).reshape(KINDS, 2, 2))
    return Model.empty()


def content(page: Page, p: np.ndarray) -> tuple[str, int, int, float]:
    """The content, the numbers of text nodes and of those in it, and the mean certainty of the verdicts."""
    lines, line, block, n, good, sure = [], [], None, 0, 0, 0.0
    for k, tag in enumerate(page.tag):
        if tag != "#text":
            continue
        n += 1
        sure += max(p[k], 1 - p[k])
        if p[k] >= 0.5:
            good += 1
            up = page.parent[k]
            while up > 0 and page.tag[up] not in BLOCK:
                up = page.parent[up]
            if up != block and line:
                lines.append(" ".join(line))
                line = []
            block = up
            line.append(page.text[k])
    lines += [" ".join(line)] if line else []
    return "\n".join(lines), n, good, round(sure / n, 6) if n else 0.0


RESULTS = (("content", T.StringType()), ("n_text_nodes", T.LongType()), ("n_content_nodes", T.LongType()), ("confidence", T.DoubleType()))


def extract(pages: DataFrame, model: Model, html_col: str = "html", at_once: int = 4 << 20) -> DataFrame:
    """The rows, without their HTML, with ``content, n_text_nodes, n_content_nodes, confidence``."""
    results = {name for name, _ in RESULTS}
    kept = pages.select(*(F.col(f"`{c}`") for c in pages.columns if c not in results and c != html_col), F.col(f"`{html_col}`").alias(unused(pages, "html")[0]))
    schema = T.StructType([*kept.schema.fields[:-1], *(T.StructField(*r) for r in RESULTS)])
    sent = pages.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for whole in batches:
            sources, i = whole.column(whole.num_columns - 1).to_pylist(), 0
            while i < len(sources):
                j, size = i, 0
                while j < len(sources) and (j == i or size + len(sources[j] or "") <= at_once):
                    size += len(sources[j] or "")
                    j += 1
                dom = [parse(x) for x in sources[i:j]]
                trees = forest(dom)
                p, _ = marginals(trees, model)
                begin = np.r_[0, np.cumsum([len(d.parent) for d in dom])]
                out = [content(d, p[a:b]) for d, a, b in zip(dom, begin[:-1], begin[1:], strict=True)]
                columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in whole.columns[:-1]), *columns], [f.name for f in schema.fields])
                i = j

    return kept.mapInArrow(run, schema)
