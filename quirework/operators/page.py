"""Passes over one page at a time that are greedy or recursive: lines of glyphs, reading order, figures, tables.

Each is a map over Arrow batches or a grouped one, keyed by document and page; the kernels are plain Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quirework.operators.groups import whole_groups
from quirework.operators.stats import pooled_mode

Box = tuple[float, float, float, float]


def _hull(boxes: list[Box]) -> Box:
    return min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)


def _x_overlap(a: Box, b: Box) -> float:
    return min(a[2], b[2]) - max(a[0], b[0])


def _y_overlap(a: Box, b: Box) -> float:
    return min(a[3], b[3]) - max(a[1], b[1])


# ---- reading order


def _cut_at_gaps(at: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: float) -> list[np.ndarray] | None:
    """Groups between the gaps that are nearly as wide as the widest, if that exceeds ``least``."""
    order = at[np.argsort(lo[at], kind="stable")]
    gap = lo[order][1:] - np.maximum.accumulate(hi[order])[:-1]
    if not len(gap) or not gap.max() > least:
        return None
    return np.split(order, np.flatnonzero(gap >= gap.max() * 0.85) + 1)


def reading_order(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, baseline: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of a page's lines as they are read: cut at white vertical stripes, else at horizontal ones, recursively."""
    tall = np.maximum(y1 - y0, size)
    out: list[np.ndarray] = []
    work: list[tuple[np.ndarray, int]] = [(np.arange(len(x0)), 0)]
    while work:
        at, depth = work.pop()
        parts = None
        if len(at) > 1 and depth < 32:
            if len(at) >= 4:
                parts = _cut_at_gaps(at, x0, x1, 9.0)
            if parts is None:
                heights = np.sort(tall[at][tall[at] > 0])
                parts = _cut_at_gaps(at, y0, y1, (heights[len(heights) // 2] if len(heights) else 10.0) * 0.15)
        if parts is None:
            out.append(at[np.lexsort((x0[at], baseline[at]))])
        else:
            work += [(p, depth + 1) for p in reversed(parts)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def reading_order_of_pages(page: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, baseline: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``reading_order`` of many pages at once, whose lines stand together: ``page`` never decreases.

    All parts of one depth are cut in step.  Pages with coordinates that aren't finite are read one by one.
    """
    n = len(page)
    if not n:
        return np.zeros(0, np.int64)
    tall = np.maximum(y1 - y0, size)
    starts = np.flatnonzero(np.diff(page, prepend=page[0] - 1))
    odd = np.logical_or.reduceat(~np.isfinite(x0 + x1 + y0 + y1 + baseline + size), starts)
    at, seg = np.arange(n), np.repeat(np.arange(len(starts)), np.diff(starts, append=n))
    live = ~odd
    ranks = {k: np.unique(hi, return_inverse=True) for k, hi in (("x", x1), ("y", y1))}

    def cut(rows: np.ndarray, lo: np.ndarray, axis: str, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorts the rows of the parts that are cut; which parts those are, and the rows at which new ones begin."""
        values, rank = ranks[axis]
        s = seg[rows]
        order = np.lexsort((lo[at[rows]], s))
        lines = at[rows][order]
        reach = values[np.maximum.accumulate(s * len(values) + rank[lines]) - s * len(values)]
        inner = np.flatnonzero(s[1:] == s[:-1])
        gap, of = lo[lines[inner + 1]] - reach[inner], s[inner]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        most = np.zeros(len(live))
        most[of[first]] = np.maximum.reduceat(gap, first)
        done = np.zeros(len(live), bool)
        done[of[first]] = most[of[first]] > least[of[first]]
        moved = done[s]
        at[rows[moved]] = lines[moved]
        return done, rows[inner + 1][done[of] & (gap >= most[of] * 0.85)]

    for _ in range(32):
        many = np.bincount(seg, minlength=len(live))
        begins = np.zeros(n, bool)
        cut_at = np.zeros(len(live), bool)
        rows = np.flatnonzero((live & (many >= 4))[seg])
        if len(rows):
            cut_at, new = cut(rows, x0, "x", np.full(len(live), 9.0))
            begins[new] = True
        rows = np.flatnonzero((live & (many >= 2) & ~cut_at)[seg])
        if len(rows):
            high = rows[tall[at[rows]] > 0]
            high = high[np.lexsort((tall[at[high]], seg[high]))]
            count = np.bincount(seg[high], minlength=len(live))
            usual = np.full(len(live), 10.0)
            usual[count > 0] = tall[at[high[(np.cumsum(count) - count + count // 2)[count > 0]]]]
            also, new = cut(rows, y0, "y", usual * 0.15)
            begins[new] = True
            cut_at = cut_at | also
        if not cut_at.any():
            break
        old = seg
        seg = np.cumsum(begins | (np.diff(old, prepend=-1) > 0)) - 1
        live = cut_at[old[np.flatnonzero(np.diff(seg, prepend=-1))]]
    at = at[np.lexsort((x0[at], baseline[at], seg))]
    for k in np.flatnonzero(odd):
        a, b = starts[k], starts[k + 1] if k + 1 < len(starts) else n
        at[a:b] = a + reading_order(x0[a:b], y0[a:b], x1[a:b], y1[a:b], baseline[a:b], size[a:b])
    return at


def in_reading_order(lines: DataFrame) -> DataFrame:
    """The lines with ``ord``, their place on the page.

    Pages arrive whole and one after another, so that a batch's are ordered at once; the last waits for the next batch.
    """
    schema = T.StructType([*(f for f in lines.schema.fields if f.name != "ord"), T.StructField("ord", T.IntegerType())])
    kept = lines.select(*schema.names[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, page, starts in whole_groups(batches, ["doc_id", "page"]):
            c = {k: table.column(k).to_numpy().astype(np.float64) for k in ("x0", "y0", "x1", "y1", "baseline", "size")}
            at = reading_order_of_pages(page, **c)
            yield from table.take(pa.array(at)).append_column("ord", pa.array(np.arange(len(at)) - starts[page], pa.int32())).to_batches()

    return kept.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page").mapInArrow(run, schema)


# ---- lines of glyphs


def word_gap(ratios: list[float]) -> float:
    """The gap, in sizes, beyond which a word ends: the split of gaps with the greatest variance between its sides."""
    gaps = np.sort([r for r in ratios if np.isfinite(r)])
    n = len(gaps)
    if n < 4:
        return 0.19
    below = np.cumsum(gaps)[:-1]
    k = np.arange(1, n)
    between = k * (n - k) * (below / k - (gaps.sum() - below) / (n - k)) ** 2
    s = int(np.argmax(between)) + 1
    if gaps[s] < 0.10 or gaps[s:].mean() < abs(gaps[:s].mean()) * 2.5:
        return 0.19
    return float(np.clip((gaps[s - 1] + gaps[s]) / 2, 0.10, 0.19))


class _Line:
    """Glyphs on one baseline."""

    def __init__(self, glyphs: list[dict[str, Any]]) -> None:
        self.glyphs = glyphs
        self.measure()

    def measure(self) -> None:
        g = self.glyphs
        if not g:
            return
        self.box = _hull([x["box"] for x in g])
        self.size = pooled_mode([x["size"] for x in g], [max(x["box"][2] - x["box"][0], 0.1) for x in g], 0.25) or 0.0
        main = sorted(x["oy"] for x in g if abs(x["size"] - self.size) < 0.25) or sorted(x["oy"] for x in g)
        self.baseline = main[len(main) // 2]
        self.bold = 2 * sum(bool(x["flags"] & 256) for x in g) > len(g)
        self.italic = 2 * sum(bool(x["flags"] & 1) for x in g) > len(g)

    def words(self) -> list[dict[str, Any]]:
        g = self.glyphs
        marked = any(x["break"] for x in g)
        ratios = [(b["box"][0] - a["box"][2]) / max(min(a["size"], b["size"]), 1.0) for a, b in zip(g, g[1:], strict=False)]
        most = word_gap(ratios)
        starts = [0] + [i for i in range(1, len(g)) if (g[i]["break"] if marked else ratios[i - 1] > most)]
        out = []
        for a, b in zip(starts, [*starts[1:], len(g)], strict=True):
            x0, y0, x1, y1 = _hull([x["box"] for x in g[a:b]])
            out.append({"text": "".join(x["text"] for x in g[a:b]), "x0": x0, "y0": y0, "x1": x1, "y1": y1, "start": a, "end": b})
        return out


def _by_baseline(glyphs: list[dict[str, Any]]) -> list[_Line]:
    """Each glyph goes to the nearest of the last eight lines begun, if it is near enough, else it begins one."""
    lines: list[tuple[float, float, list]] = []
    for g in glyphs:
        best = None
        for line in reversed(lines[-8:]):
            off = abs(line[0] - g["oy"])
            if off <= max(0.28 * min(line[1], g["size"]), 0.5) and (best is None or off < best[0]):
                best = (off, line)
        if best:
            best[1][2].append(g)
        else:
            lines.append((g["oy"], g["size"], [g]))
    return [_Line(x[2]) for x in lines]


def _absorb_scripts(lines: list[_Line]) -> list[_Line]:
    """Small lines beside the glyphs of a larger one are its scripts."""
    gone: set[int] = set()
    moves = []
    for k in sorted(range(len(lines)), key=lambda i: -lines[i].size):
        small = lines[k]
        tall = small.box[3] - small.box[1]
        if tall <= 0:
            continue
        hosts = [
            (abs(h.baseline - small.baseline), i)
            for i, h in enumerate(lines)
            if i != k and i not in gone and small.size <= h.size * 0.85 and _y_overlap(h.box, small.box) >= tall * 0.25 and _x_overlap(h.box, small.box) > -1.5 * h.size and not (abs(h.baseline - small.baseline) > 0.6 * h.size and len(small.glyphs) >= 20)
        ]
        if hosts:
            gone.add(k)
            moves.append((k, min(hosts)[1]))
    for k, host in moves:
        for g in lines[k].glyphs:
            g["script"] = "super" if g["oy"] < lines[host].baseline else "sub"
        lines[host].glyphs = lines[host].glyphs + lines[k].glyphs
        lines[k].glyphs = []
    return [x for x in lines if x.glyphs]


def _drop_capital(lines: list[_Line], line: _Line) -> _Line | None:
    """The line that a large initial belongs to: the topmost one set beside it."""
    first, rest = line.glyphs[0], line.glyphs[1:]
    body = line.size
    if not rest or len(first["text"]) != 1 or not first["text"].isupper() or body <= 0 or not 1.8 * body <= first["size"] <= 6.0 * body:
        return None
    edge = first["box"][2]
    if any(g["size"] > 1.8 * body for g in rest) or min(g["box"][0] for g in rest) < edge - 0.25 * body:
        return None
    beside = [x for x in lines if x is not line and abs(x.size - body) <= 0.5 and first["box"][1] < x.baseline < line.baseline and edge - 0.25 * body <= x.box[0] <= edge + 2 * body]
    return min(beside, key=lambda x: x.baseline) if beside else None


def page_lines(glyphs: list[dict[str, Any]]) -> list[_Line]:
    """The lines of a page, by baseline and left edge."""
    lines = _absorb_scripts(_by_baseline(sorted(glyphs, key=lambda g: (g["oy"], g["ox"]))))
    for line in lines:
        kept, pending = [], False
        for g in sorted(line.glyphs, key=lambda g: g["ox"]):
            if g["text"].isspace():
                pending = bool(kept)
            else:
                g["break"], pending = pending, False
                kept.append(g)
        line.glyphs = kept
        line.measure()
    lines = [x for x in lines if x.glyphs]
    for line, to in [(x, t) for x in lines if (t := _drop_capital(lines, x))]:
        capital = line.glyphs.pop(0)
        capital["break"] = False
        to.glyphs.insert(0, capital)
        line.measure()
        to.measure()
    return sorted((x for x in lines if x.glyphs), key=lambda x: (x.baseline, x.box[0]))


LINES = "doc_id long, page int, ord int, text string, baseline float, size float, x0 float, y0 float, x1 float, y1 float, bold boolean, italic boolean, words array<struct<text: string, x0: float, y0: float, x1: float, y1: float>>"


def build_lines(glyphs: DataFrame) -> DataFrame:
    """Lines with their words, of glyphs ``doc_id, page, text, x0, y0, x1, y1, ox, oy, size, angle, flags``.

    Glyphs that don't stand upright are left out.
    """
    from pyspark.sql import functions as F

    from quirework.functions.geometry import is_horizontal

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        each = [{"text": r["text"], "box": (r["x0"], r["y0"], r["x1"], r["y1"]), "ox": r["ox"], "oy": r["oy"], "size": r["size"], "flags": r["flags"] or 0, "break": False, "script": None} for r in rows]
        out = []
        for k, line in enumerate(page_lines(each)):
            words = line.words()
            out.append({"doc_id": rows[0]["doc_id"], "page": rows[0]["page"], "ord": k, "text": " ".join(w["text"] for w in words), "baseline": line.baseline, "size": line.size, "x0": line.box[0], "y0": line.box[1], "x1": line.box[2], "y1": line.box[3], "bold": line.bold, "italic": line.italic, "words": words})
        return pa.Table.from_pylist(out, schema=_LINES_ARROW)

    upright = glyphs.filter(is_horizontal(F.col("angle")) & F.col("text").isNotNull() & (F.col("text") != ""))
    return upright.select("doc_id", "page", "text", "x0", "y0", "x1", "y1", "ox", "oy", "size", "flags").groupBy("doc_id", "page").applyInArrow(run, LINES)


_WORD = pa.struct([("text", pa.string()), ("x0", pa.float32()), ("y0", pa.float32()), ("x1", pa.float32()), ("y1", pa.float32())])
_LINES_ARROW = pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("ord", pa.int32()), ("text", pa.string()), ("baseline", pa.float32()), ("size", pa.float32()), *((k, pa.float32()) for k in ("x0", "y0", "x1", "y1")), ("bold", pa.bool_()), ("italic", pa.bool_()), ("words", pa.list_(_WORD))])


# ---- figures


def merge_boxes(boxes: list[Box], images: list[bool], gap: float = 24.0) -> list[tuple[Box, int, int]]:
    """Boxes that lie within a gap of each other as one, until none do: box, images and paths of each."""
    out = [(b, int(i), int(not i)) for b, i in zip(boxes, images, strict=True)]
    while True:
        kept: list[tuple[Box, int, int]] = []
        for region in out:
            k = next((k for k, e in enumerate(kept) if _x_overlap(e[0], region[0]) >= -gap and _y_overlap(e[0], region[0]) >= -gap), None)
            if k is None:
                kept.append(region)
            else:
                e = kept[k]
                kept[k] = (_hull([e[0], region[0]]), e[1] + region[1], e[2] + region[2])
        if len(kept) == len(out):
            return kept
        out = kept


def figure_boxes(boxes: list[Box], images: list[bool], width: float, height: float) -> list[tuple[Box, int, int]]:
    """The figures of a page: of merged boxes those that take 1.5 to 85 percent of it, aren't narrow, and have an image or eight paths."""
    some = [k for k, b in enumerate(boxes) if b[2] > b[0] and b[3] > b[1]]
    area, out = max(1.0, width * height), []
    for (x0, y0, x1, y1), n_images, n_paths in merge_boxes([boxes[k] for k in some], [images[k] for k in some]):
        if 0.015 <= (x1 - x0) * (y1 - y0) / area <= 0.85 and min(x1 - x0, y1 - y0) >= 36 and (n_images or n_paths >= 8):
            out.append(((x0, y0, x1, y1), n_images, n_paths))
    return out


def figures(marks: DataFrame) -> DataFrame:
    """``doc_id, page, region, x0, y0, x1, y1, images, paths`` of marks ``doc_id, page, x0, y0, x1, y1, image, page_width, page_height``.

    A region is a figure if it takes 1.5 to 85 percent of the page, isn't narrow, and has an image or eight paths.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        found = figure_boxes([(r["x0"], r["y0"], r["x1"], r["y1"]) for r in rows], [r["image"] for r in rows], rows[0]["page_width"], rows[0]["page_height"])
        out = [{"doc_id": rows[0]["doc_id"], "page": rows[0]["page"], "region": k, "x0": b[0], "y0": b[1], "x1": b[2], "y1": b[3], "images": i, "paths": p} for k, (b, i, p) in enumerate(found)]
        return pa.Table.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("region", pa.int32()), *((k, pa.float32()) for k in ("x0", "y0", "x1", "y1")), ("images", pa.int32()), ("paths", pa.int32())]))

    return marks.groupBy("doc_id", "page").applyInArrow(run, "doc_id long, page int, region int, x0 float, y0 float, x1 float, y1 float, images int, paths int")


# ---- tables


def group_rules(rules: list[Box], body: float, figures: list[Box], captions: list[tuple[float, float]]) -> list[list[Box]]:
    """Chains of horizontal rules that may belong to one table; captions are (baseline, centre)."""
    chains: list[list[Box]] = []
    for rule in sorted(rules, key=lambda r: r[1]):
        best: tuple[float, list[Box]] | None = None
        for chain in chains:
            last = chain[-1]
            narrow, wide = sorted((last[2] - last[0], rule[2] - rule[0]))
            share = _x_overlap(last, rule) / max(narrow, 1.0)
            if rule[1] - last[3] > 320 or share < 0.6 or narrow / max(wide, 1.0) < 0.25:
                continue
            if any(f[1] >= last[3] and f[3] <= rule[1] for f in figures):
                continue
            left, right = min(last[0], rule[0]), max(last[2], rule[2])
            if any(last[3] < y < rule[1] and left <= x <= right for y, x in captions):
                continue
            if best is None or share >= best[0]:
                best = (share, chain)
        if best:
            best[1].append(rule)
        else:
            chains.append([rule])
    return [c for c in chains if len(c) >= 2 and max(r[2] - r[0] for r in c) >= 12 * body]


def table_columns(rows: list[list[dict[str, Any]]], region: Box, body: float) -> list[tuple[float, float]]:
    """Columns of a table: stretches that words of enough rows cover, with wide enough gaps between."""
    width = region[2] - region[0]
    if width <= 0:
        return []
    bins = int(np.ceil(width)) + 1
    taken = np.zeros(bins, np.int64)
    for words in rows:
        mask = np.zeros(bins, bool)
        for w in words:
            lo, hi = min(max(int(np.floor(w["x0"] - region[0])), 0), bins - 1), min(max(int(np.ceil(w["x1"] - region[0])), 0), bins)
            mask[lo:hi] = True
        taken += mask
    full = np.flatnonzero(taken > int(np.floor(np.float32(len(rows)) * np.float32(0.34))))
    if not len(full):
        return []
    breaks = np.flatnonzero(np.diff(full) - 1 >= max(0.55 * body, 2.0))
    begins, ends = full[np.r_[0, breaks + 1]], full[np.r_[breaks, len(full) - 1]] + 1
    return [(region[0] + float(a), region[0] + float(b)) for a, b in zip(begins, ends, strict=True)]


def row_cells(words: list[dict[str, Any]], columns: list[tuple[float, float]]) -> list[str]:
    """A row's words by the column that their centre is in, or nearest to."""
    cells: list[list[str]] = [[] for _ in columns]
    for w in words:
        c = (w["x0"] + w["x1"]) / 2
        k = min(range(len(columns)), key=lambda i: max(columns[i][0] - c, c - columns[i][1], 0.0))
        cells[k].append(w["text"])
    return [" ".join(c) for c in cells]


def page_tables(rules: list[Box], lines: list[dict[str, Any]], body: float, figures: list[Box]) -> list[dict[str, Any]]:
    """Tables of a page: their box, rows, number of header rows, and the indices of the lines that they take."""
    from re import IGNORECASE, compile

    caption = compile(r"\s*tab(?:le)?[.:]*\s+(?:[0-9]+|(?-i:[IVXL]+))[.:)]*(?:\s|$)", IGNORECASE)
    captions = [(x["baseline"], (x["x0"] + x["x1"]) / 2) for x in lines if caption.match(x["text"])]
    outside = [r for r in rules if not any(f[0] <= r[0] and f[1] <= r[1] and f[2] >= r[2] and f[3] >= r[3] for f in figures)]
    out, used = [], set()
    for chain in group_rules(outside, body, figures, captions):
        region = (min(r[0] for r in chain), chain[0][1], max(r[2] for r in chain), chain[-1][3])
        inside = [k for k, x in enumerate(lines) if k not in used and region[1] < x["baseline"] < region[3] and region[0] - body <= (x["x0"] + x["x1"]) / 2 <= region[2] + body]
        inside.sort(key=lambda k: lines[k]["baseline"])
        if len(inside) < 2:
            continue
        columns = table_columns([lines[k]["words"] for k in inside], region, body)
        rows = [row_cells(lines[k]["words"], columns) for k in inside] if len(columns) >= 2 else []
        if not any(sum(c != "" for c in r) >= 2 for r in rows):
            continue
        used |= set(inside)
        heads = 0
        if len(chain) >= 3:
            heads = next((i for i, k in enumerate(inside) if not lines[k]["baseline"] < chain[1][3]), len(inside))
        out.append({"box": region, "rows": rows, "header_rows": heads, "lines": inside})
    return out
