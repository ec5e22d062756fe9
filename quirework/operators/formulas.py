"""Formulas from placed glyphs and rules: a tree of fractions, radicals, operators and scripts, as LaTeX."""

from __future__ import annotations

from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.maths import latex_of, word_role
from quirework.operators.stats import pooled_mode

Item = dict[str, Any]
LARGE = frozenset("∑∏∐∫∬∮⋃⋂")
GUESS = 0.75


class _Doubt:
    """Confidence, lowered by a quarter with each guess."""

    def __init__(self) -> None:
        self.value = 1.0

    def guess(self) -> None:
        self.value *= GUESS


def _base(items: list[Item]) -> tuple[float, float]:
    size = pooled_mode([i["size"] for i in items], [max(i["x1"] - i["x0"], 0.1) for i in items], 0.3) or 1.0
    lines = sorted(i["oy"] for i in items if abs(i["size"] - size) < 0.3) or sorted(i["oy"] for i in items)
    return size, lines[len(lines) // 2]


def _script(mark: str, tex: str) -> str:
    return f"{mark}{tex}" if len(tex) == 1 else f"{mark}{{{tex}}}"


def _region(items: list[Item], rules: list[Item], doubt: _Doubt) -> str:
    """LaTeX of a region: split at its widest fraction bar, else read from left to right."""
    if not items:
        return ""
    size, _ = _base(items)
    best = None
    for rule in rules:
        over = [i for i in items if min(i["x1"], rule["x1"]) > max(i["x0"], rule["x0"])]
        above, below = [i for i in over if i["oy"] < rule["y0"] + 0.01], [i for i in over if i["oy"] > rule["y1"] - 0.01]
        wide = rule["x1"] - rule["x0"]
        if wide >= 0.9 * min(size, min((i["size"] for i in over), default=size)) and above and below and not any(i["text"] == "√" for i in over) and (best is None or wide >= best[0]):
            best = (wide, rule, above, below)
    if best is None:
        return _row(items, rules, doubt)
    _, rule, above, below = best
    inner = [r for r in rules if r is not rule]
    taken = {id(i) for i in above + below}
    left = [i for i in items if id(i) not in taken and i["x0"] < rule["x0"]]
    right = [i for i in items if id(i) not in taken and i["x0"] >= rule["x0"]]
    parts = [_region(left, inner, doubt), rf"\frac{{{_region(above, [r for r in inner if r['y0'] < rule['y0']], doubt)}}}{{{_region(below, [r for r in inner if r['y0'] > rule['y0']], doubt)}}}", _region(right, inner, doubt)]
    return " ".join(p for p in parts if p)


def _row(items: list[Item], rules: list[Item], doubt: _Doubt) -> str:
    items = sorted(items, key=lambda i: i["x0"])
    size, line = _base(items)
    out, k = "", 0
    while k < len(items):
        it = items[k]
        c, k = it["text"], k + 1
        if c == "√":
            under = [i for i in items[k:] if i["x0"] < it["x1"]]
            bar = next((r for r in rules if abs(r["x0"] - it["x1"]) <= 2 and r["y0"] <= it["y0"] + 3), None)
            if bar is not None:
                under = [i for i in items[k:] if i["x0"] < bar["x1"]]
            if not under:
                under = items[k : k + 1]
                doubt.guess()
            k += len(under)
            piece = rf"\sqrt{{{_region(under, [r for r in rules if r is not bar], doubt)}}}"
        else:
            name = latex_of(c) if len(c) == 1 else c
            if name is None:
                name = c
                if not c.isascii():
                    doubt.guess()
            piece = name
            if c in LARGE and it["y1"] - it["y0"] > 1.1 * size:
                # limits begin within the operator's width, above or below it
                low, high = [], []
                while k < len(items) and items[k]["x0"] <= it["x1"]:
                    middle = (items[k]["y0"] + items[k]["y1"]) / 2
                    if it["y0"] <= middle <= it["y1"]:
                        break
                    (high if middle < it["y0"] else low).append(items[k])
                    k += 1
                piece += (_script("_", _region(low, rules, doubt)) if low else "") + (_script("^", _region(high, rules, doubt)) if high else "")
        sub, sup = [], []
        while k < len(items) and items[k]["size"] <= 0.92 * it["size"] and abs(items[k]["oy"] - it["oy"]) > 0.12 * it["size"]:
            (sup if items[k]["oy"] < it["oy"] else sub).append(items[k])
            k += 1
        piece += (_script("_", _region(sub, rules, doubt)) if sub else "") + (_script("^", _region(sup, rules, doubt)) if sup else "")
        gap = bool(out) and (it["x0"] - items[items.index(it) - 1]["x1"] > 0.28 * size if items.index(it) else False)
        command = out.rsplit("\\", 1)[-1].isalpha() and "\\" in out and piece[:1].isalpha()
        out += (" " if gap or command else "") + piece
    return out.strip()


def formula(items: list[Item], rules: list[Item]) -> tuple[str, float]:
    """LaTeX of glyphs (``text, x0, y0, x1, y1, oy, size``) and rules, and how sure it is."""
    doubt = _Doubt()
    tex = _region([i for i in items if not i["text"].isspace()], rules, doubt)
    return " ".join(tex.split()), doubt.value


def formulas(glyphs: DataFrame, rules: DataFrame) -> DataFrame:
    """``formula_id, latex, confidence`` of glyphs and rules that share ``formula_id``: one grouped map over both."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        tex, sure = formula(left.to_pylist(), right.to_pylist())
        return pa.table({"formula_id": pa.array([key[0].as_py()], pa.int64()), "latex": [tex], "confidence": pa.array([sure], pa.float64())})

    return glyphs.groupBy("formula_id").cogroup(rules.groupBy("formula_id")).applyInArrow(run, "formula_id long, latex string, confidence double")


def inline_spans(words: DataFrame, in_math_font: Column | None = None) -> DataFrame:
    """``doc_id, ord, span, first, last, text``: runs of words (``doc_id, ord, pos, text``) that are no prose and have a seed.

    A run of a single word of one character is prose.
    """
    role = word_role(F.col("text"), in_math_font if in_math_font is not None else F.lit(False))
    line = Window.partitionBy("doc_id", "ord").orderBy("pos")
    marked = words.withColumn("role", role).filter("role IS NOT NULL").withColumn("span", F.sum((F.col("role") == "prose").cast("int")).over(line)).filter("role <> 'prose'")
    runs = marked.groupBy("doc_id", "ord", "span").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.bool_or(F.col("role") == "seed").alias("seeded"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda w: w["text"]), " ").alias("text"))
    return runs.filter("seeded AND NOT (first = last AND length(text) = 1)").drop("seeded")
