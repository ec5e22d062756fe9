"""Display equations of a page: which lines are set as mathematics, what belongs to them, and their numbers.

Lines are dictionaries with ``box``, ``size``, ``glyphs`` and ``words`` (with ``start`` and ``end`` among the glyphs); a
glyph has ``text``, ``box``, ``size`` and ``seed``, which tells mathematical fonts and signs.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any, NamedTuple

from quirework.functions.maths import FILLER
from quirework.operators.formulas import formula

Box = tuple[float, float, float, float]
Line = dict[str, Any]

#: Least share of mathematical glyphs, and least number.
SHARE, SEEDS = 0.10, 2
#: Characters of a number; the gap before it in sizes, and at the margin, which begins so many sizes from the edge.
NUMBER, GAP, GAP_AT_MARGIN, AT_MARGIN = 5, 2.0, 0.6, 1.5
#: Of lines that a display takes in: the gap in sizes, how far they may stick out, their words, and the size of scripts.
NEAR, OUT, WORDS, SCRIPT = 0.6, 1.0, 6, 0.92
GROWN = frozenset("∑∏∐∫∬∮⋃⋂√()[]{}|⟨⟩⌈⌉⌊⌋")
_FILLER = re.compile(FILLER)


class Display(NamedTuple):
    latex: str
    confidence: float
    number: str | None
    lines: list[int]
    box: Box


class Evidence(NamedTuple):
    """What speaks for a line being an equation: seeds, their share, words, those of prose, number, where the body ends, whether it is centred."""

    seeds: int
    share: float
    words: int
    prose: int
    number: str | None
    end: int
    centred: bool


def hull(boxes: Sequence[Box]) -> Box:
    return min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)


def role(line: Line, word: dict[str, Any]) -> str:
    """``seed``, ``connector`` or ``prose``, by the glyphs of a word."""
    if any(g["seed"] for g in line["glyphs"][word["start"] : word["end"]]):
        return "seed"
    return "connector" if _FILLER.match(word["text"]) else "prose"


def trailing_number(line: Line, column: Box) -> tuple[str | None, int]:
    """The label in round brackets that ends a line at a distance from the rest, and how many glyphs that leaves.

    It is read from glyphs, since there may be no space in so wide a gap.
    """
    glyphs = line["glyphs"]
    seen = [(k, g["text"], g["box"]) for k, g in enumerate(glyphs) if len(g["text"]) == 1 and not g["text"].isspace()]
    if not seen or seen[-1][1] != ")":
        return None, len(glyphs)
    at = next((k for k in range(len(seen) - 2, -1, -1) if seen[k][1] == "("), 0)
    label = "".join(c for _, c, _ in seen[at + 1 : -1])
    if at < 1 or not re.fullmatch(rf"[0-9A-Za-z.]{{1,{NUMBER}}}", label):
        return None, len(glyphs)
    gap = (seen[at][2][0] - seen[at - 1][2][2]) / line["size"]
    margin = column[2] - line["box"][2] <= AT_MARGIN * line["size"]
    return (label, seen[at][0]) if gap > (GAP_AT_MARGIN if margin else GAP) else (None, len(glyphs))


def evidence(line: Line, column: Box) -> Evidence:
    seeds = sum(g["seed"] for g in line["glyphs"])
    number, end = trailing_number(line, column)
    left, right = line["box"][0] - column[0], column[2] - line["box"][2]
    prose = sum(role(line, w) == "prose" for w in line["words"])
    centred = left > 2 * line["size"] and abs(left - right) <= 2 * line["size"]
    return Evidence(seeds, seeds / max(1, len(line["glyphs"])), len(line["words"]), prose, number, end, centred)


def _fragment(line: Line, column: Box, box: Box, size: float) -> bool:
    """Whether a line is short, without prose or a number of its own, close, and within the width of the block."""
    if not line["glyphs"] or len(line["words"]) > WORDS or trailing_number(line, column)[0] is not None or any(role(line, w) == "prose" for w in line["words"]):
        return False
    own = line["box"]
    gap = box[1] - own[3] if own[1] + own[3] < box[1] + box[3] else own[1] - box[3]
    return gap <= NEAR * size and own[0] >= box[0] - OUT * size and own[2] <= box[2] + OUT * size


def _placeable(line: Line, claimed: list[dict[str, Any]], rules: list[Box], box: Box, size: float) -> bool:
    """Whether the line is something that a formula has a place for: scripts, grown signs, limits, or the other side of a bar."""
    own = line["box"]

    def spans(b: Box) -> bool:
        return b[0] <= own[0] + OUT * size and b[2] >= own[2] - OUT * size

    if line["size"] < SCRIPT * size:
        return True
    signs = [g["text"] for g in line["glyphs"] if not g["text"].isspace()]
    if signs and all(s in GROWN for s in signs):
        return True
    if any(g["text"] in GROWN and g["box"][3] - g["box"][1] > 1.1 * g["size"] and spans(g["box"]) for g in claimed):
        return True
    top, bottom = min(box[1], own[1]), max(box[3], own[3])
    return any(spans(r) and top < (r[1] + r[3]) / 2 < bottom for r in rules)


def stack(lines: list[Line], at: int, column: Box, end: int, rules: list[Box], taken: Sequence[bool] = ()) -> tuple[list[int], Box]:
    """The lines that an equation is set across, found upwards and then downwards, and their box."""
    size, claimed = lines[at]["size"], list(lines[at]["glyphs"][:end])
    box, used = hull([g["box"] for g in claimed]) if claimed else lines[at]["box"], [at]
    for reach in (range(at - 1, -1, -1), range(at + 1, len(lines))):
        for k in reach:
            if (k < len(taken) and taken[k]) or not _fragment(lines[k], column, box, size) or not _placeable(lines[k], claimed, rules, box, size):
                break
            box = hull([box, lines[k]["box"]])
            claimed += lines[k]["glyphs"]
            used.append(k)
    return sorted(used), box


def build(glyphs: list[dict[str, Any]], rules: list[Box]) -> tuple[str, float]:
    """LaTeX of glyphs with the rules in their reach, and its confidence."""
    items = [{"text": g["text"][0], "x0": g["box"][0], "y0": g["box"][1], "x1": g["box"][2], "y1": g["box"][3], "oy": g["oy"], "size": g["size"]} for g in glyphs if not g["text"].isspace()]
    if not items:
        return "", 1.0
    x0, y0, x1, y1 = hull([g["box"] for g in glyphs if not g["text"].isspace()])
    near = [{"x0": r[0], "y0": r[1], "x1": r[2], "y1": r[3]} for r in rules if min(r[2], x1) > max(r[0], x0) and min(r[3], y1) - max(r[1], y0) > -2]
    return formula(sorted(items, key=lambda i: i["x0"]), near)


def display(lines: list[Line], at: int, column: Box, rules: list[Box], taken: Sequence[bool] = ()) -> Display | None:
    """The equation that a line belongs to, if it is one: mathematical, hardly any prose, and centred or numbered."""
    line = lines[at]
    if not line["glyphs"]:
        return None
    e = evidence(line, column)
    if e.seeds < SEEDS or e.share < SHARE or e.prose * 4 > e.words or not (e.centred or e.number is not None):
        return None
    used, box = stack(lines, at, column, e.end, rules, taken)
    latex, sure = build([g for k in used for g in lines[k]["glyphs"][: e.end if k == at else None]], rules)
    return Display(latex, sure, e.number, used, box)


def spans(line: Line, rules: list[Box]) -> list[tuple[int, int, str]]:
    """Runs of words that are mathematics within prose: first word, end, and LaTeX; a single sign is none."""
    roles = [role(line, w) for w in line["words"]]
    out, k = [], 0
    while k < len(roles):
        end = k
        while end < len(roles) and roles[end] != "prose":
            end += 1
        words = line["words"][k:end]
        if "seed" in roles[k:end] and (end - k > 1 or len(words[0]["text"]) > 1):
            latex, _ = build(line["glyphs"][words[0]["start"] : words[-1]["end"]], rules)
            if latex.strip():
                out.append((k, end, latex))
        k = max(end, k + 1)
    return out


def fold_inline(line: Line, rules: list[Box]) -> None:
    """Puts one ``$...$`` word in the place of each run of mathematics."""
    for first, end, latex in reversed(spans(line, rules)):
        words = line["words"][first:end]
        line["words"][first:end] = [words[0] | {"text": f"${latex}$", "end": words[-1]["end"]}]


def column_of(box: Box, extent: Box, gutters: Sequence[tuple[float, float]]) -> Box:
    """The column that a line's middle is in; the whole extent for one that crosses a gutter."""
    if not gutters or any(box[0] < a and box[2] > b for a, b in gutters):
        return extent
    middle = (box[0] + box[2]) / 2
    left = max([extent[0], *(b for _, b in gutters if b <= middle)])
    right = min([extent[2], *(a for a, b in gutters if b > middle and a >= middle)])
    return (left, extent[1], right, extent[3]) if right > left else extent


def lift(lines: list[Line], gutters_at: Any, rules: list[Box]) -> tuple[list[Display], list[bool]]:
    """The equations of a page's lines, and which lines they take; runs of mathematics in the other lines are folded."""
    taken, out = [False] * len(lines), []
    extent = hull([x["box"] for x in lines]) if lines else (0.0, 0.0, 0.0, 0.0)
    for k, line in enumerate(lines):
        if taken[k]:
            continue
        column = column_of(line["box"], extent, gutters_at((line["box"][1] + line["box"][3]) / 2))
        found = display(lines, k, column, rules, taken)
        if found and found.latex.strip():
            for i in found.lines:
                taken[i] = True
            out.append(found)
    for k, line in enumerate(lines):
        if not taken[k]:
            fold_inline(line, rules)
    return out, taken
