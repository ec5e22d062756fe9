"""Bibliography entries: their parts as Columns, and the splitting of a run of entries."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DASH = r"[-‐‑‒–—]"
ARXIV = r"(?is)^.*?arxiv:([a-z0-9./-]+)"
BOUNDARY = r"(?s)^(.*?(?:[\p{L}\p{N}]{2}|\([0-9]{4}[A-Za-z]?\)))\.\s"
MEDIAN_ENTRY = 400


def _found(text: Column) -> Column:
    return F.when(text != "", text)


def label(text: Column) -> Column:
    """``12`` of a leading ``[12]``, ``12.`` or ``12)``."""
    return F.coalesce(_found(F.when(F.octet_length(F.regexp_extract(text, r"^\s*\[([^\]]+)\]", 1)) <= 12, F.regexp_extract(text, r"^\s*\[([^\]]+)\]", 1))), _found(F.regexp_extract(text, r"^\s*([0-9]{1,3})[.)]\s", 1)))


def unlabelled(text: Column) -> Column:
    bracketed = F.octet_length(F.regexp_extract(text, r"^\s*\[([^\]]+)\]", 1)).between(1, 12)
    return F.trim(F.when(bracketed, F.regexp_replace(text, r"^\s*\[[^\]]+\]", "")).otherwise(F.regexp_replace(text, r"^\s*[0-9]{1,3}[.)](?=\s)", "")))


def year(raw: Column) -> Column:
    """The last number of four digits that may be a year and isn't a page or part of an arXiv identifier."""
    bare = F.regexp_replace(raw, r"(?is)^(.*?arxiv:)[a-z0-9./-]+", "$1#")
    found = F.regexp_extract_all(bare, F.lit(rf"(?<![0-9])(?<![0-9]{DASH})([0-9]{{4}})(?![0-9])(?!{DASH}[0-9])"), 1)
    return F.try_element_at(F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: y.between(1800, 2100)), F.lit(-1))


def doi(raw: Column) -> Column:
    return _found(F.regexp_replace(F.regexp_extract(raw, r"(10\.[0-9]{2,}/\S*[^\s.,;])", 1), r"[.,;]+$", ""))


def arxiv(raw: Column) -> Column:
    return _found(F.regexp_replace(F.regexp_extract(raw, ARXIV, 1), r"\.+$", ""))


def authors(raw: Column) -> Column:
    """Names before the first stop that ends no initial; none unless there are two."""
    head = F.regexp_extract(raw, BOUNDARY, 1)
    names = F.transform(F.split(F.rtrim(F.regexp_replace(F.rtrim(head), r"\([^(]*\)$", "")), r"[,;]| and "), lambda x: F.trim(x))
    names = F.filter(names, lambda x: (F.octet_length(x) <= 60) & x.rlike(r"^\p{Lu}"))
    return F.when((F.octet_length(head) < 200) & (F.size(names) >= 2), names).otherwise(F.array().cast("array<string>"))


def reads_as_prose(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]+", "")) * 4 > F.length(text) * 3


def title(raw: Column) -> Column:
    """The first of three sentences after the authors that reads as prose."""
    rest = F.regexp_replace(raw, BOUNDARY, "")
    pieces = F.transform(F.slice(F.split(rest, r"\. "), 1, 3), lambda p: F.regexp_replace(F.trim(p), r"\.+$", ""))
    return F.when(raw.rlike(BOUNDARY), F.try_element_at(F.filter(pieces, lambda p: reads_as_prose(p) & F.octet_length(p).between(8, 299)), F.lit(1)))


def parse(text: Column) -> Column:
    """``label, raw, authors, title, year, doi, arxiv`` of an entry."""
    raw = unlabelled(text)
    return F.struct(label(text).alias("label"), raw.alias("raw"), authors(raw).alias("authors"), title(raw).alias("title"), year(raw).alias("year"), doi(raw).alias("doi"), arxiv(raw).alias("arxiv"))


def link_citations(text: Column, known: Column) -> Column:
    """``[1, 2]`` as links, if all parts are known labels."""
    head = F.regexp_extract(text, r"^([^\[]*)", 1)
    groups = F.regexp_extract_all(text, F.lit(r"(\[[^\]]*\][^\[]*|\[[^\]]*$)"), 1)

    def linked(g: Column) -> Column:
        inner, after = F.regexp_extract(g, r"^\[([^\]]*)\]", 1), F.regexp_extract(g, r"\]([^\[]*)$", 1)
        parts = F.transform(F.split(inner, ","), lambda x: F.trim(x))
        good = g.contains("]") & F.forall(parts, lambda p: (p != "") & F.array_contains(known, p))
        return F.when(good, F.concat(F.lit("["), F.array_join(F.transform(parts, lambda p: F.concat(F.lit("["), p, F.lit("](#ref-"), p, F.lit(")"))), ", "), F.lit("]"), after)).otherwise(g)

    return F.when(F.coalesce(F.size(known), F.lit(0)) > 0, F.concat(head, F.array_join(F.transform(groups, linked), ""))).otherwise(text)


_PARTICLES = frozenset("da de del den der di du la le ten van von".split())


def _counted(text: str, shape: re.Pattern[str]) -> list[int]:
    """Where labels 1, 2, 3 ... begin."""
    out: list[int] = []
    for m in shape.finditer(text):
        if int(m.group(1)) == len(out) + 1:
            out.append(m.start())
    return out


def _by_authors(text: str) -> list[int]:
    """Where a sentence has ended and a surname, a comma and an initial follow."""
    starts = [0]
    for m in re.finditer(r"\.\s+(?=\S)", text):
        at, dot = m.end(), m.start()
        initial = dot > 0 and text[dot - 1].isalpha() and text[dot - 1].isupper() and (dot < 2 or not text[dot - 2].isalnum())
        if initial:
            continue
        word = re.match(r"[^\W\d_]+", text[at:])
        name = at + len(word.group()) + 1 if word and word.group().lower() in _PARTICLES and text[at + len(word.group()) : at + len(word.group()) + 1] == " " else at
        opens = re.match(r"([^\W\d_](?:[^\W\d_]|['’`´¨\-~^])+), ([^\W\d_])\.", text[name:])
        if opens and opens.group(1)[0].isupper() and len(opens.group(1)) <= 30 and opens.group(2).isupper():
            starts.append(at)
    sizes = sorted(b - a for a, b in zip(starts, [*starts[1:], len(text)], strict=True))
    return starts if len(starts) >= 3 and sizes[len(sizes) // 2] <= MEDIAN_ENTRY else []


def entries_of(text: str | None) -> list[str]:
    """The entries of a run of them: by counting labels, else by author lists, else one."""
    text = text or ""
    bracketed, numbered = _counted(text, re.compile(r"(?<!\S)\[([0-9]{1,3})\]")), _counted(text, re.compile(r"(?<!\S)([0-9]{1,3})\.(?=\s)"))
    starts = bracketed if len(bracketed) >= len(numbered) else numbered
    if len(starts) < 2:
        starts = _by_authors(text)
    if len(starts) < 2:
        return [text.strip()] if text.strip() else []
    return [e for a, b in zip(starts, [*starts[1:], len(text)], strict=True) if (e := text[a:b].strip())]


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_entries(text: pd.Series) -> pd.Series:
    return text.map(entries_of)
