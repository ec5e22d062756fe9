"""URL filters: all glob rules at once, as a bit-parallel wildcard automaton over canonical URLs.

A rule is a glob over a whole canonical URL: ``*`` is any run of bytes, ``?`` one byte, all else itself.  Every
token of every rule, and every rule's start, is one bit of a mask of several 64-bit words.  A step shifts the
mask by a bit, carries across words, and keeps the bits whose token the next byte fits (Shift-And); bits
before a ``*`` stay set whatever comes.  All URLs of a batch step together, shorter ones drop out.

A URL is blocked if a ``block`` rule matches and no ``allow`` rule does.  Null URLs have a null canonical URL,
match nothing and are not blocked; an empty one is matched by ``*`` alone.  Very long URLs are read to their end;
the steps of a batch are those of its longest.  Rows are judged one by one: repeated rows and ties fare alike, empty
tables give empty ones.  Other columns stay, whatever their names; ``canonical``, ``matched`` and ``blocked`` are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework.llm.common import text_bytes


class Rule(NamedTuple):
    name: str
    glob: str
    action: str = "block"


RULES = (
    Rule("spam-farm", "http*://*spam-farm.*"),
    Rule("pills", "http*://*pills*"),
    Rule("casino", "http*://*casino*"),
    Rule("adult", "http*://*adult*/*"),
    Rule("paged", "*?page=*"),
    Rule("login", "*/login*"),
    Rule("search", "*/search?q=*"),
    Rule("binary", "*.exe"),
    Rule("archive", "*.zip"),
    Rule("short-path", "http*://*.example.???/??/?"),
    Rule("mobile-es", "http*://m.*.example.*/es/*"),
    Rule("help", "http*://help.*", "allow"),
    Rule("fr-example-org", "http*://*.example.org/fr/*", "allow"),
)
#: Rewrites that give the canonical form, in order; Java and RE2 understand them alike.
REWRITES = (
    (r"^[ \t\r\n]+|[ \t\r\n]+$", ""),
    (r"#.*$", ""),
    (r"[?&](utm_[a-z]+|ref|fbclid|gclid)=[^&]*", ""),
    (r"^([^?&]*)&", r"\1?"),
    (r"^(http://[^/?]*):80([/?]|$)", r"\1\2"),
    (r"^(https://[^/?]*):443([/?]|$)", r"\1\2"),
    (r"^(https?://)www\.", r"\1"),
    (r"^(https?://[^/?]*)$", r"\1/"),
    (r"/index\.html?$", "/"),
    (r"^(https?://[^/?]*/.*[^/])/+$", r"\1"),
)


def canonical(url: Column) -> Column:
    """Scheme and host in small letters, without fragment, tracking parameters, default port, leading www. and final slashes."""
    bare = F.regexp_replace(url, REWRITES[0][0], "")
    head = F.regexp_extract(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0)
    out = F.concat(F.lower(head), F.substring(bare, F.length(head) + 1, F.length(bare)))
    for find, put in REWRITES[1:]:
        out = F.regexp_replace(out, find, put.replace("\\", "$"))
    return out


class Automaton:
    """Masks of all rules: ``step[byte]`` are the bits whose token the byte fits, ``stay`` those before a star."""

    def __init__(self, globs: list[str]) -> None:
        step, stay, start, end, at = [], [], [], [], 0
        for glob in globs:
            start.append(at)
            for c in glob.encode():
                if c == ord("*"):
                    stay.append(at)
                else:
                    at += 1
                    step.append((at, None if c == ord("?") else c))
            end.append(at)
            at += 1
        self.words = at // 64 + 1
        self.step = np.zeros((256, self.words), np.uint64)
        for bit, c in step:
            self.step[slice(None) if c is None else c, bit // 64] |= np.uint64(1 << bit % 64)
        self.stay, self.start = self._mask(stay), self._mask(start)
        self.end = np.array(end, np.int64)

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1 << b % 64)
        return out

    def matches(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """URL × rule."""
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        begin, size = offsets[:-1][order], sizes[order]
        state = np.repeat(self.start[None], len(order), 0)
        for t in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, side="left"))
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = moved & self.step[buf[begin[:live] + t]] | now & self.stay
        out = np.empty((len(order), len(self.end)), bool)
        out[order] = (state[:, self.end // 64] >> (self.end % 64).astype(np.uint64) & np.uint64(1)).astype(bool)
        return out


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url_col: str = "url", at_once: int = 4096, most_bytes: int = 256 << 20) -> DataFrame:
    """The rows with ``canonical``, ``matched`` (names of the rules that match, in their order) and ``blocked``.

    The masks, 32 bytes for each byte of a rule, are broadcast; ``most_bytes`` bounds them.
    """
    if any(r.action not in ("block", "allow") for r in rules):
        raise ValueError("a rule blocks or allows")
    machine = Automaton([r.glob for r in rules])
    if machine.step.nbytes > most_bytes:
        raise ValueError(f"the masks of the rules take {machine.step.nbytes} bytes; filter by several sets of rules, or raise most_bytes")
    sent = pages.sparkSession.sparkContext.broadcast(machine)
    names, blocks = np.array([r.name for r in rules], object), np.array([r.action == "block" for r in rules], bool)
    kept = pages.select(*(F.col(f"`{c}`") for c in pages.columns if c not in ("canonical", "matched", "blocked")), canonical(F.col(f"`{url_col}`")).alias("canonical"))
    schema = T.StructType([*kept.schema.fields, T.StructField("matched", T.ArrayType(T.StringType())), T.StructField("blocked", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sent.value
        for whole in batches:
            for i in range(0, whole.num_rows, at_once):
                batch = whole.slice(i, at_once)
                urls = batch.column(batch.num_columns - 1)
                hits = machine.matches(*text_bytes(urls)) & urls.is_valid().to_numpy(zero_copy_only=False)[:, None]
                blocked = (hits & blocks).any(1) & ~(hits & ~blocks).any(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([list(names[h]) for h in hits], pa.list_(pa.string())), pa.array(blocked)], [*batch.schema.names, "matched", "blocked"])

    return kept.mapInArrow(run, schema)


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """``page_id, canonical, matched, blocked`` of ``pages`` in DuckDB, where each glob is a LIKE pattern."""
    rewritten = "lower(regexp_extract(b, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*')) || substr(b, length(regexp_extract(b, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*')) + 1)"
    for find, put in REWRITES[1:]:
        rewritten = f"regexp_replace({rewritten}, '{find}', '{put}', 'g')"
    like = [r.glob.replace("!", "!!").replace("%", "!%").replace("_", "!_").replace("*", "%").replace("?", "_") for r in rules]
    tests = ", ".join(f"CASE WHEN c LIKE '{p}' ESCAPE '!' THEN '{r.name}' END" for p, r in zip(like, rules, strict=True))
    some = {a: "false" + "".join(f" OR c LIKE '{p}' ESCAPE '!'" for p, r in zip(like, rules, strict=True) if r.action == a) for a in ("block", "allow")}
    return f"""
WITH b AS (SELECT page_id, regexp_replace(url, '{REWRITES[0][0]}', '', 'g') AS b FROM pages), c AS (SELECT page_id, {rewritten} AS c FROM b)
SELECT page_id, c AS canonical, array_to_string(list_filter([{tests}], lambda x: x IS NOT NULL), ',') AS matched, coalesce(({some["block"]}) AND NOT ({some["allow"]}), false) AS blocked FROM c"""
