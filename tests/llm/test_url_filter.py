from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirework.llm.common import text_bytes
from quirework.llm.url_filter import RULES, Automaton, Rule, canonical, filter_urls


def as_regex(glob: str) -> re.Pattern[bytes]:
    return re.compile(b"".join(b".*" if c == 42 else b"." if c == 63 else re.escape(bytes([c])) for c in glob.encode()), re.S)


@pytest.mark.parametrize("seed", range(6))
def test_matches_like_one_regex_a_rule(seed):
    rng = random.Random(seed)
    globs = ["".join(rng.choice("ab*?é/") for _ in range(rng.randint(0, 40 if k % 7 == 0 else 7))) for k in range(40)] + ["*", "", "**", "a" * 200]
    urls = ["".join(rng.choice("abé/") for _ in range(rng.randint(0, 12))) for _ in range(200)] + ["", "a" * 200, "a" * 5000]
    got = Automaton(globs).matches(*text_bytes(pa.array(urls)))
    want = np.array([[bool(as_regex(g).fullmatch(u.encode())) for g in globs] for u in urls])
    assert (got == want).all()


def test_canonical_form(spark):
    cases = {
        "HTTPS://WWW.Example.COM/A/B/?utm_source=x&q=1#top": "https://example.com/A/B/?q=1", "http://a.com:80": "http://a.com/", "http://a.com": "http://a.com/", "http://a.com/x/index.html": "http://a.com/x",
        "https://a.com:443/x//": "https://a.com/x", " http://a.com/?ref=1 ": "http://a.com/", "not a url": "not a url", "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "url string").select("url", canonical(F.col("url")).alias("c"))
    assert {r.url: r.c for r in df.collect()} == cases


def test_allow_wins(spark):
    rules = (Rule("b", "*bad*"), Rule("a", "*good*", "allow"))
    df = spark.createDataFrame([("http://bad.com",), ("http://bad.com/good",), ("http://x.com",)], "url string")
    assert [(r.matched, r.blocked) for r in filter_urls(df, rules).collect()] == [(["b"], True), (["b", "a"], False), ([], False)]
    with pytest.raises(ValueError):
        filter_urls(df, (Rule("x", "*", "maybe"),))


def test_awkward_rows(spark):
    df = spark.createDataFrame([(1, None, "x", [1]), (2, "", "y", None), (3, "http://casino.example.com/" + "a" * 100_000, None, None), (3, "http://casino.example.com/" + "a" * 100_000, None, None), (None, "x", None, None)], "page_id long, url string, canonical string, key array<int>")
    got = filter_urls(df)
    rows = got.collect()
    assert got.columns == ["page_id", "url", "key", "canonical", "matched", "blocked"]
    assert (rows[0].canonical, rows[0].matched, rows[0].blocked) == (None, [], False)
    assert rows[1].canonical == "" and rows[2].blocked and rows[2] == rows[3]
    assert filter_urls(df.filter("false")).count() == 0
    assert len(RULES) == len({r.name for r in RULES})
