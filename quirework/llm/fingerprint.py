"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph is a line without its outer spaces, if not blank.  Each is hashed to ``lanes`` numbers of 32 bits,
cut from SHA-256 of a counter and the paragraph; a document's fingerprint has their sums modulo 2**32, in
hexadecimal.  So it doesn't depend on the order of paragraphs, counts how often each occurs, and is kept up to
date by adding or subtracting the numbers of a paragraph that comes or goes.  All of it is one projection.

Null, empty and blank texts have no paragraphs and the fingerprint of zeros.  Very long texts are hashed whole, as
a fold over their paragraphs.  Rows are hashed one by one, so that no row depends on another: repeated rows and ties
have equal fingerprints, empty tables give empty ones.  Other columns stay, whatever their names; those named
``n_paragraphs`` and ``fingerprint`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import unused

LANES = 32
_PER_DIGEST = 8
_MASK = (1 << 32) - 1


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text, in order."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.regexp_replace(p, r"^[ \t\r]+|[ \t\r]+$", "")), lambda p: p != "")


def _check(lanes: int) -> None:
    if lanes < _PER_DIGEST or lanes % _PER_DIGEST:
        raise ValueError(f"lanes must be a multiple of {_PER_DIGEST}")


def _numbers(paragraph: Column, lanes: int) -> Column:
    """The numbers of a paragraph, as an array of longs."""
    digests = F.array(*(F.sha2(F.concat(F.lit(f"{k}:"), paragraph), 256) for k in range(lanes // _PER_DIGEST)))
    return F.flatten(F.transform(digests, lambda d: F.array(*(F.conv(F.substring(d, 8 * i + 1, 8), 16, 10).cast("long") for i in range(_PER_DIGEST)))))


def _hex(sums: Column) -> Column:
    return F.concat_ws("", F.transform(sums, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(_MASK)))), 8, "0")))


def _sums(fingerprint: Column, lanes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(lanes - 1)), lambda i: F.conv(F.substring(fingerprint, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))


def multiset_hash(items: Column, lanes: int = LANES) -> Column:
    """The hash of an array of strings, as a multiset."""
    _check(lanes)
    # sums of numbers below 2**32 stay exact, or wrap at 2**64, which 2**32 divides
    zero = F.array_repeat(F.lit(0).cast("long"), lanes)
    return _hex(F.aggregate(items, zero, lambda acc, p: F.zip_with(acc, _numbers(p, lanes), lambda a, b: (a + b).bitwiseAND(F.lit(_MASK)))))


def inserted(fingerprint: Column, paragraph: Column, lanes: int = LANES) -> Column:
    """The fingerprint once the paragraph is there once more."""
    _check(lanes)
    return _hex(F.zip_with(_sums(fingerprint, lanes), _numbers(paragraph, lanes), lambda a, b: a + b))


def deleted(fingerprint: Column, paragraph: Column, lanes: int = LANES) -> Column:
    """The fingerprint once the paragraph is there once less."""
    _check(lanes)
    return _hex(F.zip_with(_sums(fingerprint, lanes), _numbers(paragraph, lanes), lambda a, b: a - b))


def combined(a: Column, b: Column, lanes: int = LANES) -> Column:
    """The fingerprint of two documents together."""
    _check(lanes)
    return _hex(F.zip_with(_sums(a, lanes), _sums(b, lanes), lambda x, y: x + y))


def fingerprints(docs: DataFrame, lanes: int = LANES, text_col: str = "text") -> DataFrame:
    """The documents with ``n_paragraphs`` and ``fingerprint``."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_paragraphs", "fingerprint")]
    both = F.transform(F.array(paragraphs(F.col(f"`{text_col}`"))), lambda ps: F.struct(F.size(ps).alias("n"), multiset_hash(ps, lanes).alias("h")))[0]
    (name,) = unused(docs, "both")
    return docs.select(*kept, both.alias(name)).select(*kept, F.col(f"{name}.n").alias("n_paragraphs"), F.col(f"{name}.h").alias("fingerprint"))


def oracle(lanes: int = LANES) -> str:
    """``doc_id, n_paragraphs, fingerprint`` of ``documents`` in DuckDB; it takes identifiers to be unique."""
    return f"""
WITH p AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g')), lambda x: x <> '')) AS par FROM documents),
  k AS (SELECT doc_id, par, unnest(range({lanes // _PER_DIGEST})) AS k FROM p),
  d AS (SELECT doc_id, k, sha256(k || ':' || par) AS d FROM k),
  i AS (SELECT doc_id, k * {_PER_DIGEST} + i AS lane, sum(('0x' || substr(d, i * 8 + 1, 8))::BIGINT) % 4294967296 AS s FROM d, range({_PER_DIGEST}) t(i) GROUP BY ALL),
  f AS (SELECT doc_id, string_agg(printf('%08x', s::BIGINT), '' ORDER BY lane) AS h FROM i GROUP BY doc_id),
  n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::INT AS n_paragraphs, coalesce(h, repeat('0', {lanes * 8})) AS fingerprint FROM documents LEFT JOIN f USING (doc_id) LEFT JOIN n USING (doc_id)"""
