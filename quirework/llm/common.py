"""Helpers shared by the corpus operators: word hashing over UTF-8 bytes, packed shuffles, shared storage.

A *word* is a maximal run of ASCII letters and digits and of non-ASCII characters; everything else in
ASCII separates words.  Case is folded with Spark's ``lower`` before texts reach Python, so DuckDB's
``regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10FFFF}]+')`` yields the same words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.storage import discard, shared_dir, written  # noqa: F401 (for the operators)

#: The words of a text in DuckDB, for the oracles.
SQL_WORDS = r"regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+')"
BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 16


def parts(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, made longer where the table has columns of that name."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def documents(docs: DataFrame, *cols: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifier, lower-cased text and the named columns; rows without identifier or text go."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col)).alias("text"), *cols).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())


def n_words(text: Column) -> Column:
    """Whitespace-separated words of a text, 0 for null and blank ones."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"\s+")))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _classes() -> np.ndarray:
    """Byte -> folded byte, with 32 for all that separates words."""
    table = np.full(256, 32, np.uint8)
    for c in b"abcdefghijklmnopqrstuvwxyz0123456789":
        table[c] = c
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[c] = c + 32
    table[128:] = np.arange(128, 256)
    return table


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    inverse = pow(BASE, -1, 1 << 64)
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (BASE, inverse))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and the offsets of each."""
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, start and end of each word, and the word offsets of each text."""
    folded = _classes()[buf]
    inside = folded != 32
    n = len(folded)
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins, stops = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        begins[edges] |= inside[edges]
        stops[edges - 1] |= inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return folded, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, and the word offsets of each text."""
    folded, starts, ends, offsets = word_bounds(*text_bytes(texts))
    return span_hashes(folded, starts, ends), offsets


def span_hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        b0 = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, b0 + _BLOCK, side="right")))
        b1 = ends[j - 1]
        power, inverse = _powers(max(16, int(b1 - b0).bit_length()))
        sums = np.empty(b1 - b0 + 1, np.uint64)
        sums[0] = 0
        np.cumsum((folded[b0:b1].astype(np.uint64) + np.uint64(1)) * power[: b1 - b0], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - b0] - sums[starts[i:j] - b0]) * inverse[starts[i:j] - b0]
        i = j
    return mix64(out)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words, by doubling; entry i covers words i to i+k-1."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, done, block, width = None, 0, h, 1
    while True:
        if k & width:
            out = block if out is None else out[: len(h) - done - width + 1] * np.uint64(pow(BASE, width, 1 << 64)) + block[done : done + len(h) - done - width + 1]
            done += width
        if done == k:
            return mix64(out[: len(h) - k + 1])
        block = block[:-width] * np.uint64(pow(BASE, width, 1 << 64)) + block[width:]
        width *= 2


#: A key of 128 bits.
KEY = np.dtype([("a", "<u8"), ("b", "<u8")])


def text_keys(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A key of 128 bits of each text's word sequence, as ``KEY``."""
    n = np.diff(offsets)
    place = (np.arange(len(h)) - np.repeat(offsets[:-1], n)).astype(np.uint64)
    out = np.empty(len(n), KEY)
    for name, odd in (("a", BASE), ("b", 0xD6E8FEB86659FD93)):
        sums = np.cumsum(np.r_[np.uint64(0), mix64(h * np.uint64(odd) + place * np.uint64(BASE ^ odd >> 1))])
        out[name] = mix64(sums[offsets[1:]] - sums[offsets[:-1]] + n.astype(np.uint64))
    return out


def key_bytes(keys: np.ndarray) -> pa.Array:
    """Keys as a column of 16 bytes each."""
    return pa.Array.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys).tobytes())]).cast(pa.binary())


def part_of(h: np.ndarray, n: int) -> np.ndarray:
    """The partition, of n, of each 64-bit hash: by its leading bits."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def by_part(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the rows by partition, the partitions there are, and their bounds in that order."""
    order = np.argsort(part, kind="stable")
    found, begin = np.unique(part[order], return_index=True)
    return order, found, np.r_[begin, len(part)]


def _planes(x: np.ndarray) -> bytes:
    """The bytes of an array, first ones first: small numbers leave runs of zeros, which shuffles compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def _values(data: bytes, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


class Packed:
    """Rows of ``part`` and a binary per array, so that a shuffle moves dense arrays instead of one row per value."""

    def __init__(self, **types: type) -> None:
        self.types = {k: np.dtype(t) for k, t in types.items()}
        self.schema = "part int, " + ", ".join(f"{k} binary" for k in types)

    def batch(self, rows: list[tuple[int, dict[str, np.ndarray]]]) -> pa.RecordBatch:
        arrays = [pa.array([p for p, _ in rows], pa.int32())]
        for k, t in self.types.items():
            arrays.append(pa.array([_planes(np.asarray(x[k], t)) for _, x in rows], pa.binary()))
        return pa.RecordBatch.from_arrays(arrays, ["part", *self.types])

    def split(self, part: np.ndarray, **arrays: np.ndarray) -> list[tuple[int, dict[str, np.ndarray]]]:
        order, found, bounds = by_part(part)
        moved = {k: a[order] for k, a in arrays.items()}
        return [(int(p), {k: a[bounds[i] : bounds[i + 1]] for k, a in moved.items()}) for i, p in enumerate(found)]

    def rows(self, table: pa.Table | pa.RecordBatch) -> list[dict[str, np.ndarray]]:
        columns = {k: table.column(k).to_pylist() for k in self.types}
        return [{k: _values(columns[k][i], t) for k, t in self.types.items()} for i in range(table.num_rows)]

    def joined(self, table: pa.Table) -> dict[str, np.ndarray]:
        rows = self.rows(table)
        return {k: np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, t) for k, t in self.types.items()}


#: log2 of the bits that a sieve has: it grows with the identifiers up to 32 MB.
SIEVE_BITS = (20, 28)
_PIECES = 16


class Sieve(NamedTuple):
    """A bit for each hash of a set of identifiers: it may let others through, and never keeps one of the set back."""

    bits: int
    packed: Broadcast

    def has(self, ids: pa.Array) -> np.ndarray:
        at = _place(ids, self.bits)
        found = (self.packed.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return found & ids.is_valid().to_numpy(zero_copy_only=False)


def _place(ids: pa.Array, bits: int) -> np.ndarray:
    return (mix64(ids.cast(pa.int64()).fill_null(0).to_numpy().view(np.uint64) * np.uint64(BASE)) >> np.uint64(64 - bits)).astype(np.int64)


def sieve(ids: DataFrame) -> Sieve:
    """The sieve of the only column of ``ids``; at most 32 MB are sent, and beyond 2**25 identifiers it lets more through."""
    n = ids.count()
    bits = min(SIEVE_BITS[1], max(SIEVE_BITS[0], (8 * n).bit_length()))
    width = (1 << bits) // 8 // _PIECES

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << bits, bool)
        for batch in batches:
            flags[_place(batch.column(0), bits)] = True
        packed = np.packbits(flags)
        yield pa.RecordBatch.from_arrays([pa.array(range(_PIECES), pa.int32()), pa.array([zlib.compress(packed[k * width : (k + 1) * width].tobytes(), 1) for k in range(_PIECES)], pa.binary())], ["piece", "bits"])

    def both(table: pa.Table) -> pa.Table:
        out = np.zeros(width, np.uint8)
        for x in table.column("bits").to_pylist():
            out |= np.frombuffer(zlib.decompress(x), np.uint8)
        return pa.table({"piece": table.column("piece")[:1], "bits": pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())})

    found = {r.piece: np.frombuffer(zlib.decompress(r.bits), np.uint8) for r in ids.mapInArrow(mark, "piece int, bits binary").groupBy("piece").applyInArrow(both, "piece int, bits binary").collect()}
    whole = np.concatenate([found.get(k, np.zeros(width, np.uint8)) for k in range(_PIECES)])
    return Sieve(bits, ids.sparkSession.sparkContext.broadcast(whole))


def sifted(docs: DataFrame, through: Sieve, inside: bool = True) -> DataFrame:
    """The rows, with all columns, whose ``doc_id`` may be in the sieve; or those whose ``doc_id`` surely isn't, nulls among them."""
    at = docs.columns.index("doc_id")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(through.has(batch.column(at)) == inside))

    return docs.mapInArrow(keep, docs.schema)


def slices(texts: pa.Array, most: int = 2 << 20) -> list[tuple[int, int]]:
    """Row ranges of at most so many bytes of text, one row at least: bounds the memory of array kernels."""
    sizes = np.cumsum(np.diff(text_bytes(texts)[1]))
    out, i = [], 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + most, side="right")))
        out.append((i, j))
        i = j
    return out
