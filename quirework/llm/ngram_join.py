"""N-gram Jaccard self-join by a blocked sparse matrix product.

Documents are the rows and word n-grams the columns of a 0/1 incidence matrix A; the join is A·Aᵀ without
the entries that cannot reach the threshold.

1. Each document's word sequence becomes a key of 128 bits; documents with one key are one row of A, which the
   least of their identifiers represents.  The first half names the row, or the second where two rows share the first.
2. A count sketch of all n-grams (fixed size, summed over all documents) orders columns from rare to common.
   The order decides only the work, never the result.
3. Of a document with m n-grams, only the first ``m - ceil(t·m) + 1`` in that order enter the product: two
   documents of similarity t share one of these.  Column blocks are hash ranges of the n-grams; within a
   block, every posting list yields its pairs, those whose sizes differ by more than t go, and the overlaps
   of the rest are counted.
4. The counts of all column blocks are added.  What two documents share beyond these lies behind the prefix of
   the one whose prefix ends first, so that pairs whose count and that rest are below t/(1+t)·(m₁+m₂) go.
   N-grams travel as the 32 bits after those that name their block; how many of a document's own collide is
   counted and allowed for.
5. Surviving entries are gathered into row blocks (by the partner with which a row shares most, so that a
   group of near copies is one block; large groups are cut into several), and the whole rows of A, sent
   once to each block that needs them, give exact overlaps.  An overlap below t/(1+t)·(m₁+m₂) is dropped.
   Before all this, each row is compared with the least row that has one of its bands, i.e. pairs of least n-grams in
   several orders.  Rows that such links join are of one group, and give no entries between each other, so that a
   group of copies gives about as many entries as it has rows, and no link between groups is lost.  Where links are
   counted, those within a group come from dense products of its incidence matrix, tile by tile.
6. A row block gives links counted by document and a spanning forest of its links, not the links themselves, so
   that what leaves it is linear in its documents.  Components of the forests are the classes.

A document of fewer than n words has its whole word sequence as its only n-gram; one without words pairs
with none.  Rows without identifier or text are left out, repeated rows of one identifier are one document;
an identifier that comes with several texts has the links of all and the least of their classes.  Ties, i.e.
copies of one text, are represented by the least identifier.  Very long texts are taken whole.  Of other columns
none is read, so that they may have any name.  Empty tables give empty results.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import BASE, KEY, Packed, discard, documents, key_bytes, mix64, part_of, parts, rolling, sieve, sifted, slices, text_keys, word_hashes, written

POSTINGS = Packed(keys=np.uint64, sizes=np.uint32, last=np.uint32, slack=np.uint32, which=np.uint32, gram=np.uint32)
#: So many rows that are joined already are broadcast with their labels (12 bytes each), those of the largest groups first.
MOST_LABELS = 1 << 21
#: Bands of each row, and the n-grams of a band.
BANDS, BAND = 8, 2
#: Entries of a column block that are kept before they are passed on.
ENTRIES_AT_ONCE = 1 << 21
#: A group is cut into pieces of about so many bytes of hashed n-grams and so many rows; a tile holds two of them.
PIECE_BYTES, PIECE_ROWS = 8 << 20, 2048
#: A column of a tile with at least this share of its cells is multiplied as a dense one.
DENSE_SHARE = 1 / 64
ENTRIES = Packed(keys=np.uint64, sizes=np.uint32, last=np.uint32, slack=np.uint32, row=np.uint32, col=np.uint32, votes=np.uint32)
_CHUNK = 22  # log2 of the counters that the sketch has
#: Shuffle partitions for one column block: in a larger block more of what two documents share is one entry.
COLUMN_BLOCK = 2
#: A key with at least this share of all documents is joined by broadcast: there can't be more of them than its inverse.
HOT_SHARE = 1 / 1024
#: The bits of an n-gram that travel, after those that name its column block.
SHORT = 32
#: N-grams that are packed at once.
AT_ONCE = 1 << 20
#: So many rows may share the first half of their keys; of 10**11 rows, about 300 do.
MOST_CLASHES = 100_000
_PIECES = 16


def _grams(h: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    rolled, out = rolling(h, n), []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            out.append(rolling(h[a:b], int(b - a)) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sketch(docs: DataFrame, n: int) -> np.ndarray:
    """log-scale counts of all n-grams by the last bits of their hashes: 4 MB whatever the input."""
    width = (1 << _CHUNK) // _PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << _CHUNK, np.uint32)
        for batch in batches:
            texts = batch.column("text")
            for i, j in slices(texts):
                h, offsets = word_hashes(texts.slice(i, j - i))
                rolled = rolling(h, n)
                total += np.bincount((rolled & np.uint64((1 << _CHUNK) - 1)).astype(np.int64), minlength=1 << _CHUNK).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(range(_PIECES), pa.int32()), pa.array([zlib.compress(np.minimum(total[k * width : (k + 1) * width], 65535).astype("<u2").tobytes(), 1) for k in range(_PIECES)], pa.binary())], ["piece", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.uint64)
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(x), "<u2")
        logs = np.minimum(4 * np.log2(total + 1.0), 255).astype(np.uint8)
        return pa.table({"piece": table.column("piece")[:1], "counts": pa.array([logs.tobytes()], pa.binary())})

    counted = docs.select("text").mapInArrow(count, "piece int, counts binary")
    found = {r.piece: np.frombuffer(r.counts, np.uint8) for r in counted.groupBy("piece").applyInArrow(add, "piece int, counts binary").collect()}
    return np.concatenate([found.get(k, np.zeros(width, np.uint8)) for k in range(_PIECES)])


def text_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, key`` of every document that has a word; equal word sequences have equal keys."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            for i, j in slices(texts):
                h, offsets = word_hashes(texts.slice(i, j - i))
                some = pa.array(np.diff(offsets) > 0)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).filter(some), key_bytes(text_keys(h, offsets)).filter(some)], ["doc_id", "key"])

    return docs.select("doc_id", "text").mapInArrow(keys, "doc_id long, key binary")


def _with_classes(rows: DataFrame, classes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with columns of ``classes``, which has a row for each key, and in ``n`` how many rows have it.

    A key may have any share of the rows, so that those with ``HOT_SHARE`` of them or more, at most 1024 keys, are
    broadcast, and only the rest is shuffled by key.
    """
    hot = F.col("n") >= max(2, math.ceil((classes.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE))
    few = F.broadcast(classes.filter(hot).select(key, *columns))
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(classes.filter(~hot).select(key, *columns), key))


def _row_names(keys: np.ndarray, clashes: np.ndarray) -> np.ndarray:
    """The name of the row of each key: its first half, unless that is among the sorted ``clashes``."""
    return np.where(np.isin(keys["a"], clashes), keys["b"], keys["a"]) if len(clashes) else keys["a"].copy()


def _clashes(classes: DataFrame) -> np.ndarray:
    """The first halves that several keys share, sorted."""
    half = classes.groupBy(F.substring("key", 1, 8).alias("half")).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    found = half.select("half").limit(MOST_CLASHES + 1).collect()
    if len(found) > MOST_CLASHES:
        raise ValueError("too many rows share half of their keys")
    return np.sort(np.array([np.frombuffer(r.half, "<u8")[0] for r in found], np.uint64))


def _postings(docs: DataFrame, n: int, threshold: float, bits: int, clashes: np.ndarray) -> DataFrame:
    """bits: log2 of the number of column blocks."""
    sketch, short, part = docs.sparkSession.sparkContext.broadcast(_sketch(docs, n)), np.uint64(64 - bits - SHORT), np.uint64(64 - bits)
    mask = np.uint64((1 << SHORT) - 1)

    def packed(found: list[tuple[np.ndarray, int, int, int, int]]) -> pa.RecordBatch:
        g = np.concatenate([x[0] for x in found])
        w = np.repeat(np.arange(len(found), dtype=np.uint32), [len(x[0]) for x in found])
        keys, sizes, last, slack = (np.array([x[k] for x in found], t) for k, t in ((1, np.uint64), (2, np.uint32), (3, np.uint32), (4, np.uint32)))
        rows = []
        for p, x in POSTINGS.split((g >> part if bits else g * np.uint64(0)).astype(np.int32), which=w, gram=(g >> short & mask).astype(np.uint32)):
            there, x["which"] = np.unique(x["which"], return_inverse=True)
            rows.append((p, x | {"keys": keys[there], "sizes": sizes[there], "last": last[there], "slack": slack[there]}))
        return POSTINGS.batch(rows)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, found, total = sketch.value, [], 0
        for batch in batches:
            texts = batch.column("text")
            for i, j in slices(texts):
                h, offsets = word_hashes(texts.slice(i, j - i))
                own = _row_names(text_keys(h, offsets), clashes)
                for k, g in enumerate(_grams(h, offsets, n)):
                    if len(g):
                        count = counts[(g & np.uint64((1 << _CHUNK) - 1)).astype(np.int64)]
                        rank = np.argsort(count, kind="stable")
                        end = rank[_prefix(len(g), threshold) - 1]
                        # sorted, so that those that share block and bits are neighbours
                        cut = g >> short
                        some = g[rank[: _prefix(len(g), threshold)]]
                        found.append((some, own[k], len(g), int(count[end]) << 24 | int(g[end]) >> 40, np.count_nonzero(cut[1:] == cut[:-1])))
                        total += len(some)
                if total >= AT_ONCE:
                    yield packed(found)
                    found, total = [], 0
        if found:
            yield packed(found)

    return docs.select("text").mapInArrow(emit, POSTINGS.schema)


def _prefix(m: int, threshold: float) -> int:
    """The n-grams of a document of m that enter the product."""
    return m - math.ceil(threshold * m - 1e-9) + 1


def _added(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and the sums of their counts."""
    if not pairs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pair, at = np.unique(np.concatenate([p for p, _ in pairs]), return_inverse=True)
    return pair, np.bincount(at, np.concatenate([v for _, v in pairs]), len(pair)).astype(np.int64)


def _possible(votes: np.ndarray, m: np.ndarray, last: np.ndarray, slack: np.ndarray, row: np.ndarray, col: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs may reach the threshold, given how much their prefixes share.

    ``last`` is where in the order of n-grams a prefix ends, as far as 32 bits tell; ``slack`` is by how much the
    n-grams of a prefix that share 32 bits of hash may lower a count.
    """
    rest = np.ceil(threshold * m - 1e-9) - 1
    behind = np.where(last[row] < last[col], rest[row], np.where(last[row] > last[col], rest[col], np.maximum(rest[row], rest[col])))
    return (votes + np.minimum(slack[row], slack[col]) + behind) * (1 + threshold) >= threshold * (m[row] + m[col]) - 1e-9


class _Labels(NamedTuple):
    """Rows that are joined already, ascending, and their groups."""

    rows: Broadcast
    groups: Broadcast

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The group of each key, or -1."""
        rows, groups = self.rows.value, self.groups.value
        if not len(rows):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(rows, keys), len(rows) - 1)
        return np.where(rows[at] == keys, groups[at].astype(np.int64), -1)


def _block_entries(postings: DataFrame, threshold: float, blocks: int, labels: _Labels | None = None) -> DataFrame:
    """The entries of the product that a column block gives, by row.

    labels: rows with one label are joined already, and give no entries.
    """

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in POSTINGS.rows(batch)]
        own = np.concatenate([r["keys"] for r in rows] or [np.zeros(0, np.uint64)])
        keys, first = np.unique(own, return_index=True)
        group = labels.of(keys) if labels is not None else np.full(len(keys), -1, np.int64)
        # by group, those without one last, so that in a posting list the rows of a group are neighbours
        order = np.lexsort((keys, np.where(group < 0, np.iinfo(np.int64).max, group)))
        group, place = group[order], np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        local = place[np.searchsorted(keys, own)]
        keys = keys[order]
        sizes, last, slack = (np.concatenate([r[k] for r in rows] or [np.zeros(0, np.uint32)])[first][order] for k in ("sizes", "last", "slack"))
        sizes = sizes.astype(np.float64)
        run = np.cumsum(np.r_[True, (group[1:] != group[:-1]) | (group[1:] < 0)][: len(group)])
        begin = np.cumsum([0, *(len(r["keys"]) for r in rows)])
        doc = np.concatenate([local[b + r["which"].astype(np.int64)] for b, r in zip(begin, rows, strict=False)] or [np.zeros(0, np.int64)])
        cell = np.unique(np.concatenate([r["gram"] for r in rows] or [np.zeros(0, np.uint32)]).astype(np.uint64) << np.uint64(32) | doc.astype(np.uint64))
        del rows, own, local
        gram, doc = cell >> np.uint64(32), (cell & np.uint64(0xFFFFFFFF)).astype(np.int64)
        fresh = np.r_[True, gram[1:] != gram[:-1]][: len(gram)]
        start = np.flatnonzero(fresh)
        runs = np.flatnonzero(fresh | np.r_[True, run[doc[1:]] != run[doc[:-1]]][: len(gram)])
        ends_at = np.repeat(runs, np.diff(np.r_[runs, len(gram)]))  # before it are the rows of the list that are of other groups
        before = ends_at - np.repeat(start, np.diff(np.r_[start, len(gram)]))
        some = np.flatnonzero(before)
        # row by row, so that what a chunk of whole rows gives is final
        some = some[np.argsort(doc[some], kind="stable")]
        ends = np.r_[np.flatnonzero(np.diff(doc[some])) + 1, len(some)] if len(some) else np.zeros(0, np.int64)

        def passed_on(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            row, col, votes = (np.concatenate(c) for c in zip(*found, strict=True))
            out = []
            for p, x in ENTRIES.split(part_of(keys[row], blocks), row=row, col=col, votes=votes):
                there, at = np.unique(np.concatenate([x["row"], x["col"]]), return_inverse=True)
                out.append((p, {"keys": keys[there], "sizes": sizes[there], "last": last[there], "slack": slack[there], "votes": x["votes"], "row": at[: len(x["row"])], "col": at[len(x["row"]) :]}))
            return ENTRIES.batch(out)

        total, found, count, i = np.r_[0, np.cumsum(before[some])], [], 0, 0
        while i < len(some):
            # as many whole rows as make half a million pairs, one at least
            k = max(np.searchsorted(total[ends], total[i] + (1 << 19), side="right") - 1, np.searchsorted(ends, i, side="right"))
            j = int(ends[k])
            at = some[i:j]
            right = np.repeat(at, before[at])
            left = np.repeat(ends_at[at], before[at]) - 1 - (np.arange(len(right)) - np.repeat(np.cumsum(before[at]) - before[at], before[at]))
            a, b = doc[left], doc[right]
            near = np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]) - 1e-9
            pair, votes = np.unique(b[near].astype(np.uint64) << np.uint64(32) | a[near].astype(np.uint64), return_counts=True)
            found.append(((pair >> np.uint64(32)).astype(np.uint32), pair.astype(np.uint32), votes.astype(np.uint32)))
            i, count = j, count + len(pair)
            if count >= ENTRIES_AT_ONCE:
                yield passed_on(found)
                found, count = [], 0
        if count:
            yield passed_on(found)

    return postings.groupBy("part").applyInArrow(multiply, ENTRIES.schema)


def _row_blocks(entries: DataFrame, threshold: float, rows_each: int) -> DataFrame:
    """``row, block, cols``: what each row block needs, and for the rows that it computes their columns."""

    def assign(table: pa.Table) -> pa.Table:
        rows = ENTRIES.rows(table)
        keys, first, local = np.unique(np.concatenate([r["keys"] for r in rows]), return_index=True, return_inverse=True)
        sizes = np.concatenate([r["sizes"] for r in rows])[first].astype(np.float64)
        last, slack = (np.concatenate([r[k] for r in rows])[first].astype(np.int64) for k in ("last", "slack"))
        begin = np.cumsum([0, *(len(r["keys"]) for r in rows)])
        row, col = (np.concatenate([local[b + r[k].astype(np.int64)] for b, r in zip(begin, rows, strict=False)]) for k in ("row", "col"))
        cell, votes = _added([(row.astype(np.uint64) << np.uint64(32) | col.astype(np.uint64), np.concatenate([r["votes"] for r in rows]))])
        row, col = (cell >> np.uint64(32)).astype(np.int64), (cell & np.uint64(0xFFFFFFFF)).astype(np.int64)
        some = _possible(votes, sizes, last, slack, row, col, threshold)
        row, col, votes = row[some], col[some], votes[some]
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
        out_key, out_block, out_cols, needs = [], [], [], {}
        for a, b in zip(start, np.r_[start[1:], len(row)][: len(start)], strict=True):
            cols, v = col[a:b], votes[a:b]
            label = keys[cols[v * 2 >= v.max()].min(keepdims=True)]
            cuts = np.array([1 << max(0, math.ceil(math.log2((b - a) / rows_each)))], np.uint64)
            block = int(mix64(label + cuts * np.uint64(BASE) + mix64(keys[row[a : a + 1]]) % cuts).view(np.int64)[0])
            out_key.append(row[a])
            out_block.append(block)
            out_cols.append(keys[cols].tobytes())
            needs.setdefault(block, []).append(cols)
        for block, several in needs.items():
            found = np.unique(np.concatenate(several))
            out_key += found.tolist()
            out_block += [block] * len(found)
            out_cols += [None] * len(found)
        return pa.table({"row": pa.array(keys[np.array(out_key, np.int64)].view(np.int64)), "block": pa.array(out_block, pa.int64()), "cols": pa.array(out_cols, pa.binary())})

    assigned = entries.groupBy("part").applyInArrow(assign, "row long, block long, cols binary")
    return assigned.groupBy("row", "block").agg(F.max("cols").alias("cols"))


class _Forest:
    """Components of the rows of a block, and the links that have joined them."""

    def __init__(self, n: int) -> None:
        self.label, self.edges = np.arange(n), []

    def join(self, y: int, xs: np.ndarray) -> None:
        found, first = np.unique(self.label[xs], return_index=True)
        fresh = found != self.label[y]
        if fresh.any():
            self.edges += [(y, int(x)) for x in xs[first[fresh]]]
            self.label[np.isin(self.label, found[fresh])] = self.label[y]


def _multiply_rows(needed: DataFrame, n: int, threshold: float, clashes: np.ndarray, what: str) -> DataFrame:
    """Exact overlaps, as ``a, b, overlap, either`` of representatives.

    what: "pairs" are all that reach the threshold, a < b.  "links" are a row per document of a block (b is null, and
    overlap counts the documents that it is linked to there) and the links of a spanning forest; "forest" is these alone,
    so that two documents that are joined already aren't compared.
    """

    def overlaps(table: pa.Table) -> pa.Table:
        own = table.column("row").to_numpy().view(np.uint64)
        keys, first = np.unique(own, return_index=True)
        texts, grams = table.column("text").combine_chunks(), {}
        for i, j in slices(texts):
            h, offsets = word_hashes(texts.slice(i, j - i))
            fits = _row_names(text_keys(h, offsets), clashes) == own[i:j]  # an identifier may come with several texts
            for k, g in enumerate(_grams(h, offsets, n)):
                if fits[k]:
                    grams[int(own[i + k])] = g
        grams = [grams.get(int(k), np.zeros(0, np.uint64)) for k in keys]
        reps, copies = (table.column(c).to_numpy()[first] for c in ("doc_id", "n"))
        lengths = np.array([len(g) for g in grams])
        column = np.unique(np.concatenate(grams), return_inverse=True)[1]
        begin = np.r_[0, np.cumsum(lengths)]
        marked = np.zeros(len(column) + 1, np.int64)
        forest, links = _Forest(len(keys)), np.zeros(len(keys), np.int64)
        pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for y, cols in enumerate(table.column("cols").take(pa.array(first)).to_pylist()):
            if cols is None:
                continue
            xs = np.searchsorted(keys, np.frombuffer(cols, np.uint64))
            marked[column[begin[y] : begin[y + 1]]] = 1
            step = 1 if what == "forest" else 512
            while len(xs):
                if what == "forest":
                    xs = xs[forest.label[xs] != forest.label[y]]
                x, xs = xs[:step], xs[step:]
                if not len(x):
                    break
                step = min(512, step * 8)
                n_x = lengths[x]
                take = np.repeat(begin[x] - np.r_[0, np.cumsum(n_x)[:-1]], n_x) + np.arange(n_x.sum())
                both = np.bincount(np.repeat(np.arange(len(x)), n_x), marked[column[take]], len(x)).astype(np.int64)
                good = both * (1 + threshold) >= threshold * (n_x + lengths[y]) - 1e-9
                if what == "pairs":
                    pairs.append((x[good], np.full(good.sum(), y), both[good], n_x[good] + lengths[y] - both[good]))
                else:
                    links[x[good]] += copies[y]
                    links[y] += copies[x[good]].sum()
                    forest.join(y, x[good])
            marked[column[begin[y] : begin[y + 1]]] = 0
        if what != "pairs":
            e = np.array(forest.edges, np.int64).reshape(-1, 2)
            k = np.flatnonzero(links) if what == "links" else np.zeros(0, np.int64)
            a, b = np.r_[reps[k], reps[e[:, 0]]], pa.array(np.r_[np.zeros(len(k), np.int64), reps[e[:, 1]]], mask=np.r_[np.ones(len(k), bool), np.zeros(len(e), bool)])
            return pa.table([pa.array(a), b, pa.array(np.r_[links[k], np.zeros(len(e), np.int64)]), pa.nulls(len(a), pa.int64())], names=["a", "b", "overlap", "either"])
        a, b, overlap, either = (np.concatenate(c) for c in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 4
        return pa.table([pa.array(np.minimum(reps[a], reps[b])), pa.array(np.maximum(reps[a], reps[b])), pa.array(overlap, pa.int64()), pa.array(either, pa.int64())], names=["a", "b", "overlap", "either"])

    return needed.groupBy("block").applyInArrow(overlaps, "a long, b long, overlap long, either long")


def _check(n: int, threshold: float) -> None:
    if not 0 < threshold <= 1 or n < 1:
        raise ValueError("0 < threshold <= 1 and n >= 1 are needed")


def _joined(docs: DataFrame, n: int, threshold: float, rows_each: int, what: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Membership (``doc_id, key``), distinct word sequences (``key, rep, n``), and what ``_multiply_rows`` gives."""
    _check(n, threshold)
    docs, spark = documents(docs), docs.sparkSession
    bits = max(0, math.ceil(math.log2(parts(spark) / COLUMN_BLOCK)))
    membership = written(text_classes(docs).distinct(), "membership")
    classes = written(membership.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    clashes = _clashes(classes)
    rows = classes.select("rep", "n", F.substring("key", 1, 8).alias("a"), F.substring("key", 9, 8).alias("b")).mapInArrow(_named(clashes), "row long, doc_id long, n long")
    first = labels = labelled = None
    if what != "pairs":
        rows = written(rows, "rows")
        first, sizes = _first_links(docs, n, threshold, rows, clashes, rows_each)
        labelled, labels = _labelled(written(connected_components(first), "first-groups"), rows, sizes)
    entries = _block_entries(_postings(docs, n, threshold, bits, clashes), threshold, 1 << bits, labels)
    needs = written(_row_blocks(entries, threshold, rows_each).join(rows, "row").select("row", "block", "cols", "n", "doc_id"), "row-blocks")
    texts = sifted(docs.select("doc_id", "text"), sieve(needs.select("doc_id")))
    needed = needs.join(texts, "doc_id").select("row", "block", "cols", "n", "doc_id", "text")
    found = _multiply_rows(needed, n, threshold, clashes, what)
    if first is not None:
        found = found.unionByName(first, allowMissingColumns=True)
    if what == "links":
        found = found.unionByName(_links_inside(docs, labelled, n, threshold, clashes), allowMissingColumns=True)
    return membership, classes, written(found, what)


def _named(clashes: np.ndarray):  # noqa: ANN202
    """Classes (``rep, n`` and both halves of the key) by the names of their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.empty(batch.num_rows, KEY)
            for k in "ab":
                keys[k] = np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u8")
            yield pa.RecordBatch.from_arrays([pa.array(_row_names(keys, clashes).view(np.int64)), batch.column("rep"), batch.column("n")], ["row", "doc_id", "n"])

    return run


def _bands(g: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each run of n-grams, none of them empty, ``BANDS`` hashes of its least n-grams in ``BAND`` orders each."""
    out = np.zeros((len(offsets) - 1, BANDS), np.uint64)
    for k in range(BANDS * BAND):
        odd = np.uint64(pow(BASE, 2 * k + 3, 1 << 64) | 1)
        least = np.minimum.reduceat(g * odd, offsets[:-1])
        out[:, k // BAND] = mix64(out[:, k // BAND] * np.uint64(BASE) + least + np.uint64(k))
    return out


def _first_links(docs: DataFrame, n: int, threshold: float, rows: DataFrame, clashes: np.ndarray, rows_each: int) -> tuple[DataFrame, DataFrame]:
    """Links ``a, b`` of representatives that are likely, and verified: a start for groups, so that these need not give all their pairs; and the n-grams of each row (``row, size``).

    A row is compared with one other: of the least rows that have its bands, the least.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for i, j in slices(texts):
                h, offsets = word_hashes(texts.slice(i, j - i))
                own, found = _row_names(text_keys(h, offsets), clashes), _grams(h, offsets, n)
                lengths = np.array([len(g) for g in found])
                some = np.flatnonzero(lengths)
                if len(some):
                    bands = _bands(np.concatenate(found), np.r_[0, np.cumsum(lengths[some])])
                    bands = pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32), bands.ravel().view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(own[some].view(np.int64)), pa.array(lengths[some]), bands], ["row", "size", "bands"])

    each = written(docs.select("text").mapInArrow(emit, "row long, size long, bands array<long>"), "bands")
    some = each.select("row", F.explode("bands").alias("band"))
    # a band may be in any share of the documents: its least row is an aggregate, and what has it is joined as hot keys are
    centres = written(some.groupBy("band").agg(F.min("row").alias("centre"), F.max("row").alias("most"), F.count(F.lit(1)).alias("n")).filter("centre <> most"), "centres")
    shared = sifted(some.withColumnRenamed("band", "doc_id"), sieve(centres.select("band"))).withColumnRenamed("doc_id", "band")
    pairs = written(_with_classes(shared, centres, "band", ["centre"]).filter("row <> centre").groupBy("row").agg(F.min("centre").alias("centre")), "stars")
    # a centre may have any number of rows: they are cut into pieces of about rows_each
    size = written(pairs.groupBy("centre").agg(F.count(F.lit(1)).alias("n")), "star-sizes")
    cut = _with_classes(pairs, size, "centre", [F.col("n").alias("size")])
    piece = F.xxhash64("centre", F.pmod(F.xxhash64("row"), F.ceil(F.col("size") / rows_each).cast("int")))
    placed = cut.select("row", "centre", F.pmod(piece, F.lit(math.ceil(pairs.count() / rows_each) or 1)).alias("block"))
    asked = placed.mapInArrow(_with_cols, "row long, block long, cols binary")
    needed = asked.unionByName(placed.select(F.col("centre").alias("row"), "block", F.lit(None).cast("binary").alias("cols")))
    needs = written(needed.groupBy("row", "block").agg(F.max("cols").alias("cols")).join(rows, "row").select("row", "block", "cols", "n", "doc_id"), "star-blocks")
    texts = sifted(docs.select("doc_id", "text"), sieve(needs.select("doc_id")))
    found = _multiply_rows(needs.join(texts, "doc_id").select("row", "block", "cols", "n", "doc_id", "text"), n, threshold, clashes, "forest")
    return written(found.filter("a <> b").select("a", "b"), "first-links"), each.select("row", "size")


def _with_cols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``row, centre, block`` with their centre as what they are compared with."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("block"), pa.array([c.to_bytes(8, "little", signed=True) for c in batch.column("centre").to_pylist()], pa.binary())], ["row", "block", "cols"])


def _labelled(groups: DataFrame, rows: DataFrame, sizes: DataFrame) -> tuple[DataFrame, _Labels]:
    """Rows with the labels of groups (``node, component``) as ``row, doc_id, n, size, label``, at most about ``MOST_LABELS`` of them; the others count as not joined yet."""
    named = rows.join(groups, rows["doc_id"] == groups["node"]).select("row", "doc_id", "n", F.col("component").alias("label"))
    named = written(named.join(sizes.groupBy("row").agg(F.max("size").alias("size")), "row"), "labelled")
    if (count := named.count()) > MOST_LABELS:
        groups = written(named.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label-sizes")
        least, total = None, 0
        for r in groups.groupBy("n").agg(F.sum("n").alias("rows")).orderBy(F.desc("n")).toLocalIterator():
            if (total := total + r.rows) > MOST_LABELS:
                break
            least = r.n
        if least:
            named = written(named.join(groups.filter(F.col("n") >= least).select("label"), "label", "left_semi"), "labelled")
        else:
            named = written(named.filter(F.pmod(F.xxhash64("row"), F.lit(math.ceil(count / MOST_LABELS))) == 0), "labelled")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(k).to_numpy().tobytes()], pa.binary()) for k in range(2)], ["row", "label"])

    found = named.select("row", "label").mapInArrow(pack, "row binary, label binary").collect()
    keys, label = np.frombuffer(b"".join(r.row for r in found), np.uint64), np.frombuffer(b"".join(r.label for r in found), np.int64)
    order, group = np.argsort(keys), np.unique(label, return_inverse=True)[1].astype(np.uint32)
    sc = rows.sparkSession.sparkContext
    return named, _Labels(sc.broadcast(keys[order]), sc.broadcast(group[order]))


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each of ``left`` shares with each of ``right``: columns that many have by dense products, the others pair by pair."""
    out = np.zeros((len(left), len(right)), np.float32)
    column = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)))
    if not len(column):
        return out
    cells, counts = [], []
    for grams in (left, right):
        g, doc = np.concatenate(grams), np.repeat(np.arange(len(grams)), [len(x) for x in grams])
        at = np.minimum(np.searchsorted(column, g), len(column) - 1)
        there = column[at] == g
        at, doc = at[there], doc[there]
        order = np.argsort(at, kind="stable")
        cells.append((at[order], doc[order]))
        counts.append(np.bincount(at, minlength=len(column)))
    begin = [np.r_[0, np.cumsum(c)] for c in counts]
    products = counts[0] * counts[1]
    dense = products >= DENSE_SHARE * out.size
    for some in np.array_split(np.flatnonzero(dense), math.ceil(dense.sum() / 1024) or 1):
        parts_ = []
        for (at, doc), c, b, height in zip(cells, counts, begin, out.shape, strict=True):
            x = np.zeros((height, len(some)), np.float32)
            take = np.repeat(b[some] - np.r_[0, np.cumsum(c[some])[:-1]], c[some]) + np.arange(c[some].sum()) if len(some) else np.zeros(0, np.int64)
            x[doc[take], np.repeat(np.arange(len(some)), c[some])] = 1
            parts_.append(x)
        out += parts_[0] @ parts_[1].T
    flat, rare = out.reshape(-1), np.flatnonzero(~dense)
    total, i = np.r_[0, np.cumsum(products[rare])], 0
    while i < len(rare):
        j = max(i + 1, int(np.searchsorted(total, total[i] + (1 << 20), side="right")) - 1)
        some, wide = rare[i:j], products[rare[i:j]]
        own, k = np.repeat(some, wide), np.arange(total[j] - total[i]) - np.repeat(total[i:j] - total[i], wide)
        np.add.at(flat, cells[0][1][begin[0][own] + k // counts[1][own]] * out.shape[1] + cells[1][1][begin[1][own] + k % counts[1][own]], np.float32(1))
        i = j
    return out


def _links_inside(docs: DataFrame, labelled: DataFrame, n: int, threshold: float, clashes: np.ndarray) -> DataFrame:
    """``a, overlap`` of representatives: the documents that each row is linked to within its group, tile by tile."""
    piece_bytes, piece_rows = PIECE_BYTES, PIECE_ROWS

    def count(table: pa.Table) -> pa.Table:
        own = table.column("row").to_numpy().view(np.uint64)
        texts, grams = table.column("text").combine_chunks(), {}
        for i, j in slices(texts):
            h, offsets = word_hashes(texts.slice(i, j - i))
            fits = _row_names(text_keys(h, offsets), clashes) == own[i:j]  # an identifier may come with several texts
            for k in np.flatnonzero(fits):
                if int(own[i + k]) not in grams:
                    grams[int(own[i + k])] = _grams(h[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]), n)[0]
        label, piece, other = (table.column(c).to_numpy() for c in ("label", "piece", "other"))
        reps, copies = (table.column(c).to_numpy() for c in ("doc_id", "n"))
        order = np.lexsort((own, piece, other, label))
        tile = np.flatnonzero(np.r_[True, np.diff(label[order]) != 0] | np.r_[True, np.diff(other[order]) != 0])
        a, links = [], []
        for begin, end in zip(tile, np.r_[tile[1:], len(order)], strict=True):
            at = order[begin:end]
            at = at[np.r_[True, own[at[1:]] != own[at[:-1]]]]
            i, j = int(other[at[0]]) >> 32, int(other[at[0]]) & 0xFFFFFFFF
            sides = [at[piece[at] == i], at[piece[at] == j]]
            if not all(len(x) for x in sides):
                continue
            left, right = ([grams[int(k)] for k in own[x]] for x in sides)
            m = [np.array([len(g) for g in side], np.float64) for side in (left, right)]
            both = _overlaps(left, right)
            of_right = np.zeros(len(right))
            for k in range(0, len(left), 256):
                good = both[k : k + 256] * (1 + threshold) >= threshold * (m[0][k : k + 256, None] + m[1]) - 1e-9
                if i == j:
                    good[np.arange(len(good)), k + np.arange(len(good))] = False
                good = good.astype(np.float64)
                a.append(reps[sides[0][k : k + 256]])
                links.append((good @ copies[sides[1]].astype(np.float64)).astype(np.int64))
                of_right += copies[sides[0][k : k + 256]].astype(np.float64) @ good
            if i != j:
                a.append(reps[sides[1]])
                links.append(of_right.astype(np.int64))
        a, links = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, links))
        return pa.table({"a": pa.array(a[links > 0], pa.int64()), "overlap": pa.array(links[links > 0], pa.int64())})

    # an n-gram has 8 bytes
    weight = F.col("size") * 8
    sizes = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("bytes"))
    sizes = written(sizes.select("label", "n", "bytes", F.greatest(F.ceil(F.col("bytes") / piece_bytes), F.ceil(F.col("n") / piece_rows)).cast("long").alias("pieces")), "groups")
    small = sizes.filter("pieces = 1").agg(F.sum("bytes")).first()[0] or 0
    cut = _with_classes(labelled, sizes, "label", ["pieces"]).withColumn("piece", F.pmod(F.xxhash64("row"), "pieces"))
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1), lambda k: F.shiftleft(F.least(k, "piece"), 32) + F.greatest(k, "piece"))
    many = F.lit(math.ceil(small / piece_bytes) or 1)  # groups of one piece share blocks
    block = F.when(F.col("pieces") == 1, F.pmod(F.xxhash64("label"), many)).otherwise(F.xxhash64("label", "other"))
    texts = sifted(docs.select("doc_id", "text"), sieve(labelled.select("doc_id")))
    placed = cut.join(texts, "doc_id").select("row", "doc_id", "n", "label", "piece", "pieces", "text", F.explode(tiles).alias("other"))
    return placed.select("row", "doc_id", "n", "label", "piece", "other", "text", block.alias("block")).groupBy("block").applyInArrow(count, "a long, overlap long")


def class_pairs(docs: DataFrame, n: int = 3, threshold: float = 0.5, rows_each: int = 256) -> tuple[DataFrame, DataFrame]:
    """Membership of every document (``doc_id, rep``: the least identifier with its word sequence), and the pairs of representatives that reach the threshold (``a, b, overlap, either``)."""
    membership, classes, pairs = _joined(docs, n, threshold, rows_each, "pairs")
    return _with_classes(membership, classes, "key", ["rep"]).select("doc_id", "rep"), pairs


def ngram_jaccard_join(docs: DataFrame, n: int = 3, threshold: float = 0.5, rows_each: int = 256) -> DataFrame:
    """``doc_id, class_id, links`` of every document whose n-gram set reaches the threshold with another's.

    ``links`` counts these others, copies of one text each; ``class_id`` is the least identifier that chains of links lead to.
    """
    membership, classes, found = _joined(docs, n, threshold, rows_each, "links")
    labels = connected_components(found.filter("b IS NOT NULL AND a <> b").select("a", "b"))
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("overlap").alias("others"))
    linked = classes.join(counts, "rep", "left").join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    rows = linked.select("key", "n", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links")).filter("links > 0")
    return _with_classes(membership, written(rows, "linked"), "key", ["class_id", "links"]).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links"))


def near_groups(docs: DataFrame, n: int = 3, threshold: float = 0.5) -> DataFrame:
    """``doc_id, group_id`` of the documents that have a near or exact copy; the group is named by its least identifier."""
    membership, classes, found = _joined(docs, n, threshold, 256, "forest")
    labels = connected_components(found.filter("a <> b").select("a", "b"))
    rows = classes.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").filter("n > 1 OR component IS NOT NULL").select("key", "n", F.coalesce("component", "rep").alias("group_id"))
    return _with_classes(membership, written(rows, "grouped"), "key", ["group_id"]).groupBy("doc_id").agg(F.min("group_id").alias("group_id"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the least node) of an edge list ``a, b``: large-star and small-star rounds until all are stars."""
    pairs = written(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u > v").distinct(), "edges")
    while True:
        ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(pairs.select("v", F.lit(0), F.lit(1)))
        # a star has no node with two edges upwards, nor one with edges both ways
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up > 0 AND down > 0)").isEmpty():
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select("v", "v").distinct())
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = _with_classes(both, least, "u", ["m"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smaller = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smaller, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u > v").distinct()
        before, pairs = pairs, written(small, "edges")
        discard(before)
        discard(least)


def drop_near_copies(docs: DataFrame, n: int = 3, threshold: float = 0.5) -> DataFrame:
    """The documents, with one of each group of near copies: that with the least identifier. All columns stay."""
    groups = near_groups(docs, n, threshold).filter("doc_id <> group_id").select(F.col("doc_id").alias("gone"))
    gone = written(groups, "gone")
    through = sieve(gone)
    # rows that surely stay aren't shuffled; the alias keeps the name apart from the documents' own columns
    some = sifted(docs, through).alias("d").join(gone.alias("g"), F.col("d.doc_id").cast("long") == F.col("g.gone"), "left_anti")
    return sifted(docs, through, inside=False).unionByName(some)
