"""Passages of ``min_words`` words that occur more than once, by bucket-pointer refinement of word suffixes.

The suffixes of all documents are sorted by their first ``min_words`` words, as far as they may be repeated:

1. Of each window of ``min_words`` words, the q-gram with the least hash is an anchor (equal windows have equal
   anchors, at one place).  Anchors are counted by q-gram over all documents; a suffix whose window has no
   repeated anchor is alone and drops out, and only documents with a repeated anchor are read again.
2. The suffixes of one anchor are neighbours: with the ``min_words`` words that the last one needs they are a
   *context*.  Contexts go to the task that owns their anchor's q-gram; so all equal windows meet there, with their
   words.  Equal contexts of one batch are merged before they are sent.
3. There words are numbered, exactly, and suffixes go to initial q-gram buckets by the code of their first words.
   Each suffix has a pointer to its bucket.  Buckets are then refined by sorting them on the bucket pointers of
   the suffixes as many words later as the buckets are deep.  The pointers are replaced by the refined ones, and
   these are what the next, recursive refinement looks up: depth doubles.  Buckets of one suffix are final and
   leave.  What remains at depth ``min_words`` are the groups of equal windows; as numbers stand for words and
   buckets for runs of these, nothing rests on hashes.

An anchor may be in any share of the documents.  Those with a 1/1024 of all anchors or more are found first (there
are at most 2048): that they are repeated is known, so that they aren't counted by one task, and the suffixes of
these are sent one by one to owners by their whole windows.  Then only equal windows meet, a row from each batch.

The least (doc_id, position) of a group is its first occurrence.  Rows without identifier or text and texts of
fewer than ``min_words`` words have no passages; repeated rows of one identifier are one document.  Very long texts
are taken whole.  Texts are cut at whole words; what remains keeps its line breaks.  Of other columns none is read,
so that they may have any name.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework.llm.common import Packed, by_part, documents, mix64, part_of, parts, rolling, sieve, sifted, slices, span_hashes, text_bytes, word_bounds, word_hashes, written

ANCHORS = Packed(bucket=np.uint64, ids=np.int64, which=np.uint32, at=np.uint32)
PLACES = Packed(doc=np.int64, at=np.uint32)
CONTEXTS = Packed(ids=np.int64, which=np.uint32, at=np.uint32, n=np.uint32, state=np.uint8, sub=np.uint16, size=np.uint32, text=np.uint8)
FLAGGED = Packed(doc=np.int64, at=np.uint32, n=np.uint32, first=np.uint8)
_SEGMENT = 1 << 22
#: States of a context on its way: alone in its batch, first of several there, one of the others.
SINGLE, FIRST, REPEAT = 0, 1, 2
#: An anchor with this share of all, and so often at least, is hot; the flag of its places.
HOT_SHARE, HOT_LEAST, HOT = 1 / 1024, 1024, 1 << 31
#: Bytes of contexts that are sorted at once.
AT_ONCE = 2 << 20


def _least(x: np.ndarray, window: int) -> np.ndarray:
    """The least of each window of x, by doubling."""
    out, have = x, 1
    while have * 2 <= window:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    n = len(x) - window + 1
    return np.minimum(out[:n], out[window - have : window - have + n])


def _anchor_of(g: np.ndarray, n: int, window: int) -> np.ndarray:
    """The position in g of the least hash, the leftmost of equals, of each of n windows of g."""
    low, out = np.uint64((1 << 23) - 1), [np.zeros(0, np.int64)]
    for s in range(0, n, _SEGMENT):
        part = g[s : s + _SEGMENT + window - 1]
        least = _least((part & ~low) | np.arange(len(part), dtype=np.uint64), window)
        out.append((least[: n - s] & low).astype(np.int64) + s)
    return np.concatenate(out)


def refine(words: np.ndarray, left: np.ndarray, depth: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts suffixes by their first ``depth`` words; gives those that share these with another, and their buckets.

    words: the numbers of the words; left: how many words each suffix has.  A suffix's pointer is its bucket's
    first place in the sorted order, so that a refined bucket's pointer lies within the old one's range.
    """
    bits = max(1, int(words.max(initial=0)).bit_length())
    d = max(1, min(q, depth, 62 // bits))
    at = np.flatnonzero(left >= d)
    code = np.zeros(len(at), np.int64)
    for k in range(d):
        code = code << bits | words[at + k]
    pointer = np.full(len(words), -1, np.int64)
    order = np.argsort(code, kind="stable")
    at, code = at[order], code[order]

    def settle(at: np.ndarray, new: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Gives sorted suffixes the pointers of the buckets that begin at ``new``; those that aren't alone remain."""
        begin = np.flatnonzero(new)
        size = np.diff(np.r_[begin, len(at)])
        pointer[at] = np.repeat(place[begin], size)
        return at[np.repeat(size > 1, size)]

    def edges(x: np.ndarray) -> np.ndarray:
        return np.r_[True, x[1:] != x[:-1]] if len(x) else np.zeros(0, bool)

    at = settle(at, edges(code), np.arange(len(at)))
    while d < depth:
        step = min(d, depth - d)
        at = at[left[at] >= d + step]
        old, later = pointer[at], pointer[at + step]
        order = np.lexsort((later, old))
        at, old, later = at[order], old[order], later[order]
        begins = np.flatnonzero(edges(old))
        inner = np.arange(len(at)) - np.repeat(begins, np.diff(np.r_[begins, len(at)]))
        at = settle(at, edges(old) | edges(later), old + inner)
        d += step
    at = at[left[at] >= depth]
    return at, pointer[at]


def _anchors(docs: DataFrame, min_words: int, q: int, blocks: int) -> DataFrame:
    """The anchors of all documents, packed by q-gram."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id").to_numpy()
            for i, j in slices(texts):
                h, offsets = word_hashes(texts.slice(i, j - i))
                if len(h) < min_words:
                    continue
                doc = np.repeat(np.arange(j - i), np.diff(offsets))
                g, n = rolling(h, q), len(h) - min_words + 1
                where = np.unique(_anchor_of(g, n, min_words - q + 1)[doc[:n] == doc[min_words - 1 :]])
                which = doc[where]
                rows = []
                for p, x in ANCHORS.split(part_of(mix64(g[where]), blocks), bucket=g[where], which=which, at=where - offsets[which]):
                    there, x["which"] = np.unique(x["which"], return_inverse=True)
                    rows.append((p, x | {"ids": ids[i:j][there]}))
                if rows:
                    yield ANCHORS.batch(rows)

    return written(docs.mapInArrow(emit, ANCHORS.schema), "anchors")


def _hot_anchors(anchors: DataFrame) -> np.ndarray:
    """The q-grams of all anchors with ``HOT_SHARE`` of these: at most 2 / HOT_SHARE of them, sorted.

    A q-gram has its share in some task at least; each task names those with half of it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r["bucket"] for batch in batches for r in ANCHORS.rows(batch)]
        bucket, n = np.unique(np.concatenate(held or [np.zeros(0, np.uint64)]), return_counts=True)
        total = int(n.sum())
        big = n >= max(2, total * HOT_SHARE / 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[bucket[big].view(np.int64), 0]), pa.array(np.r_[n[big], 0]), pa.array(np.r_[np.zeros(big.sum(), np.int64), total])], ["bucket", "n", "total"])

    counted = anchors.mapInArrow(count, "bucket long, n long, total long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    least = max(HOT_LEAST, (counted.agg(F.sum("total")).first()[0] or 0) * HOT_SHARE / 2)
    return np.sort(np.array([r.bucket for r in counted.filter(F.col("n") >= least).select("bucket").collect()], np.int64).view(np.uint64))


def _repeated_anchors(anchors: DataFrame, hot: np.ndarray, blocks: int) -> DataFrame:
    """``doc_id, at``: the anchors of each document whose q-gram has several places, hot ones flagged."""

    def by_doc(doc: np.ndarray, at: np.ndarray) -> list[tuple[int, dict[str, np.ndarray]]]:
        return PLACES.split(part_of(mix64(doc.view(np.uint64)), blocks), doc=doc, at=at)

    def places(r: dict[str, np.ndarray], some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return r["ids"][r["which"][some]], r["at"][some]

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [places(r, np.isin(r["bucket"], hot)) for r in ANCHORS.rows(batch)]
            if found:
                doc, at = (np.concatenate(c) for c in zip(*found, strict=True))
                yield PLACES.batch(by_doc(doc, at | np.uint32(HOT)))

    def repeated(table: pa.Table) -> pa.Table:
        rows = ANCHORS.rows(table)
        bucket = np.concatenate([r["bucket"] for r in rows])
        doc, at = (np.concatenate(c) for c in zip(*(places(r, np.ones(len(r["at"]), bool)) for r in rows), strict=True))
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        several = np.r_[False, b[1:] == b[:-1]] | np.r_[b[1:] == b[:-1], False] if len(b) else np.zeros(0, bool)
        order = order[several & ~np.isin(b, hot)]
        doc, at = doc[order], at[order]
        by = np.lexsort((at, doc))
        return pa.Table.from_batches([PLACES.batch(by_doc(doc[by], at[by]))])

    def cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, r in zip(batch.column("part").to_pylist(), ANCHORS.rows(batch), strict=True):
                some = ~np.isin(r["bucket"], hot)
                rows.append((p, {"bucket": r["bucket"][some], "ids": r["ids"], "which": r["which"][some], "at": r["at"][some]}))
            yield ANCHORS.batch(rows)

    def gather(table: pa.Table) -> pa.Table:
        x = PLACES.joined(table)
        order = np.lexsort((x["at"], x["doc"]))
        doc, at = x["doc"][order], x["at"][order]
        ids, begin = np.unique(doc, return_index=True)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "at": pa.array([a.tobytes() for a in np.split(at, begin[1:])] if len(ids) else [], pa.binary())})

    some = (anchors.mapInArrow(cold, ANCHORS.schema) if len(hot) else anchors).groupBy("part").applyInArrow(repeated, PLACES.schema)
    if len(hot):
        some = some.unionByName(anchors.mapInArrow(flag, PLACES.schema))
    return written(some.groupBy("part").applyInArrow(gather, "doc_id long, at binary"), "places")


def _contexts(flagged: DataFrame, min_words: int, q: int, blocks: int) -> DataFrame:
    """The suffixes that may be repeated, as contexts of neighbours with one anchor, merged within each batch."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, anchors = batch.column("text"), batch.column("doc_id").to_numpy(), batch.column("at").to_pylist()
            for i, j in slices(texts, 1 << 20):
                folded, starts, ends, begin = word_bounds(*text_bytes(texts.slice(i, j - i)))
                n = len(starts) - min_words + 1
                if n < 1:
                    continue
                h, doc = span_hashes(folded, starts, ends), np.repeat(np.arange(j - i), np.diff(begin))
                mark = np.zeros(len(h), np.uint8)
                for k in range(i, j):
                    p = np.frombuffer(anchors[k], np.uint32)
                    place = begin[k - i] + (p & np.uint32(HOT - 1)).astype(np.int64)
                    # an identifier may come with several texts, and has the anchors of all
                    good = place < begin[k - i + 1]
                    mark[place[good]] = 1 + (p[good] >> np.uint32(31))
                g = rolling(h, q)
                anchor = _anchor_of(g, n, min_words - q + 1)
                where = np.flatnonzero((doc[:n] == doc[min_words - 1 :]) & (mark[anchor] > 0))
                if not len(where):
                    continue
                a = anchor[where]
                new = np.r_[True, (where[1:] != where[:-1] + 1) | (a[1:] != a[:-1])] | (mark[a] > 1)
                first = np.flatnonzero(new)
                s, a, size = where[first], a[first], np.diff(np.r_[first, len(where)])
                route = g[a]
                if (mark[a] > 1).any():
                    route = np.where(mark[a] > 1, rolling(h, min_words)[s], route)
                # anchors have small hashes
                route = mix64(route)
                # the words of all texts with a space after each
                long = ends - starts
                text = np.full(long.sum() + len(long), 32, np.uint8)
                inside = np.arange(long.sum()) + np.repeat(np.arange(len(long)), long)
                text[inside] = folded[np.repeat(starts - np.r_[0, np.cumsum(long)[:-1]], long) + np.arange(long.sum())]
                stops = np.cumsum(long + 1) - 1
                blob, lo, hi = text.tobytes(), (stops - long)[s].tolist(), stops[s + size + min_words - 2].tolist()
                which, own = doc[s], ids[i:j]
                at = s - begin[which]
                pieces = [blob[x:y] for x, y in zip(lo, hi, strict=True)]
                groups: dict[bytes, list[int]] = {}
                for k, piece in enumerate(pieces):
                    groups.setdefault(piece, []).append(k)
                state, sent = np.full(len(s), SINGLE), np.ones(len(s), bool)
                for several in groups.values():
                    if len(several) > 1:
                        # the same place twice is a repeated row of one document, not a repeat
                        by_place = {(own[which[k]], at[k]): k for k in several}
                        least = by_place.pop(min(by_place))
                        state[several], sent[several] = REPEAT, False
                        sent[list(by_place.values())] = True
                        state[least], sent[least] = FIRST if by_place else SINGLE, True
                pick = np.flatnonzero(sent)
                order, found, bounds = by_part(part_of(route[pick], blocks))
                rows = []
                for k, p in enumerate(found):
                    at_p = pick[order[bounds[k] : bounds[k + 1]]]
                    here = [b"" if state[x] == REPEAT else pieces[x] for x in at_p]
                    there, index = np.unique(which[at_p], return_inverse=True)
                    rows.append((int(p), {"ids": own[there], "which": index, "at": at[at_p], "n": size[at_p], "state": state[at_p], "sub": (route[at_p] & np.uint64(0xFFFF)), "size": np.array([len(x) for x in here]), "text": np.frombuffer(b"".join(here), np.uint8)}))
                yield CONTEXTS.batch(rows)

    return flagged.mapInArrow(emit, CONTEXTS.schema)


def _groups(buf: np.ndarray, offsets: np.ndarray, doc: np.ndarray, at: np.ndarray, state: np.ndarray, min_words: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``doc, at, first`` of the windows of some contexts that are repeated."""
    folded, starts, ends, begin = word_bounds(buf, offsets)
    data = np.ascontiguousarray(folded[folded != 32])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[0, np.cumsum(ends - starts)].astype(np.int64)), pa.py_buffer(data)])
    number = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    count = np.diff(begin)
    which = np.repeat(np.arange(len(count)), count)
    left = begin[1:][which] - np.arange(len(number))
    some, bucket = refine(number, left, min_words, q)
    # windows of contexts that are repeated in their batch count as such, alone or not
    windows = np.flatnonzero(left >= min_words)
    known = windows[state[which[windows]] == FIRST]
    lone = np.setdiff1d(known, some, assume_unique=True)
    where, bucket = np.r_[some, lone], np.r_[bucket, -1 - np.arange(len(lone))]
    c = which[where]
    doc, place, first = doc[c], at[c] + where - begin[c], state[c] == FIRST
    order = np.lexsort((~first, place, doc, bucket))
    doc, place, first, bucket = doc[order], place[order], first[order], bucket[order]
    fresh = np.r_[True, bucket[1:] != bucket[:-1]] if len(order) else np.zeros(0, bool)
    once = fresh | np.r_[True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])] if len(order) else fresh
    doc, place, first, fresh = doc[once], place[once], first[once], fresh[once]
    size = np.diff(np.r_[np.flatnonzero(fresh), len(doc)])
    real = (np.repeat(size > 1, size) | first) if len(doc) else fresh
    return doc[real], place[real], fresh[real]


def _repeats(contexts: DataFrame, min_words: int, q: int, blocks: int) -> DataFrame:
    """All suffixes whose first min_words words occur more than once, as runs (``doc, at, n, first``) by document."""

    def sort(table: pa.Table) -> pa.Table:
        rows = CONTEXTS.rows(table)
        for r in rows:
            r["doc"], r["stops"] = r["ids"][r["which"]], np.cumsum(r["size"], dtype=np.int64)
        # equal windows have equal low bits of their route as well, so that what is large is sorted in several goes
        goes = -(-sum(len(r["text"]) for r in rows) // AT_ONCE)
        out = []
        for k in range(goes):
            found = []
            for r in rows:
                mine = np.flatnonzero((r["state"] != REPEAT) & (r["sub"].astype(np.int64) * goes >> 16 == k))
                if len(mine):
                    size = r["size"][mine].astype(np.int64)
                    take = np.repeat(r["stops"][mine] - np.cumsum(size), size) + np.arange(size.sum())
                    found.append((r["text"][take], size, r["doc"][mine], r["at"][mine].astype(np.int64), r["state"][mine]))
            if found:
                text, size, doc, at, state = (np.concatenate(c) for c in zip(*found, strict=True))
                out.append(_groups(text, np.r_[0, np.cumsum(size)], doc, at, state, min_words, q))
        d, p, f = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((p, d))
        d, p, f = d[order], p[order], f[order].astype(np.int64)
        run = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1) | (f[1:] != f[:-1])]) if len(d) else np.zeros(0, np.int64)
        rest = [r["state"] == REPEAT for r in rows]
        doc, at, n = (np.concatenate([r[c][x] for r, x in zip(rows, rest, strict=True)]) for c in ("doc", "at", "n"))
        d, p, m, f = np.r_[d[run], doc], np.r_[p[run], at], np.r_[np.diff(np.r_[run, len(d)]), n], np.r_[f[run], np.zeros(len(doc), np.int64)]
        return pa.Table.from_batches([FLAGGED.batch(FLAGGED.split(part_of(mix64(d.view(np.uint64)), blocks), doc=d, at=p, n=m, first=f))])

    return contexts.groupBy("part").applyInArrow(sort, FLAGGED.schema)


def repeated_passages(docs: DataFrame, min_words: int = 50, q: int = 17) -> DataFrame:
    """``doc_id, start_word, end_word, first``: the stretches of each document that occur more than once.

    A stretch is a maximal run of consecutive windows; ``first`` tells those that are the first occurrences
    of their windows from those that repeat earlier ones.  ``end_word`` is exclusive.
    """
    if not 1 <= q <= min_words:
        raise ValueError("1 <= q <= min_words is needed")
    docs, blocks = documents(docs), parts(docs.sparkSession)
    anchors = _anchors(docs, min_words, q, blocks)
    places = _repeated_anchors(anchors, _hot_anchors(anchors), blocks)
    flagged = sifted(docs, sieve(places.select("doc_id"))).join(places, "doc_id").select("doc_id", "text", "at")
    repeats = _repeats(_contexts(flagged, min_words, q, blocks), min_words, q, blocks)

    def stretches(table: pa.Table) -> pa.Table:
        x = FLAGGED.joined(table)
        n = x["n"].astype(np.int64)
        doc, first = np.repeat(x["doc"], n), np.repeat(x["first"] > 0, n)
        at = np.repeat(x["at"] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        order = np.lexsort((~first, at, doc))
        doc, at, first = doc[order], at[order], first[order]
        once = np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])] if len(doc) else first
        doc, at, first = doc[once], at[once], first[once]
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1) | (first[1:] != first[:-1])]) if len(doc) else np.zeros(0, np.int64)
        last = np.r_[new[1:], len(doc)] - 1
        return pa.table({"doc_id": pa.array(doc[new], pa.int64()), "start_word": pa.array(at[new], pa.int64()), "end_word": pa.array(at[last] + min_words if len(new) else at[:0], pa.int64()), "first": pa.array(first[new], pa.bool_())})

    return repeats.groupBy("part").applyInArrow(stretches, "doc_id long, start_word long, end_word long, first boolean")


def cut_passages(docs: DataFrame, min_words: int = 50, q: int = 17) -> DataFrame:
    """The documents without the passages that an earlier document or place has; those left without words go.

    Only ``text`` and, if there, ``n_chars`` change.
    """
    cuts = written(repeated_passages(docs, min_words, q).filter(~F.col("first")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_word", "end_word"))).alias("spans")), "cuts")
    through = sieve(cuts.select("doc_id"))
    # documents without cuts aren't shuffled; positions keep names apart
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = sifted(docs, through).toDF(*names)
    key = F.col(names[docs.columns.index("doc_id")]).cast("long")
    joined = own.join(cuts.withColumnRenamed("doc_id", "cut_id"), key == F.col("cut_id"), "left").drop("cut_id")
    at, docs_names = docs.columns.index("text"), docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cuts = batch.column(at), batch.column(batch.num_columns - 1).to_pylist()
            out = texts.to_pylist()
            for k, spans in enumerate(cuts):
                if spans and out[k]:
                    buf, offsets = text_bytes(texts.slice(k, 1))
                    _, starts, ends, _ = word_bounds(buf, offsets)
                    keep, place = [], 0
                    for s in spans:
                        a, b = s["start_word"], min(s["end_word"], len(starts))
                        if a < b:
                            keep.append(buf[place : max(place, starts[a])])
                            place = max(place, starts[b] if b < len(starts) else len(buf))
                    keep.append(buf[place:])
                    left = b"".join(x.tobytes() for x in keep)
                    out[k] = left.decode("utf-8", "replace") if len(word_bounds(np.frombuffer(left, np.uint8), np.array([0, len(left)]))[1]) else None
            gone = pa.array([not (s and o is None and t.is_valid and t.as_py()) for s, o, t in zip(cuts, out, texts, strict=True)])
            columns = [pa.array(out, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays([c.filter(gone) for c in columns], docs_names)

    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType, True) for f in docs.schema.fields])
    done = joined.mapInArrow(cut, schema).unionByName(sifted(docs, through, inside=False))
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
