"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal updates.

A *token* is a maximal run of letters, digits and non-ASCII characters, or one of other visible characters;
case counts.  A token that repeats the one before it is replaced by a marker, so that stutter looks alike
whatever the word.  Features are the hashed uni- and bigrams that a text has, each once, and as cruder unigrams the
first ``STEMS`` bytes of each token, since inflected words that training never saw share theirs.  Two models, for
quality and for toxicity, share them.  Training sees a sample of at most ``train_rows`` labelled documents,
those with the least hash of seed and identifier; every document is scored, as a sparse dot product.

Labels: rows with a null are left out, and of several for one document the worse counts.  Of rows of one
identifier training sees one, that whose text has the least hash, so that ``train_rows`` bounds its rows.  Null,
empty and blank texts have no features: their quality and toxicity are 0 and they are not kept.  Very long texts
have all their features.  Rows without identifier are scored like others; repeated rows and ties get one score
each.  Without labels, or documents that have some, every probability is a half.  Other columns aren't read, so
that they may have any name.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import BASE, mix64, slices, span_hashes, text_bytes

#: Bytes of a token that stand for its stem.
STEMS = (5, 7)
#: Bytes of text whose features are computed at once.
AT_ONCE = 1 << 20
SAME = np.uint64(0x5A5A5A5A5A5A5A5A)


class Ftrl(NamedTuple):
    """Hyperparameters: learning rate, smoothing, and the two penalties."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.0
    epochs: int = 4


def _classes() -> np.ndarray:
    table = np.full(256, 2, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = 0
    for c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
        table[c] = 1
    table[128:] = 1
    return table


CLASSES = _classes()


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of all texts, and the offsets of each text's."""
    buf, offsets = text_bytes(texts)
    kind = CLASSES[buf]
    fresh = np.ones(len(kind) + 1, bool)
    if len(kind):
        fresh[1:-1] = kind[1:] != kind[:-1]
        fresh[offsets] = True
    edges = np.flatnonzero(fresh)
    starts, ends = edges[:-1], edges[1:]
    some = kind[starts] != 0
    starts, ends = starts[some], ends[some]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    h = span_hashes(buf, starts, ends)
    together = doc[1:] == doc[:-1]
    marked = h.copy()
    marked[1:][together & (h[1:] == h[:-1])] = SAME
    two = mix64(marked[:-1] * np.uint64(BASE) + marked[1:])[together]
    shift, place = np.uint64(64 - bits), doc.astype(np.uint64) << np.uint64(32)
    cells = [place | marked >> shift, place[1:][together] | two >> shift]
    for n in STEMS:
        longer = ends - starts > n
        cells.append(place[longer] | mix64(span_hashes(buf, starts[longer], starts[longer] + n) + np.uint64(n)) >> shift)
    cell = np.unique(np.concatenate(cells))
    return (cell & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(cell, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))


class Learner:
    """FTRL-proximal: per-coordinate rates, weights that the penalty of absolute values keeps sparse."""

    def __init__(self, bits: int, heads: int, how: Ftrl) -> None:
        self.how, self.heads = how, heads
        # the sums z and n of all heads of a coordinate lie together in memory
        self.sums = np.zeros(((1 << bits) + 1, 2 * heads))

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        h = self.how
        return np.where(np.abs(z) <= h.l1, 0.0, (np.sign(z) * h.l1 - z) / ((h.beta + np.sqrt(n)) / h.alpha + h.l2))

    def weights(self) -> np.ndarray:
        """Head × coordinate."""
        return self._weights(self.sums[:, : self.heads], self.sums[:, self.heads :]).T

    def update(self, x: np.ndarray, y: np.ndarray) -> None:
        """One labelled document; the last coordinate is the bias."""
        at = np.append(x, len(self.sums) - 1)
        own = self.sums[at]
        z, n = own[:, : self.heads], own[:, self.heads :]
        w = self._weights(z, n)
        g = 1 / (1 + np.exp(-np.clip(w.sum(0), -35, 35))) - y
        z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.how.alpha * w
        n += g * g
        self.sums[at] = own


def train(docs: DataFrame, labels: DataFrame, bits: int = 20, train_rows: int = 10_000, seed: int = 0, how: Ftrl = Ftrl()) -> np.ndarray:
    """The weights of both models: 2 × (2**bits + 1).

    Features of the sampled documents are computed where these are; one task then learns from them in the
    order of their hashes.  What comes to the driver are the weights that are not 0.
    """
    place = F.struct(F.xxhash64(F.lit(seed), F.col("_id")).alias("hash"), F.col("_id").alias("id"))
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_quality"), F.col("toxic").cast("int").alias("_toxic")).dropna()
    sample = known.groupBy("_id").agg(F.min("_quality").alias("_quality"), F.max("_toxic").alias("_toxic")).orderBy(place).limit(train_rows).withColumn("_place", place["hash"])
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"))
    # at most train_rows rows of four numbers: small whatever the input; of repeated rows the text with the least hash counts
    found = texts.join(F.broadcast(sample), "_id").groupBy("_place", "_quality", "_toxic").agg(F.min(F.struct(F.xxhash64("_text"), "_text"))["_text"].alias("_text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column("_text"), AT_ONCE):
                x, offsets = features(batch.column("_text").slice(i, j - i), bits)
                grams = pa.array([x[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(3)), grams, pa.array([0] * (j - i), pa.int32())], ["place", "quality", "toxic", "grams", "task"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        learner = Learner(bits, 2, how)
        y = np.stack([table.column("quality").to_numpy(), table.column("toxic").to_numpy()], 1).astype(float)
        x = [np.frombuffer(b, np.uint32) for b in table.column("grams").to_pylist()]
        for _ in range(how.epochs):
            for k, own in enumerate(x):
                learner.update(own, y[k])
        w = learner.weights()
        return pa.table({"head": pa.array([0, 1], pa.int32()), "at": pa.array([np.flatnonzero(r).astype(np.uint32).tobytes() for r in w], pa.binary()), "w": pa.array([r[r != 0].tobytes() for r in w], pa.binary())})

    out = np.zeros((2, (1 << bits) + 1))
    for r in found.mapInArrow(emit, "place long, quality int, toxic int, grams binary, task int").groupBy("task").applyInArrow(learn, "head int, at binary, w binary").collect():
        out[r["head"], np.frombuffer(r["at"], np.uint32)] = np.frombuffer(r["w"], float)
    return out


def score(docs: DataFrame, weights: np.ndarray, least_quality: float = 0.5, most_toxicity: float = 0.5) -> DataFrame:
    """``doc_id, quality, toxicity, keep`` of every row: probabilities of both models, to six digits."""
    bits = (weights.shape[1] - 1).bit_length() - 1
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            for i, j in slices(batch.column("text"), AT_ONCE):
                x, offsets = features(batch.column("text").slice(i, j - i), bits)
                some = np.diff(offsets) > 0
                p = []
                for head in w:
                    sums = np.r_[0.0, np.cumsum(head[x], dtype=float)]
                    margin = sums[offsets[1:]] - sums[offsets[:-1]] + head[-1]
                    p.append(np.where(some, np.round(1 / (1 + np.exp(-np.clip(margin, -35, 35))), 6), 0.0))
                keep = some & (p[0] >= least_quality) & (p[1] < most_toxicity)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(p[0]), pa.array(p[1]), pa.array(keep)], ["doc_id", "quality", "toxicity", "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, quality double, toxicity double, keep boolean")


def classify(docs: DataFrame, labels: DataFrame, bits: int = 20, train_rows: int = 10_000, seed: int = 0, how: Ftrl = Ftrl()) -> DataFrame:
    """``score`` by what ``train`` learns from the labelled documents."""
    return score(docs, train(docs, labels, bits, train_rows, seed, how))
