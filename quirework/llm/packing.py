"""Bounded-space online packing of documents into windows of a fixed number of tokens.

Within a partition, at most ``open_windows`` windows are open.  A piece goes to the fullest one in which it
fits (best fit); if it fits none and all are open, the fullest is emitted and a new one begins.  Texts
longer than a window are cut into whole windows and a rest.  The windows that are still open at the end
of each partition are then merged as a tree: the leftovers of ``fan_in`` neighbouring partitions, fullest first, each
go into the fullest merged window that has room, and the ``open_windows`` emptiest of these go on to the next
level, until one task has merged what is left of all.  So a task never has more than ``fan_in`` times
``open_windows`` windows, however many partitions there are.  Finished windows are written once and not moved.

Null and empty texts have no tokens and are in no window.  Very long texts fill as many windows as they need.  Ties
go to the window opened first, repeated rows are packed once each, and rows without identifier keep a null
identifier.  Other columns aren't read, so that they may have any name.  Empty tables give no windows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import n_words, written

PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
SENT = "part int, done boolean, window string, used long, pieces array<struct<doc_id: bigint, start: bigint, n: bigint>>"


class Packer:
    """Open windows, by free tokens."""

    def __init__(self, size: int, limit: int | None) -> None:
        self.size, self.limit, self.free, self.made = size, limit, [], 0
        self.windows: dict[int, tuple[int, list]] = {}

    def place(self, pieces: list, n: int) -> Iterator[tuple[int, list]]:
        """Places pieces of n tokens together; gives the window that this closes, if any."""
        at = bisect_left(self.free, (n, -1))
        if at < len(self.free):
            room, k = self.free.pop(at)
            used, inside = self.windows.pop(k)
            inside += pieces
            if room > n:
                self.windows[k] = (used + n, inside)
                insort(self.free, (room - n, k))
            else:
                yield used + n, inside
            return
        if n == self.size:
            yield n, list(pieces)
            return
        if self.limit is not None and len(self.free) >= self.limit:
            yield self.windows.pop(self.free.pop(0)[1])
        self.windows[self.made] = (n, list(pieces))
        insort(self.free, (self.size - n, self.made))
        self.made += 1

    def rest(self) -> list[tuple[int, list]]:
        """The windows that are still open, the fullest first."""
        out = [self.windows[k] for _, k in self.free]
        self.free, self.windows = [], {}
        return out


def pack(docs: DataFrame, window: int = 2048, open_windows: int = 16, tokens: Column | None = None, fan_in: int = 64) -> DataFrame:
    """``window, used, pieces``: every window with its tokens and, in order, its pieces of documents.

    tokens: the number of tokens of a row, by default of whitespace-separated words of ``text``.  fan_in: how many
    partitions' leftovers one merging task takes.
    """
    if window < 1 or open_windows < 1 or fan_in < 2:
        raise ValueError("window and open_windows must be positive, and fan_in 2 at least")
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(tokens if tokens is not None else n_words(F.col("text")), F.lit(0)).cast("long").alias("n"))
    made = [written(counted.withColumn("pid", F.spark_partition_id()).mapInArrow(_packer(window, open_windows), SENT), "windows")]
    while True:
        left = made[-1].filter("NOT done")
        owners = (left.agg(F.max("part")).first()[0] or 0) + 1
        merged = left.withColumn("part", F.floor(F.col("part") / fan_in).cast("int")).groupBy("part").applyInArrow(_merger(window, open_windows, len(made), owners <= fan_in), SENT)
        if owners <= fan_in:
            break
        made.append(written(merged, "windows"))
    out = merged
    for df in made:
        out = out.unionByName(df.filter("done"))
    return out.select("window", "used", "pieces")


def _table(rows: list[tuple[str, int, list]], **more: pa.Array) -> pa.RecordBatch:
    arrays = [*more.values(), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([[{"doc_id": d, "start": s, "n": n} for d, s, n in r[2]] for r in rows], pa.list_(PIECE))]
    return pa.RecordBatch.from_arrays(arrays, [*more, "window", "used", "pieces"])


def _packer(window: int, limit: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, made, pid = Packer(window, limit), 0, 0
        out: list[tuple[bool, int, list]] = []

        def flush() -> pa.RecordBatch:
            nonlocal made, out
            rows = [(f"0-{pid}-{made + i}", used, pieces) for i, (_, used, pieces) in enumerate(out)]
            made += len(out)
            batch = _table(rows, part=pa.array([pid] * len(out), pa.int32()), done=pa.array([d for d, _, _ in out], pa.bool_()))
            out = []
            return batch

        for batch in batches:
            if batch.num_rows:
                pid = batch.column("pid")[0].as_py()
            for doc, n in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), strict=True):
                start = 0
                while n > 0:
                    k = min(n, window)
                    out += [(True, used, pieces) for used, pieces in packer.place([(doc, start, k)], k)]
                    start, n = start + k, n - k
                if len(out) >= 4096:
                    yield flush()
        out += [(False, used, pieces) for used, pieces in packer.rest()]
        if out:
            yield flush()

    return run


def _merger(window: int, limit: int, level: int, last: bool):  # noqa: ANN202
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        left = sorted(zip(table.column("window").to_pylist(), table.column("used").to_pylist(), table.column("pieces").to_pylist(), strict=True), key=lambda r: (-r[1], r[0]))
        packer, out = Packer(window, None), []
        for _, used, pieces in left:
            out += packer.place([(p["doc_id"], p["start"], p["n"]) for p in pieces], used)
        rest = packer.rest()
        open_ = [] if last else rest[max(0, len(rest) - limit) :]
        out += rest[: len(rest) - len(open_)]
        rows = [(f"{level}-{part}-{k}", used, pieces) for k, (used, pieces) in enumerate([*out, *open_])]
        return pa.Table.from_batches([_table(rows, part=pa.array([part] * len(rows), pa.int32()), done=pa.array([k < len(out) for k in range(len(rows))], pa.bool_()))])

    return run
