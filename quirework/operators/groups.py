"""Groups of rows that stand together, taken from a stream of Arrow batches many at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole groups, the group of each row counted from 0, and the row at which each group begins.

    Rows of a group must follow one another.  A group at the end of a batch is held back until the next ones have
    shown where it ends; besides it no more than a batch is held.
    """

    def begins(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            code = pc.dictionary_encode(table.column(k).combine_chunks(), null_encoding="encode")
            code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        return new

    def whole(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        new = begins(table)
        return table, np.cumsum(new) - 1, np.flatnonzero(new)

    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.table(batch) if not isinstance(batch, pa.RecordBatch) else pa.Table.from_batches([batch])
        if held:
            # the batch may go on with the group that is held, whose last row tells
            joint = pa.concat_tables([held[-1].slice(held[-1].num_rows - 1).select(keys), table.select(keys)])
            starts = np.flatnonzero(begins(joint)[1:])
        else:
            starts = np.flatnonzero(begins(table))
        if len(starts) and (held or starts[-1] > 0):
            ready = pa.concat_tables([*held, table.slice(0, starts[-1])])
            held = []
            if ready.num_rows:
                yield whole(ready.combine_chunks())
            table = table.slice(starts[-1])
        held.append(table)
    if held:
        yield whole(pa.concat_tables(held).combine_chunks())
