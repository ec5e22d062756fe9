from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest

from quirework.llm.token_counts import END, VOCABULARY, count_documents, encoder, scan_files, write_tokens

from .conftest import prose


def naive(tokens: list[int], end: int) -> list[tuple[int, int, bool]]:
    out, begin = [], 0
    for i, t in enumerate(tokens):
        if t == end:
            out.append((begin, i - begin, True))
            begin = i + 1
    return out + ([(begin, len(tokens) - begin, False)] if begin < len(tokens) else [])


@pytest.mark.parametrize("block", [1, 3, 7, 64, 10_000])
def test_blocks_are_stitched(spark, tmp_path, block):
    rng, files, want = random.Random(block), [], {}
    for k in range(8):
        tokens = [rng.choice([0, 5, 6, 9]) if k else 0 for _ in range(rng.randint(1, 90))] + [0] * (k % 2)
        if k == 3:
            tokens = [5] * 40
        path = tmp_path / f"f{k}.bin"
        path.write_bytes(np.array(tokens, "<u4").tobytes())
        files.append((str(path), len(tokens)))
        want[str(path)] = naive(tokens, 0)
    files.append((str(tmp_path / "none"), 0))
    got: dict = {}
    for r in scan_files(spark.createDataFrame(files, "file string, n_tokens long"), end=0, width=4, block_tokens=block).orderBy("file", "doc_no").collect():
        assert r.doc_no == len(got.setdefault(r.file, []))
        got[r.file].append((r.start, r.n_tokens, r.closed))
    assert got == want


def test_round_trip(spark, tmp_path):
    rng = random.Random(0)
    texts = [prose(rng, rng.randint(0, 40)) for _ in range(50)] + ["é ß 😀 日本語", "<|endoftext|>", "", None, "a\n\n  b\t"]
    files = write_tokens(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), f"file://{tmp_path}/t")
    row = files.collect()[0]
    tokens = np.frombuffer(Path(row.file[len("file://") :]).read_bytes(), "<u2")
    assert len(tokens) == row.n_tokens
    ends = np.flatnonzero(tokens == END)
    back = [encoder(VOCABULARY).decode(p[p != END].tolist()) for p in np.split(tokens, ends + 1)[:-1]]
    assert back == [t or "" for t in texts]
    assert not [p for p in Path(f"{tmp_path}/t").iterdir() if p.name.startswith(".tokens") and p.suffix != ".crc"]


def test_counts_are_those_of_the_texts(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(200)]
    got = count_documents(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), block_tokens=50).collect()
    encode = encoder(VOCABULARY).encode_ordinary
    assert sorted(r.n_tokens for r in got) == sorted(len(encode(t)) for t in texts)
    assert all(r.closed for r in got)


def test_awkward_rows(spark, awkward, empty, tmp_path):
    got = count_documents(awkward).collect()
    assert len(got) == awkward.count() and sum(r.n_tokens == 0 for r in got) == 3
    assert count_documents(empty).count() == 0
    with pytest.raises(ValueError):
        scan_files(spark.createDataFrame([], "file string, n_tokens long"), width=3)
