"""Token counts by separator scan of flat token files, which have no index.

A token file is a sequence of identifiers of one width, where an end-of-document identifier ends each document.

1. Files are cut into blocks of ``block_tokens``.  A task reads a block and finds its separators in one
   vectorised comparison.
2. A prefix scan over the blocks of each file, as a window function over one row a block, stitches them: the
   running number of separators numbers the documents, and the running maximum of separator places tells
   where the document that a block begins within has begun.

``count_documents`` first writes a table of documents as such files, one a partition, into the shared folder.
Null and empty texts are documents of 0 tokens, so every row has one separator; the identifier of a
separator never occurs in a text.  Tokens after the last separator of a file are a document that is not
``closed``.  Repeated rows are counted like any other; other columns are not read.  Empty tables give no files.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.llm.common import shared_dir, written

#: A byte-level vocabulary of 50,256 tokens, as ranks; the next identifier is free for the separator.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The published splitting pattern of byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
END = 50256


@cache
def encoder(path: str):  # noqa: ANN201
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _file_system(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:/") else f"file://{folder}")


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """Writes a file of 16-bit tokens per partition into ``folder``; ``file, n_tokens`` of each, as a written table.

    A file takes its name once it is complete, so that a repeated task replaces it as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        fs, root = _file_system(folder)
        task = TaskContext.get()
        name = f"tokens-{task.partitionId():07d}.bin"
        part, whole, n, out = f"{root}/.{name}.{task.taskAttemptId()}", f"{root}/{name}", 0, None
        for batch in batches:
            for text in batch.column("text"):
                tokens = encode(text.as_py() or "")
                tokens.append(end)
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(part, buffer_size=1 << 20)
                out.write(np.array(tokens, "<u2").tobytes())
                n += len(tokens)
        if out is not None:
            out.close()
            fs.move(part, whole)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], ["file", "n_tokens"])

    return written(docs.select("text").mapInArrow(run, "file string, n_tokens long"), "token-files")


def scan_files(files: DataFrame, end: int = END, width: int = 2, block_tokens: int = 1 << 22) -> DataFrame:
    """``file, doc_no, start, n_tokens, closed`` of each document in the files (``file, n_tokens``), without its separator."""
    if width not in (1, 2, 4, 8) or block_tokens < 1:
        raise ValueError("width is 1, 2, 4 or 8 bytes, and block_tokens positive")
    kind = np.dtype(f"<u{width}")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, total, start in zip(*(batch.column(k).to_pylist() for k in ("file", "total", "start")), strict=True):
                fs, path = _file_system(file)
                with fs.open_input_file(path) as f:
                    f.seek(start * width)
                    tokens = np.frombuffer(f.read(min(block_tokens, total - start) * width), kind)
                at = np.flatnonzero(tokens == end).astype(np.int64) + start
                last = start + len(tokens) == total
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([total], pa.int64()), pa.array([start], pa.int64()), pa.array([last]), pa.array([at.tolist()], pa.list_(pa.int64()))], ["file", "total", "start", "last", "at"])

    blocks = files.filter("n_tokens > 0").select("file", F.col("n_tokens").alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(block_tokens).cast("long"))).alias("start"))
    found = blocks.repartition("file", "start").mapInArrow(search, "file string, total long, start long, last boolean, at array<long>")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.withColumn("done", F.coalesce(F.sum(F.size("at").cast("long")).over(before), F.lit(0).cast("long"))).withColumn("begun", F.coalesce(F.max(F.try_element_at("at", F.lit(-1)) + 1).over(before), F.lit(0).cast("long")))
    ends = F.when(F.col("last") & (F.col("total") > F.coalesce(F.try_element_at("at", F.lit(-1)) + 1, F.col("begun"))), F.concat("at", F.array("total"))).otherwise(F.col("at"))
    bounds = scanned.select("file", "total", "done", F.size("at").alias("n_at"), ends.alias("ends"), F.concat(F.array("begun"), F.transform("at", lambda x: x + 1)).alias("begins"))
    docs = bounds.select("file", "done", "n_at", "begins", F.posexplode("ends").alias("k", "end"))
    return docs.select("file", (F.col("done") + F.col("k")).alias("doc_no"), F.get("begins", F.col("k")).alias("start"), (F.col("end") - F.get("begins", F.col("k"))).alias("n_tokens"), (F.col("k") < F.col("n_at")).alias("closed"))


def count_documents(docs: DataFrame, vocabulary: str = VOCABULARY, block_tokens: int = 1 << 22) -> DataFrame:
    """Writes the texts as token files in the shared folder and scans these; ``file`` is the name alone."""
    spark: SparkSession = docs.sparkSession
    files = write_tokens(docs, f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}", vocabulary)
    return scan_files(files, block_tokens=block_tokens).withColumn("file", F.substring_index("file", "/", -1))
