"""A corpus to score against: PDF files and, under the same names, the archives of their LaTeX sources."""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.evaluate import source as L

#: Words of prose that a source must have for its paper to be scored.
LEAST_WORDS = 500
PAPERS = "paper string, reference string, source string, bibliography string, scorable boolean"


def unpack(content: bytes) -> dict[str, str]:
    """The texts of an archive by name: a tar, packed or not, or a single source, gzipped or not."""
    try:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
            found = {m.name: tar.extractfile(m) for m in tar.getmembers() if m.isfile() and m.name.endswith((".tex", ".bbl"))}
            return {name: f.read().decode("utf-8", "replace") for name, f in found.items() if f is not None}
    except (tarfile.TarError, EOFError):
        pass
    try:
        content = gzip.decompress(content)
    except (OSError, EOFError):
        pass
    return {"source.tex": content.decode("utf-8", "replace")}


def paper_of(files: dict[str, str]) -> dict[str, object]:
    """Reference prose, whole source and the file of the bibliography; of several lists the longest, not all of them."""
    tex = {k: v for k, v in files.items() if k.endswith(".tex")}
    begins = [k for k, v in tex.items() if "\\begin{document}" in v]
    main = max(begins or (tex if len(tex) == 1 else []), key=lambda k: (len(tex[k]), k), default=None)
    prose = L.prose_of(L.inline_inputs(tex, main)) if main else ""
    items = {k: L.count_items(v) for k, v in sorted(files.items())}
    best = max(items, key=items.get, default=None)
    return {"reference": prose, "source": "\n".join(tex.values()), "bibliography": files[best] if best and items[best] else "", "scorable": len(prose.split()) >= LEAST_WORDS}


def read_sources(spark: SparkSession, path: str, only: str = "") -> DataFrame:
    """``PAPERS`` of the archives in a folder; ``paper`` is a file's name without its endings, and has ``only`` in it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{tar.gz,tgz,tar,gz,tex}").load(path)
    named = files.select(stem(F.col("path"), r"\.(?:tar\.gz|tgz|tar|gz|tex)").alias("paper"), "content").filter(F.col("paper").contains(only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"paper": p.as_py()} | paper_of(unpack(c.as_py() or b"")) for p, c in zip(batch.column("paper"), batch.column("content"), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([*((k, pa.string()) for k in ("paper", "reference", "source", "bibliography")), ("scorable", pa.bool_())]))

    return named.mapInArrow(run, PAPERS)


def stem(path, endings: str):  # noqa: ANN001, ANN201
    """A file's name without these endings."""
    return F.regexp_replace(F.substring_index(path, "/", -1), rf"(?i){endings}$", "")
