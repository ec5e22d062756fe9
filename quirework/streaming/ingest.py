"""Documents as they arrive: each is complete in itself, so that a batch of new ones is converted like a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quirework.plans.convert import convert
from quirework.sources.adapters import html_blocks


def stream_pages(spark: SparkSession, folder: str, out: str, checkpoint: str, to: str = "md", caveman: str | None = None, blocks: Callable[[DataFrame], DataFrame] = html_blocks) -> StreamingQuery:
    """Converts the Parquet files (``page_id, url, html``) that appear in ``folder`` and stops when there are no more.

    A batch that is repeated after a failure overwrites its own part of ``out``.
    """
    pages = spark.readStream.schema("page_id long, url string, html string").parquet(folder)

    def each(batch: DataFrame, batch_id: int) -> None:
        convert(blocks(batch), to, caveman).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
