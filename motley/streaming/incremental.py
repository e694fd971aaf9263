"""Label counts over a stream of frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motley.sources import versions


def windowed_counts(events: DataFrame, time: str, label: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, label, n: counts of each tumbling window; rows later than `late` are left out, and windows leave the
    state once the watermark has passed them. For a batch DataFrame the same without lateness."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    counts = events.groupBy(F.window(time, window), label).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), label, "n")


def upserted(batch: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Counts of `batch` added to those stored under `path` (keys, n), written as a new version and returned: for foreachBatch,
    which may repeat a batch, give each batch its own path of the version before."""
    old = batch.sparkSession.read.parquet(path)
    return old.unionByName(batch.select(*keys, "n")).groupBy(*keys).agg(F.sum("n").alias("n"))


def counted_into(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: adds the rows of each batch, counted by `keys`, to the table in versions under `path` (keys, n). A batch that
    is given again after a failure adds nothing."""

    def sink(batch: DataFrame, number: int) -> None:
        versions.added(batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), path, keys, "n", f"batch-{number}")

    return sink
