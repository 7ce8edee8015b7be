"""A pipeline over a stream: each micro-batch is one run, in a folder of its own."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import Pipeline
from ..plans.records import Commits
from ..plans.run import run
from ..sources.datasets import Loader
from ..sources.files import join


def run_stream(stream: DataFrame, pipeline: Pipeline, run_root: str, checkpoint: str, trigger: dict[str, Any] | None = None, **options: Any) -> StreamingQuery:
    """Starts a query that runs the pipeline on every batch that has rows; run_root/batch=N holds batch N.

    A batch that is run again after a failure replaces its folder, so each batch counts once. The pipeline's own source is not read. Commit records are
    kept for each batch by itself, below batch=N of their root.
    """

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            own = replace(pipeline, source=Loader("batch", lambda _: batch))
            commits = options.get("commits")
            mine = {"commits": replace(commits, root=join(commits.root, f"batch={number}"))} if isinstance(commits, Commits) else {}
            run(batch.sparkSession, own, f"{run_root.rstrip('/')}/batch={number}", **options | mine)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer.trigger(availableNow=True)).start()


def windowed_counts(stream: DataFrame, time: str, by: list[str], width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window and columns; rows later than `late` behind the newest are left out. Works on batch frames too."""
    at = F.window(F.col(time), width, slide) if slide else F.window(F.col(time), width)
    return stream.withWatermark(time, late).groupBy(at.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
