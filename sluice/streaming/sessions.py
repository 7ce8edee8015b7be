"""Sessions of an unordered stream: state as a table for each micro-batch, a watermark that closes sessions, late rows in an output of their own.

A session is a run of a key's rows, each at most `gap` after one before it. A batch is merged with the sessions that were open before it: rows that fall into one stretch
of the length of the gap are put together before any shuffle, so that a key has as many rows to merge as its time has stretches, and sessions that touch are joined. The watermark is
the latest time of all batches before, less `late`; rows before it are late, and go to the late output as they came. Sessions that no row in time can reach any more are closed.

Below root lie `closed`, `open` and `late`, with a folder batch=N for each batch, and `records`, with a record of each batch, which is published last. A batch that
runs again, after a failure or a replay, starts from the record before its own and replaces its folders, so each batch counts once; what has no record is not read.

Rows without a time are late; null is a key like any other.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import RecordError
from ..sources.files import Files, join

FORMAT = 1
_MICROS = 1_000_000


@dataclass
class Sessions:
    """Where and how sessions are kept: keys `by`, event time `time`, sums of columns as {name: column}."""

    root: str
    time: str
    by: list[str]
    gap: float
    late: float
    sums: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.gap <= 0 or self.late < 0:
            raise ValueError("gap is above 0, late at least 0")

    def start(self, stream: DataFrame, checkpoint: str, trigger: dict[str, Any] | None = None) -> StreamingQuery:
        """Starts a query that takes every batch of the stream."""
        writer = stream.writeStream.foreachBatch(self.each).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer.trigger(availableNow=True)).start()

    def record(self, spark: SparkSession, before: int | None = None) -> dict[str, Any] | None:
        """The record of the last batch (before the one given); None if there is none."""
        numbers = sorted(int(n.removesuffix(".json")) for n in Files(spark).children(join(self.root, "records")) if n[0] != "." and n.endswith(".json"))
        numbers = [n for n in numbers if before is None or n < before]
        if not numbers:
            return None
        record = json.loads(Files(spark).read_text(join(self.root, "records", f"{numbers[-1]:012d}.json")) or "null")
        if not isinstance(record, dict) or record.get("format") != FORMAT:
            raise RecordError(f"the record of batch {numbers[-1]} cannot be read")
        return record

    def _micros(self) -> Any:
        return F.unix_micros(F.col(self.time).cast("timestamp"))

    def each(self, batch: DataFrame, number: int) -> None:
        """Takes one batch."""
        spark = batch.sparkSession
        before = self.record(spark, number)
        mark = before["watermark"] if before else None
        seen = Observation()
        at = F.coalesce(self._micros() >= mark, F.lit(False)) if mark is not None else self._micros().isNotNull()
        rows = batch.observe(seen, F.count(F.lit(1)).alias("rows"), F.max(self._micros()).alias("newest"), F.count_if(~at).alias("late")).persist()
        try:
            self._write(rows.where(~at), "late", number)
            facts = seen.get
            gap = int(self.gap * _MICROS)
            each = rows.where(at).withColumn("__t", self._micros())
            stretches = each.groupBy(*self.by, F.floor(F.col("__t") / gap).alias("__s")).agg(
                F.min("__t").alias("first"), F.max("__t").alias("last"), F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(n) for n, c in self.sums.items()]
            )
            runs = stretches.drop("__s")
            if before:
                runs = runs.unionByName(self._read(spark, "open", before["batch"], runs))
            by_start = Window.partitionBy(*self.by).orderBy("first", "last")
            reach = F.max("last").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
            numbered = runs.withColumn("__new", (reach.isNull() | (F.col("first") - reach > gap)).cast("long")).withColumn("__n", F.sum("__new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
            merged = numbered.groupBy(*self.by, "__n").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("rows").alias("rows"), *[F.sum(n).cast(stretches.schema[n].dataType).alias(n) for n in self.sums]).drop("__n").persist()
            new = facts["newest"] - int(self.late * _MICROS) if facts["newest"] is not None else None
            mark = max((m for m in (mark, new) if m is not None), default=None)
            done = F.col("last") + gap < mark if mark is not None else F.lit(False)
            self._write(merged.where(done), "closed", number)
            self._write(merged.where(~done), "open", number)
            merged.unpersist()
        finally:
            rows.unpersist()
        record = {"format": FORMAT, "batch": number, "watermark": mark, "rows": facts["rows"], "late": facts["late"]}
        Files(spark).write_text(join(self.root, "records", f"{number:012d}.json"), json.dumps(record))

    def _write(self, df: DataFrame, what: str, number: int) -> None:
        df.write.mode("overwrite").parquet(join(self.root, what, f"batch={number}"))

    def _read(self, spark: SparkSession, what: str, number: int, like: DataFrame) -> DataFrame:
        return spark.read.schema(like.schema).parquet(join(self.root, what, f"batch={number}"))

    def _all(self, spark: SparkSession, what: str) -> DataFrame | None:
        last = self.record(spark)
        return spark.read.parquet(join(self.root, what)).where(F.col("batch") <= last["batch"]) if last else None

    def late_rows(self, spark: SparkSession) -> DataFrame | None:
        """The rows that came too late, with their batch; None before the first batch."""
        return self._all(spark, "late")

    def sessions(self, spark: SparkSession, open_too: bool = False) -> DataFrame | None:
        """(by ..., start, end, rows, sums ...) of closed sessions, from the first to the last row; open ones too, as they are now, if asked for."""
        closed = self._all(spark, "closed")
        if closed is None:
            return None
        found = closed.drop("batch")
        if open_too:
            found = found.unionByName(self._read(spark, "open", self.record(spark)["batch"], found))
        return found.select(*self.by, F.timestamp_micros("first").alias("start"), F.timestamp_micros("last").alias("end"), "rows", *self.sums)
