"""Helpers that the operators share: scratch tables in the shared folder, free column names, bounded broadcasts."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_dir

#: A side of a join is broadcast only when its counted rows, at this many bytes each, stay below BROADCAST_BYTES.
BROADCAST_BYTES = 64 << 20
#: Batches that go to Python while a table is staged; a task holds a few of them at a time.
BATCH_BYTES = "8m"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters between the words of the decontamination contract, once A-Z are lower-cased.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: The folder of the scratch() block that is being run.
_FOLDER: ContextVar[str | None] = ContextVar("sluice_scratch", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_FOLDER.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession, name: str = "scratch"):
    """All tables that operators stage within the block go to one folder of the shared one, which is removed at its end.

    A result that an operator returns within the block reads those tables, so it is to be written or counted there too.
    """
    at = scratch_path(spark, name)
    before = _FOLDER.set(at)
    try:
        yield at
    finally:
        _FOLDER.reset(before)
        remove(spark, at)


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """One session setting for the length of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, and its shuffle files go at once.

    The table survives lost executors. Its folder goes with the scratch() block it is made in; drop() removes it before.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"), setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sluice_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes the folders of staged tables."""
    for df in tables:
        remove(df.sparkSession, df._sluice_path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def bounded_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted size is proven small; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def ascii_words(text):
    """Column: array of words [0-9a-z and above 0x7F]+ after lower-casing A-Z; null text has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def steps(texts: list[str | None], chars: int):
    """Slices of texts of about so many characters together, at least one text each."""
    first = total = 0
    for k, t in enumerate(texts):
        size = len(t or "")
        if k > first and total + size > chars:
            yield texts[first:k]
            first, total = k, 0
        total += size
    if texts[first:]:
        yield texts[first:]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
