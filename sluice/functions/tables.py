"""Table functions whose columns depend on their arguments: to be used lateral, on a whole table, or as the function of a step.

Spark asks such a function for its columns before it runs (analyze), and for tables also for the partitioning and order that it wants; its rows then stream
through one instance for each partition, which keeps no more than the row before.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


def _constant(argument: AnalyzeArgument, what: str) -> str:
    if not argument.isConstantExpression or not isinstance(argument.value, str) or not argument.value:
        raise ValueError(f"{what} is a constant text")
    return argument.value


class _Stretches:
    """stretches(text, start, end, name): each part of a text between marks, from left to right, as (position from 0, <name>)."""

    @staticmethod
    def analyze(text: AnalyzeArgument, start: AnalyzeArgument, end: AnalyzeArgument, name: AnalyzeArgument) -> AnalyzeResult:
        _constant(start, "the first mark"), _constant(end, "the second mark")
        return AnalyzeResult(T.StructType([T.StructField("position", T.IntegerType()), T.StructField(_constant(name, "the name of the column"), T.StringType())]))

    def eval(self, text: str | None, start: str, end: str, name: str) -> Iterator[tuple]:
        at, k = 0, 0
        while text and (a := text.find(start, at)) >= 0 and (b := text.find(end, a + len(start))) >= 0:
            yield k, text[a + len(start) : b]
            at, k = b + len(end), k + 1


class _Steps:
    """steps(TABLE(t), key, order, value, name): all columns of t and, as <name>, by how much the value differs from that of the row before of its key; null for the first, or if either is null."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, order: AnalyzeArgument, value: AnalyzeArgument, name: AnalyzeArgument) -> AnalyzeResult:
        columns, own = rows.dataType, _constant(value, "the value")
        by = [_constant(key, "the key"), *_constant(order, "the order").split(",")]
        lacking = [c for c in (own, *by) if c not in columns.names]
        if lacking:
            raise ValueError(f"the table has no {', '.join(lacking)}")
        kind = T.LongType() if isinstance(columns[own].dataType, T.IntegralType) else T.DoubleType()
        made = T.StructType([*columns.fields, T.StructField(_constant(name, "the name of the column"), kind)])
        return AnalyzeResult(made, partitionBy=[PartitioningColumn(by[0])], orderBy=[OrderingColumn(c) for c in by[1:]])

    def __init__(self) -> None:
        self.before: Any = None

    def eval(self, row: Any, key: str, order: str, value: str, name: str) -> Iterator[tuple]:
        now = row[value]
        yield (*row, None if now is None or self.before is None else now - self.before)
        self.before = now


stretches, steps = F.udtf(_Stretches), F.udtf(_Steps)


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL as stretches and steps."""
    spark.udtf.register("stretches", stretches)
    spark.udtf.register("steps", steps)


def with_stretches(df: DataFrame, text: str, start: str, end: str, name: str) -> DataFrame:
    """df with a row for each part of a text between marks: its position and itself; rows without one are gone."""
    return df.lateralJoin(stretches(F.col(text).outer(), F.lit(start), F.lit(end), F.lit(name)))


def with_steps(df: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """df with the difference to the row before of its key. All rows of a key go to one task, one after another; for keys larger than that see ordered.running."""
    return steps(df.asTable(), F.lit(key), F.lit(",".join(order)), F.lit(value), F.lit(name))
