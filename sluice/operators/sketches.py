"""Counts of distinct values and quantiles by sketches: made once at the finest grouping, kept, and merged for any coarser one without the rows.

A HyperLogLog sketch of 2 ** LG values is off by 1.04 / sqrt(2 ** LG) as a standard error (1.6 % at 12); a KLL sketch of K answers a quantile by a value whose rank is off by about
1.7 % of the rows at K = 200. Both are of a fixed size, so a group's row is small however many rows it stands for. Merging takes the same error, not the sum
of errors. Nulls are not counted. Sketches of a run's step can be taken while it is written (see ParquetDataset.metrics).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG, K = 12, 200


def distinct_sketch(column: str | Column, lg: int = LG) -> Column:
    """An aggregate: the sketch of a column's distinct values."""
    return F.hll_sketch_agg(column, lg)


def quantile_sketch(column: str | Column, k: int = K) -> Column:
    """An aggregate: the sketch of a column's values, as doubles."""
    return F.kll_sketch_agg_double(F.col(column).cast("double") if isinstance(column, str) else column.cast("double"), k)


def sketched(df: DataFrame, by: Sequence[str | Column], distinct: dict[str, str] | None = None, quantiles: dict[str, str] | None = None, sums: dict[str, str] | None = None) -> DataFrame:
    """A row for each group: by, n, sums, and the sketches of the named columns as d_<name> and q_<name>. Groups are put together before the shuffle."""
    made = [F.sum(c).alias(n) for n, c in (sums or {}).items()]
    made += [distinct_sketch(c).alias(f"d_{n}") for n, c in (distinct or {}).items()] + [quantile_sketch(c).alias(f"q_{n}") for n, c in (quantiles or {}).items()]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *made)


def _merged(rows: DataFrame, by: Sequence[str]) -> list[Column]:
    kinds = {f.name: f.dataType for f in rows.schema.fields if f.name not in by}
    merge = lambda n: F.hll_union_agg(n) if n.startswith("d_") else F.kll_merge_agg_double(n) if n.startswith("q_") else F.sum(n).cast(kinds[n])
    return [merge(n).alias(n) for n in kinds]


def merged(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of sketched() put together by fewer columns; they may come from several frames, united."""
    whole = _merged(rows, rows.columns[: rows.columns.index("n")])
    return rows.groupBy(*by).agg(*whole)


def rolled(rows: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Rows of sketched() by each of several groupings at once; columns that a row is not grouped by are null, and `grouping` has a bit for each of these."""
    by = rows.columns[: rows.columns.index("n")]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *by)
    return grouped.agg(F.grouping_id().alias("grouping"), *_merged(rows, by))


def answers(rows: DataFrame, at: Sequence[float] = (0.5,)) -> DataFrame:
    """The sketches of rows turned into estimates: d_<name> into a number, q_<name> into an array of the quantiles `at`."""
    points = F.array(*[F.lit(float(p)) for p in at])
    told = {c: F.hll_sketch_estimate(c) if c.startswith("d_") else F.kll_sketch_get_quantile_double(c, points) for c in rows.columns if c.startswith(("d_", "q_"))}
    return rows.select(*[told[c].alias(c) if c in told else F.col(c) for c in rows.columns])
