"""Operators on rows in the order of a time (or any column) within keys, for keys of any size: as-of joins, running windows, interval joins.

Spark's windows bring all rows of a key to one task. Here rows are range partitioned by (key, order), so that a hot key lies in as many partitions as
it fills, and written once, which fixes the partitions. A window then runs within each partition and key, and what a key had before the partition comes in as one more
row at its head. These rows come from one row for each partition, its last key's end, put together in the order of partitions; so
what is seen in one place grows with the number of partitions, not of rows.

Keys may be null, and null is a key like any other, but for joins, where it matches nothing. Rows whose order is null come first, and match nothing in joins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import join, shared_dir

#: A (key, bucket) of more interval rows than this is dealt over parts.
HEAVY = 100_000
#: Each level's buckets are so many times as wide as those of the level below.
STEP = 4
#: Buckets of interval rows are first counted by so many hashes.
CELLS = 1 << 16

_KEY, _AT, _SIDE, _TIE, _PART, _HEAD = "__key", "__at", "__side", "__tie", "__part", "__head"


def _written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back."""
    spark = df.sparkSession
    at = join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def _placed(df: DataFrame, order: list[Column], partitions: int | None) -> DataFrame:
    """df in ranges of (key, order), with the number of its partition in __part; written, so that it stays there."""
    by = [F.col(_KEY), *order]
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    return _written(ranged.withColumn(_PART, F.spark_partition_id()), "ranges")


def _heads(placed: DataFrame, ends: DataFrame, carried: dict[str, Column]) -> DataFrame:
    """(__part, __key, carried ...): for each partition that begins with a key that went on before it, what that key brings along.

    ends has (__part, ...) of the rows of each partition's last key, aggregated; carried says how a column adds up over such ends, as
    an aggregate to be taken over a window.
    """
    borders = placed.groupBy(_PART).agg(F.min(F.struct(_KEY)).alias("first"), F.max(F.struct(_KEY)).alias("last"))
    rows = borders.join(ends, _PART, "left")  # a row for each partition
    before = Window.partitionBy("last").orderBy(_PART).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select(_PART, "first", "last", *[c.over(before).alias(n) for n, c in carried.items()])
    by_part = Window.orderBy(_PART)
    back = summed.select(_PART, "first", F.lag("last").over(by_part).alias("went"), *[F.lag(n).over(by_part).alias(n) for n in carried])
    return back.where(F.col("first").eqNullSafe(F.col("went"))).select(_PART, F.col(f"first.{_KEY}").alias(_KEY), *carried)


def _last_key(placed: DataFrame) -> DataFrame:
    """The rows of each partition's last key."""
    last = placed.groupBy(_PART).agg(F.max(F.struct(_KEY)).alias("last"))
    return placed.join(F.broadcast(last), _PART).where(F.struct(_KEY).eqNullSafe(F.col("last")))  # a row for each partition


def as_of_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_time: str,
    right_time: str,
    direction: str = "backward",
    strict: bool = False,
    tolerance: Column | None = None,
    tie: list[str] | None = None,
    how: str = "left",
    out_col: str = "matched",
    partitions: int | None = None,
) -> DataFrame:
    """Each left row with the struct of the latest right row of its key at or before its time (`strict`: before it), in out_col.

    direction `forward`: the earliest at or after it. tolerance is an interval that the two may be apart. Of right rows of one key and time the last by the
    columns `tie` counts (by a hash of the row, if not given). how `inner` leaves out rows without a match. Left rows stay as they are, repeated ones
    too. Both times must be of one type.
    """
    if direction not in ("backward", "forward") or how not in ("left", "inner"):
        raise ValueError(f"direction is backward or forward, how is left or inner, not {direction!r} and {how!r}")
    if left.schema[left_time].dataType != right.schema[right_time].dataType:
        raise TypeError(f"times of two types: {left.schema[left_time].dataType.simpleString()} and {right.schema[right_time].dataType.simpleString()}")
    whole = lambda df: F.struct(*[F.col(f"`{c}`") for c in df.columns])
    key = F.struct(*[F.col(c).alias(f"k{k}") for k, c in enumerate(on)])
    usable = lambda df, time: [F.col(c).isNotNull() for c in (*on, time)]
    every = lambda cs: F.when(_all(cs), True).otherwise(False)
    back = direction == "backward"
    # at one time, right rows stand before left ones, unless equal times do not count
    first = 1 if strict else -1
    right_tie = F.struct(*tie) if tie else F.xxhash64(whole(right))
    l = left.where(every(usable(left, left_time))).select(key.alias(_KEY), F.col(left_time).alias(_AT), F.lit(0).alias(_SIDE), whole(left).alias("l"))  # noqa: E741
    r = right.where(every(usable(right, right_time))).select(key.alias(_KEY), F.col(right_time).alias(_AT), F.lit(first).alias(_SIDE), right_tie.alias(_TIE), whole(right).alias("r"))
    both = l.unionByName(r, allowMissingColumns=True)
    time = F.col(_AT) if back else F.col(_AT).desc()
    # left rows of one time may lie apart, which their hash sees to
    order = [time, F.col(_SIDE), F.col(_TIE), F.xxhash64("l")]
    placed = _placed(both, order, partitions)
    nearest = F.max_by if back else F.min_by
    ends = _last_key(placed).where(F.col("r").isNotNull()).groupBy(_PART, _AT).agg(F.max_by("r", _TIE).alias("r")).groupBy(_PART).agg(nearest("r", _AT).alias("r"))
    heads = _heads(placed, ends, {"r": F.last("r", ignorenulls=True)}).where(F.col("r").isNotNull()).withColumn(_HEAD, F.lit(0))
    rows = placed.withColumn(_HEAD, F.lit(1)).unionByName(heads, allowMissingColumns=True)
    window = Window.partitionBy(_PART, _KEY).orderBy(_HEAD, *order[:3]).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("r", F.last("r", ignorenulls=True).over(window)).where(F.col("l").isNotNull())
    if tolerance is not None:
        apart = F.col(_AT) - tolerance <= F.col("r")[right_time] if back else F.col("r")[right_time] <= F.col(_AT) + tolerance
        found = found.withColumn("r", F.when(apart, F.col("r")))
    out = found.select(*[F.col("l")[c].alias(c) for c in left.columns if c != out_col], F.col("r").alias(out_col))
    if how == "inner":
        return out.where(F.col(out_col).isNotNull())
    alone = left.where(~every(usable(left, left_time))).drop(out_col).withColumn(out_col, F.lit(None).cast(out.schema[out_col].dataType))
    return out.unionByName(alone)


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    row_number: str | None = None,
    sums: dict[str, str] | None = None,
    lows: dict[str, str] | None = None,
    highs: dict[str, str] | None = None,
    lags: dict[str, str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """df with running values within keys, in ascending order, from a key's first row to each row.

    row_number names a column; sums, lows, highs (of the values so far) and lags (the value of the row before) map new columns to those they are of. Rows that are equal in
    `order` follow each other by a hash of the whole row. Sums are of the type that Spark's sum gives.
    """
    sums, lows, highs, lags = sums or {}, lows or {}, highs or {}, lags or {}
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.select(F.struct(*[F.col(c).alias(f"k{k}") for k, c in enumerate(keys)]).alias(_KEY), F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)]).alias(_AT), F.xxhash64(whole).alias(_TIE), whole.alias("row"))
    by = [F.col(_AT), F.col(_TIE)]
    placed = _placed(rows, by, partitions)
    of = lambda c: F.col("row")[c]
    aggregates = {"n": F.count(F.lit(1))} | {f"s_{k}": F.sum(of(c)) for k, c in enumerate(sums.values())}
    aggregates |= {f"l_{k}": F.min(of(c)) for k, c in enumerate(lows.values())} | {f"h_{k}": F.max(of(c)) for k, c in enumerate(highs.values())}
    aggregates |= {f"g_{k}": F.max_by(F.struct(of(c)), F.struct(_AT, _TIE)) for k, c in enumerate(lags.values())}
    ends = _last_key(placed).groupBy(_PART).agg(*[a.alias(n) for n, a in aggregates.items()])
    add = {"n": F.sum, "s": F.sum, "l": F.min, "h": F.max, "g": F.last}
    heads = _heads(placed, ends, {n: add[n[0]](n) for n in aggregates})
    # as values of one more row at the head of its partition
    own = {"n": F.lit(1).cast("long")} | {f"s_{k}": of(c) for k, c in enumerate(sums.values())} | {f"l_{k}": of(c) for k, c in enumerate(lows.values())}
    own |= {f"h_{k}": of(c) for k, c in enumerate(highs.values())} | {f"g_{k}": F.struct(of(c)) for k, c in enumerate(lags.values())}
    types = {n: heads.schema[n].dataType for n in aggregates}
    values = placed.select(_PART, _KEY, _AT, _TIE, "row", *[c.cast(types[n]).alias(n) for n, c in own.items()])
    every = values.withColumn(_HEAD, F.lit(1)).unionByName(heads.withColumn(_HEAD, F.lit(0)), allowMissingColumns=True)
    ordered = Window.partitionBy(_PART, _KEY).orderBy(_HEAD, *by)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    names = {f"s_{k}": n for k, n in enumerate(sums)} | {f"l_{k}": n for k, n in enumerate(lows)} | {f"h_{k}": n for k, n in enumerate(highs)} | {f"g_{k}": n for k, n in enumerate(lags)}
    names |= {"n": row_number} if row_number else {}
    made = [(F.lag(n).over(ordered)[types[n][0].name] if n[0] == "g" else add[n[0]](n).over(so_far)).alias(to) for n, to in names.items()]
    done = every.select(_HEAD, "row", *made).where(F.col(_HEAD) == 1)
    return done.select(*[of(c).alias(c) for c in df.columns if c not in names.values()], *names.values())


def ranked(df: DataFrame, keys: list[str], order: list[str], rank: str = "rank", dense_rank: str | None = None, partitions: int | None = None) -> DataFrame:
    """df with the rank of each row within its key (rows that are equal in order share one), and the dense rank if named.

    Equal rows are counted before any shuffle, the counts are added up as in running(), and each row looks its rank up. Rows of one key and order that are many are dealt over tasks.
    """
    names = [f"__k{k}" for k in range(len(keys) + len(order))]
    marked = df.withColumns({n: F.col(c) for n, c in zip(names, [*keys, *order], strict=True)})
    counts = marked.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    placed = running(counts, names[: len(keys)], names[len(keys) :], row_number="__dense", sums={"__upto": "__n"}, partitions=partitions)
    spots = placed.select(*names, "__n", (F.col("__upto") - F.col("__n") + 1).alias(rank), *([F.col("__dense").alias(dense_rank)] if dense_rank else []))
    joined = _dealt(marked.withColumn("__node", F.struct(*names)).drop(*names), _written(spots, "ranks"), names)
    return joined.select(*[c for c in df.columns if c not in (rank, dense_rank)], rank, *([dense_rank] if dense_rank else []))


def _dealt(rows: DataFrame, table: DataFrame, names: list[str]) -> DataFrame:
    """rows, with a struct __node, joined to table, one row a node with its count __n; the rows of a large node are dealt over parts, each with a copy."""
    table = table.withColumn("__node", F.struct(*names)).drop(*names)
    large = table.where(F.col("__n") > HEAVY).select(F.col("__node").alias("__large"), F.ceil(F.col("__n") / HEAVY).alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1)).cast("long")
    hot = F.broadcast(large) if large.count() * 256 < 64 << 20 else large  # counted; as few as nodes of over HEAVY rows are
    own = [F.col(f"`{c}`") for c in rows.columns if c != "__node"]
    dealt = rows.join(hot, rows["__node"].eqNullSafe(hot["__large"]), "left").withColumn("__deal", F.pmod(F.xxhash64(*own), parts))
    copies = table.join(hot, table["__node"].eqNullSafe(hot["__large"]), "left").withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).withColumnRenamed("__node", "__spot").drop("__parts", "__large")
    return dealt.join(copies, dealt["__node"].eqNullSafe(copies["__spot"]) & (dealt["__deal"] == copies["__copy"]))


def interval_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: float, levels: int = 12, closed: bool = False) -> DataFrame:
    """(left, right) structs of all pairs of one key whose half-open spans [start, end) overlap; with `closed`, spans that share an end do too.

    Spans are numbers or timestamps (in seconds, for the width). A span's level is the first whose buckets are as wide as it is: `width` at level 0, STEP times wider at each; the last takes all
    longer ones. Two spans meet at the higher of their levels, where each touches few buckets, in the bucket in which the later one starts, so each pair
    comes once. A key's rows are thus spread over its buckets; (key, bucket)s of over HEAVY right rows are dealt over parts. An empty span (start >= end, unless closed and equal) and one with a null overlap nothing.

    The left frame is read once for its levels, unless its spans are points (one column named twice), and once for the join; the right one once more, for the sizes of buckets. Write frames that are
    costly to make before. Only the columns that are used of the pairs are shuffled, once each.
    """
    if width <= 0 or not 1 <= levels <= 30:
        raise ValueError("width is above 0 and levels are 1 to 30")
    spark = left.sparkSession
    a, b = _Spans(left, "__x", on, left_span, width, levels, closed), _Spans(right, "__y", on, right_span, width, levels, closed)
    met, other = a.bucketed(b.found), b.bucketed(a.found)
    met, other, dealt = _spread(spark, met, other, a.place, b.place)
    pairs = met.join(other, _all([F.col(x) == F.col(y) for x, y in [*zip(a.place, b.place, strict=True), *dealt]]))
    start = F.greatest(a.start, b.start)
    overlap = (a.start <= b.end) & (b.start <= a.end) if closed else (a.start < b.end) & (b.start < a.end)
    once = (F.col("__x_on") == F.greatest(a.level, b.level)) & (_number(start, F.col("__x_on"), width) == F.col("__x_bucket"))
    return pairs.where(overlap & once).select(a.row.alias("left"), b.row.alias("right"))


def _number(at: Column, level: Column, width: float) -> Column:
    """The bucket of a place."""
    return F.floor(at / (F.lit(float(width)) * F.pow(F.lit(float(STEP)), level)))


class _Spans:
    """The rows of one side that may overlap anything, their columns under names of their own; start, end, level and row are expressions over these, so that none is shuffled beside its column."""

    def __init__(self, df: DataFrame, side: str, on: list[str], span: tuple[str, str], width: float, levels: int, closed: bool) -> None:
        names = {c: f"{side}{k}" for k, c in enumerate(df.columns)}

        def number(column: str) -> Column:
            kind, at = df.schema[column].dataType.simpleString(), F.col(names[column])
            return at.cast("timestamp").cast("double") if kind in ("timestamp", "timestamp_ntz", "date") else at.cast("double")

        self.side, self.width, self.point = side, width, span[0] == span[1]
        self.start, self.end = number(span[0]), number(span[1])
        steps = F.ceil(F.log(float(STEP), F.greatest((self.end - self.start) / F.lit(float(width)), F.lit(1.0))))
        self.level = F.lit(0) if self.point else F.least(F.greatest(steps, F.lit(0)), F.lit(levels - 1)).cast("int")
        self.row = F.struct(*[F.col(n).alias(c) for c, n in names.items()])
        self.place = [*[names[c] for c in on], f"{side}_on", f"{side}_bucket"]
        some = self.start <= self.end if closed else self.start < self.end
        self.rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).where(_all([F.col(names[c]).isNotNull() for c in on]) & some)
        #: The levels that there are, `levels` at most; points are all at the lowest.
        self.found = [0] if self.point else [r[0] for r in self.rows.select(self.level).distinct().collect()]

    def bucketed(self, others: list[int]) -> DataFrame:
        """Each span once for each bucket that it touches at its own level and at those above that the other side has; a few, but for the last level."""
        on, bucket = self.place[-2:]
        above = [x for x in sorted(others) if x > min(self.found, default=0)]
        if above:
            higher = F.filter(F.array(*[F.lit(x) for x in above]).cast("array<int>"), lambda x: x > self.level)
            spans = self.rows.withColumn(on, F.explode(F.concat(F.array(self.level), higher)))
        else:
            spans = self.rows.withColumn(on, F.lit(self.found[0]) if len(self.found) == 1 else self.level)
        first, last = (_number(at, F.col(on), self.width) for at in (self.start, self.end))
        return spans.withColumn(bucket, first if self.point else F.explode(F.sequence(first, last)))


def _spread(spark: SparkSession, met: DataFrame, other: DataFrame, left: list[str], right: list[str]) -> tuple[DataFrame, DataFrame, list[tuple[str, str]]]:
    """Both sides, with columns to be equal too: the right rows of a large bucket are dealt over parts by a hash, and each left row goes to all of its bucket's parts.

    Buckets are counted by CELLS hashes, which tasks add up before the shuffle, and one by one only in cells of over HEAVY rows, as a large bucket's is.
    """
    cell = F.pmod(F.xxhash64(*right), F.lit(CELLS)).alias("cell")
    cells = _written(other.groupBy(cell).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HEAVY).select("cell"), "cells")
    if cells.isEmpty():
        return met, other, []
    counted = other.select(*right, cell).join(F.broadcast(cells), "cell").groupBy(*right).agg(F.count(F.lit(1)).alias("__n"))
    sizes = _written(counted.where(F.col("__n") > HEAVY).select(*[F.col(c).alias(f"__p{k}") for k, c in enumerate(right)], "__n"), "sizes")
    large = F.broadcast(sizes) if sizes.count() * 256 < 64 << 20 else sizes
    at = lambda place: _all([F.col(c) == F.col(f"__p{k}") for k, c in enumerate(place)])
    parts = F.coalesce(F.ceil(F.col("__n") / HEAVY), F.lit(1)).cast("long")
    dealt = other.join(large, at(right), "left").select(*other.columns, F.pmod(F.xxhash64(*other.columns), parts).alias("__y_deal"))
    copied = met.join(large, at(left), "left").select(*met.columns, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("__x_deal"))
    return copied, dealt, [("__x_deal", "__y_deal")]
