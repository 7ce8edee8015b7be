"""Operators on keyed frames: DataFrames with a string column `key` that is unique.

All are lazy but for the checks, which are one aggregation each, sorted_keys, which writes its keys, and fan_out and branch, which write their input once. A check runs before anything is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import safe_key
from ..model import CONTENT, KEY, SOURCE, InvalidKeyError, KeyCollisionError, MissingSourceTagError
from ..sources.files import join, shared_dir


@dataclass(frozen=True)
class KeyFacts:
    """What tells one set of keys from another: for each bucket of a hash of the key that has some, how many, and 128 bits that do not depend on their order."""

    rows: int
    of: int
    buckets: dict[int, tuple[int, str]]

    def differing(self, other: KeyFacts) -> list[int]:
        """The buckets that are not the same in both; both are of equally many buckets."""
        return sorted(b for b in self.buckets.keys() | other.buckets.keys() if self.buckets.get(b) != other.buckets.get(b))


def bucket(of: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("bucket"), KEY), F.lit(of)).cast("int")


def _bits(seed: str) -> Column:
    return F.hex(F.coalesce(F.bit_xor(F.xxhash64(F.lit(seed), KEY)), F.lit(0)))


def key_facts(df: DataFrame, of: int = 1, at: str | None = None) -> KeyFacts:
    """The facts of df's keys in `of` buckets, after a check that every key is safe and none occurs twice: one shuffle of the keys.

    With `at`, that shuffle's outcome, (key, bucket, n) with a bucket in one file, is written there.
    """
    if KEY not in df.columns:
        raise InvalidKeyError(f"no column {KEY!r}: {df.columns}")
    keys = df.select(KEY, bucket(of).alias("bucket"))
    each = (keys.repartition("bucket") if at else keys).groupBy("bucket", KEY).agg(F.count(F.lit(1)).alias("n"))
    if at:
        each.sortWithinPartitions("bucket").write.parquet(at)
        each = df.sparkSession.read.schema(each.schema).parquet(at)
    bad = ~safe_key(F.col(KEY))
    per = each.groupBy("bucket").agg(
        F.sum("n").alias("rows"),
        F.concat_ws("-", _bits("a"), _bits("b")).alias("bits"),
        F.sum(bad.cast("long")).alias("bad"),
        F.min(F.when(F.col("n") > 1, F.col(KEY))).alias("twice"),
        F.min(F.when(bad, F.coalesce(KEY, F.lit("<null>")))).alias("unsafe"),
    )
    facts = per.collect()  # `of` rows at most
    if number := sum(r["bad"] for r in facts):
        raise InvalidKeyError(f"{number} unsafe keys, such as {min(r['unsafe'] for r in facts if r['unsafe'] is not None)!r}")
    if twice := [r["twice"] for r in facts if r["twice"] is not None]:
        raise KeyCollisionError(f"key {min(twice)!r} occurs more than once")
    return KeyFacts(sum(r["rows"] for r in facts), of, {r["bucket"]: (r["rows"], r["bits"]) for r in facts})


def bucket_facts(df: DataFrame, of: int) -> KeyFacts:
    """The facts of df's keys without a check, and without a shuffle of keys; a key that is there twice shows in the number of its bucket."""
    per = df.groupBy(bucket(of).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"), F.concat_ws("-", _bits("a"), _bits("b")).alias("bits")).collect()  # `of` rows at most
    return KeyFacts(sum(r["rows"] for r in per), of, {r["bucket"]: (r["rows"], r["bits"]) for r in per})


def missing_and_extra(there: DataFrame, expected: DataFrame) -> DataFrame:
    """(key, missing boolean): the keys that only one side has; missing are those not there."""
    only = lambda a, b, flag: a.select(KEY).join(b.select(KEY), KEY, "left_anti").select(KEY, F.lit(flag).alias("missing"))
    return only(expected, there, True).unionByName(only(there, expected, False))


def check_keys(df: DataFrame) -> int:
    """The number of rows, after a check that every key is safe and none occurs twice."""
    return key_facts(df).rows


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """(rows, 128 bits that tell one set of keys from another, in whatever order): one aggregation without a shuffle of keys."""
    got = df.agg(F.count(F.lit(1)).alias("n"), F.concat_ws("-", _bits("a"), _bits("b")).alias("keys")).first()
    return got["n"], got["keys"]


def tagged(df: DataFrame, source: str) -> DataFrame:
    """The frame with its source in `__source__`."""
    return df.withColumn(SOURCE, F.lit(source))


def wrapped(df: DataFrame, value: str = "value") -> DataFrame:
    """Bare values as records: the column `value` becomes `content`."""
    return df.withColumnRenamed(value, CONTENT)


def collisions(frames: Mapping[str, DataFrame]) -> DataFrame:
    """(key, n, existing, incoming) of the keys that more than one of the named frames have; names by order of the mapping."""
    order = {name: k for k, name in enumerate(frames)}
    keys = reduce(DataFrame.unionByName, [df.select(KEY, F.lit(order[n]).alias("o"), F.lit(n).alias("s")) for n, df in frames.items()])
    met = keys.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("o", "s")).alias("a"), F.max(F.struct("o", "s")).alias("b"))
    return met.where("n > 1").select(KEY, "n", F.col("a.s").alias("existing"), F.col("b.s").alias("incoming"))


def _joined(frames: Mapping[str, DataFrame], what: str, check: bool) -> DataFrame:
    if check and len(frames) > 1 and (hit := collisions(frames).orderBy(KEY).first()):
        raise KeyCollisionError(f"{what}s {hit['existing']!r} and {hit['incoming']!r} both give the key {hit[KEY]!r}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames.values())


def union_sources(frames: Mapping[str, DataFrame], check: bool = True) -> DataFrame:
    """All sources in one frame, each record tagged; columns that a source lacks are null. A key of two sources is an error."""
    return _joined({name: tagged(df, name) for name, df in frames.items()}, "source", check)


def strip_source(df: DataFrame) -> DataFrame:
    return df.drop(SOURCE)


def route_column(df: DataFrame, by: str | Column, routes: list[str], name: str) -> Column:
    """The route of each record: its source, or the value of a string column; a record without a declared route fails the query."""
    if isinstance(by, str) and by == "source":
        if SOURCE not in df.columns:
            raise MissingSourceTagError(f"branch {name!r} routes by source, but records have no {SOURCE}")
        route = F.col(SOURCE)
    elif isinstance(by, Column):
        route = by
        kind = df.select(route.alias("r")).schema["r"].dataType.simpleString()
        if kind != "string":
            raise TypeError(f"branch {name!r} routes by a {kind}, not by a string")
    else:
        raise TypeError(f"branch {name!r} routes by 'source' or a column, not {type(by).__name__}")
    return F.when(route.isin(*routes), route).otherwise(F.raise_error(F.concat(F.lit(f"branch {name!r} has no route for "), F.coalesce(route, F.lit("a null")))))


def split_routes(df: DataFrame, by: str | Column, routes: list[str], name: str = "branch") -> dict[str, DataFrame]:
    """One lazy frame for each route, in order; together they hold every record once. Each reads df by itself; fan_out reads it once for all.

    The route is computed inside a filter, so that an undeclared one cannot be optimized away.
    """
    route = route_column(df, by, routes, name)
    return {r: df.where(route == r) for r in routes}


def fan_out(df: DataFrame, by: str | Column, routes: list[str], name: str = "branch", at: str | None = None) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """(a frame, a number of records) for each route, in order. df is read once: it is written, with a folder for each route (to `at`, else in the shared folder).

    A record without a declared route fails that write.
    """
    spark, at = df.sparkSession, at or join(shared_dir(df.sparkSession), f"fan-{uuid.uuid4().hex}")
    number = (F.array_position(F.array(*[F.lit(r) for r in routes]), route_column(df, by, routes, name)) - 1).cast("int")
    mark = "__route"
    while mark in df.columns:
        mark += "_"
    void = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)}  # not to be had in files
    seen = Observation()
    marked = df.drop(*void).withColumn(mark, number)
    marked.observe(seen, *[F.count_if(F.col(mark) == k).alias(f"r{k}") for k in range(len(routes))]).write.partitionBy(mark).parquet(at)
    counts = {r: seen.get[f"r{k}"] for k, r in enumerate(routes)}
    kept = T.StructType([f for f in df.schema.fields if f.name not in void])
    whole = [F.lit(None).alias(c) if c in void else F.col(f"`{c}`") for c in df.columns]
    reader = spark.read.schema(kept)
    parts = {r: (reader.parquet(f"{at}/{mark}={k}") if counts[r] else spark.createDataFrame([], kept)).select(*whole) for k, r in enumerate(routes)}
    return parts, counts


def merge_routes(frames: Mapping[str, DataFrame], check: bool = True) -> DataFrame:
    """The outputs of routes in one frame; a key of two routes is an error that names both."""
    return _joined(frames, "route", check)


def branch(df: DataFrame, by: str | Column, routes: Mapping[str, Callable[[DataFrame], DataFrame] | None], name: str = "branch", check: bool = True) -> DataFrame:
    """Fan out, apply each route's function (None: pass through) and merge."""
    parts, _ = fan_out(df, by, list(routes), name)
    return merge_routes({r: fn(parts[r]) if fn else parts[r] for r, fn in routes.items()}, check)


def rekey(df: DataFrame, key: Column, origin: str | None = None) -> DataFrame:
    """New keys; the old one is kept in the column `origin` if named. Of records with one new key, the last by old key stays."""
    fresh = df.withColumnRenamed(KEY, "__old").withColumn("__new", key)
    rest = [c for c in df.columns if c != KEY]
    best = fresh.groupBy("__new").agg(F.max_by(F.struct("__old", *rest), "__old").alias("r"))  # taken before the shuffle, so hot keys stay light
    kept = [F.col("r")["__old"].alias(origin)] if origin else []
    return best.select(F.col("__new").alias(KEY), *kept, *[F.col("r")[c].alias(c) for c in rest])


def last_wins(df: DataFrame, key: Column, order: Column) -> DataFrame:
    """One record for each key: the one of highest order. The maximum is taken before the shuffle, so hot keys stay light."""
    row = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(key.alias("__key")).agg(F.max_by(row, order).alias("r"))
    return best.select(F.col("__key").alias(KEY), *[F.col("r")[c].alias(c) for c in df.columns if c != KEY])


def count_by_domain(df: DataFrame, column: str, domain: list[str], check: bool = True) -> DataFrame:
    """(column, n) for every value of the domain, 0 where there are no records; other values are an error."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if check and (odd := counts.where(F.col(column).isNull() | ~F.col(column).isin(*domain)).first()):
        raise ValueError(f"unexpected {column} {odd[column]!r}")
    values = df.sparkSession.createDataFrame([(v,) for v in domain], f"`{column}` string")
    return values.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def with_defaults(df: DataFrame, required: list[str], defaults: Mapping[str, object]) -> DataFrame:
    """Required columns must be there; optional ones are filled in where they lack or are null."""
    if lacking := [c for c in required if c not in df.columns]:
        raise ValueError(f"required columns are missing: {lacking}")
    for c, v in defaults.items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v))
    return df


def summary_of_records(df: DataFrame, mode: str | None = None, **totals: Column) -> DataFrame:
    """summary() with the records themselves as a map from key to struct, in the order of keys, and with `mode` if given. For frames whose records fit a row."""
    rest = F.struct(*[c for c in df.columns if c != KEY])
    records = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(KEY), rest)))).alias("records")
    out = df.agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list(KEY)).alias("ids"), *[c.alias(n) for n, c in totals.items()], records)
    return out if mode is None else out.withColumn("mode", F.lit(mode))


def summary(df: DataFrame, **totals: Column) -> DataFrame:
    """One row: count, the sorted keys, and the named aggregates. For frames whose keys fit a row; sorted_keys() gives them as rows."""
    keys = [F.array_sort(F.collect_list(KEY)).alias("ids")] if KEY in df.columns else []
    return df.agg(F.count(F.lit(1)).alias("count"), *keys, *[c.alias(n) for n, c in totals.items()])


def sorted_keys(df: DataFrame, at: str | None = None) -> DataFrame:
    """(key, position from 0) in ascending order of any number of keys: by a range shuffle and the counts of its partitions.

    The sorted keys are written with their numbers (to `at`, else in the shared folder), so that counts and positions are of one and the same
    partitioning, whatever is computed again.
    """
    spark, at = df.sparkSession, at or join(shared_dir(df.sparkSession), f"sorted-{uuid.uuid4().hex}")
    df.select(KEY).repartitionByRange(KEY).sortWithinPartitions(KEY).withColumn("__at", F.monotonically_increasing_id()).write.parquet(at)
    spread = spark.read.schema(f"`{KEY}` string, __at long").parquet(at).withColumn("__part", F.shiftright("__at", 33))
    counts = spread.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = spread.join(F.broadcast(counts.select("__part", before.alias("__before"))), "__part")
    return placed.select(KEY, (F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).alias("position"))


def with_context(df: DataFrame, **labels: str) -> DataFrame:
    """Constant columns, such as tenant, job or run."""
    return df.withColumns({n: F.lit(v) for n, v in labels.items()})
