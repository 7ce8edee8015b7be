import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import ordered


def events(rng, n, hot=0.4):
    """(user, time, id): few times, so that many are the same; a hot user; some nulls."""
    users = np.where(rng.random(n) < hot, 0, rng.integers(1, 9, n))
    return [(None if k % 37 == 5 else int(u), None if k % 41 == 7 else int(t), k) for k, (u, t) in enumerate(zip(users, rng.integers(0, 60, n), strict=True))]


def plain_as_of(left, right, back, strict, tolerance):
    out = []
    for u, t, i in left:
        fits = lambda s: (s < t if strict else s <= t) and (tolerance is None or t - tolerance <= s) if back else (s > t if strict else s >= t) and (tolerance is None or s <= t + tolerance)
        found = [(s, j) for v, s, j in right if u is not None and t is not None and v == u and s is not None and fits(s)]
        out.append((i, (max(found) if back else min(found, key=lambda f: (f[0], -f[1])))[1] if found else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("back", "strict", "tolerance"), [(True, False, None), (True, True, 4), (False, False, 9), (False, True, None)])
def test_as_of_join(spark, back, strict, tolerance):
    rng = np.random.default_rng(5)
    left, right = events(rng, 300), events(rng, 200)
    schema = "user int, time int, id int"
    a, b = (spark.createDataFrame(rows, schema).repartition(3) for rows in (left, right))
    for partitions in (1, 11):
        got = ordered.as_of_join(a, b, ["user"], "time", "time", direction="backward" if back else "forward", strict=strict, tolerance=None if tolerance is None else F.lit(tolerance), tie=["id"], partitions=partitions)
        assert got.columns == ["user", "time", "id", "matched"]
        assert sorted(((r["id"], r["matched"]["id"] if r["matched"] else None) for r in got.collect()), key=str) == plain_as_of(left, right, back, strict, tolerance)


def test_as_of_join_cases(spark):
    a = spark.createDataFrame([(1, 5), (1, 5), (None, 5), (2, None), (3, 1)], "k int, t int")
    b = spark.createDataFrame([(1, 5, "x"), (None, 5, "no"), (3, 2, "late")], "k int, t int, matched string")
    whole = ordered.as_of_join(a, b, ["k"], "t", "t")
    assert sorted((r["k"] or 0, r["t"] or 0, r["matched"]["matched"] if r["matched"] else "-") for r in whole.collect()) == [(0, 5, "-"), (1, 5, "x"), (1, 5, "x"), (2, 0, "-"), (3, 1, "-")]
    assert ordered.as_of_join(a, b, ["k"], "t", "t", how="inner").count() == 2
    assert ordered.as_of_join(a, b.limit(0), ["k"], "t", "t").where("matched is null").count() == 5
    assert ordered.as_of_join(a.limit(0), b, ["k"], "t", "t").count() == 0
    with pytest.raises(TypeError):
        ordered.as_of_join(a, b, ["k"], "t", "matched")
    with pytest.raises(ValueError):
        ordered.as_of_join(a, b, ["k"], "t", "t", direction="sideways")


def test_no_partition_holds_a_hot_key(spark):
    df = spark.range(4000).select(F.lit(1).alias("k"), F.col("id"))
    rows = df.select(F.struct(F.col("k").alias("k0")).alias("__key"), F.struct(F.col("id").alias("o0")).alias("__at"), F.lit(0).alias("__tie"))
    placed = ordered._placed(rows, [F.col("__at"), F.col("__tie")], 8)
    sizes = [r["count"] for r in placed.groupBy("__part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000
    heads = ordered._heads(placed, ordered._last_key(placed).groupBy("__part").agg(F.count(F.lit(1)).alias("n")), {"n": F.sum("n")})
    assert sorted(r["n"] for r in heads.collect()) == list(itertools.accumulate(r["count"] for r in placed.groupBy("__part").count().orderBy("__part").collect()))[:-1]


@pytest.mark.parametrize("partitions", [1, 9])
def test_running_and_ranked(spark, partitions):
    rows = events(np.random.default_rng(6), 400)
    df = spark.createDataFrame(rows, "user int, time int, id int").repartition(3)
    made = ordered.running(df, ["user"], ["time", "id"], row_number="n", sums={"s": "id"}, lows={"low": "id"}, highs={"high": "id"}, lags={"before": "id"}, partitions=partitions)
    rank = ordered.ranked(df, ["user"], ["time"], dense_rank="dense", partitions=partitions)
    assert made.columns == ["user", "time", "id", "s", "low", "high", "before", "n"] and rank.columns == ["user", "time", "id", "rank", "dense"]
    got = {r["id"]: tuple(r)[3:] for r in made.collect()}
    ranks = {r["id"]: (r["rank"], r["dense"]) for r in rank.collect()}
    assert len(got) == len(ranks) == 400
    order = lambda t: -1 if t is None else t
    for user in {u for u, *_ in rows}:
        own = sorted((order(t), i) for u, t, i in rows if u == user)
        times = [t for t, _ in own]
        for k, (t, i) in enumerate(own):
            seen = [j for _, j in own[: k + 1]]
            assert got[i] == (sum(seen), min(seen), max(seen), own[k - 1][1] if k else None, k + 1)
            assert ranks[i] == (times.index(t) + 1, len(set(times[: times.index(t) + 1])))


def test_ranks_of_many_equal_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(ordered, "HEAVY", 50)
    df = spark.range(500).select(F.lit(1).alias("k"), (F.col("id") % 2).alias("o"), "id")
    got = ordered.ranked(df, ["k"], ["o"])
    assert {(r["o"], r["rank"], r["count"]) for r in got.groupBy("o", "rank").count().collect()} == {(0, 1, 250), (1, 251, 250)}
    assert ordered.ranked(df.limit(0), ["k"], ["o"]).count() == 0 and ordered.running(df.limit(0), ["k"], ["o"], row_number="n").count() == 0


def spans(rng, n):
    starts, sizes = rng.integers(-50, 400, n), np.where(rng.random(n) < 0.1, rng.integers(0, 500, n), rng.integers(0, 9, n))
    return [(None if k % 29 == 3 else int(rng.integers(0, 3)), int(a), None if k % 31 == 4 else int(a + s), k) for k, (a, s) in enumerate(zip(starts, sizes, strict=True))]


@pytest.mark.parametrize(("closed", "levels", "heavy"), [(False, 12, 100_000), (True, 12, 5), (False, 2, 5), (True, 1, 100_000)])
def test_interval_join(spark, monkeypatch, closed, levels, heavy):
    monkeypatch.setattr(ordered, "HEAVY", heavy)
    rng = np.random.default_rng(7)
    left, right = spans(rng, 150), spans(rng, 120)
    schema = "k int, a int, b int, id int"
    got = ordered.interval_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], ("a", "b"), ("a", "b"), width=4, levels=levels, closed=closed)
    meets = (lambda a, b, c, d: a <= b and c <= d and a <= d and c <= b) if closed else (lambda a, b, c, d: a < b and c < d and a < d and c < b)
    want = sorted((i, j) for k, a, b, i in left for m, c, d, j in right if None not in (k, m, b, d) and k == m and meets(a, b, c, d))
    assert sorted((r["left"]["id"], r["right"]["id"]) for r in got.collect()) == want and want


def test_intervals_of_timestamps_with_themselves(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    df = spark.createDataFrame([("x", at(1), at(4)), ("y", at(3), at(9)), ("z", at(9), at(10))], "id string, a timestamp, b timestamp").withColumn("k", F.lit(1))
    got = ordered.interval_join(df, df, ["k"], ("a", "b"), ("a", "b"), width=86400)
    assert sorted((r["left"]["id"], r["right"]["id"]) for r in got.collect()) == [("x", "x"), ("x", "y"), ("y", "x"), ("y", "y"), ("z", "z")]
    assert ordered.interval_join(df.limit(0), df, ["k"], ("a", "b"), ("a", "b"), width=1).count() == 0


def test_points_are_made_once_and_only_used_columns_are_read(spark, tmp_path):
    at, made = f"file://{tmp_path}/rows", spark.sparkContext.accumulator(0)
    spark.range(60).select((F.col("id") % 3).alias("k"), F.col("id"), (F.col("id") + 3).alias("until"), F.col("id").cast("string").alias("unused")).write.parquet(at)

    def counted(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    rows = spark.read.parquet(at)
    points = rows.mapInPandas(counted, rows.schema)
    got = ordered.interval_join(points, rows, ["k"], ("id", "id"), ("id", "until"), width=3, closed=True).select("left.id", F.col("right.id").alias("other"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((p, i) for p in range(60) for i in range(60) if p % 3 == i % 3 and i <= p <= i + 3)
    assert made.value == 60
    alone = ordered.interval_join(rows, rows, ["k"], ("id", "id"), ("id", "until"), width=3, closed=True).select("left.id", F.col("right.id").alias("other"))
    assert "unused" not in alone._jdf.queryExecution().executedPlan().toString()


def test_cells_that_hold_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(ordered, "HEAVY", 20)
    monkeypatch.setattr(ordered, "CELLS", 2)
    left = spark.range(90).select(F.lit(1).alias("k"), F.col("id").alias("a"), (F.col("id") + 2).alias("b"))
    right = left.unionByName(spark.range(30).select(F.lit(1).alias("k"), F.lit(50).cast("long").alias("a"), (F.col("id") + 51).alias("b")))
    got = ordered.interval_join(left, right, ["k"], ("a", "b"), ("a", "b"), width=4)
    rows = [tuple(r) for r in right.collect()]
    want = sorted((x, x + 2, a, b) for x in range(90) for _, a, b in rows if x < b and a < x + 2)
    assert sorted((r["left"]["a"], r["left"]["b"], r["right"]["a"], r["right"]["b"]) for r in got.collect()) == want
