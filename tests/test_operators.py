import pytest
from pyspark.sql import functions as F

from sluice.functions.keys import between, safe_key
from sluice.model import InvalidKeyError, KeyCollisionError, MissingSourceTagError
from sluice.operators import keyed


def frame(spark, rows, schema="key string, value long"):
    return spark.createDataFrame(rows, schema)


def test_keys_are_checked_in_one_go(spark):
    assert keyed.check_keys(frame(spark, [("a", 1), ("b/c", 2)])) == 2
    assert keyed.check_keys(frame(spark, [])) == 0
    with pytest.raises(KeyCollisionError, match="'a'"):
        keyed.check_keys(frame(spark, [("a", 1), ("a", 2)]))
    for bad in ("", "/a", "a\\b", "a/../b", "..", "a/./b", "a//b", None):
        with pytest.raises(InvalidKeyError):
            keyed.check_keys(frame(spark, [(bad, 1)]))
    with pytest.raises(InvalidKeyError):
        keyed.check_keys(spark.createDataFrame([(1,)], "other long"))


def test_safe_key_of_null_is_false(spark):
    assert [r[0] for r in spark.createDataFrame([("a..b",), (None,)], "k string").select(safe_key(F.col("k"))).collect()] == [True, False]


def test_sources_are_tagged_and_collide_by_name(spark):
    a, b = frame(spark, [("x", 1)]), frame(spark, [("y", 2)])
    both = keyed.union_sources({"a": a, "b": b})
    assert {(r.key, r["__source__"]) for r in both.collect()} == {("x", "a"), ("y", "b")}
    assert "__source__" not in a.columns
    with pytest.raises(KeyCollisionError, match="'a' and 'b'.*'x'"):
        keyed.union_sources({"a": a, "b": a})


def test_sources_with_other_columns_are_filled_with_null(spark):
    b = spark.createDataFrame([("y", "t")], "key string, title string")
    assert {(r.key, r.value, r.title) for r in keyed.union_sources({"a": frame(spark, [("x", 1)]), "b": b}).collect()} == {("x", 1, None), ("y", None, "t")}


def test_branch_is_total_and_disjoint(spark):
    df = frame(spark, [(str(k), k) for k in range(10)])
    out = keyed.branch(df, F.when(F.col("value") > 4, "hi").otherwise("lo"), {"hi": lambda d: d.withColumn("value", -F.col("value")), "lo": None})
    assert {r.key: r.value for r in out.collect()} == {str(k): -k if k > 4 else k for k in range(10)}


def test_branch_errors(spark):
    df = frame(spark, [("a", 1)])
    with pytest.raises(MissingSourceTagError):
        keyed.split_routes(df, "source", ["a"])
    with pytest.raises(TypeError):
        keyed.split_routes(df, F.col("value"), ["a"])
    with pytest.raises(TypeError):
        keyed.split_routes(df, 3, ["a"])
    with pytest.raises(Exception, match="no route for z"):
        keyed.split_routes(df, F.lit("z"), ["a"])["a"].count()
    with pytest.raises(KeyCollisionError, match="routes 'l' and 'r'"):
        keyed.merge_routes({"l": df, "r": df})


def test_rekey_keeps_the_last(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "key string, to string")
    assert {(r.key, r.origin) for r in keyed.rekey(df, F.col("to"), origin="origin").collect()} == {("x", "b"), ("y", "c")}
    assert {(r.key, r.value) for r in keyed.last_wins(frame(spark, [("1", 5), ("2", 5), ("3", 6)]).withColumnRenamed("key", "id"), F.col("value").cast("string"), F.col("id")).select("key", "value").collect()} == {("5", 5), ("6", 6)}


def test_count_by_domain(spark):
    df = spark.createDataFrame([("a",), ("a",)], "s string")
    assert {tuple(r) for r in keyed.count_by_domain(df, "s", ["a", "b"]).collect()} == {("a", 2), ("b", 0)}
    with pytest.raises(ValueError):
        keyed.count_by_domain(df, "s", ["b"])


def test_between_takes_the_first_and_fails_without_the_text(spark):
    df = spark.createDataFrame([("<a>x</a><a>y</a>",), (None,)], "t string")
    assert [r[0] for r in df.select(between(F.col("t"), "<a>", "</a>")).collect()] == ["x", None]
    with pytest.raises(Exception) as e:
        spark.createDataFrame([("secret",)], "t string").select(between(F.col("t"), "<a>", "</a>", "title")).collect()
    assert "no title" in str(e.value)


def test_defaults(spark):
    df = spark.createDataFrame([("a", None)], "key string, q int")
    row = keyed.with_defaults(df, ["key"], {"q": -1, "t": ""}).first()
    assert (row.q, row.t) == (-1, "")
    with pytest.raises(ValueError, match="lang"):
        keyed.with_defaults(df, ["lang"], {})


def test_between_with_a_recurring_start(spark):
    df = spark.createDataFrame([("<h1>a<h1>b</h1>",), ("x<h1></h1><h1>y</h1>",), (None,)], "t string")
    assert [r[0] for r in df.select(between(F.col("t"), "<h1>", "</h1>")).collect()] == ["a<h1>b", "", None]
    for bad in ("</h1><h1>", "<h1>", "none"):
        with pytest.raises(Exception, match="no title"):
            spark.createDataFrame([(bad,)], "t string").select(between(F.col("t"), "<h1>", "</h1>", "title")).collect()


def test_sorted_keys_and_fingerprints(spark):
    df = spark.createDataFrame([(f"k{k % 50}",) for k in range(120)], "key string").repartition(7)
    got = {(r["key"], r["position"]) for r in keyed.sorted_keys(df).collect()}
    assert [k for _, k in sorted((p, k) for k, p in got)] == sorted(f"k{k % 50}" for k in range(120)) and len(got) == 120
    some = df.distinct()
    assert keyed.fingerprint(some) == keyed.fingerprint(some.repartition(2))
    assert keyed.fingerprint(some)[1] != keyed.fingerprint(some.where("key <> 'k1'").unionByName(spark.createDataFrame([("z",)], "key string")))[1]
    assert keyed.fingerprint(some.limit(0))[0] == 0


def test_fan_out_reads_its_input_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def touched(x):
        seen.add(1)
        return x

    df = spark.range(30).select(F.format_string("k%d", "id").alias("key"), touched("id").alias("value"), F.lit(None).alias("nothing"), F.lit("x").alias("__route"))
    parts, counts = keyed.fan_out(df, F.when(F.col("value") % 3 == 0, "a").otherwise("b"), ["a", "b", "none"], at=f"{tmp_path}/fan")
    assert counts == {"a": 10, "b": 20, "none": 0} and list(parts) == ["a", "b", "none"]
    assert [parts[r].count() for r in parts] == [10, 20, 0] and all(p.columns == df.columns for p in parts.values())
    assert parts["a"].where("nothing is null and __route = 'x'").count() == 10
    assert seen.value == 30
    with pytest.raises(Exception, match="no route for"):
        keyed.fan_out(df, F.lit("z"), ["a"])
    with pytest.raises(Exception, match="no route for a null"):
        keyed.fan_out(df, F.lit(None).cast("string"), ["a"])


def test_key_facts_tell_buckets_apart(spark, tmp_path):
    df = spark.range(1000).select(F.format_string("k%d", "id").alias("key"))
    facts = keyed.key_facts(df, 16, f"{tmp_path}/keys")
    assert facts == keyed.bucket_facts(df.repartition(3), 16) == keyed.key_facts(df, 16) and facts.rows == 1000 and len(facts.buckets) == 16
    other = df.where("key <> 'k7'").unionByName(spark.createDataFrame([("z",)], "key string"))
    differ = facts.differing(keyed.bucket_facts(other, 16))
    assert 1 <= len(differ) <= 2
    written = spark.read.parquet(f"{tmp_path}/keys")
    assert written.count() == 1000 and written.withColumn("file", F.input_file_name()).groupBy("bucket").agg(F.countDistinct("file").alias("n")).where("n > 1").count() == 0
    some = F.col("bucket").isin(differ)
    odd = keyed.missing_and_extra(other.withColumn("bucket", keyed.bucket(16)).where(some), written.where(some))
    assert sorted(map(tuple, odd.collect())) == [("k7", True), ("z", False)]
    assert keyed.bucket_facts(df.union(df.limit(1)), 16) != facts and keyed.key_facts(df.limit(0), 4).rows == 0
