import pytest
from pyspark.sql import functions as F

from sluice.functions import tables


def test_stretches(spark):
    df = spark.createDataFrame([(1, "a<b>c<d>"), (2, None), (3, "none"), (4, "<open"), (5, "<><x>"), (6, "<a<b>")], "id int, text string")
    got = tables.with_stretches(df, "text", "<", ">", "found")
    assert got.columns == ["id", "text", "position", "found"]
    assert sorted((r["id"], r["position"], r["found"]) for r in got.collect()) == [(1, 0, "b"), (1, 1, "d"), (5, 0, ""), (5, 1, "x"), (6, 0, "a<b")]
    tables.register(spark)
    df.createOrReplaceTempView("texts")
    assert spark.sql("SELECT s.part FROM texts, LATERAL stretches(text, '<', '>', 'part') s").count() == 5
    with pytest.raises(Exception, match="constant text"):
        spark.sql("SELECT * FROM texts, LATERAL stretches(text, '<', '>', text) s").collect()


def test_steps(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("b", 1, 1), ("a", 3, None), ("a", 4, 2), (None, 1, 3), (None, 2, 9)], "k string, t int, v int").repartition(3)
    got = tables.with_steps(df, "k", ["t"], "v", "more")
    assert got.columns == ["k", "t", "v", "more"] and dict(got.dtypes)["more"] == "bigint"
    assert {(r["k"], r["t"]): r["more"] for r in got.collect()} == {("a", 1): None, ("a", 2): 2, ("a", 3): None, ("a", 4): None, ("b", 1): None, (None, 1): None, (None, 2): 6}
    assert dict(tables.with_steps(df.withColumn("v", F.col("v").cast("double")), "k", ["t"], "v", "more").dtypes)["more"] == "double"
    assert tables.with_steps(df.limit(0), "k", ["t"], "v", "more").count() == 0
    with pytest.raises(Exception, match="no nothing"):
        tables.with_steps(df, "k", ["nothing"], "v", "more")
