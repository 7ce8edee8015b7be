import duckdb
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from sluice import table_queries
from sluice.operators import sketches


@pytest.fixture
def events(spark):
    return spark.range(20_000).select((F.col("id") % 7).alias("a"), (F.col("id") % 11).alias("b"), (F.col("id") % 3001).alias("user"), F.col("id").cast("double").alias("value"), F.lit(1).alias("one"))


def test_merged_sketches_answer_as_the_rows_do(events):
    fine = sketches.sketched(events, ["a", "b"], distinct={"users": "user"}, quantiles={"value": "value"}, sums={"ones": "one"})
    got = {tuple(r[:3]): r for r in sketches.answers(sketches.rolled(fine, [["a"], []]), [0.1, 0.5, 0.9]).collect()}
    assert len(got) == 8
    whole = got[None, None, 3]
    assert whole["n"] == whole["ones"] == 20_000 and abs(whole["d_users"] / 3001 - 1) < 0.07
    for q, p in zip(whole["q_value"], (0.1, 0.5, 0.9), strict=True):
        assert abs(q / 20_000 - p) < 0.03
    assert sum(r["n"] for k, r in got.items() if k[2] == 1) == 20_000 and all(abs(r["d_users"] / 2858 - 1) < 0.1 for k, r in got.items() if k[2] == 1)


def test_ways_of_merging_agree(events):
    by_a, by_b = (sketches.sketched(events, [c], distinct={"users": "user"}) for c in ("a", "b"))
    halves = sketches.sketched(events.where("b < 5"), ["a"], distinct={"users": "user"}).unionByName(sketches.sketched(events.where("b >= 5"), ["a"], distinct={"users": "user"}))
    told = [sketches.answers(sketches.merged(x, [])).first() for x in (by_a, by_b, halves)]
    assert len({(t["n"], t["d_users"]) for t in told}) == 1


def test_empty_and_null_values(events, spark):
    none = sketches.sketched(events.limit(0), ["a"], distinct={"users": "user"})
    assert none.count() == 0 and sketches.rolled(none, [["a"]]).count() == 0
    nulls = sketches.sketched(events.withColumn("user", F.lit(None).cast("long")), ["a"], distinct={"users": "user"})
    assert {r["d_users"] for r in sketches.answers(nulls).collect()} == {0}


def test_rollup_makes_no_digest_for_each_user(spark, sf_dir):
    plan = table_queries.sketch_rollup(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    digests = [x for x in plan.splitlines() if "percentile_approx" in x]
    assert digests and not any("user_id" in x.partition("functions=")[0] for x in digests)


def test_rollup_with_null_types_equals_its_sql(spark, sf_dir, tmp_path):
    null = F.when(F.col("event_id") % 4 > 0, F.col("event_type"))
    spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("event_type", null).write.parquet(f"file://{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert same_rows(table_queries.sketch_rollup(spark, f"file://{tmp_path}").toPandas(), con.execute(table_queries.SQL["sketch_rollup"]).df())


def test_options_from_the_environment():
    from sluice.sources.environment import store_options
    from sluice.sources.keyed_files import store_of

    host, url = "acct.dfs.core.windows.net", "abfss://box@acct.dfs.core.windows.net/a"
    client = {"AZURE_TENANT_ID": "t", "AZURE_CLIENT_ID": "c", "AZURE_CLIENT_SECRET": "s"}
    for names, wanted in (
        ({"AZURE_STORAGE_ACCOUNT_KEY": "a2V5", "AZURE_STORAGE_SAS_TOKEN": "x", **client}, {f"fs.azure.account.key.{host}"}),
        ({"AZURE_STORAGE_SAS_TOKEN": "sv=1&sig=a", **client}, {f"fs.azure.account.auth.type.{host}", f"fs.azure.sas.fixed.token.{host}"}),
        ({"AZURE_STORAGE_ACCOUNT_KEY": "", **client}, {f"fs.azure.account.{k}.{host}" for k in ("auth.type", "oauth.provider.type", "oauth2.client.endpoint", "oauth2.client.id", "oauth2.client.secret")}),
        ({"AZURE_CLIENT_ID": "c"}, {f"fs.azure.account.{k}.{host}" for k in ("auth.type", "oauth.provider.type", "oauth2.client.id")}),
    ):
        options = store_options(url, names)
        assert set(options) == wanted and store_of(url, options)[1] == "box/a"  # tasks know all of them
    assert store_options(url, {}) is None and store_options("s3a://b/x", client) is None and store_options("/x", client) is None
    assert store_options("az://box/x", {"AZURE_STORAGE_ACCOUNT_KEY": "k"}) is None
    assert store_options("az://box/x", {"AZURE_STORAGE_ACCOUNT_KEY": "k", "AZURE_STORAGE_ACCOUNT_NAME": "acct"}) == {f"fs.azure.account.key.{host}": "k"}
