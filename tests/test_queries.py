import pytest
from conftest import same_rows

from sluice import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, oracle, name):
    assert same_rows(queries.queries()[name](spark, sf_dir).toPandas(), oracle.execute(queries.oracle_sql()[name]).df())


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_branch_pipeline_persists_whole_texts(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "_shared", lambda spark: f"file://{tmp_path}/run")
    queries.branch_pipeline(spark, sf_dir)
    at = next(p.parent for p in tmp_path.rglob("*.parquet") if "documents" in str(p.relative_to(tmp_path)))
    wrote = spark.read.parquet(f"file://{at}").select("key", "content")
    assert same_rows(wrote.toPandas(), queries._documents(spark, sf_dir).select("key", "content").toPandas())
