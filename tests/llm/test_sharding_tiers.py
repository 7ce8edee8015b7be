import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from sluice.llm import sharding
from sluice.llm.queries import OP4_SQL, op4_sharding


def table(spark, tmp_path, **sizes):
    return sharding.ShardedTable(spark, f"file://{tmp_path}/t", **({"target_bytes": 40_000, "first_tier": 4_000, "ratio": 4, "min_runs": 3} | sizes))


COLUMNS = ["id as doc_id", "if(id % 7 = 0, null, repeat(sha2(cast(id as string), 256), 3)) as text", "'x' as version", "cast(null as string) as path"]


def arrival(spark, first, n):
    return spark.range(first, first + n, 1, 1).selectExpr(*COLUMNS)


def test_query_equals_its_sql(spark, sf_dir, oracle):
    assert same_rows(op4_sharding(spark, sf_dir).toPandas(), oracle.execute(OP4_SQL).df())


def test_arrivals_merge_by_tier_and_keep_their_rows(spark, tmp_path):
    t = table(spark, tmp_path)
    for k in range(7):
        t.append(arrival(spark, 100 * k, 100))
    before = t.shards()
    assert t.version() == 7 and len(before) == 7
    t.compact()
    assert len(t.shards()) < 7 and not t.due(t.shards())
    assert sorted(r[0] for r in t.read().select("doc_id").collect()) == list(range(700))
    assert t.read().columns == ["doc_id", "text", "version", "path"]
    assert sum(s.rows for s in t.shards()) == 700
    # An old version stays readable until its shards are vacuumed.
    assert t.read(3).count() == 300
    assert t.vacuum() == len({s.path for s in before} - {s.path for s in t.shards()})
    assert t.read().count() == 700


def test_large_shards_are_left_alone(spark, tmp_path):
    t = table(spark, tmp_path, target_bytes=4_000)
    for k in range(4):
        t.append(arrival(spark, 100 * k, 100))
    assert all(s.bytes >= 2_000 for s in t.shards())
    assert t.compact() == 4


def test_a_version_is_committed_once(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append(arrival(spark, 0, 10))
    with pytest.raises(sharding.VersionTaken):
        t._commit(0, [])
    assert t.version() == 1 and t.read().count() == 10


def test_a_job_that_dies_leaves_nothing_that_readers_see(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append(arrival(spark, 0, 10))
    t._write(arrival(spark, 10, 10))  # written, never committed
    assert t.read().count() == 10
    assert t.vacuum() == 1


def test_empty_and_repeated_arrivals(spark, tmp_path):
    t = table(spark, tmp_path)
    with pytest.raises(FileNotFoundError):
        t.read()
    t.append(arrival(spark, 0, 10).limit(0))
    t.append(arrival(spark, 0, 10))
    t.append(arrival(spark, 0, 10))
    t.compact()
    assert t.version() >= 3 and t.read().count() == 20


def test_query_over_an_empty_table(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/sf/documents.parquet")
    out = op4_sharding(spark, f"{tmp_path}/sf")
    assert out.count() == 0 and out.columns == ["doc_id", "lang", "source", "n_chars", "text_sha256"]
    t = table(spark, tmp_path)
    t.append(docs.limit(0))
    assert t.compact() == 1 and t.read().schema == docs.schema and t.read().count() == 0


def merged(t):
    """How many shards each version after the first took away."""
    live = [{s.path for s in t.shards(v)} for v in range(1, t.version() + 1)]
    return [len(a - b) for a, b in zip(live, live[1:], strict=False)]


def test_documents_arrive_in_parts_that_merge(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)))
    t = sharding.shard_documents(docs)
    assert sum(merged(t)) >= 4 and not t.due(t.shards())
    assert same_rows(t.read().toPandas(), docs.toPandas())


def test_versions_name_settled_shards_by_shared_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "FULL_LIST", 4)
    monkeypatch.setattr(sharding, "SMALL_LISTS", 3)
    t = table(spark, tmp_path, target_bytes=4_000)
    for k in range(9):
        t.append(arrival(spark, 100 * k, 100))
    own = t._manifest()
    assert not own["open"] and len(own["lists"]) <= 3 + 2 and sum(x["n"] for x in own["lists"]) == 9
    assert len({s.path for s in t.shards()}) == 9 and len(t.shards(5)) == 5
    assert t.vacuum() == 0
    for version in (9, 5):
        assert sorted(r[0] for r in t.read(version).select("doc_id").collect()) == list(range(100 * version))


def test_a_folder_with_dead_files_is_read_by_file(spark, tmp_path):
    t = table(spark, tmp_path, target_bytes=20_000, min_runs=2)
    t.append(spark.range(0, 400, 1, 2).where("id < 200 or id >= 396").selectExpr(*COLUMNS))  # one settled shard and one open shard in a folder
    t.append(arrival(spark, 400, 4))
    before = t.shards()
    t.compact()
    kept = {s.path for s in t.shards()} & {s.path for s in before}
    assert len(before) == 3 and len(kept) == 1 and len(t.shards()) == 2
    assert t.read().count() == 208 and t.read(2).count() == 208
    assert t.vacuum() == 2 and t.read().count() == 208


def test_vacuum_spares_writers_that_have_not_committed(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append(arrival(spark, 0, 10))
    with t._writing() as run:
        new = t._write(arrival(spark, 10, 10), run)
        assert t.vacuum() == 0
        t._commit(1, t._manifest(1)["open"], new)
    assert t.vacuum() == 0 and t.read().count() == 20
    with t._writing() as run:
        t._write(arrival(spark, 20, 10), run)
        assert t.vacuum(abandoned_after=0) == 1


def test_columns_named_like_sparks_own(spark, tmp_path):
    t = table(spark, tmp_path)
    for k in range(3):
        t.append(arrival(spark, 10 * k, 10).withColumns({"_metadata": F.lit("m"), "name": F.lit("n"), "count": F.lit(1)}))
    t.compact()
    assert len(t.shards()) == 1 and t.shards()[0].rows == 30
    assert t.read().where("_metadata = 'm' and name = 'n' and count = 1").count() == 30


def test_documents_are_read_once(spark, sf_dir):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        reads.add(1)
        return x

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", counted("text").alias("text"), F.lit(1).alias("__turn"))
    t = sharding.shard_documents(docs)
    assert reads.value == docs.count() == t.read().count() and t.read().columns == docs.columns


def test_vacuum_keeps_the_last_versions(spark, tmp_path):
    t = table(spark, tmp_path)
    for k in range(6):
        t.append(arrival(spark, 100 * k, 100))
    t.compact()
    last = t.version()
    assert t.vacuum(keep=3) == 0 or t.read(last - 2).count() == 500
    assert [t.read(v).count() for v in (last, last - 1)] == [600, 600]
    t.vacuum()
    assert t.read().count() == 600


def test_an_arrival_that_is_not_there(spark, tmp_path):
    t = table(spark, tmp_path)
    docs = arrival(spark, 0, 5)
    assert t.adopt(f"file://{tmp_path}/none", docs.schema) == 1 and t.read().count() == 0
    docs.write.parquet(f"file://{tmp_path}/some")
    assert t.adopt(f"file://{tmp_path}/some", docs.schema) == 2 and t.read().count() == 5


def test_arrivals_at_once_all_come_in(spark, tmp_path):
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda k: table(spark, tmp_path).append(arrival(spark, 100 * k, 100)), range(6)))
    t = table(spark, tmp_path)
    assert sorted(versions) == [1, 2, 3, 4, 5, 6] and sorted(r[0] for r in t.read().select("doc_id").collect()) == list(range(600))


def test_two_mergers_and_one_version_on_a_store_without_rename(spark, tmp_path, monkeypatch):
    class Put:
        """Puts a file if there is none, and has nothing else."""

        def publish(self, path, text):
            at = path.removeprefix("file://")
            try:
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(at, "x") as out:
                    out.write(text)
                return True
            except FileExistsError:
                with open(at) as there:
                    return there.read() == text

    for k in range(3):
        table(spark, tmp_path, store=Put()).append(arrival(spark, 100 * k, 100))
    a, b = table(spark, tmp_path, store=Put()), table(spark, tmp_path, store=Put())
    write = b._write

    def late(df, run):  # the other merger comes to its end meanwhile
        new = write(df, run)
        a.compact()
        return new

    monkeypatch.setattr(b, "_write", late)
    with pytest.raises(sharding.VersionTaken):
        b.compact()
    assert a.version() == 4 and a.read().count() == 300
    assert a.vacuum() == 4 and a.read().count() == 300
