import json

import pytest
from pyspark.sql import functions as F

from sluice.cli import make_cli
from sluice.model import EmptyOutputError, LeaseHeldError, MissingPriorOutputError, ObserverError, RecordError, RecordVersionError
from sluice.plans.pipeline import Branch, Pipeline, Stage, Step, mermaid, nodes, snapshot, step
from sluice.plans.records import Commits, Lease, Ownership, RunLog
from sluice.plans.run import run
from sluice.sources.datasets import KeyedText, Loader, ParquetDataset
from sluice.sources.files import Files

SCHEMA = "key string, value long"
calls = []


def double(df, context):
    calls.append(context.step)
    return df.withColumn("value", F.col("value") * 2)


def plus(df, context):
    calls.append(context.step)
    return df.withColumn("value", F.col("value") + int(context.params.get("by", "1")))


def total(df, context):
    return df.agg(F.sum("value").alias("total"))


def source(rows=(("a", 1), ("b", 2))):
    return Loader("rows", lambda s: s.createDataFrame(list(rows), SCHEMA))


def keyed(**more):
    return ParquetDataset(schema=SCHEMA, **more)


def made(**stage):
    return Pipeline("p", source(), [Stage("one", [Step(double, keyed()), Step(plus, keyed())], **stage), Stage("two", [Step(total, ParquetDataset(keyed=False))])])


def test_full_run_layout_and_result(spark, tmp_path):
    out = run(spark, made(), str(tmp_path), params={"by": "10"})
    assert out.output.first().total == 26
    assert Files(spark).children(f"{tmp_path}/p") == ["001_one", "002_two"]
    assert Files(spark).children(f"{tmp_path}/p/001_one") == ["001_double", "002_plus"]
    assert len(out.run_id) == 32


def test_rerun_leaves_no_stale_files(spark, tmp_path):
    def text(df, context):
        return df.select("key", F.lit("x").alias("value"))

    for rows in ([("a", 1), ("b", 2)], [("a", 1)]):
        run(spark, Pipeline("p", source(rows), [Stage("s", [Step(text, KeyedText())])]), str(tmp_path))
    assert Files(spark).walk(f"{tmp_path}/p", ".txt") == ["001_s/001_text/a.txt"]


def test_failed_validation_leaves_output_and_record(spark, tmp_path):
    commits = Commits(f"{tmp_path}/meta")
    run(spark, made(), f"{tmp_path}/out", commits=commits)
    bad = made()
    bad.source = source([("a", 1), ("a", 2)])
    with pytest.raises(Exception, match="more than once"):
        run(spark, bad, f"{tmp_path}/out", commits=commits)
    assert run(spark, made(), f"{tmp_path}/out", stage="two", commits=commits).output.first().total == 8


def test_crash_in_save_leaves_nothing_to_trust(spark, tmp_path, monkeypatch):
    commits = Commits(f"{tmp_path}/meta")
    run(spark, made(), f"{tmp_path}/out", commits=commits)
    monkeypatch.setattr(ParquetDataset, "save", lambda *a: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        run(spark, made(), f"{tmp_path}/out", stage="one", step="double", commits=commits)
    with pytest.raises(MissingPriorOutputError):
        run(spark, made(), f"{tmp_path}/out", stage="one", step="plus", commits=commits)


def test_selective_runs_fail_closed_before_user_code(spark, tmp_path):
    calls.clear()
    for args in ({"stage": 2}, {"stage": "one", "step": 2}):
        with pytest.raises(MissingPriorOutputError, match="double|plus"):
            run(spark, made(), str(tmp_path), **args)
    with pytest.raises(MissingPriorOutputError):
        run(spark, made(), str(tmp_path), stage=2, commits=Commits(f"{tmp_path}/meta"))
    assert calls == []
    run(spark, made(), str(tmp_path), stage=1, step=1)
    assert calls == ["double"]
    for args in ({"stage": 9}, {"stage": "no"}, {"stage": 1, "step": 9}, {"step": 1}):
        with pytest.raises(ValueError):
            run(spark, made(), str(tmp_path), **args)


def test_unpersisted_prior_is_no_start(spark, tmp_path):
    p = Pipeline("p", source(), [Stage("one", [Step(double, keyed(), persist=False)]), Stage("two", [Step(plus, keyed())])])
    assert {r.value for r in run(spark, p, str(tmp_path)).output.collect()} == {3, 5}
    assert not Files(spark).exists(f"{tmp_path}/p/001_one")
    with pytest.raises(MissingPriorOutputError, match="not persisted"):
        run(spark, p, str(tmp_path), stage=2, commits=Commits(f"{tmp_path}/meta"))


def test_commit_record_is_checked(spark, tmp_path):
    commits = Commits(f"{tmp_path}/meta")
    run(spark, made(), f"{tmp_path}/out", commits=commits)
    at = f"{tmp_path}/meta/commits/p/s001-e002.json"
    record = json.loads(Files(spark).read_text(at))
    for change, error in (({"rows": 7}, RecordError), ({"dataset": "X"}, RecordError), ({"format": 9}, RecordVersionError)):
        Files(spark).write_text(at, json.dumps(record | change))
        with pytest.raises(error):
            run(spark, made(), f"{tmp_path}/out", stage=2, commits=commits)
    Files(spark).write_text(at, "{")
    with pytest.raises(MissingPriorOutputError):
        run(spark, made(), f"{tmp_path}/out", stage=2, commits=commits)


def test_branch_in_a_run(spark, tmp_path):
    load = Loader("x", lambda s: s.createDataFrame([("a", 1, "l"), ("b", 2, "r")], "key string, value long, __source__ string"))
    p = Pipeline("p", load, [Stage("s", [Branch("b", "source", {"l": [Step(double, keyed())], "r": []}), Step(plus, keyed())])])
    assert {(r.key, r.value) for r in run(spark, p, str(tmp_path)).output.collect()} == {("a", 3), ("b", 3)}
    assert Files(spark).children(f"{tmp_path}/p/001_s/001_b") == ["l"]
    kept = run(spark, p, f"{tmp_path}/k", keep_source=True).output
    assert "value" in kept.columns


def test_empty_route_still_runs(spark, tmp_path):
    p = lambda **m: Pipeline("p", source(), [Stage("s", [Branch("b", F.lit("x"), {"x": [], "y": [Step(double, keyed(**m))]})])])
    with pytest.raises(EmptyOutputError):
        run(spark, p(), str(tmp_path))
    assert run(spark, p(allow_empty=True), str(tmp_path)).output.count() == 2


def test_clean_and_stage_root(spark, tmp_path):
    files = Files(spark)
    files.write_text(f"{tmp_path}/p/001_one/old/x.txt", "x")
    run(spark, made(), str(tmp_path))
    assert files.exists(f"{tmp_path}/p/001_one/old/x.txt")
    run(spark, made(clean=True), str(tmp_path))
    assert files.children(f"{tmp_path}/p/001_one") == ["001_double", "002_plus"]
    with pytest.raises(ValueError):
        run(spark, made(clean=True), str(tmp_path), stage=1, step=2)
    run(spark, made(root=f"{tmp_path}/else"), str(tmp_path))
    assert files.children(f"{tmp_path}/else") == ["001_double", "002_plus"]


def test_context_factory(spark, tmp_path):
    class Own:
        def __init__(self, base):
            self.base, self.tenant = base, "t"

    def tag(df, context):
        return df.select("key", F.lit(context.tenant).alias("value"))

    p = Pipeline("p", source(), [Stage("s", [Step(tag, KeyedText())])])
    assert {r.value for r in run(spark, p, str(tmp_path), context=Own).output.collect()} == {"t"}
    with pytest.raises(TypeError):
        run(spark, p, str(tmp_path), context=lambda c: 3)


def test_events_and_observers(spark, tmp_path):
    record = RunLog(f"{tmp_path}/meta")
    done = run(spark, made(), f"{tmp_path}/out", observers=[record])
    assert record.summary(spark, done.run_id)["status"] == "completed"

    def fail(df, context):
        raise ValueError("s3cret value")

    seen = []

    class Watch:
        required = True

        def on_event(self, spark, event):
            seen.append(event)

    with pytest.raises(ValueError):
        run(spark, Pipeline("p", source(), [Stage("s", [fail])]), f"{tmp_path}/out", observers=[Watch()])
    assert [e["kind"] for e in seen] == ["run_started", "node_started", "node_failed", "run_failed"]
    assert "s3cret" not in json.dumps(seen)

    class Broken:
        def on_event(self, spark, event):
            raise OSError

    assert len(run(spark, made(), f"{tmp_path}/out", observers=[Broken()]).observer_errors) == 8
    Broken.required = True
    with pytest.raises(ObserverError):
        run(spark, made(), f"{tmp_path}/out", observers=[Broken()])


def test_ownership_prunes_only_its_own(spark, tmp_path):
    own, out, files = Ownership(f"{tmp_path}/meta"), f"{tmp_path}/out", Files(spark)
    run(spark, made(), out, ownership=own)
    files.write_text(f"{out}/p/foreign/x", "x")
    less = Pipeline("p", source(), [Stage("one", [Step(double, keyed())])])
    run(spark, less, out, stage=1, ownership=own)
    assert files.exists(f"{out}/p/001_one/002_plus")
    run(spark, less, out, ownership=own)
    assert not files.exists(f"{out}/p/001_one/002_plus") and files.exists(f"{out}/p/foreign/x")
    at = f"{tmp_path}/meta/inventories/p.json"
    bad = json.loads(files.read_text(at))
    files.write_text(at, json.dumps(bad | {"folders": [f"{out}/p/../else"]}))
    with pytest.raises(RecordError):
        run(spark, less, out, ownership=own)


def test_lease(spark, tmp_path):
    a, clock = Lease(f"{tmp_path}/m"), [0.0]
    a.enter(spark, "p", "r1")
    with pytest.raises(LeaseHeldError):
        run(spark, made(), f"{tmp_path}/out", lease=Lease(f"{tmp_path}/m"))
    late = Lease(f"{tmp_path}/m", clock=lambda: __import__("time").time() + 100)
    late.enter(spark, "p", "r2")
    late.exit(spark, "p")
    assert Files(spark).exists(f"{tmp_path}/m/recoveries/p/r2.json")
    a._stop.set()
    run(spark, made(), f"{tmp_path}/out", lease=Lease(f"{tmp_path}/m"))
    Files(spark).write_text(f"{tmp_path}/m/leases/p.json", "?")
    with pytest.raises(LeaseHeldError):
        Lease(f"{tmp_path}/m").enter(spark, "p", "r3")
    with pytest.raises(ValueError):
        Lease("x", heartbeat=5, stale=5)
    assert clock == [0.0]


def test_declarations():
    p = made()
    assert snapshot(p) == snapshot(made()) and "/" not in json.loads(snapshot(p))["pipeline"]
    assert [n.id for n in nodes(p, "r")] == ["s001-e001", "s001-e002", "s002-e001"]
    for wrong in (lambda: Stage("a/b", []), lambda: Pipeline("p", source(), [Stage("x", []), Stage("x", [])]), lambda: Branch("b", "source", {}), lambda: Stage("", [])):
        with pytest.raises(ValueError):
            wrong()
    for wrong in (lambda: Stage("s", [3]), lambda: Branch("b", "source", {"x": [double]}), lambda: step(output=3), lambda: Pipeline("p", 3, [])):
        with pytest.raises(TypeError):
            wrong()
    with pytest.raises(ValueError):
        Branch("b", "source", {"x": [Step(plus), Step(plus)]})

    @step(output=KeyedText("t"), persist=False)
    def own(df, context):
        return df

    assert Stage("s", [own]).entries[0].persist is False
    assert mermaid(p).startswith("flowchart TD\n") and "double" in mermaid(p)


def test_cli(spark, tmp_path, capsys):
    main = make_cli(made(), session=lambda master: spark)
    assert main(["--run-root", str(tmp_path), "--param", "by=3"]) == 0
    assert main(["--mermaid", f"{tmp_path}/x.mmd"]) == 0
    for args in (["--param", "s3cret"], ["--stage", "2", "--run-root", str(tmp_path)], ["--stage", "9"]):
        with pytest.raises(SystemExit):
            main(args)
    assert "s3cret" not in capsys.readouterr().err


def test_stream_of_batches(spark, tmp_path):
    from sluice.streaming.batches import run_stream

    spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    run_stream(stream, made(), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out/batch=0/p/002_two/001_total").first().total == 8


def test_a_step_that_reads_back_fewer_rows_fails(spark, tmp_path):
    class Losing(ParquetDataset):
        def load_from(self, spark, dest):
            return super().load_from(spark, dest).limit(1)

    commits = Commits(f"{tmp_path}/meta")
    with pytest.raises(RecordError, match="wrote 2 rows, but 1"):
        run(spark, Pipeline("p", source(), [Stage("s", [Step(double, Losing(schema=SCHEMA))])]), str(tmp_path), commits=commits)
    with pytest.raises(MissingPriorOutputError):
        run(spark, Pipeline("p", source(), [Stage("s", [Step(double, Losing(schema=SCHEMA)), Step(plus, keyed())])]), str(tmp_path), stage=1, step=2, commits=commits)


def test_hidden_keys_are_handed_on(spark, tmp_path):
    def text(df, context):
        return df.select("key", F.lit("x").alias("value"))

    def same(df, context):
        return df

    rows = [("_x", 1), (".a", 2), ("en/_x", 3), ("b", 4)]
    out = run(spark, Pipeline("p", source(rows), [Stage("s", [Step(text, KeyedText()), Step(same, KeyedText())])]), str(tmp_path)).output
    assert sorted(r["key"] for r in out.collect()) == sorted(k for k, _ in rows)


def test_replaced_keys_of_the_same_number_are_not_trusted(spark, tmp_path):
    commits = Commits(f"{tmp_path}/meta")
    run(spark, made(), f"{tmp_path}/out", commits=commits)
    at = f"{tmp_path}/out/p/001_one/002_plus"
    spark.createDataFrame([("a", 3), ("c", 5)], SCHEMA).write.mode("overwrite").parquet(at)
    with pytest.raises(RecordError, match="other keys"):
        run(spark, made(), f"{tmp_path}/out", stage=2, commits=commits)
    spark.createDataFrame([("b", 9), ("a", 3)], SCHEMA).write.mode("overwrite").parquet(at)
    assert run(spark, made(), f"{tmp_path}/out", stage=2, commits=commits).output.first().total == 12


def test_guards_are_left_in_reverse_and_none_is_forgotten(spark, tmp_path):
    told = []

    class Guard:
        def __init__(self, name, fails=""):
            self.name, self.fails = name, fails

        def enter(self, spark, pipeline, run_id):
            told.append(f"enter {self.name}")
            if self.fails == "enter":
                raise OSError(self.name)

        def exit(self, spark, pipeline, outcome):
            told.append(f"{outcome} {self.name}")
            if self.fails == "exit":
                raise OSError(self.name)

    with pytest.raises(OSError, match="b"):
        run(spark, made(), str(tmp_path), guards=[Guard("a"), Guard("b", "enter"), Guard("c")])
    assert told == ["enter a", "enter b", "failed a"]
    told.clear()
    with pytest.raises(OSError, match="b"):
        run(spark, made(), str(tmp_path), guards=[Guard("a"), Guard("b", "exit"), Guard("c")])
    assert told == ["enter a", "enter b", "enter c", "completed c", "completed b", "failed a"]
    one = Guard("x")
    for wrong, error in (({"guards": [one, one]}, ValueError), ({"guards": [3]}, TypeError), ({"observers": [3]}, TypeError), ({"commits": 3}, TypeError), ({"ownership": 3}, TypeError)):
        with pytest.raises(error):
            run(spark, made(), str(tmp_path), **wrong)


def test_profile_of_all_records(spark, tmp_path):
    from sluice.plans.records import production

    root = f"{tmp_path}/meta"
    run(spark, made(), f"{tmp_path}/out", **production(root))
    assert run(spark, made(), f"{tmp_path}/out", stage=2, **production(root)).output.first().total == 8
    assert Files(spark).children(root) == ["commits", "events", "inventories", "leases"]
    with pytest.raises(ValueError):
        production(" ")


def test_records_are_replaced_in_one_step(spark, tmp_path):
    files = Files(spark)
    for k in range(3):
        files.write_text(f"{tmp_path}/a/b.json", str(k))
        assert files.read_text(f"{tmp_path}/a/b.json") == str(k)
    assert files.children(f"{tmp_path}/a") == ["b.json"] or files.children(f"{tmp_path}/a") == [".b.json.crc", "b.json"]
    assert files.any(str(tmp_path), ".json") and not files.any(str(tmp_path), ".txt") and not files.any(f"{tmp_path}/none")


def test_empty_partitioned_output(spark, tmp_path):
    def none(df, context):
        return df.where("value < 0")

    out = ParquetDataset(schema=SCHEMA, allow_empty=True, partition_by=("value",))
    assert run(spark, Pipeline("p", source(), [Stage("s", [Step(none, out)])]), str(tmp_path)).output.count() == 0
    with pytest.raises(EmptyOutputError):
        run(spark, Pipeline("p", source(), [Stage("s", [Step(none, ParquetDataset(partition_by=("value",)))])]), str(tmp_path))


def test_missing_and_extra_keys_are_named(spark, tmp_path):
    rows = [(f"k{k:03d}", k) for k in range(40)]
    p = Pipeline("p", source(rows), [Stage("s", [Step(double, keyed()), Step(plus, keyed())])])
    commits = Commits(f"{tmp_path}/meta", named=3)
    run(spark, p, f"{tmp_path}/out", stage=1, step=1, commits=commits)
    at = f"{tmp_path}/out/p/001_s/001_double"
    spark.createDataFrame([*rows[5:], ("new", 1)], SCHEMA).write.mode("overwrite").parquet(at)
    with pytest.raises(RecordError, match=r"missing=\['k000', 'k001', 'k002'\] and 2 more, extra=\['new'\]"):
        run(spark, p, f"{tmp_path}/out", stage=1, step=2, commits=commits)
    spark.createDataFrame([*rows, rows[0]], SCHEMA).write.mode("overwrite").parquet(at)
    with pytest.raises(RecordError, match="other keys"):
        run(spark, p, f"{tmp_path}/out", stage=1, step=2, commits=commits)
    run(spark, p, f"{tmp_path}/out", commits=commits)
    assert len(Files(spark).children(f"{tmp_path}/meta/commits/p/keys")) == 2  # one table for each step
    Files(spark).delete(f"{tmp_path}/meta/commits/p/keys")
    assert run(spark, p, f"{tmp_path}/out", stage=1, step=2, commits=commits).output.count() == 40  # equal buckets need no table


def test_records_of_before_there_were_buckets_still_count(spark, tmp_path):
    from sluice.operators.keyed import fingerprint

    commits, at = Commits(f"{tmp_path}/meta"), f"{tmp_path}/meta/commits/p/s001-e002.json"
    run(spark, made(), f"{tmp_path}/out", commits=commits)
    record = json.loads(Files(spark).read_text(at))
    old = fingerprint(spark.read.parquet(f"{tmp_path}/out/p/001_one/002_plus"))[1]
    Files(spark).write_text(at, json.dumps(record | {"keys": old}))
    assert run(spark, made(), f"{tmp_path}/out", stage=2, commits=commits).output.first().total == 8
    Files(spark).write_text(at, json.dumps(record | {"keys": "0-0"}))
    with pytest.raises(RecordError, match="other keys"):
        run(spark, made(), f"{tmp_path}/out", stage=2, commits=commits)


def test_a_persisted_step_is_one_write_and_one_pass_over_keys(spark, tmp_path):
    sc, seen = spark.sparkContext, []

    class Watch:
        def on_event(self, spark, event):
            seen.append((event["kind"], event["rows"]))

    sc.setJobGroup("one-step", "")
    try:
        run(spark, Pipeline("p", Loader("r", lambda s: s.range(100).selectExpr("cast(id as string) AS key", "id AS value")), [Stage("s", [Step(double, keyed())])]), str(tmp_path), observers=[Watch()])
        jobs = sc.statusTracker().getJobIdsForGroup("one-step")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert ("node_completed", 100) in seen
    assert len(jobs) <= 4  # the write; the keys by adaptive stages


def test_branch_input_is_read_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        reads.add(1)
        return x

    load = Loader("x", lambda s: s.range(20).select(F.col("id").cast("string").alias("key"), counted("id").alias("value")))
    routes = {"even": [Step(double, keyed())], "odd": [Step(plus, keyed())], "none": [Step(double, keyed(allow_empty=True))]}
    p = Pipeline("p", load, [Stage("s", [Branch("b", F.when(F.col("value") % 2 == 0, "even").otherwise("odd"), routes)])])
    assert run(spark, p, str(tmp_path)).output.count() == 20 and reads.value == 20
    p.stages[0].entries[0].routes.pop("odd")
    with pytest.raises(Exception, match="no route for odd"):
        run(spark, p, str(tmp_path))


def test_wrong_keys_in_keyed_files_are_found(spark, tmp_path):
    class Renaming(KeyedText):
        def save(self, df, dest):
            super().save(df.withColumn("key", F.concat("key", F.lit("x"))), dest)

    def text(df, context):
        return df.select("key", F.lit("x").alias("value"))

    with pytest.raises(RecordError, match="other keys"):
        run(spark, Pipeline("p", source(), [Stage("s", [Step(text, Renaming())])]), str(tmp_path))


def test_a_bound_plan_can_be_looked_at(tmp_path):
    from sluice.plans.run import bind

    p = made(clean=True)
    whole, part = bind(p, "root"), bind(p, "root", stage="two")
    assert [d["runs"] for d in whole.describe()] == [True] * 3 and whole.before() is None and whole.emptied() == ["root/p/001_one"] and not whole.selective
    assert [d["node"] for d in part.describe() if d["runs"]] == ["s002-e001"] and part.before()[2].name == "plus" and part.emptied() == [] and part.selective
    assert part.describe()[2]["folder"] == "root/p/002_two/001_total"
    for wrong in ({"step": 1}, {"stage": "none"}, {"stage": 1, "step": 2}):
        with pytest.raises(ValueError):
            bind(p, "root", **wrong)


def test_plugin_ids_are_single_segments_of_their_own(spark, tmp_path):
    class Part:
        def __init__(self, plugin_id):
            self.plugin_id = plugin_id

        def on_event(self, spark, event):
            pass

    for ids, told in ((["a", "a"], "twice"), (["a/b"], "segment"), ([""], "segment"), ([".."], "segment"), ([3], "segment")):
        with pytest.raises(ValueError, match=told):
            run(spark, made(), str(tmp_path), observers=[Part(x) for x in ids])
    assert run(spark, made(), str(tmp_path), observers=[Part("a"), Part("b"), Part(None)]).output.first().total == 8


def test_metrics_of_the_write_are_kept_with_the_commit(spark, tmp_path):
    commits = Commits(f"{tmp_path}/meta")
    p = Pipeline("p", source(), [Stage("s", [Step(double, keyed(metrics={"most": F.max("value"), "users": F.hll_sketch_agg("key")}))])])
    run(spark, p, f"{tmp_path}/out", commits=commits)
    told = commits.metrics(spark, "p", nodes(p, "")[0])
    assert told["most"] == 4 and spark.createDataFrame([(told["users"],)], "s binary").select(F.hll_sketch_estimate("s")).first()[0] == 2
    assert commits.metrics(spark, "other", nodes(p, "")[0]) == {}
