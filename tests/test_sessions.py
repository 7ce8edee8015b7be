import datetime as dt

import numpy as np
import pytest

from sluice.model import RecordError
from sluice.plans.records import Commits
from sluice.sources.files import Files
from sluice.streaming.sessions import Sessions

SCHEMA = "user string, at timestamp, n long"
BASE = dt.datetime(2024, 1, 1)


def plain(batches, gap, late):
    """(sessions, late rows) of rows (user, seconds, n) in batches."""
    newest, kept, lost = None, [], []
    for rows in batches:
        for u, t, n in rows:
            (lost if t is None or (newest is not None and t < newest - late) else kept).append((u, t, n))
        times = [t for _, t, _ in rows if t is not None]
        newest = max([*times, *([newest] if newest is not None else [])], default=None)
    out = []
    for user in {u for u, *_ in kept}:
        run = []
        for t, n in sorted((t, n) for u, t, n in kept if u == user):
            if run and t - run[-1][0] > gap:
                out.append((user, run))
                run = []
            run.append((t, n))
        out.append((user, run))
    return sorted(((u, r[0][0], r[-1][0], len(r), sum(n for _, n in r)) for u, r in out), key=str), sorted(lost, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(u, None if t is None else BASE + dt.timedelta(seconds=t), n) for u, t, n in rows], SCHEMA)


def told(own, spark):
    seconds = lambda x: int((x - BASE).total_seconds())
    got = sorted(((r["user"], seconds(r["start"]), seconds(r["end"]), r["rows"], r["n"]) for r in own.sessions(spark, open_too=True).collect()), key=str)
    return got, sorted(((r["user"], None if r["at"] is None else seconds(r["at"]), r["n"]) for r in own.late_rows(spark).collect()), key=str)


def test_out_of_order_late_and_replayed_batches(spark, tmp_path):
    rng = np.random.default_rng(2)
    batches = [[(["a", "b", None][int(rng.integers(3))], None if rng.random() < 0.05 else int(k * 100 + rng.integers(0, 400)), k) for _ in range(60)] for k in range(4)]
    own = Sessions(str(tmp_path), "at", ["user"], gap=7, late=90, sums={"n": "n"})
    assert own.sessions(spark) is None and own.late_rows(spark) is None
    for k, rows in enumerate(batches):
        own.each(frame(spark, rows).repartition(3), k)
        own.each(frame(spark, rows), k)  # again, as after a failure
    want, lost = plain(batches, 7, 90)
    assert lost and told(own, spark) == (want, lost)
    assert 0 < own.sessions(spark).count() < len(want)
    assert own.record(spark)["late"] == sum(r["late"] for r in [own.record(spark)]) and own.record(spark, 0) is None
    Files(spark).write_text(f"{tmp_path}/records/000000000003.json", "{}")
    with pytest.raises(RecordError):
        own.record(spark)


def test_what_has_no_record_is_not_read(spark, tmp_path, monkeypatch):
    own = Sessions(str(tmp_path), "at", ["user"], gap=5, late=0, sums={"n": "n"})
    own.each(frame(spark, [("a", 1, 1), ("a", 100, 1)]), 0)
    with monkeypatch.context() as m:
        m.setattr(Files, "write_text", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            own.each(frame(spark, [("a", 103, 5), ("b", 300, 1)]), 1)
    assert told(own, spark)[0] == [("a", 1, 1, 1, 1), ("a", 100, 100, 1, 1)]
    own.each(frame(spark, [("a", 103, 5), ("b", 300, 1)]), 1)
    own.each(frame(spark, []), 2)
    assert told(own, spark)[0] == [("a", 1, 1, 1, 1), ("a", 100, 103, 2, 6), ("b", 300, 300, 1, 1)]
    with pytest.raises(ValueError):
        Sessions("x", "at", ["user"], gap=0, late=1)


def test_each_batch_of_a_stream_has_commits_of_its_own(spark, tmp_path):
    from test_runs import SCHEMA as ROWS
    from test_runs import made

    from sluice.streaming.batches import run_stream

    for k in range(2):
        spark.createDataFrame([(f"a{k}", k)], ROWS).write.parquet(f"{tmp_path}/in/arrival={k}")
        stream = spark.readStream.schema(ROWS).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        run_stream(stream, made(), f"{tmp_path}/out", f"{tmp_path}/check", commits=Commits(f"{tmp_path}/meta")).awaitTermination(60)
    for k in range(2):
        assert "s001-e002.json" in Files(spark).children(f"{tmp_path}/meta/batch={k}/commits/p")
