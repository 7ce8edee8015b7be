import json
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest

from sluice.model import LeaseHeldError, PublishError
from sluice.plans.records import Lease
from sluice.sources.files import Files
from sluice.sources.publish import Log, SparkStore


class Objects:
    """A store of objects without rename: put, and put if there is none."""

    def __init__(self):
        self.of, self._lock = {}, threading.Lock()

    def children(self, path):
        return sorted(p.rpartition("/")[2] for p in self.of if p.rpartition("/")[0] == path)

    def read_text(self, path):
        return self.of.get(path)

    def publish(self, path, text):
        with self._lock:
            return self.of.setdefault(path, text) == text

    def replace(self, path, text):
        self.of[path] = text

    def delete(self, path):
        self.of.pop(path, None)


def stores(spark, tmp_path):
    return [(Objects(), "bucket/log"), (SparkStore(spark), f"file://{tmp_path}/log")]


def test_one_writer_has_a_number(spark, tmp_path):
    for store, root in stores(spark, tmp_path):
        log = Log(store, root)
        assert log.last() == 0 and list(log.entries()) == []
        with ThreadPoolExecutor(8) as pool:
            won = list(pool.map(lambda k, log=log: log.take(1, {"k": k}), range(8)))
        assert sum(won) == 1 and log.read(1)["k"] == won.index(True) and log.numbers() == [1]


def test_writers_at_once_leave_no_gap(spark, tmp_path):
    for store, root in stores(spark, tmp_path):
        log, seen = Log(store, root), []
        with ThreadPoolExecutor(6) as pool:
            numbers = list(pool.map(lambda k, log=log, seen=seen: log.append({"k": k}, after=0, agree=seen.append), range(12)))
        assert sorted(numbers) == log.numbers() == list(range(1, 13))
        assert [numbers[e["k"]] for e in log.entries()] == list(range(1, 13))
        assert len(seen) == sum(n - 1 for n in numbers)

        def never(entry):
            raise PublishError("not after that")

        with pytest.raises(PublishError):
            log.append({}, after=11, agree=never)
        with pytest.raises(PublishError):
            log.read(99)
        assert [e["k"] for e in log.entries(after=11)] == [log.read(12)["k"]]


def test_every_way_refuses_a_taken_name(spark, tmp_path, monkeypatch):
    store = SparkStore(spark)
    assert store.way(f"file://{tmp_path}/x") == "link"
    for way in ("link", "move", "create"):
        at = f"file://{tmp_path}/{way}/x"
        monkeypatch.setattr(SparkStore, "way", lambda self, path, way=way: way)
        assert store.publish(at, "ä 1") and not store.publish(at, "2") and store.read_text(at) == "ä 1"
        assert store.publish(at, "ä 1")  # a request that a client repeats finds its own text
        assert [n for n in Files(spark).children(f"file://{tmp_path}/{way}") if not n.endswith(".crc")] == ["x"]
        store.replace(at, "3")
        assert store.read_text(at) == "3"


def test_a_create_whose_answer_is_lost_has_won(spark, tmp_path, monkeypatch):
    link = SparkStore._link

    def lost(self, path, text):
        link(self, path, text)
        raise OSError("no answer")

    monkeypatch.setattr(SparkStore, "_link", lost)
    assert SparkStore(spark).publish(f"{tmp_path}/a", "1") and not SparkStore(spark).publish(f"{tmp_path}/a", "2")
    monkeypatch.setattr(SparkStore, "_link", lambda self, path, text: (_ for _ in ()).throw(OSError("down")))
    with pytest.raises(PublishError):
        SparkStore(spark).publish(f"{tmp_path}/b", "1")


def test_a_mount_without_hard_links(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("os.link", lambda *a: (_ for _ in ()).throw(OSError(1, "not permitted")))
    store = SparkStore(spark)
    assert store.publish(f"{tmp_path}/a/x", "1") and not store.publish(f"{tmp_path}/a/x", "2") and store.read_text(f"{tmp_path}/a/x") == "1"


class _Fake:
    """A file system of a scheme, with or without conditional creation."""

    def __init__(self, scheme, conditional):
        self.scheme, self.conditional = scheme, conditional

    def getUri(self):  # noqa: N802
        return self

    def getScheme(self):  # noqa: N802
        return self.scheme

    def hasPathCapability(self, path, what):  # noqa: N802
        return self.conditional and what == "fs.option.create.conditional.overwrite"


@pytest.mark.parametrize(("scheme", "conditional", "way"), [("s3a", True, "conditional"), ("s3a", False, None), ("gs", False, "create"), ("hdfs", False, "move"), ("abfss", False, "move"), ("file", False, "link")])
def test_the_way_of_a_store(spark, monkeypatch, scheme, conditional, way):
    monkeypatch.setattr(SparkStore, "_at", lambda self, path: (_Fake(scheme, conditional), path))
    if way:
        assert SparkStore(spark).way("x") == way
    else:
        with pytest.raises(PublishError):
            SparkStore(spark).publish("x", "1")


def test_leases_on_a_store_without_rename(spark):
    objects = Objects()
    leases = [Lease("m", store=lambda s: objects) for _ in range(8)]

    def enter(lease):
        try:
            lease.enter(spark, "p", lease.holder)
            return True
        except LeaseHeldError:
            return False

    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(enter, leases))
    assert sum(won) == 1
    first = leases[won.index(True)]
    first.exit(spark, "p")
    again = Lease("m", store=lambda s: objects)
    again.enter(spark, "p", "r")
    assert again.number > first.number and objects.children("m/leases/p") == [f"{again.number:012d}.json"]
    # Two runs that find a stale lease: one takes it over, and who had it is told at its end.
    late = [Lease("m", clock=lambda: __import__("time").time() + 100, store=lambda s: objects) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        assert sum(pool.map(enter, late)) == 1
    assert len(objects.children("m/recoveries/p")) == 1
    with pytest.raises(LeaseHeldError):
        again.exit(spark, "p")
    assert json.loads(objects.of[f"m/leases/p/{again.number + 1:012d}.json"]).get("released") is None


def test_a_number_that_was_cleared_away_is_not_taken_again(spark):
    objects = Objects()
    log = Log(objects, "m/leases/p")
    slow = Lease("m", store=lambda s: objects)
    last = Log.last

    def stale(self):  # what a run saw before two others came and went
        Log.last = last
        for k in range(2):
            x = Lease("m", store=lambda s: objects)
            x.enter(spark, "p", f"r{k}")
            x.exit(spark, "p")
        return 0

    Log.last = stale
    try:
        with pytest.raises(LeaseHeldError):
            slow.enter(spark, "p", "slow")
    finally:
        Log.last = last
    assert log.numbers() == [2]
