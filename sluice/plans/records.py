"""Durable records around runs: commits, run events, owned folders, leases. Small JSON files through Spark's file systems.

Every record names its format; an unknown one is an error, never a guess. Records hold names, counts, folders and error types, no values
of records, parameters or options.
"""

from __future__ import annotations

import base64
import json
import os
import socket
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import LeaseHeldError, RecordError, RecordVersionError
from ..operators.keyed import KeyFacts, bucket, bucket_facts, fingerprint, missing_and_extra
from ..sources.files import Files, join
from ..sources.publish import Log, SparkStore, Store
from .pipeline import Node, Pipeline, nodes

FORMAT = 1


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def _parsed(text: str | None, what: str) -> dict | None:
    """The record, or None if there is none or it is not one."""
    try:
        out = json.loads(text) if text else None
    except ValueError:
        return None
    if not isinstance(out, dict):
        return None
    if isinstance(out.get("format"), int) and out["format"] != FORMAT:
        raise RecordVersionError(f"a {what} has format {out['format']}; this version knows {FORMAT}")
    return out


@dataclass
class Commits:
    """What has been written whole: one record for each persisted step, published after its files and withdrawn before they change.

    A record holds the number of rows and a fingerprint of each bucket of the keys, which are held against the files before they are used again; the keys
    themselves lie beside it as a table. Only buckets that differ are compared key by key, and what is missing or extra is named.
    """

    root: str
    #: How many keys an error names of each kind.
    named: int = 5

    def _at(self, pipeline: str, node: Node) -> str:
        return join(self.root, "commits", pipeline, f"{node.id}.json")

    def facts(self, pipeline: str, stage: str, node: Node) -> dict[str, Any]:
        return {"format": FORMAT, "pipeline": pipeline, "node": node.id, "stage": stage, "step": node.step.name, "dataset": type(node.step.output).__name__, "folder": node.folder}

    def withdraw(self, spark: SparkSession, pipeline: str, node: Node) -> None:
        Files(spark).delete(self._at(pipeline, node))

    def keys_at(self, pipeline: str, node: Node, run_id: str) -> str:
        """The table of the keys that a run's step has written."""
        return join(self.root, "commits", pipeline, "keys", f"{node.id}-{run_id}")

    def publish(self, spark: SparkSession, pipeline: str, stage: str, node: Node, run_id: str, rows: int, keys: KeyFacts | None = None, metrics: dict[str, Any] | None = None) -> None:
        known = {"of": keys.of, "buckets": [[b, n, bits] for b, (n, bits) in sorted(keys.buckets.items())]} if keys else None
        record = self.facts(pipeline, stage, node) | {"run_id": run_id, "rows": rows, "keys": known, "at": now()}
        if metrics:
            record["metrics"] = {n: {"base64": base64.b64encode(v).decode()} if isinstance(v, bytes | bytearray) else v for n, v in metrics.items()}
        files, at = Files(spark), self._at(pipeline, node)
        files.write_text(at, json.dumps(record, sort_keys=True))
        if _parsed(files.read_text(at), "commit record") != record:
            raise RecordError(f"the commit record of {node.step.name!r} could not be read back")
        tables = join(self.root, "commits", pipeline, "keys")
        for name in files.children(tables):  # one or two for each step
            if name.startswith(f"{node.id}-") and name != f"{node.id}-{run_id}":
                files.delete(join(tables, name))

    def metrics(self, spark: SparkSession, pipeline: str, node: Node) -> dict[str, Any]:
        """What was taken while a step's output was written; empty without a record."""
        record = _parsed(Files(spark).read_text(self._at(pipeline, node)), "commit record") or {}
        return {n: bytearray(base64.b64decode(v["base64"])) if isinstance(v, dict) else v for n, v in record.get("metrics", {}).items()}

    def load(self, spark: SparkSession, pipeline: str, stage: str, node: Node) -> DataFrame | None:
        """The committed output of a step; None if it has no record. A record that does not fit declaration or files is an error."""
        record = _parsed(Files(spark).read_text(self._at(pipeline, node)), "commit record")
        if record is None or not isinstance(record.get("rows"), int):
            return None
        wrong = [k for k, v in self.facts(pipeline, stage, node).items() if record.get(k) != v]
        if wrong:
            raise RecordError(f"the commit record of {node.step.name!r} differs from its declaration in {', '.join(wrong)}")
        output = node.step.output
        if not record["rows"]:
            return output.committed_empty(spark)
        if not output.exists(spark, node.folder):
            raise RecordError(f"the output of {node.step.name!r} is committed but not there")
        df = output.load_from(spark, node.folder)
        keys = record.get("keys")
        if not isinstance(keys, dict):  # output without keys, or a record of before there were buckets
            rows, bits = fingerprint(df) if keys else (df.count(), None)
            if rows != record["rows"]:
                raise RecordError(f"the output of {node.step.name!r} has {rows} rows, its record {record['rows']}")
            if bits != keys:
                raise RecordError(f"the output of {node.step.name!r} has other keys than its record")
            return df
        then = KeyFacts(record["rows"], keys["of"], {b: (n, bits) for b, n, bits in keys["buckets"]})
        there = output.keys_at(spark, node.folder)
        now_ = bucket_facts(there, then.of)
        if differ := then.differing(now_):
            raise RecordError(f"the output of {node.step.name!r} has other keys than its record: {self.difference(spark, pipeline, node, record['run_id'], there, then.of, differ)}")
        if now_.rows != record["rows"]:
            raise RecordError(f"the output of {node.step.name!r} has {now_.rows} rows, its record {record['rows']}")
        return df

    def difference(self, spark: SparkSession, pipeline: str, node: Node, run_id: str, there: DataFrame, of: int, buckets: list[int]) -> str:
        """Which keys of these buckets are missing and which are extra, the first few by name."""
        at = self.keys_at(pipeline, node, run_id)
        if not Files(spark).exists(at):
            return f"{len(buckets)} of {of} buckets differ, and the table of keys is gone"
        some = F.col("bucket").isin(buckets)
        then = spark.read.schema("bucket int, key string, n long").parquet(at).where(some)
        odd = missing_and_extra(there.withColumn("bucket", bucket(of)).where(some), then).persist()
        try:
            told = []
            for what, flag in (("missing", True), ("extra", False)):
                own = odd.where(F.col("missing") == flag)
                names = [r["key"] for r in own.orderBy("key").limit(self.named).collect()]
                n = own.count()
                told.append(f"{what}={names}" + (f" and {n - len(names)} more" if n > len(names) else ""))
            return ", ".join(told)
        finally:
            odd.unpersist()


@dataclass
class RunLog:
    """An observer that keeps each event of a run as a numbered file; the folder can be read with spark.read.json."""

    root: str
    required: bool = False

    def on_event(self, spark: SparkSession, event: dict[str, Any]) -> None:
        own = join(self.root, "events", event["run_id"])
        files = Files(spark)
        names = [n for n in files.children(own) if n.endswith(".json") and n[0] != "."]
        if [int(n[:6]) for n in names] != list(range(1, len(names) + 1)):
            raise RecordError("the events of this run have a gap")
        files.write_text(join(own, f"{len(names) + 1:06d}-{event['kind']}.json"), json.dumps({"format": FORMAT, "sequence": len(names) + 1, "at": now()} | event, sort_keys=True))

    def summary(self, spark: SparkSession, run_id: str) -> dict[str, Any]:
        """Status and the last outcome of each step, derived from the events."""
        own = join(self.root, "events", run_id)
        events = [_parsed(Files(spark).read_text(join(own, n)), "event") for n in Files(spark).children(own) if n.endswith(".json") and n[0] != "."]
        kinds = [e["kind"] for e in events if e]
        status = "completed" if "run_completed" in kinds else "failed" if "run_failed" in kinds else "unknown"
        return {"run_id": run_id, "status": status, "events": len(kinds), "steps": {e["node"]: e["kind"].removeprefix("node_") for e in events if e and e.get("node")}, "errors": sorted({e["error"] for e in events if e and e.get("error")})}


@dataclass
class Ownership:
    """Removes, on full runs, output folders of a pipeline that an earlier declaration made and this one does not.

    Only folders strictly below <run_root>/<pipeline> that the last inventory lists are ever removed; all are checked before the first goes.
    """

    root: str

    def reconcile(self, spark: SparkSession, pipeline: Pipeline, run_root: str, run_id: str, selective: bool) -> list[str]:
        if selective:
            return []
        files, at = Files(spark), join(self.root, "inventories", f"{pipeline.name}.json")
        managed = join(run_root, pipeline.name)
        own = sorted(n.folder for n in nodes(pipeline, run_root) if n.step.persist and not pipeline.stages[n.stage - 1].root)
        old = _parsed(files.read_text(at), "inventory") or {}
        listed = old.get("folders") if old.get("managed") == managed else None
        gone = sorted(set(listed) - set(own)) if isinstance(listed, list) and all(isinstance(x, str) for x in listed) else []
        for x in gone:
            if not x.startswith(managed + "/") or ".." in x.split("/"):
                raise RecordError("an inventory lists a folder outside the pipeline's own")
        gone = [x for x in gone if not any(o == x or o.startswith(x + "/") for o in own)]
        for x in gone:
            files.delete(x)
        files.write_text(at, json.dumps({"format": FORMAT, "pipeline": pipeline.name, "managed": managed, "run_id": run_id, "folders": own, "at": now()}))
        return gone


class Lease:
    """Keeps two runs of one pipeline apart, as long as both ask: a log of holders, of whom the last holds it, and a heartbeat in the holder's entry. Advisory.

    A number is published once, so of two runs that find a lease free, or stale, one gets it. Its number is kept in `number` and only grows, so that what a holder writes
    elsewhere can be told from what its predecessors wrote late. A lease whose heartbeat is older than stale seconds is taken over, and that is recorded. A
    lease that cannot be read is taken for held.
    """

    def __init__(self, root: str, heartbeat: float = 10.0, stale: float = 60.0, clock: Callable[[], float] = time.time, store: Callable[[SparkSession], Store] = SparkStore):
        if not 0 < heartbeat < stale:
            raise ValueError("the heartbeat must be shorter than the time after which a lease is stale")
        self.root, self.heartbeat, self.stale, self._clock, self._store = root, heartbeat, stale, clock, store
        self.holder = uuid.uuid4().hex
        self.number = 0
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None
        self._failed: str | None = None

    def _log(self, spark: SparkSession, pipeline: str) -> Log:
        return Log(self._store(spark), join(self.root, "leases", pipeline))

    def _record(self, pipeline: str, run_id: str, **more: Any) -> dict[str, Any]:
        return {"format": FORMAT, "pipeline": pipeline, "run_id": run_id, "holder": self.holder, "host": socket.gethostname(), "pid": os.getpid(), "beat": self._clock()} | more

    def _left(self, text: str, pipeline: str) -> dict[str, Any] | None:
        """The record of a holder that is no longer alive; None of one that has given its lease back."""
        held = _parsed(text, "lease")
        if held is None or not isinstance(held.get("beat"), int | float):
            raise LeaseHeldError(f"the lease of {pipeline!r} cannot be read, so it counts as held")
        if held.get("released"):
            return None
        if self._clock() - held["beat"] < self.stale:
            raise LeaseHeldError(f"run {held.get('run_id')} of {pipeline!r} is alive")
        return held

    def enter(self, spark: SparkSession, pipeline: str, run_id: str) -> None:
        log, single = self._log(spark, pipeline), join(self.root, "leases", f"{pipeline}.json")  # the latter of before there were numbers
        store, last = log.store, log.last()
        texts = [t for t in (store.read_text(single), store.read_text(log.at(last)) if last else None) if t is not None]
        left = [x for x in (self._left(t, pipeline) for t in texts) if x]
        number, record = last + 1, self._record(pipeline, run_id)
        if not log.take(number, record):
            raise LeaseHeldError(f"another run of {pipeline!r} took the lease first")
        if log.last() != number:  # the number had been used and cleared away before
            store.delete(log.at(number))
            raise LeaseHeldError(f"another run of {pipeline!r} took the lease first")
        self.number = number
        for held in left:
            store.replace(join(self.root, "recoveries", pipeline, f"{run_id}.json"), json.dumps({"format": FORMAT, "pipeline": pipeline, "run_id": run_id, "taken_from": held, "at": now()}))
        for n in log.numbers():  # only after the new number is there, so that none is used twice
            if n < number:
                store.delete(log.at(n))
        store.delete(single)

        def beat() -> None:
            while not self._stop.wait(self.heartbeat):
                try:
                    if log.last() != number:
                        self._failed = "another run took the lease"
                        return
                    store.replace(log.at(number), json.dumps(self._record(pipeline, run_id)))
                except Exception as e:  # told when the run ends
                    self._failed = f"a heartbeat failed: {type(e).__name__}"
                    return

        self._failed = None
        self._stop.clear()
        self._thread = threading.Thread(target=beat, daemon=True)
        self._thread.start()

    def exit(self, spark: SparkSession, pipeline: str, outcome: str | None = None) -> None:
        self._stop.set()
        if self._thread:
            self._thread.join()
        log = self._log(spark, pipeline)
        if self.number and log.last() == self.number:
            log.store.replace(log.at(self.number), json.dumps(self._record(pipeline, "", released=True)))
        elif self.number and not self._failed:
            self._failed = "another run took the lease"
        if self._failed:
            raise LeaseHeldError(f"the lease of {pipeline!r} was not kept: {self._failed}")


def production(root: str, heartbeat: float = 10.0, stale: float = 60.0, required: bool = True) -> dict[str, Any]:
    """The arguments of run() for commits, run log, ownership and a lease, all below one folder."""
    if not root.strip():
        raise ValueError("the folder of the records is empty")
    return {"commits": Commits(root), "observers": [RunLog(root, required=required)], "ownership": Ownership(root), "lease": Lease(root, heartbeat, stale)}
