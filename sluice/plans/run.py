"""Running a pipeline: steps build DataFrames in order, persisted ones are checked and committed, and Spark does the rest.

A persisted step is written to a staging folder beside its own, its rows being counted on the way; one shuffle of the keys of what was written checks
them (those that become file names are checked before there is a file), counts them, and makes the key table of the commit record; the old record is withdrawn, the files are moved into place, and the new
record is published. A crash in between leaves no record, so nothing reads what is half done; a failed check leaves output and record as they were. The next step reads the committed files, which ends the lineage there. Steps that are not persisted stay lazy: their
completion means that their plan was built.

A branch reads its input once, in a write with a folder for each route.

A selective run (one stage, or one step of it) starts from the committed output of the step before, and fails before any
job if that is not to be had.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..model import MissingPriorOutputError, ObserverError, RecordError, StepContext
from ..operators.keyed import KeyFacts, bucket_facts, fan_out, merge_routes, strip_source
from ..sources.files import Files, join, shared_dir
from .pipeline import Branch, Node, Pipeline, Step, nodes
from .records import Commits, Lease, Ownership

log = logging.getLogger("sluice")
DEFAULT_ROOT = "data/output"
#: Keys are compared by buckets of about so many, up to so many buckets.
BUCKET_ROWS, MOST_BUCKETS = 50_000, 4096


@dataclass(frozen=True)
class RunResult:
    run_root: str
    run_id: str
    #: What the last entry gave, read from its files if it was persisted.
    output: DataFrame | None
    observer_errors: tuple[str, ...] = ()


def _stage_number(pipeline: Pipeline, stage: int | str) -> int:
    if isinstance(stage, int):
        if not 1 <= stage <= len(pipeline.stages):
            raise ValueError(f"there is no stage {stage}; stages are 1 to {len(pipeline.stages)}")
        return stage
    names = [s.name for s in pipeline.stages]
    if stage not in names:
        raise ValueError(f"there is no stage {stage!r}: {names}")
    return names.index(stage) + 1


def _entry_number(pipeline: Pipeline, stage: int, step: int | str) -> int:
    """The entry of a step; steps are counted without branches."""
    steps = [(k, e.name) for k, e in enumerate(pipeline.stages[stage - 1].entries, 1) if isinstance(e, Step)]
    if isinstance(step, int):
        if not 1 <= step <= len(steps):
            raise ValueError(f"there is no step {step}; steps are 1 to {len(steps)}")
        return steps[step - 1][0]
    found = [k for k, n in steps if n == step]
    if not found:
        raise ValueError(f"there is no step {step!r}: {[n for _, n in steps]}")
    return found[0]


@dataclass(frozen=True)
class Bound:
    """A declaration bound to a folder and a selection: what a run would do, to look at before it does."""

    pipeline: Pipeline
    run_root: str
    nodes: tuple[Node, ...]
    #: The chosen stage, and the chosen entry of it; None for all.
    stage: int | None = None
    entry: int | None = None

    @property
    def selective(self) -> bool:
        return self.stage is not None

    def entries(self) -> list[tuple[int, int, Any]]:
        """(stage, entry, step or branch) of what runs."""
        every = [(i, j, e) for i, s in enumerate(self.pipeline.stages, 1) for j, e in enumerate(s.entries, 1)]
        return [x for x in every if self.stage in (None, x[0]) and self.entry in (None, x[1])]

    def runs(self, node: Node) -> bool:
        return self.stage in (None, node.stage) and self.entry in (None, node.entry)

    def before(self) -> tuple[int, int, Any] | None:
        """The entry before the first that runs; None if a run starts at the source."""
        chosen = self.entries()
        every = [(i, j, e) for i, s in enumerate(self.pipeline.stages, 1) for j, e in enumerate(s.entries, 1)]
        return next((x for x in reversed(every) if chosen and x[:2] < chosen[0][:2]), None)

    def emptied(self) -> list[str]:
        """The folders of stages that are emptied before they run."""
        return [self.base(i) for i in sorted({i for i, _, _ in self.entries()}) if self.pipeline.stages[i - 1].clean]

    def base(self, i: int) -> str:
        """A stage's folder."""
        stage = self.pipeline.stages[i - 1]
        return str(stage.root).rstrip("/") if stage.root else f"{self.run_root.rstrip('/')}/{self.pipeline.name}/{i:03d}_{stage.name}"

    def describe(self) -> list[dict[str, Any]]:
        """A row for each step: its id, folder, route, and whether it runs and is persisted."""
        return [{"node": n.id, "step": n.step.name, "folder": n.folder, "route": n.route, "runs": self.runs(n), "persist": n.step.persist} for n in self.nodes]


def bind(pipeline: Pipeline, run_root: str | None = None, stage: int | str | None = None, step: int | str | None = None) -> Bound:
    """What run() with these arguments would do. Nothing is read; a selection that does not fit the declaration is an error."""
    root = str(run_root or DEFAULT_ROOT)
    if step is not None and stage is None:
        raise ValueError("a step is chosen within a stage")
    at = _stage_number(pipeline, stage) if stage is not None else None
    entry = _entry_number(pipeline, at, step) if step is not None else None
    if entry is not None and entry > 1 and pipeline.stages[at - 1].clean:
        raise ValueError("a stage that empties its folder cannot start at a later step")
    return Bound(pipeline, root, tuple(nodes(pipeline, root)), at, entry)


class _Run:
    def __init__(self, spark, bound, keep_source, params, context, commits, observers):
        self.spark, self.bound, self.keep, self.params, self.context = spark, bound, keep_source, dict(params or {}), context
        self.pipeline, self.root, self.nodes, self.selective = bound.pipeline, bound.run_root, bound.nodes, bound.selective
        self.commits, self.observers, self.errors = commits, observers, []
        self.id, self.files = uuid.uuid4().hex, Files(spark)
        self.prior = self._prior()

    def _prior(self) -> Node | None:
        """The step whose committed output a selective run starts from; None if it starts at the source."""
        if (before := self.bound.before()) is None:
            return None
        i, j, e = before
        what = f"step {e.name!r} of stage {self.pipeline.stages[i - 1].name!r}"
        if self.commits is None:
            raise MissingPriorOutputError(f"this run needs the output of {what}, and there are no commit records to trust")
        if isinstance(e, Branch) or not e.persist:
            raise MissingPriorOutputError(f"this run needs the output of {what}, which is not persisted by itself")
        return next(n for n in self.nodes if (n.stage, n.entry) == (i, j))

    def tell(self, kind: str, node: Node | None = None, error: BaseException | None = None, rows: int | None = None) -> None:
        event = {"kind": kind, "pipeline": self.pipeline.name, "run_id": self.id, "selective": self.selective, "node": node.id if node else None, "step": node.step.name if node else None, "error": type(error).__name__ if error else None, "rows": rows}
        for o in self.observers:
            try:
                o.on_event(self.spark, event)
            except Exception as e:
                if getattr(o, "required", False):
                    raise ObserverError(f"a required observer failed on {kind}: {type(e).__name__}") from e
                self.errors.append(f"an observer failed on {kind}: {type(e).__name__}")
                log.error(self.errors[-1])

    def _write(self, node: Node, df: DataFrame) -> tuple[DataFrame, int]:
        output, stage = node.step.output, self.pipeline.stages[node.stage - 1].name
        folder = f"{node.folder}.staging-{self.id}"
        aside = f"{folder}/{node.folder.rpartition('/')[2]}"
        late = getattr(output, "validates_written", False)
        held = df if late else df.persist()
        facts, metrics = None, {}
        try:
            if late:
                seen, extra = Observation(), getattr(output, "metrics", None) or {}
                self._save(node, df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(f"own {n}") for n, c in extra.items()]), aside)
                wrote, metrics = seen.get["rows"], {n: seen.get[f"own {n}"] for n in extra}
                if output.exists(self.spark, aside):
                    rows, facts = self._facts(node, output.load_from(self.spark, aside), wrote)
                    self._read_back(node, rows, wrote)
                else:  # partitioned, and without rows
                    rows = output.validate(df.limit(0))
            else:  # keys become file names, so they are checked before there are files
                rows, facts = self._facts(node, held, held.count() if self._key_table(node) else 0)
                if rows:
                    self._save(node, held, aside)
            self._withdraw(node)
            self.files.delete(node.folder)
            self.files.rename(aside, node.folder) if rows else self.files.mkdirs(node.folder)
        except BaseException:
            if at := self._key_table(node):
                self.files.delete(at)
            raise
        finally:
            self.files.delete(folder)
            if not late:
                held.unpersist()
        out = output.load_from(self.spark, node.folder) if rows else df.limit(0)
        if rows and not late:
            there = bucket_facts(output.keys_at(self.spark, node.folder), facts.of) if facts else None
            self._read_back(node, there.rows if there else out.count(), rows)
            if there and there != facts:
                raise RecordError(f"step {node.step.name!r} wrote other keys than its own")
        if self.commits:
            self.commits.publish(self.spark, self.pipeline.name, stage, node, self.id, rows, facts, **({"metrics": metrics} if metrics else {}))
        return out, rows

    def _save(self, node: Node, df: DataFrame, aside: str) -> None:
        try:
            node.step.output.save(df, aside)
        except Exception:
            self._withdraw(node)
            raise

    def _key_table(self, node: Node) -> str | None:
        """Where the keys of a step's output are kept with its record."""
        at = getattr(self.commits, "keys_at", None)
        return at(self.pipeline.name, node, self.id) if at and getattr(node.step.output, "has_keys", bool)() else None

    def _facts(self, node: Node, df: DataFrame, rows: int) -> tuple[int, KeyFacts | None]:
        """(rows, facts of the keys) of valid output."""
        output, at = node.step.output, self._key_table(node)
        facts = output.facts(df, min(MOST_BUCKETS, 1 + rows // BUCKET_ROWS), at) if hasattr(output, "facts") else None
        return (facts.rows, facts) if facts else (output.validate(df), None)

    def _read_back(self, node: Node, there: int, wrote: int) -> int:
        if there != wrote:
            raise RecordError(f"step {node.step.name!r} wrote {wrote} rows, but {there} are read back")
        return there

    def _withdraw(self, node: Node) -> None:
        if self.commits:
            self.commits.withdraw(self.spark, self.pipeline.name, node)

    def _step(self, node: Node, df: DataFrame, prior: str | None) -> DataFrame:
        ctx = StepContext(self.spark, self.root, self.pipeline.name, self.id, self.pipeline.stages[node.stage - 1].name, node.stage, node.step.name, node.route_step or node.entry, node.step.persist, node.folder, prior, self.params, log)
        own = self.context(ctx) if self.context else ctx
        if not isinstance(own, StepContext) and not isinstance(getattr(own, "base", None), StepContext):
            raise TypeError("the context function gives a StepContext, or an object that has one as .base")
        self.tell("node_started", node)
        log.info("step %s/%s starts (persist=%s)", ctx.stage, node.step.name, node.step.persist)
        try:
            made = node.step.fn(df, context=own)
            if not isinstance(made, DataFrame):
                raise TypeError(f"step {node.step.name!r} gave {type(made).__name__}, not a DataFrame")
            made = made if self.keep else strip_source(made)
            out, rows = self._write(node, made) if node.step.persist else (made, None)
        except ObserverError:
            raise
        except Exception as e:
            self.tell("node_failed", node, e)
            raise
        self.tell("node_completed", node, rows=rows)
        return out

    def _branch(self, i: int, j: int, branch: Branch, df: DataFrame) -> DataFrame:
        """All routes run, those without records too; their input is read once."""
        at, out = join(shared_dir(self.spark), f"fan-{uuid.uuid4().hex}"), {}
        parts, counts = fan_out(df, branch.by, list(branch.routes), branch.name, at)
        log.info("branch %s: %s", branch.name, counts)
        for route, part in parts.items():
            prior = None
            for node in (n for n in self.nodes if (n.stage, n.entry, n.route) == (i, j, route)):
                part = self._step(node, part, prior)
                prior = node.folder
            out[route] = part
        merged = merge_routes(out)
        if all(s and s[-1].persist for s in branch.routes.values()):
            self.files.delete(at)  # else the merged frame still reads it
        return merged

    def go(self) -> DataFrame | None:
        df, prior, cleaned = None, None, set()
        entries = self.bound.entries()
        if self.prior is not None:
            df = self.commits.load(self.spark, self.pipeline.name, self.pipeline.stages[self.prior.stage - 1].name, self.prior)
            if df is None:
                raise MissingPriorOutputError(f"step {self.prior.step.name!r} has no commit record; run it first")
            prior = self.prior.folder
            self.tell("node_skipped", self.prior)
        elif entries:
            df = self.pipeline.source.load(self.spark)
        last_stage = self.prior.stage if self.prior else None
        for i, j, e in entries:
            if self.pipeline.stages[i - 1].clean and i not in cleaned:
                cleaned.add(i)
                base = self.bound.base(i)
                for name in self.files.children(base):
                    self.files.delete(f"{base}/{name}")
            if last_stage not in (None, i) and "key" not in df.columns:
                raise TypeError(f"what stage {self.pipeline.stages[last_stage - 1].name!r} hands on has no keys")
            if isinstance(e, Branch):
                df, prior = self._branch(i, j, e, df), None
            else:
                node = next(n for n in self.nodes if (n.stage, n.entry) == (i, j))
                df, prior = self._step(node, df, prior), node.folder
            last_stage = i
        return df


def check_extensions(commits: Any = None, observers: list[Any] | None = None, guards: list[Any] | None = None, ownership: Any = None) -> None:
    """Raises unless each part has the methods of its role, an observer's `required` is a bool, none is given twice, and those that have a plugin_id have one each: a path segment."""
    roles = [(commits, "commit store", ("withdraw", "publish", "load")), (ownership, "owner of folders", ("reconcile",))]
    roles += [(o, "observer", ("on_event",)) for o in observers or []] + [(g, "guard", ("enter", "exit")) for g in guards or []]
    for part, role, methods in roles:
        lacking = [m for m in methods if part is not None and not callable(getattr(part, m, None))]
        if lacking:
            raise TypeError(f"a {role} of type {type(part).__name__} has no {', '.join(lacking)}")
    for o in observers or []:
        if not isinstance(getattr(o, "required", False), bool):
            raise TypeError(f"an observer of type {type(o).__name__} must be required or not")
    ids = [p.plugin_id for p in {id(p): p for p in (commits, ownership, *(observers or []), *(guards or []))}.values() if getattr(p, "plugin_id", None) is not None]
    for x in ids:
        if not isinstance(x, str) or not x or "/" in x or "\\" in x or x in (".", ".."):
            raise ValueError(f"plugin id {x!r} is not one path segment")
    if len(set(ids)) < len(ids):
        raise ValueError(f"a plugin id is given twice: {sorted(x for x in set(ids) if ids.count(x) > 1)}")
    for name, parts in (("observer", observers or []), ("guard", guards or [])):
        if len({id(x) for x in parts}) < len(parts):
            raise ValueError(f"one {name} is given twice")


def run(
    spark: SparkSession,
    pipeline: Pipeline,
    run_root: str | None = None,
    stage: int | str | None = None,
    step: int | str | None = None,
    keep_source: bool = False,
    params: Mapping[str, str] | None = None,
    context: Callable[[StepContext], Any] | None = None,
    commits: Commits | None = None,
    observers: list[Any] | None = None,
    ownership: Ownership | None = None,
    lease: Lease | None = None,
    guards: list[Any] | None = None,
) -> RunResult:
    """Runs a pipeline, or one stage or step of it.

    Guards are entered in order, the lease first, before anything else, and left in reverse with the outcome, `completed` or `failed`. All that were entered
    are left; an error of theirs is raised only if nothing failed before it.
    """
    guards = [*([lease] if lease else []), *(guards or [])]
    check_extensions(commits, observers, guards, ownership)
    own = _Run(spark, bind(pipeline, run_root, stage, step), keep_source, params, context, commits, list(observers or []))
    failure: BaseException | None = None
    entered: list[Any] = []
    try:
        for g in guards:
            g.enter(spark, pipeline.name, own.id)
            entered.append(g)
        own.tell("run_started")
        if ownership:
            ownership.reconcile(spark, pipeline, own.root, own.id, own.selective)
        out = own.go()
        own.tell("run_completed")
    except BaseException as e:
        failure = e
        if not isinstance(e, ObserverError) and len(entered) == len(guards):
            try:
                own.tell("run_failed", error=e)
            except ObserverError as told:
                log.error("%s", told)
        raise
    finally:
        late: Exception | None = None
        for g in reversed(entered):
            try:
                g.exit(spark, pipeline.name, "failed" if failure or late else "completed")
            except Exception as e:
                log.error("a guard could not be left: %s", type(e).__name__)
                late = late or e
        if late is not None and failure is None:
            raise late
    return RunResult(own.root, own.id, out, tuple(own.errors))
