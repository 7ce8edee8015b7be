"""Declarations: a pipeline is a source and ordered stages; a stage is ordered steps and branches over one keyed frame.

A step is a function (df, context) -> DataFrame that builds a plan; nothing runs until a persisted step is written. Steps that are not
persisted melt into the next job.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame

from ..sources.datasets import Dataset, ParquetDataset

_NAME = re.compile(r"[^/\\]+")


def _named(name: str, what: str) -> str:
    if not isinstance(name, str) or not _NAME.fullmatch(name) or name in (".", "..") or not name.strip():
        raise ValueError(f"{what} name {name!r} is not one path segment")
    return name


@dataclass
class Step:
    fn: Callable[..., DataFrame]
    output: Dataset = field(default_factory=ParquetDataset)
    persist: bool = True
    name: str = ""

    def __post_init__(self) -> None:
        if not callable(self.fn):
            raise TypeError("Step.fn is a function")
        if not isinstance(self.output, Dataset):
            raise TypeError(f"Step.output is a dataset, not {type(self.output).__name__}")
        self.name = _named(self.name or getattr(self.fn, "__name__", type(self.fn).__name__), "step")
        if self.output.name is None:
            self.output.name = self.name

        if not isinstance(self.persist, bool):
            raise TypeError("Step.persist is a bool")

    def __call__(self, df: DataFrame, context: Any = None) -> DataFrame:
        """A step can be called as the function it was made of."""
        return self.fn(df, context=context)

    @staticmethod
    def of(entry: Any) -> Step:
        if isinstance(entry, Step):
            return entry
        if not callable(entry):
            raise TypeError(f"{type(entry).__name__} is no step")
        return Step(entry)


def step(*, output: Dataset, persist: bool = True) -> Callable[[Any], Step]:
    """Makes a Step of the function below it; a further one above it takes the function with its own output."""
    if not isinstance(output, Dataset):
        raise TypeError(f"output is a dataset, not {type(output).__name__}")
    return lambda fn: Step(fn.fn if isinstance(fn, Step) else fn, output, persist)


@dataclass
class Branch:
    """Routes records by source or by a string column to chains of steps, and merges the outcomes."""

    name: str
    by: str | Column
    routes: dict[str, list[Any]]

    def __post_init__(self) -> None:
        _named(self.name, "branch")
        if not self.routes:
            raise ValueError(f"branch {self.name!r} has no routes")
        for route, steps in self.routes.items():
            _named(route, "route")
            for s in steps:
                if not isinstance(s, Step):
                    raise TypeError(f"a step of route {route!r} has no declared output")
            own = self.routes[route] = [Step.of(s) for s in steps]
            if len({s.name for s in own}) < len(own):
                raise ValueError(f"route {route!r} names a step twice")


@dataclass
class Stage:
    name: str
    entries: list[Any]
    #: Replaces the stage's folder; such folders are never pruned.
    root: str | None = None
    #: Empties the stage's folder before its first entry runs.
    clean: bool = False

    def __post_init__(self) -> None:
        _named(self.name, "stage")
        if self.root is not None and not str(self.root).strip():
            raise ValueError("Stage.root is empty")
        if not isinstance(self.clean, bool):
            raise TypeError("Stage.clean is a bool")
        self.entries = [e if isinstance(e, Branch) else Step.of(e) for e in self.entries]


@dataclass
class Pipeline:
    name: str
    source: Any
    stages: list[Stage]

    def __post_init__(self) -> None:
        _named(self.name, "pipeline")
        if not hasattr(self.source, "load"):
            raise TypeError("Pipeline.source has no load()")
        names = [s.name for s in self.stages]
        if len(set(names)) < len(names):
            raise ValueError("two stages have one name")


@dataclass(frozen=True)
class Node:
    """One step, in a stage or in a route of a branch."""

    id: str
    stage: int
    entry: int
    step: Step
    folder: str
    route: str | None = None
    route_step: int | None = None


def nodes(pipeline: Pipeline, run_root: str) -> list[Node]:
    """Every step with its number-based id (renaming keeps it) and its folder below run_root."""
    out = []
    for i, stage in enumerate(pipeline.stages, 1):
        base = str(stage.root).rstrip("/") if stage.root else f"{run_root.rstrip('/')}/{pipeline.name}/{i:03d}_{stage.name}"
        for j, entry in enumerate(stage.entries, 1):
            at, folder = f"s{i:03d}-e{j:03d}", f"{base}/{j:03d}_{entry.name}"
            if isinstance(entry, Step):
                out.append(Node(at, i, j, entry, folder))
            else:
                for r, (route, steps) in enumerate(entry.routes.items(), 1):
                    out += [Node(f"{at}-r{r:03d}-{k:03d}", i, j, s, f"{folder}/{route}/{s.name}", route, k) for k, s in enumerate(steps, 1)]
    return out


def graph(pipeline: Pipeline) -> list[dict[str, Any]]:
    """Every node of the flow in order: steps, and for a branch its fan-out, the steps of its routes, and its merge; `inputs` names what each reads.

    A reference is `source`, the id of a node, or `<fan-out>:<route>` for what a fan-out gives a route.
    """
    steps, out, last = nodes(pipeline, ""), [], "source"

    def add(ident: str, kind: str, stage: str, name: str, inputs: list[str], step: Step | None = None, route: str | None = None) -> str:
        dataset = {"dataset": type(step.output).__name__, "dataset_name": step.output.name, "persist": step.persist} if step else {}
        out.append({"id": ident, "kind": kind, "stage": stage, "name": name, "inputs": inputs, "route": route} | dataset)
        return ident

    for i, stage in enumerate(pipeline.stages, 1):
        for j, entry in enumerate(stage.entries, 1):
            at = f"s{i:03d}-e{j:03d}"
            if isinstance(entry, Step):
                last = add(at, "step", stage.name, entry.name, [last], entry)
                continue
            add(f"{at}-fan", "fan_out", stage.name, entry.name, [last])
            ends = []
            for route in entry.routes:
                end = f"{at}-fan:{route}"
                for n in (n for n in steps if (n.stage, n.entry, n.route) == (i, j, route)):
                    end = add(n.id, "route_step", stage.name, n.step.name, [end], n.step, route)
                ends.append(end)
            last = add(f"{at}-merge", "merge", stage.name, entry.name, ends)
    return out


def snapshot(pipeline: Pipeline) -> str:
    """The declaration as JSON that is the same whenever the declaration is: no folders, no run."""
    branches = [{"stage": s.name, "branch": e.name, "routes": list(e.routes), "by": "source" if isinstance(e.by, str) else "column"} for s in pipeline.stages for e in s.entries if isinstance(e, Branch)]
    return json.dumps({"pipeline": pipeline.name, "nodes": graph(pipeline), "branches": branches}, sort_keys=True, separators=(",", ":"))


def mermaid(pipeline: Pipeline) -> str:
    """A flow chart of stages, steps and branches."""
    clean = lambda s: s.replace('"', "'")
    lines, last = ["flowchart TD", f'  source["{clean(getattr(pipeline.source, "name", "source"))}"]'], "source"
    for i, stage in enumerate(pipeline.stages, 1):
        lines.append(f'  subgraph stage{i}["{clean(stage.name)}"]')
        links = []
        for j, e in enumerate(stage.entries, 1):
            own = f"s{i}e{j}"
            if isinstance(e, Step):
                lines.append(f'    {own}["{clean(e.name)}{"" if e.persist else " (not persisted)"}"]')
                links.append(f"  {last} --> {own}")
                last = own
            else:
                lines += [f'    {own}{{"{clean(e.name)}"}}', f'    {own}m(("merge"))']
                links.append(f"  {last} --> {own}")
                links += [f'  {own} -- "{clean(r)}" --> {own}m' for r in e.routes]
                last = f"{own}m"
        lines += ["  end", *links]
    return "\n".join(lines) + "\n"
