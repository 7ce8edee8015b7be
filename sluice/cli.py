"""A command line for a pipeline: run it, run a part of it, or draw it."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

from .model import MissingPriorOutputError
from .plans.pipeline import Pipeline, mermaid
from .plans.run import run


def _number_or_name(text: str) -> int | str:
    return int(text) if text.isdecimal() else text


def params_of(pairs: Sequence[str]) -> dict[str, str]:
    """k=v pairs; the first = splits. Errors do not repeat values."""
    out = {}
    for pair in pairs:
        name, eq, value = pair.partition("=")
        if not eq or not name:
            raise ValueError("a parameter is written as name=value")
        out[name] = value
    return out


def make_cli(pipeline: Pipeline, session: Callable[[str | None], SparkSession] | None = None, **options) -> Callable[[Sequence[str] | None], int]:
    """main(argv) for a pipeline; options go to run()."""

    def start(master: str | None) -> SparkSession:
        builder = SparkSession.builder.appName(pipeline.name)
        return (builder.master(master) if master else builder).getOrCreate()

    def main(argv: Sequence[str] | None = None) -> int:
        p = argparse.ArgumentParser(prog=pipeline.name)
        p.add_argument("--run-root")
        p.add_argument("--stage", type=_number_or_name, help="number from 1, or name")
        p.add_argument("--step", type=_number_or_name, help="number from 1 among the stage's steps, or name")
        p.add_argument("--param", action="append", default=[], metavar="NAME=VALUE")
        p.add_argument("--keep-source", action="store_true", help="leave the source column in outputs")
        p.add_argument("--mermaid", metavar="FILE", help="write a flow chart and run nothing")
        p.add_argument("--master", help="Spark master")
        args = p.parse_args(argv)
        if args.mermaid:
            with open(args.mermaid, "w", encoding="utf-8") as f:
                f.write(mermaid(pipeline))
            return 0
        try:
            params = params_of(args.param)
            run((session or start)(args.master), pipeline, args.run_root, args.stage, args.step, args.keep_source, params, **options)
        except (ValueError, MissingPriorOutputError) as e:
            p.error(str(e))
        return 0

    return main
