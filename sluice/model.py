"""Names, errors and the step context that the library shares."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import SparkSession

#: Column that names each record, unique within a frame.
KEY = "key"
#: Reserved column with the source of a record.
SOURCE = "__source__"
#: Column of records that are a bare text or binary.
CONTENT = "content"


class KeyCollisionError(Exception):
    """Two sources, or two routes, give the same key."""


class InvalidKeyError(ValueError):
    """A key is null, empty, absolute, or leaves its folder."""


class MissingSourceTagError(Exception):
    """Routing by source meets a record without a source."""


class MissingPriorOutputError(Exception):
    """A selective run needs output that has no committed record."""


class EmptyOutputError(Exception):
    """A dataset that takes no empty output was given one."""


class RecordError(Exception):
    """A commit record contradicts the declaration, or the files it speaks of."""


class RecordVersionError(RecordError):
    """A commit record has a format that this version does not know."""


class LeaseHeldError(RuntimeError):
    """Another run of the same pipeline is alive."""


class PublishError(OSError):
    """A file cannot be published, or its store has no way to let one writer only do so."""


class ObserverError(RuntimeError):
    """An observer that a run requires has failed."""


@dataclass(frozen=True)
class StepContext:
    """What a step may know about its run; steps build DataFrames and do no I/O."""

    spark: SparkSession
    run_root: str
    pipeline: str
    run_id: str
    stage: str
    stage_index: int
    step: str
    step_index: int
    persist: bool
    step_dir: str
    prior_dir: str | None
    params: Mapping[str, str]
    logger: logging.Logger
