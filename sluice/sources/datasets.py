"""Where a step's output lives, and how it is read again.

ParquetDataset is the native form: a keyed frame of any schema as a Parquet table. The file datasets keep one file for each key
(`<dest>/<key><suffix>`, slashes in keys are folders) or one file for the whole, for exchange with other tools; tasks list, read and write the files
(see keyed_files), so neither records nor names pass the driver. Folders that only Hadoop's file systems reach are read by Spark's `binaryFile`.

All take part in the same protocol: validate before anything is touched, save into an empty folder, tell which keys are there, load from a
folder, and give an empty frame for a committed empty output.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import KEY, EmptyOutputError, InvalidKeyError
from ..operators.keyed import KeyFacts, check_keys, key_facts
from . import keyed_files
from .files import Files, join, leaf


@runtime_checkable
class Dataset(Protocol):
    """What a step's output needs."""

    name: str | None

    def load(self, spark: SparkSession) -> DataFrame: ...

    def validate(self, df: DataFrame) -> int: ...

    def save(self, df: DataFrame, dest: str) -> None: ...

    def exists(self, spark: SparkSession, dest: str) -> bool: ...

    def describe(self) -> dict[str, Any]: ...


@runtime_checkable
class Loadable(Protocol):
    """Output that can be read from the folder it was saved to, which a selective run needs."""

    def load_from(self, spark: SparkSession, dest: str) -> DataFrame: ...


@runtime_checkable
class EmptyLoadable(Protocol):
    """Output that may have been empty when it was committed."""

    def committed_empty(self, spark: SparkSession) -> DataFrame: ...


@runtime_checkable
class Inspectable(Protocol):
    """Output whose keys can be told from its files, and held against a record."""

    def has_keys(self) -> bool: ...

    def keys_at(self, spark: SparkSession, dest: str) -> DataFrame | None: ...

    def facts(self, df: DataFrame, of: int = 1, at: str | None = None) -> KeyFacts | None: ...


@dataclass
class _Base:
    name: str | None = None
    path: str | None = None
    allow_empty: bool = False
    #: Options of Spark's readers and writers, such as credentials; never shown by describe().
    storage_options: dict[str, str] | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        if not isinstance(self.allow_empty, bool):
            raise TypeError("allow_empty is a bool")

    def load(self, spark: SparkSession) -> DataFrame:
        if self.path is None:
            raise FileNotFoundError(f"dataset {self.name!r} has no path to load")
        return self.load_from(spark, self.path)

    def load_from(self, spark: SparkSession, dest: str) -> DataFrame:
        raise NotImplementedError

    #: Whether the written output is what gets validated; else the frame is, before any file is made.
    validates_written = False

    def has_keys(self) -> bool:
        return False

    def _counted(self, rows: int) -> int:
        if not rows and not self.allow_empty:
            raise EmptyOutputError(f"dataset {self.name!r} takes no empty output")
        return rows

    def facts(self, df: DataFrame, of: int = 1, at: str | None = None) -> KeyFacts | None:
        """validate() with what it found of the keys, in `of` buckets, and the keys written to `at` if given; None for output without keys."""
        if not self.has_keys():
            return None
        found = key_facts(df, of, at)
        self._counted(found.rows)
        return found

    def describe(self) -> dict[str, Any]:
        return {"type": type(self).__name__, "name": self.name, "path": self.path, "allow_empty": self.allow_empty, "storage_options_configured": bool(self.storage_options)}


@dataclass
class ParquetDataset(_Base):
    """A frame as Parquet; keyed frames have their keys checked, others (keyed=False) only their count."""

    schema: T.StructType | str | None = None
    keyed: bool = True
    partition_by: tuple[str, ...] = ()
    #: Aggregates that are taken while the frame is written, and kept in the commit record; numbers, texts or sketches.
    metrics: dict[str, Column] | None = None

    validates_written = True

    def has_keys(self) -> bool:
        return self.keyed

    def load_from(self, spark: SparkSession, dest: str) -> DataFrame:
        reader = spark.read.options(**self.storage_options or {})
        return (reader.schema(self.schema) if self.schema else reader).parquet(dest)

    def validate(self, df: DataFrame) -> int:
        return self._counted(check_keys(df) if self.keyed else df.count())

    def save(self, df: DataFrame, dest: str) -> None:
        df.write.mode("overwrite").options(**self.storage_options or {}).partitionBy(*self.partition_by).parquet(dest)

    def written_rows(self, spark: SparkSession, dest: str) -> int:
        """The rows that the files' footers count."""
        return spark.read.options(**self.storage_options or {}).parquet(dest).count()

    def exists(self, spark: SparkSession, dest: str) -> bool:
        return Files(spark).any(dest, ".parquet")

    def committed_empty(self, spark: SparkSession) -> DataFrame:
        if not self.allow_empty:
            raise EmptyOutputError(f"dataset {self.name!r} no longer takes empty output")
        if self.schema is None:
            raise EmptyOutputError(f"dataset {self.name!r} needs a schema to give an empty frame")
        return spark.createDataFrame([], self.schema)

    def keys_at(self, spark: SparkSession, dest: str) -> DataFrame | None:
        return self.load_from(spark, dest).select(KEY) if self.keyed else None


#: Kept under their old names, as tests and queries use them.
_named, _unnamed, _store = keyed_files.named, keyed_files.unnamed, keyed_files.store_of


@dataclass
class _Keyed(_Base):
    """One file for each key."""

    suffix: str = ""

    def has_keys(self) -> bool:
        return True

    def _body(self, df: DataFrame) -> DataFrame:
        """(key, body binary)."""
        raise NotImplementedError

    def _files(self, spark: SparkSession, dest: str) -> DataFrame:
        """(key, content binary) of the files below dest that end in the suffix, or of the one file that dest is."""
        if not keyed_files.reachable(dest):
            return self._hadoop_files(spark, dest)
        if Files(spark).is_file(dest):
            return keyed_files.contents(keyed_files.one(spark, dest, self.suffix), keyed_files.folder_of(dest), self.storage_options)
        return keyed_files.contents(keyed_files.listed(spark, dest, self.suffix, self.storage_options), dest, self.storage_options)

    def _hadoop_files(self, spark: SparkSession, dest: str) -> DataFrame:
        """The same through Spark's reader, for file systems that tasks do not reach by themselves; files are listed on the driver, empty ones once more."""
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{self.suffix}").options(**self.storage_options or {})
        at = Files(spark).qualified(dest).rstrip("/") + "/"
        key = F.udf(lambda path: _unnamed(path[len(at) : len(path) - len(self.suffix)]), "string", useArrow=True)
        found = reader.load(dest).select(key("path").alias(KEY), "content")
        empty = [(_unnamed(f[: len(f) - len(self.suffix)]), b"") for f in Files(spark).walk(dest, self.suffix, empty_only=True)]
        return found.unionByName(spark.createDataFrame(empty, f"{KEY} string, content binary")) if empty else found

    def validate(self, df: DataFrame) -> int:
        return self._counted(check_keys(df))

    def save(self, df: DataFrame, dest: str) -> None:
        files = Files(df.sparkSession)
        fresh = not files.children(dest)
        files.mkdirs(dest)
        keyed_files.write(self._body(df), dest, self.suffix, self.storage_options, fresh)

    def exists(self, spark: SparkSession, dest: str) -> bool:
        return Files(spark).any(dest, self.suffix)

    def committed_empty(self, spark: SparkSession) -> DataFrame:
        if not self.allow_empty:
            raise EmptyOutputError(f"dataset {self.name!r} no longer takes empty output")
        return spark.createDataFrame([], self._schema())

    def keys_at(self, spark: SparkSession, dest: str) -> DataFrame | None:
        """The keys of the files that are there, as a frame that tasks list."""
        if keyed_files.reachable(dest):
            return keyed_files.listed(spark, dest, self.suffix, self.storage_options).select(KEY)
        names = [(_unnamed(f[: len(f) - len(self.suffix)]),) for f in Files(spark).walk(dest, self.suffix)]
        return spark.createDataFrame(names, f"{KEY} string")

    def _schema(self) -> T.StructType | str:
        raise NotImplementedError


@dataclass
class KeyedJSON(_Keyed):
    """Records as JSON, one file a key. The schema has the record's columns, without the key."""

    schema: T.StructType | str | None = None
    suffix: str = ".json"

    def _fields(self) -> T.StructType:
        if self.schema is None:
            raise ValueError(f"dataset {self.name!r} needs the schema of its records")
        return self.schema if isinstance(self.schema, T.StructType) else T.StructType.fromDDL(self.schema)

    def _schema(self) -> T.StructType:
        return T.StructType([T.StructField(KEY, T.StringType()), *self._fields().fields])

    def load_from(self, spark: SparkSession, dest: str) -> DataFrame:
        record = F.from_json(F.decode("content", "UTF-8"), self._fields(), {"mode": "FAILFAST"})
        return self._files(spark, dest).select(KEY, record.alias("r")).select(KEY, "r.*")

    def _body(self, df: DataFrame) -> DataFrame:
        record = F.to_json(F.struct(*[c for c in df.columns if c != KEY]), {"ignoreNullFields": "false", "pretty": "true"})
        return df.select(KEY, F.encode(record, "UTF-8").alias("body"))


@dataclass
class KeyedText(_Keyed):
    """Texts, one file a key; column `value`."""

    suffix: str = ".txt"
    encoding: str = "UTF-8"

    def _schema(self) -> str:
        return f"{KEY} string, value string"

    def load_from(self, spark: SparkSession, dest: str) -> DataFrame:
        return self._files(spark, dest).select(KEY, F.decode("content", self.encoding).alias("value"))

    def _body(self, df: DataFrame) -> DataFrame:
        return df.select(KEY, F.encode(F.coalesce("value", F.lit("")), self.encoding).alias("body"))


@dataclass
class KeyedBinary(_Keyed):
    """Binaries, one file a key; column `value`."""

    suffix: str = ".bin"

    def _schema(self) -> str:
        return f"{KEY} string, value binary"

    def load_from(self, spark: SparkSession, dest: str) -> DataFrame:
        return self._files(spark, dest).select(KEY, F.col("content").alias("value"))

    def _body(self, df: DataFrame) -> DataFrame:
        return df.select(KEY, F.coalesce("value", F.lit(b"")).alias("body"))


@dataclass
class _Single(_Base):
    """One file for a frame of one row: `<dest>/<last name of dest><suffix>`, the name escaped as a key is."""

    suffix: str = ""

    def _keyed(self) -> _Keyed:
        raise NotImplementedError

    def validate(self, df: DataFrame) -> int:
        rows = df.limit(2).count()
        if rows > 1:
            raise InvalidKeyError(f"dataset {self.name!r} holds one row")
        if not rows:
            raise EmptyOutputError(f"dataset {self.name!r} takes no empty output")
        return rows

    def save(self, df: DataFrame, dest: str) -> None:
        self._keyed().save(df.select(F.lit(leaf(dest)).alias(KEY), *[c for c in df.columns if c != KEY]), dest)

    def load_from(self, spark: SparkSession, dest: str) -> DataFrame:
        at = dest if dest.endswith(self.suffix) and Files(spark).is_file(dest) else join(dest, _named(leaf(dest)) + self.suffix)
        if not Files(spark).is_file(at):
            raise FileNotFoundError(f"dataset {self.name!r} has no file at {at}")
        return self._keyed().load_from(spark, at).drop(KEY)

    def exists(self, spark: SparkSession, dest: str) -> bool:
        return Files(spark).is_file(join(dest, _named(leaf(dest)) + self.suffix))

    def keys_at(self, spark: SparkSession, dest: str) -> DataFrame | None:
        return None


@dataclass
class JSONFile(_Single):
    """One record as JSON."""

    schema: T.StructType | str | None = None
    suffix: str = ".json"

    def _keyed(self) -> KeyedJSON:
        return KeyedJSON(name=self.name, schema=self.schema, suffix=self.suffix, storage_options=self.storage_options)


@dataclass
class TextFile(_Single):
    """One text; column `value`."""

    suffix: str = ".txt"
    encoding: str = "UTF-8"

    def _keyed(self) -> KeyedText:
        return KeyedText(name=self.name, suffix=self.suffix, encoding=self.encoding, storage_options=self.storage_options)


@dataclass
class BinaryFile(_Single):
    """One binary; column `value`."""

    suffix: str = ".bin"

    def _keyed(self) -> KeyedBinary:
        return KeyedBinary(name=self.name, suffix=self.suffix, storage_options=self.storage_options)


@dataclass
class Loader:
    """A named source: a function of the session that gives a keyed frame."""

    name: str
    fn: Callable[[SparkSession], DataFrame]

    def load(self, spark: SparkSession) -> DataFrame:
        df = self.fn(spark)
        if not isinstance(df, DataFrame) or KEY not in df.columns:
            raise TypeError(f"loader {self.name!r} must give a DataFrame with a column {KEY!r}")
        return df


@dataclass
class Sources:
    """Several loaders as one: each record is tagged with its loader's name; a key of two loaders is an error."""

    loaders: list[Any]
    name: str = "sources"

    def load(self, spark: SparkSession) -> DataFrame:
        from ..operators.keyed import union_sources

        return union_sources({x.name: x.load(spark) for x in self.loaders})


def missing_or_extra(there: DataFrame, expected: DataFrame) -> tuple[int, int]:
    """How many expected keys are not there, and how many are there unexpectedly."""
    return expected.select(KEY).join(there, KEY, "left_anti").count(), there.join(expected.select(KEY), KEY, "left_anti").count()


