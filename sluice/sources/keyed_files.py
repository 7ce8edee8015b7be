"""One file for each key, in a tree of folders: listed, read and written by tasks, so that no name passes the driver.

Writing is a Python data source, `keyed_files`: each task puts its rows' files in place and hands on a message with how many and how many bytes; the
commit checks that every task sent one, and a job that fails has its files removed again. Reading is a frame: a data source's splits would have to come from the driver, so folders are listed in
rounds by tasks instead (a task goes down a tree by itself as long as it is small, and hands folders on to the next round beyond that), and the
listed files are dealt over tasks by a hash of their names.

Names: a key's segments are folders and a file name with the suffix. What file systems or Spark's readers cannot take is escaped: `:` is `%3A` (and `%3A` or `%25` in
a key has its `%` as `%25`), and names that look hidden have a `~` before or after.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..model import KEY
from .files import join, leaf, parent, shared_dir

#: Folders that a task lists by itself, and files that it reads into one batch at most, by number and by bytes.
FOLDERS, BATCH_FILES, BATCH_BYTES = 256, 2048, 8 << 20
_COPYING = "._COPYING_"
#: A file that a task is still writing, or has left behind; no key's file is named like this.
_ASIDE = re.compile(r"\.part-\d+-\d+")


def named(key: str) -> str:
    """The path of a key's file, without its suffix."""
    parts = [f"~{p}" if p[:1] in ("_", ".", "~") else p for p in re.sub("%(?=3A|25)", "%25", key).replace(":", "%3A").split("/")]
    return "/".join(f"{p}~" if p.rstrip("~").endswith(_COPYING) else p for p in parts)


def unnamed(path: str) -> str:
    """The key of a path without its suffix."""
    parts = [p.removeprefix("~") for p in path.split("/")]
    whole = "/".join(p.removesuffix("~") if p.rstrip("~").endswith(_COPYING) else p for p in parts)
    return re.sub("%(3A|25)", lambda m: ":" if m[1] == "3A" else "%", whole)


#: Spark's names of S3 options and pyarrow's (fixed values).
_S3_OPTIONS = {"fs.s3a.access.key": "access_key", "fs.s3a.secret.key": "secret_key", "fs.s3a.session.token": "session_token", "fs.s3a.endpoint": "endpoint_override", "fs.s3a.endpoint.region": "region"}


def store_of(dest: str, options: dict[str, str] | None) -> tuple[Any, str]:
    """(file system, path) of a folder for a task's Python: by its scheme and by those of the options, named as Spark names them, that pyarrow has too.

    An option of another name is an error, so that none is passed over in silence.
    """
    from pyarrow import fs

    scheme, found, rest = dest.partition("://")
    own = dict(options or {})

    def taken(names: dict[str, str]) -> dict[str, str]:
        out = {to: own.pop(at) for at, to in names.items() if at in own}
        if own:
            raise ValueError(f"options of keyed files that are not known for {scheme or 'file'}: {', '.join(sorted(own))}")
        return out

    if not found or scheme == "file":
        taken({})
        return fs.LocalFileSystem(), rest if found else dest
    if scheme in ("s3", "s3a", "s3n"):
        return fs.S3FileSystem(**taken(_S3_OPTIONS)), rest
    if scheme in ("abfs", "abfss", "wasb", "wasbs"):
        container, _, tail = rest.partition("@")
        account, _, path = tail.partition("/")
        short = account.partition(".")[0]
        for how in (f"fs.azure.account.auth.type.{account}", f"fs.azure.account.oauth.provider.type.{account}"):
            own.pop(how, None)  # told by the credentials themselves
        azure = {f"fs.azure.account.key.{account}": "account_key", f"fs.azure.sas.fixed.token.{account}": "sas_token", f"fs.azure.sas.{container}.{account}": "sas_token"}
        secret = {f"fs.azure.account.oauth2.client.{k}.{account}": to for k, to in (("id", "client_id"), ("secret", "client_secret"), ("endpoint", "endpoint"))}
        more = taken(azure | secret)
        if endpoint := more.pop("endpoint", None):  # https://login.microsoftonline.com/<tenant>/oauth2/token
            more["tenant_id"] = endpoint.split("/")[3]
        return fs.AzureFileSystem(short, **more), f"{container}/{path}"
    taken({})
    store, root = fs.FileSystem.from_uri(dest)
    return store, root


def reachable(dest: str) -> bool:
    """Whether tasks can reach a folder by themselves; else Spark's readers are used, which list on the driver."""
    scheme, found, _ = dest.partition("://")
    return not found or scheme in ("file", "s3", "s3a", "s3n", "abfs", "abfss", "wasb", "wasbs", "gs", "gcs")


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote."""

    files: int
    size: int


class KeyedFilesWriter(DataSourceArrowWriter):
    def __init__(self, options: Any):
        self.dest, self.suffix = options["path"], options.get("suffix", "")
        self.own = json.loads(options.get("secretOptions", "{}"))
        self.fresh = options.get("fresh", "false") == "true"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyarrow import fs

        store, root = store_of(self.dest, self.own)
        attempt, made, done = TaskContext.get().taskAttemptId(), set(), Written(0, 0)
        moves = isinstance(store, fs.LocalFileSystem | fs.HadoopFileSystem)  # elsewhere a put is whole or not there
        for batch in batches:
            for key, body in zip(batch.column(KEY).to_pylist(), batch.column("body"), strict=True):
                to, body = posixpath.join(root, named(key) + self.suffix), body.as_py()
                folder = posixpath.dirname(to)
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                aside = posixpath.join(folder, f".part-{attempt}-{done.files}") if moves else to
                with store.open_output_stream(aside) as out:
                    out.write(body)
                if moves:
                    store.move(aside, to)
                done.files, done.size = done.files + 1, done.size + len(body)
        return done

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        if any(m is None for m in messages):
            raise RuntimeError("a task told nothing of its files")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if self.fresh:
            store, root = store_of(self.dest, self.own)
            store.delete_dir_contents(root, missing_dir_ok=True)


class KeyedFiles(DataSource):
    """Write only: (key string, body binary) to `path`, with `suffix`; `fresh` says that the folder is the job's own, so that a failed job may empty it."""

    @classmethod
    def name(cls) -> str:
        return "keyed_files"

    def schema(self) -> str:
        return f"{KEY} string, body binary"

    def writer(self, schema: Any, overwrite: bool) -> KeyedFilesWriter:
        return KeyedFilesWriter(self.options)


def write(rows: DataFrame, dest: str, suffix: str, options: dict[str, str] | None, fresh: bool) -> None:
    """A file for each row (key, body)."""
    store_of(dest, options)  # so that bad options fail before the job
    rows.sparkSession.dataSource.register(KeyedFiles)
    writer = rows.select(KEY, "body").write.format("keyed_files").mode("append")
    writer.options(path=dest, suffix=suffix, fresh=str(fresh).lower(), secretOptions=json.dumps(options or {})).save()


def listed(spark: SparkSession, dest: str, suffix: str, options: dict[str, str] | None) -> DataFrame:
    """(name, key, size) of the files below a folder that end in suffix, hidden and empty ones too; none if it is not there."""

    columns = pa.schema([("name", pa.string()), (KEY, pa.string()), ("size", pa.int64()), ("folder", pa.bool_())])

    def ls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(columns)], schema=columns)

        store, root = store_of(dest, options)
        for batch in batches:
            todo, seen = batch.column("name").to_pylist(), 0
            while todo and seen < FOLDERS:
                folder, seen, rows = todo.pop(), seen + 1, []
                for info in store.get_file_info(fs.FileSelector(posixpath.join(root, folder) if folder else root, allow_not_found=True)):
                    name = f"{folder}/{info.base_name}" if folder else info.base_name
                    if info.type == fs.FileType.Directory:
                        todo.append(name)
                    elif name.endswith(suffix) and not _ASIDE.fullmatch(info.base_name):
                        rows.append((name, unnamed(name[: len(name) - len(suffix)]), info.size, False))
                yield batch_of(rows)
            yield batch_of([(name, None, 0, True) for name in todo])

    folders, rounds, schema = spark.createDataFrame([("",)], "name string"), [], f"name string, {KEY} string, size long, folder boolean"
    while True:
        at = join(shared_dir(spark), f"listing-{uuid.uuid4().hex}")
        folders.mapInArrow(ls, schema).write.parquet(at)
        found = spark.read.schema(schema).parquet(at)
        rounds.append(found.where("not folder").select("name", KEY, "size"))
        folders = found.where("folder").select("name").repartition(F.xxhash64("name"))
        if folders.isEmpty():
            break
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out


def contents(files: DataFrame, dest: str, options: dict[str, str] | None) -> DataFrame:
    """(key, content) of listed files (name, key)."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(dest, options)
        keys, bodies, size = [], [], 0
        for batch in batches:
            for name, key in zip(batch.column("name").to_pylist(), batch.column(KEY).to_pylist(), strict=True):
                with store.open_input_stream(posixpath.join(root, name)) as f:
                    body = f.read()
                keys.append(key)
                bodies.append(body)
                size += len(body)
                if size > BATCH_BYTES or len(keys) >= BATCH_FILES:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(bodies, pa.binary())], [KEY, "content"])
                    keys, bodies, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(bodies, pa.binary())], [KEY, "content"])

    return files.select("name", KEY).repartition(F.xxhash64("name")).mapInArrow(load, f"{KEY} string, content binary")


def one(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """The listing of one file."""
    name = leaf(path)
    return spark.createDataFrame([(name, unnamed(name.removesuffix(suffix) if suffix else name))], f"name string, {KEY} string")


def folder_of(path: str) -> str:
    return parent(path)
