"""Size-tiered sharding: arrivals become small immutable shards; similarly sized ones merge into target-sized files.

A table is a folder with `data/` (immutable Parquet shards) and `manifest/`: one small JSON file per version, and lists of shards that versions share.
A version holds the schema, path, bytes and rows of each open shard (smaller than half the target when written, so that it can still be merged), and
the names of the lists that hold all settled ones. A commit thus writes its own shards and not the whole table's, and compaction reads open ones only.
Readers see the shards of one version and nothing else, so a job that dies leaves only files that no version names. A version is published
by the one writer that gets its number (sluice.sources.publish), on stores without a rename as well; an arrival whose number was taken is published under the next. Rows move only in Spark jobs; the driver handles file names and sizes,
and names a folder instead of its files where all of them are live.

Tiers: a shard of b bytes is in tier floor(log(b / first_tier) / log(ratio)), 0 below that. compact() merges the shards of a tier once
it has min_runs of them, in one job a tier, without a shuffle: Spark reads each shard as it is and coalesces them to as many files as the
tier's bytes fill at target_bytes. Shards of at least half the target are left alone. It goes on until no tier is due.

Writers leave a mark in `writing/` from before their first file until after their commit. vacuum() spares the files of marked writers, unless a mark is
older than `abandoned_after` seconds.

Cases: an empty arrival commits a version without new shards, and a version without any reads as an empty frame of the last arrival's
schema; a table without versions reads as an error naming the folder; null columns, repeated rows and extra columns are stored as they are; arrivals must share a schema.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.publish import SparkStore, Store
from ._common import free_name, remove, scratch_path

#: Arrivals that a table of documents is taken in.
ARRIVALS = 8
#: Versions whose shards are kept while documents arrive.
KEEP_VERSIONS = 3
#: Shards of a list that is left as it is, and smaller lists that a version has at most.
FULL_LIST, SMALL_LISTS = 4096, 16
#: Versions that a table object remembers.
KNOWN_VERSIONS = 16
#: Seconds after which a writer's mark counts for nothing.
ABANDONED = 7 * 86400


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int
    #: Shards that its folder was written with.
    run_files: int = 1


_LISTED = "path string, bytes long, rows long, run_files int"


class VersionTaken(RuntimeError):
    """Another writer has committed the version that this one was about to commit."""


class ShardedTable:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, first_tier: int = 4 << 20, ratio: int = 4, min_runs: int = 4, store: Store | None = None):
        self.spark, self.root, self.target_bytes, self.first_tier, self.ratio, self.min_runs = spark, root.rstrip("/"), target_bytes, first_tier, ratio, max(2, min_runs)
        self._files, self._known = SparkStore(spark), {}
        self.store = store or self._files
        self._fs_api = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, at: str):
        return self._fs_api.Path(at)

    # --- manifest -----------------------------------------------------------------------------------------------
    def version(self) -> int:
        """The latest committed version; 0 if there is none."""
        at = self._path(f"{self.root}/manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def _manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"open": [], "lists": [], "schema": None}
        if version not in self._known:
            text = self._files.read_text(f"{self.root}/manifest/v{version:08d}.json")
            if text is None:
                raise FileNotFoundError(f"{self.root} has no version {version}")
            while len(self._known) >= KNOWN_VERSIONS:
                self._known.pop(next(iter(self._known)))
            self._known[version] = json.loads(text)  # a version never changes
        own = self._known[version]
        return own | {"open": [Shard(**s) for s in own["open"]]}

    def _listed(self, lists: list[dict]) -> DataFrame:
        return self.spark.read.schema(_LISTED).json([x["path"] for x in lists])

    def shards(self, version: int | None = None) -> list[Shard]:
        """Every live shard, a row of names and sizes for each."""
        own = self._manifest(version)
        return own["open"] + ([Shard(*r) for r in self._listed(own["lists"]).collect()] if own["lists"] else [])

    def _settled(self, shard: Shard) -> bool:
        return shard.bytes >= self.target_bytes / 2

    def _create(self, at: str, lines: list[dict]) -> None:
        out = self._fs.create(self._path(at), False)
        out.write(bytearray("\n".join(map(json.dumps, lines)).encode()))
        out.close()

    def _with_list(self, lists: list[dict], shards: list[Shard]) -> list[dict]:
        """lists and one more of shards; small lists become one before there are too many."""
        if not shards:
            return lists
        lines = [asdict(s) for s in shards]
        small = [x for x in lists if x["n"] < FULL_LIST]
        if len(small) >= SMALL_LISTS:
            lists = [x for x in lists if x["n"] >= FULL_LIST]
            lines += [r.asDict() for r in self._listed(small).collect()]  # SMALL_LISTS * FULL_LIST rows at most
        at = f"{self.root}/manifest/lists/{uuid.uuid4().hex}.json"
        self._create(at, lines)
        return [*lists, {"path": at, "n": len(lines)}]

    def _commit(self, parent: int, open_shards: list[Shard], new: list[Shard] = (), schema: T.StructType | None = None) -> int:
        """Publishes the version after parent: the parent's open shards that stay, and new ones, which are open or settled by their bytes; without a schema, the parent's."""
        version, before = parent + 1, self._manifest(parent)
        lists = self._with_list(before["lists"], [s for s in new if self._settled(s)])
        still = [asdict(s) for s in [*open_shards, *(s for s in new if not self._settled(s))]]
        kept = schema.jsonValue() if schema else before["schema"]
        record = {"version": version, "parent": parent, "open": still, "lists": lists, "schema": kept, "writer": uuid.uuid4().hex}
        if not self.store.publish(f"{self.root}/manifest/v{version:08d}.json", json.dumps(record)):
            raise VersionTaken(f"{self.root} already has version {version}")
        return version

    # --- writing ------------------------------------------------------------------------------------------------
    @contextmanager
    def _writing(self) -> Iterator[str]:
        """The name of a run of files, marked as being written until the block, with its commit, is over."""
        run = uuid.uuid4().hex
        mark = f"{self.root}/writing/{run}"
        self._create(mark, [])
        try:
            yield run
        finally:
            self._fs.delete(self._path(mark), False)

    def _write(self, df: DataFrame, run: str | None = None) -> list[Shard]:
        at = f"{self.root}/data/{run or uuid.uuid4().hex}"
        df.write.parquet(at)
        return self._shards_in(at, df.schema)

    def _rows_of(self, at: str, schema: T.StructType) -> dict[tuple[str, str], int]:
        """Rows of each Parquet file below a folder, from one job, by the names of its folder and its own; as many rows as a listing has."""
        parts = F.split(F.input_file_name(), "/")
        counted = self.spark.read.schema(schema).parquet(at).select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name")).groupBy("folder", "name").count()
        return {(r["folder"], r["name"]): r["count"] for r in counted.collect()}

    def _shards_in(self, at: str, schema: T.StructType, rows: dict[str, int] | None = None) -> list[Shard]:
        """The Parquet files of a folder as shards, with their rows as counted now or, if given, before."""
        sizes = {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._path(at)) if s.getPath().getName().endswith(".parquet")}
        if not sizes:
            return []
        if rows is None:
            rows = {name: n for (_, name), n in self._rows_of(at, schema).items()}
        return [Shard(f"{at}/{name}", sizes[name], rows.get(name, 0), len(sizes)) for name in sorted(sizes)]

    def _arrive(self, new: list[Shard], schema: T.StructType) -> int:
        """Commits new shards after the latest version; where another writer gets its number, after that one, since arrivals do not depend on what is there."""
        while True:
            version = self.version()
            try:
                return self._commit(version, self._manifest(version)["open"], new, schema)
            except VersionTaken:
                if self.version() <= version:
                    raise

    def append(self, arrival: DataFrame) -> int:
        """Writes an arrival as immutable shards, one for each task that has rows, and commits them."""
        with self._writing() as run:
            return self._arrive(self._write(arrival, run), arrival.schema)

    def adopt(self, folder: str, schema: T.StructType, rows: dict[str, int] | None = None) -> int:
        """Moves a folder of Parquet files into the table and commits it as an arrival; one that is not there is an arrival without rows.

        rows: those of each file by its name, if they have been counted already.
        """
        with self._writing() as run:
            at, new = f"{self.root}/data/{run}", []
            if self._fs.exists(self._path(folder)):
                self._fs.mkdirs(self._path(f"{self.root}/data"))
                if not self._fs.rename(self._path(folder), self._path(at)):
                    raise OSError("an arrival could not be moved into the table")
                new = self._shards_in(at, schema, rows)
            return self._arrive(new, schema)

    def _tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.first_tier, self.ratio)))

    def due(self, shards: list[Shard]) -> list[Shard]:
        """The shards of the lowest tier that has min_runs of them and gains from a merge."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if not self._settled(s):
                tiers.setdefault(self._tier(s.bytes), []).append(s)
        ready = [t for t, own in tiers.items() if len(own) >= self.min_runs]
        return tiers[min(ready)] if ready else []

    def compact(self) -> int:
        """Merges tiers until none is due; each merge is one job and one version, and keeps the count of rows."""
        version = self.version()
        own = self._manifest(version)
        still = own["open"]
        while old := self.due(still):
            files = max(1, math.ceil(sum(s.bytes for s in old) / self.target_bytes))
            with self._writing() as run:
                new = self._write(self._frame(self._folders(old), own["schema"]).coalesce(files), run)
                if sum(s.rows for s in new) != sum(s.rows for s in old):
                    raise RuntimeError(f"merging {len(old)} shards of {self.root} changed the number of rows")
                gone = set(old)
                still = [s for s in still if s not in gone]
                version = self._commit(version, still, new)  # with fewer shards each time: min_runs of less than half the target fill fewer files
            still += [s for s in new if not self._settled(s)]
        return version

    def vacuum(self, abandoned_after: float = ABANDONED, keep: int = 1) -> int:
        """Deletes shards that none of the latest `keep` versions names and no marked writer is at; only safe once no reader is on an older version.

        A folder whose files are all live is not listed.
        """
        data, writing, n = self._path(f"{self.root}/data"), self._path(f"{self.root}/writing"), 0
        latest = self.version()
        whole = {p.rpartition("/")[2] for p in self._folders(self.shards(latest)) if not p.endswith(".parquet")}
        runs = [s.getPath().getName() for s in self._fs.listStatus(data)] if self._fs.exists(data) else []
        found = [(run, s.getPath()) for run in runs if run not in whole for s in self._fs.listStatus(self._path(f"{self.root}/data/{run}"))]
        # Marks are read after the files and live shards after the marks, so that a file whose writer commits in between is in one of the two.
        marks = self._fs.listStatus(writing) if self._fs.exists(writing) else []
        busy = {s.getPath().getName() for s in marks if time.time() - s.getModificationTime() / 1000 < abandoned_after}
        latest = self.version()
        live = {s.path for v in range(max(1, latest - keep + 1), latest + 1) for s in self.shards(v)}
        for run, at in found:
            name = at.getName()
            if run not in busy and name.endswith(".parquet") and f"{self.root}/data/{run}/{name}" not in live:
                self._fs.delete(at, False)
                n += 1
        return n

    # --- reading ------------------------------------------------------------------------------------------------
    @staticmethod
    def _folders(shards: list[Shard]) -> list[str]:
        """Paths of shards; the folder alone where all that it was written with are among them."""
        runs: dict[str, list[Shard]] = {}
        for s in shards:
            runs.setdefault(s.path.rpartition("/")[0], []).append(s)
        return [p for run, own in runs.items() for p in ([run] if len(own) == own[0].run_files else [s.path for s in own])]

    def _frame(self, paths: list[str], schema: dict) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(schema)).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        own = self._manifest(version)
        if not own["schema"]:
            raise FileNotFoundError(f"{self.root} has no committed shards")
        paths = self._folders(own["open"])
        if own["lists"]:
            run = F.regexp_replace("path", "/[^/]*$", "")
            runs = self._listed(own["lists"]).groupBy(run.alias("run")).agg(F.collect_list("path").alias("paths"), F.first("run_files").alias("of"))
            whole = F.when(F.size("paths") == F.col("of"), F.array("run")).otherwise(F.col("paths"))
            paths += [r["path"] for r in runs.select(F.explode(whole).alias("path")).collect()]
        return self._frame(paths, own["schema"]) if paths else self.spark.createDataFrame([], T.StructType.fromJson(own["schema"]))


def shard_documents(documents: DataFrame, root: str | None = None, arrivals: int = ARRIVALS, keep_versions: int = KEEP_VERSIONS, **sizes) -> ShardedTable:
    """A sharded table that took documents in arrivals by a hash of their ids, which together hold every row once, each followed by compaction and vacuum.

    Documents are read once, in a write with a folder for each arrival; the folders then come to the table one after another. Each task of that write has its
    part of a read split in each folder, so that shards start small however large the table is. The last keep_versions versions stay readable.
    """
    spark = documents.sparkSession
    table = ShardedTable(spark, root or scratch_path(spark, "shards"), **sizes)
    mark, incoming = free_name(documents, "turn"), f"{table.root}/incoming/{uuid.uuid4().hex}"
    turn = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(arrivals))
    documents.withColumn(mark, turn).write.partitionBy(mark).parquet(incoming)
    rows: dict[str, dict[str, int]] = {}
    for (folder, name), n in table._rows_of(incoming, documents.schema).items():
        rows.setdefault(folder, {})[name] = n
    for k in range(arrivals):
        table.adopt(f"{incoming}/{mark}={k}", documents.schema, rows.get(f"{mark}={k}", {}))
        table.compact()
        table.vacuum(keep=keep_versions)
    remove(spark, incoming)
    return table
