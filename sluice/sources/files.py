"""Files through Hadoop's file systems: whatever path Spark can read, these can list, write and rename."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own on a local master, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="sluice-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def is_url(path: str) -> bool:
    return "://" in path


def join(root: str, *parts: str) -> str:
    return "/".join([root.rstrip("/"), *[p.strip("/") for p in parts if p]])


def leaf(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2]


def parent(path: str) -> str:
    return path.rstrip("/").rpartition("/")[0]


class Files:
    def __init__(self, spark: SparkSession):
        self.spark, self._jvm, self._conf = spark, spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def is_file(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isFile()

    def children(self, path: str) -> list[str]:
        """Names in a folder, sorted; none if it is not there."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def qualified(self, path: str) -> str:
        """The path as file systems give it back."""
        fs, p = self._at(path)
        return fs.getFileStatus(p).getPath().toString()

    def walk(self, path: str, suffix: str = "", empty_only: bool = False) -> list[str]:
        """Paths of the files (those without bytes, if asked) below a folder that end in suffix, relative to it, sorted; hidden ones included."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        root = fs.getFileStatus(p).getPath().toString().rstrip("/") + "/"
        found, it = [], fs.listFiles(p, True)
        while it.hasNext():
            status = it.next()
            at = status.getPath().toString()
            if at.endswith(suffix) and not (empty_only and status.getLen()):
                found.append(at.removeprefix(root))
        return sorted(found)

    def any(self, path: str, suffix: str = "") -> bool:
        """Whether a file below a folder ends in suffix; stops at the first."""
        fs, p = self._at(path)
        it = fs.listFiles(p, True) if fs.exists(p) else None
        while it is not None and it.hasNext():
            if it.next().getPath().getName().endswith(suffix):
                return True
        return False

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def mkdirs(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def rename(self, old: str, new: str) -> None:
        fs, a = self._at(old)
        _, b = self._at(new)
        fs.mkdirs(b.getParent())
        if not fs.rename(a, b):
            raise OSError(f"could not move {leaf(old)} to {leaf(new)}")

    def read_text(self, path: str) -> str | None:
        """The text of a small file, such as a record; None if it is not there."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str, replace: bool = True) -> None:
        """A small file, written aside and moved over what is there in one step; without replace, an existing file is an error."""
        fs, p = self._at(path)
        if not replace:
            out = fs.create(p, False)
            out.write(bytearray(text.encode()))
            out.close()
            return
        aside = self._jvm.org.apache.hadoop.fs.Path(join(parent(path), f".{leaf(path)}.{uuid.uuid4().hex}"))
        out = fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        api = self._jvm.org.apache.hadoop.fs
        over = self.spark.sparkContext._gateway.new_array(api.Options.Rename, 1)
        over[0] = api.Options.Rename.OVERWRITE
        try:
            api.FileContext.getFileContext(fs.makeQualified(p).toUri(), self._conf).rename(fs.makeQualified(aside), fs.makeQualified(p), over)
        except Exception as e:
            fs.delete(aside, False)
            raise OSError(f"could not publish {leaf(path)}") from e
