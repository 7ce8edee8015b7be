"""Publishing a small file under a name that one writer only may have, on file systems with and without an atomic rename.

publish() gives True to exactly one of all writers of a path, and readers see the whole file or none. How, depends on the file system:

- `conditional`: it says that it has conditional creation (s3a since Hadoop 3.4.2); the store itself refuses a name that is taken;
- `create`: a create without overwriting is such a condition there (gs), and the file appears when it is closed;
- `link`: local files are written aside and linked to their name, which fails if there is one (on a mount without hard links, `move`, where two writers of the same instant can both win);
- `move`: written aside and renamed without overwriting, in one step on the server (HDFS, ABFS).

A store that renames by copying and has no conditional creation is an error: two writers would both win there.

A client that repeats a request whose answer was lost is refused by its own file. So a refused writer reads the file, and has won if its own text is there; the
text must therefore hold something that no other writer's has, such as a random id.
"""

from __future__ import annotations

import errno
import json
import os
import uuid
from collections.abc import Callable, Iterator
from typing import Any, Protocol

from pyspark.sql import SparkSession

from ..model import PublishError
from .files import Files, join, leaf, parent

#: The capability and option of conditional creation, in Hadoop's words.
CONDITIONAL = "fs.option.create.conditional.overwrite"
#: Schemes whose create without overwriting is a condition that the store keeps.
CREATES = ("gs",)
#: Schemes of stores that rename by copying.
COPIES = ("cosn", "obs", "oss", "s3", "s3a", "s3n")
#: What a mount without hard links answers.
NO_LINKS = (errno.EPERM, errno.ENOTSUP, errno.ENOSYS)


class Store(Protocol):
    """What a log needs of a store; no rename."""

    def children(self, path: str) -> list[str]: ...

    def read_text(self, path: str) -> str | None: ...

    def publish(self, path: str, text: str) -> bool: ...

    def replace(self, path: str, text: str) -> None: ...

    def delete(self, path: str) -> None: ...


class SparkStore(Files):
    """Any file system of Spark's as a store of small files."""

    def way(self, path: str) -> str:
        fs, p = self._at(path)
        scheme = fs.getUri().getScheme()
        if fs.hasPathCapability(p, CONDITIONAL):
            return "conditional"
        if scheme in CREATES:
            return "create"
        if scheme in COPIES:
            raise PublishError(f"{scheme} has neither a rename in one step nor conditional creation here")
        return "link" if scheme == "file" else "move"

    def publish(self, path: str, text: str) -> bool:
        """Whether this call's text is now at path; False if another's is."""
        try:
            getattr(self, f"_{self.way(path)}")(path, text)
            return True
        except PublishError:
            raise
        except Exception as e:  # what a refusal is differs from one file system to the next, so it is looked up
            there = self.read_text(path)
            if there is None:
                raise PublishError(f"could not publish {leaf(path)}") from e
            return there == text

    def replace(self, path: str, text: str) -> None:
        """A file of our own again, whole; stores that rename by copying put it in place at once."""
        fs, p = self._at(path)
        if fs.getUri().getScheme() in (*COPIES, *CREATES):
            self._put(fs.create(p, True), text)
        else:
            self.write_text(path, text)

    @staticmethod
    def _put(out: Any, text: str) -> None:
        out.write(bytearray(text.encode()))
        out.close()

    def _conditional(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        self._put(fs.createFile(p).recursive().overwrite(False).must(CONDITIONAL, "true").build(), text)

    def _create(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        self._put(fs.create(p, False), text)

    def _link(self, path: str, text: str) -> None:
        final = self._at(path)[1].toUri().getPath()
        aside = join(parent(final), f".{leaf(final)}.{uuid.uuid4().hex}")
        os.makedirs(parent(final), exist_ok=True)
        with open(aside, "x", encoding="utf-8", newline="") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        try:
            os.link(aside, final)
        except OSError as e:
            if e.errno not in NO_LINKS:
                raise
            self._move(path, text)
        finally:
            os.unlink(aside)

    def _move(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        api = self._jvm.org.apache.hadoop.fs
        aside = api.Path(join(parent(path), f".{leaf(path)}.{uuid.uuid4().hex}"))
        self._put(fs.create(aside, False), text)
        try:
            context = api.FileContext.getFileContext(fs.makeQualified(p).toUri(), self._conf)
            context.rename(fs.makeQualified(aside), fs.makeQualified(p), self.spark.sparkContext._gateway.new_array(api.Options.Rename, 0))
        except Exception:
            fs.delete(aside, False)
            raise


class Log:
    """Numbered entries in a folder, each published once: the order in which writers came is that of the numbers, without a gap.

    An entry is a JSON object. Entries that name Parquet folders make a table that many writers append to: one lists the log, and reads what it names.
    """

    def __init__(self, store: Store, root: str):
        self.store, self.root = store, root

    def at(self, number: int) -> str:
        return join(self.root, f"{number:012d}.json")

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.store.children(self.root) if n.endswith(".json") and n[:-5].isdigit())

    def last(self) -> int:
        """The number of the last entry; 0 if there is none."""
        return max(self.numbers(), default=0)

    def read(self, number: int) -> dict[str, Any]:
        text = self.store.read_text(self.at(number))
        if text is None:
            raise PublishError(f"there is no entry {number}")
        return json.loads(text)

    def entries(self, after: int = 0) -> Iterator[dict[str, Any]]:
        for number in self.numbers():
            if number > after:
                yield self.read(number)

    def take(self, number: int, entry: dict[str, Any]) -> bool:
        """Publishes an entry under this number; False if another writer has it."""
        return self.store.publish(self.at(number), json.dumps(entry | {"writer": uuid.uuid4().hex}, sort_keys=True))

    def append(self, entry: dict[str, Any], after: int | None = None, agree: Callable[[dict[str, Any]], None] | None = None) -> int:
        """Publishes an entry under the first free number after `after` (the last, if not given), and returns it.

        Each entry of another writer that came in between is shown to agree(), which raises if this one cannot come after it.
        """
        number = (self.last() if after is None else after) + 1
        while not self.take(number, entry):
            if agree is not None:
                agree(self.read(number))
            number += 1
        return number
