"""Best-fit packing of documents into sequences by large-item matching.

Texts are tokenized once, in place, without a shuffle; every document ends with end_id. Only documents longer than the capacity are
cut, into full pieces after a first piece that takes what is left over, so a full piece fills a sequence and only pieces below the
capacity have to be placed. How well they fit depends on their lengths alone, and there are at most `capacity` of those: the
lengths are counted in Spark, the counts are packed, and each piece finds its place by its rank among the pieces of its length.
So the driver holds a table that the capacity bounds, and no task holds more than its own rows, however the lengths are spread.

plan() packs counts: lengths above a third of the capacity are large, at most two of them share a sequence, and they
are matched greedily, the longest with the longest that fits it; smaller lengths, in descending order, go each to the fullest sequence
that still takes them, or open a new one.

Cases: a null or empty text is a document of the end id alone; repeated rows, and rows with a repeated or null id, are
packed each for itself; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded_broadcast, staged
from ._tokens import encoder

#: Texts that are tokenized together.
STEP = 512
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


@dataclass
class Bins:
    """Equal sequences: how many, what they hold as (length, how often), and what is still free in each."""

    count: int
    free: int
    holds: list[tuple[int, int]] = field(default_factory=list)


def plan(counts: dict[int, int], capacity: int) -> list[Bins]:
    """Packs counts[length] pieces of every length; the sequences of the result hold them all."""
    left = {n: c for n, c in counts.items() if c}
    if any(not 1 <= n <= capacity for n in left):
        raise ValueError("a length is outside 1..capacity")
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    bins: list[Bins] = []
    for a in large:
        while c := left[a]:
            b = next((x for x in large if a + x <= capacity and left[x] - (x == a) > 0), None)
            if b is None:
                bins.append(Bins(c, capacity - a, [(a, 1)]))
                left[a] = 0
            elif b == a:
                bins.append(Bins(c // 2, capacity - 2 * a, [(a, 2)]))
                left[a] = c % 2
            else:
                m = min(c, left[b])
                bins.append(Bins(m, capacity - a - b, [(a, 1), (b, 1)]))
                left[a] -= m
                left[b] -= m
    by_free: dict[int, list[Bins]] = {}
    for x in bins:
        by_free.setdefault(x.free, []).append(x)

    def put(x: Bins, m: int, n: int, k: int) -> None:
        """m of the sequences of x take k pieces of length n."""
        by_free.setdefault(x.free - k * n, []).append(Bins(m, x.free - k * n, [*x.holds, (n, k)]))
        if x.count > m:
            x.count -= m
        else:
            by_free[x.free].remove(x)

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while c := left[n]:
            gap = min((g for g, own in by_free.items() if g >= n and own), default=None)
            if gap is None:
                by_free.setdefault(capacity, []).append(Bins(-(-c // (capacity // n)), capacity))
                continue
            x, k = by_free[gap][-1], gap // n
            if c >= k:  # as many whole fillings as pieces and sequences allow
                m = min(x.count, c // k)
                put(x, m, n, k)
                left[n] -= m * k
            else:
                put(x, 1, n, c)
                left[n] = 0
    return [x for own in by_free.values() for x in own if x.holds]


def places(bins: list[Bins]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, pieces a sequence, first sequence, offset in it), by ascending rank."""
    rank: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    for x in bins:
        offset = 0
        for n, k in x.holds:
            out.setdefault(n, []).append((rank.get(n, 0), k, first, offset))
            rank[n] = rank.get(n, 0) + k * x.count
            offset += n * k
        first += x.count
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def tokenized_pieces(documents: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """The pieces of every document, with a rank within task and length and, if asked for, their ids (little-endian unsigned 32-bit)."""
    schema = _PIECES + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, seen = encoder(path), TaskContext.get().partitionId(), {}
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            for k in range(0, batch.num_rows, STEP):
                docs, texts = batch.column(0).slice(k, STEP), batch.column(1).slice(k, STEP).to_pylist()
                rows = []
                for doc, raw in enumerate(code.ids(texts)):
                    ids = np.frombuffer(raw + end, "<u2").astype("<u4")
                    start, n = 0, len(ids) % capacity or capacity
                    for piece in range(-(-len(ids) // capacity)):
                        own = ids[start : start + n].tobytes()
                        rank = seen[n] = seen.get(n, -1) + 1
                        rows.append((doc, piece, start, n, zlib.crc32(own), part, rank, own if with_ids else None))
                        start, n = start + n, capacity
                doc, piece, start, n, crc, at, rank, own = zip(*rows, strict=True)
                long, int32 = pa.int64(), pa.int32()
                columns = [docs.take(pa.array(doc)), pa.array(piece, int32), pa.array(start, long), pa.array(n, long), pa.array(crc, long), pa.array(at, int32), pa.array(rank, long)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(own, pa.binary())] if with_ids else columns, names)

    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(cut, schema)


def pack_documents(documents: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids themselves if asked for.

    The tokenized pieces are a staged table in the shared folder; the counts, the ranks and the result are read from it.
    """
    pieces = staged(tokenized_pieces(documents, path, capacity, end_id, id_col, text_col, with_ids), "pieces")
    return place(pieces, capacity, with_ids)


def place(pieces: DataFrame, capacity: int, with_ids: bool = True) -> DataFrame:
    """The pieces with their sequence and their offset in it.

    A piece's rank among all of its length is its rank within its task and how many the tasks before hold, which stand in one row for each task: an array of
    `capacity` counts. Those rows are broadcast while they are proven small, else they meet the pieces by a shuffle on the task.
    """
    met = staged(pieces.groupBy("part", "length").count(), "lengths")
    counts = {r["length"]: r["n"] for r in met.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    table = places(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = met.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(capacity + 1, np.int64)
        own[rows["length"].to_numpy()] = rows["before"].to_numpy()
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "bases": [own]})

    bases = staged(each.groupBy("part").applyInPandas(packed, "part int, bases array<long>"), "bases")

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, r = batch.column("length").to_numpy(), batch.column("at").to_numpy()
            sequence, offset = np.empty_like(n), np.empty_like(n)
            for size in np.unique(n):
                own = n == size
                rows = table[int(size)]
                first, k, base, at = rows[np.searchsorted(rows[:, 0], r[own], "right") - 1].T
                i = r[own] - first
                sequence[own], offset[own] = base + i // k, at + i % k * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    # the row of counts is left behind here, before anything goes to Python
    at = F.col("rank") + F.get("bases", F.col("length").cast("int"))
    ranked = pieces.select(*columns, "part", "rank").join(bounded_broadcast(bases, bases.count(), 8 * (capacity + 1) + 64), "part").select(*columns, at.alias("at"))
    return ranked.mapInArrow(seat, T.StructType([*ranked.schema.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, lengths): the packed sequences; each holds at most `capacity` ids, so groups are bounded."""
    one = F.struct("offset", "doc_id", "length", "ids")
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(one)).alias("own"))
    joined = F.aggregate("own", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), F.col("own.doc_id").alias("doc_ids"), F.col("own.length").alias("lengths"))
