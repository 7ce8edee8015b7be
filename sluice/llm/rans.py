"""Token ids as a file of independent blocks, coded by a static range asymmetric numeral system (rANS).

Format: a Parquet table of blocks, so that Spark writes, commits, splits and reads it. Each row is one block: the ids of consecutive whole
documents, in ascending id order. One frequency table, counted over the whole corpus, is shared by all blocks and
lies beside them. A block's ids are dealt round-robin to `lanes` interleaved 64-bit coders that share one stream of 32-bit words; every
CHECK_STEPS steps the coders' states and the place in the stream are stored as a checkpoint, with a checksum of
the ids up to the next one, so the segments of a block decode side by side, and any segment alone.

Work in Spark: texts are range-partitioned by document id and a hash of the text, into as many partitions as their bytes ask for, and sorted, tokenized in place (a staged table, which ends the shuffle), counted,
and encoded task by task as they lie. Nothing but the frequency table (one count for each id of the vocabulary) and
the totals of the partitions goes through the driver.

Cases: a null or empty text is the end id alone; null document ids sort first; repeated ids lie side by side in any order; an empty
table gives an empty file. A document longer than a block makes a block of its own length. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import drop, remove, scratch_path, staged
from ._tokens import encoder

SCALE_BITS = 20
SCALE = 1 << SCALE_BITS
LOW = np.uint64(1 << 31)
LANES = 4096
CHECK_STEPS = 128
BLOCK_TOKENS = 1 << 20
STEP = 512
#: Bytes of text, and of what else a row has, that a range partition is to hold.
PART_BYTES, ROW_BYTES = 32 << 20, 32
_WORD, _BITS = np.uint64(0xFFFFFFFF), np.uint64(32)
_STAGED = "doc_id long, part int, seq long, first long, n long, ids binary"
_BLOCK = "part int, seq long, first long, n long, docs binary, lengths binary, lanes int, payload binary, words_crc32 long, checks binary"


@dataclass(frozen=True)
class Table:
    """Frequencies that sum to SCALE, for the ids 0 .. len(freq) - 1; ids that never occur have 0."""

    freq: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Table:
        """Scales counts so that each present id keeps at least 1 and the sum is SCALE."""
        present = np.flatnonzero(counts)
        if not len(present):
            return Table(np.zeros(len(counts), np.uint32))
        if len(present) > SCALE:
            raise ValueError("more ids than the scale has room for")
        spare = SCALE - len(present)
        share = counts[present].astype(np.float64) * spare / counts.sum()
        freq = np.floor(share).astype(np.int64)
        order = np.argsort(-(share - freq), kind="stable")
        freq[order[: spare - int(freq.sum())]] += 1
        out = np.zeros(len(counts), np.uint32)
        out[present] = freq + 1
        return Table(out)

    def start(self) -> np.ndarray:
        return (np.cumsum(self.freq, dtype=np.uint64) - self.freq).astype(np.uint64)

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freq), dtype=np.uint16), self.freq)


def lanes_for(n: int) -> int:
    """As many coders as keep the final states a small part of the block: a power of two up to LANES."""
    return 1 << max(0, min(LANES.bit_length() - 1, (n // 256).bit_length() - 1)) if n >= 256 else 1


class Coder:
    """Encodes and decodes blocks by one table."""

    def __init__(self, table: Table):
        self.freq, self.first = table.freq.astype(np.uint64), table.start()
        self.limit = self.freq << np.uint64(63 - SCALE_BITS)
        self._slots, self._table = None, table

    def encode(self, ids: np.ndarray, lanes: int) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray, int]]]:
        """(words, checkpoints): words in decoding order; a checkpoint is (step, word, states, crc32 of the ids up to the next)."""
        n, steps = len(ids), -(-len(ids) // lanes)
        state = np.full(lanes, LOW, np.uint64)
        out: list[np.ndarray] = []
        marks: list[tuple[int, int, np.ndarray]] = []
        written = 0
        for t in range(steps - 1, -1, -1):
            own = ids[t * lanes : min(n, (t + 1) * lanes)]
            m, f = len(own), self.freq[own]
            x = state[:m]
            full = x >= self.limit[own]
            if full.any():
                some = x[full]
                out.append((some & _WORD).astype("<u4")[::-1])  # reversed, as the whole stream is turned round at the end
                written += len(some)
                x = np.where(full, x >> _BITS, x)
            q = x // f
            state[:m] = (q << np.uint64(SCALE_BITS)) + (x - q * f) + self.first[own]
            if t % CHECK_STEPS == 0:
                marks.append((t, written, state.copy()))
        words = np.concatenate(out)[::-1] if out else np.empty(0, "<u4")
        checks = [(t, written - w, s, zlib.crc32(ids[t * lanes : (t + CHECK_STEPS) * lanes].astype("<u4").tobytes())) for t, w, s in reversed(marks)]
        return words, checks

    def decode(self, words: np.ndarray, checks: list[tuple[int, int, np.ndarray, int]], n: int, lanes: int, segments: range | None = None) -> np.ndarray:
        """The ids of the given segments (all of them by default); checksums that do not hold raise ValueError."""
        if self._slots is None:
            self._slots = self._table.slots()
        steps, out = -(-n // lanes), []
        for k in segments if segments is not None else range(len(checks)):
            begin, at, state, crc = checks[k]
            end, state = min(steps, begin + CHECK_STEPS), state.copy()
            ids = np.empty(min(n, end * lanes) - begin * lanes, np.uint16)
            for t in range(begin, end):
                m = min(n - t * lanes, lanes)
                x = state[:m]
                slot = x & np.uint64(SCALE - 1)
                own = self._slots[slot]
                x = self.freq[own] * (x >> np.uint64(SCALE_BITS)) + slot - self.first[own]
                low = np.flatnonzero(x < LOW)
                if len(low):
                    x[low] = (x[low] << _BITS) | words[at : at + len(low)]
                    at += len(low)
                state[:m] = x
                ids[(t - begin) * lanes : (t - begin) * lanes + m] = own
            if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                raise ValueError(f"segment {k} of a block does not match its checksum")
            out.append(ids)
        return np.concatenate(out) if out else np.empty(0, np.uint16)


def _pack_checks(checks: list) -> bytes:
    """Each checkpoint: step, word and checksum as 64-bit, then the states; the count of lanes is the block's."""
    return b"".join(np.array([t, w, crc], "<u8").tobytes() + s.astype("<u8").tobytes() for t, w, s, crc in checks)


def _unpack_checks(raw: bytes, lanes: int) -> list:
    rows = np.frombuffer(raw, "<u8").reshape(-1, 3 + lanes)
    return [(int(r[0]), int(r[1]), r[3:].astype(np.uint64), int(r[2])) for r in rows]


def _tokenized(documents: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    parts = max(1, -(-int(size) // PART_BYTES))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, seq, first = encoder(path), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            for k in range(0, batch.num_rows, STEP):
                docs = batch.column(0).slice(k, STEP)
                ids = [x + end for x in code.ids(batch.column(1).slice(k, STEP).to_pylist())]
                n = np.array([len(x) // 2 for x in ids], np.int64)
                at = first + np.cumsum(n) - n
                columns = [docs, pa.array([part] * len(n), pa.int32()), pa.array(range(seq, seq + len(n)), pa.int64()), pa.array(at), pa.array(n), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _STAGED.split(", ")])
                seq, first = seq + len(n), first + int(n.sum())

    order = ["doc_id", F.xxhash64("text"), "row"]  # so that rows with one id, or none, and equal ones too, may lie in several partitions
    placed = docs.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return placed.select("doc_id", "text").mapInArrow(tokens, _STAGED)


def _counts(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2"), minlength=vocabulary)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["id", "n"])

    out = np.zeros(vocabulary, np.int64)
    for r in tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # vocabulary rows at most
        out[r["id"]] = r["n"]
    return out


def _blocks(tokens: DataFrame, table: Table, block_tokens: int) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(table)
        held: list[tuple] = []  # consecutive documents of one part

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x[3] for x in held), "<u2")
            lanes = lanes_for(len(ids))
            words, checks = coder.encode(ids, lanes)
            payload = words.tobytes()
            known = np.array([x[2] is not None for x in held], np.uint8)
            docs = known.tobytes() + np.array([x[2] or 0 for x in held], "<i8").tobytes()
            lengths = np.array([len(x[3]) // 2 for x in held], "<i8").tobytes()
            row = [[held[0][0]], [held[0][1]], [held[0][4]], [len(ids)], [docs], [lengths], [lanes], [payload], [zlib.crc32(payload)], [_pack_checks(checks)]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], [x.split()[0] for x in _BLOCK.split(", ")])

        size = 0
        for batch in batches:
            for part, seq, doc, ids, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (part != held[-1][0] or seq != held[-1][1] + 1 or size >= block_tokens):
                    yield block()
                    held, size = [], 0
                held.append((part, seq, doc, ids, first))
                size += len(ids) // 2
        if held:
            yield block()

    return tokens.select("part", "seq", "doc_id", "ids", "first").mapInArrow(encode, _BLOCK)


def write_token_file(documents: DataFrame, out: str, path: str, end_id: int = 0, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the ids of documents, in ascending document id, to the folder out: `blocks`, `table` and `totals`."""
    spark = documents.sparkSession
    tokens = staged(_tokenized(documents, path, end_id, id_col, text_col), "tokens")
    table = Table.of(_counts(tokens, encoder(path).library.get_vocab_size()))
    _blocks(tokens, table, block_tokens).write.parquet(f"{out}/blocks")
    drop(tokens)
    present = np.flatnonzero(table.freq)
    spark.createDataFrame([(int(i), int(table.freq[i])) for i in present], "id int, freq int").coalesce(1).write.parquet(f"{out}/table")
    blocks = spark.read.schema(_BLOCK).parquet(f"{out}/blocks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("part").agg(F.sum("n").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))  # a row for each partition
    totals.coalesce(1).write.parquet(f"{out}/totals")
    return out


def read_token_file(spark: SparkSession, at: str, with_ids: bool = True) -> DataFrame:
    """One row per document of a token file: part, first (ids before it in the part), doc_id, n_tokens, ids_crc32, and its ids (little-endian 32-bit) if asked for."""
    rows = spark.read.schema("id int, freq int").parquet(f"{at}/table").collect()  # vocabulary rows at most
    freq = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.uint32)
    for r in rows:
        freq[r["id"]] = r["freq"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(Table(freq))
        for batch in batches:
            for part, seq, first, n, docs, lengths, lanes, payload, crc, checks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if zlib.crc32(payload) != crc:
                    raise ValueError(f"block {part}/{seq} does not match its checksum")
                size = np.frombuffer(lengths, "<i8")
                known = np.frombuffer(docs[: len(size)], np.uint8).astype(bool)
                doc = pa.array(np.frombuffer(docs[len(size) :], "<i8"), mask=~known)
                ids = coder.decode(np.frombuffer(payload, "<u4"), _unpack_checks(checks, lanes), n, lanes).astype("<u4")
                own = [x.tobytes() for x in np.split(ids, np.cumsum(size)[:-1])]
                columns = [pa.array([part] * len(size), pa.int32()), pa.array(first + np.cumsum(size) - size), doc, pa.array(size), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                names = ["part", "first", "doc_id", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(own, pa.binary())] if with_ids else columns, [*names, "ids"] if with_ids else names)

    blocks = spark.read.schema(_BLOCK).parquet(f"{at}/blocks")
    return blocks.mapInArrow(decode, "part int, first long, doc_id long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def documents_of(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document of a token file."""
    docs = read_token_file(spark, at, with_ids=False)
    totals = spark.read.schema("part int, n long, before long").parquet(f"{at}/totals")
    return docs.join(totals.select("part", "before"), "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(documents: DataFrame, path: str, end_id: int = 0, out: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of a token file that was written to out (by default in the shared folder) and read back."""
    spark = documents.sparkSession
    return documents_of(spark, write_token_file(documents, out or scratch_path(spark, "token-file"), path, end_id, id_col=id_col, text_col=text_col))


__all__ = ["Coder", "Table", "documents_of", "lanes_for", "read_token_file", "remove", "round_trip", "write_token_file"]
