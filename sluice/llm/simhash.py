"""Near-duplicates by SimHash: 64-bit fingerprints, linked at few differing bits, found with a hierarchical index in Gray order.

Fingerprints. A text's words (A-Z lower-cased, between ASCII white space) give its shingles, repeats included; each is hashed by XXH64 with seed
42, and a bit of the fingerprint is set if it is in over half of the hashes.

Index. A node of the index stands for fingerprints that agree in the bits of a mask: their pattern. The upper nodes are dealt out by Spark: of two
fingerprints that differ in at most `distance` bits, one of distance + 1 blocks of the bits that are not fixed yet is the same in both, so each fingerprint goes
below one node for each block, whose mask has that block's bits more. A node of over CELL fingerprints is parted again, by the blocks of its
open bits; with few open bits a node cannot be that large, so this ends. Counts are taken before the shuffle, and rows of large nodes are dealt
over tasks, so no task holds a large node.

A node of at most CELL is a cell. Its fingerprints are sorted by Gray rank, in which neighbours differ little, and cut into runs of FAN, and those into runs of
FAN * FAN. Each run's node factors out the bits that all below it share and that the node above does not fix already. A fingerprint goes down from the
top and adds up its differences from the patterns; past `distance` it leaves the whole group. What reaches the leaves is compared exactly. Cells
are gone through many at a time, as arrays; a cell hands on only a link to the least fingerprint of what it joins, not pairs.

The classes are the connected components of those links. Equal fingerprints are one node from the start.

Cases: a null or empty text, or one without words, has the fingerprint 0, which links like any other; one of fewer words than a shingle has one
shingle of all of them; repeated rows and ids agree; a row without an id is in its class but gives it no name (a class of such rows alone has none);
an empty table gives no rows. Extra columns stay out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bounded_broadcast, drop, staged
from .neardup import _dealt_join, _heavy, components

BITS, DISTANCE, WIDTH, SEED = 64, 3, 3, 42
#: Fingerprints of a cell, and of a node of its index for each one below.
CELL, FAN = 1024, 16
#: Hashes whose bits are counted at a time, and pairs of fingerprint and node that are held at a time.
HASHES, PAIRS = 1 << 14, 1 << 20
#: What a row of codes takes in a broadcast.
KEY_BYTES = 64


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """The fingerprint of a text in UTF-8, as unsigned integer."""
    words = text.lower().split() if text else []  # of bytes: A-Z, and ASCII white space
    if not words:
        return 0
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    spans = zip((ends - size)[: max(1, len(words) - width + 1)].tolist(), ends[min(width, len(words)) - 1 :].tolist(), strict=True)
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), HASHES):
        some = hashes[k : k + HASHES]
        counts += np.unpackbits(some.view(np.uint8), bitorder="little").reshape(len(some), BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, width: int = WIDTH) -> Column:
    """Column of fingerprints of whole texts, as signed long."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
        return pa.array(np.array([fingerprint(t.as_py(), width) for t in raw], np.uint64).view(np.int64))

    return of(text)


def hexadecimal(fingerprint: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def gray_rank(fingerprint: Column) -> Column:
    """The place of a fingerprint among all Gray codes, as a signed long in the same order."""
    for shift in (1, 2, 4, 8, 16, 32):
        fingerprint = fingerprint.bitwiseXOR(F.shiftrightunsigned(fingerprint, shift))
    return fingerprint.bitwiseXOR(F.lit(-(1 << 63)))


def open_blocks(mask: int, parts: int) -> list[int]:
    """The bits that a mask leaves open, cut into parts of nearly equal size; each as a mask that has the given one's bits too."""
    free = [k for k in range(BITS) if not mask >> k & 1]
    return [mask | sum(1 << k for k in free[len(free) * p // parts : len(free) * (p + 1) // parts]) for p in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number of the connected component of each of n nodes, by the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _children(at: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into at, child) of all children of the nodes at."""
    n = count[at]
    of = np.repeat(np.arange(len(at)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at], n)


class GrayIndex:
    """The index of whole cells that stand one after another, each sorted by Gray rank."""

    def __init__(self, codes: np.ndarray, cell: np.ndarray):
        self.codes, self.cell = codes, cell
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        within = np.arange(len(codes)) - np.repeat(starts, np.diff(np.r_[starts, len(codes)]))
        #: From the leaves up: (first child, children, pattern, bits it fixes that the node above does not); the children of the lowest are the codes.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        low = high = codes
        step, spans = 1, []
        while step < CELL:
            step *= FAN
            spans.append(np.flatnonzero(within % step == 0))
        below = np.arange(len(codes))
        shared: list[np.ndarray] = []
        for first in spans:
            at = np.searchsorted(below, first)
            low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
            shared.append(~(low ^ high))
            self.levels.append((at, np.diff(np.r_[at, len(below)]), low, shared[-1].copy()))
            below = first
        for k in range(len(self.levels) - 1):  # a node keeps what its parent leaves open
            parent = np.repeat(np.arange(len(self.levels[k + 1][1])), self.levels[k + 1][1])
            self.levels[k] = (*self.levels[k][:3], shared[k] & ~shared[k + 1][parent])
        self.tops = spans[-1]
        #: Bits left to the leaves.
        self.open = ~np.repeat(shared[0], self.levels[0][1])

    def search(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(a, b): places of codes of one cell that differ in at most distance bits, a before b; some at a time."""
        top = np.searchsorted(self.tops, np.arange(len(self.codes)), "right") - 1  # a cell has one top node, as it holds at most CELL codes
        size = np.diff(np.r_[self.tops, len(self.codes)])[top]
        batch = (np.cumsum(size) - size) // PAIRS
        for low, high in zip(*(lambda s: (s, np.r_[s[1:], len(batch)]))(np.flatnonzero(np.r_[True, batch[1:] != batch[:-1]])), strict=True):
            query = np.arange(low, high)
            node, sum_ = top[query], np.zeros(len(query), np.uint8)
            for k in range(len(self.levels) - 1, -1, -1):
                first, count, pattern, own = self.levels[k]
                sum_ = sum_ + np.bitwise_count((self.codes[query] ^ pattern[node]) & own[node])
                near = sum_ <= distance
                query, node, sum_ = query[near], node[near], sum_[near]
                of, node = _children(node, first, count)
                query, sum_ = query[of], sum_[of]
            later = node > query
            query, node, sum_ = query[later], node[later], sum_[later]
            near = sum_ + np.bitwise_count((self.codes[query] ^ self.codes[node]) & self.open[node]) <= distance
            yield query[near], node[near]


def cell_links(codes: np.ndarray, cell: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, code of the first of its component) for whole cells sorted by Gray rank; one link for each code that is not first."""
    label = np.arange(len(codes))
    if not len(codes):
        return codes, codes
    for a, b in GrayIndex(codes, cell).search(distance):
        label = joined(len(codes), np.r_[np.arange(len(codes)), a], np.r_[label, b])
    moved = np.flatnonzero(label != np.arange(len(codes)))
    return codes[moved], codes[label[moved]]


def _search(cells: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) from rows (code, node) of cells; a cell's rows come to one task, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3

        def links(rows: list[np.ndarray]) -> pa.RecordBatch:
            code, mask, pattern = rows
            cell = np.cumsum(np.r_[False, (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])])[: len(code)]
            a, b = cell_links(code.view(np.uint64), cell, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            last = np.flatnonzero((held[1] != held[1][-1]) | (held[2] != held[2][-1])) if len(held[0]) else []
            cut = int(last[-1]) + 1 if len(last) else 0  # the last cell may go on in the next batch
            yield links([h[:cut] for h in held])
            held = [h[cut:].copy() for h in held]
        yield links(held)

    dealt = cells.select("code", "node.*").repartition("mask", "pattern").sortWithinPartitions("mask", "pattern", gray_rank(F.col("code")))
    return dealt.mapInArrow(run, "a long, b long")


def links(codes: DataFrame, distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """Links (a, b) between the distinct codes of the frame's column `code`, which join the same codes as all pairs of at most distance differing bits do.

    At most distance + 1 rows of two longs for each code and level; a level's nodes of over `cell` codes go on to the next.
    """
    if not 1 < cell <= CELL:
        raise ValueError(f"a cell holds 2 to {CELL} codes, not {cell}")
    parts, masks, found = distance + 1, [0], []
    open_rows, before = codes.select("code", F.lit(0).cast("long").alias("mask")), None
    while masks:
        finer = [F.when(F.col("mask") == _signed(m), F.array(*[F.lit(_signed(b)).cast("long") for b in open_blocks(m, parts)])) for m in masks]
        rows = open_rows.select("code", F.explode(F.coalesce(*finer)).alias("mask"))
        rows = rows if before is None else rows.distinct()  # two nodes may have one below them
        rows = staged(rows.withColumn("node", F.struct("mask", F.col("code").bitwiseAND(F.col("mask")).alias("pattern"))), "nodes")
        sizes = staged(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
        placed = staged(_dealt_join(rows, sizes, "node", "code", _heavy(rows, "node", rows.count())), "placed")
        drop(rows, sizes, *([before] if before else []))
        found.append(staged(_search(placed.where(F.col("n") <= cell), distance), "links"))
        open_rows, before = placed.where(F.col("n") > cell).select("code", "mask"), placed
        masks = [r["mask"] & (1 << 64) - 1 for r in open_rows.select("mask").distinct().collect()]  # at most parts times as many as before
    drop(before)
    return reduce(DataFrame.unionByName, found)


def simhash_duplicates(documents: DataFrame, distance: int = DISTANCE, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (long) and component_id (the least doc_id of its class) of each row."""
    marked = documents.select(F.col(id_col).cast("long").alias("doc_id"), fingerprints(F.col(text_col), width).alias("code"))
    marked = staged(marked.withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    nodes = staged(marked.groupBy("code").agg(F.min("doc_id").alias("first")), "codes")
    linked = components(links(nodes, distance))
    linked = staged(linked.join(nodes, F.col("key") == F.col("code")).select("code", "comp", "first"), "linked")
    total = linked.count()
    least = linked.groupBy("comp").agg(F.min("first").alias("least"))
    wider = _dealt_join(linked, least, "comp", "code", _heavy(linked, "comp", total)).select("code", "least")
    named = nodes.join(bounded_broadcast(wider, total, KEY_BYTES), "code", "left").select("code", F.coalesce("least", "first").alias("component_id"))
    named = staged(named, "named")
    drop(nodes, linked)
    rows = _dealt_join(marked, named, "code", "row", _heavy(marked, "code", marked.count()))
    return rows.select("doc_id", F.col("code").alias("fingerprint"), "component_id")
