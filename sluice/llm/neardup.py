"""Near-duplicate detection by improved consistent weighted sampling over TF-IDF shingles.

Weights. A shingle is five consecutive words (a text of fewer words is one shingle). Its weight is its count in the text times the mean inverse
document frequency of its words, 1 + ln((N + 1) / (df + 1)). Document frequencies are counted over all documents into a table of fixed size
(IDF_BUCKETS hashed words), which is all that is broadcast. Taking the frequency of words, not of shingles, keeps copies
from making their own shingles light.

Candidates. For each of HASHES hash functions, a text's sample is the shingle, with its quantized weight, that is least by ICWS;
two texts share a sample with the probability of their weighted Jaccard similarity. Bands of BAND samples each are hashed, and texts
that share a band are candidates.

Verification. A link counts only if the exact weighted Jaccard similarity of the whole texts reaches the threshold. Texts with equal
words are one node from the start. A bucket's top is the node in it that shares most buckets with others, which is the original of a family of
copies rather than one of its edits. Each node is first checked against one leader, the greatest of the tops of its buckets, and connected
components follow. What is left is every pair of nodes that share a bucket but not a component. These meet in cells: the cell of a top holds the
nodes of the buckets that it tops, so every such pair shares a cell, and a node is in few cells. A task checks the pairs of a cell against each
other in place, those that share most bands first, and joins components as it finds links, so that it puts out fewer links than it has nodes
and no pair is ever a row. Pairs are passed over only where it is certain that they do not reach the threshold: by the distances to a common leader
(1 - similarity is a metric), or by sketches (weights by hashed bucket). A cell of more than CELL nodes, long texts counting more, is cut into blocks
by a hash; its heaviest component, in which no pair is left to check, is cut apart from the rest, and each of its blocks meets those of the rest, which meet each
other. Two blocks make a task's group, so groups stay bounded, no pair is missed, and a cell of one component and a few strays costs in proportion to its nodes. Classes are the components of all links.

Work in Spark: signatures, nodes and links are staged tables in the shared folder; the driver sees counts only. Hot buckets are met by
a join with the few large buckets, whose number their size bounds. Where many rows name one key (the leader of a large family, its component, the words of exact
copies), they are dealt over parts, each with a copy of what is joined to them; the table of such keys is bounded by their rows. All else goes by shuffled joins.

Cases: a text without words (or null) is a class of its own, with a null class id if its own id is null; repeated rows fall into one class; ties
between representatives go to the smaller id; an empty table gives no rows. Extra columns are kept by deduplicate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded_broadcast, drop, staged

WIDTH = 5
THRESHOLD = 0.8
HASHES = 24
#: Band k takes the samples k + d, modulo HASHES, for these steps d.
STEPS = (0, 1, 5, 11)
IDF_BUCKETS = 1 << 18
#: A cell is cut into blocks of about this weight: 1 for a node, and 1 more for every LONG characters.
CELL, LONG = 384, 24_000
#: What a row of keys, and a row of what a cell knows of a node, takes in a broadcast.
KEY_BYTES, FACT_BYTES = 64, 600
SKETCH = 256
#: Pairs whose sketches are compared together.
PAIRS = 4096
HOT_SHARE = 20_000
#: A key of more rows than this is dealt over parts in a join; of more than 1 / HOT_SHARE of all rows, where that is more.
HEAVY = 100
STEP = 64
KEEP_WORDS = 250_000
_WORD = re.compile(r"\w+")
_MIX1, _MIX2, _ROLL = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_SIG = [("doc_id", T.LongType()), ("row", T.LongType()), ("key", T.BinaryType()), ("bands", T.ArrayType(T.LongType())), ("text", T.StringType())]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of texts as 64-bit hashes; remembers those it has met."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def hashes(self, text: str | None) -> np.ndarray:
        if len(self.known) > KEEP_WORDS:
            self.known.clear()
        words, known = _WORD.findall(text.lower()) if text else [], self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes in order, their weights) of a text's word hashes."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.float32)
    width = min(WIDTH, n)
    each = idf[(words & np.uint64(IDF_BUCKETS - 1)).astype(np.int64)]
    h, w = words[: n - width + 1].copy(), each[: n - width + 1].astype(np.float64)
    for k in range(1, width):
        h = h * _ROLL + words[k : n - width + 1 + k]
        w = w + each[k : n - width + 1 + k]
    own, first, count = np.unique(_mix(h), return_index=True, return_counts=True)
    return own, (w[first] / width * count).astype(np.float32)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: the sum of the lesser weights over that of the greater; 0 if either is empty."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    low = float(np.minimum(a[1][same], b[1][at[same]]).sum(dtype=np.float64))
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64))
    return low / (total - low) if total > low else 0.0


@lru_cache(maxsize=1)
def _gamma_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gamma(2, 1) by quantiles: r and 1 / r from 16 bits, ln c from 18; the same in every worker by a fixed bisection."""

    def quantiles(bits: int) -> np.ndarray:
        p = (np.arange(1 << bits) + 0.5) / (1 << bits)
        low, high = np.zeros_like(p), np.full_like(p, 60.0)
        for _ in range(60):
            mid = (low + high) / 2
            under = 1 - np.exp(-mid) * (1 + mid) < p
            low, high = np.where(under, mid, low), np.where(under, high, mid)
        return (low + high) / 2

    r = quantiles(16)
    return r.astype(np.float32), (1 / r).astype(np.float32), np.log(quantiles(18)).astype(np.float32)


def samples(own: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """texts x HASHES: the consistent sample of each text, as a hash of shingle and quantized weight. No text is empty."""
    r_of, inverse, ln_c = _gamma_tables()
    starts = np.cumsum(counts) - counts
    log_w = np.log(weight)
    of = np.repeat(np.arange(len(counts)), counts)
    out = np.empty((len(counts), HASHES), np.uint64)
    for k in range(HASHES):
        z = own * np.uint64(2 * k + 0x9E3779B97F4A7C15) + np.uint64(k * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(29))) * _MIX2
        z ^= z >> np.uint64(32)
        q = (z & np.uint64(0xFFFF)).astype(np.int32)
        beta = (z >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
        t = np.floor(log_w * inverse[q] + beta)
        value = ln_c[((z >> np.uint64(16)) & np.uint64(0x3FFFF)).astype(np.int32)] - r_of[q] * (t - beta + np.float32(1))
        least = np.minimum.reduceat(value, starts)
        at = np.flatnonzero(value == least[of])
        first = at[np.searchsorted(at, starts)]
        out[:, k] = _mix(own[first] + _ROLL * (t[first].astype(np.int64).astype(np.uint64) + np.uint64(k << 32)))
    return out


def bands(sample: np.ndarray) -> np.ndarray:
    """texts x HASHES: each band's hash, its number included."""
    out = np.zeros_like(sample)
    for k in range(HASHES):
        h = np.full(len(sample), k + 1, np.uint64)
        for d in STEPS:
            h = _mix(h * _ROLL + sample[:, (k + d) % HASHES])
        out[:, k] = h
    return out


def inverse_frequencies(documents: DataFrame, text_col: str = "text") -> np.ndarray:
    """Of each hashed word bucket 1 + ln((N + 1) / (df + 1)), over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total, n = Words(), np.zeros(IDF_BUCKETS + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = words.hashes(text)
                n += 1
                hit = np.unique((own & np.uint64(IDF_BUCKETS - 1)).astype(np.int64))
                total[hit] += 1
        total[IDF_BUCKETS] = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    got = documents.select(text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # IDF_BUCKETS + 1 rows at most
    df = np.zeros(IDF_BUCKETS + 1)
    df[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return (1 + np.log((df[-1] + 1) / (df[:-1] + 1))).astype(np.float32)


def signatures(documents: DataFrame, idf: np.ndarray, id_col: str = "doc_id", text_col: str = "text", rest: bool = False) -> DataFrame:
    """doc_id, row (unique), key (128-bit hash of the words, null without words), bands, the text itself and, if asked for, a struct of the rest."""
    others = F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != text_col]).alias("rest")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([others] if rest else []))
    schema = T.StructType([*[T.StructField(*field) for field in _SIG], *docs.schema.fields[2:]])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, row = Words(), TaskContext.get().partitionId() << 33
        for batch in batches:
            for k in range(0, batch.num_rows, STEP):
                some = batch.slice(k, STEP)
                own = [words.hashes(t) for t in some.column(1).to_pylist()]
                full = [i for i, w in enumerate(own) if len(w)]
                key: list[bytes | None] = [xxhash.xxh3_128_digest(w.tobytes()) if len(w) else None for w in own]
                hashed: list[list[int] | None] = [None] * len(own)
                if full:
                    sets = [shingles(own[i], idf) for i in full]
                    got = bands(samples(np.concatenate([s for s, _ in sets]), np.concatenate([w for _, w in sets]), np.array([len(s) for s, _ in sets])))
                    for i, b in zip(full, got.astype(np.int64), strict=True):
                        hashed[i] = b
                columns = [some.column(0), pa.array(range(row, row + len(own)), pa.int64()), pa.array(key, pa.binary()), pa.array(hashed, pa.list_(pa.int64())), *some.columns[1:]]
                yield pa.RecordBatch.from_arrays(columns, schema.names)
                row += len(own)

    return docs.mapInArrow(sign, schema)


def _with_sets(rows: DataFrame, idf: np.ndarray) -> DataFrame:
    """rows (key, text, ...) with the shingles of their texts, hashes and weights, for the text; rows of one key stand together."""
    kept = [f for f in rows.schema.fields if f.name != "text"]
    names = [f.name for f in kept]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, own = Words(), None, (b"", b"")
        for batch in batches:
            sets = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if key != last:
                    h, w = shingles(words.hashes(text), idf)
                    last, own = key, (h.tobytes(), w.tobytes())
                sets.append(own)
            columns = [batch.column(n) for n in names] + [pa.array([x[k] for x in sets], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "hashes", "weights"])

    return rows.mapInArrow(cut, T.StructType([*kept, T.StructField("hashes", T.BinaryType()), T.StructField("weights", T.BinaryType())]))


def _heavy(rows: DataFrame, key: str, total: int) -> DataFrame:
    """(key, parts) of the keys that many of the rows, total in all, have; at most HOT_SHARE keys. Counted before the shuffle."""
    large = max(HEAVY, -(-total // HOT_SHARE))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large).select(key, F.ceil(F.col("n") / large).alias("parts"))


def _dealt_join(rows: DataFrame, table: DataFrame, key: str, by: str, heavy: DataFrame, how: str = "inner") -> DataFrame:
    """rows with what table, one row a key, has of their key; rows of a heavy key are dealt over its parts by a hash of the column `by`."""
    parts, heavy = F.coalesce("parts", F.lit(1)).cast("long"), F.broadcast(heavy)
    dealt = rows.join(heavy, key, "left").withColumn("part", F.pmod(F.xxhash64(by), parts)).drop("parts")
    copies = table.join(heavy, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    return dealt.join(copies, [key, "part"], how).drop("part")


def _measured(pairs: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(a, b, sim): the exact similarity of the pairs' texts."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        held: dict[bytes, tuple] = {}

        def of(key: bytes, text: str) -> tuple:
            if key not in held:
                if len(held) >= 32:
                    held.pop(next(iter(held)))
                held[key] = shingles(words.hashes(text), idf)
            return held[key]

        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            sim = [similarity(of(j, s), of(k, t)) for j, k, s, t in zip(a, b, x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim, pa.float64())], ["a", "b", "sim"])

    n = pairs.count()
    x = texts.select(F.col("key").alias("a"), F.col("text").alias("x")).join(bounded_broadcast(pairs, n, KEY_BYTES), "a")
    y = texts.join(bounded_broadcast(pairs.select(F.col("b").alias("key")), n, KEY_BYTES), "key", "left_semi")
    both = _dealt_join(x, y.select(F.col("key").alias("b"), F.col("text").alias("y")), "b", "a", _heavy(pairs, "b", n)).select("a", "b", "x", "y")
    return both.mapInArrow(measure, "a binary, b binary, sim double")


def components(links: DataFrame) -> DataFrame:
    """(key, comp): the least key of the connected component of each key that has a link (a, b).

    Rounds of taking the least of the label, the label's own label and those of the neighbours, until nothing changes; each round is staged. Nodes of
    many links, and labels of many nodes, are dealt over tasks.
    """
    edges = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("comp")), "labels")
    hubs = staged(_heavy(edges, "b", edges.count()), "hubs")
    total = labels.count()
    while True:
        near = _dealt_join(edges, labels.select(F.col("key").alias("b"), F.col("comp").alias("near")), "b", "a", hubs).groupBy("a").agg(F.min("near").alias("near"))
        own = labels.select("key", "comp")
        jump = _dealt_join(own, own.select(F.col("key").alias("comp"), F.col("comp").alias("jump")), "comp", "key", _heavy(own, "comp", total))
        lower = jump.join(near.withColumnRenamed("a", "key"), "key")
        new = staged(lower.select("key", F.col("comp").alias("was"), F.least("comp", "jump", "near").alias("comp")), "labels")
        changed = new.where(F.col("was") != F.col("comp")).limit(1).count()
        drop(labels)
        labels = new
        if not changed:
            drop(edges, hubs)
            return labels.select("key", "comp")


def _hot_join(rows: DataFrame, buckets: DataFrame, total: int) -> DataFrame:
    """rows with what buckets (bucket, size, ...) has of their bucket; large buckets, few by their size, meet rows by a broadcast."""
    large = max(1000, total * HASHES // HOT_SHARE)  # there are at most HOT_SHARE buckets of more nodes
    hot, cold = buckets.where(F.col("size") > large), buckets.where(F.col("size") <= large)
    rest = rows.join(F.broadcast(hot.select("bucket")), "bucket", "left_anti")
    return rows.join(F.broadcast(hot), "bucket").unionByName(rest.join(cold, "bucket"))


class Joined:
    """Components that have been joined, by path halving."""

    def __init__(self):
        self.root: dict[bytes, bytes] = {}

    def find(self, k: bytes) -> bytes:
        root = self.root
        while (up := root.get(k, k)) != k:
            root[k] = k = root.get(up, up)
        return k


def links_of(comp: list, lead: list, far: np.ndarray, bands: np.ndarray, sets: list, side: np.ndarray, threshold: float) -> list[tuple]:
    """Links (component, component) that join the components of the nodes of one group, as few as do so.

    side: 0 and 1 for nodes of two blocks, whose pairs across are looked at; all 0 for pairs inside one block.
    """
    n = len(comp)
    number = lambda values: np.unique(np.array(values, object), return_inverse=True)[1]
    of, by = number(comp), number(lead)
    shared = np.zeros((n, n), np.uint8)
    for k in range(HASHES):
        shared += bands[:, k, None] == bands[None, :, k]
    able = (shared > 0) & (of[:, None] != of[None, :])
    able &= ~((by[:, None] == by[None, :]) & (np.abs(far[:, None] - far[None, :]) > 1 - threshold + 1e-9))
    total = np.array([w.sum(dtype=np.float64) for _, w in sets])
    able &= np.minimum(total[:, None], total[None, :]) >= threshold * np.maximum(total[:, None], total[None, :]) * (1 - 1e-6)
    able &= side[:, None] != side[None, :] if side.any() else True
    a, b = np.nonzero(np.triu(able, 1))
    order = np.argsort(-shared[a, b].astype(np.int16), kind="stable")
    a, b = a[order], b[order]
    sketch = np.stack([np.bincount((h % np.uint64(SKETCH)).astype(np.int64), w, SKETCH) for h, w in sets]) if len(a) else None
    joined, out = Joined(), []
    for k in range(0, len(a), PAIRS):
        x, y = a[k : k + PAIRS], b[k : k + PAIRS]
        apart, sum_ = np.abs(sketch[x] - sketch[y]).sum(axis=1), total[x] + total[y]  # the similarity is at most (sum - apart) / (sum + apart)
        near = sum_ - apart >= threshold * (sum_ + apart) - 1e-6 * sum_
        for i, j in zip(x[near].tolist(), y[near].tolist(), strict=True):
            u, v = joined.find(comp[i]), joined.find(comp[j])
            if u != v and similarity(sets[i], sets[j]) >= threshold:
                joined.root[u] = v
                out.append((comp[i], comp[j]))
    return out


def _cell_links(cells: DataFrame, facts: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Links (a, b) between components from cells (top, key); facts: key, comp, lead, far, weight, bands; texts: key, text.

    A cell of at most CELL in weight is one group. Of a larger one, the nodes of its heaviest component (main) need no look at each other: they
    are cut into blocks, each of which meets every block of the other nodes (rest); and the blocks of the rest meet each other.
    """
    met = staged(cells.join(facts, "key"), "met")
    each = met.groupBy("top", "comp").agg(F.sum("weight").alias("w"))
    whole = each.groupBy("top").agg(F.sum("w").alias("total"), F.max(F.struct("w", "comp")).alias("most"))
    blocks = lambda w: F.greatest(F.ceil(w / CELL), F.lit(1)).cast("int")
    large = whole.where(F.col("total") > CELL).select("top", F.col("most.comp").alias("main"), blocks(F.col("most.w")).alias("mains"), blocks(F.col("total") - F.col("most.w")).alias("rests"))
    large = staged(large, "large")
    cut = _dealt_join(met, large, "top", "key", _heavy(met, "top", met.count()), "left")
    at = lambda n: F.pmod(F.xxhash64("key"), n.cast("long")).cast("int")
    spot = lambda low, high, side: F.struct(F.lit(low).alias("low") if isinstance(low, int) else low.alias("low"), F.lit(high).alias("high") if isinstance(high, int) else high.alias("high"), side.cast("tinyint").alias("side"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    mains, rests = F.col("mains"), F.col("rests")
    # blocks are numbered with those of the main component first
    as_main = F.transform(every(rests), lambda b: spot(at(mains), mains + b, F.lit(0)))
    own = mains + at(rests)
    as_rest = F.concat(F.transform(every(mains), lambda a: spot(a, own, F.lit(1))), F.transform(every(rests), lambda b: spot(F.least(own, mains + b), F.greatest(own, mains + b), own > mains + b)))
    spots = F.when(F.col("main").isNull(), F.array(spot(0, 0, F.lit(0)))).when(F.col("comp") == F.col("main"), as_main).otherwise(as_rest)
    placed = staged(cut.withColumn("spot", F.explode(spots)).select(*met.columns, "spot.*"), "placed")
    rows = texts.select("key", "text").join(bounded_broadcast(placed, placed.count(), FACT_BYTES), "key")
    full = _with_sets(rows, idf)

    def check(group: pa.Table) -> pa.Table:
        side, links = group.column("side").to_numpy(), []
        if group.column("low")[0] == group.column("high")[0] or 0 < side.sum() < len(side):
            c = {name: group.column(name).to_pylist() for name in ("comp", "lead", "bands", "hashes", "weights")}
            sets = [(np.frombuffer(h, np.uint64), np.frombuffer(w, np.float32)) for h, w in zip(c["hashes"], c["weights"], strict=True)]
            links = links_of(c["comp"], c["lead"], group.column("far").to_numpy(), np.array(c["bands"], np.int64), sets, side, threshold)
        return pa.table({name: pa.array([x[k] for x in links], pa.binary()) for k, name in enumerate("ab")})

    return full.groupBy("top", "low", "high").applyInArrow(check, "a binary, b binary")


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, class_id (the least doc_id of its class), representative (true for one row of each class), by document row."""
    return _classes(documents, threshold, id_col, text_col)[0]


def _classes(documents: DataFrame, threshold: float, id_col: str, text_col: str, rest: bool = False) -> tuple[DataFrame, DataFrame]:
    idf = inverse_frequencies(documents, text_col)
    signed = staged(signatures(documents, idf, id_col, text_col, rest), "signed")
    worded = signed.where(F.col("key").isNotNull())
    nodes = staged(worded.groupBy("key").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.first("bands").alias("bands")), "nodes")
    total = nodes.count()
    each = nodes.select("key", F.explode("bands").alias("bucket"))
    sizes = staged(each.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    members = staged(_hot_join(each, sizes, total), "members")
    wanted = members.groupBy("key").agg(F.sum(F.col("size") - 1).alias("degree")).join(nodes.select("key", F.col("first.row").alias("row")), "key")
    wanted = staged(wanted, "wanted")
    picked = bounded_broadcast(wanted.select("row"), wanted.count(), KEY_BYTES)
    texts = staged(signed.select("row", "key", "text").join(picked, "row", "left_semi").select("key", "text", (1 + F.floor(F.length("text") / LONG)).alias("weight")), "texts")
    ranked = staged(members.join(wanted.select("key", "degree"), "key"), "ranked")
    tops = staged(ranked.groupBy("bucket").agg(F.max("size").alias("size"), F.max(F.struct("degree", "key")).alias("top")), "tops")
    led = _hot_join(ranked.select("bucket", "key"), tops, total).where(F.col("key") != F.col("top.key"))
    best = led.groupBy("key").agg(F.max("top").alias("top")).select(F.col("key").alias("a"), F.col("top.key").alias("b"))
    best = staged(best, "best")
    measured = staged(_measured(best, texts, idf), "measured")
    comps = components(measured.where(F.col("sim") >= threshold).select("a", "b"))
    # comp of nodes without a link is the node itself
    facts = wanted.select("key").join(comps, "key", "left").join(measured.select(F.col("a").alias("key"), F.col("b").alias("lead"), (1 - F.col("sim")).alias("far")), "key", "left")
    facts = staged(facts.select("key", F.coalesce("comp", "key").alias("comp"), F.coalesce("lead", "key").alias("lead"), F.coalesce("far", F.lit(0.0)).alias("far")), "facts")
    spread = members.join(facts.select("key", "comp"), "key").groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high")
    topped = tops.join(spread.select("bucket"), "bucket")
    cells = staged(_hot_join(members.select("bucket", "key"), topped, total).select(F.col("top.key").alias("top"), "key").distinct(), "cells")
    spread_keys = staged(cells.select("key").distinct(), "spread")
    known = nodes.select("key", "bands").join(bounded_broadcast(spread_keys, spread_keys.count(), KEY_BYTES), "key", "left_semi")
    more = staged(_cell_links(cells, facts.join(texts.select("key", "weight"), "key").join(known, "key"), texts, idf, threshold), "links")
    named = nodes.select("key", "first").join(comps, "key", "left").select("key", "first", F.coalesce("comp", "key").alias("comp"))
    if not more.isEmpty():
        wider = components(more).select(F.col("key").alias("comp"), F.col("comp").alias("wider"))
        named = staged(named, "named")
        named = _dealt_join(named, wider, "comp", "key", _heavy(named, "comp", total), "left").select("key", "first", F.coalesce("wider", "comp").alias("comp"))
    named = staged(named, "named")
    least = named.groupBy("comp").agg(F.min("first").alias("head"))
    heads = staged(_dealt_join(named, least, "comp", "key", _heavy(named, "comp", total)).select("key", "head"), "heads")
    own = worded.select("doc_id", "row", "key")
    rows = _dealt_join(own, heads, "key", "row", _heavy(own, "key", own.count())).unionByName(signed.where(F.col("key").isNull()).select("doc_id", "row", "key"), allowMissingColumns=True)
    out = rows.select(
        "doc_id",
        "row",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce(F.col("row") == F.col("head.row"), F.col("key").isNull()).alias("representative"),
    )
    drop(members, ranked, texts, cells, wanted, tops, nodes, sizes, best, measured, facts, spread_keys, more)
    return out, signed


def deduplicate(documents: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents with one row of each class left, all columns kept.

    Rows are read once: the signed table carries all columns, and the rows that go are looked up in it by number.
    """
    classes, signed = _classes(documents, threshold, id_col, text_col, rest=True)
    gone = staged(classes.where(~F.col("representative")).select("row"), "gone")
    kept = signed.join(bounded_broadcast(gone, gone.count(), KEY_BYTES), "row", "left_anti")
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in documents.columns])


__all__ = ["components", "deduplicate", "inverse_frequencies", "near_duplicates", "shingles", "signatures", "similarity"]
