"""Benchmark decontamination: a broadcast hash table of n-gram windows against every token window of the corpus.

Main path: DataFrame functions only. The windows of the benchmark are hashed into a small table; each document is
split into words once, its word positions are exploded, and the hash of the window that starts at each position is
looked up by a broadcast join inside the same stage. A match of hashes is verified word by word before it counts, and
only verified positions are shuffled.

Cases: null texts have no words and no hits. A benchmark item of fewer than n words, but at least one, is one window; an item
with none, or with a null id, takes no part. Repeated rows of documents each give their own row; repeated benchmark items
with one id count once. Empty tables give empty results. Extra columns are kept by remove_contaminated, whatever their
names, and ignored by scan_windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_BYTES, ascii_words, bounded_broadcast, free_name, staged

#: What a row of windows, a word or an id in it, and a row of keys of contaminated documents take in a broadcast beside their bytes.
ROW_BYTES, VALUE_BYTES, KEY_BYTES = 128, 16, 64
#: One word with what follows it, in the text as it is (upper case included): the unit that remove_contaminated takes out.
_WORD_AND_GAP = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)"
_LEADING_GAP = r"^([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)"


def benchmark_windows(benchmark: DataFrame, n: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(size, window, hash, items): every distinct window of the benchmark with the ids, as strings, of its items."""
    words = benchmark.select(F.col(item_col).cast("string").alias("item"), ascii_words(F.col(text_col)).alias("words")).where(F.col("item").isNotNull() & (F.size("words") > 0))
    size = F.least(F.lit(n), F.size("words"))
    starts = F.explode(F.sequence(F.lit(1), F.size("words") - size + 1))
    cut = words.select("item", "words", size.alias("size"), starts.alias("at")).select("item", "size", F.slice("words", F.col("at"), F.col("size")).alias("window"))
    return cut.groupBy("size", "window").agg(F.collect_set("item").alias("items")).withColumn("hash", F.xxhash64("window"))


def _hits(docs: DataFrame, windows: DataFrame, keys: list[str], sentinel: bool) -> DataFrame:
    """keys, n_words, pos, size, items: verified window starts; with sentinel also one row of nulls for each document.

    docs has the keys and an array column `words`.
    """
    held = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + F.octet_length(x) + VALUE_BYTES)
    known = {r["size"]: r["bytes"] for r in windows.groupBy("size").agg(F.sum(held("window") + held("items") + ROW_BYTES).alias("bytes")).collect()}  # at most n rows
    small = sum(known.values()) <= BROADCAST_BYTES
    if not small:  # read twice below, and rows are to have the same numbers both times
        docs = staged(docs.select(*keys, "words"), "worded")
    each = docs.select(*keys, "words", F.size("words").alias("n_words"), F.posexplode_outer("words").alias("pos", "word"))
    sizes = sorted(known) or [1]
    # xxhash64 of an array folds its elements just as xxhash64 of several columns does, so both sides agree.
    hashes = {k: F.when(F.col("pos") <= F.col("n_words") - k, F.xxhash64("word", *[F.get("words", F.col("pos") + i) for i in range(1, k)])) for k in sizes}
    if len(sizes) == 1:
        each = each.withColumns({"size": F.lit(sizes[0]), "hash": hashes[sizes[0]]})
    else:
        each = each.withColumn("at", F.explode(F.array(*[F.struct(F.lit(k).alias("size"), h.alias("hash")) for k, h in hashes.items()])))
        each = each.withColumns({"size": F.col("at.size"), "hash": F.col("at.hash")})
    right = windows.select(F.col("size").alias("w_size"), F.col("hash").alias("w_hash"), "window", "items")
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    if small:
        met = each.join(F.broadcast(right), (F.col("hash") == F.col("w_hash")) & (F.col("size") == F.col("w_size")), "left")
        if not sentinel:
            met = met.where(F.col("window").isNotNull())
    else:  # too many windows to broadcast: positions meet them in a shuffled join, and carry their window to be verified
        plain = each.where(F.col("hash").isNotNull()).withColumn("words_at", F.slice("words", F.col("pos") + 1, F.col("size"))).drop("words", "word")
        met = plain.join(right, (F.col("hash") == F.col("w_hash")) & (F.col("size") == F.col("w_size")))
        met = met.where(F.col("words_at") == F.col("window")).select(*keys, "n_words", "pos", "size", "items")
        if sentinel:
            met = met.unionByName(each.where(first).select(*keys, "n_words", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("array<string>").alias("items")))
        return met
    same = F.slice("words", F.col("pos") + 1, F.col("size")) == F.col("window")
    found = F.col("window").isNotNull() & same
    out = met.where(found | first if sentinel else found)
    return out.select(*keys, "n_words", *[F.when(found, F.col(c)).alias(c) for c in ("pos", "size", "items")])


def _covered(spans):
    """Number of word positions inside the union of [pos, pos + size) of an array of (pos, size), sorted by position."""
    start = F.struct(F.lit(0).alias("till"), F.lit(0).alias("n"))

    def step(acc, s):
        end = s["pos"] + s["size"]
        return F.struct(F.greatest(acc["till"], end).alias("till"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["till"], s["pos"]))).alias("n"))

    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"])


def scan_windows(documents: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, item_ids (sorted array of strings), spans (array of (pos, size))."""
    windows = staged(benchmark_windows(benchmark, n), "windows")
    docs = documents.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), ascii_words(F.col(text_col)).alias("words"))
    hits = _hits(docs, windows, ["row", "doc_id"], sentinel=True)
    per = hits.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").cast("long").alias("n_words"),
        F.collect_set(F.when(F.col("pos").isNotNull(), F.struct("pos", "size"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
    )
    return per.select("doc_id", "n_words", _covered(F.col("spans")).cast("long").alias("n_hit"), "item_ids", F.array_sort("spans").alias("spans"))


def _gaps(spans: Column, n: Column) -> Column:
    """(start, words) of the runs of word positions below n that no span covers; spans: array of (pos, size), sorted by position."""
    begin = F.struct(F.lit(0).alias("till"), F.array().cast("array<struct<at:int,n:int>>").alias("gaps"))

    def step(acc, s):
        gap = F.struct(acc["till"].alias("at"), (s["pos"] - acc["till"]).alias("n"))
        return F.struct(F.greatest(acc["till"], s["pos"] + s["size"]).alias("till"), F.when(s["pos"] > acc["till"], F.array_append(acc["gaps"], gap)).otherwise(acc["gaps"]).alias("gaps"))

    end = lambda acc: F.array_append(acc["gaps"], F.struct(acc["till"].alias("at"), F.greatest(n - acc["till"], F.lit(0)).alias("n")))
    return F.aggregate(F.array_sort(spans), begin, step, end)


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents without the contaminated rows (remove='documents') or with the hit words cut out (remove='spans').

    All columns stay. A row is named by its id and text, so repeated rows share their fate. With 'spans', a hit word goes with the
    separators after it. The names of contaminated rows are a staged table, broadcast while it is proven small; the texts are not shuffled then.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    windows = staged(benchmark_windows(benchmark, n), "windows")
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [F.col(id_col), F.xxhash64(text), F.length(text)]
    names = [free_name(documents, x) for x in ("id", "hash", "length")]
    keyed = documents.select(*[c.alias(x) for c, x in zip(own, names, strict=True)], ascii_words(F.col(text_col)).alias("words"))
    hits = _hits(keyed, windows, names, sentinel=False)
    same = own[0].eqNullSafe(F.col(names[0])) & (own[1] == F.col(names[1])) & (own[2] == F.col(names[2]))
    if remove == "documents":
        gone = staged(hits.select(*names).distinct(), "contaminated")
        size = gone.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length(F.col(names[0]).cast("string")), F.lit(0))).alias("b")).first()
        return documents.join(bounded_broadcast(gone, size["n"] * KEY_BYTES + (size["b"] or 0), 1), same, "left_anti")
    mark = free_name(documents, "spans")
    spans = staged(hits.groupBy(*names).agg(F.collect_set(F.struct("pos", "size")).alias(mark)), "spans")
    size = spans.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(mark) * VALUE_BYTES + F.coalesce(F.octet_length(F.col(names[0]).cast("string")), F.lit(0))).alias("b")).first()
    joined = documents.join(bounded_broadcast(spans, size["n"] * KEY_BYTES + (size["b"] or 0), 1), same, "left").drop(*names)
    parts = F.regexp_extract_all(F.col(text_col), F.lit(_WORD_AND_GAP))
    kept = F.flatten(F.transform(_gaps(F.col(mark), F.size(parts)), lambda g: F.slice(parts, g["at"] + 1, g["n"])))
    cut = F.concat(F.regexp_extract(F.col(text_col), _LEADING_GAP, 1), F.array_join(kept, ""))
    return joined.withColumn(text_col, F.when(F.col(mark).isNull(), F.col(text_col)).otherwise(cut)).drop(mark)
