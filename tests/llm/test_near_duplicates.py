import random

import numpy as np
from brute import classes

from sluice.llm import neardup
from sluice.llm.queries import op5_minhash_near_duplicates


def grouped(pairs):
    """{class: sorted members} as a set of tuples."""
    own = {}
    for doc, c in pairs:
        own.setdefault(c, []).append(doc)
    return {tuple(sorted(x)) for x in own.values()}


def made(seed=5):
    """Texts with exact copies, near copies, chains of edits, and texts that share passages below the threshold."""
    rng = random.Random(seed)
    word = lambda: "w" + str(int(rng.paretovariate(0.6)) % 4000)
    out = []
    for _ in range(30):
        own = [word() for _ in range(rng.choice([4, 40, 120, 300]))]
        out.append(own)
        if rng.random() < 0.5:
            out.append(list(own))
        for _ in range(rng.choice([0, 1, 4])):  # each an edit of the one before
            own = list(own)
            for _ in range(max(1, len(own) // 60)):
                own[rng.randrange(len(own))] = word()
            out.append(own)
    passage = [word() for _ in range(80)]
    out += [passage + [word() for _ in range(60)] for _ in range(6)]
    rng.shuffle(out)
    return [" ".join(x) for x in out]


def test_query_equals_brute_force(spark, sf_dir):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    want = classes([t for _, t in docs], neardup.THRESHOLD, neardup.IDF_BUCKETS)
    rows = op5_minhash_near_duplicates(spark, sf_dir).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == {d: docs[w][0] for (d, _), w in zip(docs, want, strict=True)}
    assert sorted(r["class_id"] for r in rows if r["representative"]) == sorted({docs[w][0] for w in want})


def test_made_texts_equal_brute_force(spark):
    texts = made()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = classes(texts, neardup.THRESHOLD, neardup.IDF_BUCKETS)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    assert got == dict(enumerate(want))
    assert 10 < len(set(want)) < len(texts)


def test_cells_of_many_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 3)
    monkeypatch.setattr(neardup, "HOT_SHARE", 10)
    texts = made(9)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    assert got == dict(enumerate(classes(texts, neardup.THRESHOLD, neardup.IDF_BUCKETS)))


def cases(spark):
    long = " ".join(f"t{k % 977}" for k in range(30_000))
    rows = [
        (9, "one two", "a"), (3, "One, two!", "b"), (3, "One, two!", "b"), (4, None, "c"), (5, "", "d"), (6, " ?! ", "e"), (None, None, "f"),
        (None, "only here with no id at all", "g"), (7, long, "h"), (8, long + " end", "i"), (10, "one two three", "j"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, key string").withColumnRenamed("key", "ROW")


def test_cases(spark):
    docs = cases(spark)
    rows = neardup.near_duplicates(docs).collect()
    assert len(rows) == 11
    assert {(r["doc_id"], r["class_id"]) for r in rows} == {(9, 3), (3, 3), (4, 4), (5, 5), (6, 6), (None, None), (7, 7), (8, 7), (10, 10)}
    assert sum(r["representative"] for r in rows) == 8
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["ROW"]) for r in kept.collect()) == [("10", "j"), ("3", "b"), ("4", "c"), ("5", "d"), ("6", "e"), ("7", "h"), ("None", "f"), ("None", "g")]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    assert neardup.deduplicate(docs.limit(0)).count() == 0


def test_samples_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(1)
    own = np.sort(rng.integers(0, 1 << 63, 400, dtype=np.int64).astype(np.uint64))
    a, b = (own, rng.uniform(1, 9, 400).astype(np.float32)), (own[60:], rng.uniform(1, 9, 340).astype(np.float32))
    want = neardup.similarity(a, b)
    same = []
    for k in range(400):  # other hash functions by other shingle numbers
        shift = np.uint64(k * 7919)
        got = neardup.samples(np.concatenate([neardup._mix(a[0] + shift), neardup._mix(b[0] + shift)]), np.concatenate([a[1], b[1]]), np.array([400, 340]))
        same.append((got[0] == got[1]).mean())
    assert abs(np.mean(same) - want) < 0.02


def test_components_of_a_path(spark):
    name = lambda k: f"{k:04d}".encode()
    links = spark.createDataFrame([(name(k), name(k + 1)) for k in range(40)] + [(name(90), name(91))], "a binary, b binary")
    got = {bytes(r["key"]): bytes(r["comp"]) for r in neardup.components(links).collect()}
    assert got == {name(k): name(0) for k in range(41)} | {name(90): name(90), name(91): name(90)}


def test_recall_of_the_bands():
    rng = np.random.default_rng(8)
    pairs = 3000
    for n, shared, found in ((63, 56, 0.996), (37, 34, 0.999), (19, 18, 0.9995)):  # similarities 0.8, 0.85 and 0.9
        own, weight = [], []
        for _ in range(pairs):
            h = rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.int64).astype(np.uint64)
            w = np.full(len(h), rng.uniform(1, 9), np.float32)
            own += [h[:n], h[n - shared :]]
            weight += [w[:n], w[n - shared :]]
        b = neardup.bands(neardup.samples(np.concatenate(own), np.concatenate(weight), np.full(2 * pairs, n)))
        assert (b[::2] == b[1::2]).any(axis=1).mean() >= found


def test_a_large_component_with_strays_costs_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 8)
    rng = random.Random(2)
    base = [f"b{k}" for k in range(200)]
    family = [[*base[:k], f"x{k}", *base[k + 1 :]] for k in range(80)]
    stray = [[*base[:150], *(f"s{i}_{k}" for k in range(50))] for i in range(6)]
    texts = [" ".join(x) for x in family + stray]
    rng.shuffle(texts)
    seen = []
    placed = neardup._with_sets
    monkeypatch.setattr(neardup, "_with_sets", lambda rows, idf: seen.append(rows.count()) or placed(rows, idf))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    assert got == dict(enumerate(classes(texts, neardup.THRESHOLD, neardup.IDF_BUCKETS)))
    assert seen and seen[-1] <= 4 * len(texts)


def test_hot_keys_are_dealt_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HEAVY", 2)
    name = lambda k: f"{k:04d}".encode()
    hub = [(name(500), name(k)) for k in range(1, 60)] + [(name(k), name(k + 100)) for k in range(1, 60)] + [(name(900), name(901))]
    links = spark.createDataFrame(hub, "a binary, b binary")
    got = {bytes(r["key"]): bytes(r["comp"]) for r in neardup.components(links).collect()}
    assert got == {name(k): name(1) for k in [*range(1, 60), *range(101, 160), 500]} | {name(900): name(900), name(901): name(900)}
    texts = made(3)
    texts += [texts[0]] * 20 + [None] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    assert got == dict(enumerate(classes(texts, neardup.THRESHOLD, neardup.IDF_BUCKETS)))


def test_dealt_join_keeps_every_row_once(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HEAVY", 3)
    rows = spark.createDataFrame([(k, min(k % 40, 5)) for k in range(200)] + [(900, None), (901, 77)], "id long, k long")
    table = spark.createDataFrame([(k, k * 10) for k in range(6)], "k long, v long")
    heavy = neardup._heavy(rows, "k", rows.count())
    got = neardup._dealt_join(rows, table, "k", "id", heavy, "left")
    assert sorted((r["id"], r["v"]) for r in got.collect()) == sorted((r["id"], None if r["k"] in (None, 77) else r["k"] * 10) for r in rows.collect())
    assert neardup._dealt_join(rows, table, "k", "id", heavy).count() == 200
