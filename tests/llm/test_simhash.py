import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sluice.llm import simhash
from sluice.llm.queries import op13_simhash_near_duplicates, read

SCHEMA = "doc_id long, text string, code long, row int, comp string, component_id int"


def print_of(text):
    """The contract, bit by bit."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not ws:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(ws[k : k + 3]).encode(), 42) for k in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(docs, distance=3):
    """Sorted (doc_id, fingerprint, component_id) by all pairs."""
    codes = [print_of(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            if (codes[a] ^ codes[b]).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min((x for x in (i, least.get(find(k))) if x is not None), default=None)
    return sorted(((i, f"{c:016x}", least[find(k)]) for k, ((i, _), c) in enumerate(zip(docs, codes, strict=True))), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", simhash.hexadecimal(F.col("fingerprint")), "component_id").collect()), key=str)


def test_query_equals_all_pairs(spark, sf_dir):
    docs = [tuple(r) for r in read(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    got = op13_simhash_near_duplicates(spark, sf_dir)
    assert sorted(map(tuple, got.select("doc_id", "fingerprint", "component_id").collect()), key=str) == classes(docs)


def test_odd_rows(spark):
    docs = [(5, None), (2, ""), (9, " \t\x0b "), (1, "One two"), (1, "one TWO"), (4, "one"), (None, "one two"), (None, "alone here of four"), (7, "É é Ünï   x"), (7, "É é Ünï   x"), (8, "w " * 40_000), (3, "a b c d e f g h i j k")]
    frame = spark.createDataFrame([(*d, 1, 2, "c", 3) for d in docs], SCHEMA)
    assert rows_of(simhash.simhash_duplicates(frame)) == classes(docs)
    assert rows_of(simhash.simhash_duplicates(frame.limit(0))) == []


def brute_labels(codes, distance):
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= distance
    return simhash.joined(len(codes), *np.nonzero(near))


def family(rng, n, bits):
    """Codes that differ from one in some of a few bits, and strays."""
    base, places = rng.integers(0, 1 << 63, dtype=np.uint64), rng.choice(64, bits, replace=False).astype(np.uint64)
    flips = (rng.random((n, bits)) < 0.3) @ (np.uint64(1) << places)
    return np.unique(np.r_[base ^ flips.astype(np.uint64), rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)])


@pytest.mark.parametrize("cell", [6, 40, simhash.CELL])
def test_links_join_what_all_pairs_join(spark, cell):
    codes = family(np.random.default_rng(7), 900, 24)
    frame = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "code long").repartition(3)
    at = {int(c): k for k, c in enumerate(codes.view(np.int64))}
    pairs = np.array([(at[r["a"]], at[r["b"]]) for r in simhash.links(frame, cell=cell).collect()]).reshape(-1, 2)
    want = brute_labels(codes, 3)
    assert 1 < len(np.unique(want)) < len(codes)
    assert simhash.joined(len(codes), pairs[:, 0], pairs[:, 1]).tolist() == want.tolist()


def gray_sorted(codes):
    return codes[np.argsort(np.bitwise_xor.reduce([codes >> np.uint64(k) for k in range(64)]))]


@pytest.mark.parametrize("distance", [0, 1, 3, 6])
def test_index_finds_the_pairs_of_each_cell(distance, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS", 5000)
    rng = np.random.default_rng(1)
    cells = [family(rng, n, 12)[:1000] for n in (1, 3, 700, 17, 256, 2)]
    cells = [gray_sorted(c) for c in cells]
    codes, of = np.concatenate(cells), np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    got = [p for a, b in simhash.GrayIndex(codes, of).search(distance) for p in zip(a.tolist(), b.tolist(), strict=True)]
    near = (np.bitwise_count(codes[:, None] ^ codes[None, :]) <= distance) & (of[:, None] == of[None, :])
    assert sorted(got) == sorted(zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1))), strict=True))
    assert len(set(got)) == len(got)


def test_groups_are_left_by_their_patterns(monkeypatch):
    codes = gray_sorted(np.unique(np.random.default_rng(3).integers(0, 1 << 62, 1000, dtype=np.uint64)))
    seen = []
    children = simhash._children
    monkeypatch.setattr(simhash, "_children", lambda at, first, count: seen.append(int(count[at].sum())) or children(at, first, count))
    list(simhash.GrayIndex(codes, np.zeros(len(codes), int)).search(1))
    assert seen[-1] < len(codes) ** 2 / 3  # all pairs of a code and a leaf's would be the square


def test_gray_rank_and_blocks(spark):
    codes = [0, 1, 3, 2, 6, 7, 5, 4]  # the Gray codes of 0 to 7
    frame = spark.createDataFrame([(c,) for c in codes] + [(-1,), (-(1 << 63),)], "code long")
    got = {r["code"]: r["rank"] + (1 << 63) for r in frame.select("code", simhash.gray_rank(F.col("code")).alias("rank")).collect()}
    assert [got[c] for c in codes] == list(range(8)) and got[-(1 << 63)] == (1 << 64) - 1
    blocks = simhash.open_blocks(0xFFFF, 4)
    assert [bin(b).count("1") for b in blocks] == [28] * 4
    assert simhash.open_blocks(0, 4)[0] == 0xFFFF
