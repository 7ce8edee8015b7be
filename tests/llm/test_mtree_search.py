import math

import numpy as np
from pyspark.sql import functions as F

from sluice.llm import mtree
from sluice.llm.queries import OP1_SQL, op1_mtree_search

SCHEMA = "vec_id long, embedding array<float>, score string, id int, tree string, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 7, "y", "z") for i, v in rows], SCHEMA)


def brute(rows, every, k):
    fine = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, x in fine:
        if q % every == 0:
            found = {}
            for i, y in fine:
                if i != q:
                    found[i] = max(found.get(i, -(1 << 60)), sum(a * b for a, b in zip(x, y, strict=False)))
            out += [(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(found.items(), key=lambda p: (-p[1], p[0]))[:k])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_query_equals_its_sql(spark, sf_dir, oracle):
    want = oracle.execute(OP1_SQL).df()[["query_id", "rank", "vec_id", "score"]]
    assert rows_of(op1_mtree_search(spark, sf_dir)) == sorted(map(tuple, want.to_numpy().tolist()))


def test_many_subtrees_pages_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(700)]  # few distinct vectors: ties everywhere
    rows += [(1000 + i, [1.0, 1.0, 0.0, 2.0]) for i in range(300)]  # one hot vector
    got = mtree.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, k=5, pivots=4, subtree_size=60)
    assert rows_of(got) == brute(rows, 50, 5)


def test_unusable_short_and_repeated_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, [3.0]), (6, []), (7, [-1.0, 0.5]), (7, [-1.0, 0.5]), (None, [1.0, 1.0])]
    assert rows_of(mtree.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0)) == brute(rows, 50, 5)
    assert len(brute(rows, 50, 5)) == 3  # all there are, as they are fewer than five


def test_empty(spark):
    assert rows_of(mtree.top_k(frame(spark, []), F.col("vec_id") % 50 == 0)) == []
    assert rows_of(mtree.top_k(frame(spark, [(50, [1.0])]), F.col("vec_id") % 50 == 0)) == []


def test_large_components_are_exact(spark):
    big = 65536.0 - 1 / 256  # sums of 64 products pass 2 ** 53 once scaled
    rng = np.random.default_rng(5)
    rows = [(i, (big - rng.integers(0, 9, 64) / 256).tolist()) for i in range(120)]
    rows += [(200 + i, (-big + rng.integers(0, 9, 64) / 256).tolist()) for i in range(20)]
    assert rows_of(mtree.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, pivots=4, subtree_size=30)) == brute(rows, 50, 5)


def test_scores_outside_64_bits_are_cut(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [2e30, 0.0]), (3, [-1e30, 0.0]), (4, [0.5, 0.5]), (5, [3e38, 3e38]), (50, [65536.0, 1e-40])]
    cut = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    v = {i: [math.floor(256 * float(np.float32(x))) for x in e] for i, e in rows}
    want = []
    for q in (0, 50):
        found = sorted((-cut(sum(a * b for a, b in zip(v[q], v[i], strict=True))), i) for i in v if i != q)
        want += [(q, r, i, -s) for r, (s, i) in enumerate(found[:5], 1)]
    assert rows_of(mtree.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0)) == sorted(want)


def test_an_id_with_several_vectors_counts_once(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(60)] + [(3, [float(k), 9.0]) for k in range(40)] + [(50, [2.0, float(k)]) for k in range(5)]
    assert {(q, r, i) for q, r, i, _ in rows_of(mtree.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, subtree_size=8))} >= {(50, 1, 3)}
    for q in (0, 50):
        own = [i for x, _, i, _ in rows_of(mtree.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, subtree_size=8)) if x == q]
        assert len(own) == len(set(own)) == 5


def clustered(n_clusters: int, each: int):
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 100, (n_clusters, 8))
    return np.floor(np.repeat(centres, each, axis=0) + rng.normal(0, 2, (n_clusters * each, 8)))


def test_search_avoids_computations():
    v = clustered(40, 50)
    tree = mtree.Subtree(v.copy(), np.arange(2000), float((v * v).sum(axis=1).max()))
    assert [s for s, _ in tree.search(v[0], -1, 5, None)] == sorted((v @ v[0]).astype(int).tolist(), reverse=True)[:5]
    assert tree.computed < 0.75 * len(v)


def test_clustered_vectors_leave_most_subtrees_unvisited(spark):
    rows = [(i, (x / 256).tolist()) for i, x in enumerate(clustered(30, 40))]
    report: dict[str, int] = {}
    got = mtree.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, subtree_size=40, report=report)
    assert rows_of(got) == brute(rows, 50, 5)
    assert report["visits"] < 0.5 * report["queries"] * report["subtrees"]


def test_kth_scores_of_distinct_ids():
    rng = np.random.default_rng(6)
    for n in (1, 4, 30):
        ids, own = rng.integers(0, 12, n), rng.integers(0, 14, 20)
        scores = rng.integers(-9, 9, (20, n))
        want = []
        for row, me in zip(scores, own, strict=True):
            best = {i: max(row[ids == i]) for i in set(ids.tolist()) - {me}}
            want.append(sorted(best.values(), reverse=True)[2] if len(best) >= 3 else None)
        assert mtree.kth_scores(scores.copy(), ids, own, 3) == want
    assert mtree.kth_scores(np.array([[mtree.LOWEST, mtree.HIGHEST]]), np.array([1, 2]), np.array([9]), 2) == [mtree.LOWEST]


def test_blocks_go_once_to_a_grove(spark, monkeypatch):
    monkeypatch.setattr(mtree, "GROVE", 3)
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=6) / 4).tolist()) for i in range(400)]
    rows = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows]
    report = {}
    got = mtree.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, k=5, pivots=5, subtree_size=40, report=report)
    assert rows_of(got) == brute(rows, 50, 5)
    assert report["queries"] == 8 and report["subtrees"] > 6 and 16 <= report["visits"] <= report["queries"] * report["subtrees"]
