import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import whitening
from sluice.llm.queries import op11_embedding_whitening, read

SCHEMA = "vec_id long, embedding array<float>, x string, n int, deviation string, whitening string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 7, "y", "z") for i, v in rows], SCHEMA)


def brute(rows, components=16):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} and the vectors' values, from numpy on the whole table."""
    usable = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(x) for _, x in usable)
    usable = [(i, x + (1_000_000,) * (width - len(x))) for i, x in usable]
    listed = sorted({x for _, x in usable})
    n, sums = len(listed), [sum(c) for c in zip(*listed, strict=True)]
    mean = np.array([s / n for s in sums])
    centred = np.array(listed, float) - mean
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    kept = min(components, int((values > values[0] * 1e-12).sum()))
    out = {}
    for i, x in usable:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        for k in range(kept):
            out.setdefault(i, []).append((k + 1, n, deviation, (np.array(x) - mean) @ axes[:, k] / math.sqrt(values[k]), values[k] / values.sum()))
    return out


def check(got, want):
    found = {}
    for r in got:
        found.setdefault(r["vec_id"], []).append((r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]))
    assert found.keys() == want.keys()
    sign = {}
    for i, own in want.items():
        for a, b in zip(sorted(found[i])[: len(own)], own, strict=True):
            assert a[:3] == b[:3]
            sign.setdefault(a[0], np.sign(a[3] * b[3]) if abs(b[3]) > 1e-3 else 1)
            assert a[3] == pytest.approx(b[3] * sign[a[0]], abs=1e-6)
            assert a[4] == pytest.approx(b[4], rel=1e-6)


def test_query_equals_plain_version(spark, sf_dir):
    rows = [tuple(r) for r in read(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()]
    got = op11_embedding_whitening(spark, sf_dir).collect()
    assert len(got) == 16 * len(rows)
    check(got, brute(rows))
    assert {r["identity_error"] for r in got}.pop() < 1e-9


def exploded(frame_):
    projected, model = whitening.whiten(frame_)
    spread = projected.select("vec_id", "n", F.col("whitening.deviation").cast("long").alias("deviation"), F.posexplode("whitening.whitened").alias("at", "whitened"))
    return [{"vec_id": r["vec_id"], "component": r["at"] + 1, "n": model.n, "deviation": r["deviation"], "whitened": r["whitened"], "explained": model.explained()[r["at"]]} for r in spread.collect()], model


def test_unusable_and_repeated_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(size=3).astype(np.float32).tolist()) for i in range(40)]
    hot = [(100 + i, [0.5, -0.25, 2.0]) for i in range(60)]  # one vector counts once in the fit
    bad = [(500, None), (502, [1.0, None, 1.0]), (503, [1.0, float("nan"), 1.0]), (504, [float("inf"), 1.0, 1.0])]
    got, model = exploded(frame(spark, good + hot + bad))
    assert model.n == 41
    check(got, brute(good + hot))


def test_directions_without_variance_are_left_out(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0]) for i in range(20)]  # a line
    got, model = exploded(frame(spark, rows))
    assert len(model.eigenvalues) == 1 and model.explained() == pytest.approx([1.0])
    check(got, brute(rows))


def test_one_vector_and_none(spark):
    got, model = exploded(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))
    assert got == [] and model.n == 1
    projected, model = whitening.whiten(frame(spark, [(1, None)]))
    assert model is None and projected.collect() == [] and projected.columns[-1] == "whitening"


def test_shorter_vectors_are_filled_up(spark):
    rows = [(1, [1.0, 2.0, 0.5]), (2, [1.0, 2.0]), (3, [1.0, 2.0, 0.0]), (4, []), (5, [-1.0]), (6, [0.25, 3.0, -2.0]), (7, [0.0])]
    got, model = exploded(frame(spark, rows))
    assert model.n == 5  # 2 and 3 are one vector, and 4 and 7
    check(got, brute(rows))
    assert whitening.whiten(frame(spark, [(1, []), (2, [])]))[0].collect() == []


def test_large_entries_are_exact(spark):
    far = 2.0**40
    rows = [(i, [far + 2.0**20 * i, -far + 2.0**21 * (i % 3)]) for i in range(50)]
    projected, model = whitening.whiten(frame(spark, rows))
    got = {r["vec_id"]: int(r["whitening"]["deviation"]) for r in projected.collect()}
    xs = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in rows}
    distinct = {tuple(x) for x in xs.values()}
    sums = [sum(c) for c in zip(*distinct, strict=True)]
    assert got == {i: sum((len(distinct) * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for i, x in xs.items()}
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(frame(spark, [(1, [1e30])]))
