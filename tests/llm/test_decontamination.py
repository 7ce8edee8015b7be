import hashlib

import pytest
from brute import hits, windows
from conftest import same_rows
from pyspark.sql import functions as F

from sluice.llm import _common, decontaminate
from sluice.llm.queries import OP3_SQL, op3_decontamination

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def frames(spark):
    docs = [
        (1, f"Before, {ITEM.upper()}! After it", "a", 1),
        (2, "alpha beta gamma delta epsilon zeta eta theta iota", "b", 2),  # nine words of the item are no window
        (3, None, None, 3),
        (4, "", "c", 4),
        (5, "x short item y short item", "d", 5),
        (5, "x short item y short item", "d", 5),
        (None, ITEM, "e", 6),
        (6, "word " * 5000 + ITEM, "f", 7),
        (7, "Äpfel ÄPFEL are not lowered", "g", 8),
    ]
    items = [(10, ITEM), (10, ITEM), (2, ITEM), (3, "Short; item."), (4, None), (5, " .. "), (None, "x short"), (6, "äpfel are not")]
    return spark.createDataFrame(docs, "doc_id long, text string, words string, hash long"), spark.createDataFrame(items, "item_id long, text string")


def brute(docs, items):
    known = windows([(r["item_id"], r["text"]) for r in items.collect() if r["item_id"] is not None])
    out = []
    for r in docs.collect():
        n, at, own = hits(r["text"], known)
        out.append((r["doc_id"], n, len(at), sorted(own)))
    return sorted(out, key=str)


def scanned(docs, items):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in decontaminate.scan_windows(docs, items).collect()), key=str)


def test_query_equals_its_sql(spark, sf_dir, oracle):
    assert same_rows(op3_decontamination(spark, sf_dir).toPandas(), oracle.execute(OP3_SQL).df())


def test_query_equals_brute_force(spark, sf_dir):
    known = windows([tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()])
    want = []
    for doc, text in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        n, at, own = hits(text, known)
        want.append((doc, n, len(at), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(at)))
    got = [tuple(r) for r in op3_decontamination(spark, sf_dir).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(got) == sorted(want)
    assert any(w[-1] for w in want)


def test_cases(spark):
    docs, items = frames(spark)
    assert scanned(docs, items) == brute(docs, items)
    assert scanned(docs, items.limit(0)) == brute(docs, items.limit(0))
    assert scanned(docs.limit(0), items) == []


def test_a_benchmark_too_large_to_broadcast_gives_the_same(spark, monkeypatch):
    docs, items = frames(spark)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert scanned(docs, items) == brute(docs, items)
    assert decontaminate.BROADCAST_BYTES != _common.BROADCAST_BYTES


@pytest.mark.parametrize("bytes_allowed", [0, 64 << 20])
def test_removal(spark, monkeypatch, bytes_allowed):
    docs, items = frames(spark)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", bytes_allowed)
    kept = decontaminate.remove_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 7]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_contaminated(docs, items, remove="spans").collect()}
    assert cut[1] == "Before, After it"
    assert cut[5] == "x y "
    assert cut[None] == ""
    assert cut[6] == "word " * 5000
    assert cut[2] == "alpha beta gamma delta epsilon zeta eta theta iota" and cut[3] is None and cut[4] == ""
    with pytest.raises(ValueError):
        decontaminate.remove_contaminated(docs, items, remove="words")


@pytest.mark.parametrize("remove", ["documents", "spans"])
@pytest.mark.parametrize("bytes_allowed", [0, 64 << 20])
def test_removal_keeps_columns_of_any_name(spark, monkeypatch, remove, bytes_allowed):
    docs, items = frames(spark)
    monkeypatch.setattr(_common, "BROADCAST_BYTES", bytes_allowed)
    odd = docs
    for k, name in enumerate(["k_id", "k_hash", "k_len", "__id", "__hash", "__length", "__spans", "words", "pos"]):
        odd = odd.withColumn(name, F.lit(k))
    plain = decontaminate.remove_contaminated(docs, items, remove=remove)
    got = decontaminate.remove_contaminated(odd, items, remove=remove)
    assert got.columns == odd.columns
    assert same_rows(got.select("doc_id", "text").toPandas(), plain.select("doc_id", "text").toPandas())
    assert {tuple(r) for r in got.select("k_id", "k_len", "pos").collect()} == {(0, 2, 8)}
