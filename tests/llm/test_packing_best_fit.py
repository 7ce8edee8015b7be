from collections import Counter

import numpy as np
import pytest
from brute import VOCABULARY, crc, library_ids
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import packing
from sluice.llm.queries import op2_best_fit_packing


def checked(rows, capacity):
    """Sequences have no gaps or overlaps and hold at most capacity ids; how many there are."""
    own = {}
    for r in rows:
        own.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in own.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(own)


def test_query_holds_every_id_once(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = op2_best_fit_packing(spark, sf_dir).collect()
    whole = dict(zip(docs, ([*x, 2] for x in library_ids(docs.values())), strict=True))
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert pieces.keys() == whole.keys()
    for doc, ids in whole.items():
        own = sorted(pieces[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert sum(r["length"] for r in own) == len(ids)
        assert len(own) == -(-len(ids) // 1024)
        assert all(r["length"] == 1024 for r in own[1:])
        assert all(r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]]) for r in own)
    assert checked(rows, 1024) <= np.ceil(sum(map(len, whole.values())) / 1024) * 1.02 + 1


def test_cases(spark):
    rows = [(1, "one two three", "a"), (1, "one two three", "a"), (2, None, "b"), (3, "", None), (None, "word", "c"), (4, "many words " * 900, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    out = packing.pack_documents(docs, VOCABULARY, capacity=64, end_id=2)
    got = out.collect()
    checked(got, 64)
    whole = Counter((d, tuple([*x, 2])) for (d, _, _), x in zip(rows, library_ids(t for _, t, _ in rows), strict=True))
    first = [r for r in got if r["doc_id"] != 1 or r["start"] == 0]
    assert sum(r["length"] for r in got) == sum(len(ids) * n for (_, ids), n in whole.items())
    assert Counter(r["doc_id"] for r in first if r["piece"] == 0) == Counter(d for d, _, _ in rows)
    assert [r["length"] for r in got if r["doc_id"] in (2, 3)] == [1, 1]
    ids = {}
    for r in got:
        if r["doc_id"] == 4:
            ids[r["start"]] = np.frombuffer(r["ids"], "<u4")
    assert np.concatenate([ids[k] for k in sorted(ids)]).tolist() == [*library_ids([rows[5][1]])[0], 2]
    sequences = packing.sequences(out).collect()
    assert sum(len(r["ids"]) for r in sequences) == 4 * sum(r["length"] for r in got)
    assert packing.pack_documents(docs.limit(0), VOCABULARY).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80))
def test_plan_places_each_length(lengths):
    counts = Counter(lengths)
    bins = packing.plan(dict(counts), 60)
    held = Counter()
    for x in bins:
        assert sum(n * k for n, k in x.holds) + x.free == 60
        assert sum(k for n, k in x.holds if n * 3 > 60) <= 2
        for n, k in x.holds:
            held[n] += k * x.count
    assert held == counts
    # First-fit decreasing is a bound that best fit over matched large items stays close to.
    free = []
    for n in sorted(lengths, reverse=True):
        k = next((k for k, f in enumerate(free) if f >= n), None)
        if k is None:
            free.append(60 - n)
        else:
            free[k] -= n
    assert sum(x.count for x in bins) <= len(free) * 11 / 9 + 1


def test_plan_rejects_lengths_beyond_the_capacity():
    with pytest.raises(ValueError):
        packing.plan({65: 1}, 64)


def test_pieces_with_one_hash_and_one_beginning_keep_their_own_ids():
    from sluice.llm import _tokens

    pair = ["wordwordabcdefghijklmnop", 'wordwordlCUMjArKm"Ty_,CI']  # their 64-bit hashes and first 8 bytes are equal
    want = dict(zip(pair, library_ids(pair), strict=True))
    for texts in (pair, pair[::-1], [pair[0]], [pair[1]], [f"{pair[0]} {pair[1]}"]):
        code = _tokens.Encoder(VOCABULARY)
        for _ in range(2):
            assert [np.frombuffer(x, "<u2").tolist() for x in code.ids(texts)] == library_ids(texts)
    code = _tokens.Encoder(VOCABULARY)
    for t in (*pair, *pair):
        assert np.frombuffer(code.ids([t])[0], "<u2").tolist() == want[t]


def test_ranks_meet_pieces_by_a_shuffle_where_their_rows_are_too_many(spark, monkeypatch):
    from sluice.llm import _common

    docs = spark.createDataFrame([(k, "word " * (k % 37)) for k in range(400)], "doc_id long, text string").repartition(5)
    order = ["doc_id", "piece"]
    want = packing.pack_documents(docs, VOCABULARY, capacity=32, with_ids=False).orderBy(*order).collect()
    monkeypatch.setattr(_common, "BROADCAST_BYTES", 0)
    got = packing.pack_documents(docs, VOCABULARY, capacity=32, with_ids=False).orderBy(*order).collect()
    assert checked(got, 32) == checked(want, 32) and len(got) == len(want)


def plain_pack(lengths, capacity):
    """Free space of each sequence, by items one after another: large ones matched, the longest with the longest that fits; small ones to the fullest that takes them."""
    large, free = sorted((n for n in lengths if 3 * n > capacity), reverse=True), []
    while large:
        a = large.pop(0)
        b = next((n for n in large if a + n <= capacity), None)
        if b is not None:
            large.remove(b)
        free.append(capacity - a - (b or 0))
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        k = min((k for k, left in enumerate(free) if left >= n), key=lambda k: free[k], default=None)
        if k is None:
            free.append(capacity - n)
        else:
            free[k] -= n
    return free


def test_query_packs_as_a_plain_packer(spark, sf_dir):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    lengths = [n for ids in library_ids(texts) for n in [1024] * ((len(ids) + 1) // 1024) + ([(len(ids) + 1) % 1024] if (len(ids) + 1) % 1024 else [])]
    held = Counter()
    for r in op2_best_fit_packing(spark, sf_dir).collect():
        held[r["sequence_id"]] += r["length"]
    assert sorted(1024 - n for n in held.values()) == sorted(plain_pack(lengths, 1024))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_plan_packs_as_a_plain_packer(lengths):
    bins = packing.plan(Counter(lengths), 30)
    assert sorted(b.free for b in bins for _ in range(b.count)) == sorted(plain_pack(lengths, 30))
