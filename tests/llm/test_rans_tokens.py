from collections import Counter

import numpy as np
import pytest
from brute import VOCABULARY, crc, library_ids
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.llm import _tokens, rans
from sluice.llm._tokens import Encoder
from sluice.llm.queries import op8_rans_tokens


def test_query_is_an_exact_round_trip(spark, sf_dir):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    want, start = [], 0
    for (doc, _), ids in zip(docs, library_ids(t for _, t in docs), strict=True):
        want.append((doc, start, len(ids) + 1, crc([*ids, 0])))
        start += len(ids) + 1
    got = op8_rans_tokens(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_cases(spark, tmp_path):
    rows = [(5, "five", 1), (2, None, 2), (3, "", 3), (2, "two again", 4), (None, "no id", 5), (9, "long text " * 3000, 6), (7, "<|endoftext|> inside", 7), (8, "odd space  here \n\n x  ", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    at = rans.write_token_file(df, f"file://{tmp_path}/f", VOCABULARY, block_tokens=1000)
    got = rans.read_token_file(spark, at).collect()
    ids = {tuple(np.frombuffer(r["ids"], "<u4").tolist()): r["doc_id"] for r in got}
    assert ids == {tuple([*x, 0]): d for (d, _, _), x in zip(rows, library_ids(t for _, t, _ in rows), strict=True)} | {(0,): ids[0,]}
    assert len(got) == len(rows)
    placed = sorted(tuple(r) for r in rans.documents_of(spark, at).select("start", "n_tokens", F.coalesce("doc_id", F.lit(-1))).collect())
    assert [d for _, _, d in placed] == [-1, 2, 2, 3, 5, 7, 8, 9]  # ascending ids, null first
    assert [s for s, _, _ in placed] == [sum(n for _, n, _ in placed[:k]) for k in range(len(placed))]
    empty = rans.write_token_file(df.limit(0), f"file://{tmp_path}/e", VOCABULARY)
    assert rans.documents_of(spark, empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=3000), st.sampled_from([1, 2, 8, 64]))
def test_coder_is_exact(ids, lanes):
    ids = np.array(ids, np.uint16)
    coder = rans.Coder(rans.Table.of(np.bincount(ids, minlength=600)))
    words, checks = coder.encode(ids, lanes)
    assert coder.decode(words, checks, len(ids), lanes).tolist() == ids.tolist()
    for k in range(len(checks)):  # each segment alone
        begin = k * rans.CHECK_STEPS * lanes
        assert coder.decode(words, checks, len(ids), lanes, range(k, k + 1)).tolist() == ids[begin : begin + rans.CHECK_STEPS * lanes].tolist()


def test_damage_is_found(spark):
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.geometric(0.02, 40_000), 5000).astype(np.uint16)
    coder = rans.Coder(rans.Table.of(np.bincount(ids, minlength=5001)))
    words, checks = coder.encode(ids, 32)
    p = np.bincount(ids) / len(ids)
    assert len(words) * 4 < len(ids) * -(p[p > 0] * np.log2(p[p > 0])).sum() / 8 * 1.01 + 100  # close to the entropy
    words = words.copy()
    words[len(words) // 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        coder.decode(words, checks, len(ids), 32)


def test_frequencies_sum_to_the_scale():
    rng = np.random.default_rng(1)
    counts = rng.zipf(1.3, 5000) * (rng.random(5000) < 0.5)
    freq = rans.Table.of(counts).freq
    assert freq.sum() == rans.SCALE and ((freq > 0) == (counts > 0)).all()
    assert rans.Table.of(np.zeros(9)).freq.sum() == 0


PARTS = ["word", " ", "  ", "\n", "\t", "'s", "'re", "12", "!?", "é", " ", " ", "中文", "😀", "<|endoftext|>", "_", "-", "\x1c", "\x85", "A b", "\r\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), min_size=1, max_size=6))
def test_cut_texts_have_the_ids_of_whole_ones(texts):
    got = _ENCODER.ids([*texts, None])
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [*library_ids(texts), []]


_ENCODER = Encoder(VOCABULARY)


def test_long_texts_full_tables_and_new_beginnings_change_nothing(monkeypatch):
    texts = ["one two, three.\nFour  five" * 9, "x" * 200 + " y", "", "many words here and there, " * 40, "eins zwei drei, größer", *(f"w{k} v{k}," for k in range(60))]
    want = library_ids(texts)
    for slots, keep, part in ((1 << 8, 20, 1 << 20), (1 << 6, 1 << 20, 100), (1 << 6, 3, 7)):
        monkeypatch.setattr(_tokens, "SLOTS", slots)
        monkeypatch.setattr(_tokens, "KEEP", keep)
        monkeypatch.setattr(_tokens, "CHUNK", part)
        code = Encoder(VOCABULARY)
        for _ in range(3):
            assert [np.frombuffer(x, "<u2").tolist() for x in code.ids(texts)] == want


def test_one_id_with_many_texts_lies_in_several_partitions(spark, monkeypatch):
    monkeypatch.setattr(rans, "PART_BYTES", 2000)
    rows = [(7, f"text {k} " * 4) for k in range(300)] + [(None, f"no id {k}") for k in range(100)] + [(9, "last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tokens = rans._tokenized(docs, VOCABULARY, 0, "doc_id", "text")
    assert tokens.where("doc_id = 7").select("part").distinct().count() > 1
    got = rans.round_trip(docs, VOCABULARY).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [None] * 100 + [7] * 300 + [9]
    assert Counter(r["ids_crc32"] for r in got) == Counter(crc([*x, 0]) for x in library_ids(t for _, t in rows))


def test_equal_rows_may_lie_in_several_partitions(spark, monkeypatch):
    monkeypatch.setattr(rans, "PART_BYTES", 4000)
    rows = spark.range(400).select(F.lit(7).alias("doc_id"), F.lit("the same text in every row").alias("text"))
    staged = rans._tokenized(rows, VOCABULARY, 0, "doc_id", "text")
    sizes = [r["count"] for r in staged.groupBy("part").count().collect()]
    assert sum(sizes) == 400 and len(sizes) > 2 and max(sizes) < 300
    got = rans.round_trip(rows, VOCABULARY, end_id=0).collect()
    n = got[0]["n_tokens"]
    assert sorted(r["start"] for r in got) == [k * n for k in range(400)] and len({(r["n_tokens"], r["ids_crc32"]) for r in got}) == 1
