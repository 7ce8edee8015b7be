import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import language
from sluice.llm.queries import op7_language_id

SIZE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SIZE}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return language.train(docs.where(language.learnable()))


def test_held_out_accuracy(spark, docs):
    got = op7_language_id(spark, SIZE).join(docs.select("doc_id", "lang", "text"), "doc_id").toPandas()
    import zlib

    assert got["held_out"].tolist() == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got["doc_id"]]
    known = got[got["held_out"] & got["lang"].notna() & (got["lang_pred"] != "und")]
    assert len(known) > 200 and (known["lang"] == known["lang_pred"]).mean() > 0.97
    assert set(got["lang_pred"]) <= set(got["lang"].dropna()) | {"und"}
    assert got["score"].between(0, 1).all()
    blank = got["text"].map(lambda t: not any(c.isalpha() for c in t or ""))
    assert ((got["lang_pred"] == "und") == blank).all()


def test_the_path_is_the_best_of_all():
    rng = np.random.default_rng(2)
    languages = ("a", "b", "c")
    tagger = language.Tagger(language.Model(languages, np.zeros((3, 1)), {}), 2.5)
    for n in range(1, 8):
        for _ in range(40):
            tagger.rows = np.minimum(rng.normal(-1.5, 1.5, (n, 3)), 0).astype(np.float32)
            worth = lambda p: sum(tagger.rows[k, x] for k, x in enumerate(p)) - 2.5 * sum(x != y for x, y in itertools.pairwise(p))
            best = max(map(worth, itertools.product(range(3), repeat=n)))
            assert worth(tagger.labels(np.arange(n)).tolist()) == pytest.approx(best, abs=1e-4)


def test_spans_of_mixed_text(docs, spark, model):
    long = {r["lang"]: r["text"] for r in docs.where("length(text) > 400 and source <> 'junk'").groupBy("lang").agg(F.max("text").alias("text")).collect()}
    some = [x for x in long if x in ("en", "de")]
    text = " ".join(" ".join(w for w in long[x].split() if w.isalpha())[:300].rsplit(" ", 1)[0] for x in some)
    row = spark.createDataFrame([(text,)], "text string").select(language.identify(F.col("text"), model).alias("f")).first()["f"]
    assert [s["lang"] for s in row["spans"]] == some
    assert 0.3 < row["score"] < 0.7
    assert sum(s["words"] for s in row["spans"]) == len(text.split())


def test_scripts_narrow_the_candidates():
    log_p = np.log(np.full((2, language.BUCKETS), 1 / language.BUCKETS)).astype(np.float32)
    model = language.Model(("el", "en"), log_p, {"Greek": np.array([True, False]), "Latin": np.array([False, True])})
    assert model.scores(["λόγος", "word"]).tolist() == [[0, language.FLOOR], [language.FLOOR, 0]]
    assert [language.script_of(c) for c in "aéλжあ漢한"] == ["Latin", "Latin", "Greek", "Cyrillic", "Kana", "Han", "Hangul"]


def labelled(model, words):
    tagger = language.Tagger(model, language.SWITCH_COST)
    return [model.languages[k] for k in tagger.labels(tagger.words([" ".join(words)])[0])]


def test_short_spans_of_another_script_have_their_language(spark):
    log_p = np.log(np.full((3, language.BUCKETS), 1 / language.BUCKETS)).astype(np.float32)
    model = language.Model(("el", "en", "zh"), log_p, {"Greek": np.array([True, False, False]), "Latin": np.array([False, True, False]), "Han": np.array([False, False, True])})
    for inside in (1, 3):
        assert labelled(model, ["word"] * 9 + ["λόγος"] * inside + ["word"] * 9) == ["en"] * 9 + ["el"] * inside + ["en"] * 9
    clauses = ["漢" * 30] * 4
    assert labelled(model, ["word"] * 9 + clauses + ["word"] * 9) == ["en"] * 9 + ["zh"] * 4 + ["en"] * 9
    found = spark.createDataFrame([(" ".join(["word"] * 9 + clauses + ["word"] * 9),)], "text string").select(language.identify(F.col("text"), model).alias("f")).first()["f"]
    assert found["lang"] == "zh" and found["score"] == pytest.approx(120 / 192)


def test_unsegmented_clauses_weigh_by_their_letters():
    here, there = "語学文字漢和辞典国書", "説話學習漢語詞彙經濟"
    log_p = np.log(np.full((2, language.BUCKETS), 1 / language.BUCKETS)).astype(np.float32)
    for k, clause in enumerate((here, there)):
        log_p[k, language._trigrams([clause * 3])[0]] += 3
    model = language.Model(("ja", "zh"), log_p, {"Han": np.array([True, True])})
    assert labelled(model, [here * 3] * 4 + [there * 3] + [here * 3] * 4) == ["ja"] * 4 + ["zh"] + ["ja"] * 4
    assert model.scores([there * 3])[0, 0] == 30 * language.FLOOR / language.WORD_LETTERS


def test_cases(spark, model):
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 34 _ !?", "x"), (4, "a", "x"), (5, "a", "x"), (6, "the house and the street " * 20_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = df.withColumn("found", language.identify(F.col("text"), model))
    assert out.columns == [*df.columns, "found"]
    got = {r["doc_id"]: r["found"] for r in out.collect()}
    assert all(tuple(got[k])[:2] == ("und", 0.0) and not got[k]["spans"] for k in (1, 2, 3))
    assert got[4] == got[5] and got[4]["lang"] != "und"
    assert got[6]["lang"] == "en" and got[6]["score"] == 1
    assert df.limit(0).select(language.identify(F.col("text"), model)).count() == 0
    untaught = language.train(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r[0]["lang"] for r in df.select(language.identify(F.col("text"), untaught)).collect()} == {"und"}


def plain_language(text, model, cost):
    """(language, its share of the letters) by a whole Viterbi table over all words, each scored by itself."""
    import re
    from collections import Counter

    def scores(word):
        code, total = [2, *map(ord, word.lower()), 3], np.zeros(len(model.languages), np.float64)
        for a, b, c in zip(code, code[1:], code[2:], strict=False):
            h = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) & 0xFFFFFFFF
            total += model.log_p[:, (h ^ (h >> 15)) % language.BUCKETS]
        allowed = model.candidates.get(language.script_of(word[0]))
        out = np.zeros(len(total), bool) if allowed is None or not allowed.any() else ~allowed
        total[out] = -np.inf
        own = np.maximum(total - total.max(), language.FLOOR * max(1, len(word) / language.WORD_LETTERS))
        own[out] = np.minimum(own[out], -2 * cost - 1)
        return own

    words = [w for w in re.findall(r"[^\W\d_]+", text or "") if any(c.isalpha() for c in w)]
    if not words:
        return "und", 0.0
    value, back = scores(words[0]), []
    for w in words[1:]:
        moved = value[None, :] - cost * (1 - np.eye(len(value)))
        back.append(moved.argmax(axis=1))
        value = moved.max(axis=1) + scores(w)
    path = [int(value.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    letters = Counter()
    for w, x in zip(words, reversed(path), strict=True):
        letters[x] += len(w)
    best = max(letters, key=lambda x: (letters[x], -x))
    return model.languages[best], letters[best] / sum(letters.values())


def test_query_equals_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = language.train(docs.where(language.learnable()))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in op7_language_id(spark, sf_dir).collect()}
    for r in docs.select("doc_id", "text").collect():
        lang, share = plain_language(r["text"], own, language.SWITCH_COST)
        assert got[r["doc_id"]][0] == lang and got[r["doc_id"]][1] == pytest.approx(share, abs=1e-9)


def mixed_model():
    log_p = np.log(np.full((3, language.BUCKETS), 1 / language.BUCKETS)).astype(np.float32)
    rng = np.random.default_rng(8)
    words = [["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(40)] for _ in range(3)]
    for k, own in enumerate(words):
        log_p[k, language._trigrams(own)[0]] += 4
    return language.Model(("a", "b", "c"), log_p, {"Latin": np.array([True, True, True])}), words


def test_blocks_of_a_long_text_give_the_same_labels(monkeypatch):
    model, words = mixed_model()
    rng = np.random.default_rng(9)
    monkeypatch.setattr(language, "STEP_WORDS", 37)
    monkeypatch.setattr(language, "KEEP_WORDS", 60)
    for _ in range(20):
        runs = [(int(rng.integers(3)), int(rng.integers(1, 60))) for _ in range(30)]
        text = " ".join(words[k][int(rng.integers(40))] for k, n in runs for _ in range(n)) + " 12 _"
        tagger = language.Tagger(model, language.SWITCH_COST)
        numbers = tagger.words([text])[0]
        want, sizes = tagger.labels(numbers), tagger.sizes[numbers]
        got, letters = language.Tagger(model, language.SWITCH_COST).long_labels(text)
        assert got.tolist() == want.tolist() and letters.tolist() == sizes.tolist() and len(set(want.tolist())) > 1
    assert len(language.Tagger(model, 2.0).long_labels("1 2 _")[0]) == 0


def test_long_texts_go_by_blocks(spark, monkeypatch):
    model, words = mixed_model()
    text = " ".join(words[0] * 5000 + words[1] * 100)
    assert len(text) > language.STEP_CHARS
    df = spark.createDataFrame([(text,), (None,), ("9 " * language.STEP_CHARS,)], "text string")
    got = [r["f"] for r in df.select(language.identify(F.col("text"), model).alias("f")).collect()]
    assert got[0]["lang"] == "a" and [(s["words"], s["lang"]) for s in got[0]["spans"]] == [(200_000, "a"), (4000, "b")]
    assert [g["lang"] for g in got[1:]] == ["und", "und"]


def test_memory_of_a_long_text():
    from test_line_quality import peak

    setup = "model = language.Model(('a', 'b'), np.log(np.full((2, language.BUCKETS), 1 / language.BUCKETS)).astype(np.float32), {})\ntagger = language.Tagger(model, 12.0)\ntext = ' '.join(f'w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}rd' for k in range(676)) * 15_000\n"
    assert peak(setup + "---\nassert len(tagger.long_labels(text)[0]) > 10_000_000") < 300


def test_too_many_languages_are_refused(spark):
    df = spark.createDataFrame([(k, f"text {k}", f"l{k}") for k in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 4"):
        language.train(df, most_languages=4)
    assert len(language.train(df, most_languages=5).languages) == 5
