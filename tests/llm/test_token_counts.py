from brute import VOCABULARY, library_ids
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.llm import transducer
from sluice.llm.queries import TOKEN_LIMIT, op9_token_counts

MACHINE = transducer.Transducer(VOCABULARY)
PARTS = ["word", "Another", " ", "  ", "\n", "\t", "'s", "'re", "'x", "12", "!?", "é", " ", " ", "中文", "😀", "<|endoftext|>", "<|endo", "_", "-", "\x1c", "\x85", "ſ", "١", "\r\n", "aaaaaaaaaaaa", "----------"]


def test_query_equals_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    n = [len(x) for x in library_ids(t for _, t in docs)]
    want = sorted((d, len((t or "").encode()), k, k > TOKEN_LIMIT) for (d, t), k in zip(docs, n, strict=True))
    assert sorted(map(tuple, op9_token_counts(spark, sf_dir).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())) == want


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25).map("".join), st.integers(1, 40))
def test_any_chunks_give_the_library_s_count(text, chunk):
    assert MACHINE.count(text, chunk) == len(library_ids([text])[0])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text_gives_the_library_s_count(text):
    text = text.encode("utf-8", "replace").decode()
    assert MACHINE.count(text) == len(library_ids([text])[0])


def pieces_of(text, cuts):
    at = sorted({0, *(min(c, len(text)) for c in cuts), len(text)})
    return [text[a:b] for a, b in zip(at, at[1:], strict=False)]


def map_of(chunk, entries):
    return {e: MACHINE.through(e, chunk) for e in entries}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([p for p in PARTS if "<" not in p]), min_size=3, max_size=20).map("".join), st.lists(st.integers(1, 30), max_size=5))
def test_maps_compose_associatively(text, cuts):
    chunks, maps, entries = pieces_of(text, cuts), [], {transducer.START}
    for c in chunks:  # each map for every exit of the one before, and for the start
        maps.append(map_of(c, entries))
        entries = {x for x, _ in maps[-1].values()} | {transducer.START}
    whole = transducer.compose(maps)
    for k in range(1, len(maps)):
        assert transducer.compose([transducer.compose(maps[:k]), transducer.compose(maps[k:])]) == whole
    last, n = whole[transducer.START]
    assert n + MACHINE.close(last) == len(library_ids([text])[0])
    assert whole == map_of(text, maps[0])  # as the machine goes through all of it


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), st.lists(st.sampled_from(PARTS), max_size=6).map("".join))
def test_all_entries_leave_by_one_exit_after_a_safe_cut(before, after):
    chunk = before + "x " + after
    exits = {MACHINE.through(MACHINE.step(transducer.START, lead)[0], chunk)[0] for lead in ("", "wor", "wor ", "12", "\n\n", "don'", "'r", "中")}
    assert len(exits) == 1
    assert all(transducer.State.of(x.key()) == x for x in exits)


def test_maps_of_other_entries_are_left_out():
    a, b = MACHINE.step(transducer.START, "wor")[0], MACHINE.step(transducer.START, "1")[0]
    assert transducer.compose([{transducer.START: (a, 1)}, {b: (a, 1)}]) == {}


def test_words_are_counted_by_the_machine_as_the_merges_do():
    for word in (b"", b"a", b"tokenization", b"\xff\x00\xfe", "naïveté".encode(), b"zzzzzzzzzzzzzzzzzzzzzzzzz", b" the"):
        assert MACHINE.words.count(word) == len(MACHINE.words.merged(word))


def test_forgotten_states_are_built_again(monkeypatch):
    monkeypatch.setattr(transducer, "KEEP_STATES", 3)
    monkeypatch.setattr(transducer, "KEEP_PIECES", 1)
    machine = transducer.Transducer(VOCABULARY)
    for text in ("one two three", "four five six", "one two three"):
        assert machine.count(text) == len(library_ids([text])[0])
        machine.trim()


def counts(df, **more):
    return sorted(r["n"] for r in transducer.count_tokens(df, VOCABULARY, count_col="n", **more).collect())


def test_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "same", "x"), (3, "same", "x"), (4, "long words  and\n lines " * 20_000, "x"), (None, "id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumns({"chunk": F.lit(1), "__row": F.lit("y"), "run": F.lit(2)})
    for more in ({}, {"chunk_chars": 1000}, {"chunk_chars": 1000, "long_chars": 3000}):
        assert counts(df, **more) == sorted(map(len, library_ids(t for _, t, _ in rows)))
        assert transducer.count_tokens(df, VOCABULARY, **more).columns == [*df.columns, "n_tokens"]
    assert counts(df.limit(0)) == []


def test_long_texts_of_every_kind_by_chunks(spark, monkeypatch):
    monkeypatch.setattr(transducer, "FAN", 3)
    monkeypatch.setattr(transducer, "LEAD_CHARS", 5)
    texts = ["".join(PARTS[(k * k + k // 7) % len(PARTS)] for k in range(3000)), "аб" * 4000, "中文字" * 3000, "a" * 9001, " " * 5000 + "x", "don't we'll 'rest " * 700, "<|endoftext|>" * 300 + "x" * 5000, "word " * 2000 + "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in transducer.count_tokens(df, VOCABULARY, chunk_chars=97, long_chars=500).collect()}
    assert got == {k: len(x) for k, x in enumerate(library_ids(texts))}


def test_twenty_megabytes_of_cyrillic_and_a_long_text_without_blanks(spark):
    words = [w for w in ("привет мир это очень длинный текст без конца и края который никто не читает " * 3).split()]
    blanks = " ".join(words[(k * 7 + k // 11) % len(words)] + str(k % 89) * (k % 5 == 0) for k in range(2_000_000))
    alone = "".join(words[(k * 5 + k // 13) % len(words)] for k in range(60_000))
    assert len(blanks.encode()) > 20_000_000
    df = spark.createDataFrame([(1, blanks), (2, alone)], "doc_id long, text string")
    assert counts(df) == sorted(map(len, library_ids([blanks, alone])))
    machine = transducer.Transducer(VOCABULARY)
    machine.count(blanks[:400_000])
    machine.count(alone[:40_000])
    assert sum(map(len, machine.known)) < 100_000


def test_the_tables_texts_are_counted_by_composed_maps(monkeypatch):
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist() if t and len(t) > transducer.CHUNK_CHARS]
    whole, made = transducer.composed, []
    monkeypatch.setattr(transducer, "composed", lambda maps: made.append(len(maps)) or whole(maps))
    assert [MACHINE.count(t) for t in texts] == [len(x) for x in library_ids(texts)]
    assert len(made) >= len(texts) > 20 and all(n > 1 for n in made)
    assert sum(len(t) > transducer.LONG_CHARS for t in texts)  # and one that goes by chunk rows


def test_wrong_entries_are_made_good(monkeypatch):
    monkeypatch.setattr(transducer, "LEAD_CHARS", 1)
    text = "don't 'tis the season's " + "a" * 300 + "12345" * 30 + "中文" * 100
    for chunk in (1, 2, 7, 64):
        maps = MACHINE.maps(text, chunk)
        assert any(len(m) > 1 for m in maps)
        assert MACHINE.count(text, chunk) == len(library_ids([text])[0])
