from collections import Counter

import corpus_pipeline
import numpy as np
from brute import classes, crc, hits, library_ids, windows
from pyspark.sql import functions as F

from sluice.llm import language, neardup, quality


def test_run_equals_a_plain_version(spark, sf_dir):
    """The stages one by one in plain Python, over sf0.001; models are those that the stages train, which is deterministic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, benchmark = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = sorted((r.asDict() for r in docs.collect()), key=lambda r: r["doc_id"])
    lines = quality.train(docs.where(quality.learnable()), labels)
    rows = [r for r in rows if lines.scores([r["text"]])[0] >= quality.THRESHOLD]
    kept = spark.createDataFrame(rows, docs.schema)
    model = language.train(kept.where(language.learnable()))
    tagger, spoken = language.Tagger(model, language.SWITCH_COST), []
    for r in rows:
        n = tagger.words([r["text"]])[0]
        if len(n):
            own = np.bincount(tagger.labels(n), tagger.sizes[n])
            if own.max() >= corpus_pipeline.LANGUAGE_SHARE * own.sum():
                spoken.append(r)
    first = classes([r["text"] for r in spoken], neardup.THRESHOLD, neardup.IDF_BUCKETS)
    distinct = [r for k, r in enumerate(spoken) if first[k] == k]
    known = windows([tuple(r) for r in benchmark.select("item_id", "text").collect()])
    clean = [r for r in distinct if not hits(r["text"], known)[1]]
    assert len(docs.collect()) > len(rows) >= len(spoken) > len(distinct) > len(clean) > 0

    got = corpus_pipeline.run(spark, sf_dir).collect()
    whole = {r["doc_id"]: [*ids, 2] for r, ids in zip(clean, library_ids(r["text"] for r in clean), strict=True)}
    pieces = {}
    for d, ids in whole.items():
        start, n = 0, len(ids) % 1024 or 1024
        for piece in range(-(-len(ids) // 1024)):
            pieces[d, piece] = (start, n, crc(ids[start : start + n]))
            start, n = start + n, 1024
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == pieces
    assert len(got) == len(pieces)
    filled = Counter()
    for r in got:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 1024


def test_stages_keep_columns_and_take_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("score", F.lit("x")).withColumn("key", F.lit(1))
    odd = spark.createDataFrame([(None, None, None, None, None, None, None), (10**9, "", "en", "s", 0, "y", 2)], "doc_id long, text string, lang string, source string, n_chars long, score string, key int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        some = docs.unionByName(odd)
        out = stage(spark, some, sf_dir)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= some.count(), name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs.limit(0), sf_dir).count() == 0


def test_registered(spark):
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and corpus_pipeline.ORACLE_SQL is None and "pipeline" not in entry.oracle_sql()
    assert sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op")) == list(range(1, 14))
