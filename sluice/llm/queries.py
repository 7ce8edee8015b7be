"""The registered queries of this subpackage, with SQL for those that SQL can express.

Each takes (spark, sf_dir), runs its operator with production parameters over its whole table, and derives the digest columns from
what the operator returns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, filter_audit, language, mtree, neardup, packing, quality, rans, sharding, simhash, transducer, whitening
from ._common import read

#: Where the vocabulary files are: a parameter of the operators, this file for the queries.
VOCABULARY = "byte_bpe_50k.json"
#: Limit of tokens of op9's over_limit.
TOKEN_LIMIT = 512


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def op1_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary(), capacity=1024, end_id=2, with_ids=False)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan_windows(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), n=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = sharding.shard_documents(read(spark, sf_dir, "documents"))
    return table.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op5_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "representative")


def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = chat.rotate_perspectives(read(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit(":"), m["end"].cast("string")))
    return turned.select("conv_id", "perspective", "n_turns", "text", F.array_join(spans, ",").alias("mask"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(language.learnable()))
    found = docs.select("doc_id", language.held_out().alias("held_out"), language.identify(F.col("text"), model).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.size("found.spans").cast("long").alias("n_spans"))


def op8_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(read(spark, sf_dir, "documents"), vocabulary(), end_id=0)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = transducer.count_tokens(docs, vocabulary())
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs.where(quality.learnable()), read(spark, sf_dir, "labels").where(quality.learnable()))
    scored = docs.select("doc_id", quality.held_out().alias("held_out"), quality.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    projected, model = whitening.whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    shares = model.explained() if model else []
    facts = [F.lit(model.n if model else 0).cast("long").alias("n"), F.col("whitening.deviation").cast("long").alias("deviation")]
    values = F.posexplode("whitening.whitened").alias("at", "whitened")
    spread = projected.select(F.col("vec_id").cast("long").alias("vec_id"), *facts, values)
    explained = F.element_at(F.array(*[F.lit(s) for s in shares]).cast("array<double>"), F.col("at") + 1)
    error = F.lit(model.identity_error if model else None).cast("double")
    return spread.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", explained.alias("explained"), error.alias("identity_error"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), read(spark, sf_dir, "labels"))


def op13_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the top of the repository, beside this package; it imports the operators itself

    return corpus_pipeline.run(spark, sf_dir)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
bk AS (SELECT item, ws, least(10, len(ws)) AS k FROM b WHERE len(ws) > 0),
bi AS (SELECT item, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM bk),
iw AS (SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS win FROM bi),
sizes AS (SELECT DISTINCT k FROM iw),
di AS (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, sizes),
dw AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS win FROM di),
hits AS (SELECT doc_id, i, k, item FROM dw JOIN iw USING (k, win)),
spots AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hits),
cov AS (SELECT doc_id, count(*) AS n_hit FROM spots GROUP BY doc_id),
one AS (SELECT DISTINCT doc_id, item FROM hits),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM one GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP4_SQL = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"

OP6_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS sp, coalesce(text, '') AS tx FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sp, tx) AS rn FROM t),
p AS (SELECT DISTINCT conv_id, sp AS perspective FROM t WHERE sp <> 'system'),
x AS (
  SELECT n.conv_id, p.perspective, n.rn, n.sp = p.perspective AS own,
         '<|im_start|>' || CASE WHEN n.sp = p.perspective THEN 'assistant' WHEN n.sp = 'system' THEN 'system'
           ELSE 'user name=' || regexp_replace(regexp_replace(n.sp, '[\r\n]', ' ', 'g'), '<\|(im_start|im_end)\|>', '<\1|>', 'g') END || chr(10) AS head,
         regexp_replace(n.tx, '<\|(im_start|im_end)\|>', '<\1|>', 'g') || '<|im_end|>' AS body
  FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id),
y AS (SELECT *, CAST(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY rn) AS BIGINT) - length(body) - 1 AS s FROM x)
SELECT conv_id, perspective, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY rn) AS text,
       coalesce(string_agg(s || ':' || (s + length(body)), ',' ORDER BY rn) FILTER (WHERE own), '') AS mask
FROM y GROUP BY conv_id, perspective
"""


OP12_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT doc_id, part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
             100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
             coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
h AS (SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad
      FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
x(k, name) AS (VALUES (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')),
o AS (SELECT [p.k, q.k, r.k, s.k, t.k] AS ks, p.name || q.name || r.name || s.name || t.name AS filter_order
      FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.k, q.k, r.k, s.k, t.k])) = 5),
st AS (SELECT filter_order, step, ks[step] AS own, list_slice(ks, 1, step - 1) AS earlier FROM (SELECT *, unnest(range(1, 6)) AS step FROM o)),
y AS (SELECT part, filter_order, step, own, n, good, bad, fails[own] AS now, len(list_filter(earlier, lambda j: fails[j])) > 0 AS gone,
             len(list_filter(fails, lambda z: z)) AS broken FROM h, st),
g AS (SELECT part, filter_order, step, own,
             CAST(coalesce(sum(n) FILTER (WHERE NOT now AND NOT gone), 0) AS BIGINT) AS kept,
             CAST(coalesce(sum(n) FILTER (WHERE now AND NOT gone), 0) AS BIGINT) AS removed,
             CAST(coalesce(sum(n) FILTER (WHERE now AND gone), 0) AS BIGINT) AS redundant,
             CAST(coalesce(sum(n) FILTER (WHERE now AND broken = 1), 0) AS BIGINT) AS unique_fails,
             CAST(coalesce(sum(good) FILTER (WHERE now AND NOT gone), 0) AS BIGINT) AS good_lost,
             CAST(coalesce(sum(bad) FILTER (WHERE now AND NOT gone), 0) AS BIGINT) AS toxic_lost
      FROM y GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM g
"""


def queries() -> dict:
    own = [op1_mtree_search, op2_best_fit_packing, op3_decontamination, op4_sharding, op5_minhash_near_duplicates]
    own += [op6_chat_rotation, op7_language_id, op8_rans_tokens, op9_token_counts, op10_line_quality]
    own += [op11_embedding_whitening, op12_filter_audit, op13_simhash_near_duplicates, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_mtree_search": OP1_SQL, "op3_decontamination": OP3_SQL, "op4_sharding": OP4_SQL, "op6_chat_rotation": OP6_SQL, "op12_filter_audit": OP12_SQL}
