"""The registered queries of the library's own operators, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.keys import article, between, normalized, numbered, safe_key
from .model import KEY, SOURCE
from .operators import keyed
from .plans.pipeline import Branch, Pipeline, Stage, Step
from .plans.records import Commits
from .plans.run import run
from .sources.datasets import KeyedJSON, KeyedText, Loader, ParquetDataset, Sources
from .sources.files import shared_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _shared(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"


def _through(spark: SparkSession, name: str, frame: DataFrame, *steps) -> DataFrame:
    """What a pipeline of these steps, each persisted, makes of a frame."""
    made = Pipeline(name, Loader(name, lambda _: frame), [Stage("all", [Step(f, ParquetDataset()) for f in steps])])
    return run(spark, made, _shared(spark)).output


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias(KEY), "lang", F.col("text").alias("content"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return read(spark, sf_dir, "pages").select(
        F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias(KEY),
        between(html, '<html lang="', '"', "language").alias("lang"),
        between(html, "<h1>", "</h1>", "title").alias("content"),
    )


def _seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.union_sources({"documents": _documents(spark, sf_dir), "pages": _pages(spark, sf_dir)})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources, tagged and merged, routed by source, normalized, merged again, counted."""
    out = keyed.branch(_seed(spark, sf_dir), "source", {"documents": lambda d: d.withColumn("content", normalized(F.col("content"))), "pages": None})
    return out.groupBy(SOURCE, "lang").agg(F.count(F.lit(1)).alias("n"))


def keyed_load(spark, sf_dir):
    return _pages(spark, sf_dir)


def multisource_tag_union(spark, sf_dir):
    return _seed(spark, sf_dir)


def wrap_content(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("benchmark/"), F.col("item_id").cast("string")).alias(KEY), F.col("text").alias("value"))
    return keyed.tagged(keyed.wrapped(items), "benchmark")


def count_by_source(spark, sf_dir):
    frames = {t: read(spark, sf_dir, t).select(F.concat(F.lit(f"{t}/"), F.col(c).cast("string")).alias(KEY)) for t, c in (("documents", "doc_id"), ("pages", "page_id"))}
    return keyed.count_by_domain(keyed.union_sources(frames), SOURCE, ["documents", "pages", "benchmark"])


def collision_report(spark, sf_dir):
    return keyed.collisions({t: read(spark, sf_dir, t).select(F.col(c).cast("string").alias(KEY)) for t, c in (("documents", "doc_id"), ("pages", "page_id"))})


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias(KEY), "user_id", "event_type", "value")


def _level():
    return F.when(F.col("value") >= 100, "high").otherwise("low")


def branch_by_source(spark, sf_dir):
    parts, _ = keyed.fan_out(_seed(spark, sf_dir), "source", ["documents", "pages"])
    return keyed.merge_routes(parts).groupBy(SOURCE).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lang").alias("langs"))


def branch_by_predicate(spark, sf_dir):
    parts, _ = keyed.fan_out(_events(spark, sf_dir), _level(), ["high", "low"])
    return keyed.merge_routes({r: d.withColumn("route", F.lit(r)) for r, d in parts.items()}, check=False).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


def branch_merge(spark, sf_dir):
    return keyed.branch(_events(spark, sf_dir), _level(), {"high": lambda d: d.withColumn("value", F.col("value") * 2), "low": None})


def branch_passthrough_route(spark, sf_dir):
    return keyed.branch(_events(spark, sf_dir), _level(), {"high": None, "low": None})


def derive_scale(spark, sf_dir):
    """Two steps that derive columns, each written."""

    def bronze(df, context):
        return df.withColumns({"bronze": F.lit(True), "doubled_value": F.col("o_custkey").cast("bigint") * 2})

    def silver(df, context):
        return df.withColumn("normalized", F.col("doubled_value").cast("double") / 4.0)

    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias(KEY), "o_custkey")
    return _through(spark, "scaled", orders, bronze, silver)


def derive_normalize(spark, sf_dir):
    def names(df, context):
        return df.withColumn("name", normalized(F.col("name")))

    def scaled(df, context):
        return df.withColumn("scaled", F.col("scaled") * 10)

    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias(KEY), F.col("c_name").alias("name"), F.col("c_acctbal").alias("scaled"))
    return _through(spark, "normalized", customers, names, scaled)


def _money(column: str):
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def summary_count_total(spark, sf_dir):
    return keyed.summary(read(spark, sf_dir, "orders"), total=_money("o_totalprice"))


def summary_sorted_ids(spark, sf_dir):
    out = keyed.summary(read(spark, sf_dir, "nation").select(F.col("n_name").alias(KEY)))
    return out.select("count", F.array_join("ids", ",").alias("ids"))


def tag_row_key(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias(KEY), "c_custkey", "c_mktsegment")
    return keyed.rekey(customers, numbered("row-", F.col("c_custkey"))).select(KEY, "c_mktsegment")


def context_columns(spark, sf_dir):
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias(KEY), "s_name")
    return keyed.with_context(suppliers, tenant="acme", job_id="job-7")


def context_summary(spark, sf_dir):
    return keyed.with_context(keyed.summary(read(spark, sf_dir, "supplier"), total=_money("s_acctbal")), tenant="acme", job_id="job-7")


def render_html(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias(KEY), F.sha2(article(F.col("doc_id").cast("string"), F.col("lang"), F.col("source"), F.col("text")).cast("binary"), 256).alias("html_sha256"))


def extract_between(spark, sf_dir):
    html = F.col("html")
    return read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias(KEY), between(html, "<h1>", "</h1>").alias("title"), between(html, '<html lang="', '"').alias("lang"))


def lower_normalize(spark, sf_dir):
    def lower(df, context):
        return df.withColumns({"lower_sha256": F.sha2(F.lower("text").cast("binary"), 256), "source_key": numbered("documents/", F.col(KEY))}).drop("text")

    return _through(spark, "lower", read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias(KEY), "text"), lower)


def rekey_lang_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias(KEY), "lang")
    return keyed.rekey(docs, F.concat_ws("/", "lang", "__old"), origin="origin_key")


def rekey_last_wins(spark, sf_dir):
    return keyed.last_wins(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), F.col("user_id").cast("string"), F.col("event_id"))


def unify_required_defaults(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return keyed.with_defaults(docs.select(F.col("doc_id").cast("string").alias(KEY), "lang", "source", "quality"), ["lang", "source"], {"quality": -1, "title": ""})


def strip_source(spark, sf_dir):
    return keyed.strip_source(_seed(spark, sf_dir)).select(KEY, "lang")


def keep_source(spark, sf_dir):
    return _seed(spark, sf_dir).select(KEY, SOURCE, "lang")


def key_validity(spark, sf_dir):
    forms = ["en/{0}", "/abs{0}", "a\\{0}", "x/../{0}", "a..{0}", "", "a/./{0}", "a//{0}"]
    docs = read(spark, sf_dir, "documents").select("doc_id")
    keys = docs.select("doc_id", F.posexplode(F.array(*[F.concat(*[F.lit(x) if k % 2 == 0 else F.col("doc_id").cast("string") for k, x in enumerate(_around(f))]) for f in forms])).alias("form", KEY))
    return keys.select("doc_id", "form", safe_key(F.col(KEY)).alias("valid"))


def _around(form: str) -> list[str]:
    """The text before the number, a place for the number, and nothing after, as concat takes them."""
    return [form.replace("{0}", ""), ""] if "{0}" in form else [form]


def _orders_pipeline(sf_dir: str) -> Pipeline:
    schema = "key string, o_custkey bigint, o_totalprice double"
    load = Loader("orders", lambda s: read(s, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias(KEY), "o_custkey", "o_totalprice"))

    def keep(df, context):
        return df.where("o_totalprice >= 1000")

    def double(df, context):
        return df.withColumn("o_totalprice", F.col("o_totalprice") * 2)

    def count(df, context):
        return df.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), _money("o_totalprice").alias("total"))

    return Pipeline("orders", load, [Stage("select", [Step(keep, ParquetDataset(schema=schema)), Step(double, ParquetDataset(schema=schema))]), Stage("summary", [Step(count, ParquetDataset(keyed=False))])])


def pipeline_full_run(spark, sf_dir):
    """All stages of a pipeline, each committed; what the last one wrote."""
    return run(spark, _orders_pipeline(sf_dir), _shared(spark)).output


def selective_stage_reuse(spark, sf_dir):
    """The last stage alone, from the committed output of a run before."""
    root = _shared(spark)
    commits, pipeline = Commits(f"{root}/meta"), _orders_pipeline(sf_dir)
    run(spark, pipeline, root, commits=commits)
    return run(spark, pipeline, root, stage="summary", commits=commits).output


def branch_pipeline(spark, sf_dir):
    """Sources, routed by source to chains of persisted steps, merged and summarized in a run."""

    def plain(df, context):
        return df.withColumn("plain", normalized(F.col("content")))

    def loud(df, context):
        louder = F.concat("content", F.lit("!"))
        return df.withColumns({"content": louder, "plain": louder})

    def count(df, context):
        return df.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("plain")).alias("chars"))

    sources = Sources([Loader("documents", lambda s: _documents(s, sf_dir)), Loader("pages", lambda s: _pages(s, sf_dir))])
    routes = {"documents": [Step(plain, ParquetDataset())], "pages": [Step(loud, ParquetDataset())]}
    made = Pipeline("mixed", sources, [Stage("all", [Branch("by_source", "source", routes), Step(count, ParquetDataset(keyed=False))])])
    return run(spark, made, _shared(spark)).output


def keyed_json_files(spark, sf_dir):
    """One JSON file for each key, written and read back."""
    root, out = _shared(spark), KeyedJSON("nations", schema="n_name string, n_regionkey int")
    df = read(spark, sf_dir, "nation").select(F.concat_ws("/", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")).alias(KEY), "n_name", "n_regionkey")
    out.validate(df)
    out.save(df, root)
    return out.load_from(spark, root)


def keyed_text_files(spark, sf_dir):
    """One text file for each key, written and read back."""
    root, out = _shared(spark), KeyedText("items")
    out.save(read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias(KEY), F.col("text").alias("value")), root)
    return out.load_from(spark, root)


def committed_empty(spark, sf_dir):
    """A step with allowed empty output, committed, and read by a later selective run."""
    root = _shared(spark)
    schema = "key string, r_name string"
    load = Loader("regions", lambda s: read(s, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias(KEY), "r_name"))

    def none(df, context):
        return df.where("cast(key as int) < 0")

    def same(df, context):
        return df

    made = Pipeline("regions", load, [Stage("one", [Step(none, ParquetDataset(allow_empty=True, schema=schema))]), Stage("two", [Step(same, ParquetDataset(allow_empty=True, schema=schema))])])
    commits = Commits(f"{root}/meta")
    run(spark, made, root, commits=commits)
    return run(spark, made, root, stage=2, commits=commits).output


def windowed_event_counts(spark, sf_dir):
    from .streaming.batches import windowed_counts

    return windowed_counts(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def _between(text: str, start: str, end: str) -> str:
    """SQL of what stands between the first start and the first end after it."""
    rest = f"substr({text}, strpos({text}, '{start}') + {len(start)})"
    return f"substr({rest}, 1, strpos({rest}, '{end}') - 1)"


_LANG, _TITLE = _between("html", '<html lang="', '"'), _between("html", "<h1>", "</h1>")
_SEED = f"""(SELECT 'documents/' || doc_id AS key, 'documents' AS __source__, lang, text AS content FROM documents UNION ALL
SELECT 'pages/' || page_id, 'pages', {_LANG}, {_TITLE} FROM pages)"""
_EVENTS = "SELECT CAST(event_id AS VARCHAR) AS key, user_id, event_type, value FROM events"

SQL = {
    "flagship": f"SELECT __source__, lang, count(*) AS n FROM {_SEED} GROUP BY 1, 2",
    "keyed_load": f"SELECT key, lang, content FROM {_SEED} WHERE __source__ = 'pages'",
    "multisource_tag_union": f"SELECT key, lang, content, __source__ FROM {_SEED}",
    "wrap_content": "SELECT 'benchmark/' || item_id AS key, text AS content, 'benchmark' AS __source__ FROM benchmark",
    "count_by_source": f"SELECT d.s AS __source__, coalesce(n, 0) AS n FROM (VALUES ('documents'), ('pages'), ('benchmark')) d(s) LEFT JOIN (SELECT __source__, count(*) AS n FROM {_SEED} GROUP BY 1) c ON d.s = c.__source__",
    "collision_report": "SELECT key, count(*) AS n, min(src) AS existing, max(src) AS incoming FROM (SELECT CAST(doc_id AS VARCHAR) AS key, 'documents' AS src FROM documents UNION ALL SELECT CAST(page_id AS VARCHAR), 'pages' FROM pages) GROUP BY 1 HAVING count(*) > 1",
    "branch_by_source": f"SELECT __source__, count(*) AS n, count(DISTINCT lang) AS langs FROM {_SEED} GROUP BY 1",
    "branch_by_predicate": "SELECT CASE WHEN value >= 100 THEN 'high' ELSE 'low' END AS route, count(*) AS n FROM events GROUP BY 1",
    "branch_merge": "SELECT CAST(event_id AS VARCHAR) AS key, user_id, event_type, CASE WHEN value >= 100 THEN value * 2 ELSE value END AS value FROM events",
    "branch_passthrough_route": _EVENTS,
    "derive_scale": "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_custkey, true AS bronze, o_custkey * 2 AS doubled_value, CAST(o_custkey * 2 AS DOUBLE) / 4.0 AS normalized FROM orders",
    "derive_normalize": "SELECT CAST(c_custkey AS VARCHAR) AS key, lower(c_name) AS name, c_acctbal * 10 AS scaled FROM customer",
    "summary_count_total": "SELECT count(*) AS count, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders",
    "summary_sorted_ids": "SELECT count(*) AS count, string_agg(n_name, ',' ORDER BY n_name) AS ids FROM nation",
    "tag_row_key": "SELECT 'row-' || c_custkey AS key, c_mktsegment FROM customer",
    "context_columns": "SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name, 'acme' AS tenant, 'job-7' AS job_id FROM supplier",
    "context_summary": "SELECT count(*) AS count, CAST(sum(CAST(s_acctbal AS DECIMAL(18, 2))) AS DOUBLE) AS total, 'acme' AS tenant, 'job-7' AS job_id FROM supplier",
    "render_html": """SELECT CAST(doc_id AS VARCHAR) AS key, sha256('<article data-id="' || doc_id || '" data-lang="' || lang || '">' || chr(10) || '  <h1>' || source || '</h1>' || chr(10) || '  <p>' || text || '</p>' || chr(10) || '</article>' || chr(10)) AS html_sha256 FROM documents""",
    "extract_between": f"SELECT CAST(page_id AS VARCHAR) AS key, {_TITLE} AS title, {_LANG} AS lang FROM pages",
    "lower_normalize": "SELECT CAST(doc_id AS VARCHAR) AS key, sha256(lower(text)) AS lower_sha256, 'documents/' || doc_id AS source_key FROM documents",
    "rekey_lang_id": "SELECT lang || '/' || doc_id AS key, lang, CAST(doc_id AS VARCHAR) AS origin_key FROM documents",
    "rekey_last_wins": "SELECT CAST(user_id AS VARCHAR) AS key, user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "unify_required_defaults": "SELECT CAST(doc_id AS VARCHAR) AS key, lang, source, coalesce(quality, -1) AS quality, '' AS title FROM documents LEFT JOIN labels USING (doc_id)",
    "strip_source": f"SELECT key, lang FROM {_SEED}",
    "keep_source": f"SELECT key, __source__, lang FROM {_SEED}",
    "key_validity": "SELECT doc_id, f.form, f.valid FROM documents, (VALUES (0, true), (1, false), (2, false), (3, false), (4, true), (5, false), (6, false), (7, false)) f(form, valid)",
    "pipeline_full_run": "SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice * 2 AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders WHERE o_totalprice >= 1000 GROUP BY 1",
    "selective_stage_reuse": "SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice * 2 AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders WHERE o_totalprice >= 1000 GROUP BY 1",
    "branch_pipeline": f"SELECT lang, count(*) AS n, CAST(sum(length(CASE WHEN __source__ = 'documents' THEN trim(regexp_replace(lower(content), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) ELSE content || '!' END)) AS BIGINT) AS chars FROM {_SEED} GROUP BY 1",
    "keyed_json_files": "SELECT n_regionkey || '/' || n_nationkey AS key, n_name, n_regionkey FROM nation",
    "keyed_text_files": "SELECT CAST(item_id AS VARCHAR) AS key, text AS value FROM benchmark",
    "committed_empty": "SELECT CAST(r_regionkey AS VARCHAR) AS key, r_name FROM region WHERE r_regionkey < 0",
    "windowed_event_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}


def queries() -> dict:
    from . import run_queries, table_queries

    return {n: globals()[n] for n in SQL} | run_queries.queries() | table_queries.queries()


def oracle_sql() -> dict[str, str]:
    from . import run_queries, table_queries

    return SQL | run_queries.SQL | table_queries.SQL
