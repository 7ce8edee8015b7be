"""The registered queries of ordered operators, fan-out and key reconciliation, over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import tables
from .model import KEY, RecordError
from .operators import keyed, ordered, sketches
from .plans.pipeline import Branch, Pipeline, Stage, Step
from .plans.records import Commits
from .plans.run import bind, run
from .queries import _shared, read
from .sources.datasets import Dataset, EmptyLoadable, Inspectable, KeyedJSON, KeyedText, Loadable, Loader, ParquetDataset, TextFile
from .sources.files import Files, is_url, leaf
from .streaming.sessions import Sessions


def _hot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, a third of them of one user."""
    user = F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")).cast("long")
    return read(spark, sf_dir, "events").select("event_id", "ts", user.alias("user_id"), "event_type", F.col("value").cast("decimal(18,4)").alias("value"))


_HOT = "(SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id, event_type, CAST(value AS DECIMAL(18, 4)) AS value FROM events)"


#: Events with their batch, and whether they came late: before the newest of all batches before, less twenty days.
_LATE = """b AS (SELECT *, event_id % 4 AS batch FROM events), m AS (SELECT batch, max(ts) AS newest FROM b GROUP BY 1),
a AS (SELECT *, coalesce(ts < (SELECT max(newest) FROM m WHERE m.batch < b.batch) - INTERVAL 20 DAY, false) AS late FROM b)"""


def as_of_events(spark, sf_dir):
    """Each purchase with the latest view of its user before it, a third of all events being of one user."""
    events = _hot_events(spark, sf_dir)
    found = ordered.as_of_join(events.where("event_type = 'purchase'"), events.where("event_type = 'view'"), ["user_id"], "ts", "ts", tie=["event_id"])
    return found.select("event_id", "user_id", F.coalesce("matched.event_id", F.lit(-1)).alias("view_id"))


def as_of_next_within(spark, sf_dir):
    """Each error with the first click of its user after it, not at its time, within six hours; errors without one left out."""
    events = _hot_events(spark, sf_dir)
    errors, clicks = (events.where(F.col("event_type") == t) for t in ("error", "click"))
    found = ordered.as_of_join(errors, clicks, ["user_id"], "ts", "ts", direction="forward", strict=True, tolerance=F.expr("interval 6 hours"), tie=["event_id"], how="inner")
    return found.select("event_id", F.col("matched.event_id").alias("click_id"))


def running_user_totals(spark, sf_dir):
    """Number, running total, highest value so far and event before, of each event of a user."""
    made = ordered.running(_hot_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], row_number="number", sums={"total": "value"}, highs={"top": "value"}, lags={"before": "event_id"})
    return made.select("event_id", "number", F.col("total").cast("double").alias("total"), F.col("top").cast("double").alias("top"), F.coalesce("before", F.lit(-1)).alias("before"))


def event_type_ranks(spark, sf_dir):
    """Rank and dense rank by type within a user: a few ranks, of very many rows each."""
    return ordered.ranked(_hot_events(spark, sf_dir), ["user_id"], ["event_type"], dense_rank="dense").select("event_id", "rank", "dense")


def concurrent_orders(spark, sf_dir):
    """How many other orders of its customer are open at some time while an order is, from its date to its last shipment, if that is later."""
    shipped = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("until"))
    root = _shared(spark)
    read(spark, sf_dir, "orders").join(shipped, "o_orderkey").select("o_orderkey", "o_custkey", "o_orderdate", "until").write.parquet(root)
    spans = spark.read.parquet(root)  # both sides read it several times
    met = ordered.interval_join(spans, spans, ["o_custkey"], ("o_orderdate", "until"), ("o_orderdate", "until"), width=86400.0 * 7)
    return met.groupBy(F.col("left.o_orderkey").alias("o_orderkey")).agg((F.count(F.lit(1)) - 1).alias("others"))


def events_in_orders(spark, sf_dir):
    """Line items that ship while another order of the same customer is at most a day old: points in intervals."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", (F.col("o_orderdate") + F.expr("interval 1 day")).alias("until"))
    lines = read(spark, sf_dir, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select("l_orderkey", "o_custkey", "l_shipdate")
    met = ordered.interval_join(lines, orders, ["o_custkey"], ("l_shipdate", "l_shipdate"), ("o_orderdate", "until"), width=86400.0, closed=True)
    return met.where("left.l_orderkey <> right.o_orderkey").groupBy(F.col("right.o_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))


def fan_out_languages(spark, sf_dir):
    """Documents, written once with a folder for each language; what each route got, as the write counted it and as it is read."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias(KEY), "lang", "text")
    langs = [r["lang"] for r in docs.select("lang").distinct().orderBy("lang").collect()]  # the routes of a branch are few
    parts, counts = keyed.fan_out(docs, F.col("lang"), langs)
    told = spark.createDataFrame(list(counts.items()), "lang string, counted long")
    there = keyed.merge_routes(parts).groupBy("lang").agg(F.count(F.lit(1)).alias("there"), F.sum(F.length("text")).alias("chars"))
    return told.join(there, "lang")


def fan_out_chains(spark, sf_dir):
    """A run whose branch has a chain of persisted steps for one language, one step for another, and lets all others pass."""

    def upper(df, context):
        return df.withColumn("tag", F.upper("lang"))

    def twice(df, context):
        return df.withColumn("tag", F.concat("tag", "tag"))

    def sizes(df, context):
        return df.withColumn("tag", F.length("text").cast("string"))

    schema = "key string, lang string, text string, tag string"
    out = lambda: ParquetDataset(schema=schema, allow_empty=True)
    load = Loader("documents", lambda s: read(s, sf_dir, "documents").select(F.col("doc_id").cast("string").alias(KEY), "lang", "text", F.lit("").alias("tag")))
    routes = {"de": [Step(upper, out()), Step(twice, out())], "en": [Step(sizes, out())], "rest": []}
    made = Pipeline("chains", load, [Stage("all", [Branch("lang", F.when(F.col("lang").isin("de", "en"), F.col("lang")).otherwise("rest"), routes)])])
    return run(spark, made, _shared(spark)).output.select(KEY, "lang", "tag")


def key_reconciliation(spark, sf_dir):
    """What a selective run tells of a committed table of documents that has since lost the first and gained another: keys missing and extra by name."""
    root, schema = _shared(spark), "key string, lang string"
    docs = read(spark, sf_dir, "documents").select(F.format_string("%012d", "doc_id").alias(KEY), "lang")

    def same(df, context):
        return df

    made = Pipeline("docs", Loader("docs", lambda s: docs), [Stage("s", [Step(same, ParquetDataset(schema=schema), name="one"), Step(same, ParquetDataset(schema=schema), name="two")])])
    commits, files, at = Commits(f"{root}/meta"), Files(spark), f"{root}/docs/001_s/001_one"
    run(spark, made, root, stage="s", step="one", commits=commits)
    first = docs.agg(F.min(KEY)).first()[0]
    old = spark.read.schema(schema).parquet(at)
    old.withColumn(KEY, F.when(F.col(KEY) == first, F.concat(F.lit("new"), KEY)).otherwise(F.col(KEY))).write.parquet(f"{at}-other")
    files.delete(at)
    files.rename(f"{at}-other", at)
    try:
        run(spark, made, root, stage="s", step="two", commits=commits)
        told = "trusted"
    except RecordError as e:
        told = str(e).partition(": ")[2]
    return spark.createDataFrame([(told,)], "told string")


def written_metrics(spark, sf_dir):
    """The rows of each persisted step as its write counted them, told to an observer, for a run over documents and its routes."""
    told = []

    class Rows:
        def on_event(self, spark, event):
            if event["kind"] == "node_completed":
                told.append((event["node"], event["step"], -1 if event["rows"] is None else event["rows"]))

    def long(df, context):
        return df.where(F.length("text") >= 1000)

    def same(df, context):
        return df

    load = Loader("documents", lambda s: read(s, sf_dir, "documents").select(F.col("doc_id").cast("string").alias(KEY), "lang", "text"))
    out = lambda: ParquetDataset(schema="key string, lang string, text string", allow_empty=True)
    route = F.when(F.col("lang") == "en", "en").otherwise("other")
    stages = [Stage("a", [Step(long, out()), Step(same, out(), persist=False, name="lazy")]), Stage("b", [Branch("by", route, {"en": [Step(same, out(), name="en")], "other": [Step(same, out(), name="other")]})])]
    run(spark, Pipeline("m", load, stages), _shared(spark), observers=[Rows()])
    return spark.createDataFrame(told, "node string, step string, rows long")


def keyed_text_tree(spark, sf_dir):
    """Every page's address as a file of its own in folders by language and thousand, keys with colons; written, listed and read by tasks."""
    root, out = _shared(spark), KeyedText("pages", suffix=".url")
    pages = read(spark, sf_dir, "pages")
    data = pages.select(F.concat(F.lit("p:"), F.floor(F.col("page_id") / 1000).cast("string"), F.lit("/"), F.col("page_id").cast("string"), F.lit(":%3A")).alias(KEY), F.col("url").alias("value"))
    out.validate(data)
    out.save(data, root)
    return out.load_from(spark, root).join(out.keys_at(spark, root), KEY)


def sketch_rollup(spark, sf_dir):
    """Distinct users and the median value of events by type and day, by type, and of all, from one table of sketches; held against what the rows say, within the stated errors."""
    root, day = _shared(spark), F.date_format("ts", "yyyy-MM-dd").alias("day")
    events = read(spark, sf_dir, "events").select("event_type", day, "user_id", "value")
    sketches.sketched(events, ["event_type", "day"], distinct={"users": "user_id"}, quantiles={"value": "value"}).write.parquet(root)
    sets, by = [["event_type", "day"], ["event_type"], []], ["event_type", "day"]
    told = sketches.answers(sketches.rolled(spark.read.parquet(root), sets))
    grouped = lambda made: events.groupingSets([[F.col(c) for c in s] for s in sets], *by).agg(F.grouping_id().alias("grouping"), made)
    # apart, as a distinct count beside them would make a digest of values for each user
    users, around = grouped(F.countDistinct("user_id").alias("users")), grouped(F.percentile_approx("value", [0.45, 0.55], 10_000).alias("around"))
    named = lambda df: df.withColumns({c: F.coalesce(c, F.lit("*")) for c in by})
    met = named(told).join(named(users), ["grouping", *by]).join(named(around), ["grouping", *by])
    near = F.abs(F.col("d_users") / F.col("users") - 1) <= 0.07  # over four standard errors
    return met.select(*by, "n", near.alias("users_near"), F.col("q_value")[0].between(F.col("around")[0], F.col("around")[1]).alias("median_near"))


def sketches_of_runs(spark, sf_dir):
    """Users and rows of events that two runs wrote, from the sketches that their writes left in the commit records, put together without a read."""
    root, parts = _shared(spark), []
    events = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias(KEY), "user_id")
    for k in range(2):
        step = Step(lambda df, context: df, ParquetDataset(metrics={"users": sketches.distinct_sketch("user_id"), "highest": F.max("user_id")}), name="same")
        made = Pipeline(f"p{k}", Loader("events", lambda s, k=k: events.where(F.col(KEY).cast("long") % 2 == k)), [Stage("s", [step])])
        commits = Commits(f"{root}/meta")
        run(spark, made, root, commits=commits)
        told = commits.metrics(spark, made.name, bind(made, root).nodes[0])
        parts.append((told["users"], told["highest"]))
    merged = spark.createDataFrame(parts, "users binary, highest long").agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"), F.max("highest").alias("highest"))
    exact = events.agg(F.countDistinct("user_id")).first()[0]
    return merged.select("highest", (F.abs(F.col("users") / F.lit(max(exact, 1)) - 1) <= 0.07).alias("users_near"))


def summary_with_records(spark, sf_dir):
    """The summary of suppliers by nation as one record with all records in it, in a mode; told as its rows."""
    nations = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("string").alias(KEY)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("s_acctbal").cast("decimal(18,2)")).cast("double").alias("total"))
    made = keyed.summary_of_records(nations, mode="smoke", suppliers=F.sum("n"))
    return made.select("count", "suppliers", "mode", F.explode("records").alias(KEY, "r")).select("count", "suppliers", "mode", KEY, "r.n", "r.total")


def bound_plans(spark, sf_dir):
    """What a whole run, a stage, and a step of a pipeline over documents would do, and the rows that each step that ran then wrote."""
    root = _shared(spark)
    schema = "key string, lang string"
    load = Loader("documents", lambda s: read(s, sf_dir, "documents").select(F.col("doc_id").cast("string").alias(KEY), "lang"))

    def same(df, context):
        return df

    def english(df, context):
        return df.where("lang = 'en'")

    step = lambda fn, name, **more: Step(fn, ParquetDataset(schema=schema, allow_empty=True), name=name, **more)
    made = Pipeline("plans", load, [Stage("a", [step(same, "whole"), step(english, "english")]), Stage("b", [step(same, "lazy", persist=False), step(same, "last")], clean=True)])
    commits, rows = Commits(f"{root}/meta"), []
    for what, args in (("all", {}), ("stage b", {"stage": "b"}), ("step english", {"stage": "a", "step": "english"})):
        bound, wrote = bind(made, root, **args), {}

        class Rows:
            def on_event(self, spark, event, wrote=wrote):
                if event["kind"] == "node_completed" and event["rows"] is not None:
                    wrote[event["node"]] = event["rows"]

        before = bound.before()
        run(spark, made, root, commits=commits, observers=[Rows()], **args)
        for d in bound.describe():
            rows.append((what, d["node"], d["folder"].removeprefix(root), d["runs"], d["persist"], before[2].name if before else "", len(bound.emptied()), wrote.get(d["node"], 0)))
    return spark.createDataFrame(rows, "selection string, node string, folder string, runs boolean, persist boolean, starts_after string, emptied int, rows long")


def page_parts(spark, sf_dir):
    """Every attribute value in the markup of pages, by a table function that is used lateral, in SQL."""
    tables.register(spark)
    read(spark, sf_dir, "pages").createOrReplaceTempView("sluice_pages")
    return spark.sql("""SELECT page_id, p.position, p.value FROM sluice_pages, LATERAL stretches(html, '="', '"', 'value') p""")


def event_steps(spark, sf_dir):
    """By how much each event's number differs from that of the event before of its user, by a step of a pipeline that is a table function."""

    def differ(df, context):
        return tables.with_steps(df, "user_id", ["ts", "event_id"], "event_id", "step")

    events = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias(KEY), "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    made = Pipeline("steps", Loader("events", lambda s: events), [Stage("all", [Step(differ, ParquetDataset())])])
    return run(spark, made, _shared(spark)).output.select("event_id", "user_id", F.coalesce("step", F.lit(0)).alias("step"))


def name_rules(spark, sf_dir):
    """Whether a stage, a step and a branch may be named after each language of documents in several forms; whether that is a URL, and its last segment."""

    def same(df, context):
        return df

    def fine(make) -> bool:
        try:
            make()
            return True
        except ValueError:
            return False

    rows = []
    for lang in [r["lang"] for r in read(spark, sf_dir, "documents").select("lang").distinct().collect()]:
        for k, form in enumerate(("{}", "a {}", "a/{}", "{}\\b", "s3://{}/x", "/x/{}/")):
            name = form.format(lang)
            each = [fine(lambda n=name: Stage(n, [])), fine(lambda n=name: Step(same, name=n)), fine(lambda n=name: Branch(n, "source", {"x": []}))]
            rows.append((lang, k, *each, is_url(name), leaf(name)))
    return spark.createDataFrame(rows, "lang string, form int, stage boolean, step boolean, branch boolean, url boolean, last string")


def plugin_rules(spark, sf_dir):
    """Runs over documents with extensions of several shapes, by the error each gives before any step runs, or the rows of its output."""
    root, load = _shared(spark), Loader("documents", lambda s: read(s, sf_dir, "documents").select(F.col("doc_id").cast("string").alias(KEY), "lang"))

    def same(df, context):
        return df

    class Watch:
        def __init__(self, plugin_id=None, required=False):
            self.plugin_id, self.required = plugin_id, required

        def on_event(self, spark, event):
            pass

    class Guard:
        def enter(self, spark, pipeline, run_id):
            pass

        def exit(self, spark, pipeline, outcome):
            pass

    one, guard = Watch("one"), Guard()
    cases = [("own ids", {"observers": [one, Watch("two")]}), ("one id", {"observers": [one, Watch("one")]}), ("id with a slash", {"observers": [Watch("a/b")]})]
    cases += [("twice", {"observers": [one, one]}), ("required", {"observers": [Watch(required="yes")]}), ("no observer", {"observers": [object()]}), ("no guard", {"guards": [object()]})]
    cases += [("guard", {"guards": [guard]}), ("guard twice", {"guards": [guard, guard]}), ("no records", {"commits": 3}), ("records", {"commits": Commits(f"{root}/meta")})]
    rows = []
    for what, args in cases:
        made = Pipeline("rules", load, [Stage("s", [Step(same, ParquetDataset(schema="key string, lang string"))])])
        try:
            rows.append((what, "", run(spark, made, root, **args).output.count()))
        except (TypeError, ValueError) as e:
            rows.append((what, type(e).__name__, 0))
    return spark.createDataFrame(rows, "extension string, error string, rows long")


def dataset_contracts(spark, sf_dir):
    """What each kind of dataset can do beside loading and saving, and the rows that it gave back of whole tables."""
    root, items = _shared(spark), read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias(KEY), F.col("text").alias("value"))
    total = items.agg(F.sum(F.length("value")).cast("string").alias("value"))
    kinds = [(ParquetDataset("a"), items), (KeyedText("b"), items), (KeyedJSON("c", schema="value string"), items), (TextFile("d"), total)]
    rows = []
    for out, data in kinds:
        at = f"{root}/{out.name}"
        out.save(data, at)
        keys = out.keys_at(spark, at)
        rows.append((type(out).__name__, *[isinstance(out, c) for c in (Dataset, Loadable, EmptyLoadable, Inspectable)], out.load_from(spark, at).count(), -1 if keys is None else keys.count()))
    return spark.createDataFrame(rows, "kind string, dataset boolean, loadable boolean, empty_loadable boolean, inspectable boolean, rows long, keys long")


def _arrivals(spark, sf_dir):
    """Events in four arrivals by number, each a batch of a stream; (session, root)."""
    root = _shared(spark)
    events = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("value").cast("decimal(18,4)").alias("value"))
    own = Sessions(f"{root}/sessions", "ts", ["user_id"], gap=3600.0 * 3, late=86400.0 * 20, sums={"total": "value"})
    for k in range(4):
        events.where(F.col("event_id") % 4 == k).write.parquet(f"{root}/in/arrival={k}")
        own.start(spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in"), f"{root}/check").awaitTermination()
    return own


def stream_sessions(spark, sf_dir):
    """Sessions of users from events that arrive out of order in four micro-batches, those that came too late left out; open ones as they are at the end."""
    found = _arrivals(spark, sf_dir).sessions(spark, open_too=True)
    return found.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "rows", F.col("total").cast("double").alias("total"))


def stream_late_rows(spark, sf_dir):
    """The events that came more than twenty days after the newest of the batches before."""
    return _arrivals(spark, sf_dir).late_rows(spark).select("event_id", F.col("batch").cast("long").alias("batch"))


SQL = {
    "as_of_events": f"SELECT p.event_id, p.user_id, coalesce(v.event_id, -1) AS view_id FROM (SELECT * FROM {_HOT} WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM {_HOT} WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts",
    "as_of_next_within": f"SELECT p.event_id, v.event_id AS click_id FROM (SELECT * FROM {_HOT} WHERE event_type = 'error') p ASOF JOIN (SELECT * FROM {_HOT} WHERE event_type = 'click') v ON p.user_id = v.user_id AND p.ts < v.ts WHERE v.ts <= p.ts + INTERVAL 6 HOUR",
    "running_user_totals": f"SELECT event_id, row_number() OVER w AS number, CAST(sum(value) OVER w AS DOUBLE) AS total, CAST(max(value) OVER w AS DOUBLE) AS top, coalesce(lag(event_id) OVER w, -1) AS before FROM {_HOT} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "event_type_ranks": f"SELECT event_id, rank() OVER w AS rank, dense_rank() OVER w AS dense FROM {_HOT} WINDOW w AS (PARTITION BY user_id ORDER BY event_type)",
    "concurrent_orders": """WITH s AS (SELECT o_orderkey, o_custkey, o_orderdate AS a, (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey) AS b FROM orders)
SELECT x.o_orderkey, count(*) - 1 AS others FROM s x JOIN s y ON x.o_custkey = y.o_custkey AND x.a < y.b AND y.a < x.b WHERE x.a < x.b AND y.a < y.b GROUP BY 1""",
    "events_in_orders": """SELECT o.o_orderkey, count(*) AS lines FROM lineitem JOIN orders w ON l_orderkey = w.o_orderkey
JOIN orders o ON o.o_custkey = w.o_custkey AND o.o_orderkey <> l_orderkey AND l_shipdate >= o.o_orderdate AND l_shipdate <= o.o_orderdate + INTERVAL 1 DAY GROUP BY 1""",
    "fan_out_languages": "SELECT lang, count(*) AS counted, count(*) AS there, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1",
    "fan_out_chains": "SELECT CAST(doc_id AS VARCHAR) AS key, lang, CASE lang WHEN 'de' THEN 'DEDE' WHEN 'en' THEN CAST(length(text) AS VARCHAR) ELSE '' END AS tag FROM documents",
    "key_reconciliation": "SELECT 'missing=[''' || k || '''], extra=[''new' || k || ''']' AS told FROM (SELECT lpad(CAST(min(doc_id) AS VARCHAR), 12, '0') AS k FROM documents)",
    "written_metrics": """WITH d AS (SELECT lang FROM documents WHERE length(text) >= 1000)
SELECT 's001-e001' AS node, 'long' AS step, count(*) AS rows FROM d UNION ALL SELECT 's001-e002', 'lazy', -1
UNION ALL SELECT 's002-e001-r001-001', 'en', count(*) FROM d WHERE lang = 'en' UNION ALL SELECT 's002-e001-r002-001', 'other', count(*) FROM d WHERE lang <> 'en'""",
    "sketch_rollup": """SELECT coalesce(event_type, '*') AS event_type, coalesce(day, '*') AS day, count(*) AS n, true AS users_near, true AS median_near
FROM (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day FROM events) GROUP BY GROUPING SETS ((event_type, day), (event_type), ())""",
    "sketches_of_runs": "SELECT max(user_id) AS highest, true AS users_near FROM events",
    "summary_with_records": """WITH k AS (SELECT CAST(s_nationkey AS VARCHAR) AS key, count(*) AS n, CAST(sum(CAST(s_acctbal AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM supplier GROUP BY 1)
SELECT (SELECT count(*) FROM k) AS count, (SELECT count(*) FROM supplier) AS suppliers, 'smoke' AS mode, key, n, total FROM k""",
    "bound_plans": """WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS en FROM documents),
s(node, folder, persist) AS (VALUES ('s001-e001', '/plans/001_a/001_whole', true), ('s001-e002', '/plans/001_a/002_english', true), ('s002-e001', '/plans/002_b/001_lazy', false), ('s002-e002', '/plans/002_b/002_last', true)),
x(selection, starts_after, emptied) AS (VALUES ('all', '', 1), ('stage b', 'english', 1), ('step english', 'whole', 0)),
r AS (SELECT *, selection = 'all' OR (selection = 'stage b' AND node LIKE 's002%') OR (selection = 'step english' AND node = 's001-e002') AS runs FROM s, x)
SELECT selection, node, folder, runs, persist, starts_after, CAST(emptied AS INTEGER) AS emptied, CASE WHEN NOT runs OR NOT persist THEN 0 WHEN node = 's001-e001' THEN n ELSE en END AS rows FROM r, c""",
    "name_rules": r"""SELECT lang, form, ok AS stage, ok AS step, ok AS branch, url, replace(l, '{}', lang) AS last FROM (SELECT DISTINCT lang FROM documents),
(VALUES (0, true, false, '{}'), (1, true, false, 'a {}'), (2, false, false, '{}'), (3, false, false, '{}\b'), (4, false, true, 'x'), (5, false, false, '{}')) f(form, ok, url, l)""",
    "plugin_rules": """SELECT extension, error, CASE WHEN error = '' THEN n ELSE 0 END AS rows FROM (SELECT count(*) AS n FROM documents),
(VALUES ('own ids', ''), ('one id', 'ValueError'), ('id with a slash', 'ValueError'), ('twice', 'ValueError'), ('required', 'TypeError'), ('no observer', 'TypeError'), ('no guard', 'TypeError'),
('guard', ''), ('guard twice', 'ValueError'), ('no records', 'TypeError'), ('records', '')) v(extension, error)""",
    "dataset_contracts": """SELECT kind, true AS dataset, true AS loadable, kind <> 'TextFile' AS empty_loadable, true AS inspectable, CASE WHEN kind = 'TextFile' THEN 1 ELSE n END AS rows, CASE WHEN kind = 'TextFile' THEN -1 ELSE n END AS keys
FROM (SELECT count(*) AS n FROM benchmark), (VALUES ('ParquetDataset'), ('KeyedText'), ('KeyedJSON'), ('TextFile')) v(kind)""",
    "page_parts": """SELECT page_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS position, unnest(v) AS value FROM (SELECT page_id, regexp_extract_all(html, '="([^"]*)"', 1) AS v FROM pages)""",
    "event_steps": "SELECT event_id, user_id, coalesce(event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS step FROM events",
    "stream_sessions": f"""WITH {_LATE}, r AS (SELECT user_id, epoch_us(ts) AS t, CAST(value AS DECIMAL(18, 4)) AS value FROM a WHERE NOT late),
n AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 10800000000 THEN 0 ELSE 1 END AS new FROM r),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM n)
SELECT user_id, min(t) AS start, max(t) AS "end", count(*) AS rows, CAST(sum(value) AS DOUBLE) AS total FROM s GROUP BY user_id, k""",
    "stream_late_rows": f"WITH {_LATE} SELECT event_id, batch FROM a WHERE late",
    "keyed_text_tree": "SELECT 'p:' || CAST(page_id // 1000 AS VARCHAR) || '/' || page_id || ':%3A' AS key, url AS value FROM pages",
}


def queries() -> dict:
    return {n: globals()[n] for n in SQL}
