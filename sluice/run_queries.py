"""The registered queries of datasets, runs, records and streams, each with its SQL.

Those that tell of a run's folders, events or errors give them as a table of a few rows, with what the run made of its tables; the SQL counts that there.
"""

from __future__ import annotations

import json
import posixpath
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cli import make_cli
from .functions.keys import between, numbered
from .model import KEY, LeaseHeldError, MissingPriorOutputError, RecordError
from .operators import keyed
from .plans.pipeline import Branch, Pipeline, Stage, Step, graph, mermaid, snapshot, step
from .plans.records import Commits, Lease, Ownership, RunLog, production
from .plans.run import run
from .queries import _money, _orders_pipeline, _shared, read
from .sources.datasets import BinaryFile, JSONFile, KeyedBinary, KeyedJSON, KeyedText, Loader, ParquetDataset, Sources, TextFile, missing_or_extra
from .sources.files import Files
from .sources.publish import Log, SparkStore
from .streaming.batches import run_stream


def _items(spark: SparkSession, sf_dir: str, prefix: str = "") -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(numbered(prefix, F.col("item_id")).alias(KEY), F.col("text").alias("value"))


# --- datasets -------------------------------------------------------------------------------------------------------
def single_json_file(spark, sf_dir):
    """The totals of all orders as one JSON file, written and read back."""
    root, out = _shared(spark), JSONFile("totals", schema="count long, total double")
    totals = keyed.summary(read(spark, sf_dir, "orders"), total=_money("o_totalprice"))
    out.validate(totals)
    out.save(totals, root)
    return out.load_from(spark, root)


def single_text_file(spark, sf_dir):
    root, out = _shared(spark), TextFile("names")
    out.save(keyed.summary(read(spark, sf_dir, "nation").select(F.col("n_name").alias(KEY))).select(F.array_join("ids", "\n").alias("value")), root)
    return out.load_from(spark, root).select(F.explode(F.split("value", "\n")).alias("name"))


def single_binary_file(spark, sf_dir):
    """One binary of all items: how many, how many bytes, and the greatest of their digests."""
    root, out = _shared(spark), BinaryFile("all")
    facts = _items(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).alias("bytes"), F.max(F.sha2("value", 256)).alias("most"))
    out.save(facts.select(F.concat_ws(":", "n", "bytes", "most").cast("binary").alias("value")), root)
    return out.load_from(spark, root).select(F.sha2("value", 256).alias("sha256"), F.octet_length("value").cast("long").alias("bytes"))


def keyed_binary_files(spark, sf_dir):
    root, out = _shared(spark), KeyedBinary("items")
    data = _items(spark, sf_dir).select(KEY, F.col("value").cast("binary").alias("value"))
    out.validate(data)
    out.save(data, root)
    return out.load_from(spark, root).select(KEY, F.sha2("value", 256).alias("sha256"))


def keyed_hidden_names(spark, sf_dir):
    """Keys that file readers would take for hidden, or cannot take, written and read back."""
    root, out = _shared(spark), KeyedText("hidden")
    items = _items(spark, sf_dir)
    data = items.select(F.explode(F.array(*[F.concat(F.lit(p), KEY) for p in ("_", ".", "d/_e/", "~_", "a:b", "%3A")])).alias(KEY), "value")
    out.validate(data)
    out.save(data, root)
    return out.load_from(spark, root)


def physical_keys(spark, sf_dir):
    """The keys of the files that are there."""
    root, out = _shared(spark), KeyedJSON("regions", schema="r_name string")
    out.save(read(spark, sf_dir, "region").select(numbered("r/", F.col("r_regionkey")).alias(KEY), "r_name"), root)
    return out.keys_at(spark, root)


def key_set_difference(spark, sf_dir):
    """How many expected keys are not there, and how many are there unexpectedly."""
    root, out = _shared(spark), KeyedText("items")
    items = _items(spark, sf_dir)
    out.save(items, root)
    missing, extra = missing_or_extra(out.keys_at(spark, root), items.where(F.col(KEY).cast("long") % 3 != 0).unionByName(_items(spark, sf_dir, "x").limit(7)))
    return spark.createDataFrame([(missing, extra)], "missing long, extra long")


def dataset_as_source(spark, sf_dir):
    """Datasets with a path as the sources of a pipeline."""
    root = _shared(spark)
    suppliers = ParquetDataset("suppliers", path=f"{root}/suppliers")
    suppliers.save(read(spark, sf_dir, "supplier").select(numbered("s", F.col("s_suppkey")).alias(KEY), F.col("s_name").alias("name")), suppliers.path)
    regions = KeyedJSON("regions", path=f"{root}/regions", schema="name string")
    regions.save(read(spark, sf_dir, "region").select(numbered("r", F.col("r_regionkey")).alias(KEY), F.col("r_name").alias("name")), regions.path)

    def same(df, context):
        return df

    made = Pipeline("sources", Sources([suppliers, regions]), [Stage("all", [Step(same)])])
    return run(spark, made, root, keep_source=True).output


def dataset_descriptions(spark, sf_dir):
    """What a dataset of each kind tells of itself, without its options, and the rows that it holds, which come from whole tables."""
    root, items = _shared(spark), _items(spark, sf_dir)
    totals = read(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("count"))
    docs = read(spark, sf_dir, "documents").select(numbered("d", F.col("doc_id")).alias(KEY), "lang")
    nations = read(spark, sf_dir, "nation").select(numbered("n", F.col("n_nationkey")).alias(KEY), "n_name")
    held = [
        (ParquetDataset("documents", path=f"{root}/p", storage_options={"mergeSchema": "false"}), docs),
        (KeyedJSON("nations", path=f"{root}/j", schema="n_name string"), nations),
        (KeyedText("items", path=f"{root}/t", allow_empty=True), items),
        (KeyedBinary("bytes", path=f"{root}/b"), items.select(KEY, F.col("value").cast("binary").alias("value"))),
        (JSONFile("totals", path=f"{root}/f", schema="count long"), totals),
        (TextFile("number", path=f"{root}/g"), totals.select(F.col("count").cast("string").alias("value"))),
        (BinaryFile("raw", path=f"{root}/h"), totals.select(F.col("count").cast("string").cast("binary").alias("value"))),
    ]
    rows = []
    for out, data in held:
        out.save(data, out.path)
        rows.append((*(out.describe() | {"path": out.path.removeprefix(root)}).values(), out.load(spark).count()))
    return spark.createDataFrame(rows, "type string, name string, path string, allow_empty boolean, storage_options_configured boolean, rows long")


def sorted_key_table(spark, sf_dir):
    """Keys of any number with their places in ascending order."""
    return keyed.sorted_keys(read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias(KEY)))


def between_recurring_marks(spark, sf_dir):
    text = F.concat(F.lit("x<h1>"), F.col("page_id").cast("string"), F.lit("<h1>"), F.col("url"), F.lit("</h1></h1>"))
    return read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias(KEY), between(text, "<h1>", "</h1>").alias("title"))


# --- runs -----------------------------------------------------------------------------------------------------------
_REGION = "key string, r_name string"


def _regions(sf_dir: str, stages: list[Stage], name: str = "regions") -> Pipeline:
    return Pipeline(name, Loader("regions", lambda s: read(s, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias(KEY), "r_name")), stages)


def _languages(sf_dir: str, stages: list[Stage]) -> Pipeline:
    """A pipeline over all documents, with the language as the record."""
    return Pipeline("documents", Loader("documents", lambda s: read(s, sf_dir, "documents").select(F.col("doc_id").cast("string").alias(KEY), F.col("lang").alias("r_name"))), stages)


def _lower(df, context):
    return df.withColumn("r_name", F.lower("r_name"))


def _marked(df, context):
    return df.withColumn("r_name", F.concat("r_name", F.lit(context.params.get("mark", "."))))


def _two_steps(**more) -> list[Stage]:
    return [Stage("first", [Step(_lower, ParquetDataset(schema=_REGION), name="lower"), Step(_marked, ParquetDataset(schema=_REGION), name="mark")], **more)]


def step_selection(spark, sf_dir):
    """One step of a stage, from the committed output of the step before."""
    root, made = _shared(spark), _regions(sf_dir, _two_steps())
    commits = Commits(f"{root}/meta")
    run(spark, made, root, stage="first", step="lower", commits=commits)
    return run(spark, made, root, stage="first", step="mark", commits=commits, params={"mark": "!"}).output


def fail_closed_selection(spark, sf_dir):
    """Selections that cannot start, by the error each gives before any step runs, and one that can, by its rows; over documents."""
    root, made = _shared(spark), _languages(sf_dir, _two_steps())
    commits, clean = Commits(f"{root}/meta"), _languages(sf_dir, _two_steps(clean=True))
    attempts = [("no commits", made, {"stage": 1, "step": 2}), ("not run", made, {"stage": 1, "step": 2, "commits": commits}), ("no stage", made, {"stage": "none"})]
    attempts += [("step alone", made, {"step": 1}), ("clean", clean, {"stage": 1, "step": 2}), ("first", made, {"stage": 1, "step": 1, "commits": commits}), ("second", made, {"stage": 1, "step": 2, "commits": commits})]
    rows = []
    for what, pipeline, args in attempts:
        try:
            rows.append((what, "", run(spark, pipeline, root, **args).output.count()))
        except (MissingPriorOutputError, ValueError) as e:
            rows.append((what, type(e).__name__, 0))
    return spark.createDataFrame(rows, "selection string, error string, rows long")


def stage_clean(spark, sf_dir):
    """A stage that empties its folder keeps nothing of earlier runs; a stage root of its own stays; with the rows of each step's folder."""
    root, files = _shared(spark), Files(spark)
    at, own = f"{root}/documents/001_first", f"{root}/elsewhere"
    files.write_text(f"{at}/old/x.txt", "x")
    rows = []

    def look(place: str, folder: str) -> None:
        for name in files.children(folder):
            rows.append((place, name, 0 if name == "old" else spark.read.schema(_REGION).parquet(f"{folder}/{name}").count()))

    run(spark, _languages(sf_dir, _two_steps()), root)
    look("before", at)
    run(spark, _languages(sf_dir, _two_steps(clean=True)), root)
    run(spark, _languages(sf_dir, _two_steps(root=own)), root)
    look("after", at)
    look("elsewhere", own)
    return spark.createDataFrame(rows, "place string, folder string, rows long")


def rerun_replaces_output(spark, sf_dir):
    """Files of keys that a later run no longer has are gone."""
    root = _shared(spark)

    def some(df, context):
        return df.where(F.col(KEY).cast("int") < int(context.params["below"])).select(KEY, F.col("r_name").alias("value"))

    made = _regions(sf_dir, [Stage("files", [Step(some, KeyedText())])])
    for below in ("5", "2"):
        out = run(spark, made, root, params={"below": below}).output
    return out


def empty_route_rule(spark, sf_dir):
    """A route without records runs too, if its output may be empty."""

    def marked(df, context):
        return df.withColumn("r_name", F.concat("r_name", F.lit("?")))

    routes = {"all": [Step(_lower, ParquetDataset(schema=_REGION), name="lower")], "none": [Step(marked, ParquetDataset(schema=_REGION, allow_empty=True))], "pass": []}
    return run(spark, _regions(sf_dir, [Stage("s", [Branch("b", F.when(F.col(KEY) == "0", "pass").otherwise("all"), routes)])]), _shared(spark)).output


def declared_steps(spark, sf_dir):
    """Steps declared by a decorator, a bare function among them, one of them not persisted."""
    root = _shared(spark)

    @step(output=ParquetDataset(schema=_REGION), persist=False)
    def lower(df, context):
        return _lower(df, context)

    @step(output=KeyedText(), persist=True)
    def told(df, context):
        return df.select(KEY, F.concat(F.lit(f"{context.stage}/{context.step}/{context.persist}/"), "r_name").alias("value"))

    def plain(df, context):
        return df.withColumn("value", F.concat("value", F.lit(posixpath.basename(context.prior_dir or "none"))))

    return run(spark, _regions(sf_dir, [Stage("one", [lower, told]), Stage("two", [plain])]), root).output


@dataclass
class _Tenant:
    base: object
    tenant: str = "acme"


def context_factory(spark, sf_dir):
    """Steps that get a context of the caller's own."""

    def tagged(df, context):
        return keyed.with_context(df, tenant=context.tenant)

    made = _regions(sf_dir, [Stage("s", [Step(tagged, ParquetDataset())])])
    return run(spark, made, _shared(spark), context=_Tenant).output


def _by_language(spark: SparkSession, sf_dir: str) -> Pipeline:
    """A pipeline with a route for each language that documents have."""
    langs = [r["lang"] for r in read(spark, sf_dir, "documents").select("lang").distinct().orderBy("lang").collect()]  # the routes of a branch are few

    def whole(df, context):
        return df

    out = lambda: ParquetDataset(schema=_REGION)
    routes = {x: [Step(_lower, out(), name="lower")] for x in langs}
    return _languages(sf_dir, [Stage("first", [Step(whole, out())]), Stage("second", [Branch("by", F.col("r_name"), routes), Step(_marked, name="last", persist=False)])])


class _Counted:
    """An observer that keeps the rows that each step wrote."""

    def __init__(self):
        self.rows: dict[str, int] = {}

    def on_event(self, spark, event):
        if event["rows"] is not None:
            self.rows[event["node"]] = event["rows"]


def plan_graph(spark, sf_dir):
    """The nodes of a declaration: steps, fan-out, a route for each language of documents, merge; what each reads, and the rows each step wrote in a run."""
    made, counted = _by_language(spark, sf_dir), _Counted()
    assert json.loads(snapshot(made))["nodes"] == graph(made)
    run(spark, made, _shared(spark), observers=[counted])
    return spark.createDataFrame([(n["id"], n["kind"], n["name"], ",".join(n["inputs"]), counted.rows.get(n["id"], 0)) for n in graph(made)], "id string, kind string, name string, inputs string, rows long")


def plan_chart(spark, sf_dir):
    """The flow chart of a pipeline with a route for each language of documents, line by line."""
    chart = mermaid(_by_language(spark, sf_dir))
    return spark.createDataFrame([(k, line.strip()) for k, line in enumerate(chart.splitlines())], "line int, text string")


def command_line_run(spark, sf_dir):
    """A run from the command line, with a parameter."""
    root = _shared(spark)
    made = _regions(sf_dir, _two_steps())
    assert make_cli(made, session=lambda master: spark)(["--run-root", root, "--param", "mark=a=b"]) == 0
    return spark.read.parquet(f"{root}/regions/001_first/002_mark")


# --- records --------------------------------------------------------------------------------------------------------
def run_events(spark, sf_dir):
    """The events of a run over documents, as its observer keeps them, with the rows that each step wrote."""
    root = _shared(spark)
    done = run(spark, _languages(sf_dir, _two_steps()), root, observers=[RunLog(f"{root}/meta")])
    return spark.read.json(f"{root}/meta/events/{done.run_id}").select(F.col("sequence").cast("long").alias("sequence"), "kind", "node", "step", F.coalesce("rows", F.lit(0)).alias("rows"))


def run_evidence(spark, sf_dir):
    """What the events of a run that fails, and of one that does not, sum up to; both over documents."""
    root = _shared(spark)
    log, ids = RunLog(f"{root}/meta"), []

    def broken(df, context):
        ids.append(context.run_id)
        raise OSError(f"no disk for {df.count()} rows")

    ids.append(run(spark, _languages(sf_dir, _two_steps()), root, observers=[log]).run_id)
    try:
        run(spark, _languages(sf_dir, [Stage("s", [broken])]), root, observers=[log])
    except OSError as e:
        failed = str(e)
    told = [(log.summary(spark, i), why) for i, why in zip(ids, ("", failed), strict=True)]
    return spark.createDataFrame([(t["status"], t["events"], json.dumps(t["steps"], sort_keys=True), ",".join(t["errors"]), why) for t, why in told], "status string, events long, steps string, errors string, why string")


def commit_verdicts(spark, sf_dir):
    """Whether a selective run trusts the output of documents before it, and the rows it then gives: as it was, with other keys of the same number, with fewer rows, and without files."""
    root, made, files = _shared(spark), _languages(sf_dir, _two_steps()), Files(spark)
    commits, rows = Commits(f"{root}/meta"), []
    for change in ("none", "keys", "rows", "files"):
        run(spark, made, root, stage=1, step=1, commits=commits)
        at = f"{root}/documents/001_first/001_lower"
        old = spark.read.schema(_REGION).parquet(at)
        if change != "none":
            other = {"keys": old.withColumn(KEY, F.concat(F.lit("x"), KEY)), "rows": old.where(F.col(KEY) > "3"), "files": old}[change]
            other.write.parquet(f"{at}-other")
            files.delete(at)
            if change != "files":
                files.rename(f"{at}-other", at)
        try:
            rows.append((change, run(spark, made, root, stage=1, step=2, commits=commits).output.count()))
        except RecordError:
            rows.append((change, 0))
    return spark.createDataFrame(rows, "change string, rows long").withColumn("trusted", F.col("rows") > 0)


def ownership_prune(spark, sf_dir):
    """Folders of an earlier declaration go with the next full run over documents; others stay, with their rows."""
    root, files = _shared(spark), Files(spark)
    own = Ownership(f"{root}/meta")
    run(spark, _languages(sf_dir, _two_steps()), f"{root}/out", ownership=own)
    files.write_text(f"{root}/out/documents/foreign/x", "x")
    less = _languages(sf_dir, [Stage("first", [Step(_lower, ParquetDataset(schema=_REGION), name="lower")])])
    run(spark, less, f"{root}/out", ownership=own)
    left = [f"{a}/{b}" for a in files.children(f"{root}/out/documents") for b in files.children(f"{root}/out/documents/{a}")]
    kept = spark.read.schema(_REGION).parquet(f"{root}/out/documents/001_first/001_lower").count()
    return spark.createDataFrame([(x, kept if x.startswith("001") else 0) for x in left], "folder string, rows long")


def lease_and_guards(spark, sf_dir):
    """Guards in order and reverse, with the outcome; a second run while a lease is held; the profile of all records."""
    root, made, told = _shared(spark), _languages(sf_dir, _two_steps()), []

    class Guard:
        def __init__(self, name):
            self.name = name

        def enter(self, spark, pipeline, run_id):
            told.append(f"enter {self.name}")

        def exit(self, spark, pipeline, outcome):
            told.append(f"{outcome} {self.name}")

    done = run(spark, made, root, guards=[Guard("a"), Guard("b")], **production(f"{root}/meta"))
    told.append(f"{done.output.count()} rows")
    held = Lease(f"{root}/meta")
    held.enter(spark, made.name, "other")
    try:
        run(spark, made, root, guards=[Guard("c")], **production(f"{root}/meta"))
    except LeaseHeldError:
        told.append("held")
    held.exit(spark, made.name)
    try:
        run(spark, _languages(sf_dir, [Stage("s", [lambda df, context: 3])]), root, guards=[Guard("d"), Lease(f"{root}/meta")])
    except TypeError:
        told.append("no frame")
    return spark.createDataFrame(list(enumerate(told)), "number int, what string")


# --- streams --------------------------------------------------------------------------------------------------------
def stream_of_batches(spark, sf_dir):
    """A stream of events, each micro-batch a run of the pipeline."""
    root = _shared(spark)
    events = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias(KEY), "event_type", "value")
    events.write.parquet(f"{root}/in")

    def large(df, context):
        return df.where("value >= 10")

    made = Pipeline("events", Loader("none", lambda s: events.limit(0)), [Stage("s", [Step(large, ParquetDataset(allow_empty=True, schema=events.schema))])])
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    query = run_stream(stream, made, f"{root}/out", f"{root}/check")
    query.awaitTermination()
    rows = spark.read.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{root}/out")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def orders_profile(spark, sf_dir):
    """A full and then a selective run with commits, run log, ownership and lease from one call."""
    root, made = _shared(spark), _orders_pipeline(sf_dir)
    run(spark, made, root, **production(f"{root}/meta"))
    return run(spark, made, root, stage="summary", **production(f"{root}/meta")).output


def concurrent_appends(spark, sf_dir):
    """Four writers append their shares of all orders to one table at once, each as a folder that an entry of a log names; the table is what the log names."""
    root = _shared(spark)
    log, orders = Log(SparkStore(spark), f"{root}/log"), read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", _cents("o_totalprice").alias("cents"))

    def append(writer):
        folder = f"{root}/data/{writer}"
        orders.where(F.pmod("o_orderkey", F.lit(4)) == writer).withColumn("writer", F.lit(writer)).write.parquet(folder)
        return log.append({"folder": folder}, after=0)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(append, range(4)))
    rows = spark.read.parquet(*[e["folder"] for e in log.entries()])
    return rows.groupBy("writer").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("customers"), F.sum("cents").alias("cents"), F.lit(log.last()).alias("entries"))


def _cents(column: str):
    return (F.col(column).cast("decimal(18,2)") * 100).cast("long")


def _values(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) v({columns})"


_ITEMS = "SELECT CAST(item_id AS VARCHAR) AS key, text FROM benchmark"
_LOWER = "SELECT CAST(r_regionkey AS VARCHAR) AS key, lower(r_name)"
_DOCS = "(SELECT count(*) FROM documents)"
_TWO = f"('{{0}}', '001_lower', {_DOCS}), ('{{0}}', '002_mark', {_DOCS})"

SQL = {
    "single_json_file": "SELECT count(*) AS count, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders",
    "single_text_file": "SELECT n_name AS name FROM nation",
    "single_binary_file": "SELECT sha256(v) AS sha256, CAST(strlen(v) AS BIGINT) AS bytes FROM (SELECT count(*) || ':' || sum(strlen(text)) || ':' || max(sha256(text)) AS v FROM benchmark)",
    "keyed_binary_files": f"SELECT key, sha256(text) AS sha256 FROM ({_ITEMS})",
    "keyed_hidden_names": f"SELECT p || key AS key, text AS value FROM ({_ITEMS}), (VALUES ('_'), ('.'), ('d/_e/'), ('~_'), ('a:b'), ('%3A')) v(p)",
    "physical_keys": "SELECT 'r/' || r_regionkey AS key FROM region",
    "key_set_difference": "SELECT CAST(7 AS BIGINT) AS missing, count(*) FILTER (WHERE item_id % 3 = 0) AS extra FROM benchmark",
    "dataset_as_source": "SELECT 's' || s_suppkey AS key, s_name AS name, 'suppliers' AS __source__ FROM supplier UNION ALL SELECT 'r' || r_regionkey, r_name, 'regions' FROM region",
    "dataset_descriptions": "SELECT type, name, path, allow_empty, storage_options_configured, rows FROM (VALUES "
    "('ParquetDataset', 'documents', '/p', false, true, (SELECT count(*) FROM documents)), ('KeyedJSON', 'nations', '/j', false, false, (SELECT count(*) FROM nation)), "
    "('KeyedText', 'items', '/t', true, false, (SELECT count(*) FROM benchmark)), ('KeyedBinary', 'bytes', '/b', false, false, (SELECT count(*) FROM benchmark)), "
    "('JSONFile', 'totals', '/f', false, false, 1), ('TextFile', 'number', '/g', false, false, 1), ('BinaryFile', 'raw', '/h', false, false, 1)) v(type, name, path, allow_empty, storage_options_configured, rows)",
    "sorted_key_table": "SELECT key, row_number() OVER (ORDER BY key) - 1 AS position FROM (SELECT CAST(o_orderkey AS VARCHAR) AS key FROM orders)",
    "between_recurring_marks": "SELECT CAST(page_id AS VARCHAR) AS key, page_id || '<h1>' || url AS title FROM pages",
    "step_selection": f"{_LOWER} || '!' AS r_name FROM region",
    "fail_closed_selection": _values(
        "selection, error, rows",
        "('no commits', 'MissingPriorOutputError', 0)", "('not run', 'MissingPriorOutputError', 0)", "('no stage', 'ValueError', 0)", "('step alone', 'ValueError', 0)", "('clean', 'ValueError', 0)",
        f"('first', '', {_DOCS})", f"('second', '', {_DOCS})",
    ),
    "stage_clean": _values("place, folder, rows", _TWO.format("before"), "('before', 'old', 0)", _TWO.format("after"), _TWO.format("elsewhere")),
    "rerun_replaces_output": "SELECT CAST(r_regionkey AS VARCHAR) AS key, r_name AS value FROM region WHERE r_regionkey < 2",
    "empty_route_rule": "SELECT CAST(r_regionkey AS VARCHAR) AS key, CASE WHEN r_regionkey = 0 THEN r_name ELSE lower(r_name) END AS r_name FROM region",
    "declared_steps": "SELECT CAST(r_regionkey AS VARCHAR) AS key, 'one/told/True/' || lower(r_name) || '002_told' AS value FROM region",
    "context_factory": "SELECT CAST(r_regionkey AS VARCHAR) AS key, r_name, 'acme' AS tenant FROM region",
    "plan_graph": f"""WITH l AS (SELECT lang, 's002-e001-r' || lpad(CAST(row_number() OVER (ORDER BY lang) AS VARCHAR), 3, '0') || '-001' AS id, count(*) AS n FROM documents GROUP BY lang)
SELECT 's001-e001' AS id, 'step' AS kind, 'whole' AS name, 'source' AS inputs, {_DOCS} AS rows UNION ALL SELECT 's002-e001-fan', 'fan_out', 'by', 's001-e001', 0
UNION ALL SELECT id, 'route_step', 'lower', 's002-e001-fan:' || lang, n FROM l
UNION ALL SELECT 's002-e001-merge', 'merge', 'by', (SELECT string_agg(id, ',' ORDER BY id) FROM l), 0 UNION ALL SELECT 's002-e002', 'step', 'last', 's002-e001-merge', 0""",
    "plan_chart": """WITH l AS (SELECT lang, row_number() OVER (ORDER BY lang) AS n FROM documents GROUP BY lang), k AS (SELECT count(*) AS k FROM l)
SELECT CAST(line AS INTEGER) AS line, text FROM (SELECT * FROM (VALUES (0, 'flowchart TD'), (1, 'source["documents"]'), (2, 'subgraph stage1["first"]'), (3, 's1e1["whole"]'), (4, 'end'),
(5, 'source --> s1e1'), (6, 'subgraph stage2["second"]'), (7, 's2e1{"by"}'), (8, 's2e1m(("merge"))'), (9, 's2e2["last (not persisted)"]'), (10, 'end'), (11, 's1e1 --> s2e1')) v(line, text)
UNION ALL SELECT 11 + n, 's2e1 -- "' || lang || '" --> s2e1m' FROM l UNION ALL SELECT 12 + k, 's2e1m --> s2e2' FROM k)""",
    "command_line_run": f"{_LOWER} || 'a=b' AS r_name FROM region",
    "run_events": _values(
        "sequence, kind, node, step, rows",
        "(CAST(1 AS BIGINT), 'run_started', NULL, NULL, 0)", "(2, 'node_started', 's001-e001', 'lower', 0)", f"(3, 'node_completed', 's001-e001', 'lower', {_DOCS})",
        "(4, 'node_started', 's001-e002', 'mark', 0)", f"(5, 'node_completed', 's001-e002', 'mark', {_DOCS})", "(6, 'run_completed', NULL, NULL, 0)",
    ),
    "run_evidence": _values(
        "status, events, steps, errors, why",
        "('completed', CAST(6 AS BIGINT), '{\"s001-e001\": \"completed\", \"s001-e002\": \"completed\"}', '', '')", f"('failed', 4, '{{\"s001-e001\": \"failed\"}}', 'OSError', 'no disk for ' || {_DOCS} || ' rows')",
    ),
    "commit_verdicts": _values("change, rows, trusted", f"('none', {_DOCS}, true)", "('keys', 0, false)", "('rows', 0, false)", "('files', 0, false)"),
    "ownership_prune": _values("folder, rows", f"('001_first/001_lower', {_DOCS})", "('foreign/x', 0)"),
    "lease_and_guards": _values("number, what", *[f"({k}, {w})" for k, w in enumerate(["'enter a'", "'enter b'", "'completed b'", "'completed a'", f"{_DOCS} || ' rows'", "'held'", "'enter d'", "'failed d'", "'no frame'"])]),
    "stream_of_batches": "SELECT event_type, count(*) AS n FROM events WHERE value >= 10 GROUP BY 1",
    "concurrent_appends": "SELECT CAST(o_orderkey % 4 AS INTEGER) AS writer, count(*) AS n, count(DISTINCT o_custkey) AS customers, CAST(sum(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) * 100 AS BIGINT)) AS BIGINT) AS cents, 4 AS entries FROM orders GROUP BY 1",
    "orders_profile": "SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice * 2 AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders WHERE o_totalprice >= 1000 GROUP BY 1",
}


def queries() -> dict:
    return {n: globals()[n] for n in SQL}
