import pytest

from sluice.model import EmptyOutputError, InvalidKeyError, KeyCollisionError
from sluice.sources.datasets import BinaryFile, JSONFile, KeyedBinary, KeyedJSON, KeyedText, Loader, ParquetDataset, Sources, TextFile, missing_or_extra
from sluice.sources.files import Files


@pytest.mark.parametrize("kind", ["json", "text", "binary"])
def test_keyed_round_trip(spark, tmp_path, kind):
    dest = f"{tmp_path}/001_out"
    if kind == "json":
        data, out = spark.createDataFrame([("a", 1, None), ("de/b", 2, "ü")], "key string, n long, t string"), KeyedJSON(schema="n long, t string")
    elif kind == "text":
        data, out = spark.createDataFrame([("a", "x\ny"), ("de/b", "ü")], "key string, value string"), KeyedText(suffix=".html")
    else:
        data, out = spark.createDataFrame([("a", bytearray(b"\x00\xff")), ("de/b", bytearray(b""))], "key string, value binary"), KeyedBinary()
    assert out.validate(data) == 2 and not out.exists(spark, dest)
    out.save(data, dest)
    assert out.exists(spark, dest)
    assert sorted(map(tuple, out.load_from(spark, dest).collect())) == sorted(map(tuple, data.collect()))
    assert Files(spark).walk(dest, out.suffix) == [f"a{out.suffix}", f"de/b{out.suffix}"]
    assert missing_or_extra(out.keys_at(spark, dest), data) == (0, 0)
    assert missing_or_extra(out.keys_at(spark, dest), data.where("key = 'a'")) == (0, 1)


@pytest.mark.parametrize("suffix", [".txt", ""])
def test_keys_that_look_hidden_are_read_back(spark, tmp_path, suffix):
    keys = ["_x", ".a", "en/_x", "_d/.e/f", "~_x", "~~x", "x~", "a._COPYING_", "a._COPYING_~", "._COPYING_/b", "~._COPYING_", "_k=1", "a/b~/_", "plain"]
    data, out, dest = spark.createDataFrame([(k, "" if k == "en/_x" else f"of {k}") for k in keys], "key string, value string"), KeyedText(suffix=suffix), f"{tmp_path}/out"
    assert out.validate(data) == len(keys)
    out.save(data, dest)
    assert sorted(map(tuple, out.load_from(spark, dest).collect())) == sorted(map(tuple, data.collect()))
    assert missing_or_extra(out.keys_at(spark, dest), data) == (0, 0) and out.keys_at(spark, dest).count() == len(keys)


def test_single_files_with_hidden_names(spark, tmp_path):
    data, dest = spark.createDataFrame([("hi",)], "value string"), f"{tmp_path}/_out"
    TextFile().save(data, dest)
    assert TextFile().exists(spark, dest) and TextFile().load_from(spark, dest).collect() == data.collect()


def test_single_files(spark, tmp_path):
    for out, data in (
        (JSONFile(schema="n long"), spark.createDataFrame([(3,)], "n long")),
        (TextFile(), spark.createDataFrame([("hi",)], "value string")),
        (BinaryFile(), spark.createDataFrame([(bytearray(b"\x01"),)], "value binary")),
    ):
        dest = f"{tmp_path}/{type(out).__name__}"
        out.save(data, dest)
        assert out.exists(spark, dest) and out.load_from(spark, dest).collect() == data.collect()
        with pytest.raises(InvalidKeyError):
            out.validate(data.union(data))
        with pytest.raises(FileNotFoundError):
            out.load_from(spark, f"{tmp_path}/none")


def test_validation_and_empty_output(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y")], "key string, value string")
    with pytest.raises(KeyCollisionError):
        KeyedText().validate(df)
    with pytest.raises(EmptyOutputError):
        ParquetDataset().validate(df.limit(0))
    assert ParquetDataset(allow_empty=True).validate(df.limit(0)) == 0
    assert ParquetDataset(allow_empty=True, schema="key string").committed_empty(spark).count() == 0
    with pytest.raises(EmptyOutputError):
        ParquetDataset(schema="key string").committed_empty(spark)


def test_description_hides_options():
    text = str(ParquetDataset("x", storage_options={"token": "s3cret"}).describe()) + repr(ParquetDataset("x", storage_options={"token": "s3cret"}))
    assert "s3cret" not in text and "'storage_options_configured': True" in text


def test_loaders(spark):
    one = Loader("one", lambda s: s.createDataFrame([("a",)], "key string"))
    two = Loader("two", lambda s: s.createDataFrame([("b",)], "key string"))
    assert {r["__source__"] for r in Sources([one, two]).load(spark).collect()} == {"one", "two"}
    with pytest.raises(KeyCollisionError):
        Sources([one, Loader("again", one.fn)]).load(spark)
    with pytest.raises(TypeError):
        Loader("bad", lambda s: s.range(3)).load(spark)
    with pytest.raises(FileNotFoundError):
        ParquetDataset("x").load(spark)


def test_stores_of_keyed_writes():
    from pyarrow import fs

    from sluice.sources.datasets import _store

    store, root = _store("s3a://bucket/a/b", {"fs.s3a.access.key": "k", "fs.s3a.secret.key": "s", "fs.s3a.endpoint.region": "eu-west-1"})
    assert isinstance(store, fs.S3FileSystem) and root == "bucket/a/b" and store.region == "eu-west-1"
    assert _store("file:///tmp/x", None)[1] == "/tmp/x" and _store("/tmp/x", None)[1] == "/tmp/x"
    if hasattr(fs, "AzureFileSystem"):
        assert _store("abfss://box@acct.dfs.core.windows.net/a", {"fs.azure.account.key.acct.dfs.core.windows.net": "a2V5"})[1] == "box/a"


@pytest.mark.parametrize("suffix", [".txt", ""])
def test_keys_that_hadoop_cannot_name_are_read_back(spark, tmp_path, suffix):
    keys = ["a:b", "%3A", "%25", "%253A", "x%2:y", "%:", "d:e/:f", "_:g", "100%", "a b", "ü?*[]{}#"]
    data, out, dest = spark.createDataFrame([(k, f"of {k}") for k in keys], "key string, value string"), KeyedText(suffix=suffix), f"{tmp_path}/out"
    out.save(data, dest)
    assert sorted(map(tuple, out.load_from(spark, dest).collect())) == sorted(map(tuple, data.collect()))
    assert sorted(r["key"] for r in out.keys_at(spark, dest).collect()) == sorted(keys)
    assert all(":" not in p for p in Files(spark).walk(dest))


def test_a_hundred_thousand_keys_without_a_name_on_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Files, "walk", lambda *a, **k: (_ for _ in ()).throw(AssertionError("names on the driver")))
    data, out, dest = spark.range(100_000).selectExpr("concat(id % 700, '/', id) AS key", "cast(id as string) AS value"), KeyedText(), f"{tmp_path}/many"
    out.save(data, dest)
    got = out.load_from(spark, dest)
    assert got.count() == 100_000 and got.where("value <> split(key, '/')[1]").isEmpty() and got.select("key").distinct().count() == 100_000
    assert missing_or_extra(out.keys_at(spark, dest), data) == (0, 0)
    assert out.exists(spark, dest)


def test_a_failed_write_leaves_an_own_folder_empty(spark, tmp_path):
    from pyspark.sql import functions as F

    bad = spark.range(40).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") < 39, "x").otherwise(F.raise_error(F.lit("stop"))).alias("value")).coalesce(1)
    with pytest.raises(Exception, match="stop"):
        KeyedText().save(bad, f"{tmp_path}/own")
    assert not Files(spark).any(f"{tmp_path}/own")
    Files(spark).write_text(f"{tmp_path}/shared/kept.txt", "x")
    with pytest.raises(Exception, match="stop"):
        KeyedText().save(bad, f"{tmp_path}/shared")
    assert Files(spark).is_file(f"{tmp_path}/shared/kept.txt")


def test_options_of_stores_are_all_known():
    from sluice.sources.keyed_files import store_of

    with pytest.raises(ValueError, match="fs.s3a.other") as told:
        store_of("s3a://bucket/a", {"fs.s3a.access.key": "s3cret", "fs.s3a.other": "s3cret"})
    assert "s3cret" not in str(told.value)
    with pytest.raises(ValueError, match="token"):
        store_of("/tmp/x", {"token": "s3cret"})
    account = "acct.dfs.core.windows.net"
    assert store_of(f"abfss://box@{account}/a", {f"fs.azure.sas.fixed.token.{account}": "sv=1&sig=a"})[1] == "box/a"
    client = {f"fs.azure.account.oauth2.client.{k}.{account}": v for k, v in (("id", "i"), ("secret", "s"), ("endpoint", "https://login.microsoftonline.com/tenant/oauth2/token"))}
    assert store_of(f"abfss://box@{account}/a", client)[1] == "box/a"
