"""Tables that change together, and streams that settle."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.operators import parsing, versions
from lodestone.operators.versions import Change, Store, Table
from lodestone.streaming import jobs

TABLES = {"a": Table("k int, v string", ("k",)), "b": Table("k int, w int", ("k",))}


def rows(store, name):
    return sorted(tuple(r) for r in store.read(name).collect())


def df(spark, some, schema):
    return spark.createDataFrame(some, schema)


def test_changes_count_together_and_in_order(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), TABLES, most_changes=3)
    assert rows(store, "a") == [] and store.manifest()["version"] == 0
    assert store.apply({"a": Change(df(spark, [(1, "x"), (2, "y"), (2, "yy")], "k int, v string")), "b": Change(df(spark, [(1, 1)], "k int, w int"))})
    store.apply({"a": Change(df(spark, [(2, "z")], "k int, v string"), df(spark, [(1,)], "k int"))})
    assert rows(store, "a") == [(2, "z")] and rows(store, "b") == [(1, 1)]
    for k in range(5):  # beyond three changes the table is written anew
        store.apply({"a": Change(df(spark, [(k, f"n{k}")], "k int, v string"))})
    assert rows(store, "a") == [(k, f"n{k}") for k in range(5)]
    assert len(store.manifest()["parts"]["a"]) <= 3
    assert store.vacuum() > 0 and rows(store, "a") == [(k, f"n{k}") for k in range(5)]
    store.clear()
    assert rows(store, "a") == rows(store, "b") == []


def test_a_failure_between_the_writes_leaves_the_old_state(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), TABLES)
    store.apply({"a": Change(df(spark, [(1, "x")], "k int, v string")), "b": Change(df(spark, [(1, 1)], "k int, w int"))})
    broken = df(spark, [(2, 2)], "k int, w int").withColumn("w", F.raise_error(F.lit("stop")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        store.apply({"a": Change(df(spark, [(1, "new")], "k int, v string")), "b": Change(broken)})
    assert rows(store, "a") == [(1, "x")] and rows(store, "b") == [(1, 1)] and store.manifest()["version"] == 1


def test_two_writers_and_repeated_batches(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), TABLES)
    one = Change(df(spark, [(1, "x")], "k int, v string"))
    assert store.apply({"a": one}, stream="s", batch=0) and not store.apply({"a": one}, stream="s", batch=0)
    old = store.manifest()
    store.apply({"a": one}, stream="s", batch=1)
    monkeypatch.setattr(store, "manifest", lambda: old)
    with pytest.raises(RuntimeError):
        store.apply({"a": one})


def test_a_change_writes_what_it_changes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), TABLES)
    store.apply({"a": Change(spark.range(50_000).select(F.col("id").cast("int").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")))})
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "s").rglob("*.parquet"))
    before = size()
    store.apply({"a": Change(df(spark, [(7, "seven")], "k int, v string"))})
    assert size() - before < before / 100
    assert store.read("a").where("k = 7").first().v == "seven" and store.read("a").count() == 50_000


def index_of(spark, contents):
    sources = spark.createDataFrame([(p, "python", c) for p, c in contents.items()], "rel_path string, lang string, content string")
    files = sources.select("rel_path", "lang", F.octet_length("content").cast("long").alias("size"), F.lit(1).alias("lines"), F.sha2("content", 256).alias("checksum"))
    return files, parsing.code_chunks(sources)


def test_replaced_files_prune_orphans(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), versions.INDEX)
    versions.replace_files(store, *index_of(spark, {"a.py": "def f():\n    pass\n\ndef g():\n    return 1\n", "b.py": "def f():\n    pass\n"}), relations=spark.createDataFrame([("a.py", "b.py", "import")], "source string, target string, type string"))
    hashes = {r.symbol: r.content_hash for r in store.read("chunks").where("rel_path = 'a.py'").collect()}
    store.apply({"embeddings": Change(spark.createDataFrame([(h, [1.0]) for h in hashes.values()], "content_hash string, embedding array<float>"))})
    versions.replace_files(store, *index_of(spark, {"a.py": "def h():\n    pass\n"}))
    assert [(r.rel_path, r.symbol) for r in store.read("chunks").orderBy("rel_path").collect()] == [("a.py", "h"), ("b.py", "f")]
    assert [r.content_hash for r in store.read("embeddings").collect()] == [hashes["f"]]  # b.py still holds f
    files, chunks = index_of(spark, {"c.py": "x = 1\n"})
    versions.replace_files(store, files.limit(0), chunks.limit(0), removed=spark.createDataFrame([("b.py",)], "rel_path string"))
    assert rows(store, "embeddings") == rows(store, "relations") == [] and [r.rel_path for r in store.read("files").collect()] == ["a.py"]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


SCHEMA = "path string, op string, ts timestamp"


def feed(spark, folder, *events):
    rows_ = [(p, op, pd.Timestamp(ms, unit="ms").to_pydatetime()) for p, op, ms in events]
    spark.createDataFrame(rows_, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_events_settle(spark, rocks, tmp_path):
    """A burst counts once, a later event starts the time anew, and a restart keeps what is pending."""
    src, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        quiet = jobs.settled(stream, late="0 seconds")
        quiet.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination(180)
        return sorted((r.path, r.op, int(r.ts.timestamp() * 1000), r.events) for r in spark.read.parquet(out).collect())

    feed(spark, src, ("a", "create", 1000), ("a", "write", 1100), ("a", "write", 1150), ("b", "create", 1000))
    assert run() == []
    feed(spark, src, ("a", "write", 1300), ("c", "remove", 1250))  # a again within 200 ms; b is quiet by now
    feed(spark, src, ("z", "write", 1460))
    got = run()
    assert ("b", "create", 1000, 1) in got and all(p != "a" for p, *_ in got)
    feed(spark, src, ("z", "write", 9000))
    feed(spark, src, ("z", "write", 9100))  # Spark drops what is late by the batch before
    feed(spark, src, ("late", "write", 2000), ("z", "write", 9500))
    got = run()
    assert ("a", "write", 1300, 4) in got and ("c", "remove", 1250, 1) in got
    assert len([g for g in got if g[0] == "a"]) == 1 and all(p != "late" for p, *_ in got)


def test_watch_keeps_an_index(spark, tmp_path):
    texts = {"a.py": "def f():\n    pass\n", "b.py": "x = 1\n"}
    contents = lambda paths: paths.join(spark.createDataFrame(list(texts.items()), "rel_path string, content string"), "rel_path")
    src, check, store = str(tmp_path / "in"), str(tmp_path / "c"), Store(spark, str(tmp_path / "s"), versions.INDEX)

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        jobs.watch(stream, contents, store, check).awaitTermination(180)
        return {r.rel_path for r in store.read("files").collect()}, sorted(r.symbol for r in store.read("chunks").collect())

    feed(spark, src, ("a.py", "create", 1), ("b.py", "create", 1), ("gone.py", "create", 1))
    assert run() == ({"a.py", "b.py"}, ["b.py", "f"])
    texts["a.py"] = "def g():\n    pass\n\ndef h():\n    pass\n"
    feed(spark, src, ("a.py", "write", 2), ("b.py", "remove", 3))
    assert run() == ({"a.py"}, ["g", "h"])
