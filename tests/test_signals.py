"""Signals, stores and views on small fixtures."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import paths as P
from lodestone.operators import chunk_search, search, signals, stores, views


def ignored(spark, patterns, *paths):
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    return [r.i for r in df.select(P.ignored(F.col("p"), patterns).alias("i")).collect()]


def test_ignore_files(spark):
    assert P.ignore_patterns("# x\n\n a/ \nb*\n") == ["a/", "b*"]
    assert ignored(spark, ["build/"], "build/x.py", "src/build/x.py", "build", "builds/x.py") == [True, True, False, False]
    assert ignored(spark, ["*_backup"], "a_backup", "d_backup/x", "a_backup.py") == [True, True, False]
    assert ignored(spark, ["/docs"], "docs/a.md", "src/docs/a.md") == [True, False]
    assert ignored(spark, ["/docs/a.md"], "docs/a.md", "src/docs/a.md") == [True, False]
    assert ignored(spark, ["api/v1"], "src/api/v1/x.py", "xapi/v1/api/v1/x.py") == [True, True]
    assert ignored(spark, [], "x") == [False]


def test_ranker_takes_bonuses_and_keeps_the_first_files(spark):
    files = spark.createDataFrame([(f"src/f{k}.go", "go") for k in range(30)] + [("readme.md", "markdown"), ("src/parser_test.go", "go"), ("src/parser.go", "go")], "rel_path string, lang string")
    asked = spark.createDataFrame([(1, "parser of things"), (2, "tests of the parser")], "query_id long, text string")
    bonuses = spark.createDataFrame([(1, "src/f9.go", 5.0)], "query_id long, rel_path string, points double")
    whole = search.rank_files(files, asked, bonuses=bonuses)
    some = {tuple(r) for r in search.rank_files(files, asked, bonuses=bonuses, top=4).collect()}
    assert some == {tuple(r) for r in whole.where("rank <= 4").collect()}
    assert whole.where("query_id = 1 and rank = 1").first().rel_path == "src/f9.go"


def test_structure_reaches_every_chunk_of_a_file(spark):
    rows = [("a.go", 0, 1, 8, "run", "func", "nothing here", 50), ("a.go", 1, 9, 12, "stop", "func", "neither", 50), ("b.go", 0, 1, 2, "other", "func", "neither", 50)]
    chunks = spark.createDataFrame(rows, "rel_path string, pos int, start_line int, end_line int, symbol string, kind string, content string, token_estimate int")
    asked = spark.createDataFrame([(1, "scheduler")], "query_id long, text string")
    symbols = spark.createDataFrame([("a.go", "Scheduler"), ("a.go", "newScheduler")], "rel_path string, name string")
    imports = spark.createDataFrame([("a.go", f"pkg/scheduler/{k}") for k in range(8)], "rel_path string, imp string")
    got = {(r.rel_path, r.start_line): r.score for r in chunk_search.chunk_search(chunks, asked, symbols=symbols, imports=imports).collect()}
    assert got == {("a.go", 1): 28.0, ("a.go", 9): 28.0}


def test_stores(spark, tmp_path):
    weights = spark.createDataFrame([("a", 70.0), ("b", -1.0), ("c", None), ("d", float("nan"))], "name string, value double")
    assert {tuple(r) for r in stores.kept_weights(weights).collect()} == {("a", 60.0), ("b", 0.0)}
    stores.replace_table(weights, f"{tmp_path}/w")
    stores.clear({"w": weights}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/w").count() == 0
    assert stores.metadata_value(spark.createDataFrame([("k", "v")], "key string, value string"), "x").count() == 0


def test_views(spark):
    with pytest.raises(ValueError):
        views.files_only(None, -1)
    with pytest.raises(ValueError):
        views.export(None, "pdf")
    hints = signals.structural_hints(spark.createDataFrame([("a", "get_user"), ("b", "x")], "rel_path string, name string"), spark.createDataFrame([], "rel_path string, imp string"), spark.createDataFrame([(1, "getuser")], "query_id long, term string"), limit=0)
    assert [tuple(r) for r in hints.collect()] == [(1, 1, "a", 18.0, 1, 0)]
