"""Parsers, sources, streams, the facade and rules that change results."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.api import Engine
from lodestone.functions import paths as P
from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators import audit, bundles, gates, index, parsing, search, versions
from lodestone.sources import files
from lodestone.streaming import jobs

TS = """// Copyright 2020
import { a } from './util'
const b = require("fs")
export class Cart {
  total = 0;
  add(item) { if (item) { this.total += 1; } }
  get size() { return "}"; }
  load = async () => { return 1; }
}
export function checkout(cart) {
  return cart.total;
}
"""
PY = """import os
from sys import path

class Store:
    def get(self, k):
        def inner():
            pass
        return k

def main():
    return Store()
"""
GO = 'package x\n\nimport (\n\t"fmt"\n)\n\nconst (\n\tA = 1\n\tB, C = 2, 3\n)\n\nfunc (s *S) Run() {\n\tfmt.Println("}")\n}\n'


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_symbols():
    assert [(n, k) for n, k, _ in parsing.symbols_of("typescript", TS)] == [("checkout", "export_func"), ("Cart", "export_class"), ("Cart.add", "method"), ("Cart.size", "get"), ("Cart.load", "method")]
    assert parsing.imports_of("typescript", TS) == ["./util", "fs"]
    assert parsing.symbols_of("python", PY) == [("Store", "class", 4), ("Store.get", "method", 5), ("main", "func", 10)]
    assert parsing.imports_of("python", PY) == ["os", "sys"]
    assert [n for n, _, _ in parsing.symbols_of("go", GO)] == ["Run", "A", "B", "C"]
    assert parsing.imports_of("go", GO) == ["fmt"]
    assert parsing.symbols_of(None, "x") == [] and parsing.symbols_of("python", "") == []


@pytest.mark.parametrize("lang,code,name", [("rust", "pub fn go() {}\nstruct A {}\n", "go"), ("cpp", "class A {};\nint add(int a) {\n}\n", "A"), ("java", "public class A {\n  public int add(int a) { return a; }\n}\n", "A"), ("ruby", "class A\n  def go\n  end\nend\n", "A"), ("markdown", "# One\n\n## Two\n", "One")])
def test_other_languages(lang, code, name):
    assert parsing.symbols_of(lang, code)[0][0] == name


def test_chunks():
    spans = lambda lang, text: [(c.kind, c.symbol, c.start, c.end) for c in parsing.chunks_of(lang, "a/f", text)]
    assert spans("python", PY) == [("class", "Store", 4, 4), ("method", "Store.get", 5, 8), ("func", "main", 10, 11)]
    assert ("export_func", "checkout", 10, 12) in spans("typescript", TS)
    assert spans("json", "{}") == [("file", "f", 1, 1)]
    assert parsing.compress("typescript", TS).startswith("import")
    assert parsing.compress("json", '{"a": 1}') == '{"a":1}'
    assert parsing.without_comments("go", 'a := "//x" // y\n') == 'a := "//x" \n'


def test_terms(spark):
    assert one(spark, T.tokenise(F.lit("How does MCPServerG2Budget_foo work in the HTTPClient?"))) == ["mcpserverg2budget_foo", "mcp", "server", "budget", "foo", "work", "httpclient", "http", "client"]
    assert [one(spark, T.stem(F.lit(w))) for w in ("queries", "classes", "class", "parsing", "ranked", "security", "año")] == ["query", "class", "class", "pars", "rank", "secur", "año"]
    assert one(spark, T.token_estimate(F.lit("año"))) == 1
    assert one(spark, T.token_estimate(F.lit("años!"))) == 2


def test_double_penalty_and_floor(spark):
    rows = spark.createDataFrame([(10.0,), (-1.0,)], "s double").select(search.twice_kept(F.col("s"), 0.72).alias("x"), search.twice_kept(F.col("s"), 0.3).alias("y")).collect()
    assert round(rows[0].x, 9) == 4.4 and rows[0].y == 0 and rows[1].x == 0


def test_citations_truncate(spark):
    assert one(spark, T.citations(F.lit("see package.json:3 and a/b.tsx:12"))) == ["package.js", "a/b.ts"]


def test_greedy_skips_and_goes_on(spark):
    hits = spark.createDataFrame([(1, k, "f", n, 1.0) for k, n in enumerate((50, 60, 30, 40), 1)], "query_id long, rank int, rel_path string, tokens int, score double")
    assert [r.tokens for r in bundles.pack_greedy(hits, 100, reserve=0).orderBy("rank").collect()] == [50, 30]


def test_fact_needs_word_boundaries(spark):
    answers = spark.createDataFrame([(1, "the scoreFile2 and ñscore (x.y) here")], "answer_id long, text string")
    facts = spark.createDataFrame([(1, "scoreFile"), (1, "score"), (1, "(x.y)"), (1, " ")], "answer_id long, fact string")
    r = audit.fact_recall(answers, facts).first()
    assert (r.hits, r.n_facts) == (2, 3)
    assert audit.fact_recall(answers, facts.limit(0)).first().recall == 1.0


def test_overloads_collapse_to_the_largest(spark):
    rows = [(1, "a.ts", 1, "f", "function", 10, 9.0), (1, "a.ts", 2, "f", "function", 10, 8.0), (1, "a.ts", 3, "f", "function", 400, 7.0), (1, "b.ts", 1, "g", "function", 5, 8.5)]
    scored = spark.createDataFrame(rows, "query_id long, rel_path string, start_line int, symbol string, kind string, token_estimate int, score double")
    assert [(r.rel_path, r.start_line, r.score) for r in search.finish(scored).orderBy("rank").collect()] == [("a.ts", 3, 9.0), ("b.ts", 1, 8.5)]


def test_paths(spark):
    path = lambda f, p: one(spark, f(F.lit(p)))
    assert path(P.skipped, "x/node_modules/a.js") and path(P.skipped, "audit/a.md") and not path(P.skipped, "x/audit/a.go")
    assert path(P.skipped, "cfg/secrets.prod.yaml") and not path(P.skipped, "secrets.go") and path(P.skipped, ".env") and not path(P.skipped, ".notes.md")
    assert path(P.is_root_doc, "README.md") and not path(P.is_root_doc, "a/README.md")
    assert path(P.language, "a/b.tsx") == "typescript" and path(P.language, "a/b.min.js") is None
    assert path(index.normal_path, "a/./b/../c") == "a/c"


def test_vectors(spark):
    e = V.mock_embedding()
    assert abs(one(spark, V.dot(e(F.lit("x")), e(F.lit("x")))) - 1) < 1e-5
    assert one(spark, V.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0
    assert one(spark, V.decode_embedding()(V.encode_embedding()(F.array(F.lit(1.5), F.lit(-2.0)).cast("array<float>")))) == [1.5, -2.0]


def test_tuner_climbs():
    best, score = gates.coordinate_descent({"a": 0.0, "b": 8.0}, lambda tries: [(-abs(t["a"] - 4) - abs(t["b"] - 10),) for t in tries])
    assert best["a"] == 4.0 and score[0] > -1


def test_baseline_ignores_new_questions(spark):
    f = lambda rows: spark.createDataFrame(rows, "question string, recall double")
    assert [r.question for r in gates.regressions(f([("a", 0.5), ("b", 0.9), ("new", 0.1)]), f([("a", 0.9), ("b", 0.92)])).collect()] == ["a"]


@pytest.fixture
def tree(tmp_path):
    for name, content in {"src/cart.ts": TS, "src/util.ts": "export const a = 1;\n", "store.py": PY, "node_modules/x.js": "x", "README.md": "# Shop\n\nA cart.\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    return str(tmp_path)


def test_facade(spark, tree):
    engine = Engine.open(spark, tree)
    assert {r.rel_path for r in engine.files.collect()} == {"src/cart.ts", "src/util.ts", "store.py", "README.md"}
    q = engine.questions("where is the checkout of the cart?")
    hits = engine.search(q).orderBy("rank").collect()
    assert hits[0].rel_path == "src/cart.ts"
    assert [r.rel_path for r in engine.rank(q).orderBy("rank").limit(2).collect()] == ["README.md", "src/cart.ts"]
    assert "checkout" in engine.prompt(q).first().prompt
    r = {r.query_id: r for r in engine.context(engine.questions("where is the checkout of the cart?", "give an overview", "zzzz qqqq")).collect()}
    assert (r[0].route, r[0].rel_path) == ("excerpt", "src/cart.ts") and "function checkout(cart)" in r[0].text
    assert (r[1].route, r[1].text) == ("outline", "") and (r[2].route, r[2].text) == ("search", "")
    assert [tuple(r) for r in engine.relations().collect()] == [("src/cart.ts", "src/util.ts")]
    assert engine.expand("store.py:10-11").first().content.startswith("def main")
    answers = spark.createDataFrame([(0, "see src/cart.ts:10 and nowhere.py; checkoutTotal()")], "answer_id long, text string")
    r = engine.audit(q, answers).first()
    assert r.grounded_ratio == 0.5 and r.unknown == 1
    assert engine.outline("store.py").count() == 3 and engine.stats().count() == 3


def test_json_sources(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"a": 1}\nbroken\n\n{"a": 2}\n')
    assert sorted(r.a for r in files.read_jsonl(spark, str(p), "a int").collect()) == [1, 2]
    assert files.read_jsonl(spark, str(tmp_path / "none"), "a int").count() == 0
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl_strict(spark, str(p), "a int").collect()
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.json").write_text('{\n "q": "a"\n}')
    assert [tuple(r) for r in files.read_documents(spark, str(tmp_path / "d"), "q string").collect()] == [("a", "x")]
    m = spark.createDataFrame([("package.json", json.dumps({"name": "n", "main": "./a.js", "bin": {"x": "b.js"}, "dependencies": {"d": "1"}}))], "rel_path string, content string")
    r = files.manifest(m).first()
    assert (r.entry_points, r.dependencies) == (["a.js", "b.js"], ["d"])
    lines = spark.createDataFrame([(' M src/a.go',), ('R  old.go -> new.go',), ('?? "b c.go"',)], "line string")
    assert {r.rel_path for r in files.porcelain(lines).collect()} == {"src/a.go", "new.go", "b c.go"}


def test_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    src = str(tmp_path / "events")
    events.select("event_id", "ts", "user_id", "event_type", "value", "props").repartition(3).write.parquet(src)
    q = jobs.run_once(jobs.rolling_usage(jobs.ledger_stream(spark, src)), "usage", str(tmp_path / "c1"), "complete")
    q.awaitTermination(120)
    assert spark.table("usage").agg(F.sum("n")).first()[0] == 4 * events.count()
    q = jobs.run_once(jobs.first_seen(jobs.ledger_stream(spark, src)), "once", str(tmp_path / "c2"))
    q.awaitTermination(120)
    assert spark.table("once").count() == events.count()


def test_index_stream(spark, tmp_path):
    src, store = str(tmp_path / "in"), versions.Store(spark, str(tmp_path / "store"), versions.INDEX)
    batch = lambda rows: spark.createDataFrame(rows, "rel_path string, content string").coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema("rel_path string, content string").option("maxFilesPerTrigger", 1).parquet(src)
    batch([("a.py", "x = 1\n"), ("b.py", "y\n")])
    jobs.index_stream(stream(), store, str(tmp_path / "c")).awaitTermination(120)
    batch([("a.py", "x = 2\nz\n")])
    jobs.index_stream(stream(), store, str(tmp_path / "c")).awaitTermination(120)
    assert {r.rel_path: r.lines for r in store.read("files").collect()} == {"a.py": 2, "b.py": 1}


def test_suffix_relations_of_many_paths_come_once(spark):
    imports = spark.createDataFrame([("s1", "a/b"), ("s1", "b"), ("s1", "x/b"), ("s2", "a/b"), ("s2", None), ("b", "c")], "source string, import string")
    dirs = spark.createDataFrame([("t1", "b"), ("t1", "z/a/b"), ("b", "b"), ("t3", "c/b"), ("t4", None), ("t5", "q")], "target string, dir string")
    ends = lambda a, b: a == b or a.endswith("/" + b) or b.endswith("/" + a)
    want = {(s, t) for s, i in imports.collect() for t, d in dirs.collect() if i and d and ends(i, d) and s != t}
    for piece in (1, 4096):
        got = index.suffix_relations(imports, dirs, piece)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
        # Pairs stay where they are spelled out: nothing is made distinct after the last list is opened.
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan[: plan.index("Generate explode")]


def test_a_search_makes_and_parses_its_files_once(spark, sf_dir, monkeypatch):
    from lodestone.plans import full_search
    from lodestone.plans.registry import Tables

    made = []
    monkeypatch.setattr(full_search, "kept", lambda df: made.append(df.columns) or df.localCheckpoint())
    files, _ = full_search._chunks(Tables(spark, sf_dir))
    assert made[0] == ["rel_path", "lang", "content"]
    assert "regexp_replace" not in parsing.parse(files)._jdf.queryExecution().optimizedPlan().toString()
