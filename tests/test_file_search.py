"""The search over whole files against the one over a table of pairs."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.operators import chunk_search, file_search, parsing, tuning
from lodestone.operators.search import SearchWeights

TRIES = [SearchWeights(), SearchWeights(symbol_match=0.0, content=12.0, graph=30.0, tiny_keep=0.3, long_penalty_max=1.0, working_set=40.0, test_keep=0.5, impl_kind=9.0, legacy_keep=0.6)]


@pytest.fixture(scope="module")
def given(spark):
    rng = random.Random(11)
    words = ["parser", "parsing", "token", "stream", "cache", "index", "graph", "merges", "store", "flies", "ab"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for k in range(90):
        a, b, c = (rng.choice(words) for _ in range(3))
        folder = rng.choice(["src", "lib", "tests", "legacy", "graph"])
        # Long and short, many of them alike, so that scores are equal and only the path tells.
        n = rng.choice([2, 2, 2, 40, 500])
        one = rng.randrange(3)
        if one == 0:
            rows.append((f"{folder}/{a}{k}.py", "python", f"import {b}_lib\nclass {a}_x:\n    def {c}(self):\n        return '{text(n)}'\n\ndef {b}Two(x):\n    return x\n"))
        elif one == 1:
            rows.append((f"{folder}/{b}_{k}.go", "go", f'package p\nimport "{a}/lib"\n// {text(n)}\nfunc {c}() {{\n}}\nvar {a} = 1\n'))
        else:
            rows.append((f"{folder}/f{k}.txt", None, text(n) + "\n"))
    files = spark.createDataFrame(rows, "rel_path string, lang string, content string").repartition(3).cache()
    asked = spark.createDataFrame([(1, "how does the parser merge a token stream"), (2, "cache index of the graph store"), (3, "parsing tests of streams"), (4, "flies of func and fly"), (5, None), (6, "the legacy kind")], "query_id long, text string")
    paths = sorted(r[0] for r in rows)
    changed = spark.createDataFrame([(p,) for p in [*paths[:7], " " + paths[9], "gone.py"]], "rel_path string")
    relations = spark.createDataFrame(list(zip(paths[:-1], paths[1:], strict=True)), "source string, target string")
    similar = spark.createDataFrame([(rng.choice([1, 2, 3, 9]), rng.choice(paths), 0, round(rng.random(), 6)) for _ in range(60)], "query_id long, rel_path string, pos int, similarity double")
    facts = spark.createDataFrame([(1, "merges"), (1, "stream"), (2, "graph"), (2, "nowhere"), (3, "cache"), (3, " ")], "query_id long, fact string")
    return files, asked, changed, relations, similar, facts


@pytest.fixture(scope="module")
def pairs(given):
    files, asked, _, _, similar, _ = given
    parsed = parsing.parse(files)
    chunks = parsing.code_chunks(files).cache()
    symbols, imports = parsed.select("rel_path", F.explode("symbols.name").alias("name")), parsed.select("rel_path", F.explode("imports").alias("imp"))
    near = similar.join(chunks.select("rel_path", "pos"), ["rel_path", "pos"], "left_semi")
    return chunk_search.features(chunks, asked, symbols=symbols, imports=imports, files=files, similar=near).cache(), chunks


def rows(df):
    return sorted(tuple(r) for r in df.select("candidate", "query_id", "rank", "rel_path", "start_line", "symbol", "score").collect())


@pytest.mark.parametrize(("cells", "most", "limit"), [(60, 1_000, 8), (500_000, 2, 3)])
def test_files_rank_as_pairs_do(given, pairs, monkeypatch, cells, most, limit):
    files, asked, changed, relations, similar, _ = given
    monkeypatch.setattr(file_search, "CELLS", cells)
    monkeypatch.setattr(file_search, "MOST_QUESTIONS", most)
    features, chunks = pairs
    for context in ({"changed": changed, "relations": relations}, {}):
        want = rows(chunk_search.ranked(features, chunks, asked, candidates=TRIES, limit=limit, **context))
        assert rows(file_search.FileSearch.over(files, asked, similar=similar, **context).ranked(TRIES, limit)) == want and want


def test_tuner_over_files_judges_as_over_pairs(given, pairs):
    files, asked, changed, relations, similar, facts = given
    features, chunks = pairs
    over_pairs = tuning.Evaluation.over(features, chunks, asked, facts, changed=changed, relations=relations)
    over_files = tuning.FileEvaluation(file_search.FileSearch.over(files, asked, similar=similar, changed=changed, relations=relations), lambda hits: parsing.code_chunks(files), facts)
    tries = [*TRIES, replace(TRIES[0], content=4.0)]
    assert over_files.scores(tries) == over_pairs.scores(tries)


def test_working_set_of_any_size(spark, given, pairs):
    files, asked, _, _, _, _ = given
    many = spark.range(10_050).select(F.concat(F.lit("none/"), F.col("id").cast("string")).alias("rel_path")).unionByName(files.select("rel_path"))
    features, chunks = pairs
    want = chunk_search.ranked(features, chunks, asked, changed=files.select("rel_path"), candidates=TRIES[:1])
    assert rows(chunk_search.ranked(features, chunks, asked, changed=many, candidates=TRIES[:1])) == rows(want)
    assert rows(file_search.FileSearch.over(files, asked, changed=many).ranked(TRIES[:1])) == rows(file_search.FileSearch.over(files, asked, changed=files.select("rel_path")).ranked(TRIES[:1]))


def test_similar_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0, 0.0, 0.0]), (7, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(10, [2.0, 0.0]), (11, [0.0, 0.0, 3.0]), (12, None)], "query_id long, embedding array<float>")
    got = {tuple(r) for r in V.similar(vectors, asked, 0.18, 6).select("query_id", "vec_id", "similarity").collect()}
    assert got == {(10, 1, 1.0), (10, 2, 0.707107)}
