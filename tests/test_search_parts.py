"""Range join, ladder, tuner and related tests against brute force."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lodestone.operators import bundles, chunk_search, excerpts, index, tuning
from lodestone.operators.search import SearchWeights
from lodestone.plans.registry import Tables
from lodestone.plans.sources import source_files, source_sizes


def test_lines_meet_long_and_nested_chunks(spark):
    rng = random.Random(1)
    chunks = [(f"f{k % 4}", k, s := rng.randint(1, 900), s + rng.choice([0, 3, 70, 600])) for k in range(80)] + [("f0", 99, 1, 5000)]
    hits = [(rng.randint(1, 3), f"f{rng.randint(0, 4)}", rng.randint(1, 1500)) for _ in range(300)]
    got = chunk_search.exact_chunks(spark.createDataFrame(chunks, "rel_path string, pos int, start_line int, end_line int"), spark.createDataFrame(hits, "query_id int, rel_path string, line int"))
    want = {(q, p, k) for q, p, n in hits for f, k, s, e in chunks if f == p and s <= n <= e}
    rows = [tuple(r) for r in got.select("query_id", "rel_path", "pos").collect()]
    assert set(rows) == want and len(rows) == len(want)


def ladder(files, budget, most=600):
    used, out = 80, []
    for rank, (path, score, forms) in enumerate(files, 1):
        if score < 0.1 or used >= budget:
            break
        full, excerpt, signature, note = forms
        options = [("full", full if full and full <= most else 0), ("excerpt", excerpt if excerpt and excerpt <= 800 and rank <= 3 else 0), ("signature", signature), ("note", note)]
        form = next(((f, n) for f, n in options if n and used + n <= budget), None)
        if form:
            used += form[1]
            out.append([rank, path, *form, full])
    for row in out:
        more = row[4] - row[3]
        if row[2] in ("excerpt", "signature") and row[4] <= 600 and more > 0 and used + more <= budget:
            used += more
            row[2:4] = ["full", row[4]]
    return {tuple(r[:4]) for r in out}


@pytest.mark.parametrize(("block", "lean"), [(3, False), (256, True)])
def test_ladder_against_brute_force(spark, block, lean):
    rng = random.Random(block)
    asked = {q: [(f"p{k}", rng.choice([0.05, 1.0, 2.0]) if k > 30 else 2.0, (rng.choice([90, 400, 580, 700, 2000]), rng.choice([None, 50, 300, 900]), rng.choice([20, 60, 340]), rng.choice([8, 15]))) for k in range(40)] for q in range(12)}
    rows = [(q, k, p, s, *forms) for q, files in asked.items() for k, (p, s, forms) in enumerate(files, 1)]
    df = spark.createDataFrame(rows, "query_id long, rank int, rel_path string, score double, full int, excerpt int, signature int, note int")
    got = {}
    for r in bundles.pack_ladder(df, 2000, lean, block=block).collect():
        got.setdefault(r.query_id, set()).add((r.rank, r.rel_path, r.form, r.tokens))
    assert got == {q: ladder(files, 2000, 180 if lean else 600) for q, files in asked.items()}
    assert bundles.pack_ladder(df.limit(0), 2000).count() == 0


def test_ranking_is_asked_for_only_as_far_as_bundles_have_room(spark):
    forms = spark.createDataFrame([(f"p{k:04}", 50, 20, 10) for k in range(900)], "rel_path string, full int, signature int, note int")
    asked: list[int] = []

    def rank(top):
        asked.append(top)
        return spark.range(min(top, 900)).select(F.lit(1).alias("query_id"), (F.col("id") + 1).alias("rank"), F.format_string("p%04d", F.col("id")).alias("rel_path"), F.lit(1.0).alias("score"))

    none = lambda some: some.select("query_id", "rel_path", F.lit(None).cast("int").alias("excerpt")).limit(0)
    packed = bundles.pack_ranking(rank, forms, 2080, first=8, excerpts=none)
    assert packed.count() == 40 and asked == [8, 32, 128]


def test_forms_are_made_of_the_first_files_and_of_those_that_fit(spark):
    # Small files lie far behind in the ranking, and are no longer there once a bundle's first files are raised to the whole.
    sizes = [(f"p{k:04}", 400, 380, 390) if k not in (170, 700, 880) else (f"p{k:04}", 90, 31, 30) for k in range(900)]
    forms = spark.createDataFrame(sizes, "rel_path string, full int, signature int, note int").cache()
    made, rooms = [], []
    rank = lambda top: spark.range(min(top, 900)).select(F.lit(1).alias("query_id"), (F.col("id") + 1).cast("int").alias("rank"), F.format_string("p%04d", F.col("id")).alias("rel_path"), F.lit(1.0).alias("score"))
    none = lambda some: some.select("query_id", "rel_path", F.lit(None).cast("int").alias("excerpt")).limit(0)

    def described(some):
        made.append(some.count())
        return forms.join(some.select("rel_path"), "rel_path", "left_semi"), none(some)

    def small(room):
        rooms.append(room)
        return forms.select("rel_path", F.least("full", "signature", "note").alias("least")).where(F.col("least") <= room)

    want = ladder([(p, 1.0, (full, None, s, n)) for p, full, s, n in sizes], 2165)
    got = {tuple(r) for r in bundles.pack_ranking(rank, described, 2165, first=8, small=small).collect()}
    assert {(r[1:]) for r in got} == want and len(want) == 7 and made[0] == 8 and max(made) <= 11 and rooms == [85]
    assert {tuple(r)[1:] for r in bundles.pack_ranking(rank, forms, 2165, first=8, excerpts=none).collect()} == want


def test_no_form_falls_short_of_its_bound(spark, sf_dir):
    t = Tables(spark, sf_dir)
    odd = spark.createDataFrame([("a", None, ""), ("a.json", "json", "{}"), ("a.go", "go", "x"), ("b.go", "go", "package p\nvar x = 1\n"), ("c.md", "markdown", "# x\n"), ("d.rs", "rust", "fn f() {}\n"), ("e.md", "markdown", "# x\n" * 600), ("f" * 1500 + ".py", "python", "def f():\n    pass\n" * 200)], "rel_path string, lang string, content string")
    sized = odd.select("rel_path", "lang", F.octet_length("content").alias("size"))
    for files, sizes in ((odd, sized), (source_files(t), source_sizes(t))):
        least = F.least("full", "signature_tokens", "note_tokens")
        both = excerpts.forms(files).join(sizes, "rel_path").withColumn("bound", excerpts.least_tokens(F.col("rel_path"), F.col("lang"), F.col("size")))
        assert both.count() == files.count() and both.where(least < F.col("bound")).count() == 0
    whole = source_files(t).select("rel_path", F.octet_length("content").alias("n")).join(source_sizes(t), "rel_path")
    assert whole.where("n < size or size < n - 500").count() == 0


@pytest.fixture(scope="module")
def searched(spark):
    rng = random.Random(3)
    words = ["parser", "token", "stream", "cache", "index", "graph", "merge", "store"]
    rows = []
    for f in range(12):
        line = 1
        for k in range(rng.randint(1, 4)):
            n = rng.choice([2, 5, 30])
            symbol = rng.choice(words) + rng.choice(["", "Two", "All"])
            rows.append((f"src/{rng.choice(words)}{f}{'_test' if f % 5 == 0 else ''}.go", k, line, line + n, rng.choice(["func", "type", "file"]), symbol, " ".join(rng.choice(words) for _ in range(n)), n * 20))
            line += n + 1
    rows = list({(r[0], r[1]): r for r in rows}.values())
    fixed = {}
    for r in rows:  # chunks of a file are numbered from 0
        fixed.setdefault(r[0], []).append(r)
    rows = [(p, k, *r[2:]) for p, rs in fixed.items() for k, r in enumerate(rs)]
    chunks = spark.createDataFrame(rows, "rel_path string, pos int, start_line int, end_line int, kind string, symbol string, content string, token_estimate int").cache()
    questions = spark.createDataFrame([(1, "how does the parser merge a token stream"), (2, "cache index of the graph store"), (3, "parsing tests of streams")], "query_id long, text string")
    facts = spark.createDataFrame([(1, "merge"), (1, "stream"), (2, "graph"), (2, "nowhere"), (3, "cache"), (3, " ")], "query_id long, fact string")
    paths = sorted(fixed)
    changed = spark.createDataFrame([(p,) for p in paths[:3]], "rel_path string")
    relations = spark.createDataFrame(list(zip(paths[:-1], paths[1:], strict=True)), "source string, target string")
    return chunks, questions, facts, changed, relations, chunk_search.features(chunks, questions).cache()


def scored(searched, w):
    """Recall and tokens by a ranking of its own for each set of weights."""
    chunks, questions, facts, changed, relations, features = searched
    hits = chunk_search.ranked(features, chunks, questions, w, changed=changed, relations=relations).collect()
    text = {(r.rel_path, r.start_line, r.symbol): (r.content, r.token_estimate) for r in chunks.collect()}
    wanted = {}
    for r in facts.collect():
        if r.fact.strip():
            wanted.setdefault(r.query_id, set()).add(r.fact)
    found = {q: {f for f in fs for h in hits if h.query_id == q and f in text[h.rel_path, h.start_line, h.symbol][0].split()} for q, fs in wanted.items()}
    tokens = sum(text[h.rel_path, h.start_line, h.symbol][1] for h in hits)
    return round(sum(len(found[q]) / len(wanted[q]) for q in wanted) / len(wanted), 6), -round(tokens / len(wanted), 6)


def test_candidates_of_the_tuner_score_as_searches_of_their_own(spark, searched):
    chunks, questions, facts, changed, relations, features = searched
    evaluation = tuning.Evaluation.over(features, chunks, questions, facts, changed=changed, relations=relations)
    tries = [SearchWeights(), SearchWeights(symbol_match=0.0, content=12.0, graph=30.0, tiny_keep=0.3, long_penalty_max=1.0, working_set=40.0, test_keep=0.5, impl_kind=9.0)]
    assert evaluation.scores(tries) == [scored(searched, w) for w in tries]


def test_tuner_climbs_as_a_loop_of_searches(spark, searched):
    chunks, questions, facts, changed, relations, features = searched
    evaluation = tuning.Evaluation.over(features, chunks, questions, facts, changed=changed, relations=relations, limit=8)
    names = ("content",)
    best, told = tuning.tuned(evaluation, names=names, passes=1)
    own, score = SearchWeights(), scored(searched, SearchWeights())
    for name in names:
        for v in tuning.gates.candidate_values(getattr(own, name)):
            w = tuning.clamped(replace(own, **{name: v}))
            if (got := scored(searched, w)) > score:
                own, score = w, got
    assert (best, told[-1]) == (own, score)


def test_related_tests(spark):
    files = [("a/cart.go",), ("a/cart_test.go",), ("a/cartItem.spec.ts",), ("b/shopping_cart.py",), ("tests/x.py",), ("b/y.py",), ("c/.test.js",)]
    edges = [("tests/x.py", "b/y.py"), ("tests/x.py", "a/cart_test.go"), ("gone_test.go", "b/y.py")]
    got = {tuple(r) for r in index.related_tests(spark.createDataFrame(files, "rel_path string"), spark.createDataFrame(edges, "source string, target string")).collect()}
    assert {("a/cart.go", "a/cart_test.go"), ("a/cart.go", "a/cartItem.spec.ts"), ("b/shopping_cart.py", "a/cart_test.go"), ("b/y.py", "tests/x.py"), ("tests/x.py", "a/cart_test.go"), ("a/cart_test.go", "tests/x.py")} <= got
    assert ("b/shopping_cart.py", "a/cartItem.spec.ts") not in got and not any("gone" in t for _, t in got) and not any(f == "c/.test.js" for f, t in got if t != f)


@pytest.mark.parametrize("common", [0.0, 0.3, 1.0])
def test_first_hits_with_an_early_stop(spark, common):
    from lodestone.operators import search

    rng = random.Random(5)
    words = [f"{a}{b}x" for a in "abcdefgh" for b in "pqrst"]
    texts = [(f"k{k:03}", " ".join(rng.choice(words[: rng.choice([4, 12, 40])]) for _ in range(rng.randint(0, 25)))) for k in range(150)]
    asked = [(q, w) for q in range(12) for w in rng.sample(words, rng.choice([1, 3, 20]))]
    report = {}
    got = search.top_hits(spark.createDataFrame(texts, "key string, content string"), spark.createDataFrame(asked, "query_id long, term string"), 5, common=common, report=report).collect()
    want = set()
    for q in range(12):
        terms = {t for i, t in asked if i == q}
        best = sorted((-n, k) for k, c in texts if (n := len(terms & set(c.split()))))[:5]
        want |= {(q, i + 1, k, -n) for i, (n, k) in enumerate(best)}
    assert {tuple(r) for r in got} == want and report["scored"] <= report["pairs"]
