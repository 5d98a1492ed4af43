"""Spelling variants against brute force and on odd input."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.llm import queries as Q
from lodestone.llm import spelling
from tests.oracle import connect, differences


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, letters=5, least=3, every=97):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= letters and c >= least}
    form, out = {}, set()
    for w in n:
        found = sorted((-n[x], x) for x in n if near(w, x))
        form[w] = (found[0][1], len(found)) if found and -found[0][0] >= 2 * n[w] else (None, len(found))
    for w in n:
        root = w
        while form[root][0]:
            root = form[root][0]
        f, k = form[w]
        out.add((w, f, root, n[w], k, n[f] if f else None))
    return out


def result(spark, docs, **options):
    df = spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"), **options)
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


def test_against_sql(spark, sf_dir):
    assert not differences(Q.queries()["op11_spelling"](spark, sf_dir), connect(sf_dir), Q.oracle_sql()["op11_spelling"])


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    docs = [(rng.choice([None, *range(9)]), " ".join("".join(rng.choice("abÀ") for _ in range(rng.randint(4, 7))) for _ in range(120))) for _ in range(20)]
    got = result(spark, docs, least=2, every=7)
    assert len(got) == len(set(got)) and set(got) == brute(docs, least=2, every=7)


def test_long_words_and_pieces(spark):
    long = "".join(random.Random(1).choice("abcdé") for _ in range(3000))
    forms = [long, long[:1500] + long[1501:], long[:70] + "zz" + long[72:], "q" + long[1:], "a" * 64, "a" * 65, "a" * 66]
    docs = [(k, f"{w} " * (3 + 4 * (k == 0))) for k, w in enumerate(forms)] + [(9, "A" * 66 + " " + "a" * 66)]
    assert set(result(spark, docs)) == brute(docs)
    text = "ab cde " * 50 + "xyzé"
    assert "".join(spelling._pieces(text, 16)) == text and all(not p or len(p) < 30 for p in spelling._pieces(text, 16))
    assert {len({x[0] for x in spelling.deletions(w)}) for w in ("aabbb", "a" * 90)} == {2, 1}


def test_odd_input(spark):
    docs = [(1, None), (2, ""), (None, "Straße Straße straße STRASSE"), (3, "x" * 5 + " 12 ñandú! ÑANDÚ ñandú ñandú"), (3, "x" * 5 + " 12 ñandú! ÑANDÚ ñandú ñandú")]
    assert set(result(spark, docs)) == brute(docs)
    assert result(spark, docs[:2]) == []
    clash = spark.createDataFrame([(1, "apple apple apple apples apples apples")], "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("word", F.lit(1)).withColumn("key", F.lit(2))
    assert {r.word for r in spelling.spelling_variants(clash).collect()} == {r[0] for r in brute([(1, "apple apple apple apples apples apples")])}


def test_small_tasks_count_alike(spark):
    docs = spark.createDataFrame([(k, "alpha beta gamma delta") for k in range(40)], "doc_id long, text string")
    assert sorted(map(tuple, spelling.word_counts(docs, held=1, every=10**9).collect())) == [("alpha", 40), ("delta", 40), ("gamma", 40)]


def test_chains_are_followed(spark):
    chain = spark.createDataFrame([(str(k), str(k + 1)) for k in range(21)], "id string, form string")
    assert {(r.id, r.root) for r in spelling.roots(chain).collect()} == {(str(k), "21") for k in range(21)}
