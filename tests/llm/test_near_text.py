"""The near-duplicate stage against brute force over all pairs."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm.common import sliced
from lodestone.llm.near_text import similar_texts


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and (sets[a] == sets[b] or 5 * both >= 4 * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in root if root[i] == i}


def test_stage_links_five_word_similarity(spark, sf_dir):
    rng = random.Random(1)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 200))]
        texts.append(base)
        for _ in range(8):
            text = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 20))):
                text[rng.randrange(len(text))] = f"x{rng.randrange(3000)}"
            texts.append(text[rng.randrange(6) :])
    passage = [f"p{k}" for k in range(60)]
    texts += [[*passage, *(f"y{rng.randrange(3000)}" for _ in range(rng.randrange(3, 40)))] for _ in range(60)]
    rows = list(enumerate([" ".join(t) for t in texts] + ["a b c", "A b  C", "a b c d", "", None, " \n"], 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()} == kept(rows)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), sf_dir).count() == 0


def test_no_document_goes_on_its_fingerprint_alone(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()} == kept([tuple(r) for r in rows])
    assert similar_texts(docs.withColumn("row", F.col("doc_id"))).count() == len(rows)


def test_batches_are_cut_by_bytes():
    texts = ["", None, "x" * 5000, "short", "y" * 300, "z" * 300] * 7
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    parts = list(sliced(iter([batch, batch.slice(0, 0)]), rows=20, size=1000))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert all(p.num_rows == 1 or p.nbytes <= 1000 for p in parts) and max(p.num_rows for p in parts) > 1
    assert [p.num_rows for p in sliced(iter([batch]), rows=20)] == [20, 20, 2]
