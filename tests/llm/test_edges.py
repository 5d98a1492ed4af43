"""Nulls, empty and long texts, ties, repeated rows, empty tables and columns with clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontamination, html_text, language_id, packing, pii, simhash, substring_dedup, token_files, topk, toxicity
from lodestone.llm.common import hashed_words, new_dir
from lodestone.llm.components import components
from lodestone.llm.tokens import PieceEncoder, public_path

LONG = "word " * 30_000
ROWS = [(1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "the cat sat on the mat and the dog", "en"), (4, "the cat sat on the mat and the dog", "en"), (None, "le chat est assis sur le tapis", "fr"), (5, LONG, "en"), (6, "12 34 !!", None), (7, "naïve café ☕ 漢字", "fr")]


@pytest.fixture(scope="module")
def docs(spark):
    extra = [F.lit(x).alias(c) for c, x in (("uid", 1), ("score", "x"), ("fingerprint", 2), ("spans", 3), ("key", "k"), ("lang_pred", "q"), ("hash", 5), ("n", 1))]
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string").select("*", *extra)


def ids(rows):
    return sorted((r.doc_id for r in rows), key=str)


def test_words():
    h, first = hashed_words([b"a b", None, b"", b" b\x0ba "])
    assert first.tolist() == [0, 2, 2, 2, 4] and h[0] == h[3] and h[1] == h[2]


def test_simhash(docs):
    rows = simhash.near_duplicates(docs).collect()
    assert ids(rows) == ids(docs.collect())
    by = {r.doc_id: r for r in rows}
    assert by[1].component_id == by[2].component_id == by[3].component_id == 1 and by[1].fingerprint == 0
    assert sum(r.doc_id == 4 for r in rows) == 2 and by[4].component_id == 4
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_golay_keys_meet_within_three_bits():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, len(a), dtype=np.uint64)
    filed, sought = simhash.golay_keys(a)[0], simhash.golay_keys(b)[1]
    assert all(set(x) & set(y) for x, y in zip(filed.tolist(), sought.tolist(), strict=True))
    assert (sought >= 0).sum(axis=1).max() <= 72


@pytest.mark.parametrize("small", [0, 1 << 16])
def test_components(spark, small):
    rng = np.random.default_rng(5)
    links = [(i, i + 1) for i in range(1, 60)] + [(int(a), int(b)) for a, b in rng.integers(100, 400, (200, 2))] + [(7, 7), (7, 8), (7, 8)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long"), small=small).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for pair in links for x in pair if any(a != b and x in (a, b) for a, b in links)}
    assert components(spark.createDataFrame([], "a long, b long"), small=small).count() == 0


def test_substring_dedup(spark, docs):
    rows = substring_dedup.dedup_substrings(docs).collect()
    assert ids(rows) == ids(docs.collect())
    by = {r.doc_id: r for r in rows}
    assert by[1].n_words == by[2].n_words == by[3].n_words == 0 and by[2].kept == ""
    assert (by[5].n_words, by[5].n_removed) == (30_000, 29_999)
    p = " ".join(f"w{k}" for k in range(25))
    two = spark.createDataFrame([(1, f"a b c {p} d"), (1, f"x {p} y z"), (2, f"{p}"), (3, p[:40])], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(two).collect())
    assert got == [(1, 28, 25), (1, 29, 0), (2, 25, 25), (3, len(p[:40].split()), 0)]
    assert substring_dedup.dedup_substrings(docs.limit(0)).count() == 0


def test_token_files(spark, docs, tmp_path):
    out = f"file://{tmp_path}"
    shards = token_files.write_token_files(docs, out, tokenizer=public_path(), tasks=3)
    rows = token_files.read_token_files(shards).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 4, 5, 6, 7]
    assert [r.n_tokens for r in rows[1:3]] == [1, 1]
    at = 0
    for r in rows:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    path = shards.first().path
    reader = token_files.ShardReader(path)
    assert len(reader.document(len(reader) - 1)) == reader.counts[-1]
    raw = bytearray(open(path.removeprefix("file://"), "rb").read())
    raw[6] ^= 0xFF
    broken = tmp_path / "broken.zst"
    broken.write_bytes(raw)
    with pytest.raises(Exception, match=r"(?i)checksum|frame|data|corrupt|decompress"):
        token_files.ShardReader(f"file://{broken}").document(0)
    assert token_files.write_token_files(docs.limit(0), new_dir(spark, "none"), tokenizer=public_path()).count() == 0


def test_encoder_matches_the_library():
    e = PieceEncoder(public_path(), keep=50)
    texts = ["", " ", "a  b", " a\n b\n\n c \t d  ", "it's don't we'll.", "<|endoftext|> x", "é ü  x\x1c y", "123abc,,,  \n", "word,word. word; (x)", "漢字 ☕\r\n\r\n", "tail ", "\n\nlead"] * 2
    assert [np.frombuffer(b, "<u4").tolist() for b in e.encode(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing(docs):
    rows = packing.pack_documents(docs, tokenizer=public_path(), block_tokens=5000).collect()
    assert set(ids(rows)) == set(ids(docs.collect()))
    sizes = {}
    for r in rows:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert all(n <= 2048 and n & (n - 1) == 0 for n in sizes.values())
    assert packing.pack_documents(docs.limit(0), tokenizer=public_path()).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_pack_block(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 6000 if seed else 3, 200).tolist()
    sequences = packing.pack_block(lengths)
    seen = sorted((d, a, n) for s in sequences for d, a, n in s)
    for d, size in enumerate(lengths):
        at = 0
        for _, a, n in (x for x in seen if x[0] == d):
            assert a == at and n > 0
            at += n
        assert at == size
    assert all((t := sum(n for *_, n in s)) <= 2048 and t & (t - 1) == 0 for s in sequences)
    groups = packing.step_groups([sum(n for *_, n in s) for s in sequences], 8192)
    assert len(groups) == len(sequences)


def test_language_id(spark, docs):
    train = spark.createDataFrame([(k, ("the house of the king " if k % 2 else "das haus und der könig ") * 5, "en" if k % 2 else "de") for k in range(60)], "doc_id long, text string, lang string")
    net = language_id.train(train)
    found = language_id.identify(docs, net)
    assert found.columns.count("score") == 1 and found.count() == docs.count()
    by = {r.doc_id: r for r in found.collect()}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1, 2, 3, 6)) and by[4].lang_pred == "en"
    assert language_id.train(docs.limit(0)) is None
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}


def test_toxicity(spark, docs):
    empty = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert empty.terms == () and toxicity.score_toxicity(docs, empty).count() == docs.count()
    text = [(k, "you utter moron go away" if k % 3 == 0 else "a nice clown fish swims") for k in range(90)]
    own = spark.createDataFrame(text, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(90)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    lexicon = toxicity.learn(own, labels)
    probe = spark.createDataFrame([(1, "what a m0r0n"), (2, "MоRоN!"), (3, "nice fish"), (4, None)], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(probe, lexicon).collect()}
    assert score[1] > 0.7 and score[2] > 0.7 and score[3] < 0.5 and score[4] < 0.5
    assert toxicity.features("a clown fish", toxicity.Lexicon(((" clown ", 5.0),)))[0] == 0 < toxicity.features("a clown", toxicity.Lexicon(((" clown ", 5.0),)))[0]


def test_pii(spark, docs):
    found = pii.find_personal_data(docs)
    assert found.count() == docs.count() and pii.sanitise(found).where("doc_id = 1").first().text is None
    rows = [(k, f"write to Zorblax Quux at anna{k % 3}@mail.example.org or call +49 30 1234567{k % 3}") for k in range(12)] + [(100 + k, "the at or to call and so on") for k in range(200)]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(pii.find_personal_data(own)).collect()}
    assert "anna" not in clean[0] and "+49" not in clean[0] and "[EMAIL]" in clean[0] and clean[150] == "the at or to call and so on"
    one = spark.createDataFrame([(k, "reach Zorblax at anna@mail.example.org") for k in range(4)] + [(100 + k, "reach us at noon") for k in range(200)], "doc_id long, text string")
    assert "Zorblax" not in {r.doc_id: r.text for r in pii.sanitise(pii.find_personal_data(one)).collect()}[0]
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_base_spans():
    text = "a@b.c_d@e.f x@y @z.q 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111-1111 1111 9 +1 (202) 555-0100, +12 a..b@c-d.e.f."
    assert [(k, text[a:b]) for a, b, k in pii.find_spans(text)] == [("email", "a@b.c"), ("email", "_d@e.f"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("phone", "+1 (202) 555-0100"), ("email", "a..b@c-d.e.f")]


def test_decontamination(spark, docs):
    item = " ".join(f"token{k}" for k in range(30))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item), (4, "cat sat on"), (5, item)], "item_id long, text string")
    own = docs.select("doc_id", "text", "uid").unionByName(spark.createDataFrame([(20, f"x y {item.upper()}, z", 1), (21, item.replace("token3 ", "other "), 1), (22, " ".join(item.split()[:12]), 1)], "doc_id long, text string, uid int"))
    found = {(r.doc_id, r.item_id): (r.start, r.length) for r in decontamination.contaminations(own, bench).collect()}
    assert found[20, 1] == (2, 30) == found[20, 5] and (4, 4) in found and (22, 1) not in found
    small = decontamination.contaminations(own, bench, broadcast_bytes=64)
    assert {(r.doc_id, r.item_id) for r in small.collect()} == set(found)
    assert decontamination.contaminations(own.limit(0), bench).count() == 0 == decontamination.contaminations(own, bench.limit(0)).count()


def test_html():
    page = '<html><head><title>T</title><script>var t="</p><p>x";</script></head><body><nav><a href=/>Menu</a></nav><div class="cookie-notice">We use cookies.</div><article><h1>Head &amp; tail</h1><p>One two,\n  three.<p>Four <b>five</b>.<!-- no --><aside>Ad, buy.</aside><div id="comments"><p>Nice post!</p></div><form>Mail <input></form></article><footer>&copy; x</footer>'
    assert html_text.content_blocks(page) == ["Head & tail", "One two, three.", "Four five."]
    assert html_text.content_blocks("") == [] and html_text.content_blocks("<script>") == []
    bare = '<body><ul><li><a href=1>Home</a><li><a href=2>News</a></ul><div><p>A long text, with marks. And more of it, as texts go.</p><p>Another one, just as long as the first, or so.</p></div><div class="footer">x</div>'
    assert html_text.content_blocks(bare) == ["A long text, with marks. And more of it, as texts go.", "Another one, just as long as the first, or so."]
    assert html_text.content_blocks("plain text, no markup.") == ["plain text, no markup."]


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, 3), (2, None, "", 3), (None, "u", "<p>x y, z.", 3)], "page_id long, url string, html string, n_chars int")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [("1", "", 0), ("2", "", 0), ("None", "x y, z.", 7)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_topk(spark):
    rows = [(0, [0.5, 1.0]), (50, [0.5, 1.0]), (50, [0.5, 1.0]), (7, [1.0, 1.0]), (8, [1.0, 1.0]), (9, None), (10, [1.0, None]), (11, [float("nan"), 1.0]), (12, [float("inf"), 1.0]), (13, [1.0]), (100, [1.0]), (None, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", topk.quantised(F.col("embedding")).alias("v"), F.lit(1).alias("score"))
    got = topk.top_k(v, v.where("vec_id % 50 = 0"), k=2)
    want = [(0, 1, 7, 98304), (0, 2, 8, 98304), (50, 1, 7, 98304), (50, 2, 8, 98304), (100, 1, 13, 65536)]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sorted(tuple(r) for r in topk.top_k(v, v.where("vec_id % 50 = 0"), k=2, block=2, query_block=1).collect()) == want
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_pipeline_over_edges(spark, docs, sf_dir):
    import corpus_pipeline

    rows = docs.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, sf_dir)
        assert out.columns == rows.columns or name == "packing"
        rows = spark.createDataFrame(out.collect(), out.schema)
    assert rows.count() >= 1
