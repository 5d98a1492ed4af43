"""Long and hostile inputs, large numbers, forced collisions, and added spans against brute force."""

import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontamination, html_text, near_text, packing, pii, substring_dedup, topk, toxicity

PARA = "<p>This is a long paragraph of the article, with commas, and stops. It goes on and on; it tells a story that lasts for a while.</p>"


def test_class_words_never_empty_a_page():
    for page in (f'<body class="single no-sidebar"><div>{PARA * 4}</div></body>', f'<body class="comments-open"><div>{PARA * 4}</div></body>', f'<article class="post tag-politics">{PARA * 4}</article>', f'<div class="widget"><h1>T</h1>{PARA * 4}</div>'):
        assert sum(b.startswith("This is") for b in html_text.content_blocks(page)) == 4
    page = f'<article><header><h1>Title</h1></header>{PARA * 3}<ul><li>First item</li><li>Second item</li></ul></article><div class="comments"><p>A bad comment, with text.</p></div>'
    assert [b for b in html_text.content_blocks(page) if not b.startswith("This is")] == ["Title", "First item", "Second item"]
    assert html_text.content_blocks("<p>a &<b>amp;</b> b, here. And so on.</p>") == ["a &amp; b, here. And so on."]


@pytest.mark.parametrize("part", ['<a "', "<div>", "<button>", "<!--", "<p>x, y.", "</p>", "<a \'\">", "<ul><li>", "&"])
def test_pages_take_linear_time(part):
    took = []
    for n in (20_000, 80_000):
        start = time.perf_counter()
        html_text.content_blocks(part * n)
        took.append(time.perf_counter() - start)
    assert took[1] < 10 * took[0] + 0.5


def test_exception_phrases_and_addresses_take_linear_time():
    lexicon = toxicity.Lexicon(((" trash ", 3.0), (" scum ", 3.0)))
    start = time.perf_counter()
    assert toxicity.features("trash can " * 50_000, lexicon) == (0.0, 0.0)
    assert len(pii.find_spans("a@b.de 10.0.0.1\n" * 100_000)) == 200_000
    assert time.perf_counter() - start < 20


def test_exceptions_cover_only_their_own_words():
    lexicon = toxicity.Lexicon(((" trash ", 3.0), (" scum ", 2.0)))
    assert toxicity.features("trash can", lexicon)[0] == 0
    assert toxicity.features("pond scum trash trash can scum", lexicon)[0] == math.log1p(5.0)


def test_large_components_keep_their_order(spark):
    rows = [(0, [4_000_000_000, 4_000_000_000]), (1, [1, 0]), (2, [0, 1]), (3, [1, 1]), (4, []), (5, [])] + [(k, [k] * (k - 5)) for k in range(6, 130)]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(vectors, vectors.where("vec_id in (1, 4, 129)"), k=2).collect()}
    assert got == {(1, 1): (0, 4_000_000_000), (1, 2): (7, 7), (4, 1): (5, 0)}


def test_many_short_texts_pack_without_padding():
    lengths = np.random.default_rng(2).integers(1, 4, 300_000).tolist()
    start = time.perf_counter()
    sequences = packing.pack_block(lengths)
    assert time.perf_counter() - start < 20
    assert all((n := sum(x for _, _, x in s)) & (n - 1) == 0 for s in sequences)
    assert sum(x for s in sequences for _, _, x in s) == sum(lengths)


def test_windows_with_equal_first_hashes_stay(spark, monkeypatch):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    words = np.arange(60, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    first, check = substring_dedup.window_hashes(words, np.array([0, 30]), 20)
    assert first[0] != first[1] and check[0] != check[1]
    real = substring_dedup.window_hashes
    monkeypatch.setattr(substring_dedup, "window_hashes", lambda *x: (np.zeros_like(real(*x)[0]), real(*x)[1]))
    assert [int(x[0]) for x in (substring_dedup.window_hashes(words, np.array([0, 30]), 20)[0],)] == [0]
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(docs).collect()} == {1: 0, 2: 0, 3: 30}


def test_added_spans_against_brute_force(spark):
    rng = np.random.default_rng(9)
    people = [(f"n{k}@mail.de", f"Name{k}") for k in range(6)]
    texts = []
    for k in range(240):
        mail, name = people[int(rng.integers(6))]
        words = [f"w{int(x)}" for x in rng.integers(0, 40, 12)]
        texts.append(" ".join([*words[:6], *([mail] if k % 2 else []), *([name] if k % 2 or k % 10 == 0 else []), *words[6:]]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    word = re.compile(r"[0-9A-Za-z]+")
    held, terms = {}, {}
    for d, t in enumerate(texts):
        held[d] = set(re.findall(r"n\d@mail\.de", t))
        terms[d] = {w.lower() for w in word.findall(re.sub(r"n\d@mail\.de", " ", t))}
    n_e, n_t, n_et = Counter(e for d in held for e in held[d]), Counter(w for d in terms for w in terms[d]), Counter((e, w) for d in held for e in held[d] for w in terms[d])
    told = defaultdict(set)
    gone = set()
    for (e, w), n in n_et.items():
        if n >= 3:
            x = math.log2(len(texts) * n / (n_e[e] * n_t[w])) / math.log2(len(texts) / n_e[e])
            if x >= 0.95:
                gone.add(w)
            elif x >= 0.8:
                told[e].add(w)
    assert gone | set().union(*told.values())
    for r in pii.find_personal_data(docs).collect():
        t = texts[r.doc_id]
        known = gone | set().union(*(told[e] for e in held[r.doc_id])) if held[r.doc_id] else gone
        base = [m.span() for m in re.finditer(r"n\d@mail\.de", t)]
        want = {m.span() for m in word.finditer(t) if m[0].lower() in known and not any(a < m.end() and m.start() < b for a, b in base)}
        assert {(s.start, s.end) for s in r.spans or [] if s.kind != "email"} == want


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(4)
    own = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    prints = np.concatenate([own, own, rng.integers(0, 1 << 63, 300, dtype=np.uint64)])
    for k in range(200):
        for bit in rng.choice(64, 17, replace=False):
            prints[200 + k] ^= np.uint64(1) << np.uint64(bit)
    items = decontamination.Items([], [], 5, 17)
    items.index[7] = items._index(list(enumerate(own.tolist())))
    got = set(zip(*(x.tolist() for x in items.near(7, prints)), strict=True))
    near = np.bitwise_count(prints[:, None] ^ own[None, :]) <= 17
    assert got == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))
    met = sum(len(t.meet(prints[400:])[0]) for t in items.index[7][2])
    assert met < 0.3 * 300 * 200


def test_sketches_never_overstate_a_difference():
    rng = np.random.default_rng(6)
    for n, m, both in ((5, 7, 3), (300, 320, 250), (0, 4, 0), (2000, 100, 90), (1, 1, 1)):
        shared = rng.integers(0, 1 << 63, both, dtype=np.uint64)
        a, b = (np.concatenate([shared, rng.integers(0, 1 << 63, k - both, dtype=np.uint64)]) for k in (n, m))
        x, y = near_text.sketch(a), near_text.sketch(b)
        assert near_text.least_difference(x, y) <= n + m - 2 * both
        apart = sum((p ^ q).bit_count() if p ^ q >= 0 else 64 - (~(p ^ q)).bit_count() for p, q in zip(near_text._folded(x), near_text._folded(y), strict=True))
        assert apart <= n + m - 2 * both


def test_language_sample_is_bounded_and_no_language_is_left_out(spark):
    from lodestone.llm import language_id

    rows = [(k, f"the cat number {k} sat", "en") for k in range(3000)] + [(10_000 + k, f"le chat {k} est assis", f"l{k % 300}") for k in range(1200)]
    net = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=20)
    assert set(net.languages) == {lang for k, _, lang in rows if zlib.crc32(str(k).encode()) % 3 != 1}
    assert language_id.identify(spark.createDataFrame([(1, "the cat")], "doc_id long, text string"), net).select(F.col("score") <= 1).first()[0]
