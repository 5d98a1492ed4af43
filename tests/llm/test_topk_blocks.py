"""Blocks of op1: all queries meet a group of vectors in one product, exact whatever the bounds."""

import time

import numpy as np

from lodestone.llm import topk


def brute(ids, x, queries, q, k):
    want = []
    for n, (query, v) in enumerate(zip(queries.tolist(), q.tolist(), strict=True)):
        scores = [(-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in zip(ids.tolist(), x.tolist(), strict=True) if i != query]
        want += [(n, i, -s) for s, i in sorted(scores)[:k]]
    return want


def test_a_block_against_brute_force():
    rng = np.random.default_rng(5)
    centres = rng.integers(-200, 200, (6, 8))
    for n, width, big in ((1, 3, 0), (300, 8, 0), (300, 8, 3), (40, 0, 0), (500, 8, 1)):
        x = (centres[rng.integers(0, 6, n)][:, :width] + rng.integers(-2, 3, (n, width))).astype(np.int64)
        x[:big] = 1_000_000_000
        ids = rng.integers(0, n, n)  # vec_ids come more than once
        some = rng.integers(0, n, min(n, 60))
        for pivots in (0, 4):
            dx = topk._distances(x.astype(float), x[:pivots].astype(float)) if pivots and width else np.empty((n, 0))
            rows, found, scores, _ = topk.search_block(topk.Block(ids, x, dx, step=16), ids[some], x[some], dx[some], 5)
            assert sorted(zip(rows.tolist(), scores.tolist(), found.tolist(), strict=True)) == sorted((a, s, i) for a, i, s in brute(ids, x, ids[some], x[some], 5))


def test_groups_out_of_reach_are_left_out():
    x = np.repeat(np.arange(1, 41)[:, None] * 100, 50, axis=0) * np.array([[1, 0]])
    dx = topk._distances(x.astype(float), np.array([[0.0, 0.0]]))
    asked = np.array([1999])
    assert topk.search_block(topk.Block(np.arange(2000), x, dx, step=50), asked, x[asked], dx[asked], 5)[3] <= 200


def test_many_queries_cost_a_product_not_a_scan_each():
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(8000, 64)) * 32).astype(np.int64)
    dx = topk._distances(x.astype(float), x[:64].astype(float))
    begin = time.process_time()
    topk.search_block(topk.Block(np.arange(8000), x, dx), np.arange(1000), x[:1000], dx[:1000], 5)
    assert time.process_time() - begin < 3
