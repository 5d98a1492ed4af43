"""Exact top-k search by inner product, with a table of distances to pivots.

For a query q, a vector x and a pivot p, |d(q, p) - d(x, p)| <= d(q, x); the
largest of these bounds over all pivots gives the upper bound
(|q|^2 + |x|^2 - bound^2) / 2 of the inner product.  A block of vectors is cut
into groups that lie near the same pivots, each with its range of distances to
every pivot.  A query is measured against the group with the best bound, and
against others as long as their bound reaches the k-th score found; all queries
that need a group meet it in one product of matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, sliced, table

#: Lengths of vectors that get pivots, the commonest; others have norms alone for a bound.
_LENGTHS = 100


def quantised(embedding: Column) -> Column:
    """floor(256 x) of every component, or null for a vector that is null or holds null, NaN or infinity."""
    x = embedding.cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(x.isNotNull() & ~odd, F.transform(x, lambda v: F.floor(256 * v)))


def _pivots(vectors: DataFrame, pivots: int, sample: int) -> dict[int, np.ndarray]:
    """By length, vectors far from one another among a bounded sample, one of each of ``sample`` classes of hashes of vec_id."""
    common = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(_LENGTHS)
    sized = vectors.withColumn("d", F.size("v")).join(F.broadcast(common.select("d")), "d")
    # The least hash of each of ``sample`` classes: partial sums keep all but that many vectors of a length where they are.
    h = F.xxhash64("vec_id")
    least = sized.groupBy("d", F.pmod(h, F.lit(sample)).alias("class")).agg(F.min(F.struct(h.alias("h"), "vec_id", "v")).alias("s"))
    rows = least.orderBy("d", "s.h", "s.vec_id").select("d", "s.v").collect()
    held: dict[int, list] = {}
    for d, v in rows:
        held.setdefault(d, []).append(v)
    out = {}
    for d, found in held.items():
        x = np.array(found, float).reshape(len(found), d)
        chosen = [0]
        far = ((x - x[0]) ** 2).sum(1)
        while len(chosen) < min(pivots, len(x)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
        out[d] = x[chosen]
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x**2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(1)[None, :]
    return np.sqrt(np.maximum(square, 0))


def _grid(column: pa.Array, rows: int, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(rows, len(flat) // rows)


class Block:
    """Vectors x (int64, one or more) in groups of ``step`` by nearest pivots; lows and highs are a group's distances to the pivots dx, or its norms without pivots."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, dx: np.ndarray, step: int = 128):
        real = x.astype(float)
        norms = np.einsum("ij,ij->i", real, real)
        dx = dx if dx.shape[1] else np.sqrt(norms)[:, None]
        near = dx.argmin(axis=1)
        order = np.lexsort((dx[np.arange(len(ids)), near], near))
        self.ids, self.x, self.real = ids[order], x[order], real[order]
        self.starts = np.arange(0, len(ids), step)
        self.ends = np.append(self.starts[1:], len(ids))
        self.lows, self.highs = np.minimum.reduceat(dx[order], self.starts), np.maximum.reduceat(dx[order], self.starts)
        self.norms = np.maximum.reduceat(norms[order], self.starts)
        self.most = float(np.abs(real).max(initial=0)) * x.shape[1]

    def bounds(self, q: np.ndarray, dq: np.ndarray) -> np.ndarray:
        """By query and group, no less than any score of theirs."""
        own = np.einsum("ij,ij->i", q, q)[:, None]
        dq = dq if dq.shape[1] else np.sqrt(own)
        low = np.zeros((len(q), len(self.starts)))
        for at, lows, highs in zip(dq.T[:, :, None], self.lows.T, self.highs.T, strict=True):
            np.maximum(low, lows - at, out=low)
            np.maximum(low, at - highs, out=low)
        # Pivots' distances are rounded: a margin keeps the bound above the score.
        return (own + self.norms - low**2) / 2 + 1e-6 * (own + self.norms + 1) + 1


def search_block(block: Block, queries: np.ndarray, q: np.ndarray, dq: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best of a block for queries with vectors q (int64): place of the query, vec_id and score, ties to smaller vec_id; and how many pairs were evaluated.

    Scores are int64 products, which are right whenever the score fits a long;
    where doubles hold all sums exactly they do the work.
    """
    small = block.most * np.abs(q.astype(float)).max(axis=1, initial=0) < 2**53
    out = [np.empty(0, np.int64) for _ in range(3)]
    done = 0
    for some, x, v in ((np.flatnonzero(small), block.real, q.astype(float)), (np.flatnonzero(~small), block.x, q)):
        if len(some):
            rows, ids, scores, n = _best(block, x, queries[some], v[some], block.bounds(q[some].astype(float), dq[some]), k)
            out = [np.concatenate(pair) for pair in zip(out, (some[rows], ids, scores), strict=True)]
            done += n
    return (*out, done)


def _best(block: Block, x: np.ndarray, queries: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    rows, ids, scores = (np.empty(0, np.int64) for _ in range(3))
    last, full, done = np.zeros(len(q), np.int64), np.zeros(len(q), bool), 0
    first = bound.argmax(axis=1)
    # Each query's best group comes first, so that most have a k-th score before they meet the others.
    for opening in (True, False):
        for g in np.argsort(-bound.max(axis=0), kind="stable"):
            asking = np.flatnonzero(first == g if opening else (first != g) & (~full | (bound[:, g] >= last)))
            if not len(asking):
                continue
            at, end = block.starts[g], block.ends[g]
            told = (q[asking] @ x[at:end].T).astype(np.int64)
            done += told.size
            a, c = np.nonzero((told >= last[asking, None]) | ~full[asking, None])
            other = block.ids[at + c] != queries[asking[a]]
            a, c = a[other], c[other]
            rows, ids, scores = np.concatenate([rows, asking[a]]), np.concatenate([ids, block.ids[at + c]]), np.concatenate([scores, told[a, c]])
            order = np.lexsort((ids, -scores, rows))
            rows, ids, scores = rows[order], ids[order], scores[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            kept = place < k
            rows, ids, scores, place = rows[kept], ids[kept], scores[kept], place[kept]
            ends = place == k - 1
            full[rows[ends]], last[rows[ends]] = True, scores[ends]
    return rows, ids, scores, done


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5, pivots: int = 64, sample: int = 2048, block: int = 8192, query_block: int = 4096) -> DataFrame:
    """The k highest inner products of every query among all vectors.

    vectors, queries: vec_id long and v array<long> (see ``quantised``).  Returns
    query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id, and all
    are returned if there are fewer.  A vector with a query's vec_id is the
    query's own and no candidate of it.

    Vectors are dealt to blocks of about ``block`` rows by a hash, queries to
    blocks of about ``query_block``; every pair of blocks meets once and brings k
    rows back for each query.  ``sample`` bounds the rows of a length among which
    pivots are chosen, for the hundred commonest lengths; vectors of other lengths
    are bounded by their norms.  Rows with null vec_id or v take no part; vectors
    of different lengths never meet; repeated queries count once, repeated vectors
    as often as they are there.  Scores must fit a long.  Other columns are
    ignored; empty tables give no row.
    """
    some = vectors.where("vec_id is not null and v is not null").select("vec_id", "v")
    asked = queries.where("vec_id is not null and v is not null").select("vec_id", "v").distinct()
    table_of = some.sparkSession.sparkContext.broadcast(_pivots(some, pivots, sample))  # at most ``pivots`` vectors of each of 100 lengths
    blocks, query_blocks = max(1, -(-some.count() // block)), max(1, -(-asked.count() // query_block))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 4096):
            v, d = b.column("v"), b.column("v").value_lengths().to_numpy()
            order = np.argsort(d, kind="stable")
            edges = np.flatnonzero(np.diff(d[order], prepend=-1))
            far, wide = [], []
            for at, n in zip(edges, [*edges[1:], len(d)], strict=True):
                x = v.take(pa.array(order[at:n]))
                p = table_of.value.get(int(d[order[at]]))
                m = _distances(_grid(x, n - at, float), p) if p is not None and d[order[at]] else np.empty((n - at, 0))
                far.append(m.ravel())
                wide.append(np.full(n - at, m.shape[1]))
            ends = np.concatenate(([0], np.cumsum(np.concatenate(wide)))).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(far)))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(order)) for c in b.columns), column], [*b.schema.names, "far"])

    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    filed = some.withColumn("block", dealt(F.struct("vec_id", F.monotonically_increasing_id()), blocks)).mapInArrow(measured, "vec_id long, v array<long>, block int, far array<double>")
    filed = filed.withColumn("query_block", every(query_blocks)).withColumn("d", F.size("v"))
    sent = asked.withColumn("query_block", dealt("vec_id", query_blocks)).mapInArrow(measured, "vec_id long, v array<long>, query_block int, far array<double>")
    sent = sent.withColumn("block", every(blocks)).withColumn("d", F.size("v"))

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        n, m = left.num_rows, right.num_rows
        if not n or not m:
            return schema.empty_table()
        whole = lambda t, c: t.column(c).combine_chunks() if t.column(c).num_chunks != 1 else t.column(c).chunk(0)
        held = Block(left.column("vec_id").to_numpy(), _grid(whole(left, "v"), n, np.int64), _grid(whole(left, "far"), n, float))
        queries = right.column("vec_id").to_numpy()
        rows, found, scores, _ = search_block(held, queries, _grid(whole(right, "v"), m, np.int64), _grid(whole(right, "far"), m, float), k)
        return pa.table([queries[rows], found, scores], schema)

    found = filed.groupBy("block", "query_block", "d").cogroup(sent.groupBy("block", "query_block", "d")).applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all embeddings for those whose vec_id is divisible by 50."""
    vectors = cut(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v")))
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s
)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""
