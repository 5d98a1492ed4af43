"""Language identification by a byte convolutional network in numpy.

Filters of two, three and four bytes slide over windows of 512 bytes; each
filter's maximum in a window goes through a rectifier to a softmax layer.  A
text's score is the mean of its windows' probabilities, by bytes.  Each filter
is linear in one-hot bytes, so a window is applied by looking up byte pairs in
tables of precomputed sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, sliced, table, tidy, utf8

WINDOW = 512
WIDTHS = (2, 3, 4)
UNKNOWN = "und"


@dataclass
class ByteNet:
    """filters: by width, (width, 256, n); a zero byte adds nothing.  dense: (3 n, languages)."""

    languages: list[str]
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], n: int = 12, seed: int = 7) -> ByteNet:
        rng = np.random.default_rng(seed)
        filters = {w: rng.normal(0, 0.3, (w, 256, n)).astype(np.float32) for w in WIDTHS}
        for f in filters.values():
            f[:, 0] = 0
        k = n * len(WIDTHS)
        return cls(languages, filters, np.zeros(k, np.float32), rng.normal(0, 0.3, (k, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums over byte pairs for the first and the last two bytes of a filter, and over its third byte."""
        a, b, c = (self.filters[w] for w in WIDTHS)
        pair = lambda f, k: (f[k][:, None] + f[k + 1][None, :]).reshape(65536, -1)
        return np.concatenate([pair(a, 0), pair(b, 0), pair(c, 0)], axis=1), pair(c, 2), b[2]

    def probabilities(self, windows: np.ndarray, tables=None, batch: int = 128) -> np.ndarray:
        """windows: (m, WINDOW + 3) bytes; the last three belong to the next window or are zero."""
        first, last, third = tables or self.tables()
        n = third.shape[1]
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for k in range(0, len(windows), batch):
            w = windows[k : k + batch]
            pairs = w[:, :-1].astype(np.uint16) << 8 | w[:, 1:]
            x = first[pairs[:, :WINDOW]]
            x[:, :, n : 2 * n] += third[w[:, 2 : WINDOW + 2]]
            x[:, :, 2 * n :] += last[pairs[:, 2 : WINDOW + 2]]
            h = np.maximum(x.max(axis=1) + self.bias, 0)
            out[k : k + batch] = _softmax(h @ self.dense + self.offset)
        return out

    def fit(self, windows: np.ndarray, target: np.ndarray, *, steps: int = 400, batch: int = 48, rate: float = 0.02, seed: int = 11) -> None:
        """Adam on cross entropy; only the bytes at a filter's maximum get a gradient."""
        rng = np.random.default_rng(seed)
        params = [*self.filters.values(), self.bias, self.dense, self.offset]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        n = self.filters[2].shape[2]
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(windows), batch)
            w, y = windows[pick], target[pick]
            rows = np.arange(batch)[:, None]
            best, peaks = [], []
            for width, f in self.filters.items():
                x = sum(f[k][w[:, k : k + WINDOW]] for k in range(width))
                at = x.argmax(axis=1)
                best.append(at)
                peaks.append(np.take_along_axis(x, at[:, None], axis=1)[:, 0])
            z = np.concatenate(peaks, axis=1) + self.bias
            h = np.maximum(z, 0)
            g = _softmax(h @ self.dense + self.offset)
            g[np.arange(batch), y] -= 1
            g /= batch
            dz = (g @ self.dense.T) * (z > 0)
            grads = []
            for i, (width, f) in enumerate(self.filters.items()):
                d = np.zeros_like(f)
                for k in range(width):
                    np.add.at(d[k], (w[rows, best[i] + k], np.arange(n)[None, :]), dz[:, i * n : (i + 1) * n])
                d[:, 0] = 0
                grads.append(d)
            grads += [dz.sum(0), h.T @ g, g.sum(0)]
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for p, d, a, b in zip(params, grads, m, v, strict=True):
                a += 0.1 * (d - a)
                b += 0.01 * (d * d - b)
                p -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over all bytes of the texts, the text of each, and the bytes of its own in each."""
    sizes = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
    counts = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(texts)), counts)
    flat = np.zeros((int(counts.sum()) + 1) * WINDOW, np.uint8)
    at = np.concatenate(([0], np.cumsum(counts))) * WINDOW
    for t, a, n in zip(texts, at.tolist(), sizes.tolist(), strict=False):
        if n:
            flat[a : a + n] = np.frombuffer(t, np.uint8)
    windows = np.zeros((len(text), WINDOW + 3), np.uint8)
    windows[:, :WINDOW] = flat[:-WINDOW].reshape(-1, WINDOW)
    inner = np.flatnonzero(np.append(text[1:] == text[:-1], False)) if len(text) else text
    windows[inner, WINDOW:] = windows[inner + 1, :3] if len(inner) else 0
    own = np.minimum(sizes[text] - (np.arange(len(text)) * WINDOW - at[text]), WINDOW)
    return windows, text, own


def train(docs: DataFrame, *, rows: int = 400, windows: int = 4) -> ByteNet | None:
    """Learns from docs(doc_id, text, lang); held-out documents are never read.

    ``rows`` bounds the sample: of each language at most so many documents, those
    with the smallest hashes, and of each its first, last and middle ``windows``
    windows.  Every language is learned, however rare.  Rows without doc_id, text
    or lang teach nothing; None if there are none.
    """
    known = docs.where("doc_id is not null and lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    names = [(r.lang, r["count"]) for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    if not names:
        return None
    # A share of each language by a 64-bit hash, so that no task gathers a whole language; the rank then holds the bound.
    share = F.create_map(*[F.lit(x) for lang, n in names for x in (lang, 2.0 * rows / n + 64 / n)])
    dealt = F.xxhash64("doc_id", "text")
    likely = known.where(dealt.cast("double") / 2.0**64 + 0.5 < F.try_element_at(share, F.col("lang")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("dealt", "doc_id"))
    sample = likely.select("text", "lang", "doc_id", dealt.alias("dealt")).withColumn("rank", rank).where(F.col("rank") <= rows)
    names = [lang for lang, _ in names]

    @tidy
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            w, text, _ = windows_of(utf8(b.column("text")))
            lang = b.column("lang").to_pylist()
            keep = []
            for k in range(b.num_rows):
                mine = np.flatnonzero(text == k)
                keep += mine[np.unique(np.linspace(0, len(mine) - 1, windows).astype(int))].tolist() if len(mine) else []
            yield pa.RecordBatch.from_pydict({"window": pa.array([w[k].tobytes() for k in keep], pa.binary()), "lang": pa.array([lang[text[k]] for k in keep], pa.string())})

    got = sorted((r.lang, bytes(r.window)) for r in sample.select("text", "lang").mapInArrow(pick, "window binary, lang string").collect())
    if not got:
        return None
    x = np.frombuffer(b"".join(w for _, w in got), np.uint8).reshape(len(got), -1)
    place = {lang: k for k, lang in enumerate(names)}
    y = np.array([place[lang] for lang, _ in got])
    # Every language is met as often in training.
    share = np.bincount(y, minlength=len(names)).max()
    order = np.concatenate([np.resize(np.flatnonzero(y == k), share) for k in range(len(names)) if (y == k).any()])
    net = ByteNet.fresh(names)
    net.fit(x[order], y[order])
    return net


def identify(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """The rows of docs(doc_id, text, ...) with columns lang_pred and score (0 to 1); all bytes of a text are read.

    ``und`` with score 0 if a text is null or has no letter, or if there is no
    net.  Repeated rows are rows of their own.  Other columns stay; columns named
    lang_pred and score are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few hundred kB and 36 numbers a language, whatever the input

    @tidy
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables() if net else None
        for b in sliced(batches):
            if net is None:
                lang, score = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            else:
                w, text, own = windows_of(utf8(b.column("text")))
                p = net.probabilities(w, tables) * own[:, None]
                total = np.zeros((b.num_rows, len(net.languages)))
                np.add.at(total, text, p)
                total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-9)
                lang, score = [net.languages[k] for k in total.argmax(axis=1)], np.minimum(total.max(axis=1), 1.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    asked = docs.drop("lang_pred", "score")
    schema = T.StructType([*asked.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = asked.mapInArrow(predict, schema)
    return found.withColumn("lang_pred", F.when(letters, F.col("lang_pred")).otherwise(UNKNOWN)).withColumn("score", F.when(letters, F.col("score")).otherwise(0.0))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by a net trained outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
