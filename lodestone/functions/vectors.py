"""Vector columns."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty vectors, vectors of different lengths and zero vectors."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)), 0.0).when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def unit(a: Column) -> Column:
    """The vector at length one, so that a dot product is a cosine."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(F.transform(a, lambda x: x.cast("double")))


def similar(vectors: DataFrame, asked: DataFrame, least: float, digits: int) -> DataFrame:
    """query_id, vec_id and similarity of vectors(vec_id, embedding) and asked(query_id, embedding), a stated set, whose cosine, rounded, is ``least`` or more.

    The asked vectors go to every task, and a batch of vectors meets them in one product.
    """
    ids = {n: vectors.schema["vec_id"].dataType if n == "vec_id" else asked.schema["query_id"].dataType for n in ("vec_id", "query_id")}
    by_size: dict[int, list] = {}
    for r in asked.where("query_id is not null and size(embedding) > 0").collect():
        by_size.setdefault(len(r.embedding), []).append((r.query_id, r.embedding))
    sent = vectors.sparkSession.sparkContext.broadcast({n: ([q for q, _ in rows], np.array([v for _, v in rows], np.float64)) for n, rows in by_size.items()})
    ddl = f"vec_id {ids['vec_id'].simpleString()}, query_id {ids['query_id'].simpleString()}, similarity double"

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["embedding"].map(len)
            for n, (queries, q) in sent.value.items():
                some = batch[sizes == n]
                if not len(some):
                    continue
                v = np.stack(some["embedding"]).astype(np.float64)
                norms = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    cosines = np.where(norms == 0, 0.0, q @ v.T / norms)
                i, k = np.nonzero(cosines >= least - 10.0**-digits)
                yield pd.DataFrame({"vec_id": some["vec_id"].to_numpy()[k], "query_id": np.array(queries, object)[i], "similarity": cosines[i, k]})

    found = vectors.where("vec_id is not null and size(embedding) > 0").select("vec_id", "embedding").mapInPandas(met, ddl)
    return found.withColumn("similarity", F.round("similarity", digits)).where(F.col("similarity") >= least)


def semantic_boost(similarity: Column, weight: float, threshold: float = 0.18) -> Column:
    """0 up to the threshold; then 1 and more, at most the weight."""
    b = 1 + (F.least(similarity, F.lit(1.0)) - threshold) * weight
    capped = F.when(b < 1, 1.0).otherwise(b)
    return F.when(similarity <= threshold, 0.0).otherwise(F.when(capped > weight, float(weight)).otherwise(capped))


def mock_embedding(dim: int = 1536):
    """A pandas UDF: a unit vector that depends on the text alone, without any model."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        # Skipping ahead in the generator: state k is a**k * seed + c * (a**(k-1) + ... + 1).
        a, c, m = 1664525, 1013904223, 1 << 32
        mult, add = np.empty(dim, np.uint64), np.empty(dim, np.uint64)
        x, y = 1, 0
        for k in range(dim):
            x, y = x * a % m, (y * a + c) % m
            mult[k], add[k] = x, y
        out = []
        for t in texts:
            seed = 5381
            for ch in t or "":
                seed = (seed * 33 + ord(ch)) % m
            v = ((mult * np.uint64(seed) + add) % np.uint64(m)).astype(np.float64) / m * 2 - 1
            out.append((v / max(np.linalg.norm(v), 1e-12)).astype(np.float32))
        return pd.Series(out)

    return embed


def decode_embedding():
    """A pandas UDF: little-endian float32 bytes to a vector."""

    @F.pandas_udf("array<float>")
    def decode(blobs: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4") for b in blobs])

    return decode


def encode_embedding():
    """A pandas UDF: a vector to little-endian float32 bytes."""

    @F.pandas_udf("binary")
    def encode(vectors: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else struct.pack(f"<{len(v)}f", *v) for v in vectors])

    return encode
