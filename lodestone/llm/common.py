"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a local master that configures none."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if given is None:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        given = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(given)
    return given if "://" in given or given.startswith("file:") else f"file://{given}"


def new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage, in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder; smaller than a checkpoint where rows hold texts."""
    path = new_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def whole_texts(spark: SparkSession) -> None:
    """For queries over whole texts: hands Python fewer rows at once than Spark's 10,000.  Operators don't call it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Work on a task's batches after which the worker, which goes on to other tasks, gives freed memory back to the system."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
            if trim:
                trim(0)

    return run


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, and of about ``size`` bytes or one longer row, whatever the session hands over at once."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            parts = [b.slice(k, rows)]
            while parts:
                part = parts.pop()
                half = part.num_rows // 2
                if half and size is not None and part.nbytes > size:
                    parts += [part.slice(half), part.slice(0, half)]
                else:
                    yield part


#: Keys that hold more than 1 / HOT of all rows are hot; there are fewer than HOT of them.
HOT = 50_000


def spread_join(rows: DataFrame, facts: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """Inner join of rows with facts, which has one row a key and n, the number of that key's rows.

    total is the number of rows.  The facts of hot keys, fewer than HOT rows
    whatever the input, are broadcast, so the rows of a hot key stay where they
    are; the others are shuffled.  n is dropped.
    """
    hot = facts.where(F.col("n") * HOT > total).drop("n")
    cold = facts.where(F.col("n") * HOT <= total).drop("n")
    rest = rows.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key))), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 3 is 1 (never for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multiplier of the rolling hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 2**64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 2**64))
        done += step
    return out


class RollingHash:
    """Hashes of all slices [s, e) of a sequence of uint64 from one prefix sum modulo 2**64."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.inverse = powers(UNBASE, n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(BASE, n), out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))


#: The characters of the word pattern [^\x20\x09-\x0D]+ that are no part of a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def word_edges(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in bytes."""
    edge = np.flatnonzero(np.diff(SPACE[text], prepend=True, append=True))
    return edge[::2], edge[1::2]


def hashed_words(texts: list[bytes | None], span: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the texts, and per text the index of its first word (and the end).

    About ``span`` bytes are held as 64-bit numbers at once, or one longer text.
    """
    hashes, counts, k = [], [], 0
    while k < len(texts):
        some, size = [], 0
        while k < len(texts) and (not some or size + len(texts[k] or b"") < span):
            some.append(texts[k] or b"")
            size += len(some[-1]) + 1
            k += 1
        joined = np.frombuffer(b"\n".join(some) + b"\n", np.uint8)
        starts, ends = word_edges(joined)
        hashes.append(RollingHash(_BYTE[joined]).of(starts, ends))
        begin = np.cumsum([0, *(len(t) + 1 for t in some)])
        counts.append(np.diff(np.searchsorted(starts, begin)))
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(hashes), np.concatenate(([0], np.cumsum(np.concatenate(counts))))
