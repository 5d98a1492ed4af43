"""Exact substring deduplication with difference-cover anchors.

A window is ``window`` consecutive words of a document.  A word goes if a window
over it also starts earlier in the corpus.

1. Anchors: short windows are hashed only where the position modulo 13 lies in
   the difference cover {0, 1, 3, 9}.  For any two positions some shift below 13
   takes both into the cover, so two equal windows of 20 words hold an equal,
   aligned anchor of 20 - 12 = 8 words.
2. Anchors met twice point at the windows that may repeat; all others are
   unique and never leave their task again.
3. Extension: the whole windows around repeated anchors are hashed and ordered
   by (doc_id, start); all but the first go.

Copies of a whole text are settled by a digest first; only their originals go
on.  What is met twice in a batch needs no other batch to be known as a repeat: a
hash leaves its batch once, whatever the number of its places, so a passage that a
third of all documents share arrives as one row per batch.

Windows count as equal if two independent hashes of their words, 96 bits in all,
are: among 10**12 windows a false match has odds of one in 10**5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import RollingHash, cut, hashed_words, mix64, sliced, spread_join, table, utf8

#: Fixed value: a perfect difference set; its differences are all residues modulo 13.
PERIOD = 13
COVER = np.array([0, 1, 3, 9])

#: Turns the word hashes into those of the second, independent hash.
_OTHER = np.uint64(0xD6E8FEB86659FD93)
_NULL_ID = -(2**63)
#: Bits that anchors' hashes do without: a false meeting of anchors only lays a few windows more.
_SPARED = np.uint64(16)


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 4000, size: int = 16 << 20) -> Iterator[pa.Table]:
    """Joins small Arrow batches up to some rows and bytes, for more merging in a task."""
    held: list[pa.RecordBatch] = []
    n = nbytes = 0
    for b in batches:
        held.append(b)
        n, nbytes = n + b.num_rows, nbytes + b.nbytes
        if n >= rows or nbytes >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n, nbytes = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def _spans(rows: pa.RecordBatch, span: int = 200_000) -> Iterator[pa.RecordBatch]:
    for k in range(0, rows.num_rows, span):
        yield rows.slice(k, span)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _by_doc(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Documents and the lists of their positions."""
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    at = np.flatnonzero(_firsts(doc)) if len(doc) else np.empty(0, np.int64)
    return doc[at], pa.ListArray.from_arrays(pa.array(np.append(at, len(doc)).astype(np.int32)), pa.array(pos.astype(np.int32)))


def _anchors(docs: DataFrame, size: int) -> DataFrame:
    """Rows of two kinds.

    Hashes of a batch: hash, and uid and pos of its place if it has only one there
    (null otherwise).  Documents: uid and ``sure``, the positions of their anchors
    that are met more than once in the batch; their hash is that of the uid, to
    spread them.
    """

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _batches(batches):
            words, first = hashed_words(utf8(_column(t, "text")))
            doc = np.repeat(np.arange(t.num_rows), np.diff(first))
            pos = np.arange(len(words)) - first[doc]
            at = np.flatnonzero(np.isin(pos % PERIOD, COVER) & (np.arange(len(words)) + size <= first[doc + 1]))
            hashes = RollingHash(words).of(at, at + size) >> _SPARED
            order = np.argsort(hashes, kind="stable")
            uid, doc, pos, h = _column(t, "uid").to_numpy(), doc[at][order], pos[at][order], hashes[order]
            start = np.flatnonzero(_firsts(h)) if len(h) else np.empty(0, np.int64)
            counts = np.diff(np.append(start, len(h)))
            many = np.repeat(counts > 1, counts)
            single = counts == 1
            d, lists = _by_doc(doc[many], pos[many])
            n = len(d)
            hash_ = np.concatenate((h[start], mix64(uid[d].view(np.uint64)) >> _SPARED)).view(np.int64)
            uids = pa.array(np.concatenate((uid[doc[start]], uid[d])), mask=np.concatenate((~single, np.zeros(n, bool))))
            place = pa.array(np.concatenate((pos[start], np.zeros(n, np.int64))).astype(np.int32), mask=np.concatenate((~single, np.ones(n, bool))))
            sure = pa.concat_arrays([pa.nulls(len(start), lists.type), lists])
            yield from _spans(pa.RecordBatch.from_arrays([pa.array(hash_), uids, place, sure], ["hash", "uid", "pos", "sure"]))

    return docs.mapInArrow(anchors, "hash long, uid long, pos int, sure array<int>")


def _copies(docs: DataFrame) -> DataFrame:
    """uid and copy (true) of the documents whose whole text stands in an earlier one."""
    marked = cut(docs.select("uid", "doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest")))
    first = marked.groupBy("digest").agg(F.min(F.struct("doc_id", "uid"))["uid"].alias("first"), F.count("*").alias("n")).where("n > 1")
    found = spread_join(marked.select("uid", "digest"), cut(first), "digest", marked.count())
    return cut(found.where(F.col("uid") != F.col("first")).select("uid", F.lit(True).alias("copy")))


def _by_document(places: DataFrame, name: str) -> DataFrame:
    """uid and the positions of places(uid, pos, sure)."""
    lists = F.coalesce("sure", F.array("pos"))
    return places.groupBy("uid").agg(F.flatten(F.collect_list(lists)).alias(name))


def _windows(docs: DataFrame, size: int, window: int) -> DataFrame:
    """Windows around repeated anchors, in rows of two kinds.

    The first window of each hash in a batch: hash, check, doc_id, uid, pos.
    Documents: uid and ``sure``, the positions of their windows that are not the
    first of the batch; their hash is that of the uid.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _batches(batches):
            words, first = hashed_words(utf8(_column(t, "text")))
            lists = _column(t, "anchors")
            at = lists.flatten().to_numpy() + np.repeat(first[:-1], lists.value_lengths().to_numpy())
            near = np.zeros(len(words) + 1, np.int64)
            doc = np.repeat(np.arange(t.num_rows), np.diff(first))
            low = np.maximum(at - (window - size), first[doc[at]])
            near += np.bincount(low, minlength=len(near))
            near -= np.bincount(at + 1, minlength=len(near))
            starts = np.flatnonzero((np.cumsum(near)[:-1] > 0) & (np.arange(len(words)) + window <= first[doc + 1]))
            h, check = window_hashes(words, starts, window)
            d, pos = doc[starts], starts - first[doc[starts]]
            doc_id, uid = _column(t, "doc_id").fill_null(_NULL_ID).to_numpy(), _column(t, "uid").to_numpy()
            order = np.lexsort((pos, uid[d], doc_id[d], check, h))
            h, check, d, pos = h[order], check[order], d[order], pos[order]
            new = _firsts(h, check) if len(h) else np.empty(0, bool)
            later, lists = _by_doc(d[~new], pos[~new])
            n, m = int(new.sum()), len(later)
            some = np.concatenate((np.zeros(n, bool), np.ones(m, bool)))
            whole = lambda a: np.concatenate((a, np.zeros(m, a.dtype)))
            columns = {
                "hash": pa.array(np.concatenate((h[new], mix64(uid[later].view(np.uint64)))).view(np.int64)),
                "check": pa.array(whole(check[new]).view(np.int32)),
                "doc_id": pa.array(whole(doc_id[d[new]]), mask=some),
                "uid": pa.array(np.concatenate((uid[d[new]], uid[later]))),
                "pos": pa.array(whole(pos[new]).astype(np.int32), mask=some),
                "sure": pa.concat_arrays([pa.nulls(n, lists.type), lists]),
            }
            yield from _spans(pa.RecordBatch.from_pydict(columns))

    return docs.mapInArrow(windows, "hash long, check int, doc_id long, uid long, pos int, sure array<int>")


def window_hashes(words: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes, of 64 and 32 bits, of the windows of hashed words."""
    other = RollingHash(mix64(words ^ _OTHER)).of(starts, starts + window)
    return RollingHash(words).of(starts, starts + window), (other >> np.uint64(32)).astype(np.uint32)


def dedup_substrings(docs: DataFrame, *, window: int = 20) -> DataFrame:
    """Removes the repeats of passages of ``window`` words or more from docs(doc_id, text).

    Columns: doc_id, n_words, n_removed (long), kept (string): the words left,
    joined by single spaces.

    Words are runs of anything but space and \\t to \\r.  Null, empty and blank
    texts have no word.  Rows with equal doc_id count as documents one after
    another in reading order, null ids first.  Other columns are ignored.  docs is
    read twice; it must list its rows in the same order each time, as tables do.
    """
    return _dedup(docs, window, "kept string", lambda kept: {"kept": [k.decode() for k in kept]})


def _dedup(docs: DataFrame, window: int, column: str, of) -> DataFrame:
    size = window - PERIOD + 1
    if size < 1:
        raise ValueError(f"windows of {PERIOD} words at least")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("uid", F.monotonically_increasing_id())
    # One exchange of the texts, which the three readers below share.
    docs = given.repartition(n, "uid").join(_copies(given).hint("shuffle_hash"), "uid", "left").select("doc_id", "text", "uid", "copy")
    originals = docs.where("copy is null")

    anchors = _anchors(originals, size)
    # A hash that its batch holds more than once has no uid.
    met = F.sum(F.when(F.col("uid").isNull(), 2).otherwise(1)).over(Window.partitionBy("hash"))
    repeated = anchors.withColumn("met", met).where("uid is not null and (sure is not null or met > 1)")
    near = originals.join(_by_document(repeated, "anchors").hint("shuffle_hash"), "uid").select("doc_id", "text", "uid", "anchors")

    windows = _windows(near, size, window)
    rank = F.row_number().over(Window.partitionBy("hash", "check", F.col("sure").isNull()).orderBy("doc_id", "uid", "pos"))
    gone = _by_document(windows.withColumn("rank", rank).where("sure is not null or rank > 1"), "gone")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out: dict[str, list] = {"n_words": [], "n_removed": []}
            texts = []
            for text, copy, starts in zip(utf8(b.column("text")), b.column("copy").to_pylist(), b.column("gone"), strict=True):
                words = (text or b"").split()
                out["n_words"].append(len(words))
                if copy:  # every window starts in the original
                    words = words if len(words) < window else []
                elif starts.is_valid and len(starts):
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = starts.values.to_numpy()
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                out["n_removed"].append(out["n_words"][-1] - len(words))
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id")} | out | of(texts))

    whole = docs.join(gone.hint("shuffle_hash"), "uid", "left").select("doc_id", "text", "copy", "gone")
    return whole.mapInArrow(kept, f"doc_id long, n_words long, n_removed long, {column}")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and removed words of all documents, and the digest of the words kept."""
    return _dedup(table(spark, sf_dir, "documents"), 20, "kept_sha256 string", lambda kept: {"kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]})
