"""Near duplicates: SimHash by Golay keys first, then whatever fingerprints leave open.

Texts link if the Jaccard similarity of their sets of word shingles is ``least``
or more.

1. Fingerprints of the same shingles meet by Golay-code keys (``simhash.py``);
   of equal fingerprints each text meets the first, of fingerprints within two
   bits the first texts meet.

Fingerprints cannot vouch for a similarity: at 0.8 they lie about nine bits apart.
The rest is found exactly.  Similar sets have no choice but to meet in their
prefixes: with all shingles in one order, the first n - ceil(least n) + 1 of a set
of n.  So nodes (distinct sets) are filed under the shingles of their prefix, and
no pair is missed.  The order takes rare shingles first; it is free, so the common
ones need to be known only roughly.

2. Under each shingle the nodes outside the largest component of their size class
   meet one of its members.
3. Under shingles where several components still meet, pairs across components
   are met, the largest component with the others only, as far as sketches allow.

A sketch is a small map whose bits a set's shingles flip: two maps differ in no more
bits than their sets in shingles.  It sifts all meetings; in step 3 one of 256 bits
is part of the join itself.  What passes is verified on the texts, which lie in
buckets by node.  Hashes have 64 bits.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import RollingHash, cut, hashed_words, mix64, new_dir, sliced, spread_join, tidy, utf8, written
from .components import components
from .simhash import fingerprint, fingerprint_links

#: Common shingles that are ordered last at most; a matter of speed alone.
_COMMON = 1 << 16
#: Longs of the map that is part of a join.
_MAP = 4
#: Bytes of texts whose shingles a task holds at once; each takes about fifty bytes of arrays at worst, which workers keep.
_AT_ONCE = 1 << 18
#: Bits that the keys of prefixes do without: a false meeting is sifted like any other.
_SPARED = np.uint64(16)


def shingle_sets(texts: list[bytes | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of lower-cased texts, by text and value, and per text the index of its first (and the end).

    A text of fewer words is one shingle, one without words has none.
    """
    hashes, first = hashed_words([(t or b"").lower() for t in texts])
    n = np.diff(first)
    size = np.minimum(n, words)
    count = np.where(n > 0, n - size + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[doc]
    h = RollingHash(hashes).of(at, at + size[doc])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[fresh], np.concatenate(([0], np.cumsum(np.bincount(doc[fresh], minlength=len(n)))))


def node_hashes(texts: list[bytes | None], words: int) -> np.ndarray:
    """A hash of each text's set of shingles."""
    h, first = shingle_sets(texts, words)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(h), dtype=np.uint64)))
    return mix64(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def _nodes(docs: DataFrame, words: int) -> DataFrame:
    """row and node, a hash of the set of shingles."""

    @tidy
    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, size=_AT_ONCE):
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(node_hashes(utf8(b.column("text")), words))], ["row", "node"])

    kind = docs.schema["row"].dataType.simpleString()
    return docs.select("row", "text").mapInArrow(nodes, f"row {kind}, node long")


def _texts(docs: DataFrame, words: int) -> DataFrame:
    """node and text, one row a node, in buckets by node."""

    @tidy
    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, size=_AT_ONCE):
            yield pa.RecordBatch.from_arrays([pa.array(node_hashes(utf8(b.column("text")), words)), b.column("text")], ["node", "text"])

    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    once = docs.select("text").mapInArrow(nodes, "node long, text string").groupBy("node").agg(F.min("text").alias("text"))
    name = f"near_texts_{uuid.uuid4().hex}"
    once.write.bucketBy(n, "node").option("path", new_dir(spark, "near-texts")).saveAsTable(name)
    return spark.table(name)


def sketch(hashes: np.ndarray) -> bytes:
    """A bit map of a set: each hash flips one of about four bits a member."""
    bits = 1 << max(8, int(4 * len(hashes) - 1).bit_length())
    flips = np.bincount((hashes >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """How many members two sets differ in at least, by their sketches; the larger one is folded to the size of the other."""
    a, b = np.unpackbits(np.frombuffer(x, np.uint8)), np.unpackbits(np.frombuffer(y, np.uint8))
    if len(a) < len(b):
        a, b = b, a
    folded = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)
    return int((folded ^ b).sum())


def _folded(sketch: bytes) -> list[int]:
    """A sketch folded to a map of _MAP longs."""
    longs = np.frombuffer(sketch, np.int64)
    return np.bitwise_xor.reduce(longs.reshape(-1, _MAP), axis=0).tolist()


def _sketches(texts: DataFrame, words: int) -> DataFrame:
    """node, fingerprint of its text, n, sketch of its set and the sketch as a map of _MAP longs."""

    @tidy
    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, size=_AT_ONCE):
            given = utf8(b.column("text"))
            prints = np.fromiter((fingerprint(t, words) for t in given), np.uint64, b.num_rows)
            h, first = shingle_sets(given, words)
            maps = [sketch(h[s:e]) for s, e in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(prints.view(np.int64)), pa.array(np.diff(first).astype(np.int32)), pa.array(maps, pa.binary()), pa.array([_folded(m) for m in maps], pa.list_(pa.int64()))], ["node", "fingerprint", "n", "sketch", "map"])

    return texts.mapInArrow(sketches, "node long, fingerprint long, n int, sketch binary, map array<long>")


def _fingerprint_pairs(sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that the fingerprints of their texts suggest."""
    each = sketches.select("node", "fingerprint")
    firsts = cut(each.groupBy("fingerprint").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    same = spread_join(each, firsts.where("n > 1"), "fingerprint", each.count()).where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = fingerprint_links(firsts.select("fingerprint"), 2)
    for side in ("a", "b"):
        near = near.join(firsts.select(F.col("fingerprint").alias(side), F.col("first").alias(f"first_{side}")), side)
    return same.unionByName(near.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b")))


def _plausible(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sketches allow for the similarity."""

    @tidy
    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, size=_AT_ONCE):
            most = (1 - least) / (1 + least) * (b.column("na").to_numpy().astype(float) + b.column("nb").to_numpy()) + 1e-9
            keep = [least_difference(x, y) <= m for x, y, m in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), most, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda node, n, x: sketches.select(F.col("node").alias(node), F.col("n").alias(n), F.col("sketch").alias(x))
    met = pairs.join(of("b", "nb", "y"), "b").join(of("a", "na", "x"), "a")
    return met.select("a", "b", "na", "nb", "x", "y").mapInArrow(sift, "a long, b long")


def _common(texts: DataFrame, words: int) -> np.ndarray:
    """Shingles that batches hold often, the most common last."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            h, n = np.unique(shingle_sets(utf8(b.column("text")), words)[0], return_counts=True)
            often = n >= 4
            yield pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(n[often])], ["key", "n"])

    counted = texts.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = counted.orderBy(F.desc("n"), "key").limit(_COMMON).collect()
    return np.array([r.key for r in reversed(found)], np.int64).view(np.uint64)


def _prefixes(texts: DataFrame, words: int, least: float) -> DataFrame:
    """key, node, n and pos of the shingles in each node's prefix; n is the size of its set."""
    common = _common(texts, words)
    by_value = np.argsort(common)
    shared = texts.sparkSession.sparkContext.broadcast((common[by_value], (by_value + 1).astype(np.int32)))

    @tidy
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = shared.value
        for b in sliced(batches, size=_AT_ONCE):
            h, first = shingle_sets(utf8(b.column("text")), words)
            n = np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)
            late = np.zeros(len(h), np.int32)
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                late = np.where(known[at] == h, place[at], 0)
            order = np.lexsort((h, late, doc))
            pos = np.arange(len(h)) - first[doc]
            size = n - np.ceil(least * n - 1e-9).astype(np.int64) + 1
            kept = pos < size[doc]
            doc, node = doc[kept], b.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array((h[order][kept] >> _SPARED).view(np.int64)), pa.array(node[doc]), pa.array(n[doc].astype(np.int32)), pa.array(pos[kept].astype(np.int32))], ["key", "node", "n", "pos"])

    return texts.select("node", "text").mapInArrow(prefixes, "key long, node long, n int, pos int")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar."""

    @tidy
    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, size=_AT_ONCE):
            k = batch.num_rows
            h, first = shingle_sets(utf8(batch.column("x")) + utf8(batch.column("y")), words)
            keep = np.zeros(k, bool)
            for i in range(k):
                x, y = h[first[i] : first[i + 1]], h[first[k + i] : first[k + i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = both >= least * (len(x) + len(y) - both) - 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    one = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    two = one.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    return two.select("a", "b", "x", "y").mapInArrow(similar, "a long, b long")


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    return nodes.join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))


def _to_largest(met: DataFrame, rows: int, least: float) -> DataFrame:
    """Pairs (a, b): under each shingle and size class, a member of the largest component and each node outside it.

    The member is another one for each of four kinds of shingles.
    """
    choice = F.xxhash64(F.pmod("key", F.lit(4)), "node")
    own = met.groupBy("key", "class", "label").agg(F.count("*").alias("k"), F.min(F.struct(choice.alias("c"), "node", "n")).alias("head"))
    most = F.max(F.struct("k", "label", "head")).alias("top")
    tops = own.groupBy("key", "class").agg(most, F.sum("k").alias("n"), F.count("*").alias("labels")).where("labels > 1")
    tops = cut(tops.select("key", "class", F.col("top.label").alias("top"), F.col("top.head.node").alias("a"), F.col("top.head.n").alias("na"), "n"))
    met = met.select("key", "class", F.col("node").alias("b"), F.col("n").alias("nb"), "label")
    found = spread_join(met, tops, ["key", "class"], rows).where("label <> top")
    return found.where(F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9).select("a", "b").distinct()


def similar_texts(docs: DataFrame, *, words: int = 5, least: float = 0.8) -> DataFrame:
    """Groups of docs(row, text) by similarity: row and label; rows of one label are linked, directly or by others.

    Texts link if the Jaccard similarity of their sets of ``words``-word shingles is
    ``least`` or more.  Null, empty and blank texts have no shingle and link with
    each other.  row is an id; rows that share it have the same text.
    """
    each = cut(_nodes(docs, words))
    texts = _texts(docs, words)
    sketches = cut(_sketches(texts, words))
    verified = lambda pairs: cut(_verified(_plausible(pairs, sketches, least), texts, words, least))
    links = verified(_fingerprint_pairs(sketches))

    filed = _prefixes(texts, words, least)
    often = F.count("*").over(Window.partitionBy("key"))
    met = filed.withColumn("met", often).where("met > 1").drop("met").withColumn("class", F.floor(F.log("n") / math.log(1 / least)).cast("int"))
    met = written(met, "near-prefixes")
    labelled, rows = written(_labelled(met, links), "near-labels"), met.count()
    links = links.unionByName(verified(_to_largest(labelled, rows, least)))
    labelled = _labelled(met, links)

    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("key").agg(F.count("*").alias("labels"), F.max(F.struct("k", "label"))["label"].alias("largest")).where("labels > 1").select("key", "largest")
    mixed = labelled.join(largest, "key").join(sketches.select("node", "map"), "node")
    few = mixed.where("label <> largest").select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("label").alias("la"), F.col("map").alias("ma"))
    # What two sets can still share from their first common shingle on.
    rest = F.least(F.col("na") - F.col("pa"), F.col("n") - F.col("pos"))
    enough = rest >= least / (1 + least) * (F.col("na") + F.col("n")) - 1e-9
    close = F.least("na", "n") >= least * F.greatest("na", "n") - 1e-9
    apart = reduce(add, [F.bit_count(F.col("ma")[k].bitwiseXOR(F.col("map")[k])) for k in range(_MAP)])
    alike = apart <= (1 - least) / (1 + least) * (F.col("na") + F.col("n")) + 1e-9
    across = few.join(mixed, "key").where((F.col("la") != F.col("label")) & close & enough & alike)
    pairs = across.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    return _labelled(each, links.unionByName(verified(pairs))).select("row", "label")
