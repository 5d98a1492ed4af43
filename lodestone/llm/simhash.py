"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits.  The (23, 12)
Golay code is perfect: every 23-bit word is decoded to one of 4096 codewords, and
a segment's word and all words within a bit of it to at most six.  Three bit
errors spread over three segments in one of two ways:

* a segment is free of errors and another holds one at most.  Keys: the bits of
  the first with a codeword index of the second; a fingerprint is filed under its
  own index and looked up under those of the words within a bit, for each of the
  six ordered pairs of segments;
* every segment holds one.  Keys: three codeword indices.  The lookup takes those
  of the words within a bit of the first and third segment, the filing those
  within a bit of the second, so that neither side spreads over all three.

All keys have 33 bits or more, so chance meetings stay few among billions of
fingerprints; each meeting is verified on the fingerprints themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, sliced, spread_join, table, tidy, utf8
from .components import components

SEED = 42
#: Fixed value: generator polynomial of the (23, 12) Golay code.
GOLAY = 0b101011100011
#: (shift, bits) of the segments of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: (free of errors, one error at most).
PAIRS = ((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """SimHash of the lower-cased word shingles of a text, as an unsigned integer; 0 without words."""
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = list(accumulate(map(len, parts), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    if len(parts) < words:
        hashes = [digest(joined, SEED)]
    else:
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :])]
    set_bits = np.zeros(64, np.int64)
    h = np.array(hashes, ">u8")
    for k in range(0, len(h), 1 << 16):
        set_bits += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(h)).tobytes(), "big")


@cache
def golay_indices() -> np.ndarray:
    """Codeword index of every 23-bit word."""
    message = np.arange(1 << 12, dtype=np.uint32)
    rest = message << np.uint32(11)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> np.uint32(bit) & np.uint32(1), rest ^ np.uint32(GOLAY << (bit - 11)), rest)
    codewords = (message << np.uint32(11)) | rest
    out = np.empty(1 << 23, np.uint16)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            out[codewords ^ np.uint32(sum(1 << b for b in bits))] = message
    return out


def _indices(prints: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """The index of a segment, and those of all words within a bit of it (six columns, -1 where fewer)."""
    shift, bits = SEGMENTS[segment]
    word = (prints >> np.uint64(shift)).astype(np.uint32) & np.uint32((1 << bits) - 1)
    flips = np.array([0, *(1 << b for b in range(bits))], np.uint32)
    near = np.sort(golay_indices()[word[:, None] ^ flips].astype(np.int32), axis=1)
    fresh = np.ones(near.shape, bool)
    fresh[:, 1:] = near[:, 1:] != near[:, :-1]
    out = np.full((len(prints), 6), -1, np.int32)
    row, _ = np.nonzero(fresh)
    out[row, (np.cumsum(fresh, axis=1) - 1)[fresh]] = near[fresh]
    return golay_indices()[word].astype(np.int32), out


def golay_keys(prints: np.ndarray, bits: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which fingerprints are filed (n x 12) and looked up (n x 72), -1 where fewer.

    Up to two bits leave a segment free of errors, so that half of the keys do.
    """
    n = len(prints)
    own, near = zip(*(_indices(prints, s) for s in range(3)), strict=True)
    own, near = [x.astype(np.int64) for x in own], [x.astype(np.int64) for x in near]
    raw = [((prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64) for shift, bits in SEGMENTS]
    filed, sought = [], []
    for k, (exact, other) in enumerate(PAIRS):
        base = (k << 40) | (raw[exact] << 12)
        filed.append((base | own[other])[:, None])
        sought.append(np.where(near[other] >= 0, base[:, None] | near[other], -1))
    if bits < 3:
        return np.concatenate(filed, 1), np.concatenate(sought, 1)
    every = lambda a, b, c: np.where((a >= 0) & (b >= 0) & (c >= 0), (len(PAIRS) << 40) | (a << 24) | (b << 12) | c, -1).reshape(n, -1)
    flat = [x[:, None, None] for x in own]
    filed.append(every(flat[0], near[1][:, :, None], flat[2]))
    sought.append(every(near[0][:, :, None], flat[1], near[2][:, None, :]))
    return np.concatenate(filed, 1), np.concatenate(sought, 1)


def fingerprints(docs: DataFrame, *, words: int = 3) -> DataFrame:
    """doc_id and fingerprint (long, the unsigned bits) of docs(doc_id, text)."""

    @tidy
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = np.fromiter((fingerprint(t, words) for t in utf8(batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(prints, "doc_id long, fingerprint long")


def _keys(prints: DataFrame, sought: bool, bits: int) -> DataFrame:
    @tidy
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fingerprint").to_numpy()
            for k in range(0, len(values), 8192):
                some = values[k : k + 8192]
                found = golay_keys(some.view(np.uint64), bits)[sought]
                row, column = np.nonzero(found >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(found[row, column]), pa.array(some[row])], ["key", "fingerprint"])

    return prints.mapInArrow(keys, "key long, fingerprint long")


def fingerprint_links(prints: DataFrame, bits: int = 3) -> DataFrame:
    """Pairs a < b of the distinct fingerprints in prints(fingerprint long) at most ``bits`` (3 at most) bits apart."""
    if not 0 <= bits <= 3:
        raise ValueError("the segments guarantee pairs of at most three bits")
    filed = _keys(prints, False, bits).withColumnRenamed("fingerprint", "a")
    sought = _keys(prints, True, bits).withColumnRenamed("fingerprint", "b")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    return sought.join(filed.hint("shuffle_hash"), "key").where(close).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, *, words: int = 3, bits: int = 3) -> DataFrame:
    """Near-duplicate groups of docs(doc_id, text): doc_id, fingerprint (long), component_id.

    Documents link if their fingerprints differ in at most ``bits`` bits;
    component_id is the smallest doc_id reachable.  Copies share a fingerprint
    and are linked once, as one node.

    Null, empty and blank texts have fingerprint zero and link like any other.
    Repeated rows stay rows.  Rows with a null doc_id are kept, but name no
    component unless no other member has an id.  Other columns are ignored.
    """
    each = cut(fingerprints(docs, words=words))
    nodes = each.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    labels = components(fingerprint_links(nodes.select("fingerprint"), bits))
    labelled = nodes.join(labels.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("label", F.coalesce("label", "fingerprint"))
    named = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    facts = cut(labelled.join(named, "label").select("fingerprint", "component_id", "n"))
    return spread_join(each, facts, "fingerprint", each.count()).select("doc_id", "fingerprint", "component_id")


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")
