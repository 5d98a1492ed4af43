"""Benchmark decontamination by SimHash over item-sized windows.

Texts are lower-cased and cut into runs of letters, digits and non-ASCII
characters.  A window of as many words as an item can only resemble it if they
share a shingle, so windows are laid wherever one does; each gets a SimHash of
its shingles.  A multi-index over the items of that size finds every item within
17 bits: of six blocks of a fingerprint one at least then has two errors or none,
so an item is filed, for each block, under all values within two bits of its own,
and a window looks up its own six values.  About a fifth of the items of its size
come up for an unrelated window.  Each find is verified by the weighted Jaccard
similarity of the two bags of shingles.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RollingHash, hashed_words, sliced, table, tidy

_LETTERS = bytes(c if c >= 128 or chr(c).isalnum() else 0x20 for c in range(256))
_SEEN_BITS = 22


def normalised(text: str | None) -> bytes:
    return (text or "").lower().encode().translate(_LETTERS)


#: Errors that a block's lookup allows for.
_ERRORS = 2


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, bits) of the fewest blocks of a 64-bit fingerprint of which one at least has two errors at most within the radius."""
    n = radius // (_ERRORS + 1) + 1
    edges = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _near_values(bits: int) -> np.ndarray:
    """Differences of at most two bits."""
    return np.array([0, *(1 << a for a in range(bits)), *(1 << a | 1 << b for a in range(bits) for b in range(a))], np.uint64)


class BlockTable:
    """One block of the fingerprints: members by each value within two bits of theirs."""

    def __init__(self, prints: np.ndarray, shift: int, bits: int):
        self.shift, self.mask = np.uint64(shift), np.uint64((1 << bits) - 1)
        near = (((prints >> self.shift) & self.mask)[:, None] ^ _near_values(bits)).astype(np.int64)
        order = np.argsort(near.ravel(), kind="stable")
        self.members = (order // near.shape[1]).astype(np.int32)
        self.first = np.searchsorted(near.ravel()[order], np.arange((1 << bits) + 1)).astype(np.int32)

    def meet(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a print and a member."""
        value = ((prints >> self.shift) & self.mask).astype(np.int64)
        begin, n = self.first[value], self.first[value + 1] - self.first[value]
        k = np.repeat(np.arange(len(prints)), n)
        return k, self.members[np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + begin[k]]


class Items:
    """Shingles and fingerprints of a bounded number of benchmark items."""

    def __init__(self, ids: list[int], texts: list[str | None], shingle: int, radius: int):
        words, first = hashed_words([normalised(t) for t in texts])
        self.shingle, self.radius = shingle, radius
        self.bags: list[tuple[int, Counter]] = []  # by item: its id and bag
        self.sizes_of: dict[int, set[int]] = defaultdict(set)  # by shingle: sizes of the items that hold it
        members: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by size: items and fingerprints
        self.short: set[int] = set()  # sizes under a shingle
        rolling = RollingHash(words)
        for item, a, b in zip(ids, first[:-1].tolist(), first[1:].tolist(), strict=True):
            size = b - a
            if not size:
                continue
            k = min(shingle, size)
            at = np.arange(a, b - k + 1)
            hashes = rolling.of(at, at + k)
            for h in hashes.tolist():
                self.sizes_of[h].add(size)
            if size < shingle:
                self.short.add(size)
            members[size].append((len(self.bags), int(simhashes(hashes, np.zeros(1, np.int64), np.array([len(hashes)]))[0])))
            self.bags.append((item, Counter(hashes.tolist())))
        self.known = np.array(sorted(self.sizes_of), np.uint64)
        self.seen = np.zeros(1 << _SEEN_BITS, bool)
        self.seen[(self.known >> np.uint64(64 - _SEEN_BITS)).astype(np.int64)] = True
        self.index = {size: self._index(found) for size, found in members.items()}

    def _index(self, found: list[tuple[int, int]]):
        prints = np.array([f for _, f in found], np.uint64)
        return np.array([n for n, _ in found]), prints, [BlockTable(prints, shift, bits) for shift, bits in _blocks(self.radius)]

    def seeds(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of known shingles."""
        at = np.flatnonzero(self.seen[(hashes >> np.uint64(64 - _SEEN_BITS)).astype(np.int64)])
        return at[np.isin(hashes[at], self.known)]

    def near(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (k, item) of fingerprints within the radius."""
        items, own, tables = self.index[size]
        fresh, back = np.unique(prints, return_inverse=True)
        pairs = []
        for k in range(0, len(fresh), 4096):
            some = fresh[k : k + 4096]
            for t in tables:
                a, b = t.meet(some)
                hit = np.bitwise_count(some[a] ^ own[b]) <= self.radius
                pairs.append((a[hit] + k) * len(own) + b[hit])
        pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        # Back to all windows, several of which may share a fingerprint.
        at = np.searchsorted(pairs // len(own), np.arange(len(fresh) + 1))
        n = np.diff(at)[back]
        k = np.repeat(np.arange(len(prints)), n)
        pick = pairs[np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + at[back[k]]]
        return k, items[pick % len(own)]


def simhashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """SimHash of every slice [start, end) of hashes; a bit is set if it is in over half of them."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    total = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=total[1:])
    out = np.empty(len(start), np.uint64)
    for k in range(0, len(start), 1 << 15):
        a, b = start[k : k + (1 << 15)], end[k : k + (1 << 15)]
        out[k : k + (1 << 15)] = np.packbits(2 * (total[b] - total[a]) > (b - a)[:, None], axis=1).view(">u8").ravel()
    return out


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags."""
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def matches(hashes: np.ndarray, words: int, width: int, items: Items, least: float) -> dict[int, tuple[float, int, int]]:
    """Items that a document of so many words holds: similarity, first word and words of the best window.

    hashes: of the document's shingles of ``width`` words.
    """
    seeds = items.seeds(hashes)
    best: dict[int, tuple[float, int, int]] = {}
    by_size: dict[int, set[int]] = defaultdict(set)
    for s, h in zip(seeds.tolist(), hashes[seeds].tolist(), strict=True):
        for size in items.sizes_of[h]:
            if (size < items.shingle) == (width < items.shingle) and min(size, words) >= width:
                by_size[size].update(range(max(0, s + width - size), max(0, min(s, words - size)) + 1))
    for size, starts in by_size.items():
        start = np.array(sorted(starts))
        end = np.minimum(start + size, words) - width + 1
        low, high = int(start[0]), int(end.max())
        k, found = items.near(size, simhashes(hashes[low:high], start - low, end - low))
        for a, b, item in zip(start[k].tolist(), end[k].tolist(), found.tolist(), strict=True):
            item_id, bag = items.bags[item]
            alike = similarity(Counter(hashes[a:b].tolist()), bag)
            if alike >= least and (item_id not in best or (-alike, a) < (-best[item_id][0], best[item_id][1])):
                best[item_id] = (alike, a, min(size, words - a))
    return best


def contaminations(docs: DataFrame, benchmark: DataFrame, *, least: float = 0.8, shingle: int = 5, radius: int = 17, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """Passages of docs(doc_id, text) that resemble items of benchmark(item_id, text).

    One row per document and item with a window of weighted similarity ``least``
    or more: doc_id, item_id, similarity (double) and the best window, the first
    of equals: start (its first word) and length (long).

    Items go to the tasks in shares of at most about ``broadcast_bytes`` of text;
    the documents are read once for each share, so any benchmark fits.  Items
    under five words are one shingle.  A document shorter than an item is one
    window.  Null, empty and wordless texts match nothing, nor do items without
    id; rows with equal ids are rows of their own (of items the best counts).
    Windows over ``radius`` bits from an item are not compared with it; see the
    README for what the default finds.
    Other columns are ignored; empty tables give no row.
    """
    spark = docs.sparkSession
    given = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = given.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shares = -(-size // broadcast_bytes)
    schema = "doc_id long, item_id long, similarity double, start long, length long"
    out = spark.createDataFrame([], schema)
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for share in range(shares):
        rows = given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shares)) == share).collect()
        held = spark.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows]))
        found = asked.mapInArrow(_search(held, shingle, radius, least), schema)
        out = found if share == 0 else out.unionByName(found)
    return out


def _search(held, shingle: int, radius: int, least: float):
    @tidy
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*held.value, shingle, radius)
        for b in sliced(batches):
            out: dict[str, list] = {"doc_id": [], "item_id": [], "similarity": [], "start": [], "length": []}
            words, first = hashed_words([normalised(t) for t in b.column("text").to_pylist()])
            rolling = RollingHash(words)
            for width in (shingle, *sorted(items.short)):
                at = np.arange(max(0, len(words) - width + 1))
                hashes = rolling.of(at, at + width)
                # Documents without any known shingle are done with here.
                docs = np.unique(np.searchsorted(first, items.seeds(hashes), "right") - 1)
                for d in docs.tolist():
                    n = int(first[d + 1] - first[d])
                    if n < width:
                        continue
                    for item_id, (alike, start, length) in matches(hashes[first[d] : first[d + 1] - width + 1], n, width, items, least).items():
                        for column, x in zip(out.values(), (b.column("doc_id")[d].as_py(), item_id, alike, start, length), strict=True):
                            column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    return search


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the benchmark items that they hold."""
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
