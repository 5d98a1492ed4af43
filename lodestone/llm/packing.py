"""Hierarchical packing of tokenised documents into context windows of several lengths.

Every partition packs its own documents, a block of ``block_tokens`` ids at a
time, so nothing is shuffled and memory is bounded.  In a block

1. whole windows of the longest tier are cut off each document; the rest is
   routed to the shortest tier that holds it;
2. from the longest tier down, each document opens a window of its tier and the
   gap is filled with the largest documents of shorter tiers that fit, the last
   of which is cut so that the window is exactly full;
3. what is left when no shorter document remains goes into ever shorter windows,
   each a power of two and exactly full, so no sequence needs padding;
4. sequences are dealt to step groups by longest-first so that each group has
   about the same number of tokens.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table, tidy
from .tokens import encoder, public_path

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())])
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class _Rests:
    """Unpacked rests (length, document, start) of at most ``longest`` ids, found by length in constant time."""

    def __init__(self, longest: int):
        self.of: list[list[tuple[int, int]]] = [[] for _ in range(longest + 1)]
        self.lengths = 0  # bit n is set if there is a rest of n ids

    def put(self, n: int, doc: int, at: int) -> None:
        self.of[n].append((doc, at))
        self.lengths |= 1 << n

    def take(self, n: int) -> tuple[int, int, int]:
        doc, at = self.of[n].pop()
        if not self.of[n]:
            self.lengths &= ~(1 << n)
        return n, doc, at

    def largest(self, most: int | None = None) -> int:
        """The largest length, of at most ``most``; 0 if there is none."""
        return max(0, (self.lengths if most is None else self.lengths & ((2 << most) - 1)).bit_length() - 1)

    def shortest(self) -> int:
        return (self.lengths & -self.lengths).bit_length() - 1


def pack_block(lengths: list[int], longest: int = 2048, shortest: int = 256) -> list[list[tuple[int, int, int]]]:
    """Packs documents of the given numbers of ids.

    Returns sequences, each a list of pieces (document, start, length) whose
    lengths add up to a power of two of at most ``longest``.
    """
    sequences: list[list[tuple[int, int, int]]] = []
    pool = _Rests(longest)
    for doc, n in enumerate(lengths):
        whole = n - n % longest
        sequences += [[(doc, at, longest)] for at in range(0, whole, longest)]
        if whole < n:
            pool.put(n - whole, doc, whole)
    left: list[tuple[int, int, int]] = []
    tier = longest
    while tier >= shortest:
        floor = tier // 2 if tier > shortest else 0
        while (n := pool.largest()) > floor:
            n, doc, at = pool.take(n)
            window, gap = [(doc, at, n)], tier - n
            while gap and pool.lengths:
                n = pool.largest(gap)
                if n:
                    n, doc, at = pool.take(n)
                    window.append((doc, at, n))
                    gap -= n
                else:  # nothing fits whole: the shortest is cut
                    n, doc, at = pool.take(pool.shortest())
                    window.append((doc, at, gap))
                    pool.put(n - gap, doc, at + gap)
                    gap = 0
            if gap:
                left += [(n, doc, at) for doc, at, n in window]
            else:
                sequences.append(window)
        tier //= 2
    rest = sum(n for n, _, _ in left)
    while rest:
        size = min(longest, 1 << (rest.bit_length() - 1))
        window, need = [], size
        while need:
            n, doc, at = left.pop()
            take = min(n, need)
            window.append((doc, at, take))
            if take < n:
                left.append((n - take, doc, at + take))
            need -= take
        sequences.append(window)
        rest -= size
    return sequences


def step_groups(sizes: list[int], step_tokens: int) -> list[int]:
    """Deals sequences to groups of about step_tokens: the longest first, each to the group with the fewest tokens."""
    groups = [(0, g) for g in range(max(1, round(sum(sizes) / step_tokens)))]
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        held, g = heapq.heappop(groups)
        out[k] = g
        heapq.heappush(groups, (held + sizes[k], g))
    return out


def pack_documents(docs: DataFrame, *, tokenizer: str, end_id: int = 1, longest: int = 2048, shortest: int = 256, block_tokens: int = 1 << 22, step_tokens: int = 1 << 17) -> DataFrame:
    """Packs docs(doc_id, text) into sequences; one row per piece.

    Columns: doc_id, start (the document's ids before the piece), length,
    ids_crc32, doc_tokens (with the end id), sequence_id, offset (in the
    sequence), tier (the sequence's length), step_group.

    Null texts count as empty and give the end id alone.  Rows with null or equal
    doc_id are packed as documents of their own.  A document longer than a block
    makes a block by itself.  Other columns are ignored; an empty table gives no
    row.  Ids of sequences and groups are unique over all partitions.
    """

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 40
        made = [0, 0]  # sequences and step groups so far
        held: list[tuple[int | None, bytes]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            sequences = pack_block([len(ids) // 4 for _, ids in held], longest, shortest)
            sizes = [sum(n for _, _, n in s) for s in sequences]
            groups = step_groups(sizes, step_tokens)
            columns: list[list] = [[] for _ in _SCHEMA]
            for k, (pieces, size) in enumerate(zip(sequences, sizes, strict=True)):
                offset = 0
                for doc, at, n in pieces:
                    doc_id, ids = held[doc]
                    row = (doc_id, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), len(ids) // 4, base + made[0] + k, offset, size, base + made[1] + groups[k])
                    for column, x in zip(columns, row, strict=True):
                        column.append(x)
                    offset += n
            made[0] += len(sequences)
            made[1] += max(groups, default=-1) + 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

        for batch in sliced(batches):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist()), strict=True):
                held.append((doc_id, ids + end))
                tokens += len(ids) // 4 + 1
                if tokens >= block_tokens:
                    yield flush()
                    held, tokens = [], 0
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, SCHEMA)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 2048 ids."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer=public_path(), end_id=1)
