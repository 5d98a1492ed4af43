"""Prefix trie of conversations from the LCP array of their sorted order.

A conversation is the sequence of its turns' digests.  Different conversations are
sorted by range, so that each block of the order lies in one task; between
neighbours stands the length of their common prefix, LCP.  A node of the trie is a
longest interval of the order whose inner LCPs reach its depth: its ends are the
nearest smaller LCPs on either side, as in the Cartesian tree of the array.

* Inside a block the nearest smaller values are found with a stack.  Equal LCPs
  share a node, and depths that no LCP names (a lone branch) are nodes too.
* Nodes that reach over a block's edge are told apart by the minima of the blocks:
  one starts in the nearest block on the left whose least LCP is below its depth.
  The minima, one number a block, meet in one small task; the parts of a node in
  all blocks are then summed by (first block, depth).

The numbers of a node add up over parts: what a subtree saves is
sum(convs * words) - sum(words of nodes that start here).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import sliced, spread_join, table, written
from .sql import crc32

#: Bytes of a turn's digest.
_WIDTH = 16
#: conv_ids whose numbers agree but for so many bits are joined up before they move.
_ID_BITS = 12
_WORDS = r"[^\x20\x09-\x0D]+"
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame, *, family: int = 20) -> DataFrame:
    """conv_id, seq (the digests of the turns) and words (of each turn), a row a conversation.

    The first h = crc32(conv_id) % 4 turns of conversation c are those of
    c - c % family, its own follow from the h-th on.
    """
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c, role, text = F.col("conv_id"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        (c - c % family).cast("long").alias("base"), c.cast("long").alias("conv_id"), "turn",
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"), F.regexp_count(text, F.lit(_WORDS)).alias("words"),
    )
    listed = turns.repartition(n, "base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "words"))).alias("own"))
    first = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, 3)), ignorenulls=True).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    head = F.coalesce(F.slice(F.col("first"), F.lit(1), h), F.slice("own", 1, 0))
    every = listed.withColumn("first", first).select("conv_id", F.concat(head, F.slice("own", h + 1, F.size("own"))).alias("turns"))
    joined = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    return every.select("conv_id", joined.alias("seq"), F.transform("turns", lambda t: t["words"]).alias("words"))


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two sequences begin with alike."""
    n, k = min(len(a), len(b)) // _WIDTH, 0
    if a[: n * _WIDTH] == b[: n * _WIDTH]:
        return n
    while a[k * _WIDTH : (k + 1) * _WIDTH] == b[k * _WIDTH : (k + 1) * _WIDTH]:
        k += 1
    return k


def _sorted(conversations: DataFrame, partitions: int) -> DataFrame:
    """The different sequences in order, in blocks: block, pos, lcp (with the one before in the block), seq, words, conv_id (the least), n and ends, the hash of all conv_ids."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    near = conversations.groupBy("seq", F.shiftright("conv_id", _ID_BITS).alias("ids_at")).agg(F.first("words").alias("words"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), ids.alias("ids"))
    ordered = near.repartitionByRange(partitions, "seq").sortWithinPartitions("seq", "ids_at")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, pos, before, now, sha = TaskContext.get().partitionId(), 0, None, None, None
        rows: list[tuple] = []

        def close() -> None:
            nonlocal pos, before
            rows.append((block, pos, None if before is None else common_turns(before, now["seq"]), now["seq"], now["words"], now["conv_id"], now["n"], sha.hexdigest()))
            pos, before = pos + 1, now["seq"]

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return batch

        schema = pa.schema([("block", pa.int64()), ("pos", pa.int64()), ("lcp", pa.int32()), ("seq", pa.binary()), ("words", pa.list_(pa.int32())), ("conv_id", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])
        for b in sliced(batches, size=4 << 20):
            for row in b.to_pylist():
                if now is not None and now["seq"] == row["seq"]:
                    now["n"] += row["n"]
                    sha.update(f",{row['ids']}".encode())
                    continue
                if now is not None:
                    close()
                now, sha = row, hashlib.sha256(row["ids"].encode())
                if len(rows) >= 1000:
                    yield out()
        if now is not None:
            close()
        if rows:
            yield out()

    return ordered.mapInArrow(merged, "block long, pos long, lcp int, seq binary, words array<int>, conv_id long, n long, ends string")


def _borders(blocks: DataFrame) -> DataFrame:
    """block, left and right (LCPs over its edges, -1 at the ends of the order) and owners: for each depth up to left the block where the node starts.

    blocks(first, last, low, block), a row a block; low is the least LCP inside.
    """

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        stack: list[tuple[int, int]] = []  # (least LCP, block), rising: the nearest smaller minima

        def out(row: dict, right: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([row | {"right": right}], pa.schema([("block", pa.int64()), ("left", pa.int32()), ("right", pa.int32()), ("owners", pa.list_(pa.int64()))]))

        for b in sliced(batches):
            for row in b.to_pylist():
                left = -1 if last is None else common_turns(last, row["first"])
                if held is not None:
                    yield out(held, left)
                owners, k = [], len(stack) - 1
                for depth in range(left, -1, -1):
                    while stack[k][0] >= depth:
                        k -= 1
                    owners.append(stack[k][1])
                held, last = {"block": row["block"], "left": left, "owners": owners[::-1]}, row["last"]
                least = left if row["low"] is None else min(left, row["low"])
                while stack and stack[-1][0] >= least:
                    stack.pop()
                stack.append((least, row["block"]))
        if held is not None:
            yield out(held, -1)

    return blocks.coalesce(1).sortWithinPartitions("first").mapInArrow(borders, "block long, left int, right int, owners array<long>")


class _Open:
    """The nodes of a block, in parallel lists; ``whole`` ones touch no edge."""

    def __init__(self, block: int, right: int, owners: list[int]):
        self.block, self.right, self.owners = block, right, owners
        self.depth: list[int] = []
        self.words: list[int] = []
        self.starts: list[bool] = []
        self.conv: list[int | None] = []
        self.n: list[int] = []
        self.children: list[int] = []
        self.leaves: list[int] = []
        self.saved: list[int] = []
        self.ends: list[str | None] = []
        self.up: list[int] = []
        self.owner: list[int | None] = []
        self.stack: list[int] = []

    def push(self, words: int, starts: bool = True) -> int:
        k, up = len(self.depth), self.stack[-1] if self.stack else -1
        if starts and up >= 0:
            self.children[up] += 1
        for values, v in ((self.depth, len(self.stack)), (self.words, words), (self.starts, starts), (self.conv, None), (self.n, 0), (self.children, 0), (self.leaves, 0), (self.saved, 0), (self.ends, None), (self.up, up), (self.owner, None)):
            values.append(v)
        self.stack.append(k)
        return k

    def pop(self, at_end: bool = False) -> None:
        k = self.stack.pop()
        d, up = self.depth[k], self.up[k]
        goes_on = at_end and d <= self.right
        if self.starts[k] and not self.children[k] and not goes_on:
            self.leaves[k] = 1
        self.saved[k] += (self.n[k] - self.starts[k]) * self.words[k]
        if up >= 0:
            self.n[up] += self.n[k]
            self.leaves[up] += self.leaves[k]
            self.saved[up] += self.saved[k]
            if self.conv[up] is None or self.conv[k] < self.conv[up]:
                self.conv[up] = self.conv[k]
        if not self.starts[k]:
            self.owner[k] = self.owners[d]
        elif goes_on:
            self.owner[k] = self.block

    def rows(self) -> pa.Table:
        parent, parent_owner = [], []
        for k, up in enumerate(self.up):
            known = up >= 0 and self.starts[k]
            parent.append(self.conv[up] if known and self.owner[up] is None else None)
            parent_owner.append(self.owner[up] if known else None)
        columns = (self.owner, self.depth, self.conv, parent, parent_owner, self.n, self.children, self.leaves, self.saved, self.ends)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _NODES, strict=True)], schema=_NODES)


_NODES = pa.schema([("owner", pa.int64()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_owner", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string())])
_SUMMED = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def _nodes(sequences: pa.Table, border: pa.Table) -> pa.Table:
    """The nodes of one block, and the parts of those that reach over its edges."""
    if not sequences.num_rows:
        return _NODES.empty_table()
    edge = border.to_pylist()[0]
    block = _Open(edge["block"], edge["right"], edge["owners"])
    for b in sequences.sort_by("pos").to_batches(max_chunksize=1000):
        for row in b.to_pylist():
            if row["lcp"] is None:  # the first of the block goes on with what the block before has open
                for d in range(edge["left"] + 1):
                    block.push(row["words"][d - 1] if d else 0, starts=False)
            else:
                while len(block.stack) > row["lcp"] + 1:
                    block.pop()
            for d in range(len(block.stack), len(row["words"]) + 1):
                block.push(row["words"][d - 1] if d else 0)
            k = block.stack[-1]
            block.n[k], block.ends[k] = block.n[k] + row["n"], row["ends"]
            block.conv[k] = row["conv_id"] if block.conv[k] is None else min(block.conv[k], row["conv_id"])
    while block.stack:
        block.pop(at_end=True)
    return block.rows()


def _with_parents(nodes: DataFrame, spine: DataFrame) -> DataFrame:
    """nodes with parent_conv_id of the nodes of spine(owner, depth, conv_id, n_children) that they name."""
    facts = spine.select(F.col("owner").alias("parent_owner"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent"), F.col("n_children").alias("n"))
    return spread_join(nodes, facts, ["parent_owner", "depth"], nodes.count()).withColumn("parent_conv_id", F.col("parent")).drop("parent")


def prefix_trie(sequences: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """The nodes of the trie of sequences(conv_id, seq, words), one row a conversation.

    seq: 16 bytes a turn; words: the words of each turn.  Columns, long but for the
    last: conv_id (the smallest member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Equal conversations are one sequence; their conv_ids are joined up in groups of
    4,096 numbers before they move, and hashed as they stream by.  A task holds one
    block of the order, which ``partitions`` (spark.sql.shuffle.partitions by default)
    sets, and a sequence as a whole.  No row gives no node.
    """
    n = partitions or int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = written(_sorted(sequences, n), "ordered")
    blocks = ordered.groupBy("block").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.min("lcp").alias("low"))
    kind = "owner long, depth long, conv_id long, parent_conv_id long, parent_owner long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
    parts = written(ordered.groupBy("block").cogroup(_borders(blocks).groupBy("block")).applyInArrow(_nodes, kind), "nodes")
    spine = parts.where("owner is not null").groupBy("owner", "depth").agg(F.min("conv_id").alias("conv_id"), F.max("parent_owner").alias("parent_owner"), *(F.sum(c).alias(c) for c in _SUMMED), F.max("ends").alias("ends"))
    spine = written(spine.withColumn("parent_conv_id", F.lit(None).cast("long")), "spine")
    whole = parts.where("owner is null")
    below = F.col("parent_owner").isNotNull()
    nodes = whole.where(~below)
    for df in (spine.where(~below), _with_parents(whole.where(below), spine), _with_parents(spine.where(below), spine)):
        nodes = nodes.unionByName(df)
    return nodes.select("conv_id", "depth", "parent_conv_id", *_SUMMED, F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, *, family: int = 20, partitions: int | None = None) -> DataFrame:
    """The trie of conversations(conv_id, turn, role, text), rebuilt by families (see ``rebuilt`` and ``prefix_trie``).

    Turns are in order of turn, null first, equal ones in order of a digest of role
    and text; repeated rows are turns of their own.  Null role or text is empty;
    rows with a null conv_id belong to no conversation and go.  Other columns are
    ignored; an empty table gives no node.
    """
    return prefix_trie(written(rebuilt(conversations, family=family), "rebuilt"), partitions=partitions)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all conversations."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


def _key(column: Column | str, end: str) -> str:
    return f"array_to_string({column}[1:{end}], '')"


OP12_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, list(t ORDER BY turn NULLS FIRST, t) AS ts, list(w ORDER BY turn NULLS FIRST, t) AS ws, CAST({crc32("CAST(conv_id AS VARCHAR)")} % 4 AS INTEGER) AS h FROM turns GROUP BY conv_id
), built AS (
  SELECT c.conv_id, list_concat(coalesce(b.ts[1:c.h], []), c.ts[c.h + 1:]) AS ts, list_concat(coalesce(b.ws[1:c.h], []), c.ws[c.h + 1:]) AS ws
  FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20
), steps AS (
  SELECT conv_id, ts, ws, unnest(range(0, len(ts) + 1)) AS d FROM built
), nodes AS (
  SELECT d, {_key("ts", "d")} AS k, any_value(ts[1:d]) AS ts, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE any_value(ws[d]) END AS w,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(ts) = d), '')) AS ends_sha256
  FROM steps GROUP BY d, {_key("ts", "d")}
), children AS (
  SELECT d - 1 AS d, {_key("ts", "d - 1")} AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), numbered AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.d = n.d AND c.k = n.k
), above AS (
  SELECT ts, n_convs, w, n_children, unnest(range(0, d + 1)) AS d FROM numbered
), sums AS (
  SELECT d, {_key("ts", "d")} AS k, CAST(count(*) FILTER (WHERE n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * w) AS BIGINT) AS saved_tokens FROM above GROUP BY d, {_key("ts", "d")}
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM numbered n JOIN sums s ON s.d = n.d AND s.k = n.k LEFT JOIN nodes p ON p.d = n.d - 1 AND p.k = {_key("n.ts", "n.d - 1")}
"""
