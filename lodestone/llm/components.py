"""Connected components by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Links that one task joins up by itself, a megabyte; more are contracted in rounds.
_SMALL = 1 << 16


def _large(edges: DataFrame) -> DataFrame:
    """Joins every larger neighbour of a node to the smallest one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Joins every smaller neighbour of a node, and the node, to the smallest one."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def joined_up(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        now = label.copy()
        np.minimum.at(now, label[a], least)
        np.minimum.at(now, label[b], least)
        now = now[now]
        if (now == label).all():
            return nodes, nodes[label]
        label = now


def _in_one_task(edges: DataFrame) -> DataFrame:
    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            nodes, label = joined_up(t.column("u").to_numpy(), t.column("v").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(label)], ["node", "label"])

    return edges.coalesce(1).mapInArrow(labels, "node long, label long")


def components(links: DataFrame, *, small: int = _SMALL) -> DataFrame:
    """Labels of the nodes of links(a long, b long): node, label, the smallest node reachable.

    Nodes without a link to another node are left out, as are links with a null
    end.  At most ``small`` different links are joined up in one task.  More take
    rounds of large and small stars, each checkpointed; their number grows with the
    logarithm of the longest chain.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.count() <= small:
        return _in_one_task(edges)
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        if now == mark:
            break
        mark = now
        edges = cut(_small(_large(edges)))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
