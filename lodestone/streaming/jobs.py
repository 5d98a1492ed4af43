"""Streams: incremental indexing, ledger sessions and rolling usage.

A stream of files never shows deletions; ``index.live`` over a fresh listing
removes them between batches.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators import index, parsing
from ..operators.versions import Change, Store, replace_files
from ..session import kept

LEDGER = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def ledger_stream(spark: SparkSession, folder: str, schema: str = LEDGER, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def sessions(events: DataFrame, *, gap: str = "8 hours", late: str = "1 day") -> DataFrame:
    """Sessions by inactivity; rows later than ``late`` are dropped with their state."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def rolling_usage(events: DataFrame, *, width: str = "1 hour", slide: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    """Counts and values by type in sliding windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def first_seen(events: DataFrame, *, late: str = "1 day") -> DataFrame:
    """Events once each, as long as repeats come within ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


class _Quiet(StatefulProcessor):
    """Keeps the last event of a path and lets it go when no other has come for a while."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "op string, at long, n long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        op, at, n = self.last.get() if self.last.exists() else (None, -1, 0)
        for part in rows:
            stamps = part["ts"].astype("int64") // (10**6 if "[ns" in str(part["ts"].dtype) else 10**3)
            n += len(part)
            latest = stamps.to_numpy().max()
            if latest >= at:
                at, op = int(latest), max(part["op"][stamps == latest])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((op, at, n))
        self.handle.registerTimer(at + self.quiet_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        op, at, n = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"path": [key[0]], "op": [op], "ts": pd.to_datetime([at], unit="ms"), "events": [n]})

    def close(self) -> None:
        pass


def settled(events: DataFrame, *, quiet_ms: int = 200, late: str = "1 second") -> DataFrame:
    """path, op, ts and events: what happened last to each path of events(path, op, ts) once it has been quiet for ``quiet_ms`` of event time.

    Every event of a path starts its time anew; events counts those taken together.
    Of events of one time the greatest op counts (remove, rename, write, create: in
    that order of letters the later ones).  Events later than ``late`` are dropped.
    The state store must be RocksDB.
    """
    grouped = events.select("path", "op", "ts").withWatermark("ts", late).groupBy("path")
    return grouped.transformWithStateInPandas(_Quiet(quiet_ms), "path string, op string, ts timestamp, events long", "Append", "EventTime")


def watch(changes: DataFrame, contents: Callable[[DataFrame], DataFrame], store: Store, checkpoint: str, *, name: str = "watch", trigger: dict | None = None) -> StreamingQuery:
    """Brings an index up to date with settled changes(path, op): new contents are parsed and chunked, removed paths go.

    contents(paths(rel_path)) reads rel_path and content of those that still exist.
    Each micro-batch is one version of the store and writes what it changes; one
    that runs again after a failure changes nothing.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        last = kept(batch.groupBy(F.col("path").alias("rel_path")).agg(F.max_by("op", F.struct("ts", "op")).alias("op")))
        read = kept(contents(last.where("op in ('create', 'write')").select("rel_path")))
        files = kept(index.file_table(read))
        sources = read.join(files.select("rel_path", "lang"), "rel_path")
        gone = last.where("op in ('remove', 'rename')").select("rel_path")
        replace_files(store, files, parsing.code_chunks(sources), removed=gone, stream=name, batch=batch_id)

    return changes.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def index_stream(contents: DataFrame, store: Store, checkpoint: str, *, name: str = "files") -> StreamingQuery:
    """Upserts micro-batches of contents(rel_path, content) into a store's table of files.

    Of several contents of a file in a batch the one with the latest modified counts
    (without that column the largest).  A batch writes its own files only, and
    counts once however often it runs.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        last = F.max_by("content", "modified") if "modified" in batch.columns else F.max("content")
        new = index.file_table(batch.groupBy("rel_path").agg(last.alias("content")))
        store.apply({"files": Change(new)}, stream=name, batch=batch_id)

    return contents.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Works off what is there into an in-memory table; for tests and small reports."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
