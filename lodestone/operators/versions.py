"""Several tables that change together, behind one manifest.

A change writes new folders only; then one manifest, moved into place, makes all of
them count at once.  A job that fails before that leaves the old state, and readers
see either the old or the new one.  A change of a table is a log: the rows that come
in and the keys whose earlier rows no longer count; so a batch writes in proportion
to what it changes.  After some changes a table is written anew.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Table:
    """Columns of a table, and those that name what a change replaces (a file's path for its chunks)."""

    schema: str
    keys: tuple[str, ...]


@dataclass
class Change:
    """Rows that come in, and further keys whose rows go; ``whole`` drops all earlier rows."""

    rows: DataFrame | None = None
    gone: DataFrame | None = None
    whole: bool = False


class Store:
    """Versioned tables in a folder of any file system that Spark reads.

    Manifests are numbered; two writers that start from the same one cannot both
    move theirs into place, and the later one fails.  ``stream`` and ``batch`` of a
    change are kept, so that a batch that runs again changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, Table], *, most_changes: int = 16):
        self.spark, self.folder, self.tables, self.most_changes = spark, folder.rstrip("/"), tables, most_changes
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        place = self._path(f"{self.folder}/manifests")
        if not self._fs.exists(place):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(place))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self) -> dict:
        """version, parts by table (each with rows and keys, null where there are none), and the last batch of each stream."""
        numbers = self._numbers()
        if not numbers:
            return {"version": 0, "parts": {}, "batches": {}}
        stream = self._fs.open(self._path(f"{self.folder}/manifests/{numbers[-1]}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, manifest: dict) -> None:
        mark = self._path(f"{self.folder}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(mark, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        there = self._path(f"{self.folder}/manifests/{manifest['version']}.json")
        if self._fs.exists(there) or not self._fs.rename(mark, there):
            self._fs.delete(mark, False)
            raise RuntimeError(f"version {manifest['version']} was written by another job")

    def _write(self, df: DataFrame, name: str) -> str:
        place = f"data/{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{place}")
        return place

    def read(self, name: str, manifest: dict | None = None) -> DataFrame:
        """The rows of a table that count now."""
        table = self.tables[name]
        parts = (manifest or self.manifest())["parts"].get(name, [])
        schema = StructType.fromDDL(table.schema)
        read = lambda place: self.spark.read.schema(schema).parquet(f"{self.folder}/{place}")
        rows = [read(p["rows"]).withColumn("__v", F.lit(k)) for k, p in enumerate(parts) if p["rows"]]
        if not rows:
            return self.spark.createDataFrame([], schema)
        every = rows[0]
        for df in rows[1:]:
            every = every.unionByName(df)
        keyed = StructType([schema[c] for c in table.keys])
        keys = [self.spark.read.schema(keyed).parquet(f"{self.folder}/{p['keys']}").withColumn("__last", F.lit(k)) for k, p in enumerate(parts) if p["keys"]]
        if keys:
            last = keys[0]
            for df in keys[1:]:
                last = last.unionByName(df)
            last = last.groupBy(*table.keys).agg(F.max("__last").alias("__last"))
            every = every.join(last, list(table.keys), "left").where(F.col("__v") >= F.coalesce("__last", F.lit(0)))
        return every.select(*schema.names)

    def apply(self, changes: dict[str, Change], *, stream: str | None = None, batch: int | None = None) -> bool:
        """Makes all changes count at once; False if the stream's batch has been applied before."""
        now = self.manifest()
        if stream is not None and batch is not None and now["batches"].get(stream, -1) >= batch:
            return False
        parts = {name: list(p) for name, p in now["parts"].items()}
        for name, change in changes.items():
            table, own = self.tables[name], [] if change.whole else parts.get(name, [])
            rows = keys = None
            if change.rows is not None:
                rows = self._write(change.rows.select(*StructType.fromDDL(table.schema).names), name)
            if own:
                written = [] if rows is None else [self.spark.read.parquet(f"{self.folder}/{rows}").select(*table.keys)]
                told = written + ([] if change.gone is None else [change.gone.select(*table.keys)])
                if told:
                    both = told[0] if len(told) == 1 else told[0].unionByName(told[1])
                    keys = self._write(both.distinct(), f"{name}-keys")
            parts[name] = [*own, {"rows": rows, "keys": keys}] if rows or keys else own
            if len(parts[name]) > self.most_changes:
                merged = self.read(name, {"parts": parts})
                parts[name] = [{"rows": self._write(merged, name), "keys": None}]
        batches = now["batches"] | ({stream: batch} if stream is not None and batch is not None else {})
        self._commit({"version": now["version"] + 1, "parts": parts, "batches": batches})
        return True

    def clear(self) -> None:
        """Empties all tables at once."""
        self.apply({name: Change(whole=True) for name in self.tables})

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the folders that none of the last ``keep`` manifests names, and older manifests; returns how many folders went.

        No writer may be at work, since its folders have no manifest yet.
        """
        numbers = self._numbers()
        if not numbers:
            return 0
        held: set[str] = set()
        for n in numbers[-keep:]:
            stream = self._fs.open(self._path(f"{self.folder}/manifests/{n}.json"))
            manifest = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            held |= {place for p in manifest["parts"].values() for part in p for place in part.values() if place}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/manifests/{n}.json"), False)
        gone = [s.getPath() for s in self._fs.listStatus(self._path(f"{self.folder}/data")) if f"data/{s.getPath().getName()}" not in held]
        for place in gone:
            self._fs.delete(place, True)
        return len(gone)


#: The tables of an index.
INDEX = {
    "files": Table("rel_path string, lang string, size long, lines int, checksum string", ("rel_path",)),
    "chunks": Table("rel_path string, pos int, chunk_id string, kind string, symbol string, start_line int, end_line int, content string, content_hash string, parent_id string, token_estimate int", ("rel_path",)),
    "relations": Table("source string, target string, type string", ("source",)),
    "embeddings": Table("content_hash string, embedding array<float>", ("content_hash",)),
}


def replace_files(store: Store, files: DataFrame, chunks: DataFrame, *, removed: DataFrame | None = None, relations: DataFrame | None = None, **batch) -> bool:
    """Puts files and all their chunks in place of the earlier ones and takes removed(rel_path) out, in one step.

    Embeddings that no chunk holds any longer go with them.  relations, if given,
    replaces the whole table; else those of files that are gone go.
    """
    touched = files.select("rel_path")
    gone = removed.select("rel_path") if removed is not None else None
    every = touched if gone is None else touched.unionByName(gone)
    old = store.read("chunks")
    left = old.join(every, "rel_path", "left_anti").select("content_hash").unionByName(chunks.select("content_hash"))
    orphans = old.join(every, "rel_path", "left_semi").select("content_hash").distinct().join(left, "content_hash", "left_anti")
    changes = {"files": Change(files, gone), "chunks": Change(chunks, every), "embeddings": Change(gone=orphans)}
    if relations is not None:
        changes["relations"] = Change(relations, whole=True)
    elif gone is not None:
        edges = store.read("relations")
        kept = edges.join(gone.select(F.col("rel_path").alias("source")), "source", "left_anti").join(gone.select(F.col("rel_path").alias("target")), "target", "left_anti")
        changes["relations"] = Change(kept, whole=True)
    return store.apply(changes, **batch)
