"""Token-ID files: one zstandard frame per document and a trailing seek table.

A shard is

* a frame per document, in order, with zstandard's own content checksum;
* a skippable frame (magic 0x184D2A50) with the shard's directory: the id width
  in bytes and the documents' ids, themselves a zstandard frame;
* the seek table of the public Zstandard Seekable Format: a skippable frame with
  compressed size, decompressed size and checksum (low half of XXH64) of each
  frame, then frame count, descriptor and magic number.

Any zstandard decoder reads a shard whole; a reader that wants a few documents
seeks to the two tables at its end and decompresses those documents' frames.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_dir, sliced, table
from .tokens import encoder, public_path

#: Fixed values of the Zstandard Seekable Format.
SKIPPABLE_DIRECTORY = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
_NULL_ID = -(2**63)


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class ShardWriter:
    """Writes one shard under a name of its own and moves it into place when whole."""

    def __init__(self, path: str, width: int, level: int = 1):
        self.given, (self.fs, self.path) = path, _files(path)
        self.part = f"{self.path}.{os.getpid()}.{np.random.SeedSequence().entropy:x}.part"
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.part)
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.width, self.size, self.tokens = width, 0, 0
        self.doc_ids, self.entries = array("q"), array("I")

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: unsigned little-endian integers of the shard's width."""
        packed = self.zstd.compress(ids)
        self.out.write(packed)
        self.doc_ids.append(_NULL_ID if doc_id is None else doc_id)
        self.entries.extend((len(packed), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.tokens += len(ids) // self.width
        self.size += len(packed)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def close(self) -> None:
        directory = self.zstd.compress(struct.pack("<B", self.width) + np.array(self.doc_ids, "<i8").tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_DIRECTORY, len(directory)) + directory)
        seek = np.array(self.entries, "<u4").tobytes() + struct.pack("<IBI", len(self), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(seek)) + seek)
        self.out.close()
        self.fs.move(self.part, self.path)


class ShardReader:
    """Reads the tables of a shard and then only the frames asked for."""

    def __init__(self, path: str):
        fs, where = _files(path)
        self.file = fs.open_input_file(where)
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError(f"{path} has no seek table with checksums")
        at = end - 9 - n * _ENTRY.itemsize
        self.entries = np.frombuffer(self.file.read_at(n * _ENTRY.itemsize, at), _ENTRY)
        self.offsets = np.concatenate(([0], np.cumsum(self.entries["packed"], dtype=np.int64)))
        begin = int(self.offsets[-1])
        raw = self.file.read_at(at - 8 - begin, begin)
        if struct.unpack_from("<I", raw)[0] != SKIPPABLE_DIRECTORY:
            raise ValueError(f"{path} has no directory")
        self.zstd = zstandard.ZstdDecompressor()
        directory = self.zstd.decompress(raw[8:])
        self.width = directory[0]
        self.doc_ids = [None if x == _NULL_ID else x for x in np.frombuffer(directory, "<i8", n, 1).tolist()]
        self.counts = self.entries["plain"] // self.width

    def __len__(self) -> int:
        return len(self.entries)

    def _frame(self, k: int, packed: bytes) -> np.ndarray:
        plain = self.zstd.decompress(packed, max_output_size=max(1, int(self.entries["plain"][k])))
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.entries["check"][k]:
            raise ValueError(f"checksum of frame {k} differs")
        return np.frombuffer(plain, f"<u{self.width}")

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document; no other frame is read."""
        return self._frame(k, self.file.read_at(int(self.entries["packed"][k]), int(self.offsets[k])))

    def documents(self, span: int = 8 << 20) -> Iterator[np.ndarray]:
        """Ids of all documents in order, reading about span bytes at once."""
        k = 0
        while k < len(self):
            last = max(k + 1, int(np.searchsorted(self.offsets, self.offsets[k] + span, "right")) - 1)
            raw = memoryview(self.file.read_at(int(self.offsets[last] - self.offsets[k]), int(self.offsets[k])))
            for i in range(k, last):
                a = int(self.offsets[i] - self.offsets[k])
                yield self._frame(i, raw[a : a + int(self.entries["packed"][i])])
            k = last

    def close(self) -> None:
        self.file.close()


def _width(path: str) -> int:
    return 2 if encoder(path).tokenizer.get_vocab_size() <= 1 << 16 else 4


def write_token_files(docs: DataFrame, out_dir: str, *, tokenizer: str, end_id: int = 2, tasks: int | None = None, shard_bytes: int = 256 << 20, level: int = 1) -> DataFrame:
    """Encodes every document of docs(doc_id, text) and writes shards in ascending doc_id order.

    Documents are dealt by ranges of (doc_id, text hash) to ``tasks`` tasks
    (spark.sql.shuffle.partitions by default), equal rows to any of theirs; each
    writes its sorted range as a stream and begins a new shard after about
    ``shard_bytes``, so shards and their tables stay small at any size.  A task that
    runs again writes the same bytes under the same names.  Returns one row per
    shard (shard long, path string, n_docs, n_tokens, start long), start being the
    ids in the shards before it.

    Null texts count as empty; an empty text has end_id alone.  Null doc_ids come
    first; rows with equal doc_id stay apart, ordered by text.  Other columns are
    ignored.  An empty table gives no shard.
    """
    spark = docs.sparkSession
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    dealt = dealt.withColumn("any", F.rand(3).cast("float")).repartitionByRange(n, "doc_id", "tie", "any").sortWithinPartitions("doc_id", "tie", "text").drop("tie", "any")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, writer = TaskContext.get().partitionId(), 0, None
        enc, width = encoder(tokenizer), _width(tokenizer)
        end = np.array([end_id], "<u4").tobytes()

        def closed(shard: int) -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_pydict({"shard": pa.array([task << 32 | shard]), "path": [writer.given], "n_docs": [len(writer)], "n_tokens": [writer.tokens]})

        for batch in sliced(batches):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist()), strict=True):
                writer = writer or ShardWriter(f"{out_dir}/shard-{task:06d}-{made:06d}.zst", width, level)
                ids += end
                writer.add(doc_id, np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes() if width != 4 else ids)
                if writer.size >= shard_bytes:
                    yield closed(made)
                    made, writer = made + 1, None
        if writer:
            yield closed(made)

    done = sorted(dealt.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long").collect())
    start, rows = 0, []
    for shard, path, n_docs, n_tokens in done:
        rows.append((shard, path, n_docs, n_tokens, start))
        start += n_tokens
    return spark.createDataFrame(rows, "shard long, path string, n_docs long, n_tokens long, start long")


def read_token_files(shards: DataFrame) -> DataFrame:
    """Documents of shards as write_token_files returns them: doc_id, start, n_tokens (long) and ids (binary, unsigned little-endian 32-bit)."""
    return _read(shards, "doc_id long, start long, n_tokens long, ids binary", lambda ids: {"ids": ids})


def _read(shards: DataFrame, schema: str, of) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                reader, rows, held = ShardReader(path), [], 0
                for doc_id, ids in zip(reader.doc_ids, reader.documents(), strict=True):
                    raw = ids.astype("<u4").tobytes()
                    rows.append({"doc_id": doc_id, "start": start, "n_tokens": len(ids)} | of(raw))
                    start += len(ids)
                    held += len(raw)
                    if len(rows) >= 10_000 or held > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _arrow(schema))
                        rows, held = [], 0
                reader.close()
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _arrow(schema))

    n = shards.count()
    return shards.select("path", "start").repartition(max(1, n), "path").mapInArrow(read, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents and reads them back: doc_id, start, n_tokens, ids_crc32."""
    shards = write_token_files(table(spark, sf_dir, "documents"), new_dir(spark, "token-files"), tokenizer=public_path(), end_id=2)
    return _read(shards, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: {"ids_crc32": zlib.crc32(ids)})
