"""Tables that are kept between runs: replaced, appended to without repeats, looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import clamp


def relation_table(relations: DataFrame) -> DataFrame:
    """The whole new table of relations(source, target, type), each once."""
    return relations.select("source", "target", "type").distinct()


def replace_table(rows: DataFrame, path: str) -> None:
    """Writes rows in place of what the folder holds; they must not come from it."""
    rows.write.mode("overwrite").parquet(path)


def clear(tables: dict[str, DataFrame], folder: str) -> None:
    """Empties the named tables of a folder and keeps their columns."""
    for name, df in tables.items():
        replace_table(df.limit(0), f"{folder}/{name}")


def metadata_value(metadata: DataFrame, key: str) -> DataFrame:
    """The value under a key of metadata(key, value); no row if there is none."""
    return metadata.where(F.col("key") == key).select("value")


def fixture_id(question: Column) -> Column:
    return F.substring(F.sha2(F.lower(F.trim(question)), 256), 1, 12)


def new_fixtures(found: DataFrame, existing: DataFrame) -> DataFrame:
    """id and question of found(question) that existing(id) does not hold; of equal ids the least question.  Nothing is overwritten."""
    once = found.groupBy(fixture_id(F.col("question")).alias("id")).agg(F.min("question").alias("question"))
    return once.join(existing.select("id"), "id", "left_anti")


def chunks_to_embed(chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """content_hash and content of chunks(content), each text once, without those in embedded(content_hash)."""
    once = chunks.select(F.sha2("content", 256).alias("content_hash"), "content").groupBy("content_hash").agg(F.min("content").alias("content"))
    return once.join(embedded.select("content_hash"), "content_hash", "left_anti")


def with_embeddings(rows: DataFrame, embeddings: DataFrame, key: str) -> DataFrame:
    """All rows with the embedding of their key, null where there is none."""
    return rows.join(embeddings.select(key, "embedding"), key, "left")


def resolved_hashes(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """content_hash, rel_path and start_line: the first chunk, by path and line, of each wanted(content_hash)."""
    met = chunks.join(wanted.select("content_hash").distinct(), "content_hash")
    return met.groupBy("content_hash").agg(F.min(F.struct("rel_path", "start_line")).alias("c")).select("content_hash", "c.rel_path", "c.start_line")


def kept_weights(given: DataFrame) -> DataFrame:
    """weights(name, value) as they are stored and loaded: within 0 and 60; null and NaN values go, so that defaults stand."""
    return given.where(F.col("value").isNotNull() & ~F.isnan("value")).select("name", clamp(F.col("value")).alias("value"))


def record_names(records: DataFrame) -> DataFrame:
    """records(ts, bundle_hash, pos) with the name that each is saved under: seconds, eight digits of the hash, and its place among equals."""
    return records.withColumn("name", F.concat(F.unix_timestamp("ts").cast("string"), F.lit("-"), F.substring("bundle_hash", 1, 8), F.lit("-"), F.lpad(F.lower(F.hex("pos")), 8, "0"), F.lit(".json")))


def newest(files: DataFrame, *by: str) -> DataFrame:
    """The path of files(path, modified) changed last; of equal times the least path."""
    last = F.max(F.struct("modified")).alias("m")
    top = files.groupBy(*by).agg(last).select(*by, F.col("m.modified").alias("modified"))
    return files.join(top, [*by, "modified"]).groupBy(*by).agg(F.min("path").alias("path"))


def index_is_stale(age_hours: Column) -> Column:
    """An index older than a day, or without a date, is read anew."""
    return F.coalesce(age_hours >= 24, F.lit(True))


def cache_is_fresh(index: Column, prompt: Column, prompt_bytes: Column, bundle: Column, bundle_bytes: Column) -> Column:
    """Prompt and bundle are there, not empty, and not older than the index."""
    return F.coalesce((prompt_bytes > 0) & (bundle_bytes > 0) & (prompt >= index) & (bundle >= index), F.lit(False))
