"""The engine's tables from the generic ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import index
from ..session import whole_texts
from .registry import Tables


def corpus(t: Tables) -> DataFrame:
    """Documents as source files: rel_path, content, doc_id, lang."""
    whole_texts(t.spark)
    ending = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".ts").when(F.col("lang") == "de", ".go").when(F.col("lang") == "es", ".md").otherwise(".txt")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ending)
    return t.documents.select("doc_id", path.alias("rel_path"), F.col("text").alias("content")).withColumn("lang", P.language(F.col("rel_path")))


def chunks(t: Tables) -> DataFrame:
    return index.line_chunks(corpus(t))


def questions(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def ledger(t: Tables) -> DataFrame:
    """Events as a ledger: user_id, ts, event_id, event_type, value, target (the number in props)."""
    return t.events.select("user_id", "ts", "event_id", "event_type", "value", F.get_json_object("props", "$.k").alias("target"))
