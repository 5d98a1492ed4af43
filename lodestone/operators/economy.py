"""What a search saves: its snippets against whole files that find as much."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import kept
from . import gates


def _met(texts: DataFrame, facts: DataFrame) -> DataFrame:
    """texts(query_id, ..., content) by fact, null where a text holds none of its question's."""
    each = texts.join(facts, "query_id").where(F.regexp_like("content", T.fact_pattern(F.col("fact")))).select("query_id", "pos", "fact").distinct()
    return texts.drop("content").join(each, ["query_id", "pos"], "left")


def arms(hits: DataFrame, chunks: DataFrame, files: DataFrame, facts: DataFrame) -> DataFrame:
    """Per question: snippet_tokens and found of its hits, facts in all, whole_tokens of the files that find as many, and reduction.

    hits(query_id, rank, rel_path, start_line, symbol), chunks with content and
    token_estimate, files(rel_path, content), facts(query_id, fact).  Files are read in
    the order of the hits until they hold as many facts as the snippets, one at least.
    reduction is null where the snippets hold no fact.
    """
    facts = kept(facts.where(F.trim("fact") != "").distinct())
    once = chunks.groupBy("rel_path", "start_line", "symbol").agg(F.min_by(F.struct("content", "token_estimate"), "pos").alias("c"))
    top = kept(hits.join(once, ["rel_path", "start_line", "symbol"]).select("query_id", F.col("rank").alias("pos"), "rel_path", "c.content", F.col("c.token_estimate").alias("tokens")))
    snippet = top.groupBy("query_id").agg(F.sum("tokens").alias("tokens")).join(_met(top, facts).groupBy("query_id").agg(F.countDistinct("fact").alias("facts")), "query_id")
    order = top.groupBy("query_id", "rel_path").agg(F.min("pos").alias("pos"))
    whole = order.join(files.select("rel_path", "content"), "rel_path").withColumn("tokens", T.token_estimate("content"))
    walked = gates.iso_recall(_met(whole, facts).select("query_id", "pos", "tokens", "fact"), snippet.select("query_id", "facts", "tokens"))
    told = facts.groupBy("query_id").agg(F.count("*").alias("n"))
    out = snippet.join(walked.select("query_id", "whole_tokens", "reduction"), "query_id").join(told, "query_id", "left")
    return out.select("query_id", F.col("tokens").alias("snippet_tokens"), F.col("facts").alias("found"), F.coalesce("n", F.lit(0)).alias("facts"), "whole_tokens", F.when(F.col("facts") > 0, F.col("reduction")).alias("reduction"))
