"""Audits of answers: citations, drift, fact recall, grounding, and differences of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..session import spread


def cited(answers: DataFrame) -> DataFrame:
    """answer_id, citation, path and line of the distinct file references in answers(answer_id, text)."""
    each = answers.select("answer_id", F.explode(T.citations("text")).alias("citation"))
    line = F.regexp_extract("citation", ":([0-9]+)$", 1)
    return each.select("answer_id", "citation", F.regexp_replace("citation", ":[0-9]+$", "").alias("path"), F.when(line != "", line.try_cast("int")).alias("line"))


def validated(citations: DataFrame, fragments: DataFrame) -> DataFrame:
    """Adds valid and reason: the path is in the answer's bundle, or its name is there once.

    citations(answer_id, path, ...), fragments(answer_id, rel_path).
    """
    # Fragments are dealt out before they are gathered: they may all come from one task, and few of them are alike.
    dealt = spread(fragments.select("answer_id", P.base(F.col("rel_path")).alias("__name"), "rel_path"), "answer_id", "__name")
    names = dealt.groupBy("answer_id", "__name").agg(F.collect_set("rel_path").alias("__paths")).hint("merge")  # exploded lists look small to the planner, which would broadcast them
    out = citations.withColumn("__name", P.base(F.col("path"))).join(names, ["answer_id", "__name"], "left").withColumn("__n", F.size(F.coalesce("__paths", F.array().cast("array<string>"))))
    valid = F.coalesce(F.array_contains("__paths", F.col("path")), F.lit(False)) | (F.col("__n") == 1)
    reason = F.when(valid, "").when(F.col("__n") > 1, "ambiguous basename").otherwise("not in bundle")
    return out.withColumn("valid", valid).withColumn("reason", reason).drop("__paths", "__n", "__name")


def grounded_ratio(answers: DataFrame, checked: DataFrame) -> DataFrame:
    """answer_id and the share of valid citations, 1 where there is none."""
    share = checked.groupBy("answer_id").agg(F.avg(F.col("valid").cast("double")).alias("r"))
    return answers.select("answer_id").join(share, "answer_id", "left").select("answer_id", F.round(F.coalesce("r", F.lit(1.0)), 6).alias("grounded_ratio"))


def drift(answers: DataFrame, bundles: DataFrame) -> DataFrame:
    """known and unknown of the distinct code tokens of each answer, and the share unknown.

    answers(answer_id, text), bundles(answer_id, text).  Tokens are dotted names
    and code symbols; one is known if the answer's bundle has it, or it is a part
    of three bytes or more of a token there, whatever the case.
    """
    # Tokens stay in lists, one row an answer: each text is read once, where it lies, a bundle's only if its answer has a token, and no token is a row.
    asked = answers.where(F.col("answer_id").isNotNull()).select("answer_id", T.code_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    keys = F.array_sort(F.transform(F.flatten(F.collect_list("tokens")), F.lower))
    asked = asked.groupBy("answer_id").agg(keys.alias("keys")).where(F.size("keys") > 0)
    held = lambda words: F.transform(F.concat(words, F.flatten(F.transform(words, T.drift_parts))), F.lower)
    parts = T.let(F.array_distinct(T.extract_all(F.coalesce("text", F.lit("")), T.IDENTIFIER)), held)
    # Lists look small to the planner, which would broadcast them.
    met = asked.hint("merge").join(bundles.select("answer_id", "text"), "answer_id", "left").select("answer_id", "keys", F.array_intersect("keys", parts).alias("found"))
    found = met.groupBy("answer_id").agg(F.first("keys").alias("keys"), F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    # Tokens that differ in case alone share a key and count each.
    again = F.filter("keys", lambda x, k: (k > 0) & (x == F.get("keys", k - 1)))
    known = (F.size("found") + F.size(F.filter(again, lambda x: F.array_contains("found", x)))).cast("long")
    counted = found.select("answer_id", known.alias("known"), (F.size("keys") - known).alias("unknown"))
    every = answers.select("answer_id").join(counted, "answer_id", "left").na.fill(0, ["known", "unknown"])
    total = F.col("known") + F.col("unknown")
    return every.withColumn("drift_rate", F.round(F.when(total > 0, F.col("unknown") / total).otherwise(0.0), 6))


def fact_recall(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """answer_id, hits, n_facts and recall (1 without facts) of answers(answer_id, text) and facts(answer_id, fact)."""
    asked = facts.where(F.trim("fact") != "")
    checked = asked.join(answers, "answer_id").withColumn("hit", F.rlike(F.coalesce("text", F.lit("")), T.fact_pattern(F.col("fact"))).cast("int"))
    counted = checked.groupBy("answer_id").agg(F.sum("hit").alias("hits"), F.count("*").alias("n_facts"))
    every = answers.select("answer_id").join(counted, "answer_id", "left").na.fill(0)
    return every.withColumn("recall", F.round(F.when(F.col("n_facts") == 0, 1.0).otherwise(F.col("hits") / F.col("n_facts")), 6))


def set_differences(a: Column, b: Column) -> tuple[Column, Column]:
    """What b adds to a, and what it lacks, sorted."""
    return F.array_sort(F.array_except(b, a)), F.array_sort(F.array_except(a, b))


def journal_search(fields: DataFrame, needle: str, *, per_kind: int = 3, limit: int = 100) -> DataFrame:
    """Records with the needle in a field: record, score (summed weights), best first; of a kind the first matches count.

    fields(record, kind, pos, weight, text).
    """
    hits = fields.where(F.contains(F.lower("text"), F.lit(needle.lower())))
    counted = hits.withColumn("k", F.row_number().over(Window.partitionBy("record", "kind").orderBy("pos"))).where(F.col("k") <= per_kind)
    return counted.groupBy("record").agg(F.sum("weight").alias("score")).orderBy(F.desc("score"), F.desc("record")).limit(limit)


def audit_summary(records: DataFrame) -> DataFrame:
    """Means over records(model, grounded_ratio, drift_rate, n_facts, recall, used, whole), by model.

    recall counts only records with facts; the reduction is never negative.
    """
    out = records.groupBy("model").agg(
        F.count("*").alias("records"), F.round(F.avg("grounded_ratio"), 6).alias("grounded"), F.round(F.avg("drift_rate"), 6).alias("drift"),
        F.round(F.avg(F.when(F.col("n_facts") > 0, F.col("recall"))), 6).alias("recall"), F.sum("used").alias("used"), F.sum("whole").alias("whole"),
    )
    return out.withColumn("reduction", F.round(F.greatest(F.lit(0.0), F.when(F.col("whole") > 0, 1 - F.col("used") / F.col("whole")).otherwise(0.0)), 6))
