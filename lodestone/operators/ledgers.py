"""Ledgers: sessions, islands, latest rows, digests, retention and their summaries."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def consolidate(entries: DataFrame, key: str, order: list[str], *same: str) -> DataFrame:
    """Runs of entries of a key with equal ``same`` columns as one row: those columns, first and last ts, and n."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = reduce(or_, [~F.col(c).eqNullSafe(F.lag(c).over(w)) for c in same]) | (F.row_number().over(w) == 1)
    runs = entries.withColumn("island", F.sum(changed.cast("int")).over(w))
    return runs.groupBy(key, "island", *same).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


def sessions(entries: DataFrame, key: str, gap: str = "8 hours") -> DataFrame:
    """Sessions of a key by inactivity."""
    return entries.groupBy(F.col(key), F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("s")


def latest(entries: DataFrame, key: str, order: list[str], *columns: str) -> DataFrame:
    """The last row of each key."""
    return entries.groupBy(key).agg(*[F.max_by(c, F.struct(*order)).alias(c) for c in columns])


def as_of(feedback: DataFrame, usage: DataFrame, key: str) -> DataFrame:
    """Each feedback row with the last usage of its key at or before it: adds usage_id (null if none).

    Both sides are ordered together in one window, so no row meets all others of its key.
    """
    left = feedback.select(key, "ts", F.col("event_id").alias("event_id"), F.lit(1).alias("side"))
    right = usage.select(key, "ts", F.col("event_id").alias("event_id"), F.lit(0).alias("side"))
    w = Window.partitionBy(key).orderBy("ts", "side", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("side") == 0, F.col("event_id")), ignorenulls=True).over(w)
    return left.unionByName(right).withColumn("usage_id", seen).where("side = 1").select(key, "ts", "event_id", "usage_id")


def pending(entries: DataFrame, key: str, action: str, touch: str) -> DataFrame:
    """Actions not done: rows of the ``action`` type at the key's last such time whose target no later ``touch`` row names.

    entries(key, ts, event_type, target).
    """
    last = entries.where(F.col("event_type") == action).groupBy(key).agg(F.max("ts").alias("__at"))
    asked = entries.where(F.col("event_type") == action).join(last, key).where(F.col("ts") == F.col("__at")).select(key, "target", "ts")
    touched = entries.where(F.col("event_type") == touch).join(last, key).where(F.col("ts") >= F.col("__at")).select(key, "target").distinct()
    return asked.join(touched, [key, "target"], "left_anti")


def digest(entries: DataFrame, key: str) -> DataFrame:
    """Attempts, failures and decisions of each key of entries(key, command, outcome)."""
    decided = (F.col("command") == "decision") | (F.lower("outcome") == "decided")
    attempt = ~decided & (F.col("command") != "next_actions")
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    return entries.groupBy(key).agg(count(attempt).alias("attempts"), count(attempt & T.outcome_failed("outcome")).alias("failures"), count(decided).alias("decisions"))


def retained(entries: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Entries not older than so many days."""
    return entries.where(F.col("ts") >= F.expr(f"timestamp'{now}' - interval {days} days"))


def search(entries: DataFrame, term: str, *columns: str) -> DataFrame:
    """Entries with the term in one of the columns, whatever the case."""
    return entries.where(reduce(or_, [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(term.lower())) for c in columns]))


def usage_summary(entries: DataFrame, key: str) -> DataFrame:
    """Tokens of each key of entries(key, seq, phase, path, mode, tokens, baseline): initial and expansion, paths, modes in the order met, and the share of the baseline."""
    modes = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "mode"))), lambda s: s["mode"])), ",")
    initial = F.sum(F.when(F.col("phase") == "initial", F.col("tokens")).otherwise(0))
    out = entries.groupBy(key).agg(initial.alias("initial_tokens"), (F.sum("tokens") - initial).alias("expansion_tokens"), F.count_distinct("path").alias("paths"), modes.alias("modes"), F.sum("baseline").alias("baseline"))
    total = F.col("initial_tokens") + F.col("expansion_tokens")
    return out.withColumn("share", F.round(F.when(F.col("baseline") > 0, total / F.col("baseline")).otherwise(0.0), 6))


def grounding_summary(events: DataFrame, *by: str) -> DataFrame:
    """Edits and answers, how many are grounded, mean drift, of events(kind, in_context, grounded_ratio, drift_rate).

    An edit is grounded in a file of its context, an answer with half its
    citations valid and less than half its tokens unknown.
    """
    edit = F.col("kind") == "edit"
    grounded = F.when(edit, F.col("in_context")).otherwise((F.col("grounded_ratio") >= 0.5) & (F.col("drift_rate") < 0.5))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    return events.groupBy(*by).agg(F.count("*").alias("events"), n(edit).alias("edits"), n(grounded).alias("grounded"), n(~grounded).alias("concerning"), F.round(F.avg("drift_rate"), 6).alias("mean_drift"))


def proxy_savings(logs: DataFrame) -> DataFrame:
    """saved and usd of logs(model, before, after): tokens saved at the model's rate, never negative."""
    rate = F.when(F.contains(F.lower("model"), F.lit("gpt")), 2.5).otherwise(3.0)
    saved = F.greatest(F.lit(0), F.col("before") - F.col("after"))
    return logs.withColumn("saved", saved).withColumn("usd", F.round(saved * rate / 1e6, 9))
