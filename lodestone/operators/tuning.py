"""Tuning of the search over one table of features.

Candidates of a weight are ranked together in one job, told apart by a column, from
features that are worked out once; the search itself is never repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import kept
from . import chunk_search, gates
from .file_search import FileSearch
from .search import SearchWeights

#: Shares that are kept after a penalty; other weights are points.
SHARES = ("test_keep", "tiny_keep", "legacy_keep")


def fact_places(chunks: DataFrame, facts: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, rel_path, start_line, symbol and fact of chunks reached by a question (asked: query_id, rel_path, pos) that hold one of its facts(query_id, fact)."""
    return held_facts(asked.join(chunks.select("rel_path", "pos", "start_line", "symbol", "content"), ["rel_path", "pos"]), facts)


def held_facts(texts: DataFrame, facts: DataFrame) -> DataFrame:
    """query_id, rel_path, start_line, symbol and fact of texts(query_id, rel_path, start_line, symbol, content) that hold one of the question's facts."""
    held = texts.join(facts.where(F.trim("fact") != ""), "query_id")
    return held.where(F.regexp_like("content", T.fact_pattern(F.col("fact")))).select("query_id", "rel_path", "start_line", "symbol", "fact").distinct()


@dataclass
class Evaluation:
    """What candidates are judged by: features, chunks, questions, their facts and where facts stand, and what else the search knows."""

    features: DataFrame
    chunks: DataFrame
    questions: DataFrame
    facts: DataFrame
    places: DataFrame
    changed: DataFrame | None = None
    relations: DataFrame | None = None
    limit: int = 8

    @classmethod
    def over(cls, features: DataFrame, chunks: DataFrame, questions: DataFrame, facts: DataFrame, **context) -> Evaluation:
        """Looks the facts up once, in all chunks that some signal, the working set or the graph can bring."""
        files = chunks.select("rel_path", "pos")
        reached = features.select("query_id", "rel_path", "pos")
        for name, columns in (("changed", ("rel_path",)), ("relations", ("source", "target"))):
            if context.get(name) is not None:
                for c in columns:
                    more = context[name].select(F.col(c).alias("rel_path")).distinct().join(files, "rel_path")
                    listed = questions.agg(F.collect_list("query_id").alias("l")).scalar()  # a stated set of questions
                    reached = reached.unionByName(more.withColumn("query_id", F.explode(listed)).select("query_id", "rel_path", "pos"))
        return cls(features, chunks, questions, facts, kept(fact_places(chunks, facts, reached.distinct())), **context)

    def scores(self, tries: list[SearchWeights]) -> list[tuple[float, float]]:
        """Mean share of facts found and mean tokens, taken negatively, of each candidate; questions without facts don't count."""
        hits = chunk_search.ranked(self.features, self.chunks, self.questions, candidates=tries, changed=self.changed, relations=self.relations, limit=self.limit)
        return judged(hits, self.chunks.select("rel_path", "start_line", "symbol", "token_estimate"), self.places, self.facts, len(tries))


def judged(hits: DataFrame, chunks: DataFrame, places: DataFrame, facts: DataFrame, candidates: int) -> list[tuple[float, float]]:
    """Mean share of facts found and mean tokens, taken negatively, of the hits of each candidate."""
    tokens = chunks.dropDuplicates(["rel_path", "start_line", "symbol"])
    found = hits.join(places, ["query_id", "rel_path", "start_line", "symbol"]).groupBy("candidate", "query_id").agg(F.countDistinct("fact").alias("n"))
    spent = hits.join(tokens, ["rel_path", "start_line", "symbol"]).groupBy("candidate").agg(F.sum("token_estimate").alias("tokens"))
    wanted = facts.where(F.trim("fact") != "").groupBy("query_id").agg(F.countDistinct("fact").alias("of"))
    n = max(1, wanted.count())
    recall = found.join(wanted, "query_id").groupBy("candidate").agg(F.sum(F.col("n") / F.col("of")).alias("recall"))
    rows = {r.candidate: (r.recall or 0.0, r.tokens or 0) for r in spent.join(recall, "candidate", "full").collect()}  # a row a candidate
    return [(round(rows.get(k, (0.0, 0))[0] / n, 6), -round(rows.get(k, (0.0, 0))[1] / n, 6)) for k in range(candidates)]


@dataclass
class FileEvaluation:
    """The same over a search of whole files: facts are looked up in the chunks of the hits alone.

    chunks(hits) gives rel_path, start_line, symbol, content and token_estimate of the files of hits(rel_path).
    """

    search: FileSearch
    chunks: Callable[[DataFrame], DataFrame]
    facts: DataFrame
    limit: int = 8

    def scores(self, tries: list[SearchWeights]) -> list[tuple[float, float]]:
        hits = kept(self.search.ranked(tries, self.limit))
        places = hits.select("query_id", "rel_path", "start_line", "symbol").distinct()
        met = kept(places.join(self.chunks(hits), ["rel_path", "start_line", "symbol"]))
        return judged(hits, met.select("rel_path", "start_line", "symbol", "token_estimate"), held_facts(met, self.facts), self.facts, len(tries))


def clamped(w: SearchWeights) -> SearchWeights:
    """Points within 0 and 60, shares within 0.05 and 1."""
    return replace(w, **{f.name: min(1.0, max(0.05, getattr(w, f.name))) if f.name in SHARES else min(60.0, max(0.0, getattr(w, f.name))) for f in fields(w)})


def tuned(evaluation: Evaluation, start: SearchWeights | None = None, *, names: tuple[str, ...] | None = None, passes: int = 2) -> tuple[SearchWeights, list[tuple[float, float]]]:
    """The weights that coordinate descent finds, and the score before it and after each pass.

    One weight after another is tried at multiples of its value; a candidate counts
    if it finds more facts, or as many with fewer tokens.
    """
    best = start or SearchWeights()
    names = names or tuple(f.name for f in fields(SearchWeights))
    (score,) = evaluation.scores([best])
    told = [score]
    for _ in range(passes):
        before = best
        for name in names:
            tries = [clamped(replace(best, **{name: v})) for v in gates.candidate_values(getattr(best, name))]
            for candidate, got in zip(tries, evaluation.scores(tries), strict=True):
                if got > score:
                    best, score = candidate, got
        told.append(score)
        if best == before:
            break
    return best, told
