"""Signals of the file ranker and the chunk search beyond the words of a question.

Theta conditions on paths and imports are turned into keys that both sides list, so
that every match is an equality join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from .search import RANK_SEEDS, SEEDS, checked, word_hits


def _slashes(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def entry_points(files: DataFrame, entries: DataFrame) -> DataFrame:
    """rel_path and entry of files(rel_path) that are declared in entries(pos, entry): the first entry of the same path without its
    extension, or of the same name where that has four bytes or more and is not index."""

    def keyed(df: DataFrame, column: str) -> DataFrame:
        stem = F.regexp_replace(_slashes(F.col(column)), r"\.[^./]*$", "")
        name = P.base(stem)
        telling = (F.octet_length(name) >= 4) & (name != "index")
        keys = F.array(F.concat(F.lit("path:"), stem), F.when(telling, F.concat(F.lit("name:"), name)))
        return df.withColumn("key", F.explode(F.array_compact(keys)))

    met = keyed(files.select("rel_path"), "rel_path").join(keyed(entries, "entry"), "key")
    return met.groupBy("rel_path").agg(F.min_by("entry", F.struct("pos", "entry")).alias("entry"))


def dependency_matches(imports: DataFrame, dependencies: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, rel_path and dependency: the file imports exactly a declared dependency that a term of the question is part of.

    imports(rel_path, imp), dependencies(dep), terms(query_id, term); once a file, of several dependencies the least.
    """
    declared = dependencies.select(F.lower("dep").alias("dep")).distinct()
    named = word_hits(declared.select(F.col("dep").alias("key"), F.col("dep").alias("content")), terms).withColumnRenamed("key", "dep")
    asked = named.join(terms.select("query_id", "term").distinct(), "term").select("query_id", "dep").distinct()
    held = imports.select("rel_path", F.lower("imp").alias("dep")).distinct()
    return held.join(asked, "dep").groupBy("query_id", "rel_path").agg(F.min("dep").alias("dependency"))


def resolved_aliases(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds resolved to imports(imp): the path behind the first alias, by name, that the import is or begins with as whole steps; null without one."""
    steps = F.split("imp", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    each = imports.select("imp").distinct().withColumn("alias", F.explode(heads)).where("alias <> ''")
    found = each.join(aliases.select("alias", "target"), "alias")
    first = found.groupBy("imp").agg(F.min(F.struct("alias", "target")).alias("a"))
    path = F.concat(F.col("a.target"), F.substring(F.col("imp"), F.length(F.col("a.alias")) + 1, F.length("imp")))
    return imports.join(first.select("imp", path.alias("resolved")), "imp", "left")


def import_expansion(ranked: DataFrame, imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None, seeds: int = RANK_SEEDS) -> DataFrame:
    """query_id, rel_path and imp, the least import of the question's best files that names the file.

    ranked(query_id, rel_path, rank), imports(rel_path, imp).  An import names a file if one of its steps is the file's name without
    extension, followed by a dot, or by nothing in the last step.
    """
    given = imports.select("rel_path", "imp")
    if aliases is not None:
        both = resolved_aliases(given, aliases)
        given = both.select("rel_path", "imp").unionByName(both.where("resolved is not null").select("rel_path", F.col("resolved").alias("imp")))
    best = ranked.where(F.col("rank") <= seeds).select("query_id", "rel_path").distinct()
    asked = given.join(best, "rel_path").select("query_id", F.lower("imp").alias("imp")).distinct()
    names = asked.select("imp").distinct().select("imp", F.explode(_named(F.col("imp"))).alias("name"))
    own = files.select("rel_path", F.lower(P.strip_extension(P.base(F.col("rel_path")))).alias("name"))
    return asked.join(names.join(own, "name"), "imp").groupBy("query_id", "rel_path").agg(F.min("imp").alias("imp"))


def _named(imp: Column) -> Column:
    steps = F.split(imp, "/")
    before_dots = lambda s: F.transform(F.sequence(F.lit(1), F.size(F.split(s, r"\."))), lambda n: F.array_join(F.slice(F.split(s, r"\."), F.lit(1), n), "."))
    opened = F.flatten(F.transform(steps, lambda s: F.filter(before_dots(s), lambda b: F.length(b) < F.length(s))))
    return F.array_distinct(F.concat(opened, F.array(F.element_at(steps, -1))))


def _compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def structural_hints(symbols: DataFrame, imports: DataFrame, terms: DataFrame, limit: int = 8) -> DataFrame:
    """The files whose symbols and imports tell most of each question: query_id, rank, rel_path, score, symbols and imports (counts).

    symbols(rel_path, name), imports(rel_path, imp), a row for each of them, and terms(query_id, term).  A symbol is worth 18 if a term
    is its whole name, else 3, an import 2.  Best first, ties by path; ``limit`` is 20 at most.
    """
    limit = min(limit if limit > 0 else 8, 20)

    def met(rows: DataFrame, column: str) -> DataFrame:
        text = F.lower(F.trim(column))
        values = rows.select(F.col(column).alias("value")).distinct()
        readings = values.select("value", F.explode(F.array(F.lower(F.trim("value")), _compact(F.col("value")))).alias("content"))
        hits = word_hits(readings.select(F.col("value").alias("key"), "content"), terms).withColumnRenamed("key", "value")
        whole = (F.lower(F.trim("value")) == F.col("term")) | (_compact(F.col("value")) == F.col("term"))
        told = hits.join(terms.select("query_id", "term").distinct(), "term").groupBy("query_id", "value").agg(F.max(whole).alias("whole"))
        return rows.where(text != "").withColumnRenamed(column, "value").join(told, "value")

    found = met(symbols, "name").select("query_id", "rel_path", F.when(F.col("whole"), 18.0).otherwise(3.0).alias("points"), F.lit(1).alias("s"), F.lit(0).alias("i"))
    found = found.unionByName(met(imports, "imp").select("query_id", "rel_path", F.lit(2.0).alias("points"), F.lit(0).alias("s"), F.lit(1).alias("i")))
    scored = found.groupBy("query_id", "rel_path").agg(F.sum("points").alias("score"), F.sum("s").alias("symbols"), F.sum("i").alias("imports"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rel_path"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "rank", "rel_path", "score", "symbols", "imports")


def routes(hints: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id and route of questions(query_id, intent): an open search whose best file has symbols and six points is answered by an excerpt."""
    top = hints.where("rank = 1").select("query_id", ((F.col("symbols") > 0) & (F.col("score") >= 6)).alias("telling"))
    asked = questions.join(top, "query_id", "left")
    open_ = F.coalesce("intent", F.lit("")).isin("", "unknown", "auto", "search")
    return asked.select("query_id", F.when(open_ & F.coalesce("telling", F.lit(False)), "excerpt").when(open_, "search").otherwise(F.col("intent")).alias("route"))


def _bridges(candidates: DataFrame) -> DataFrame:
    """Adds bridge: the first candidate of its file and question without a score."""
    none = F.col("score") <= 0
    first = F.row_number().over(Window.partitionBy("query_id", "rel_path", none).orderBy("start_line"))
    return candidates.withColumn("bridge", none & (first == 1))


def working_set(candidates: DataFrame, changed: DataFrame, weight: float = 2.25) -> DataFrame:
    """candidates(query_id, rel_path, start_line, score) with ``weight`` on those of changed(rel_path) that score, and on one of each other changed file."""
    touched = changed.select(F.trim("rel_path").alias("rel_path")).where("rel_path <> ''").distinct().withColumn("touched", F.lit(True))
    marked = _bridges(candidates).join(touched, "rel_path", "left")
    hit = F.coalesce("touched", F.lit(False)) & ((F.col("score") > 0) | F.col("bridge"))
    return marked.withColumn("score", F.col("score") + F.when(hit, weight).otherwise(0.0)).drop("touched", "bridge")


def graph_boost(candidates: DataFrame, relations: DataFrame, weight: float = 1.25, seeds: int = SEEDS) -> DataFrame:
    """candidates with ``weight`` and a reason on those related to the best files of their question, as working_set has it.

    relations(source, target).  Seeds are the first files by score, path and line.  A file on both ends of relations counts as dependent.
    """
    question, file = Window.partitionBy("query_id"), Window.partitionBy("query_id", "rel_path")
    best = _bridges(candidates).withColumn("s", F.max(F.when(F.col("score") > 0, F.col("score"))).over(file)).withColumn("once", F.row_number().over(file.orderBy("start_line")) == 1)
    rank = F.dense_rank().over(question.orderBy(F.desc_nulls_last("s"), "rel_path"))
    chosen = F.when((rank <= seeds) & F.col("s").isNotNull() & F.col("query_id").isNotNull(), F.col("rel_path"))
    asked = best.withColumn("chosen", chosen).withColumn("seeds", F.collect_set("chosen").over(question)).drop("chosen", "s")
    # Each file of a question meets its seeds once, on one of its rows; a pair has one relation at most.
    met = asked.select("*", F.posexplode_outer(F.when(F.col("once"), F.col("seeds"))).alias("place", "seed"))
    both = relations.select(F.col("source").alias("seed"), F.col("target").alias("rel_path"), F.lit("graph_dependency").alias("reason"))
    both = both.unionByName(relations.select(F.col("target").alias("seed"), F.col("source").alias("rel_path"), F.lit("graph_dependent").alias("reason")))
    pairs = checked(both.groupBy("seed", "rel_path").agg(F.max("reason").alias("reason")), 200_000)
    told = met.join(pairs, ["seed", "rel_path"], "left").withColumn("reason", F.max("reason").over(file)).where(F.coalesce("place", F.lit(0)) == 0)
    hit = F.col("reason").isNotNull() & ((F.col("score") > 0) | F.col("bridge"))
    marked = told.withColumn("score", F.col("score") + F.when(hit, weight).otherwise(0.0)).withColumn("reason", F.when(hit, F.col("reason")))
    return marked.select(*candidates.columns, "reason")
