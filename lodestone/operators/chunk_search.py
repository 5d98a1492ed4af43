"""The chunk search: amounts of signals by question and chunk, folded into scores under any weights.

``features`` works each signal out once for each distinct symbol, path or kind and
brings all of them together by (question, chunk) in one aggregation.  ``ranked``
folds the amounts under weights, which may be columns, so that many candidates of
the tuner are scored from one table of features.
"""

from __future__ import annotations

from dataclasses import fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..session import kept
from . import search
from .search import SEEDS, SearchWeights

#: Signals of a chunk, and those of its file that all its chunks share.
OWN, SHARED = ("content", "symbol_met", "named", "kind_met", "similarity", "lines"), ("path", "filename", "exact", "partial", "imports")
#: Terms looked up as whole words, the most that imports add, the least similarity, and kinds that hold a body.
EXACT_TERMS, MOST_IMPORTS, LEAST_SIMILARITY = 12, 10.0, 0.18
BODIES = ("func", "export_func", "method", "nested_func", "get", "set")
#: Lines of a bin of the range join.
BIN = 64


def exact_chunks(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, rel_path and pos of chunks(rel_path, pos, start_line, end_line) on whose lines a hit(query_id, rel_path, line) lies.

    Chunks list the bins of lines that they reach into, hits the one they lie in, so
    long and nested ranges meet their hits by equality, and a file's rows are spread
    over its bins.
    """
    bins = F.sequence(F.floor(F.col("start_line") / BIN), F.floor(F.col("end_line") / BIN))
    reach = chunks.select("rel_path", "pos", "start_line", "end_line", F.explode(bins).alias("bin"))
    met = hits.withColumn("bin", F.floor(F.col("line") / BIN)).join(reach, ["rel_path", "bin"]).where("line between start_line and end_line")
    return met.select("query_id", "rel_path", "pos").distinct()


def first_terms(questions: DataFrame) -> DataFrame:
    """query_id and term of the first terms of each question, which are looked up as whole words."""
    return search.question_terms(questions).where(F.col("pos") < EXACT_TERMS).select("query_id", "term")


def lines_of(files: DataFrame) -> DataFrame:
    """rel_path, line and content of the lines of files(rel_path, content)."""
    return files.select("rel_path", F.posexplode(T.logical_lines("content")).alias("line", "content")).withColumn("line", F.col("line") + 1)


def _structure(symbols: DataFrame, imports: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, rel_path, signal and amount: symbols that are named in full and in part, and imports, of each file."""
    asked = terms.select("query_id", "term").distinct()

    def told(rows: DataFrame, column: str) -> DataFrame:
        values = rows.select("rel_path", F.col(column).alias("text"))
        pairs = search.matching(values, asked).withColumn("whole", F.arrays_overlap(T.variants("term"), T.variants(F.lower("text"))))
        return values.join(pairs.join(asked, "term").groupBy("query_id", "text").agg(F.max("whole").alias("whole")), "text")

    s = told(symbols, "name").select("query_id", "rel_path", F.when(F.col("whole"), "exact").otherwise("partial").alias("signal"))
    i = told(imports, "imp").select("query_id", "rel_path", F.lit("imports").alias("signal"))
    return s.unionByName(i).groupBy("query_id", "rel_path", "signal").agg(F.count("*").cast("double").alias("amount"))


def features(chunks: DataFrame, questions: DataFrame, *, symbols: DataFrame | None = None, imports: DataFrame | None = None, files: DataFrame | None = None, similar: DataFrame | None = None) -> DataFrame:
    """query_id, rel_path, pos and the amount of every signal, 0 where it is silent, of the pairs that some signal reaches.

    chunks(rel_path, pos, start_line, end_line, kind, symbol, content, token_estimate),
    pos from 0 in each file; questions(query_id, text).  Optional: symbols(rel_path,
    name) and imports(rel_path, imp) of the files, files(rel_path, content) for whole
    words on lines, similar(query_id, rel_path, pos, similarity).
    """
    terms = kept(search.question_terms(questions).select("query_id", "term"))
    key = ["query_id", "rel_path", "pos"]
    hits = search.content_hits(chunks.select(F.struct("rel_path", "pos").alias("key"), "content"), terms)
    meta = kept(chunks.drop("content"))  # all else is read without the texts
    texts = {"symbol": F.array("symbol"), "kind": F.array("kind"), "rel_path": F.array("rel_path", P.strip_extension(P.base(F.col("rel_path"))))}
    met = search.met_values(meta, terms, texts)
    named = search.equal_values(meta, terms, "symbol", F.array(F.lower(F.trim("symbol")), F.substring_index(F.lower(F.trim("symbol")), ".", -1)))
    filed = search.equal_values(meta, terms, "rel_path", search.name_parts(F.col("rel_path")))

    def of(df: DataFrame, signal: str, amount: Column | None = None, by: list[str] = key) -> DataFrame:
        return df.select(*by, F.lit(signal).alias("signal"), (F.lit(1.0) if amount is None else amount).cast("double").alias("amount"))

    value = lambda field: met.where(F.col("field") == field).select("query_id", F.col("value").alias(field))
    own = [
        of(hits.select("query_id", "key.*", "hits"), "content", F.least("hits", F.lit(3))),
        of(meta.select("rel_path", "pos", "symbol").join(value("symbol"), "symbol"), "symbol_met"),
        of(meta.select("rel_path", "pos", "symbol").join(named, "symbol"), "named"),
        of(meta.select("rel_path", "pos", "kind").join(value("kind"), "kind"), "kind_met"),
    ]
    if similar is not None:
        own.append(of(similar, "similarity", F.col("similarity")))
    if files is not None:
        own.append(of(exact_chunks(meta, search.exact_signal(lines_of(files), first_terms(questions))), "lines"))
    file = ["query_id", "rel_path"]
    shared = [of(value("rel_path"), "path", by=file), of(filed, "filename", by=file)]
    if symbols is not None and imports is not None:
        shared.append(_structure(symbols, imports, terms))
    spread = reduce(DataFrame.unionByName, shared).join(meta.select("rel_path", "pos"), "rel_path")
    every = reduce(DataFrame.unionByName, own).unionByName(spread)
    amounts = [F.coalesce(F.max(F.when(F.col("signal") == s, F.col("amount"))), F.lit(0.0)).alias(s) for s in (*OWN, *SHARED)]
    return every.groupBy(*key).agg(*amounts)


def points(c, w: SearchWeights, *, least, when, among):
    """Points of amounts ``c`` by name, before the working set and the graph; columns or arrays, as the functions are."""
    base = c("symbol_met") * w.symbol_match + c("named") * w.symbol_exact + c("path") * w.path + c("kind_met") * w.kind + c("content") * w.content
    base = base + when((c("kind") != "file") & (base > 0), w.chunk_scope, 0.0)
    base = base + when(among(c("kind"), BODIES) & (base > 0), w.impl_kind, 0.0)
    told = least(c("exact") * w.structural_symbol + c("partial") * w.structural_partial, w.structural_symbol)
    near = least(1 + (least(c("similarity"), 1.0) - LEAST_SIMILARITY) * w.semantic, w.semantic)
    return base + told + least(c("imports") * w.structural_import, MOST_IMPORTS) + when(c("similarity") >= LEAST_SIMILARITY, near, 0.0) + c("filename") * w.exact_filename + c("lines") * w.exact_content


def score(w: SearchWeights) -> Column:
    """Points of a row of features with its chunk's kind."""
    of = lambda x: x if isinstance(x, Column) else F.lit(x)
    return points(F.col, w, least=lambda a, b: F.least(of(a), of(b)), when=lambda test, a, b: F.when(test, a).otherwise(b), among=lambda c, values: c.isin(*values))


def _bridges(scored: DataFrame, wanted: DataFrame, meta: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Of each file of wanted(*by, rel_path) the first chunk without a score for that question, if it has one."""
    positive = scored.where("score > 0").join(wanted, [*by, "rel_path"], "left_semi").select(*by, "rel_path", "pos").distinct()
    place = F.row_number().over(Window.partitionBy(*by, "rel_path").orderBy("pos")) - 1
    led = positive.withColumn("__p", place).groupBy(*by, "rel_path").agg(F.sum((F.col("__p") == F.col("pos")).cast("int")).alias("pos"))
    first = wanted.join(led, [*by, "rel_path"], "left").withColumn("pos", F.coalesce("pos", F.lit(0)).cast("int"))
    return first.join(meta, ["rel_path", "pos"])


def _raised(scored: DataFrame, wanted: DataFrame, meta: DataFrame, weight: float | Column, by: tuple[str, ...]) -> DataFrame:
    """Adds a weight to the chunks with a score in the files of wanted, and to one more chunk of each such file."""
    columns = [c for c in scored.columns if c != "score"]
    files = wanted.select(*by, "rel_path").distinct().withColumn("__w", F.lit(True))
    held = scored.join(files, [*by, "rel_path"], "left").withColumn("score", F.col("score") + F.when(F.col("__w"), weight).otherwise(0.0))
    bridges = _bridges(scored, wanted, meta, by).withColumn("score", F.lit(weight).cast("double"))
    return held.select(*columns, "score").unionByName(bridges.select(*columns, "score")).where("score > 0")


def _asked(questions: DataFrame, candidates: list[SearchWeights] | None) -> tuple[DataFrame, list[str]]:
    """query_id, wants_tests and wants_legacy of questions, with candidates each of them by candidate and its weights; and the names of these."""
    asked = questions.select("query_id", T.wants_tests("text").alias("wants_tests"), T.wants_legacy("text").alias("wants_legacy"))
    return (asked, []) if candidates is None else (_each(asked, candidates), [f"w_{f.name}" for f in fields(SearchWeights)])


def _each(rows: DataFrame, candidates: list[SearchWeights]) -> DataFrame:
    """rows for each candidate, with its number and weights."""
    names = [f.name for f in fields(SearchWeights)]
    listed = F.array(*(F.struct(F.lit(k).alias("candidate"), *(F.lit(float(getattr(x, n))).alias(f"w_{n}") for n in names)) for k, x in enumerate(candidates)))
    return rows.withColumn("__c", F.explode(listed)).select("*", "__c.*").drop("__c")


def _columns() -> SearchWeights:
    """Weights that stand in columns."""
    return replace(SearchWeights(), **{f.name: F.col(f"w_{f.name}") for f in fields(SearchWeights)})


def related(scored: DataFrame, relations: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by and rel_path of the files that relations(source, target) tie to the first eight files of each question."""
    best = scored.groupBy(*by, "rel_path").agg(F.max("score").alias("s"))
    seeds = best.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("s"), "rel_path"))).where(F.col("k") <= SEEDS).select(*by, F.col("rel_path").alias("seed"))
    both = relations.select(F.col("source").alias("seed"), F.col("target").alias("rel_path")).unionByName(relations.select(F.col("target").alias("seed"), F.col("source").alias("rel_path")))
    return both.join(seeds, "seed").select(*by, "rel_path").distinct()


def finished(scored: DataFrame, questions: DataFrame, candidates: list[SearchWeights], limit: int) -> DataFrame:
    """The best of scored(candidate, query_id, rel_path, pos, start_line, symbol, kind, token_estimate, score) after all penalties."""
    by = ("candidate", "query_id")
    asked, _ = _asked(questions, candidates)
    whole = scored.join(asked, list(by))
    return search.finish(search.penalised(whole, _columns(), by).withColumn("score", F.round("score", 6)), limit, by=by)


def ranked(features: DataFrame, chunks: DataFrame, questions: DataFrame, weights: SearchWeights | None = None, *, changed: DataFrame | None = None, relations: DataFrame | None = None, limit: int = 8, candidates: list[SearchWeights] | None = None) -> DataFrame:
    """The best chunks of each question: query_id, rank, rel_path, start_line, symbol, score.

    In order: own signals, those of the file's structure, similarity, exact names and
    words; then the working set, the files of changed(rel_path); then files related
    (relations(source, target)) to the first eight; then long, tiny, test and legacy
    penalties.  Chunks without a score go; one symbol of a file stays once, and three
    chunks a file.  A changed or related file also brings its first chunk without a
    score.  With ``candidates`` all of them are ranked in one job, told apart by a
    column candidate.  ``file_search`` does the same over whole files of large tables.
    """
    by, w = ("query_id",), weights or SearchWeights()
    meta = kept(chunks.select("rel_path", "pos", "start_line", "symbol", "kind", "token_estimate"))
    rows = features.join(meta, ["rel_path", "pos"])
    asked, told = _asked(questions, candidates)
    if candidates is not None:
        by, rows, w = ("candidate", "query_id"), _each(rows, candidates), _columns()
    scored = rows.withColumn("score", score(w)).where("score > 0").select(*by, "rel_path", "pos", "start_line", "symbol", "kind", "token_estimate", *told, "score")
    mine = asked.select(*by, *told)
    if changed is not None:
        some = kept(changed.select(F.trim("rel_path").alias("rel_path")).where("rel_path <> ''").distinct())
        scored = _raised(scored, mine.crossJoin(some), meta, w.working_set, by)
    if relations is not None:
        scored = kept(scored)
        scored = _raised(scored, related(scored, relations, by).join(mine, list(by)), meta, w.graph, by)
    whole = scored.join(asked.drop(*told), list(by))
    return search.finish(search.penalised(whole, w, by).withColumn("score", F.round("score", 6)), limit, by=by)


def chunk_search(chunks: DataFrame, questions: DataFrame, weights: SearchWeights | None = None, limit: int = 8, *, changed: DataFrame | None = None, relations: DataFrame | None = None, **signals: DataFrame | None) -> DataFrame:
    """``features`` and ``ranked`` in one."""
    return ranked(kept(features(chunks, questions, **signals)), chunks, questions, weights, changed=changed, relations=relations, limit=limit)
