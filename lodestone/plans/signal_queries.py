"""Queries of the ranker's and the search's further signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import search, signals
from ..session import kept, spread
from . import sql as S
from .registry import Tables, query
from .search_queries import _MIN, chunk_search_min
from .tables import corpus, questions

_IGNORED = ["# comment", "", "web/", "*7.py", "/forum/1*", "/books", "code/12.go", "news/?.ts"]


@query(f"""
WITH {S.FILES} SELECT rel_path, regexp_matches(rel_path, '(^|/)[^/]*7\\.py(/|$)') OR regexp_matches(rel_path, '^forum/1[^/]*$') OR starts_with(rel_path, 'forum/1*/') OR starts_with(rel_path, 'books/') OR starts_with(rel_path, 'web/')
  OR (contains(rel_path, 'code/12.go') AND strpos(rel_path, 'code/12.go') + 10 > length(rel_path) AND (strpos(rel_path, 'code/12.go') = 1 OR substr(rel_path, strpos(rel_path, 'code/12.go') - 1, 1) = '/')) AS ignored FROM files
""")
def ignored_paths(t: Tables) -> DataFrame:
    return corpus(t).select("rel_path", P.ignored(F.col("rel_path"), P.ignore_patterns("\n".join(_IGNORED))).alias("ignored"))


@query("""
WITH f AS (SELECT 'src/mod' || p_partkey || '.ts' AS rel_path, 'src/mod' || p_partkey AS stem, 'mod' || p_partkey AS name FROM part UNION ALL SELECT 'lib/' || p_partkey || '.go', 'lib/' || p_partkey, CAST(p_partkey AS VARCHAR) FROM part),
e AS (SELECT s_suppkey AS pos, CASE s_suppkey % 3 WHEN 0 THEN './dist/mod' || s_suppkey || '.js' WHEN 1 THEN 'lib/' || s_suppkey || '.js' ELSE 'src/mod' || (s_suppkey - 1) || '.ts' END AS entry,
  CASE s_suppkey % 3 WHEN 0 THEN 'dist/mod' || s_suppkey WHEN 1 THEN 'lib/' || s_suppkey ELSE 'src/mod' || (s_suppkey - 1) END AS stem, CASE s_suppkey % 3 WHEN 0 THEN 'mod' || s_suppkey WHEN 1 THEN CAST(s_suppkey AS VARCHAR) ELSE 'mod' || (s_suppkey - 1) END AS name FROM supplier)
SELECT rel_path, arg_min(entry, pos) AS entry FROM f JOIN e ON f.stem = e.stem OR (f.name = e.name AND strlen(f.name) >= 4 AND f.name <> 'index') GROUP BY rel_path
""")
def entry_points(t: Tables) -> DataFrame:
    key, k = F.col("p_partkey").cast("string"), F.col("s_suppkey")
    files = t.part.select(F.concat(F.lit("src/mod"), key, F.lit(".ts")).alias("rel_path")).unionByName(t.part.select(F.concat(F.lit("lib/"), key, F.lit(".go")).alias("rel_path")))
    entry = F.when(k % 3 == 0, F.concat(F.lit("./dist/mod"), k.cast("string"), F.lit(".js"))).when(k % 3 == 1, F.concat(F.lit("lib/"), k.cast("string"), F.lit(".js"))).otherwise(F.concat(F.lit("src/mod"), (k - 1).cast("string"), F.lit(".ts")))
    return signals.entry_points(files, t.supplier.select(k.alias("pos"), entry.alias("entry")))


_WORDS = "regexp_extract_all(lower(content), '[a-z]{3,}')"


@query(f"""
WITH {S.TERMS}, {S.FILES}, i AS (SELECT rel_path, unnest({_WORDS}[1:4]) AS imp FROM files), d AS (SELECT DISTINCT {_WORDS}[1] AS dep FROM files WHERE doc_id % 3 = 0 AND len({_WORDS}) > 0)
SELECT item_id AS query_id, rel_path, min(dep) AS dependency FROM terms JOIN d ON contains(dep, term) JOIN i ON imp = dep GROUP BY ALL
""")
def dependency_matches(t: Tables) -> DataFrame:
    words = F.regexp_extract_all(F.lower("content"), F.lit("[a-z]{3,}"), F.lit(0))
    files = corpus(t).select("doc_id", "rel_path", words.alias("w"))
    imports = files.select("rel_path", F.explode(F.slice("w", 1, 4)).alias("imp"))
    deps = files.where("doc_id % 3 = 0 and size(w) > 0").select(F.element_at("w", 1).alias("dep"))
    return signals.dependency_matches(imports, deps, search.question_terms(questions(t)))


_ALIASES = [("@app", "src/app"), ("@app/core", "core"), ("@lib", "packages/lib"), ("x1", "vendor/x1")]


@query(f"""
WITH i AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '@app/core/m' || p_partkey WHEN 1 THEN '@lib' WHEN 2 THEN '@library/x' WHEN 3 THEN 'x1/' || p_size ELSE '@app/m' || p_size END AS imp FROM part),
a AS (SELECT unnest({[a for a, _ in _ALIASES]}) AS alias, unnest({[b for _, b in _ALIASES]}) AS target),
m AS (SELECT imp, arg_min(target || substr(imp, length(alias) + 1), alias) AS resolved FROM (SELECT DISTINCT imp FROM i) JOIN a ON imp = alias OR starts_with(imp, alias || '/') GROUP BY imp)
SELECT p_partkey, imp, resolved FROM i LEFT JOIN m USING (imp)
""")
def resolved_aliases(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey").cast("string"), F.col("p_size")
    imp = F.when(size % 5 == 0, F.concat(F.lit("@app/core/m"), k)).when(size % 5 == 1, "@lib").when(size % 5 == 2, "@library/x").when(size % 5 == 3, F.concat(F.lit("x1/"), size.cast("string"))).otherwise(F.concat(F.lit("@app/m"), size.cast("string")))
    return signals.resolved_aliases(t.part.select("p_partkey", imp.alias("imp")), t.part.sparkSession.createDataFrame(_ALIASES, "alias string, target string"))


@query(f"""
WITH h AS ({_MIN}), {S.FILES}, i AS (SELECT rel_path, CASE doc_id % 4 WHEN 0 THEN './' || (doc_id + 1) WHEN 1 THEN 'Lib/' || (doc_id + 2) || '.spec.js' WHEN 2 THEN CAST(doc_id + 3 AS VARCHAR) ELSE 'a' || doc_id || '/b' END AS imp FROM files),
q AS (SELECT DISTINCT query_id, lower(imp) AS imp FROM h JOIN i USING (rel_path)), n AS (SELECT rel_path, lower(regexp_replace(split_part(rel_path, '/', -1), '\\.[^.]*$', '')) AS name FROM files)
SELECT query_id, rel_path, min(imp) AS imp FROM q JOIN n ON imp = name OR ends_with(imp, '/' || name) OR starts_with(imp, name || '.') OR contains(imp, '/' || name || '.') GROUP BY ALL
""")
def import_expansion(t: Tables) -> DataFrame:
    files, k = corpus(t), F.col("doc_id")
    text = lambda n: (k + n).cast("string")
    imp = F.when(k % 4 == 0, F.concat(F.lit("./"), text(1))).when(k % 4 == 1, F.concat(F.lit("Lib/"), text(2), F.lit(".spec.js"))).when(k % 4 == 2, text(3)).otherwise(F.concat(F.lit("a"), text(0), F.lit("/b")))
    return signals.import_expansion(chunk_search_min(t), files.select("rel_path", imp.alias("imp")), files.select("rel_path"))


_HINTS = f"""{S.TERMS}, {S.FILES},
s AS (SELECT rel_path, unnest(list_distinct({_WORDS}[1:12])) AS name FROM files), i AS (SELECT rel_path, unnest(list_distinct(list_transform({_WORDS}[20:24], lambda w: 'pkg/' || w || '.x'))) AS name FROM files),
v AS (SELECT DISTINCT name, lower(name) AS lo, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS co FROM (SELECT name FROM s UNION SELECT name FROM i)),
m AS (SELECT t.item_id, v.name, bool_or(v.lo = t.term OR v.co = t.term) AS whole FROM v JOIN terms t ON contains(v.lo, t.term) OR contains(v.co, t.term) GROUP BY ALL),
p AS (SELECT item_id, rel_path, CASE WHEN whole THEN 18.0 ELSE 3.0 END AS points, 1 AS s, 0 AS i FROM s JOIN m USING (name) UNION ALL SELECT item_id, rel_path, 2.0, 0, 1 FROM i JOIN m USING (name)),
g AS (SELECT item_id AS query_id, rel_path, CAST(sum(points) AS DOUBLE) AS score, CAST(sum(s) AS BIGINT) AS symbols, CAST(sum(i) AS BIGINT) AS imports FROM p GROUP BY ALL),
hints AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rel_path) AS INTEGER) AS rank, rel_path, score, symbols, imports FROM g)"""


def _hints(t: Tables) -> DataFrame:
    # A text is read no further than its 24th word, once: what follows is of no account to either list.
    head = F.regexp_extract(F.lower("content"), r"(?s)\A(?>.*?[a-z]{3,}+){0,24}", 0)
    files = kept(corpus(t).select("rel_path", F.regexp_extract_all(head, F.lit("[a-z]{3,}"), F.lit(0)).alias("w")))
    symbols = files.select("rel_path", F.explode(F.array_distinct(F.slice("w", 1, 12))).alias("name"))
    imports = files.select("rel_path", F.explode(F.array_distinct(F.transform(F.slice("w", 20, 5), lambda w: F.concat(F.lit("pkg/"), w, F.lit(".x"))))).alias("imp"))
    return signals.structural_hints(symbols, imports, search.question_terms(questions(t)))


@query(f"WITH {_HINTS} SELECT * FROM hints WHERE rank <= 8")
def structural_hints(t: Tables) -> DataFrame:
    return _hints(t)


@query(f"""
WITH {_HINTS}, q AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 'bundle' WHEN 1 THEN 'auto' END AS intent FROM benchmark)
SELECT query_id, CASE WHEN coalesce(intent, '') IN ('', 'unknown', 'auto', 'search') THEN CASE WHEN symbols > 0 AND score >= 6 THEN 'excerpt' ELSE 'search' END ELSE intent END AS route
FROM q LEFT JOIN (SELECT * FROM hints WHERE rank = 1) USING (query_id)
""")
def search_routes(t: Tables) -> DataFrame:
    intent = F.when(F.col("item_id") % 3 == 0, "bundle").when(F.col("item_id") % 3 == 1, "auto")
    return signals.routes(_hints(t), t.benchmark.select(F.col("item_id").alias("query_id"), intent.alias("intent")))


_CANDIDATES = "c AS (SELECT l_orderkey AS query_id, 'f' || (l_suppkey % 40) AS rel_path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey, l_suppkey) AS start_line, CASE WHEN l_quantity < 25 THEN 0.0 ELSE round(l_extendedprice / 10000, 2) END AS score FROM lineitem), b AS (SELECT *, score <= 0 AND row_number() OVER (PARTITION BY query_id, rel_path, score <= 0 ORDER BY start_line) = 1 AS bridge FROM c)"


def _candidates(t: Tables) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey"))
    score = F.when(F.col("l_quantity") < 25, 0.0).otherwise(F.round(F.col("l_extendedprice") / 10000, 2))
    rows = spread(t.lineitem.withColumnRenamed("l_orderkey", "query_id"), "query_id")
    return rows.select("query_id", F.concat(F.lit("f"), (F.col("l_suppkey") % 40).cast("string")).alias("rel_path"), pos.cast("long").alias("start_line"), score.alias("score"))


@query(f"""
WITH {_CANDIDATES}, w AS (SELECT DISTINCT 'f' || (s_suppkey % 40) AS rel_path FROM supplier WHERE s_acctbal < 0)
SELECT query_id, b.rel_path, start_line, round(score + CASE WHEN w.rel_path IS NOT NULL AND (score > 0 OR bridge) THEN 2.25 ELSE 0 END, 6) AS score FROM b LEFT JOIN w USING (rel_path)
""")
def working_set(t: Tables) -> DataFrame:
    changed = t.supplier.where("s_acctbal < 0").select(F.concat(F.lit("f"), (F.col("s_suppkey") % 40).cast("string"), F.lit(" ")).alias("rel_path"))
    return signals.working_set(_candidates(t), changed).withColumn("score", F.round("score", 6))


@query(f"""
WITH {_CANDIDATES}, r AS (SELECT DISTINCT 'f' || (s_suppkey % 40) AS source, 'f' || (s_nationkey % 40) AS target FROM supplier),
s AS (SELECT query_id, rel_path FROM (SELECT query_id, rel_path, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, rel_path) AS k FROM c WHERE score > 0 GROUP BY query_id, rel_path) WHERE k <= 8),
g AS (SELECT query_id, path, max(reason) AS reason FROM (SELECT query_id, target AS path, 'graph_dependency' AS reason FROM r JOIN s ON source = rel_path UNION ALL SELECT query_id, source, 'graph_dependent' FROM r JOIN s ON target = rel_path) GROUP BY ALL)
SELECT b.query_id, rel_path, start_line, round(score + CASE WHEN reason IS NOT NULL AND (score > 0 OR bridge) THEN 1.25 ELSE 0 END, 6) AS score, CASE WHEN score > 0 OR bridge THEN reason END AS reason FROM b LEFT JOIN g ON g.query_id = b.query_id AND g.path = b.rel_path
""")
def graph_boost(t: Tables) -> DataFrame:
    name = lambda c: F.concat(F.lit("f"), (F.col(c) % 40).cast("string"))
    relations = t.supplier.select(name("s_suppkey").alias("source"), name("s_nationkey").alias("target")).distinct()
    return signals.graph_boost(_candidates(t), relations).withColumn("score", F.round("score", 6))
