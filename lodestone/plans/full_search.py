"""The whole chunk search over the documents as source files, and its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import chunk_search, economy, file_search, parsing, search, tuning
from ..operators.chunk_search import LEAST_SIMILARITY
from ..operators.search import SearchWeights
from ..session import kept
from . import sql as S
from .registry import Tables, query
from .sources import CHUNKS_SQL, SOURCES_SQL, SYMBOLS_SQL, source_files
from .tables import questions

_STEM = "regexp_replace(split_part(rel_path, '/', -1), '[.][^.]*$', '')"
_NUMBERED = "numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY rel_path ORDER BY start_line, chunk_id) - 1 AS INTEGER) AS pos, CAST(ceil(strlen(content) / 4.0) AS INTEGER) AS token_estimate FROM chunks)"
_LINES = f"""first_terms AS (
  SELECT item_id, unnest(list_slice({S.ordered_distinct("l")}, 1, 12)) AS term FROM asked
), contents AS (
  SELECT rel_path, regexp_replace(string_agg(seg, '' ORDER BY k), chr(10) || '$', '') AS content FROM segments GROUP BY rel_path
), file_lines AS (
  SELECT rel_path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM contents
), line_words AS (
  SELECT DISTINCT rel_path, line, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM file_lines
), line_hits AS (
  SELECT DISTINCT t.item_id, w.rel_path, w.line FROM line_words w JOIN first_terms t USING (term)
), exact_chunks AS (
  SELECT DISTINCT h.item_id, c.rel_path, c.pos FROM line_hits h JOIN numbered c ON c.rel_path = h.rel_path AND h.line BETWEEN c.start_line AND c.end_line
)"""


def _chunks(t: Tables) -> tuple[DataFrame, DataFrame]:
    files = kept(source_files(t).select("rel_path", "lang", "content"))  # made once for parsers, lines and whole files
    return files, kept(parsing.code_chunks(files).select("rel_path", "pos", "chunk_id", "start_line", "end_line", "kind", "symbol", "content", "token_estimate"))


@query(f"""
WITH {S.TERMS}, {SOURCES_SQL}, {CHUNKS_SQL}, {_NUMBERED}, {_LINES}
SELECT e.item_id AS query_id, e.rel_path, c.chunk_id FROM exact_chunks e JOIN numbered c USING (rel_path, pos)
""")
def exact_chunks(t: Tables) -> DataFrame:
    """Chunks of several lines that hold one of the first terms of a question as a whole word."""
    files, chunks = _chunks(t)
    hits = search.exact_signal(chunk_search.lines_of(files), chunk_search.first_terms(questions(t)))
    return chunk_search.exact_chunks(chunks, hits).join(chunks.select("rel_path", "pos", "chunk_id"), ["rel_path", "pos"]).select("query_id", "rel_path", "chunk_id")


def _paths(t: Tables) -> DataFrame:
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".ts").when(F.col("lang") == "de", ".go").when(F.col("lang") == "es", ".md").otherwise(".txt"))
    return t.documents.select("doc_id", name.alias("rel_path"))


def _context(t: Tables) -> dict[str, DataFrame]:
    """What a search knows beside the texts: files at work (those marked toxic), relations (each file and the next), and similar files (their first chunks)."""
    paths = _paths(t)
    changed = paths.join(t.labels.where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi").select("rel_path")
    relations = paths.select(F.col("rel_path").alias("source"), (F.col("doc_id") + 1).alias("doc_id")).join(paths.select("doc_id", F.col("rel_path").alias("target")), "doc_id").select("source", "target")
    vectors = t.embeddings.select("vec_id", "embedding")
    asked = vectors.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")
    met = V.similar(vectors, asked, LEAST_SIMILARITY, 6).where("query_id <> vec_id")
    similar = met.join(paths.select(F.col("doc_id").alias("vec_id"), "rel_path"), "vec_id").select("query_id", "rel_path", F.lit(0).alias("pos"), "similarity")
    return {"changed": changed, "relations": relations, "similar": similar}


def _search(t: Tables) -> file_search.FileSearch:
    return file_search.FileSearch.over(source_files(t, dealt=True), questions(t), **_context(t))


def _hit_chunks(t: Tables, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files of hits(rel_path), and their chunks: only these are made and parsed again."""
    named = search.checked(hits.select("rel_path").distinct(), 100_000)
    files = kept(source_files(t, only=named).select("rel_path", "lang", "content"))
    return files, parsing.code_chunks(files).select("rel_path", "pos", "start_line", "symbol", "content", "token_estimate")


#: Every pair of a question and a chunk with its score, step by step.
SEARCH_SQL = f"""{S.TERMS}, {SOURCES_SQL}, {SYMBOLS_SQL}, {CHUNKS_SQL}, {_NUMBERED}, {_LINES}, every_import AS (
  SELECT DISTINCT rel_path, imp FROM imports
), texts AS (
  SELECT 'symbol' AS field, symbol AS value, symbol AS text FROM chunks UNION SELECT 'kind', kind, kind FROM chunks UNION SELECT 'path', rel_path, rel_path FROM docs UNION SELECT 'path', rel_path, {_STEM} FROM docs
  UNION SELECT 'name', name, name FROM symbols UNION SELECT 'imp', imp, imp FROM imports
), variants AS (
  SELECT DISTINCT field, value, v FROM (SELECT field, value, lower(text) AS v FROM texts UNION ALL SELECT field, value, {S.stem("text")} FROM texts) WHERE strlen(v) >= 3
), met AS (
  SELECT f.item_id, v.field, v.value, max(CASE WHEN v.v = f.form THEN 1 ELSE 0 END) AS whole FROM variants v JOIN forms f ON contains(v.v, f.form) OR contains(f.form, v.v) GROUP BY ALL
), named AS (
  SELECT DISTINCT t.item_id, c.symbol FROM (SELECT DISTINCT symbol FROM chunks) c JOIN terms t ON t.term = lower(trim(symbol)) OR t.term = split_part(lower(trim(symbol)), '.', -1)
), name_parts AS MATERIALIZED (
  SELECT rel_path, lower(split_part(rel_path, '/', -1)) AS part FROM docs UNION SELECT rel_path, lower({_STEM}) FROM docs UNION SELECT rel_path, unnest(list_filter(regexp_split_to_array(lower({_STEM}), '[^a-z0-9]+'), lambda p: length(p) >= 3)) FROM docs
), filed AS (
  SELECT DISTINCT t.item_id, p.rel_path FROM name_parts p JOIN terms t ON t.term = p.part
), hits AS (
  SELECT f.item_id, c.rel_path, c.pos, least(count(DISTINCT f.term), 3) AS n FROM numbered c JOIN forms f ON contains(lower(c.content), f.form) GROUP BY ALL
), told AS (
  SELECT m.item_id, s.rel_path, sum(m.whole) AS exact, sum(1 - m.whole) AS partial FROM symbols s JOIN met m ON m.field = 'name' AND m.value = s.name GROUP BY ALL
), imported AS (
  SELECT m.item_id, i.rel_path, count(*) AS n FROM every_import i JOIN met m ON m.field = 'imp' AND m.value = i.imp GROUP BY ALL
), vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), near AS (
  SELECT q.vec_id AS item_id, d.rel_path, 0 AS pos, round(list_inner_product(q.e, v.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(v.e, v.e))), 6) AS sim
  FROM vectors q JOIN benchmark b ON b.item_id = q.vec_id JOIN vectors v ON v.vec_id <> q.vec_id JOIN docs d ON d.doc_id = v.vec_id
), base AS (
  SELECT b.item_id, c.rel_path, c.pos, c.start_line, c.symbol, c.kind, c.token_estimate,
    CASE WHEN s.item_id IS NULL THEN 0 ELSE 8.0 END + CASE WHEN n.item_id IS NULL THEN 0 ELSE 6.0 END + CASE WHEN p.item_id IS NULL THEN 0 ELSE 3.0 END + CASE WHEN k.item_id IS NULL THEN 0 ELSE 1.0 END + coalesce(h.n, 0) * 2.0 AS score,
    least(coalesce(t.exact, 0) * 18.0 + coalesce(t.partial, 0) * 3.0, 18.0) + least(coalesce(i.n, 0) * 2.0, 10.0) + CASE WHEN r.sim >= 0.18 THEN least(1 + (r.sim - 0.18) * 8.0, 8.0) ELSE 0 END
      + CASE WHEN f.item_id IS NULL THEN 0 ELSE 4.25 END + CASE WHEN e.item_id IS NULL THEN 0 ELSE 3.75 END AS more
  FROM benchmark b JOIN numbered c ON true
  LEFT JOIN met s ON s.item_id = b.item_id AND s.field = 'symbol' AND s.value = c.symbol LEFT JOIN named n ON n.item_id = b.item_id AND n.symbol = c.symbol
  LEFT JOIN met p ON p.item_id = b.item_id AND p.field = 'path' AND p.value = c.rel_path LEFT JOIN met k ON k.item_id = b.item_id AND k.field = 'kind' AND k.value = c.kind
  LEFT JOIN hits h ON h.item_id = b.item_id AND h.rel_path = c.rel_path AND h.pos = c.pos LEFT JOIN told t ON t.item_id = b.item_id AND t.rel_path = c.rel_path LEFT JOIN imported i ON i.item_id = b.item_id AND i.rel_path = c.rel_path
  LEFT JOIN near r ON r.item_id = b.item_id AND r.rel_path = c.rel_path AND r.pos = c.pos AND r.sim >= 0.18 LEFT JOIN filed f ON f.item_id = b.item_id AND f.rel_path = c.rel_path LEFT JOIN exact_chunks e ON e.item_id = b.item_id AND e.rel_path = c.rel_path AND e.pos = c.pos
), own AS (
  SELECT * EXCLUDE (score, more), CAST(score + CASE WHEN kind <> 'file' AND score > 0 THEN 0.5 ELSE 0 END + more AS DOUBLE) AS score FROM base
), working AS (
  SELECT o.* EXCLUDE (score), score + CASE WHEN d.rel_path IS NOT NULL AND (score > 0 OR o.pos = min(CASE WHEN score <= 0 THEN o.pos END) OVER (PARTITION BY item_id, o.rel_path)) THEN 2.25 ELSE 0 END AS score
  FROM own o LEFT JOIN (SELECT DISTINCT d.rel_path FROM docs d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1) d ON d.rel_path = o.rel_path
), seeds AS (
  SELECT item_id, rel_path FROM (SELECT item_id, rel_path, row_number() OVER (PARTITION BY item_id ORDER BY max(score) DESC, rel_path) AS k FROM working WHERE score > 0 GROUP BY item_id, rel_path) WHERE k <= 8
), edges AS (
  SELECT a.rel_path AS source, b.rel_path AS target FROM docs a JOIN docs b ON b.doc_id = a.doc_id + 1
), related AS (
  SELECT s.item_id, e.target AS rel_path FROM seeds s JOIN edges e ON e.source = s.rel_path UNION SELECT s.item_id, e.source FROM seeds s JOIN edges e ON e.target = s.rel_path
), graphed AS (
  SELECT w.* EXCLUDE (score), score + CASE WHEN r.rel_path IS NOT NULL AND (score > 0 OR w.pos = min(CASE WHEN score <= 0 THEN w.pos END) OVER (PARTITION BY w.item_id, w.rel_path)) THEN 1.25 ELSE 0 END AS score
  FROM working w LEFT JOIN related r ON r.item_id = w.item_id AND r.rel_path = w.rel_path
), positive AS (
  SELECT *, min(CASE WHEN token_estimate > 0 THEN token_estimate END) OVER (PARTITION BY item_id) AS small FROM graphed WHERE score > 0
), long AS (
  SELECT * EXCLUDE (score), CASE WHEN small < 500 AND token_estimate >= 500 AND token_estimate >= 2 * small THEN greatest(0, score - least(greatest((token_estimate - small) / 250.0, 1), 4)) ELSE score END AS score FROM positive
), scored AS (
  SELECT * EXCLUDE (score), round(CAST(score AS DOUBLE), 6) AS score FROM long
)"""


_FINAL = """placed AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, rel_path ORDER BY score DESC, start_line, symbol) AS r FROM scored WHERE score > 0
), once AS (
  SELECT *, kind = 'file' OR symbol = '' AS free, row_number() OVER (PARTITION BY item_id, rel_path, symbol ORDER BY r) AS k, first_value(start_line) OVER (PARTITION BY item_id, rel_path, symbol ORDER BY token_estimate DESC, r) AS body FROM placed
), three AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, rel_path ORDER BY r) AS n FROM once WHERE free OR k = 1
), best AS (
  SELECT item_id AS query_id, rel_path, CAST(CASE WHEN free THEN start_line ELSE body END AS INTEGER) AS start_line, symbol, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, rel_path, r) AS rank FROM three WHERE n <= 3
)"""


@query(f"""
WITH {SEARCH_SQL}, {_FINAL}
SELECT query_id, CAST(rank AS INTEGER) AS rank, rel_path, start_line, symbol, score FROM best WHERE rank <= 8
""")
def search_full(t: Tables) -> DataFrame:
    """The eight best chunks of every question with all signals, the working set, the graph and the penalties."""
    return _search(t).ranked([SearchWeights()]).drop("candidate")


def _facts(t: Tables) -> DataFrame:
    """Three facts a question: its longest words."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]{5,}"), F.lit(0)))
    longest = F.slice(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, 3)
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.explode(F.transform(longest, lambda x: x["w"])).alias("fact"))


@query(f"""
WITH {SEARCH_SQL}, {_FINAL}, wholes AS (
  SELECT rel_path, string_agg(seg, '' ORDER BY k) AS content FROM segments GROUP BY rel_path
), chunks_once AS (
  SELECT rel_path, start_line, symbol, arg_min(content, pos) AS content, arg_min(token_estimate, pos) AS token_estimate FROM numbered GROUP BY ALL
), top AS (
  SELECT b.query_id, b.rank, b.rel_path, c.content, c.token_estimate FROM best b JOIN chunks_once c USING (rel_path, start_line, symbol) WHERE b.rank <= 8
), fact_words AS (
  SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(text, '[a-z]{{5,}}'))) AS fact FROM benchmark
), facts AS (
  SELECT query_id, fact FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(fact) DESC, fact) AS k FROM fact_words) WHERE k <= 3
), snippet AS (
  SELECT t.query_id, (SELECT sum(token_estimate) FROM top x WHERE x.query_id = t.query_id) AS tokens, count(DISTINCT f.fact) AS found FROM top t LEFT JOIN facts f ON f.query_id = t.query_id AND regexp_matches(t.content, '(?i)\\b' || f.fact || '\\b') GROUP BY t.query_id
), hit_files AS (
  SELECT query_id, rel_path, min(rank) AS rank FROM top GROUP BY ALL
), whole_facts AS (
  SELECT h.query_id, h.rel_path, h.rank, f.fact, CAST(ceil(strlen(c.content) / 4.0) AS INTEGER) AS tokens FROM hit_files h JOIN wholes c USING (rel_path) LEFT JOIN facts f ON f.query_id = h.query_id AND regexp_matches(c.content, '(?i)\\b' || f.fact || '\\b')
), fresh AS (
  SELECT query_id, rank, any_value(tokens) AS tokens, count(DISTINCT CASE WHEN k = 1 THEN fact END) AS new FROM (SELECT *, CASE WHEN fact IS NOT NULL THEN row_number() OVER (PARTITION BY query_id, fact ORDER BY rank) END AS k FROM whole_facts) GROUP BY query_id, rank
), walked AS (
  SELECT query_id, rank, sum(new) OVER w AS found, sum(tokens) OVER w AS tokens FROM fresh WINDOW w AS (PARTITION BY query_id ORDER BY rank)
), reached AS (
  SELECT w.query_id, coalesce(min(CASE WHEN w.found >= s.found THEN w.rank END), max(w.rank)) AS rank FROM walked w JOIN snippet s USING (query_id) GROUP BY w.query_id
)
SELECT s.query_id, CAST(s.tokens AS BIGINT) AS snippet_tokens, s.found, (SELECT count(*) FROM facts f WHERE f.query_id = s.query_id) AS facts, CAST(w.tokens AS BIGINT) AS whole_tokens, CASE WHEN s.found > 0 THEN round(1 - s.tokens / w.tokens, 6) END AS reduction
FROM snippet s JOIN reached r USING (query_id) JOIN walked w ON w.query_id = r.query_id AND w.rank = r.rank
""")
def economy_ab(t: Tables) -> DataFrame:
    """Both arms of the token economy from one search: its snippets, and the whole files, in the order of the hits, that find as many facts."""
    hits = kept(_search(t).ranked([SearchWeights()]).drop("candidate"))
    files, chunks = _hit_chunks(t, hits)
    return economy.arms(hits, chunks, files, _facts(t))


@query()
def tuned_weights(t: Tables) -> DataFrame:
    """Four weights of the search tuned on the facts of all questions: name, value, and the share of facts found before and after."""
    names = ("symbol_match", "content", "structural_symbol", "graph")
    best, told = tuning.tuned(tuning.FileEvaluation(_search(t), lambda hits: _hit_chunks(t, hits)[1], kept(_facts(t))), names=names, passes=1)
    return t.spark.createDataFrame([(n, float(getattr(best, n)), told[0][0], told[-1][0]) for n in names], "name string, value double, recall_before double, recall_after double")
