"""Queries of parsers, chunks, closures and excerpts over the documents as source files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bundles, excerpts, parsing, search
from ..session import kept
from .registry import Tables, query
from .search_queries import RANKED
from .sources import BLOCKS_SQL, CHUNKS_SQL, FORMS_SQL, SOURCES_SQL, SYMBOLS_SQL, source_files, source_sizes
from .tables import questions


@query(f"""
WITH {SOURCES_SQL}, {SYMBOLS_SQL}
SELECT y.rel_path, 'symbol' AS what, y.name, y.kind, CAST(s.last - s.n + 1 AS INTEGER) AS line FROM symbols y JOIN segments s ON s.rel_path = y.rel_path AND s.k = y.k
UNION ALL SELECT DISTINCT rel_path, 'import', imp, NULL, NULL FROM imports
""")
def parse_sources(t: Tables) -> DataFrame:
    """Symbols and imports of all files."""
    parsed = parsing.parse(source_files(t)).select("rel_path", "symbols", "imports")
    symbols = F.transform("symbols", lambda s: F.struct(F.lit("symbol").alias("what"), s["name"].alias("name"), s["kind"].alias("kind"), s["line"].alias("line")))
    imports = F.transform("imports", lambda i: F.struct(F.lit("import").alias("what"), i.alias("name"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("line")))
    return parsed.select("rel_path", F.inline(F.concat(symbols, imports)))  # one list, so that a file is parsed once


@query(f"""
WITH {SOURCES_SQL}, {CHUNKS_SQL}
SELECT rel_path, chunk_id, kind, symbol, start_line, end_line, parent_id, sha256(content) AS content_hash, sha256(kind || chr(0) || symbol || chr(0) || start_line || chr(0) || end_line) AS ast_hash,
  CAST(ceil(strlen(content) / 4.0) AS INTEGER) AS token_estimate FROM chunks
""")
def code_chunks(t: Tables) -> DataFrame:
    """The chunks of all files."""
    return parsing.code_chunks(source_files(t)).select("rel_path", "chunk_id", "kind", "symbol", "start_line", "end_line", "parent_id", "content_hash", "ast_hash", "token_estimate")


@query(f"""
WITH {SOURCES_SQL}, {CHUNKS_SQL}
SELECT c.rel_path, c.symbol, c.start_line, c.end_line, p.chunk_id AS parent_id, p.start_line AS parent_start, p.end_line AS parent_end
FROM chunks c JOIN chunks p ON p.rel_path = c.rel_path AND p.chunk_id = c.parent_id WHERE c.kind = 'nested_func'
""")
def nested_closures(t: Tables) -> DataFrame:
    """Functions inside long functions, with the lines of both."""
    return parsing.nested_closures(source_files(t))


_EXCERPTS = f"""{BLOCKS_SQL}, totals AS (
  SELECT rel_path, max(last) + 1 AS lines FROM segments GROUP BY rel_path
), placed AS (
  SELECT b.*, d.lang, t.lines, lag(b.last) OVER w AS before, lead(b.start) OVER w AS next, string_split(regexp_replace(b.body, chr(10) || '$', ''), chr(10)) AS l
  FROM blocks b JOIN docs d USING (rel_path) JOIN totals t USING (rel_path) WINDOW w AS (PARTITION BY b.rel_path ORDER BY b.start)
), pieces AS (
  SELECT rel_path, lang, start,
    CASE WHEN before IS NULL AND start > 1 THEN '// ... ' || (start - 1) || ' lines omitted from start ...' || chr(10) || chr(10) WHEN start - before > 1 THEN chr(10) || '// ... ' || (start - before - 1) || ' lines omitted ...' || chr(10) || chr(10) ELSE '' END
    || '// ── ' || rel_path || ':' || start || '-' || last || ' (' || label || ') ──' || chr(10)
    || CASE WHEN lang = 'go' AND len(l) > 40 THEN array_to_string(l[1:8], chr(10)) || chr(10) || '// ... ' || (len(l) - 12) || ' lines elided in extracted excerpt ...' || chr(10) || array_to_string(l[len(l) - 3:], chr(10)) || chr(10) ELSE body END
    || CASE WHEN next IS NULL AND last < lines THEN chr(10) || '// ... ' || (lines - last) || ' lines omitted to end ...' || chr(10) ELSE '' END AS piece FROM placed
), texts AS (
  SELECT rel_path, '// file: ' || rel_path || chr(10) || '// lang: ' || any_value(lang) || chr(10) || '// representation: excerpt' || chr(10) || chr(10) || string_agg(piece, '' ORDER BY start) AS excerpt FROM pieces GROUP BY rel_path
)"""


@query(f"""
WITH {SOURCES_SQL}, {_EXCERPTS}
SELECT d.rel_path, t.excerpt, CAST(ceil(strlen(t.excerpt) / 4.0) AS INTEGER) AS tokens FROM docs d LEFT JOIN texts t USING (rel_path)
""")
def symbol_excerpts(t: Tables) -> DataFrame:
    """For a question about each file the blocks that it names; null where the language has none."""
    files = source_files(t)
    wanted = files.select(F.col("rel_path").alias("query_id"), "rel_path", F.col("asked").alias("terms"))
    return excerpts.symbol_excerpts(wanted, files).select("rel_path", "excerpt", "tokens")


@query(f"""
WITH {SOURCES_SQL}, {FORMS_SQL} SELECT rel_path, full_ AS "full", sig AS signature_tokens, note AS note_tokens FROM file_forms
""")
def file_forms(t: Tables) -> DataFrame:
    """Tokens of every file whole, as a signature and as a note."""
    return excerpts.forms(source_files(t)).select("rel_path", "full", "signature_tokens", "note_tokens")


@query(f"""
WITH RECURSIVE {RANKED}, {SOURCES_SQL}, {FORMS_SQL}, {_EXCERPTS}, c AS MATERIALIZED (
  SELECT r.query_id, r.rank, r.rel_path, f.full_, f.sig, f.note, CASE WHEN r.rank <= 3 THEN CAST(ceil(strlen(t.excerpt) / 4.0) AS INTEGER) END AS ex FROM ranked r JOIN file_forms f USING (rel_path) LEFT JOIN texts t USING (rel_path)
), pk AS (
  SELECT query_id, 0 AS rank, 80 AS used, CAST(NULL AS VARCHAR) AS form, 0 AS tokens FROM (SELECT DISTINCT query_id FROM c)
  UNION ALL SELECT query_id, rank, used + CASE form WHEN 'full' THEN full_ WHEN 'excerpt' THEN ex WHEN 'signature' THEN sig WHEN 'note' THEN note ELSE 0 END, form, CASE form WHEN 'full' THEN full_ WHEN 'excerpt' THEN ex WHEN 'signature' THEN sig WHEN 'note' THEN note ELSE 0 END
  FROM (SELECT c.*, pk.used, CASE WHEN c.full_ <= 600 AND pk.used + c.full_ <= 4000 THEN 'full' WHEN c.ex <= 800 AND pk.used + c.ex <= 4000 THEN 'excerpt' WHEN pk.used + c.sig <= 4000 THEN 'signature' WHEN pk.used + c.note <= 4000 THEN 'note' END AS form FROM pk JOIN c ON c.query_id = pk.query_id AND c.rank = pk.rank + 1)
), t AS (
  SELECT c.query_id, c.rank, c.rel_path, c.full_, p.form, p.tokens, max(p.used) OVER (PARTITION BY c.query_id) AS total FROM c JOIN pk p ON p.query_id = c.query_id AND p.rank = c.rank WHERE p.form IS NOT NULL
), u AS (
  SELECT query_id, rank, total, full_ - tokens AS cost, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS k FROM t WHERE form IN ('excerpt', 'signature') AND full_ <= 600 AND full_ > tokens
), g AS (
  SELECT query_id, 0 AS k, 0 AS rank, any_value(total) AS used, false AS up FROM u GROUP BY query_id
  UNION ALL SELECT u.query_id, u.k, u.rank, CASE WHEN g.used + u.cost <= 4000 THEN g.used + u.cost ELSE g.used END, g.used + u.cost <= 4000 FROM g JOIN u ON u.query_id = g.query_id AND u.k = g.k + 1
)
SELECT t.query_id, t.rank, t.rel_path, CASE WHEN g.up THEN 'full' ELSE t.form END AS form, CASE WHEN g.up THEN t.full_ ELSE t.tokens END AS tokens FROM t LEFT JOIN g ON g.query_id = t.query_id AND g.rank = t.rank AND g.up
""")
def pack_ladder(t: Tables) -> DataFrame:
    """Bundles of 4,000 tokens from the ranked files: each whole, as an excerpt of what it is asked, as a signature or as a note."""
    names = source_files(t).select("rel_path", "lang")

    def described(ranking: DataFrame) -> tuple[DataFrame, DataFrame]:
        files = kept(source_files(t, only=search.checked(ranking.select("rel_path").distinct(), 100_000)))
        best = ranking.where(F.col("rank") <= bundles.EXCERPT_TOP).select("query_id", "rel_path").join(files.select("rel_path", F.col("asked").alias("terms")), "rel_path")
        return _tokens(files), excerpts.symbol_excerpts(best, files).select("query_id", "rel_path", F.col("tokens").alias("excerpt"))

    def small(room: int) -> DataFrame:
        bound = excerpts.least_tokens(F.col("rel_path"), F.col("lang"), F.col("size"))
        some = search.checked(source_sizes(t).where(bound <= room).select("rel_path").distinct(), 100_000)
        return _tokens(source_files(t, only=some)).select("rel_path", F.least("full", "signature", "note").alias("least")).where(F.col("least") <= room)

    rank = lambda top: search.rank_files(names, questions(t), focus="src1", top=top)
    return bundles.pack_ranking(rank, described, 4000, small=small)


def _tokens(files: DataFrame) -> DataFrame:
    return excerpts.forms(files).select("rel_path", "full", F.col("signature_tokens").alias("signature"), F.col("note_tokens").alias("note"))
