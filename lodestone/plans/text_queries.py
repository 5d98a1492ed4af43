"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..functions import vectors as V
from . import sql as S
from .registry import Tables, query
from .tables import corpus, questions


@query(f"SELECT item_id AS query_id, array_to_string({S.ordered_distinct('l')}, ' ') AS terms FROM (SELECT item_id, {S.tokens('text')} AS l FROM benchmark)")
def tokenise_terms(t: Tables) -> DataFrame:
    return questions(t).select("query_id", F.array_join(T.tokenise("text"), " ").alias("terms"))


@query(f"SELECT DISTINCT w AS word, {S.stem('w')} AS stem FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM documents)")
def stem_words(t: Tables) -> DataFrame:
    words = t.documents.select(F.explode(T.extract_all(F.lower("text"), "[a-z0-9_]+")).alias("word")).distinct()
    return words.select("word", T.stem("word").alias("stem"))


@query("SELECT doc_id, CAST(ceil(strlen(text) / 4.0) AS INTEGER) AS tokens, CAST(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END AS INTEGER) AS lines FROM documents")
def token_estimate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.token_estimate("text").alias("tokens"), T.line_count("text").alias("lines"))


@query("SELECT p_partkey, rtrim(left(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-'), 40), '-') AS slug, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS compact FROM part")
def slugify(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"), T.compact("p_brand").alias("compact"))


@query("""
WITH d AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS t FROM documents), p AS (SELECT *, strpos(lower(t), 'the ') AS a FROM d),
r AS (SELECT *, greatest(a - 80, 1) AS lo, least(a + 4 - 1 + 80, length(t)) AS hi FROM p)
SELECT doc_id, CASE WHEN a = 0 THEN '' ELSE (CASE WHEN lo > 1 THEN '…' ELSE '' END) || substring(t, lo, hi - lo + 1) || (CASE WHEN hi < length(t) THEN '…' ELSE '' END) END AS snippet FROM r
""")
def snippet_window(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.snippet_around("text", F.lit("the ")).alias("snippet"))


@query(f"WITH {S.FILES} SELECT doc_id, coalesce(lang, 'none') AS lang, rel_path FROM files")
def lang_lookup(t: Tables) -> DataFrame:
    return corpus(t).select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"), "rel_path")


_PATHS = """paths AS (
  SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'src/tests/o' || o_custkey || '.go' WHEN 1 THEN 'src/o' || o_custkey || '_test.go' WHEN 2 THEN 'pkg/compat-v2/o' || o_custkey || '.ts'
    WHEN 3 THEN 'node_modules/o' || o_custkey || '.js' WHEN 4 THEN 'audit/o' || o_custkey || '.md' WHEN 5 THEN 'cfg/secrets.o' || o_custkey || '.yaml' ELSE 'src/o' || o_custkey || '.spec.ts' END AS path FROM orders
)"""


def _paths(t: Tables) -> DataFrame:
    k, o = F.pmod("o_orderkey", F.lit(7)), F.concat(F.lit("o"), F.col("o_custkey").cast("string"))
    path = (
        F.when(k == 0, F.concat(F.lit("src/tests/"), o, F.lit(".go")))
        .when(k == 1, F.concat(F.lit("src/"), o, F.lit("_test.go")))
        .when(k == 2, F.concat(F.lit("pkg/compat-v2/"), o, F.lit(".ts")))
        .when(k == 3, F.concat(F.lit("node_modules/"), o, F.lit(".js")))
        .when(k == 4, F.concat(F.lit("audit/"), o, F.lit(".md")))
        .when(k == 5, F.concat(F.lit("cfg/secrets."), o, F.lit(".yaml")))
        .otherwise(F.concat(F.lit("src/"), o, F.lit(".spec.ts")))
    )
    return t.orders.select("o_orderkey", path.alias("path"))


@query(f"WITH {_PATHS} SELECT o_orderkey, regexp_matches(path, '(^|/)(__tests__|tests|test|fixtures|mocks|testdata)/') OR regexp_matches(path, '(_test\\.go|\\.(test|spec)\\.(ts|tsx|js|jsx))$') AS test_like, regexp_matches(path, '(^|/)([^/]*[^a-z0-9/])?(compat|legacy|deprecated|polyfills?|shims)([^a-z0-9/][^/]*)?/') AS legacy_like FROM paths")
def test_and_legacy_paths(t: Tables) -> DataFrame:
    return _paths(t).select("o_orderkey", P.is_test_like(F.col("path")).alias("test_like"), P.is_legacy_like(F.col("path")).alias("legacy_like"))


@query(f"WITH {_PATHS} SELECT o_orderkey, regexp_matches(path, '(^|/)(node_modules|vendor|dist|build|target|out)/') OR path LIKE 'audit/%' OR regexp_matches(path, '/secrets\\.[^/]*\\.(json|ya?ml|toml|env|ini)$') AS skipped, regexp_replace(regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', ''), '(_test|\\.test|\\.spec)$', '') AS stem FROM paths")
def skipped_paths(t: Tables) -> DataFrame:
    return _paths(t).select("o_orderkey", P.skipped(F.col("path")).alias("skipped"), P.production_stem(F.col("path")).alias("stem"))


@query("SELECT s_suppkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0) ELSE printf('%.1f MB', b / 1048576.0) END AS shown FROM (SELECT s_suppkey, CAST(s_suppkey AS BIGINT) * 4096 AS b FROM supplier)")
def human_sizes(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", T.human_bytes(F.col("s_suppkey").cast("long") * 4096, "MB").alias("shown"))


@query("SELECT c_custkey, substring(sha256(lower(trim(c_name, ' '))), 1, 12) AS query_id, substring(sha1('8000|' || c_name), 1, 8) AS cache_name FROM customer")
def stable_ids(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", T.query_id("c_name").alias("query_id"), T.cache_name(F.col("c_name"), F.lit(8000)).alias("cache_name"))


_INTENT = "regexp_split_to_array(lower(text), '[^\\p{L}\\p{Nd}_]+')"


@query(f"""
SELECT item_id AS query_id, list_has_any({_INTENT}, [{S.quoted(T.TEST_INTENT)}]) AND NOT list_has_any({_INTENT}, [{S.quoted(T.TEST_OVERRIDE)}]) AS wants_tests,
  CASE WHEN list_has_any({_INTENT}, [{S.quoted(T.OUTLINE_HINTS)}]) THEN 'outline' WHEN list_has_any({_INTENT}, [{S.quoted(T.BUNDLE_HINTS)}]) THEN
    CASE WHEN list_filter([{S.quoted(T.BUNDLE_HINTS)}], lambda h: list_contains({_INTENT}, h))[1] IN ('review', 'revisa') THEN 'review' ELSE 'build' END ELSE 'search' END AS intent
FROM benchmark
""")
def question_intent(t: Tables) -> DataFrame:
    return questions(t).select("query_id", T.wants_tests("text").alias("wants_tests"), T.intent("text").alias("intent"))


_CITED = "regexp_extract_all(x, '([A-Za-z0-9_./\\-]+\\.(?:ts|tsx|js|jsx|mjs|cjs|py|go|md|json|ya?ml))(?::(\\d+))?')"
_ANSWERS = "SELECT p_partkey, 'see src/' || replace(p_name, ' ', '_') || '.tsx:' || p_size || ', package.json:3 and src/' || replace(p_name, ' ', '_') || '.tsx:' || p_size AS x FROM part"


@query(f"SELECT p_partkey, array_to_string({S.ordered_distinct(_CITED)}, ' ') AS cited FROM ({_ANSWERS})")
def parse_citations(t: Tables) -> DataFrame:
    name = F.concat(F.lit("src/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".tsx:"), F.col("p_size").cast("string"))
    x = F.concat(F.lit("see "), name, F.lit(", package.json:3 and "), name)
    return t.part.select("p_partkey", F.array_join(T.citations(x), " ").alias("cited"))


@query("SELECT o_orderkey, 'src/a' || o_custkey || '.py' AS path, CAST(o_orderkey % 90 + 1 AS INTEGER) AS start, CAST(o_orderkey % 90 + 20 AS INTEGER) AS \"end\" FROM orders")
def expand_specs(t: Tables) -> DataFrame:
    n = F.pmod("o_orderkey", F.lit(90))
    raw = F.concat(F.lit("src/a"), F.col("o_custkey").cast("string"), F.lit(".py:"), (n + 1).cast("string"), F.lit("-"), (n + 20).cast("string"))
    return t.orders.select("o_orderkey", T.expand_spec(raw).alias("s")).select("o_orderkey", "s.path", "s.start", "s.end")


_CALLED = "list_distinct(list_filter(regexp_extract_all(text, '\\b([A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)?)\\s*\\(', 1), lambda x: lower(x) NOT IN (" + S.quoted(T.CALL_STOP) + ")))"


@query(f"SELECT page_id, array_to_string(list_sort({_CALLED.replace('text', 'html')}), ' ') AS calls FROM pages")
def calls_in_pages(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.array_join(T.calls_in("html"), " ").alias("calls"))


@query("SELECT doc_id, array_to_string(string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10))[2:4], chr(10)) AS lines FROM documents")
def lines_two_to_four(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.lines_in_range("text", F.lit(2), F.lit(4)).alias("lines"))


@query("""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
g AS (SELECT label, min(vec_id) AS vec_id FROM v GROUP BY label), c AS (SELECT g.label, v.e FROM g JOIN v USING (vec_id))
SELECT v.vec_id, round(list_inner_product(v.e, c.e) / (sqrt(list_inner_product(v.e, v.e)) * sqrt(list_inner_product(c.e, c.e))), 6) AS cosine FROM v JOIN c USING (label)
""")
def cosine_to_first(t: Tables) -> DataFrame:
    v = t.embeddings.select("vec_id", "label", "embedding")
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return v.join(first, "label").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("first")), 6).alias("cosine"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN s <= 0.18 THEN 0.0 ELSE round(least(greatest(1 + (least(s, 1) - 0.18) * 8, 1), 8), 6) END AS boost FROM (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS s FROM lineitem)")
def semantic_boost(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(V.semantic_boost(F.col("l_quantity") / 50, 8.0), 6).alias("boost"))


@query("""
WITH RECURSIVE c AS (SELECT item_id, list_transform(string_split(text, ''), lambda x: ord(x)) AS codes FROM benchmark),
h AS (SELECT item_id, codes, 0 AS k, CAST(5381 AS BIGINT) AS seed FROM c UNION ALL SELECT item_id, codes, k + 1, (seed * 33 + codes[k + 1]) % 4294967296 FROM h WHERE k < len(codes)),
g AS (SELECT item_id, 0 AS pos, (seed * 1664525 + 1013904223) % 4294967296 AS x FROM h WHERE k = len(codes) UNION ALL SELECT item_id, pos + 1, (x * 1664525 + 1013904223) % 4294967296 FROM g WHERE pos < 15),
v AS (SELECT item_id, pos, x / 4294967296.0::DOUBLE * 2 - 1 AS v FROM g)
SELECT item_id AS query_id, pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY item_id)), 5) AS value FROM v
""")
def mock_embedding(t: Tables) -> DataFrame:
    e = V.mock_embedding(16)("text")
    return questions(t).select("query_id", F.posexplode(e).alias("pos", "value")).withColumn("value", F.round(F.col("value").cast("double"), 5))


@query("SELECT token, CASE WHEN regexp_matches(lower(token), '\\.(ts|tsx|js|jsx|mjs|cjs|py|go|md|json|yaml|yml)$') THEN 'path' WHEN token LIKE '%.%' AND NOT regexp_matches(token, '(^|\\.)[^.]?(\\.|$)') THEN 'api' WHEN strlen(token) >= 4 AND (token LIKE '%\\_%' ESCAPE '\\' OR len(regexp_extract_all(token, '[A-Z]')) >= 2 OR (regexp_matches(token, '[A-Z]') AND NOT regexp_matches(token, '[a-z]')) OR (len(regexp_extract_all(token, '[A-Z]')) = 1 AND regexp_matches(token, '^[a-z]'))) THEN 'symbol' ELSE 'skip' END AS kind FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)*')) AS token FROM documents)")
def token_kinds(t: Tables) -> DataFrame:
    tokens = t.documents.select(F.explode(T.extract_all(F.col("text"), T.IDENTIFIER)).alias("token")).distinct()
    return tokens.select("token", T.token_kind("token").alias("kind"))
