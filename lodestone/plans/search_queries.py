"""Queries of scoring, packing and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import audit, bundles, search
from ..session import parts, spread
from . import sql as S
from .registry import Tables, query
from .tables import chunks, corpus, questions


@query(f"""
WITH {S.TERMS}, {S.CHUNKS}, m AS (
  SELECT f.item_id, c.rel_path, c.start_line, count(DISTINCT f.term) AS hits FROM chunks c JOIN forms f ON contains(lower(c.content), f.form) GROUP BY ALL)
SELECT item_id AS query_id, rel_path, CAST(start_line AS INTEGER) AS start_line, hits FROM m
""")
def content_hits(t: Tables) -> DataFrame:
    c = chunks(t).select(F.struct("rel_path", "start_line").alias("key"), "content")
    return search.content_hits(c, search.question_terms(questions(t))).select("query_id", "key.rel_path", "key.start_line", "hits")


_MIN = f"""
WITH {S.TERMS}, {S.FILES}, m AS (SELECT f.item_id, c.rel_path, count(DISTINCT f.term) AS hits FROM files c JOIN forms f ON contains(lower(c.content), f.form) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, rel_path) AS rank FROM m)
SELECT item_id AS query_id, CAST(rank AS INTEGER) AS rank, rel_path, hits FROM r WHERE rank <= 8
"""


@query(_MIN)
def chunk_search_min(t: Tables) -> DataFrame:
    """The eight files with the most terms of each question."""
    top = search.top_hits(corpus(t).select(F.col("rel_path").alias("key"), "content"), search.question_terms(questions(t)))
    return top.select("query_id", "rank", F.col("key").alias("rel_path"), "hits")


@query(f"""
WITH {S.TERMS}, {S.CHUNKS}, w AS (SELECT DISTINCT rel_path, start_line, unnest(regexp_extract_all(lower(content), '[a-z0-9_]+')) AS term FROM chunks)
SELECT DISTINCT t.item_id AS query_id, w.rel_path, CAST(w.start_line AS INTEGER) AS line FROM w JOIN terms t USING (term)
""")
def search_exact_signal(t: Tables) -> DataFrame:
    return search.exact_signal(chunks(t).select("rel_path", F.col("start_line").alias("line"), "content"), search.question_terms(questions(t)))


_SCORED = "s AS (SELECT l_orderkey AS query_id, 'f' || l_suppkey AS rel_path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey, l_suppkey) AS start_line, l_shipinstruct_ AS symbol, CAST(l_quantity * 20 AS INTEGER) AS token_estimate, round(l_extendedprice / 10000, 6) AS score FROM (SELECT *, 's' || (l_partkey % 3) AS l_shipinstruct_ FROM lineitem))"


def _scored(t: Tables) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey"))
    rows = spread(t.lineitem.withColumnRenamed("l_orderkey", "query_id"), "query_id")  # every window is of a question, so rows move once
    return rows.select(
        "query_id", F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("rel_path"), pos.alias("start_line"), F.concat(F.lit("s"), (F.col("l_partkey") % 3).cast("string")).alias("symbol"),
        F.lit("func").alias("kind"), (F.col("l_quantity") * 20).cast("int").alias("token_estimate"), F.round(F.col("l_extendedprice") / 10000, 6).alias("score"),
    )


@query(f"""
WITH {_SCORED}, m AS (SELECT *, min(CASE WHEN score > 0 AND token_estimate > 0 THEN token_estimate END) OVER (PARTITION BY query_id) AS small FROM s)
SELECT query_id, start_line, round(CASE WHEN small < 500 AND score > 0 AND token_estimate >= 500 AND token_estimate >= 2 * small THEN greatest(0, score - least(greatest((token_estimate - small) / 250.0, 1), 4)) ELSE score END, 6) AS score FROM m
""")
def long_chunk_penalty(t: Tables) -> DataFrame:
    return search.long_penalty(_scored(t)).select("query_id", F.col("start_line").cast("long").alias("start_line"), F.round("score", 6).alias("score"))


@query(f"WITH {_SCORED} SELECT query_id, start_line, round(greatest(0, score * (2 * 0.72 - 1)), 6) AS score FROM s")
def double_penalty(t: Tables) -> DataFrame:
    return _scored(t).select("query_id", F.col("start_line").cast("long").alias("start_line"), F.round(search.twice_kept(F.col("score"), 0.72), 6).alias("score"))


@query(f"""
WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rel_path, start_line, symbol) AS rank FROM s),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id, rel_path, symbol ORDER BY rank) AS k, first_value(start_line) OVER (PARTITION BY query_id, rel_path, symbol ORDER BY token_estimate DESC, rank) AS body FROM r),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, rel_path ORDER BY rank) AS n FROM d WHERE k = 1),
e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM c WHERE n <= 3)
SELECT query_id, CAST(place AS INTEGER) AS rank, rel_path, body AS start_line, symbol, round(score, 6) AS score FROM e WHERE place <= 8
""")
def dedupe_and_diversity(t: Tables) -> DataFrame:
    return search.finish(_scored(t)).withColumn("start_line", F.col("start_line").cast("long"))


RANKED = f"""{S.TERMS}, {S.FILES}, names AS (SELECT rel_path, lang, lower(rel_path) AS path, lower(split_part(rel_path, '/', -1)) AS name FROM files),
m AS (SELECT f.item_id, n.rel_path, f.term, max(CASE WHEN contains(n.name, f.form) OR (length(regexp_replace(n.name, '\\.[^.]*$', '')) >= 3 AND contains(f.form, regexp_replace(n.name, '\\.[^.]*$', ''))) THEN 1 ELSE 0 END) AS inname,
  max(CASE WHEN contains(n.path, f.form) THEN 1 ELSE 0 END) AS inpath FROM names n JOIN forms f ON contains(n.path, f.form) OR (length(regexp_replace(n.name, '\\.[^.]*$', '')) >= 3 AND contains(f.form, regexp_replace(n.name, '\\.[^.]*$', ''))) GROUP BY ALL),
p AS (SELECT item_id, rel_path, sum(CASE WHEN inname = 1 THEN 3.0 ELSE 1.5 END) AS points FROM m GROUP BY ALL),
b AS (SELECT b.item_id, n.rel_path, CASE WHEN n.lang IN ('typescript', 'javascript', 'python', 'go') THEN 0.3 ELSE 0 END + CASE WHEN n.rel_path LIKE 'src1/%' THEN 4 ELSE 0 END AS own FROM names n, benchmark b),
s AS (SELECT b.item_id AS query_id, b.rel_path, round(CAST(coalesce(points, 0) + own AS DOUBLE), 6) AS score FROM b LEFT JOIN p USING (item_id, rel_path)),
ranked AS (SELECT query_id, rel_path, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rel_path) AS INTEGER) AS rank FROM s WHERE score > 0)"""


@query(f"WITH {RANKED} SELECT * FROM ranked")
def rank_files(t: Tables) -> DataFrame:
    return search.rank_files(corpus(t).select("rel_path", "lang"), questions(t), focus="src1")


def _top_files(t: Tables) -> DataFrame:
    return search.rank_files(corpus(t).select("rel_path", "lang"), questions(t), focus="src1", top=search.CONTENT_TOP)


@query(f"""
WITH {RANKED}, h AS (SELECT * FROM ranked WHERE rank <= 30),
v AS (SELECT DISTINCT item_id, term, form FROM (SELECT item_id, term, term AS form FROM terms UNION ALL SELECT t.item_id, t.term, s.st FROM terms t JOIN stems s USING (term)) WHERE form <> ''),
n AS (SELECT h.query_id, h.rel_path, h.score, f.content, sum((length(lower(f.content)) - length(replace(lower(f.content), v.form, ''))) // length(v.form)) AS n
  FROM h JOIN files f USING (rel_path) JOIN v ON v.item_id = h.query_id GROUP BY ALL)
SELECT query_id, rel_path, round(score + 0.5 * ln(1 + n) * least(1, 1000 / greatest(ceil(strlen(content) / 4.0), 1)), 6) AS score FROM n
""")
def rank_content(t: Tables) -> DataFrame:
    return search.content_match(_top_files(t), corpus(t).select("rel_path", "content"), search.question_terms(questions(t)))


@query("""
WITH r AS (SELECT DISTINCT l_orderkey AS source, l_partkey AS target FROM lineitem),
s AS (SELECT o_custkey AS query_id, o_orderkey AS seed FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 12),
b AS (SELECT query_id, target AS path, 1.0 AS boost FROM r JOIN s ON source = seed UNION ALL SELECT query_id, source, 0.8 FROM r JOIN s ON target = seed)
SELECT query_id, path, round(CAST(sum(boost) AS DOUBLE), 6) AS boost FROM b GROUP BY ALL
""")
def graph_expand(t: Tables) -> DataFrame:
    n = parts(t.lineitem)
    relations = t.lineitem.select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target")).repartition(n, "source").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rel_path"))
    orders = spread(t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("rel_path"), F.col("o_totalprice").alias("score")), "query_id")
    return search.graph_expansion(orders.withColumn("rank", rank), relations, parts=2 * n)


@query("""
WITH RECURSIVE h AS (SELECT l_orderkey AS q, 'f' || l_suppkey AS f, CAST(l_quantity AS INTEGER) AS t, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey, l_suppkey) AS INTEGER) AS k FROM lineitem),
p AS (SELECT q, 0 AS k, 80 AS used, CAST(NULL AS VARCHAR) AS f, 0 AS t, false AS taken FROM (SELECT DISTINCT q FROM h)
  UNION ALL SELECT h.q, h.k, CASE WHEN p.used + h.t <= 160 AND h.t > 0 THEN p.used + h.t ELSE p.used END, h.f, h.t, p.used + h.t <= 160 AND h.t > 0 FROM p JOIN h ON h.q = p.q AND h.k = p.k + 1)
SELECT q AS query_id, k AS rank, f AS rel_path, t AS tokens, used FROM p WHERE taken
""")
def pack_greedy(t: Tables) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey"))
    hits = t.lineitem.select(F.col("l_orderkey").alias("query_id"), pos.alias("rank"), F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("rel_path"), F.col("l_quantity").cast("int").alias("tokens"), F.lit(1.0).alias("score"))
    return bundles.pack_greedy(hits, 160)


@query("""
WITH b AS (SELECT l_suppkey AS s, CAST(l_partkey AS BIGINT) AS a, CAST(l_partkey + l_quantity AS BIGINT) AS z FROM lineitem),
m AS (SELECT *, max(z) OVER (PARTITION BY s ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM b),
i AS (SELECT *, sum(CASE WHEN r IS NULL OR a > r + 3 THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT s AS l_suppkey, min(a) AS start, max(z) AS "end", count(*) AS blocks FROM i GROUP BY s, g
""")
def merge_intervals(t: Tables) -> DataFrame:
    b = t.lineitem.select("l_suppkey", F.col("l_partkey").cast("long").alias("start"), (F.col("l_partkey") + F.col("l_quantity")).cast("long").alias("end"))
    return bundles.merge_intervals(b, "l_suppkey")


def _fragments(t: Tables) -> DataFrame:
    e = t.orders.select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("q"), F.col("o_custkey").cast("string")).alias("query"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("f"), (F.col("o_orderkey") % 5).cast("string")).alias("rel_path"))
    return e.withColumn("lang", F.lit("go")).withColumn("content", F.concat(F.lit("c"), F.col("pos").cast("string")))


@query("""
WITH f AS (SELECT o_custkey AS q, o_orderkey AS pos, 'f' || (o_orderkey % 5) AS p FROM orders), l AS (SELECT q, pos, p, max(pos) OVER (PARTITION BY q, p) AS last FROM f)
SELECT q AS query_id, sha256('q' || q || chr(0) || string_agg(p || chr(0) || 'c' || last, chr(0) ORDER BY p, pos)) AS bundle_hash FROM l GROUP BY q
""")
def bundle_hash(t: Tables) -> DataFrame:
    return bundles.bundle_hash(_fragments(t))


@query("""
SELECT o_custkey AS query_id, '# q' || o_custkey || chr(10) || chr(10) || string_agg('## f' || (o_orderkey % 5) || chr(10) || chr(10) || '```go' || chr(10) || 'c' || o_orderkey || chr(10) || '```' || chr(10), chr(10) ORDER BY o_orderkey) AS document FROM orders GROUP BY o_custkey
""")
def render_markdown(t: Tables) -> DataFrame:
    return bundles.render_markdown(_fragments(t))


@query("""
SELECT o_custkey AS query_id, '<context>' || chr(10) || string_agg('<file path="f' || (o_orderkey % 5) || '">' || chr(10) || 'c' || o_orderkey || chr(10) || '</file>', chr(10) ORDER BY o_orderkey) || chr(10) || '</context>' || chr(10) || '<task>' || chr(10) || 'q' || o_custkey || chr(10) || '</task>' AS prompt FROM orders GROUP BY o_custkey
""")
def render_prompt(t: Tables) -> DataFrame:
    return bundles.render_prompt(_fragments(t))


@query("""
WITH s AS (SELECT l_suppkey AS fragment, l_returnflag || l_linestatus AS signal, round(sum(l_tax), 6) AS weight FROM lineitem GROUP BY ALL)
SELECT fragment, signal, weight, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY fragment ORDER BY weight DESC, signal) AS k FROM s) WHERE k <= 3
""")
def top_reasons(t: Tables) -> DataFrame:
    return bundles.top_reasons(t.lineitem.select(F.col("l_suppkey").alias("fragment"), F.concat("l_returnflag", "l_linestatus").alias("signal"), F.col("l_tax").alias("weight")))


_PAIRS = """turns AS (SELECT conv_id * 1000 + turn AS answer_id, conv_id, turn, role, text FROM conversations)"""


@query(f"""
WITH {_PAIRS}, a AS (SELECT p_partkey AS answer_id, 'src/x' || (p_size % 4) || '.py' AS path FROM part), f AS (SELECT p_partkey AS answer_id, unnest(['src/x1.py', 'lib/x2.py', 'a/x3.py', 'b/x3.py']) AS rel_path FROM part)
SELECT answer_id, path, path = 'src/x1.py' OR path = 'src/x2.py' AS valid, CASE WHEN path IN ('src/x1.py', 'src/x2.py') THEN '' WHEN path = 'src/x3.py' THEN 'ambiguous basename' ELSE 'not in bundle' END AS reason FROM a
""")
def validate_citations(t: Tables) -> DataFrame:
    answers = t.part.select(F.col("p_partkey").alias("answer_id"), F.concat(F.lit("see src/x"), (F.col("p_size") % 4).cast("string"), F.lit(".py:7")).alias("text"))
    fragments = t.part.select(F.col("p_partkey").alias("answer_id"), F.explode(F.array(*[F.lit(x) for x in ("src/x1.py", "lib/x2.py", "a/x3.py", "b/x3.py")])).alias("rel_path"))
    return audit.validated(audit.cited(answers), fragments).select("answer_id", "path", "valid", "reason")


@query("SELECT p_partkey AS answer_id, CASE WHEN p_size % 4 = 0 THEN 0.5 WHEN p_size % 4 = 1 THEN 1.0 ELSE 1.0 END AS grounded_ratio FROM part")
def grounded_ratio(t: Tables) -> DataFrame:
    k = F.col("p_size") % 4
    text = F.when(k == 0, "src/x1.py and src/x9.py").when(k == 1, "src/x1.py").otherwise("nothing cited")
    answers = t.part.select(F.col("p_partkey").alias("answer_id"), text.alias("text"))
    fragments = t.part.select(F.col("p_partkey").alias("answer_id"), F.lit("src/x1.py").alias("rel_path"))
    return audit.grounded_ratio(answers, audit.validated(audit.cited(answers), fragments))


_IDENT = "regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)*')"
_CODEY = "((token LIKE '%.%' AND NOT regexp_matches(token, '(^|\\.)[^.]?(\\.|$)') AND NOT regexp_matches(lower(token), '\\.(ts|tsx|js|jsx|mjs|cjs|py|go|md|json|yaml|yml)$')) OR (token NOT LIKE '%.%' AND strlen(token) >= 4 AND (token LIKE '%\\_%' ESCAPE '\\' OR len(regexp_extract_all(token, '[A-Z]')) >= 2 OR (len(regexp_extract_all(token, '[A-Z]')) = 1 AND regexp_matches(token, '^[a-z]')))))"


@query(f"""
WITH a AS (SELECT doc_id, text FROM documents), tok AS (SELECT DISTINCT doc_id, unnest({_IDENT}) AS token FROM a), q AS (SELECT * FROM tok WHERE {_CODEY} OR (token LIKE '%.%' AND strlen(token) >= 4 AND NOT regexp_matches(lower(token), '\\.(ts|tsx|js|jsx|mjs|cjs|py|go|md|json|yaml|yml)$') AND (token LIKE '%\\_%' ESCAPE '\\' OR len(regexp_extract_all(token, '[A-Z]')) >= 2 OR (len(regexp_extract_all(token, '[A-Z]')) = 1 AND regexp_matches(token, '^[a-z]'))))),
b AS (SELECT doc_id, left(text, length(text) // 2) AS text FROM documents), bt AS (SELECT DISTINCT doc_id, unnest({_IDENT}) AS token FROM b),
bp AS (SELECT doc_id, lower(token) AS k FROM bt UNION SELECT doc_id, lower(p) FROM (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(token, '[_.]', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), ' ')) AS p FROM bt) WHERE strlen(p) >= 3),
c AS (SELECT q.doc_id, count(bp.k) AS known, count(*) - count(bp.k) AS unknown FROM q LEFT JOIN bp ON bp.doc_id = q.doc_id AND bp.k = lower(q.token) GROUP BY q.doc_id)
SELECT doc_id AS answer_id, coalesce(known, 0) AS known, coalesce(unknown, 0) AS unknown, round(CASE WHEN known + unknown > 0 THEN unknown / (known + unknown) ELSE 0.0 END, 6) AS drift_rate FROM documents LEFT JOIN c USING (doc_id)
""")
def drift_rate(t: Tables) -> DataFrame:
    answers = t.documents.select(F.col("doc_id").alias("answer_id"), "text")
    half = answers.select("answer_id", F.substring(F.col("text"), F.lit(1), (F.length("text") / 2).cast("int")).alias("text"))
    return audit.drift(answers, half)


@query("""
WITH f AS (SELECT conv_id * 1000 + turn AS answer_id, unnest(['the', 'That.', 'zzz']) AS fact, text FROM conversations)
SELECT answer_id, CAST(sum(CASE WHEN regexp_matches(text, CASE fact WHEN 'the' THEN '(?i)\\bthe\\b' WHEN 'That.' THEN '(?i)\\bThat\\.' ELSE '(?i)\\bzzz\\b' END) THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(*) AS n_facts,
  round(sum(CASE WHEN regexp_matches(text, CASE fact WHEN 'the' THEN '(?i)\\bthe\\b' WHEN 'That.' THEN '(?i)\\bThat\\.' ELSE '(?i)\\bzzz\\b' END) THEN 1 ELSE 0 END) / count(*), 6) AS recall FROM f GROUP BY answer_id
""")
def fact_recall(t: Tables) -> DataFrame:
    answers = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "text")
    facts = answers.select("answer_id", F.explode(F.array(F.lit("the"), F.lit("That."), F.lit("zzz"))).alias("fact"))
    return audit.fact_recall(answers, facts)


@query("""
WITH a AS (SELECT l_suppkey AS k, list_sort(list_distinct(list(l_linenumber))) AS x, list_sort(list_distinct(list(CAST(l_quantity AS INTEGER) % 9))) AS y FROM lineitem GROUP BY l_suppkey)
SELECT k AS record, array_to_string(list_filter(y, lambda v: NOT list_contains(x, v)), ',') AS added, array_to_string(list_filter(x, lambda v: NOT list_contains(y, v)), ',') AS removed FROM a
""")
def audit_diff_sets(t: Tables) -> DataFrame:
    a = t.lineitem.groupBy(F.col("l_suppkey").alias("record")).agg(F.collect_set("l_linenumber").alias("x"), F.collect_set(F.col("l_quantity").cast("int") % 9).alias("y"))
    added, removed = audit.set_differences(F.col("x"), F.col("y"))
    return a.select("record", F.array_join(added.cast("array<string>"), ",").alias("added"), F.array_join(removed.cast("array<string>"), ",").alias("removed"))


@query("""
WITH h AS (SELECT conv_id AS record, role, turn, CASE role WHEN 'user' THEN 3 WHEN 'assistant' THEN 2 ELSE 1 END AS weight FROM conversations WHERE lower(text) LIKE '%then%'),
k AS (SELECT *, row_number() OVER (PARTITION BY record, role ORDER BY turn) AS k FROM h)
SELECT record, CAST(sum(weight) AS BIGINT) AS score FROM k WHERE k <= 3 GROUP BY record ORDER BY score DESC, record DESC LIMIT 100
""")
def journal_search(t: Tables) -> DataFrame:
    weight = F.when(F.col("role") == "user", 3).when(F.col("role") == "assistant", 2).otherwise(1)
    fields = t.conversations.select(F.col("conv_id").alias("record"), F.col("role").alias("kind"), F.col("turn").alias("pos"), weight.alias("weight"), "text")
    return audit.journal_search(fields, "then")


@query("""
SELECT l_returnflag AS model, count(*) AS records, round(avg(l_tax), 6) AS grounded, round(avg(l_discount), 6) AS drift, round(avg(CASE WHEN l_linenumber > 2 THEN l_quantity / 51 END), 6) AS recall,
  CAST(sum(l_linenumber) AS BIGINT) AS used, CAST(sum(l_suppkey) AS BIGINT) AS whole, round(greatest(0, 1 - sum(l_linenumber) / sum(l_suppkey)), 6) AS reduction FROM lineitem GROUP BY l_returnflag
""")
def audit_aggregate(t: Tables) -> DataFrame:
    r = t.lineitem.select(
        F.col("l_returnflag").alias("model"), F.col("l_tax").alias("grounded_ratio"), F.col("l_discount").alias("drift_rate"), F.greatest(F.col("l_linenumber") - 2, F.lit(0)).alias("n_facts"),
        (F.col("l_quantity") / 51).alias("recall"), F.col("l_linenumber").alias("used"), F.col("l_suppkey").alias("whole"),
    )
    return audit.audit_summary(r)


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_turn(t: Tables) -> DataFrame:
    return t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


@query("""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u FROM v),
c AS (SELECT label, min(vec_id) AS q FROM v GROUP BY label),
s AS (SELECT c.q, u.vec_id, round(list_inner_product(a.u, u.u), 6) AS cosine FROM c JOIN u a ON a.vec_id = c.q JOIN u ON u.label = c.label AND u.vec_id <> c.q)
SELECT q AS query_id, CAST(k AS INTEGER) AS rank, vec_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, vec_id) AS k FROM s) WHERE k <= 5
""")
def cosine_topk(t: Tables) -> DataFrame:
    """The five nearest of its label for the first vector of each label."""
    u = t.embeddings.select("vec_id", "label", V.unit(F.col("embedding")).alias("u"))
    first = u.groupBy("label").agg(F.min("vec_id").alias("query_id"), F.min_by("u", "vec_id").alias("q"))
    s = u.join(first, "label").where("vec_id <> query_id").withColumn("cosine", F.round(V.dot(F.col("q"), F.col("u")), 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    return s.withColumn("rank", rank).where("rank <= 5").select("query_id", "rank", "vec_id", "cosine")
