"""Queries of stored tables, short lists, summaries and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import audit, stores, views
from . import sql as S
from .registry import Tables, query
from .search_queries import _MIN, chunk_search_min
from .tables import chunks, corpus


@query("SELECT DISTINCT s_nationkey AS source, s_suppkey % 25 AS target, 'import' AS type FROM supplier")
def relation_table(t: Tables) -> DataFrame:
    return stores.relation_table(t.supplier.select(F.col("s_nationkey").alias("source"), (F.col("s_suppkey") % 25).alias("target"), F.lit("import").alias("type")))


@query("SELECT CAST(n_regionkey AS VARCHAR) AS value FROM nation WHERE n_name = 'NATION_7'")
def metadata_value(t: Tables) -> DataFrame:
    return stores.metadata_value(t.nation.select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value")), "NATION_7")


_ID = "substr(sha256(lower(trim(text, ' '))), 1, 12)"


@query(f"WITH f AS (SELECT {_ID} AS id, min(text) AS question FROM benchmark GROUP BY 1) SELECT * FROM f WHERE id NOT IN (SELECT {_ID} FROM benchmark WHERE item_id % 3 = 0)")
def new_fixtures(t: Tables) -> DataFrame:
    existing = t.benchmark.where("item_id % 3 = 0").select(stores.fixture_id(F.col("text")).alias("id"))
    return stores.new_fixtures(t.benchmark.select(F.col("text").alias("question")), existing)


@query(f"WITH {S.CHUNKS} SELECT DISTINCT sha256(content) AS content_hash, content FROM chunks WHERE content NOT IN (SELECT content FROM chunks WHERE doc_id % 4 = 0)")
def chunks_to_embed(t: Tables) -> DataFrame:
    c = chunks(t)
    embedded = c.join(corpus(t).where("doc_id % 4 = 0").select("rel_path"), "rel_path", "left_semi").select(F.sha2("content", 256).alias("content_hash")).distinct()
    return stores.chunks_to_embed(c, embedded)


@query("SELECT doc_id, label, embedding[1] AS first FROM documents LEFT JOIN (SELECT vec_id, label, embedding FROM embeddings WHERE label % 2 = 0) ON vec_id = doc_id")
def documents_with_embeddings(t: Tables) -> DataFrame:
    e = t.embeddings.where("label % 2 = 0").select(F.col("vec_id").alias("doc_id"), F.struct("label", "embedding").alias("embedding"))
    return stores.with_embeddings(t.documents.select("doc_id"), e, "doc_id").select("doc_id", "embedding.label", F.col("embedding.embedding")[0].alias("first"))


@query(f"""
WITH {S.CHUNKS}, h AS (SELECT sha256(content) AS content_hash, rel_path, CAST(start_line AS INTEGER) AS start_line, row_number() OVER (PARTITION BY content ORDER BY rel_path, start_line) AS k, bool_or(doc_id % 5 = 0) OVER (PARTITION BY content) AS wanted FROM chunks)
SELECT content_hash, rel_path, start_line FROM h WHERE k = 1 AND wanted
""")
def resolved_hashes(t: Tables) -> DataFrame:
    c = chunks(t).select("rel_path", "start_line", F.sha2("content", 256).alias("content_hash"))
    return stores.resolved_hashes(c.join(corpus(t).where("doc_id % 5 = 0").select("rel_path"), "rel_path", "left_semi").select("content_hash"), c)


@query("SELECT p_name || p_partkey AS name, greatest(0, least(60, p_retailprice / 10 - 100)) AS value FROM part WHERE p_size % 7 <> 0")
def kept_weights(t: Tables) -> DataFrame:
    value = F.when(F.col("p_size") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice") / 10 - 100)
    return stores.kept_weights(t.part.select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), value.alias("value")))


@query("SELECT o_orderkey AS pos, CAST(epoch(o_orderdate) AS BIGINT) || '-' || substr(sha256(o_orderpriority), 1, 8) || '-' || lpad(lower(to_hex(o_orderkey)), 8, '0') || '.json' AS name FROM orders")
def record_names(t: Tables) -> DataFrame:
    r = t.orders.select(F.col("o_orderkey").alias("pos"), F.col("o_orderdate").alias("ts"), F.sha2("o_orderpriority", 256).alias("bundle_hash"))
    return stores.record_names(r).select("pos", "name")


@query("WITH f AS (SELECT o_custkey, 'b' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS path, o_orderdate AS modified FROM orders) SELECT o_custkey, path FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY modified DESC, path) AS k FROM f) WHERE k = 1")
def newest_bundle(t: Tables) -> DataFrame:
    return stores.newest(t.orders.select("o_custkey", F.concat(F.lit("b"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("path"), F.col("o_orderdate").alias("modified")), "o_custkey")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(l_quantity >= 24, true) AS stale, l_partkey > 3 AND l_suppkey > 3 AND l_tax >= 0.02 AND l_discount >= 0.02 AS fresh FROM lineitem
""")
def freshness(t: Tables) -> DataFrame:
    fresh = stores.cache_is_fresh(F.lit(0.02), F.col("l_tax"), F.col("l_partkey") - 3, F.col("l_discount"), F.col("l_suppkey") - 3)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", stores.index_is_stale(F.col("l_quantity")).alias("stale"), fresh.alias("fresh"))


@query(f"WITH h AS ({_MIN}) SELECT query_id, rank, rel_path, CAST(hits AS DOUBLE) AS score FROM h WHERE hits >= 2 AND rank <= 5")
def files_only(t: Tables) -> DataFrame:
    return views.files_only(chunk_search_min(t).withColumn("score", F.col("hits").cast("double")), 5, 2.0)


@query("""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS pos FROM k WHERE k <= 5
""")
def last_entries(t: Tables) -> DataFrame:
    return views.last_n(t.events, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "pos")


@query("SELECT event_id AS seq, event_type, value > 100 AS grounded FROM events WHERE NOT coalesce(value > 100, false) ORDER BY event_id DESC LIMIT 25")
def recent_concerning(t: Tables) -> DataFrame:
    return views.recent_concerning(t.events.select(F.col("event_id").alias("seq"), "event_type", (F.col("value") > 100).alias("grounded")), 25)


@query("SELECT ts, event_id AS id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 40")
def recent_logs(t: Tables) -> DataFrame:
    return views.recent(t.events.select("ts", F.col("event_id").alias("id"), "event_type"), 40)


@query("""
WITH l AS (SELECT l_orderkey, list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, l_partkey, l_suppkey) AS v FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(v[1:3], ', ') || CASE WHEN len(v) > 3 THEN ', +' || (len(v) - 3) || ' more' ELSE '' END AS parts FROM l
""")
def compact_list(t: Tables) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    l = t.lineitem.groupBy("l_orderkey").agg(listed.alias("l"))
    return l.select("l_orderkey", views.compact_list(F.col("l.l_partkey").cast("array<string>"), 3).alias("parts"))


@query("""
WITH p AS (SELECT l_orderkey AS query_id, list('<file path="f' || l_suppkey % 7 || '">x</file>' ORDER BY l_linenumber, l_partkey, l_suppkey) AS v FROM lineitem GROUP BY l_orderkey),
x AS (SELECT l_orderkey AS query_id, 0 AS source, l_linenumber * 1000000 + l_partkey AS pos, 'f' || l_partkey % 5 AS path FROM lineitem UNION ALL SELECT query_id, 1, generate_subscripts(v, 1) - 1, regexp_extract(unnest(v), 'path="([^"]*)"', 1) FROM p),
f AS (SELECT query_id, path, min((source, pos)) AS place FROM x GROUP BY ALL)
SELECT query_id, path, 1.0::DOUBLE / row_number() OVER (PARTITION BY query_id ORDER BY place, path) AS score FROM f
""")
def first_seen(t: Tables) -> DataFrame:
    name = lambda c, n: F.concat(F.lit("f"), (F.col(c) % n).cast("string"))
    hits = t.lineitem.select(F.col("l_orderkey").alias("query_id"), F.lit(0).alias("source"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).cast("long").alias("pos"), name("l_partkey", 5).alias("path"))
    tag = F.concat(F.lit('<file path="'), name("l_suppkey", 7), F.lit('">x</file>'))
    listed = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", tag.alias("tag"))))
    prompts = t.lineitem.groupBy(F.col("l_orderkey").alias("query_id")).agg(F.array_join(listed["tag"], "").alias("prompt"))
    tags = views.prompt_paths(prompts).select("query_id", F.lit(1).alias("source"), F.col("pos").cast("long").alias("pos"), "path")
    return views.first_seen(hits.unionByName(tags))


@query(f"""
WITH {S.CHUNKS}, s AS (SELECT rel_path, count(*) AS n, count_if(start_line % 2 = 0) AS i FROM chunks GROUP BY ALL)
SELECT lang, count(*) AS files, CAST(coalesce(sum(n), 0) AS BIGINT) AS symbols, CAST(coalesce(sum(i), 0) AS BIGINT) AS imports FROM files LEFT JOIN s USING (rel_path) GROUP BY lang
""")
def index_stats(t: Tables) -> DataFrame:
    c = chunks(t)
    return views.index_stats(corpus(t).select("rel_path", "lang"), c, c.where("start_line % 2 = 0"))


@query(f"WITH {S.CHUNKS} SELECT rel_path, count(*) AS symbols FROM chunks GROUP BY rel_path ORDER BY symbols DESC, rel_path LIMIT 10")
def top_by_symbols(t: Tables) -> DataFrame:
    return views.top_by_symbols(chunks(t))


@query("""
WITH f AS (SELECT conv_id AS answer_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE turn % 3 <> 2 GROUP BY conv_id),
x AS (SELECT DISTINCT conv_id AS answer_id, regexp_extract(text, '[A-Za-z]{4,}') AS fact FROM conversations WHERE regexp_extract(text, '[A-Za-z]{4,}') <> '')
SELECT answer_id, count_if(regexp_matches(text, '(?i)\\b' || fact || '\\b')) AS hits, count(*) AS n_facts, round(count_if(regexp_matches(text, '(?i)\\b' || fact || '\\b')) / count(*), 6) AS recall FROM f JOIN x USING (answer_id) GROUP BY answer_id
""")
def bundle_fact_score(t: Tables) -> DataFrame:
    c = t.conversations
    path = F.when(F.col("turn") % 3 == 2, "pkg/a_test.go").otherwise("pkg/a.go")
    texts = views.bundle_texts(c.select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("pos"), path.alias("rel_path"), F.col("text").alias("content")))
    facts = c.select(F.col("conv_id").alias("answer_id"), F.regexp_extract("text", "[A-Za-z]{4,}", 0).alias("fact")).where("fact <> ''").distinct()
    return audit.fact_recall(texts, facts)


@query("SELECT event_type AS route, count(*) AS n FROM events GROUP BY event_type")
def route_counts(t: Tables) -> DataFrame:
    return views.route_counts(t.events.select(F.col("event_type").alias("route")))


@query("""
SELECT l_returnflag, count(*) AS questions, round(avg(CASE WHEN l_linenumber = 1 THEN 1.0 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN l_linenumber <= 3 THEN 1.0 ELSE 0 END), 6) AS top3, round(avg(l_suppkey), 6) AS tokens, round(avg(l_quantity), 6) AS ms,
  round(avg(CASE WHEN l_tax < 0.02 THEN NULL WHEN l_discount > 0.05 THEN 1.0 ELSE 0 END), 6) AS stable FROM lineitem GROUP BY l_returnflag
""")
def bench_summary(t: Tables) -> DataFrame:
    again = F.when(F.col("l_tax") >= 0.02, F.col("l_discount") > 0.05)
    rank = F.when(F.col("l_linenumber") <= 5, F.col("l_linenumber"))
    return views.bench_summary(t.lineitem.select("l_returnflag", rank.alias("rank"), F.col("l_suppkey").alias("tokens"), F.col("l_quantity").alias("ms"), again.alias("again")), "l_returnflag")


@query("SELECT (SELECT count(*) FROM events) AS feedback, (SELECT count_if(value > 100) FROM events) AS helpful, (SELECT count(*) FROM benchmark) AS fixtures, (SELECT count_if(item_id % 2 = 0) FROM benchmark) AS learned")
def learn_status(t: Tables) -> DataFrame:
    fixtures = t.benchmark.select(F.when(F.col("item_id") % 2 == 0, "learned").otherwise("given").alias("origin"))
    return views.learn_status(t.events.select((F.col("value") > 100).alias("helpful")), fixtures)


@query("SELECT 'records' AS origin, CAST(o_orderkey AS VARCHAR) AS name, CAST(o_totalprice AS DOUBLE) AS drift FROM orders UNION ALL SELECT 'pairs', p_name, CAST(p_size AS DOUBLE) FROM part UNION ALL SELECT 'grounding', event_type, CAST(value AS DOUBLE) FROM events")
def drift_samples(t: Tables) -> DataFrame:
    return views.drift_samples(
        records=t.orders.select(F.col("o_orderkey").cast("string").alias("name"), F.col("o_totalprice").alias("drift")),
        pairs=t.part.select(F.col("p_name").alias("name"), F.col("p_size").alias("drift")),
        grounding=t.events.select(F.col("event_type").alias("name"), F.col("value").alias("drift")),
    )


@query("SELECT 'd' || doc_id AS stem, length(d.text) AS response_chars, length(p.html) AS bundle_chars FROM documents d JOIN pages p ON p.page_id = d.doc_id WHERE doc_id % 2 = 0")
def pair_stems(t: Tables) -> DataFrame:
    responses = t.documents.where("doc_id % 2 = 0").select(F.concat(F.lit("out/r.x/d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")
    bundles = t.pages.select(F.concat(F.lit("in/d"), F.col("page_id").cast("string"), F.lit(".json")).alias("path"), F.col("html").alias("text"))
    return views.stem_pairs(responses, bundles).select("stem", F.length("text").cast("long").alias("response_chars"), F.length("bundle").cast("long").alias("bundle_chars"))


@query("""
WITH f AS (SELECT l_orderkey AS record, l_linenumber * 1000000 + l_partkey AS pos, CASE l_suppkey % 4 WHEN 0 THEN 'audit/r' WHEN 1 THEN 'a/bundles/b' ELSE 'src/f' END || l_partkey % 9 AS rel_path, CAST(l_quantity AS INTEGER) AS tokens FROM lineitem),
k AS (SELECT record, rel_path, min(pos) AS pos FROM f WHERE starts_with(rel_path, 'src/') AND rel_path IN (SELECT 'src/f' || p_size % 8 FROM part) GROUP BY ALL),
l AS (SELECT record, string_agg(rel_path, ',' ORDER BY pos, rel_path) AS paths FROM k GROUP BY record)
SELECT record, CAST(sum(tokens) AS BIGINT) AS tokens, coalesce(any_value(paths), '') AS paths FROM f LEFT JOIN l USING (record) GROUP BY record
""")
def resume_seed(t: Tables) -> DataFrame:
    k = F.col("l_suppkey") % 4
    path = F.concat(F.when(k == 0, "audit/r").when(k == 1, "a/bundles/b").otherwise("src/f"), (F.col("l_partkey") % 9).cast("string"))
    f = t.lineitem.select(F.col("l_orderkey").alias("record"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("pos"), path.alias("rel_path"), F.col("l_quantity").cast("int").alias("tokens"))
    return views.resume_seed(f, t.part.select(F.concat(F.lit("src/f"), (F.col("p_size") % 8).cast("string")).alias("rel_path")))


@query("""
WITH e AS (SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'edit' WHEN 'view' THEN 'read' END AS kind, 'src/f' || user_id % 50 AS rel_path FROM events), b AS (SELECT DISTINCT 'src/f' || s_suppkey % 20 AS rel_path FROM supplier)
SELECT seq, kind, rel_path, rel_path IN (SELECT rel_path FROM b) AS in_context FROM e WHERE kind IS NOT NULL
""")
def grounding_events(t: Tables) -> DataFrame:
    tool = F.when(F.col("event_type") == "click", "Edit").when(F.col("event_type") == "view", "Read").otherwise(F.col("event_type"))
    path = F.concat(F.lit("./src/f"), (F.col("user_id") % 50).cast("string"))
    events = t.events.select(F.col("event_id").alias("seq"), tool.alias("tool"), path.alias("path"))
    return views.grounding_events(events, t.supplier.select(F.concat(F.lit("src/f"), (F.col("s_suppkey") % 20).cast("string")).alias("rel_path")))


@query(f"""
WITH {S.CHUNKS}, k AS (SELECT *, row_number() OVER (PARTITION BY rel_path ORDER BY start_line) AS k FROM chunks)
SELECT rel_path AS key, string_agg('// lines ' || start_line || '-' || start_line || chr(10) || content, '' ORDER BY k) AS excerpt FROM k WHERE k <= 5 GROUP BY rel_path
""")
def chunk_excerpts(t: Tables) -> DataFrame:
    return views.chunk_excerpts(chunks(t).withColumnRenamed("rel_path", "key"))


_ENTRIES = "e AS (SELECT user_id AS session_id, ts, event_id AS seq, CASE WHEN event_type = 'view' THEN 'q' || event_id % 9 ELSE '' END AS query, CASE WHEN event_type = 'click' THEN 'run ' || event_id % 5 ELSE '' END AS command, CASE WHEN value > 150 THEN 'ok' WHEN value > 50 THEN '' END AS outcome, CASE WHEN event_id % 11 = 0 THEN 'n' || event_id END AS notes FROM events)"


def _entries(t: Tables) -> DataFrame:
    k, kind, value = F.col("event_id"), F.col("event_type"), F.col("value")
    return t.events.select(
        F.col("user_id").alias("session_id"), "ts", k.alias("seq"), F.when(kind == "view", F.concat(F.lit("q"), (k % 9).cast("string"))).otherwise("").alias("query"),
        F.when(kind == "click", F.concat(F.lit("run "), (k % 5).cast("string"))).otherwise("").alias("command"), F.when(value > 150, "ok").when(value > 50, "").alias("outcome"), F.when(k % 11 == 0, F.concat(F.lit("n"), k.cast("string"))).alias("notes"),
    )


@query(f"""
WITH {_ENTRIES}, l AS (SELECT *, concat_ws(' | ', CASE WHEN query <> '' THEN 'Query: "' || query || '"' END, CASE WHEN command <> '' THEN 'Command: `' || command || '`' END, CASE WHEN outcome <> '' THEN 'Outcome: *' || outcome || '*' END, CASE WHEN notes <> '' THEN '(' || notes || ')' END) AS told FROM e)
SELECT session_id, string_agg('- **' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '**: ' || told, chr(10) ORDER BY ts, seq) AS text FROM l WHERE told <> '' GROUP BY session_id
""")
def session_timeline(t: Tables) -> DataFrame:
    return views.export(_entries(t), "timeline")


@query(f"""
WITH {_ENTRIES}, s AS (SELECT session_id, arg_max(query, (ts, seq)) FILTER (query <> '') AS last_query, arg_max(outcome, (ts, seq)) FILTER (outcome <> '') AS last_outcome, arg_max(notes, (ts, seq)) FILTER (notes <> '') AS last_notes,
  string_agg('`' || command || '`' || CASE WHEN outcome <> '' THEN ' -> *' || outcome || '*' ELSE '' END, chr(10) ORDER BY ts, seq) FILTER (command <> '') AS commands FROM e GROUP BY session_id) SELECT * FROM s
""")
def session_hand_off(t: Tables) -> DataFrame:
    return views.export(_entries(t), "hand_off")


@query("""
WITH r AS (SELECT n_regionkey, n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL)
SELECT n_regionkey, '| n_name | suppliers |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_name || ' | ' || suppliers || ' |', chr(10) ORDER BY n_name) AS report FROM r GROUP BY n_regionkey
""")
def markdown_report(t: Tables) -> DataFrame:
    rows = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_regionkey", "n_name").agg(F.count("s_suppkey").alias("suppliers"))
    return views.report(rows, "n_regionkey", "n_name", "suppliers")
