"""Queries of the index and of relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import index
from . import sql as S
from .registry import Tables, query
from .tables import chunks, corpus


@query(f"WITH {S.FILES} SELECT rel_path, lang, CAST(strlen(content) AS BIGINT) AS size, CAST(CASE WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + CASE WHEN content LIKE '%' || chr(10) THEN 0 ELSE 1 END END AS INTEGER) AS lines, sha256(content) AS checksum FROM files WHERE lang IS NOT NULL")
def build_files(t: Tables) -> DataFrame:
    return index.file_table(corpus(t))


@query(f"WITH {S.CHUNKS} SELECT rel_path, CAST(start_line AS INTEGER) AS start_line, symbol, sha256(content) AS content_hash, token_estimate FROM chunks")
def build_chunks(t: Tables) -> DataFrame:
    return chunks(t).select("rel_path", "start_line", "symbol", "content_hash", "token_estimate")


_ID = "trim(regexp_replace(trim(lower('line:' || symbol), ' '), '[^a-zA-Z0-9._-]+', '-', 'g'), '-')"


@query(f"""
WITH {S.CHUNKS}, ids AS (SELECT rel_path, start_line, {_ID} AS id FROM chunks),
k AS (SELECT *, row_number() OVER (PARTITION BY rel_path, id ORDER BY start_line) AS k FROM ids)
SELECT rel_path, CAST(start_line AS INTEGER) AS start_line, CASE WHEN k > 1 THEN id || '-' || k ELSE id END AS chunk_id FROM k
""")
def chunk_id_unique(t: Tables) -> DataFrame:
    c = chunks(t).withColumn("chunk_id", index.chunk_id(F.col("kind"), F.col("symbol")))
    return index.unique_ids(c).select("rel_path", "start_line", "chunk_id")


@query(f"""
WITH {S.FILES}, l AS (SELECT rel_path, string_split(regexp_replace(content, '\\n$', ''), chr(10)) AS ls FROM files),
n AS (SELECT rel_path, unnest(ls) AS line, generate_subscripts(ls, 1) AS n, len(ls) AS last FROM l),
h AS (SELECT *, regexp_matches(line, '^([A-Z][a-z]+)\\s+(of.*)') AS head FROM n),
s AS (SELECT * FROM h WHERE head OR n = 1)
SELECT rel_path, CASE WHEN head THEN trim(regexp_extract(line, '^([A-Z][a-z]+)\\s+(of.*)', 2), ' ') ELSE 'preamble' END AS symbol, CAST(n AS INTEGER) AS start_line,
  CAST(coalesce(lead(n) OVER (PARTITION BY rel_path ORDER BY n) - 1, last) AS INTEGER) AS end_line FROM s
""")
def sections(t: Tables) -> DataFrame:
    return index.sections(corpus(t).select("rel_path", "content"), r"^([A-Z][a-z]+)\s+(of.*)")


@query("""
WITH c AS (SELECT 'g' || p_size AS rel_path, p_partkey AS pos, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_brand || '.' || p_name END AS symbol FROM part),
f AS (SELECT rel_path, symbol, min(pos) AS parent FROM c GROUP BY ALL)
SELECT c.rel_path, c.pos, f.parent FROM c LEFT JOIN f ON c.rel_path = f.rel_path AND strpos(c.symbol, '.') > 0 AND split_part(c.symbol, '.', 1) = f.symbol
""")
def assign_parents(t: Tables) -> DataFrame:
    symbol = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.concat_ws(".", "p_brand", "p_name"))
    c = t.part.select(F.concat(F.lit("g"), F.col("p_size").cast("string")).alias("rel_path"), F.col("p_partkey").alias("pos"), F.col("p_partkey").alias("chunk_id"), symbol.alias("symbol"))
    return index.with_parents(c).select("rel_path", "pos", F.col("parent_id").alias("parent"))


@query("SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def upsert_rows(t: Tables) -> DataFrame:
    old = t.customer.select("c_custkey", "c_acctbal")
    return index.upsert(old, t.customer.where("c_nationkey < 5").select("c_custkey", F.lit(0.0).alias("c_acctbal")), "c_custkey")


@query(f"WITH {S.CHUNKS}, e AS (SELECT DISTINCT sha256(text) AS content_hash FROM documents) SELECT content_hash FROM e WHERE content_hash NOT IN (SELECT sha256(content) FROM chunks)")
def prune_orphans_anti(t: Tables) -> DataFrame:
    embeddings = t.documents.select(F.sha2("text", 256).alias("content_hash")).distinct()
    return index.unreferenced(embeddings, chunks(t))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def delete_removed_semi(t: Tables) -> DataFrame:
    alive = t.orders.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("rel_path"))
    return index.live(t.lineitem.select("l_orderkey", "l_linenumber"), alive, "l_orderkey").select("l_orderkey", "l_linenumber")


@query(f"WITH {S.FILES} SELECT rel_path FROM files LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality = 0")
def stale_files(t: Tables) -> DataFrame:
    files = corpus(t).select("doc_id", "rel_path", F.sha2("content", 256).alias("checksum"))
    current = files.join(t.labels, "doc_id").select("rel_path", F.when(F.col("quality") == 1, F.col("checksum")).otherwise("changed").alias("checksum"))
    return index.stale(files, current).select("rel_path")


@query("SELECT o_orderkey AS rel_path FROM orders WHERE o_totalprice > 100000 OR o_orderdate > TIMESTAMP '1996-01-01'")
def changed_files(t: Tables) -> DataFrame:
    listing = t.orders.select(F.col("o_orderkey").alias("rel_path"), F.when(F.col("o_totalprice") > 100000, 2).otherwise(1).alias("size"), F.col("o_orderdate").alias("modified"))
    known = t.orders.select(F.col("o_orderkey").alias("rel_path"), F.lit(1).alias("size"), F.expr("timestamp'1996-01-01'").alias("indexed_at"))
    return index.changed(listing, known).select("rel_path")


@query(f"WITH {S.CHUNKS} SELECT rel_path, CAST(start_line AS INTEGER) AS start_line, symbol FROM chunks WHERE lower(symbol) LIKE '%the%'")
def search_chunks_filter(t: Tables) -> DataFrame:
    c = chunks(t).withColumn("chunk_id", F.col("pos").cast("string"))
    return index.search_chunks(c, symbol="the").select("rel_path", "start_line", "symbol")


_LINKS = "links AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"/([^\"/?#]+)', 1)) AS import FROM pages)"
_HOSTS = "hosts AS (SELECT page_id, regexp_replace(regexp_extract(url, '://([^/]+)', 1), '\\.', '/', 'g') AS dir FROM pages)"


@query(f"""
WITH {_HOSTS}, i AS (SELECT page_id AS source, dir AS import FROM hosts), d AS (SELECT DISTINCT page_id AS target, regexp_replace(dir, '^[^/]+/', '') AS dir FROM hosts)
SELECT DISTINCT source, target FROM i JOIN d ON (dir = import OR ends_with(dir, '/' || import) OR ends_with(import, '/' || dir)) WHERE source <> target
""")
def relations_suffix_join(t: Tables) -> DataFrame:
    hosts = t.pages.select("page_id", F.regexp_replace(F.regexp_extract("url", "://([^/]+)", 1), r"\.", "/").alias("dir"))
    imports = hosts.select(F.col("page_id").alias("source"), F.col("dir").alias("import"))
    dirs = hosts.select(F.col("page_id").alias("target"), F.regexp_replace("dir", "^[^/]+/", "").alias("dir")).distinct()
    return index.suffix_relations(imports, dirs)


@query(f"WITH {S.FILES} SELECT DISTINCT a.rel_path, b.rel_path AS target FROM files a JOIN files b ON split_part(a.rel_path, '/', 1) = split_part(b.rel_path, '/', 1) AND b.doc_id = a.doc_id + 20 AND regexp_matches(b.rel_path, '\\.(ts|py)$')")
def relations_relative(t: Tables) -> DataFrame:
    files = corpus(t)
    imports = files.select("rel_path", F.concat(F.lit("../"), F.substring_index("rel_path", "/", 1), F.lit("/./"), (F.col("doc_id") + 20).cast("string")).alias("import"))
    return index.relative_relations(files, imports)


_RELATIONS = "rel AS (SELECT DISTINCT l_orderkey AS source, l_partkey AS target FROM lineitem)"


@query(f"""
WITH {_RELATIONS}, r AS (SELECT 'o' || source AS source, 'p' || target AS target FROM rel), p AS (SELECT source AS path FROM r UNION SELECT target FROM r),
a AS (SELECT source AS path, string_agg(target, ',' ORDER BY target) AS s FROM r GROUP BY source), b AS (SELECT target AS path, string_agg(source, ',' ORDER BY source) AS s FROM r GROUP BY target)
SELECT p.path, coalesce(a.s, '') AS dependencies, coalesce(b.s, '') AS dependents FROM p LEFT JOIN a USING (path) LEFT JOIN b USING (path)
""")
def logic_map(t: Tables) -> DataFrame:
    named = lambda c, x: F.concat(F.lit(x), F.col(c).cast("string"))
    return index.logic_map(t.lineitem.select(named("l_orderkey", "o").alias("source"), named("l_partkey", "p").alias("target")).distinct())


@query("""
WITH f AS (SELECT 'src/' || s_suppkey || '.go' AS path, CAST(s_suppkey AS VARCHAR) AS stem, s_nationkey AS k, false AS test FROM supplier
  UNION ALL SELECT 'src/' || s_suppkey || '_' || s_nationkey || '_test.go', s_suppkey || '_' || s_nationkey, s_nationkey, true FROM supplier WHERE s_nationkey % 2 = 0),
r AS (SELECT DISTINCT 'src/' || a.s_suppkey || '_' || a.s_nationkey || '_test.go' AS source, 'src/' || l.l_suppkey || '.go' AS target FROM supplier a JOIN lineitem l ON l.l_partkey = a.s_suppkey WHERE a.s_nationkey % 2 = 0)
SELECT f.path AS rel_path, t.path AS test FROM f JOIN f t ON t.test AND (contains(t.stem, f.stem) OR contains(f.stem, t.stem))
UNION SELECT r.target, r.source FROM r JOIN f ON f.path = r.target UNION SELECT r.source, r.target FROM r JOIN f ON f.path = r.target
""")
def related_tests(t: Tables) -> DataFrame:
    """Tests by stems that are equal or hold one another, and by what depends on what."""
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    test = F.concat(F.lit("src/"), key, F.lit("_"), nation, F.lit("_test.go"))
    tested = t.supplier.where("s_nationkey % 2 = 0")
    files = t.supplier.select(F.concat(F.lit("src/"), key, F.lit(".go")).alias("rel_path")).unionByName(tested.select(test.alias("rel_path")))
    relations = tested.select(test.alias("source"), F.col("s_suppkey").alias("l_partkey")).join(t.lineitem.select("l_partkey", "l_suppkey"), "l_partkey").select("source", F.concat(F.lit("src/"), F.col("l_suppkey").cast("string"), F.lit(".go")).alias("target")).distinct()
    return index.related_tests(files, relations)


@query(f"WITH {S.FILES} SELECT coalesce(lang, 'none') AS lang, count(*) AS files, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM files GROUP BY ALL")
def lang_breakdown(t: Tables) -> DataFrame:
    return corpus(t).groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).cast("long").alias("bytes"))


@query("SELECT ext, count(*) AS n, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM (SELECT regexp_extract(url, '\\.([a-z]+)/', 1) AS ext, html FROM pages) GROUP BY ext ORDER BY n DESC, ext LIMIT 10")
def extension_rollup(t: Tables) -> DataFrame:
    p = t.pages.select(F.regexp_extract("url", r"\.([a-z]+)/", 1).alias("ext"), F.octet_length("html").alias("b"))
    return p.groupBy("ext").agg(F.count("*").alias("n"), F.sum("b").cast("long").alias("bytes")).orderBy(F.desc("n"), "ext").limit(10)
