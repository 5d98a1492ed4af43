"""Queries of ledgers, gates, benches and the tuner."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import gates, ledgers
from .registry import Tables, query
from .tables import ledger

_L = "l AS (SELECT user_id, ts, event_id, event_type, value, json_extract_string(props, '$.k') AS target FROM events)"


@query(f"""
WITH {_L}, a AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM l WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT user_id, CAST(island AS BIGINT) AS island, event_type, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM b GROUP BY user_id, island, event_type
""")
def consolidate_islands(t: Tables) -> DataFrame:
    return ledgers.consolidate(ledger(t), "user_id", ["ts", "event_id"], "event_type")


@query(f"""
WITH {_L}, a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS c FROM l WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM b GROUP BY user_id, s
""")
def session_8h(t: Tables) -> DataFrame:
    return ledgers.sessions(ledger(t), "user_id")


@query(f"WITH {_L} SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM l GROUP BY user_id")
def latest_feedback(t: Tables) -> DataFrame:
    return ledgers.latest(ledger(t), "user_id", ["ts", "event_id"], "event_type", "value")


@query(f"""
WITH {_L}, f AS (SELECT * FROM l WHERE event_type = 'purchase'), u AS (SELECT * FROM l WHERE event_type = 'view')
SELECT f.user_id, f.ts, f.event_id, (SELECT arg_max(u.event_id, (u.ts, u.event_id)) FROM u WHERE u.user_id = f.user_id AND u.ts <= f.ts) AS usage_id FROM f
""")
def asof_usage(t: Tables) -> DataFrame:
    e = ledger(t)
    return ledgers.as_of(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), "user_id")


@query(f"""
WITH {_L}, m AS (SELECT user_id, max(ts) AS at FROM l WHERE event_type = 'signup' GROUP BY user_id)
SELECT l.user_id, l.target, l.ts FROM l JOIN m ON l.user_id = m.user_id AND l.ts = m.at AND l.event_type = 'signup'
WHERE NOT EXISTS (SELECT 1 FROM l x WHERE x.user_id = l.user_id AND x.event_type = 'click' AND x.ts >= m.at AND x.target = l.target)
""")
def pending_actions(t: Tables) -> DataFrame:
    return ledgers.pending(ledger(t), "user_id", "signup", "click").select("user_id", "target", "ts")


@query(f"WITH {_L} SELECT user_id, CAST(count(*) FILTER (event_type <> 'signup') AS BIGINT) AS attempts, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS failures, CAST(count(*) FILTER (event_type = 'signup') AS BIGINT) AS decisions FROM l GROUP BY user_id")
def loop_digest(t: Tables) -> DataFrame:
    command = F.when(F.col("event_type") == "signup", "decision").otherwise("task")
    return ledgers.digest(ledger(t).withColumn("command", command).withColumn("outcome", F.col("event_type")), "user_id")


@query(f"WITH {_L} SELECT event_id FROM l WHERE ts >= TIMESTAMP '2024-02-10' - INTERVAL 30 DAY")
def prune_ttl(t: Tables) -> DataFrame:
    return ledgers.retained(ledger(t), "2024-02-10").select("event_id")


@query(f"WITH {_L} SELECT event_id FROM l WHERE lower(event_type) LIKE '%rr%' OR coalesce(target, '') LIKE '%rr%'")
def ledger_search(t: Tables) -> DataFrame:
    return ledgers.search(ledger(t), "RR", "event_type", "target").select("event_id")


_U = "u AS (SELECT o_custkey AS session, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'initial' ELSE 'expand' END AS phase, o_orderstatus AS path, o_orderpriority AS mode, o_custkey % 11 AS tokens, 13 AS baseline FROM orders)"


@query(f"""
WITH {_U}, m AS (SELECT session, mode, min(seq) AS s FROM u GROUP BY session, mode), n AS (SELECT session, string_agg(mode, ',' ORDER BY s) AS modes FROM m GROUP BY session)
SELECT session, CAST(sum(CASE WHEN phase = 'initial' THEN tokens ELSE 0 END) AS BIGINT) AS initial_tokens, CAST(sum(CASE WHEN phase <> 'initial' THEN tokens ELSE 0 END) AS BIGINT) AS expansion_tokens,
  count(DISTINCT path) AS paths, any_value(modes) AS modes, CAST(sum(baseline) AS BIGINT) AS baseline, round(sum(tokens) / sum(baseline), 6) AS share FROM u JOIN n USING (session) GROUP BY session
""")
def context_usage_summary(t: Tables) -> DataFrame:
    u = t.orders.select(
        F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 3 == 0, "initial").otherwise("expand").alias("phase"),
        F.col("o_orderstatus").alias("path"), F.col("o_orderpriority").alias("mode"), (F.col("o_custkey") % 11).alias("tokens"), F.lit(13).alias("baseline"),
    )
    return ledgers.usage_summary(u, "session")


@query("""
SELECT l_returnflag AS origin, count(*) AS events, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS edits,
  CAST(sum(CASE WHEN (CASE WHEN l_linestatus = 'F' THEN l_linenumber > 2 ELSE l_quantity / 50 >= 0.5 AND l_discount * 10 < 0.5 END) THEN 1 ELSE 0 END) AS BIGINT) AS grounded,
  CAST(sum(CASE WHEN (CASE WHEN l_linestatus = 'F' THEN l_linenumber > 2 ELSE l_quantity / 50 >= 0.5 AND l_discount * 10 < 0.5 END) THEN 0 ELSE 1 END) AS BIGINT) AS concerning, round(avg(l_discount * 10), 6) AS mean_drift
FROM lineitem GROUP BY l_returnflag
""")
def grounding_summary(t: Tables) -> DataFrame:
    e = t.lineitem.select(
        F.col("l_returnflag").alias("origin"), F.when(F.col("l_linestatus") == "F", "edit").otherwise("answer").alias("kind"), (F.col("l_linenumber") > 2).alias("in_context"),
        (F.col("l_quantity") / 50).alias("grounded_ratio"), (F.col("l_discount") * 10).alias("drift_rate"),
    )
    return ledgers.grounding_summary(e, "origin")


@query("""
SELECT model, count(*) AS requests, CAST(sum(saved) AS BIGINT) AS saved, round(sum(round(saved * rate / 1000000, 9)), 6) AS usd FROM (
  SELECT CASE WHEN p_size % 2 = 0 THEN 'gpt-x' ELSE 'other' END AS model, greatest(0, p_size * 40 - 800) AS saved, CASE WHEN p_size % 2 = 0 THEN 2.5 ELSE 3.0 END AS rate FROM part) GROUP BY model
""")
def proxy_summary(t: Tables) -> DataFrame:
    logs = t.part.select(F.when(F.col("p_size") % 2 == 0, "gpt-x").otherwise("other").alias("model"), (F.col("p_size") * 40).alias("before"), F.lit(800).alias("after"))
    return ledgers.proxy_savings(logs).groupBy("model").agg(F.count("*").alias("requests"), F.sum("saved").cast("long").alias("saved"), F.round(F.sum("usd"), 6).alias("usd"))


@query("SELECT source, count(*) AS n, round(avg(quality), 6) AS yes_rate, CASE WHEN count(*) < 10 THEN 'SKIP' WHEN round(avg(quality), 6) < 0.8 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM labels JOIN documents USING (doc_id) GROUP BY source")
def gate_g1(t: Tables) -> DataFrame:
    r = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select("source", F.when(F.col("quality") == 1, "yes").otherwise("no").alias("rating"))
    return gates.yes_rate(r, "source")


@query("""
WITH b AS (SELECT o_orderpriority AS route, round(o_totalprice / 400000, 6) AS share FROM orders)
SELECT route, count(*) AS n, CAST(sum(CASE WHEN share > 1 THEN 1 ELSE 0 END) AS BIGINT) AS overshoots, quantile_disc(share, 0.5) AS median_share, quantile_disc(share, 0.95) AS p95_share,
  CASE WHEN max(share) > 1 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM b GROUP BY route
""")
def gate_g2_percentiles(t: Tables) -> DataFrame:
    return gates.budget_discipline(t.orders.select(F.col("o_orderpriority").alias("route"), F.col("o_totalprice").alias("used"), F.lit(400000.0).alias("budget")), "route")


@query("""
WITH r AS (SELECT p_brand AS corpus, p_partkey AS question, p_size / 50 AS recall FROM part)
SELECT corpus, count(*) AS n, round(avg(recall), 6) AS mean_recall, CAST(sum(CASE WHEN recall >= 0.999 THEN 1 ELSE 0 END) AS BIGINT) AS perfect, arg_min(question, (recall, question)) AS worst, CASE WHEN round(avg(recall), 6) >= 0.8 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM r GROUP BY corpus
""")
def gate_g3(t: Tables) -> DataFrame:
    return gates.mean_recall(t.part.select(F.col("p_brand").alias("corpus"), F.col("p_partkey").alias("question"), (F.col("p_size") / 50).alias("recall")), "corpus")


@query("SELECT l_shipdate_y AS origin, count(*) AS n, round(quantile_cont(l_discount, 0.5), 6) AS median_drift, CASE WHEN round(quantile_cont(l_discount, 0.5), 6) <= 0.15 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT year(l_shipdate) AS l_shipdate_y, l_discount FROM lineitem) GROUP BY l_shipdate_y")
def gate_g4_median(t: Tables) -> DataFrame:
    return gates.median_drift(t.lineitem.select(F.year("l_shipdate").cast("long").alias("origin"), F.col("l_discount").alias("drift")), "origin")


@query("SELECT c_nationkey, CASE WHEN max(v) = 3 THEN 'FAIL' WHEN max(v) = 2 THEN 'WARN' WHEN max(v) = 1 THEN 'PASS' ELSE 'SKIP' END AS verdict FROM (SELECT c_nationkey, CASE WHEN c_acctbal < -900 THEN 3 WHEN c_acctbal < 0 THEN 2 WHEN c_acctbal < 5000 THEN 1 ELSE 0 END AS v FROM customer) GROUP BY c_nationkey")
def verdict_rollup(t: Tables) -> DataFrame:
    b = F.col("c_acctbal")
    v = F.when(b < -900, "FAIL").when(b < 0, "WARN").when(b < 5000, "PASS").otherwise("SKIP")
    return gates.rollup(t.customer.select("c_nationkey", v.alias("verdict")), "c_nationkey")


@query("SELECT c_custkey AS question, round(c_acctbal / 10000, 6) AS was, round(c_nationkey / 25, 6) AS recall FROM customer WHERE c_custkey % 4 <> 0 AND c_acctbal / 10000 - c_nationkey / 25 > 0.05")
def baseline_diff(t: Tables) -> DataFrame:
    now = t.customer.select(F.col("c_custkey").alias("question"), (F.col("c_nationkey") / 25).alias("recall"))
    return gates.regressions(now, t.customer.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("question"), (F.col("c_acctbal") / 10000).alias("recall")))


@query("""
WITH r AS (SELECT l_orderkey AS q, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem),
f AS (SELECT l.l_orderkey AS q, min(r.rank) AS rank FROM lineitem l LEFT JOIN r ON r.q = l.l_orderkey AND r.p = l.l_partkey WHERE l.l_returnflag = 'R' GROUP BY l.l_orderkey)
SELECT count(*) AS questions, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 6) AS top3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS top5, round(avg(CASE WHEN rank <= 5 THEN rank END), 6) AS mean_rank FROM f
""")
def bench_topk(t: Tables) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber"))
    ranked = t.lineitem.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("rel_path"), rank.alias("rank"))
    expected = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("rel_path"))
    return gates.rank_bench(ranked, expected)


@query("SELECT o_orderpriority, list_sort(list(o_totalprice))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1] AS value FROM orders GROUP BY o_orderpriority")
def bench_pctile_floor(t: Tables) -> DataFrame:
    return gates.floor_percentile(t.orders.select("o_orderpriority", F.col("o_totalprice").alias("value")), 0.95, "o_orderpriority")


@query("""
WITH h AS (SELECT l_orderkey AS query_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey, l_suppkey) AS pos, CAST(l_quantity AS BIGINT) AS tokens, CASE WHEN l_tax > 0.02 THEN l_suppkey END AS fact FROM lineitem),
n AS (SELECT *, CASE WHEN fact IS NOT NULL AND row_number() OVER (PARTITION BY query_id, fact ORDER BY pos) = 1 THEN 1 ELSE 0 END AS new FROM h),
w AS (SELECT query_id, pos, sum(new) OVER x AS found, sum(tokens) OVER x AS whole FROM n WINDOW x AS (PARTITION BY query_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
t AS (SELECT o_orderkey AS query_id, o_custkey % 3 AS facts, o_custkey % 40 AS tokens FROM orders),
r AS (SELECT query_id, tokens, coalesce(min(CASE WHEN found >= facts THEN pos END), max(pos)) AS pos, coalesce(min(CASE WHEN found >= facts THEN whole END), max(whole)) AS whole FROM w JOIN t USING (query_id) GROUP BY query_id, tokens)
SELECT query_id, pos AS files, CAST(whole AS BIGINT) AS whole_tokens, round(CASE WHEN whole > 0 THEN 1 - tokens / whole ELSE 0.0 END, 6) AS reduction FROM r
""")
def economy_iso_recall(t: Tables) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey"))
    hits = t.lineitem.select(F.col("l_orderkey").alias("query_id"), pos.alias("pos"), F.col("l_quantity").cast("long").alias("tokens"), F.when(F.col("l_tax") > 0.02, F.col("l_suppkey")).alias("fact"))
    target = t.orders.select(F.col("o_orderkey").alias("query_id"), (F.col("o_custkey") % 3).alias("facts"), (F.col("o_custkey") % 40).alias("tokens"))
    return gates.iso_recall(hits, target)


_W = "w AS (SELECT * FROM (VALUES ('c0', 'qty', 1.0), ('c0', 'tax', 2.0), ('c1', 'qty', 0.5), ('c1', 'tax', 9.0)) AS x(candidate, feature, weight))"


@query(f"""
WITH {_W}, f AS (SELECT l_orderkey AS query_id, l_partkey AS rel_path, 'qty' AS feature, l_quantity AS amount FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, 'tax', l_tax FROM lineitem)
SELECT candidate, query_id, rel_path, round(sum(amount * weight), 6) AS score FROM f JOIN w USING (feature) GROUP BY candidate, query_id, rel_path
""")
def tune_eval_grid(t: Tables) -> DataFrame:
    weights = t.spark.createDataFrame([("c0", "qty", 1.0), ("c0", "tax", 2.0), ("c1", "qty", 0.5), ("c1", "tax", 9.0)], "candidate string, feature string, weight double")
    pick = lambda name, c: t.lineitem.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("rel_path"), F.lit(name).alias("feature"), F.col(c).alias("amount"))
    return gates.weighted(pick("qty", "l_quantity").unionByName(pick("tax", "l_tax")), weights)


@query("WITH e AS (SELECT p_type AS candidate, p_brand AS corpus, avg(p_size / 49.0) AS r, avg(p_retailprice) AS t FROM part GROUP BY ALL) SELECT candidate, round(avg(r), 6) AS recall, round(avg(t), 6) AS tokens FROM e GROUP BY candidate")
def tune_macro_avg(t: Tables) -> DataFrame:
    return gates.macro_average(t.part.select(F.col("p_type").alias("candidate"), F.col("p_brand").alias("corpus"), (F.col("p_size") / 49.0).alias("recall"), F.col("p_retailprice").alias("tokens")))
