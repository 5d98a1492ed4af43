"""URL filters: exact membership by the cascade, and odd urls."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import queries as Q
from lodestone.llm import url_filter as U
from tests.oracle import connect, differences


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def judged(url, listed, rules=U.RULES):
    host, path = parts(url)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host)))
        return host, path, best.host + best.path, best.verdict
    steps = host.split(".")
    return host, path, None, "block" if host and any(".".join(steps[k:]) in listed for k in range(len(steps))) else "allow"


def result(spark, urls, listed, rules=U.RULES, **options):
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    sites = spark.createDataFrame([(s,) for s in listed], "site string")
    rows = U.filter_urls(pages, sites, rules, **options).collect()
    assert sorted(r.page_id for r in rows) == list(range(len(urls)))
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}


def test_against_sql(spark, sf_dir):
    assert not differences(Q.queries()["op13_url_filter"](spark, sf_dir), connect(sf_dir), Q.oracle_sql()["op13_url_filter"])


def test_native(spark, sf_dir):
    plan = U.op13_url_filter(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|BroadcastExchange|SortMergeJoin|HashJoin|NestedLoop|Cartesian", plan)


URLS = [
    None, "", "no scheme", "://", "http://", "http:///en/x", "HTTP://WWW.Example.COM/en/", "http://example.com/en/1", "http://a.example.com/en", "http://www.example.com/en/x?y#z", "http://b.www.example.com/en/x",
    "http://x.net/es/1", "http://x.net/fr/1", "http://net/fr/1", "http://xnet/fr/1", "http://x.net/de/1", "https://ads.x.org?q=/en/", "https://ads.x.org#f", "http://a://b/c", "x://ÄÖ.com/en/", "http://a.com:80/en/", "http://a..b/", "http://b/", "http://" + "a." * 300 + "org/x", "http://" + "y" * 400 + "/p", "http://deep.sub.ads.x.org/\n/en/", "http://spam-farm.example.org/",
]


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_odd_urls(spark, most):
    listed = ["ads.x.org", "b", "org.", "spam-farm.example.org", "", "not.met.org"]
    got = result(spark, [*URLS, *URLS], [*listed, None, "b"], most=most)
    assert got == {k: judged(u, set(listed) - {""}) for k, u in enumerate([*URLS, *URLS])}


@pytest.mark.parametrize(("hosts", "share"), [(4000, 0.02), (3000, 0.5), (2000, 1.0), (500, 0.0)])
def test_cascade_is_exact(spark, hosts, share):
    rng = random.Random(hosts)
    names = [f"h{k}.{rng.choice(['a', 'b.c', 'd'])}.org" for k in range(hosts)]
    listed = {n for n in names if rng.random() < share} | {"nowhere.org"}
    got = result(spark, [f"http://{n}/{k}" for k, n in enumerate(names)], listed, ())
    assert [got[k][3] for k in range(hosts)] == ["block" if n in listed else "allow" for n in names]


def test_segments_hold_all_bits(spark, monkeypatch):
    monkeypatch.setattr(U, "_SEGMENT", 4)
    names = [f"h{k}.org" for k in range(1500)]
    sites = spark.createDataFrame([(n, k % 3 == 0) for k, n in enumerate(names)], "site string, listed boolean")
    levels = U.cascade(sites, 1 << 20)
    assert levels[0].segments > 3 and len(levels) > 1
    rows = sites.select("site", "listed", U.listed_in(levels, F.col("site")).alias("found")).collect()
    assert all(r.listed == r.found for r in rows)
    assert U.cascade(sites, 8) is None


def test_listed_sites_of_many_depths_are_joined(spark):
    names = [".".join("x" * k) + ".org" for k in range(1, 25)]
    got = result(spark, [f"http://{n}/" for n in names], names[::2], ())
    assert all(v[3] == "block" for v in got.values())


def test_equal_rules_and_empty_tables(spark):
    rules = (U.Rule("block", "com", "/a/b/"), U.Rule("allow", "x.com", "/a/"))
    assert result(spark, ["http://x.com/a/b/c"], [], rules)[0][2:] == ("x.com/a/", "allow")
    rules = (U.Rule("block", "com", "/abc/"), U.Rule("allow", "xy.com", "/a"))
    assert result(spark, ["http://xy.com/abc/c"], [], rules)[0][2:] == ("xy.com/a", "allow")
    assert result(spark, [], ["a.org"]) == {}
    clash = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "site", "listed", "words", "held")})
    assert [r.verdict for r in U.filter_urls(clash, spark.createDataFrame([("a.org", 1)], "site string, host int")).collect()] == ["block"]
