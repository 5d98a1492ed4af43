"""URL filters: a cascade of Bloom filters over the sites of the corpus.

The first filter encodes the listed sites; the second the other sites of the
corpus that the first lets through; the third the listed ones that the second
lets through; and so on until a filter lets nothing through.  A site is judged by
the first filter that lacks it: listed if that is an even one.  Since the levels
are built over every site that the corpus holds, no url of it is judged wrongly,
and none of its rows is joined or moved.

Everything is a DataFrame expression: bits are gathered by ``bit_or``, a filter is
one row of 64-bit words, and rows test it through a scalar subquery.  A filter takes
about 1.44 * log2(sites / listed) bits a listed site; beyond ``most`` bytes in all
the listed sites are joined to the hosts instead.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, written

#: Words of an array in a filter (8 MB); a larger filter has several.
_SEGMENT = 1 << 20
#: Limits of domain names: characters and labels.
_LONGEST, _LABELS = 253, 127
#: Label counts of listed sites that rows test one by one.
_UNROLLED = 16


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str


@dataclass(frozen=True)
class Level:
    """A Bloom filter: a table of one row, ``words``, an array of segments of 64-bit words."""

    filter: DataFrame
    number: int
    segments: int
    words: int
    hashes: int

    def positions(self, site: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(site, F.lit(self.number), F.lit(j)), F.lit(64 * self.words)) for j in range(self.hashes)]

    def segment(self, site: Column) -> Column:
        return F.pmod(F.xxhash64(site, F.lit(-self.number)), F.lit(self.segments)).cast("int")

    def holds(self, site: Column) -> Column:
        words = F.get(self.filter.scalar(), self.segment(site))
        return reduce(and_, (F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1 for p in self.positions(site)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first :// up to / ? or #, A-Z lower-cased, and what follows that up to ? or #; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    until = lambda c, marks: reduce(lambda s, m: F.substring_index(s, m, 1), marks, c)
    host = until(rest, "/?#")
    path = until(F.substring(rest, F.length(host) + 1, F.length(rest)), "?#")
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def sites_of(host: Column) -> Column:
    """A host and the domains above it, as far as they can be domain names."""
    labels = F.least(F.size(F.split(host, r"\.")), F.lit(_LABELS))
    each = F.transform(F.sequence(F.lit(1), labels), lambda n: F.call_function("substring_index", host, F.lit("."), -n))
    return F.filter(each, lambda s: (s != "") & (F.length(s) <= _LONGEST))


def labels(site: Column) -> Column:
    return F.size(F.split(site, r"\."))


def _level(sites: DataFrame, n: int, number: int, hashes: int) -> Level:
    """A filter of n sites in which about one of 2**hashes others is found."""
    words = max(1, math.ceil(n * hashes / math.log(2) / 64))
    segments = math.ceil(words / _SEGMENT)
    level = Level(sites, number, segments, math.ceil(words / segments), hashes)
    site = F.col("site")
    bits = sites.select(level.segment(site).alias("segment"), F.explode(F.array(*level.positions(site))).alias("p"))
    bits = bits.select("segment", F.shiftright("p", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(p % 64 AS int))").alias("bits"))
    empty = sites.sparkSession.range(level.words).select(F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("segment"), F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    filled = bits.unionByName(empty).groupBy("segment", "word").agg(F.bit_or("bits").alias("bits"))
    ordered = lambda rows, value: F.transform(F.array_sort(F.collect_list(F.struct(*rows))), lambda r: r[value])
    segment = filled.groupBy("segment").agg(ordered(("word", "bits"), "bits").alias("words"))
    whole = written(segment.agg(ordered(("segment", "words"), "words").alias("words")), "filter")
    return Level(whole, number, segments, level.words, hashes)


def size_of(listed: int, others: int) -> tuple[int, int]:
    """Hashes of the first filter, and bytes of all of them at most (later ones hold half as many sites each)."""
    hashes = min(max(1, round(math.log2(max(1, others) / max(1, listed)) + 0.5)), 24)
    return hashes, math.ceil((listed * hashes + 4 * listed) / math.log(2) / 8)


def cascade(sites: DataFrame, most: int) -> list[Level] | None:
    """The levels for sites(site, listed), distinct ones; None if they would take over ``most`` bytes."""
    sites = written(sites, "sites")
    pools = {True: sites.where("listed").select("site"), False: sites.where("not listed").select("site")}
    sizes = {side: pool.count() for side, pool in pools.items()}
    hashes, size = size_of(sizes[True], sizes[False])
    if size > most:
        return None
    levels: list[Level] = []
    side = True
    while sizes[side]:
        level = _level(pools[side], sizes[side], len(levels) + 1, hashes if not levels else 1)
        levels.append(level)
        side = not side
        pools[side] = cut(pools[side].where(level.holds(F.col("site"))))
        sizes[side] = pools[side].count()
    return levels


def listed_in(levels: list[Level], site: Column) -> Column:
    """Whether a site of the corpus is listed."""
    found = F.lit(len(levels) % 2 == 1)
    for k in range(len(levels) - 1, -1, -1):
        found = F.when(levels[k].holds(site), found).otherwise(F.lit(k % 2 == 1))
    return found


def fitting_rule(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, of equals that with the longer host; null without one."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), len(r.host), r.host)):
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, r.host + r.path).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = (), *, most: int = 64 << 20) -> DataFrame:
    """Judges every url of pages(page_id, url): page_id, host, path, rule, verdict (allow or block).

    The longest of ``rules`` that fits decides; without one a url is blocked if its
    host, or a domain above it, is in listed(site).  ``most`` bounds the bytes of
    all filters, which go through the driver; listed sites that the corpus does not
    hold take no room.

    A null url, and one without ://, has an empty host and path, fits no rule and is
    allowed.  A null site, or one that is no domain name, is passed over, repeated
    ones count once.  Rows are kept as often as they are there, null page_ids too.
    Other columns are ignored; an empty table gives no row.
    """
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    hosts = parts.select("host").where("host <> ''").distinct()
    names = written(hosts.select(F.explode(sites_of(F.col("host"))).alias("site")).distinct().join(listed.where("site is not null").select("site").distinct(), "site", "left_semi"), "listed")
    counts = [r.n for r in names.select(labels(F.col("site")).alias("n")).distinct().orderBy("n").limit(_UNROLLED + 1).collect()]
    levels = None
    if len(counts) <= _UNROLLED:
        own = F.array(*(F.substring_index("host", ".", -n) for n in counts)) if counts else F.array().cast("array<string>")
        sites = hosts.select(F.explode(own).alias("site")).distinct()
        levels = cascade(sites.join(names.withColumn("listed", F.lit(True)), "site", "left").select("site", F.coalesce("listed", F.lit(False)).alias("listed")), most)
    if levels is None:
        held = hosts.select("host", F.explode(sites_of(F.col("host"))).alias("site")).join(names, "site").select("host").distinct()
        parts = parts.join(held.withColumn("held", F.lit(True)), "host", "left")
        blocked = F.coalesce("held", F.lit(False))
    else:
        tests = (listed_in(levels, F.substring_index("host", ".", -n)) for n in counts)
        blocked = (F.col("host") != "") & reduce(lambda a, b: a | b, tests, F.lit(False))
    rule, verdict = fitting_rule(rules, F.col("host"), F.col("path"))
    judged = F.coalesce(verdict, F.when(blocked, "block").otherwise("allow"))
    return parts.select("page_id", "host", "path", rule.alias("rule"), judged.alias("verdict"))


#: Rules of the query, and the words that list a site whose own label holds them between hyphens.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))
WORDS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam", "track", "win")


def sites_named(pages: DataFrame, words: Sequence[str]) -> DataFrame:
    """site: those of pages(url) whose own label, split at hyphens, holds one of the words."""
    hosts = pages.select(host_and_path(F.col("url"))[0].alias("host")).distinct()
    sites = hosts.select(F.explode(sites_of(F.col("host"))).alias("site")).distinct()
    return sites.where(F.arrays_overlap(F.split(F.substring_index("site", ".", 1), "-"), F.array(*map(F.lit, words))))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages: the five rules, else the sites whose names hold a listed word."""
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, sites_named(pages, WORDS), RULES)


OP13_SQL = f"""
WITH split AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM split
), parts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM cut
), ruled AS (
  SELECT *, CASE WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/' WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/' WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/' WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN list_has_any(string_split(regexp_replace(host, '[.]', '-', 'g'), '-'), [{", ".join(f"'{w}'" for w in WORDS)}]) THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
