"""Bundles: greedy packing under a token budget, interval merging, hashes and rendering."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import kept

#: Tokens reserved for the header, the least score packed, and the representations' limits.
RESERVE, LEAST_SCORE = 80, 0.1
FULL_TOKENS, FULL_TOKENS_LEAN, SIGNATURE_TOKENS, EXCERPT_TOKENS, EXCERPT_TOP = 600, 180, 350, 800, 3


def pack_greedy(hits: DataFrame, budget: int, *, reserve: int = RESERVE, max_fragments: int = 0, max_files: int = 0) -> DataFrame:
    """Takes each question's hits by rank while they fit; one that does not fit is passed over and later ones may still fit.

    hits(query_id, rank, rel_path, tokens, score), at most some dozens a question
    (a search returns 50 at most).  max_fragments ends the bundle, max_files
    passes over hits of further files; 0 is no limit.  Hits under the least score
    end it.  Returns query_id, rank, rel_path, tokens, used (with the reserve, so
    far).  Hits without tokens are passed over.
    """
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "rel_path", "tokens", "score"))).alias("hits"))
    kind = "struct<used:int,open:boolean,files:array<string>,taken:array<struct<rank:int,rel_path:string,tokens:int,used:int>>>"
    start = F.expr(f"cast(named_struct('used', {reserve}, 'open', true, 'files', array(), 'taken', array()) as {kind})")

    def step(state: Column, hit: Column) -> Column:
        tokens = F.coalesce(hit["tokens"].cast("int"), F.lit(0))
        still = state["open"] & (hit["score"] >= LEAST_SCORE) & (state["used"] < budget)
        if max_fragments:
            still = still & (F.size(state["taken"]) < max_fragments)
        fits = still & (tokens > 0) & (state["used"] + tokens <= budget)
        if max_files:
            fits = fits & (F.array_contains(state["files"], hit["rel_path"]) | (F.size(state["files"]) < max_files))
        used = state["used"] + F.when(fits, tokens).otherwise(0)
        one = F.array(F.struct(hit["rank"].cast("int").alias("rank"), hit["rel_path"].alias("rel_path"), tokens.alias("tokens"), used.alias("used")))
        files = F.when(fits, F.array_union(state["files"], F.array(hit["rel_path"]))).otherwise(state["files"])
        taken = F.when(fits, F.concat(state["taken"], one)).otherwise(state["taken"])
        return F.struct(used.alias("used"), still.alias("open"), files.alias("files"), taken.alias("taken")).cast(kind)

    packed = listed.select("query_id", F.aggregate("hits", start, step)["taken"].alias("taken"))
    return packed.select("query_id", F.explode("taken").alias("t")).select("query_id", "t.rank", "t.rel_path", "t.tokens", "t.used")


def pack_ladder(candidates: DataFrame, budget: int, lean: bool = False, *, raised: bool = True, block: int = 256) -> DataFrame:
    """Two passes: each file in the richest form that fits, then shorter forms raised to the full one while room is left.

    candidates(query_id, rank, rel_path, score, full, excerpt, signature, note):
    tokens of each form, null where there is none.  In order of rank a file comes
    whole if it is small, else as an excerpt if it is one of the first three, else
    as a signature, else as a note; what does not fit in any form is passed over.
    Returns query_id, rank, rel_path, form and tokens.

    Files are folded in blocks of ``block``; a question goes on with the next of those
    that have a form for which room is left, so no group holds a whole ranking and what
    can no longer fit is not gone through.
    """
    taken = _taken(candidates, budget, lean, block)
    return (_raised(taken, budget) if raised else taken).select("query_id", "rank", "rel_path", "form", "tokens")


def _taken(candidates: DataFrame, budget: int, lean: bool = False, block: int = 256) -> DataFrame:
    """The first pass: query_id, rank, rel_path, form, tokens and full."""
    rows = candidates.select("query_id", F.col("rank").cast("int").alias("rank"), "rel_path", "score", *(F.col(c).cast("int").alias(c) for c in FORMS))
    rows = kept(rows.withColumn("least", F.least(*(F.when(F.col(c) > 0, F.col(c)) for c in FORMS))))
    ends = F.coalesce(F.col("score") < LEAST_SCORE, F.lit(True))  # such a file closes the bundle
    state = rows.select("query_id").distinct().select("query_id", F.lit(RESERVE).alias("used"), F.lit(0).alias("after"))
    parts: list[DataFrame] = []
    while True:
        left = rows.join(state, "query_id").where((F.col("rank") > F.col("after")) & (ends | (F.col("least") <= budget - F.col("used"))))
        first = left.withColumn("__k", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("__k") <= block)
        listed = first.groupBy("query_id", "used").agg(F.max("rank").alias("after"), F.array_sort(F.collect_list(F.struct("rank", "rel_path", "score", *FORMS))).alias("files"))
        folded = kept(listed.select("query_id", "after", _ladder(budget, FULL_TOKENS_LEAN if lean else FULL_TOKENS).alias("s")).select("query_id", "after", "s.*"))
        if folded.isEmpty():
            break
        parts.append(folded.select("query_id", F.explode("taken").alias("t")).select("query_id", "t.*"))
        state = folded.where("open").select("query_id", "used", "after")
    if not parts:
        return rows.select("query_id", "rank", "rel_path", F.lit("").alias("form"), F.lit(0).alias("tokens"), "full").limit(0)
    return reduce(DataFrame.unionByName, parts)


def pack_ranking(rank: Callable[[int], DataFrame], forms: DataFrame | Callable[[DataFrame], tuple[DataFrame, DataFrame]], budget: int, *, first: int = 256, small: Callable[[int], DataFrame] | None = None, **options) -> DataFrame:
    """``pack_ladder`` over a ranking of which only as many files are asked for as bundles have room for.

    rank(top) gives query_id, rank, rel_path and score of the first ``top`` files of
    each question; forms(rel_path, full, signature, note) their tokens; the option
    ``excerpts`` gives query_id, rel_path and excerpt (tokens) for such files.  While some question has more files and
    room for the smallest form of any, four times as many are asked for.

    forms may also be a function that gives the forms and the excerpts of ranked files
    alone; ``small(room)`` then gives rel_path and least (tokens) of all files whose
    smallest form has ``room`` tokens or fewer, and of the files after the first only
    these are packed: no other one fits.
    """
    excerpts = options.pop("excerpts", None)
    if not isinstance(forms, DataFrame):
        return _pack_rest(rank, forms, small, budget, first, options)
    forms = kept(forms)
    least = forms.agg(F.min(F.least("full", "signature", "note"))).first()[0] or 0
    while True:
        some = kept(rank(first))
        taken = kept(_taken(some.join(forms, "rel_path").join(excerpts(some), ["query_id", "rel_path"], "left"), budget, **options))
        if _room(some.where(F.col("rank") >= first), taken, budget) < least:
            return _raised(taken, budget).select(*_PACKED)
        first *= 4


_PACKED = ("query_id", "rank", "rel_path", "form", "tokens")


def _room(questions: DataFrame, taken: DataFrame, budget: int) -> int:
    """The most tokens that a bundle of the questions has left before files are raised, as further ones come first; -1 without questions."""
    used = taken.groupBy("query_id").agg((F.sum("tokens") + RESERVE).alias("used"))
    room = questions.select("query_id").distinct().join(used, "query_id", "left").agg(F.max(budget - F.coalesce("used", F.lit(RESERVE)))).first()[0]
    return -1 if room is None else room


def _pack_rest(rank: Callable[[int], DataFrame], described: Callable[[DataFrame], tuple[DataFrame, DataFrame]], small: Callable[[int], DataFrame], budget: int, first: int, options: dict) -> DataFrame:
    def pack(some: DataFrame) -> DataFrame:
        own, shown = described(some)
        return kept(_taken(some.join(own, "rel_path").join(shown, ["query_id", "rel_path"], "left"), budget, **options))

    begun, top = kept(rank(first)), first
    taken = pack(begun)
    room = _room(begun.where(F.col("rank") == first), taken, budget)
    fitting = kept(small(room).groupBy("rel_path").agg(F.min("least").alias("least")).withColumn("__fits", F.lit(True))) if room > 0 else None
    least = fitting.agg(F.min("least")).first()[0] if fitting is not None else None
    while least is not None and room >= least:
        top *= 16
        last = F.col("rank") == top  # tells that the question has more files
        later = kept(rank(top).where(F.col("rank") > first).join(fitting, "rel_path", "left").where(last | F.col("__fits")))
        taken = pack(kept(begun.unionByName(later.where("__fits").select(begun.columns))))
        room = _room(later.where(last), taken, budget)
    return _raised(taken, budget).select(*_PACKED)


#: The forms of a file, richest first.
FORMS = ("full", "excerpt", "signature", "note")


def _ladder(budget: int, most: int) -> Column:
    """The fold over ``files`` from ``used`` tokens on: open, used, and the files taken."""
    kind = "struct<used:int,open:boolean,taken:array<struct<rank:int,rel_path:string,form:string,tokens:int,full:int>>>"
    start = F.struct(F.col("used").cast("int").alias("used"), F.lit(True).alias("open"), F.array().cast("array<struct<rank:int,rel_path:string,form:string,tokens:int,full:int>>").alias("taken")).cast(kind)

    def step(state: Column, file: Column) -> Column:
        still = state["open"] & (file["score"] >= LEAST_SCORE) & (state["used"] < budget)
        fits = lambda c: (file[c] > 0) & (state["used"] + file[c] <= budget)
        form = (
            F.when(fits("full") & (file["full"] <= most), "full")
            .when(fits("excerpt") & (file["excerpt"] <= EXCERPT_TOKENS) & (file["rank"] <= EXCERPT_TOP), "excerpt")
            .when(fits("signature"), "signature")
            .when(fits("note"), "note")
        )
        tokens = F.coalesce(*(F.when(form == c, file[c]) for c in FORMS))
        one = F.array(F.struct(file["rank"].alias("rank"), file["rel_path"].alias("rel_path"), form.alias("form"), tokens.alias("tokens"), file["full"].alias("full")))
        takes = still & form.isNotNull()
        return F.struct((state["used"] + F.when(takes, tokens).otherwise(0)).cast("int").alias("used"), still.alias("open"), F.when(takes, F.concat(state["taken"], one)).otherwise(state["taken"]).alias("taken")).cast(kind)

    return F.aggregate("files", start, step)


def _raised(taken: DataFrame, budget: int) -> DataFrame:
    """Excerpts and signatures become the whole file in order of rank, while the difference fits.

    Every file takes a token at least, so a bundle has no more than the budget.
    """
    kind = "struct<used:int,files:array<struct<rank:int,rel_path:string,form:string,tokens:int,full:int>>>"
    rows = taken.groupBy("query_id").agg((F.sum("tokens") + RESERVE).cast("int").alias("total"), F.array_sort(F.collect_list(F.struct("rank", "rel_path", "form", "tokens", "full"))).alias("files"))
    start = F.struct(F.col("total").alias("used"), F.array().cast("array<struct<rank:int,rel_path:string,form:string,tokens:int,full:int>>").alias("files")).cast(kind)

    def step(state: Column, file: Column) -> Column:
        more = file["full"] - file["tokens"]
        up = file["form"].isin("signature", "excerpt") & (file["full"] <= FULL_TOKENS) & (more > 0) & (state["used"] + more <= budget)
        one = F.struct(file["rank"].alias("rank"), file["rel_path"].alias("rel_path"), F.when(up, "full").otherwise(file["form"]).alias("form"), F.when(up, file["full"]).otherwise(file["tokens"]).alias("tokens"), file["full"].alias("full"))
        return F.struct((state["used"] + F.when(up, more).otherwise(0)).cast("int").alias("used"), F.concat(state["files"], F.array(one)).alias("files")).cast(kind)

    return rows.select("query_id", F.explode(F.aggregate("files", start, step)["files"]).alias("f")).select("query_id", "f.*")


def merge_intervals(blocks: DataFrame, *keys: str, gap: int = 2) -> DataFrame:
    """Blocks (start, end) of each key joined where at most ``gap`` lines lie between them."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = blocks.withColumn("__r", reach).withColumn("__new", F.when(F.col("__r").isNull() | (F.col("start") > F.col("__r") + gap + 1), 1).otherwise(0))
    grouped = marked.withColumn("__i", F.sum("__new").over(w))
    return grouped.groupBy(*keys, "__i").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("blocks")).drop("__i")


def bundle_hash(fragments: DataFrame) -> DataFrame:
    """query_id and hash over the query and its fragments by path; of several fragments of a path the last stands for each of them.

    fragments(query_id, query, pos, rel_path, content).
    """
    last = F.last("content").over(Window.partitionBy("query_id", "rel_path").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    each = fragments.withColumn("__c", last)
    parts = F.array_sort(F.collect_list(F.struct("rel_path", "pos", "__c")))
    joined = F.array_join(F.transform(parts, lambda p: F.concat(p["rel_path"], F.lit("\x00"), p["__c"])), "\x00")
    return each.groupBy("query_id", "query").agg(F.sha2(F.concat(F.col("query"), F.lit("\x00"), joined), 256).alias("bundle_hash")).select("query_id", "bundle_hash")


def render_markdown(fragments: DataFrame) -> DataFrame:
    """One markdown document a question of fragments(query_id, query, pos, rel_path, lang, content)."""
    block = F.concat(F.lit("## "), "rel_path", F.lit("\n\n```"), F.coalesce("lang", F.lit("")), F.lit("\n"), "content", F.lit("\n```\n"))
    parts = F.array_sort(F.collect_list(F.struct("pos", block.alias("block"))))
    return fragments.groupBy("query_id", "query").agg(F.array_join(F.transform(parts, lambda p: p["block"]), "\n").alias("body")).select("query_id", F.concat(F.lit("# "), "query", F.lit("\n\n"), "body").alias("document"))


def render_prompt(fragments: DataFrame) -> DataFrame:
    """One XML prompt a question of the same fragments."""
    block = F.concat(F.lit('<file path="'), "rel_path", F.lit('">\n'), "content", F.lit("\n</file>"))
    parts = F.array_sort(F.collect_list(F.struct("pos", block.alias("block"))))
    body = F.array_join(F.transform(parts, lambda p: p["block"]), "\n")
    return fragments.groupBy("query_id", "query").agg(body.alias("body")).select("query_id", F.concat(F.lit("<context>\n"), "body", F.lit("\n</context>\n<task>\n"), "query", F.lit("\n</task>")).alias("prompt"))


def top_reasons(reasons: DataFrame, n: int = 3) -> DataFrame:
    """The n signals of the largest summed weight of each fragment of reasons(fragment, signal, weight), ties by name."""
    summed = reasons.groupBy("fragment", "signal").agg(F.round(F.sum("weight"), 6).alias("weight"))
    return summed.withColumn("rank", F.row_number().over(Window.partitionBy("fragment").orderBy(F.desc("weight"), "signal"))).where(F.col("rank") <= n)


def compress_blank_lines(c: Column) -> Column:
    """Trailing blanks go, and of several blank lines one stays."""
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]+(?=\n|\z)", ""), r"\n{3,}", "\n\n")


def excerpt_lines(c: Column, head: int = 8, tail: int = 4, most: int = 40) -> Column:
    """A block of more than ``most`` lines keeps its first and last ones around a mark."""
    lines = T.logical_lines(c)
    n = F.size(lines)
    cut = F.concat(F.slice(lines, 1, head), F.array(F.concat(F.lit("… "), (n - head - tail).cast("string"), F.lit(" lines"))), F.slice(lines, F.greatest(n - tail + 1, F.lit(1)), tail))
    return F.array_join(F.when(n > most, cut).otherwise(lines), "\n")
