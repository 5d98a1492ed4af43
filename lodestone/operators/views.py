"""Short lists, summaries and documents for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def files_only(ranked: DataFrame, limit: int, least: float = 0.0) -> DataFrame:
    """rank, rel_path and score of each question's first files that score, and no less than ``least``.  ranked(query_id, rank, rel_path, score)."""
    if limit < 0 or least < 0:
        raise ValueError("limit and least are 0 or more")
    out = ranked.where((F.col("score") > 0) & (F.col("score") >= least))
    return (out.where(F.col("rank") <= limit) if limit else out).select("query_id", "rank", "rel_path", "score")


def last_n(rows: DataFrame, key: str, order: list[str], n: int = 5) -> DataFrame:
    """The last n rows of each key, with pos from the first of them."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    kept = rows.withColumn("__k", back).where(F.col("__k") <= n).drop("__k")
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def recent_concerning(events: DataFrame, n: int = 10) -> DataFrame:
    """The n last events(seq, grounded) that are not grounded, last first."""
    return events.where(~F.coalesce("grounded", F.lit(False))).orderBy(F.desc("seq")).limit(n)


def recent(logs: DataFrame, n: int) -> DataFrame:
    """The n last rows of logs(ts, id, ...), ties by the larger id."""
    return logs.orderBy(F.desc("ts"), F.desc("id")).limit(n)


def compact_list(values: Column, n: int) -> Column:
    """The first n values, and how many more there are."""
    rest = F.size(values) - n
    listed = F.array_join(F.slice(values, 1, n), ", ")
    return F.when(rest > 0, F.concat(listed, F.lit(", +"), rest.cast("string"), F.lit(" more"))).otherwise(listed)


def first_seen(lists: DataFrame) -> DataFrame:
    """query_id, path and score of the paths in lists(query_id, source, pos, path), each where it is seen first; score is 1 / (place + 1) from 0."""
    first = lists.where("path <> ''").groupBy("query_id", "path").agg(F.min(F.struct("source", "pos")).alias("at"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "path"))
    return first.select("query_id", "path", (1.0 / place).alias("score"))


def prompt_paths(prompts: DataFrame) -> DataFrame:
    """query_id, pos and path of the file tags in prompts(query_id, prompt)."""
    return prompts.select("query_id", F.posexplode(F.regexp_extract_all("prompt", F.lit('<file path="([^"]*)"'), F.lit(1))).alias("pos", "path"))


def index_stats(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """lang, files, symbols and imports of each language of files(rel_path, lang)."""
    count = lambda df, name: df.groupBy("rel_path").agg(F.count("*").alias(name))
    joined = files.join(count(symbols, "s"), "rel_path", "left").join(count(imports, "i"), "rel_path", "left")
    return joined.groupBy("lang").agg(F.count("*").alias("files"), F.coalesce(F.sum("s"), F.lit(0)).alias("symbols"), F.coalesce(F.sum("i"), F.lit(0)).alias("imports"))


def top_by_symbols(symbols: DataFrame, n: int = 10) -> DataFrame:
    """The n files with the most symbols(rel_path, name)."""
    return symbols.groupBy("rel_path").agg(F.count("*").alias("symbols")).orderBy(F.desc("symbols"), "rel_path").limit(n)


def bundle_texts(fragments: DataFrame) -> DataFrame:
    """answer_id and text, the joined contents of fragments(answer_id, pos, rel_path, content) but Go tests: what facts of a bundle are looked for in."""
    code = fragments.where(~F.endswith("rel_path", F.lit("_test.go")))
    listed = code.groupBy("answer_id").agg(F.sort_array(F.collect_list(F.struct("pos", "content"))).alias("l"))
    return listed.select("answer_id", F.array_join(F.col("l.content"), "\n").alias("text"))


def route_counts(answers: DataFrame) -> DataFrame:
    """route and n of answers(route)."""
    return answers.groupBy("route").agg(F.count("*").alias("n"))


def bench_summary(results: DataFrame, *by: str) -> DataFrame:
    """Of results(rank, tokens, ms, again): questions, shares with the expected file first and among three, mean tokens and latency, and the share that came out the same again.

    rank is null where the expected file was not found, again where no second run was made.
    """
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    return results.groupBy(*by).agg(
        F.count("*").alias("questions"), share(F.col("rank") == 1).alias("top1"), share(F.col("rank") <= 3).alias("top3"),
        F.round(F.avg("tokens"), 6).alias("tokens"), F.round(F.avg("ms"), 6).alias("ms"), F.round(F.avg(F.col("again").cast("double")), 6).alias("stable"),
    )


def learn_status(feedback: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Counts of feedback(helpful) and fixtures(origin) in one row."""
    f = feedback.agg(F.count("*").alias("feedback"), F.count_if(F.col("helpful")).alias("helpful"))
    x = fixtures.agg(F.count("*").alias("fixtures"), F.count_if(F.col("origin") == "learned").alias("learned"))
    return f.join(x)


def drift_samples(**sources: DataFrame) -> DataFrame:
    """origin, name and drift of all sources(name, drift)."""
    parts = [df.select(F.lit(k).alias("origin"), "name", F.col("drift").cast("double").alias("drift")) for k, df in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stem_pairs(responses: DataFrame, bundles: DataFrame) -> DataFrame:
    """Responses(path, text) with the bundle of the same file stem: stem, text and bundle; what has no partner is left out."""
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    return responses.select(stem.alias("stem"), "text").join(bundles.select(stem.alias("stem"), F.col("text").alias("bundle")), "stem")


def resume_seed(fragments: DataFrame, live: DataFrame) -> DataFrame:
    """record, tokens of all its fragments, and paths, the distinct ones in order that still exist and are no artefacts.

    fragments(record, pos, rel_path, tokens), live(rel_path).
    """
    tokens = fragments.groupBy("record").agg(F.sum("tokens").alias("tokens"))
    kept = fragments.where(~F.col("rel_path").rlike(r"(^|/)(audit|bundles|records)/")).join(live.select("rel_path").distinct(), "rel_path", "left_semi")
    first = kept.groupBy("record", "rel_path").agg(F.min("pos").alias("pos"))
    listed = first.groupBy("record").agg(F.sort_array(F.collect_list(F.struct("pos", "rel_path"))).alias("l"))
    return tokens.join(listed, "record", "left").select("record", "tokens", F.coalesce(F.array_join(F.col("l.rel_path"), ","), F.lit("")).alias("paths"))


def grounding_events(events: DataFrame, bundle: DataFrame) -> DataFrame:
    """seq, kind, rel_path and in_context of tool events(seq, tool, path): edits and reads, and whether the bundle(rel_path) holds the file; other tools are left out."""
    kind = F.when(F.lower("tool").isin("edit", "write", "multiedit"), "edit").when(F.lower("tool") == "read", "read")
    known = bundle.select("rel_path").distinct().withColumn("in_context", F.lit(True))
    path = F.regexp_replace("path", r"^\./", "")
    return events.select("seq", kind.alias("kind"), path.alias("rel_path")).where("kind is not null").join(known, "rel_path", "left").select("seq", "kind", "rel_path", F.coalesce("in_context", F.lit(False)).alias("in_context"))


def chunk_excerpts(chunks: DataFrame, n: int = 5) -> DataFrame:
    """key and excerpt of chunks(key, start_line, end_line, content): the first n, each under a header with its lines; nothing stands between a body and the next header."""
    first = F.row_number().over(Window.partitionBy("key").orderBy("start_line", "end_line"))
    part = F.concat(F.lit("// lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("\n"), F.col("content"))
    some = chunks.withColumn("__k", first).where(F.col("__k") <= n).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("__k", part.alias("part")))).alias("l"))
    return some.select("key", F.array_join(F.col("l.part"), "").alias("excerpt"))


def _lines(entries: DataFrame, key: str, line: Column) -> DataFrame:
    some = entries.withColumn("__line", line).where("__line <> ''")
    return some.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ts", "seq", "__line"))).alias("l")).select(key, F.array_join(F.col("l.__line"), "\n").alias("text"))


def timeline(entries: DataFrame, key: str = "session_id") -> DataFrame:
    """A line for each entry(ts, seq, query, command, outcome, notes) of a session that says something: its time and what it holds."""
    some = lambda c, before, after: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(before), F.col(c), F.lit(after)))
    told = F.concat_ws(" | ", some("query", 'Query: "', '"'), some("command", "Command: `", "`"), some("outcome", "Outcome: *", "*"), some("notes", "(", ")"))
    return _lines(entries, key, F.when(told != "", F.concat(F.lit("- **"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("**: "), told)).otherwise(""))


def hand_off(entries: DataFrame, key: str = "session_id") -> DataFrame:
    """The state to hand on: last query, outcome and notes that are not empty, and the commands in order with their outcomes."""
    last = lambda c: F.max_by(c, F.when(F.coalesce(c, F.lit("")) != "", F.struct("ts", "seq"))).alias(f"last_{c}")
    run = F.when(F.coalesce("command", F.lit("")) != "", F.concat(F.lit("`"), F.col("command"), F.lit("`"), F.when(F.coalesce("outcome", F.lit("")) != "", F.concat(F.lit(" -> *"), F.col("outcome"), F.lit("*"))).otherwise(""))).otherwise("")
    state = entries.groupBy(key).agg(last("query"), last("outcome"), last("notes"))
    return state.join(_lines(entries, key, run).withColumnRenamed("text", "commands"), key, "left")


#: Exporters by format; others may be added.
EXPORTERS = {"timeline": timeline, "hand_off": hand_off}


def export(entries: DataFrame, form: str) -> DataFrame:
    if form not in EXPORTERS:
        raise ValueError(f"no exporter for {form}")
    return EXPORTERS[form](entries)


def report(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """A markdown table in one row for each key, its rows by the first column."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    listed = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(columns[0]).alias("o"), cells.alias("c")))).alias("l"))
    return listed.select(key, F.concat(F.lit(head + "\n"), F.array_join(F.col("l.c"), "\n")).alias("report"))
