"""The index: file and chunk tables, their upkeep, and relations between files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..session import kept


def file_table(corpus: DataFrame) -> DataFrame:
    """files(rel_path, lang, size, lines, checksum) of corpus(rel_path, content); what is skipped, has no language or is too large stays out."""
    t = F.coalesce("content", F.lit(""))
    files = corpus.select("rel_path", P.language(F.col("rel_path")).alias("lang"), F.octet_length(t).cast("long").alias("size"), T.line_count(t).alias("lines"), F.sha2(t, 256).alias("checksum"))
    return files.where(F.col("lang").isNotNull() & ~P.skipped(F.col("rel_path")) & (F.col("size") <= P.MOST_BYTES) & (F.col("lines") <= P.MOST_LINES))


def chunk_id(kind: Column, symbol: Column) -> Column:
    s = F.regexp_replace(F.trim(F.lower(F.concat(kind, F.lit(":"), symbol))), "[^a-zA-Z0-9._-]+", "-")
    s = F.trim(s, F.lit("-"))
    return F.when(s == "", "chunk").otherwise(s)


def unique_ids(chunks: DataFrame) -> DataFrame:
    """Repeats of a chunk_id in a file, by pos, get -2, -3 and so on."""
    k = F.row_number().over(Window.partitionBy("rel_path", "chunk_id").orderBy("pos"))
    return chunks.withColumn("__k", k).withColumn("chunk_id", F.when(F.col("__k") > 1, F.concat_ws("-", "chunk_id", F.col("__k").cast("string"))).otherwise(F.col("chunk_id"))).drop("__k")


def line_chunks(corpus: DataFrame) -> DataFrame:
    """A chunk for each non-blank line of corpus(rel_path, content): pos, start_line, end_line, kind, symbol (its first word), content and its hash, token_estimate."""
    lines = corpus.select("rel_path", F.posexplode(F.split("content", "\n")).alias("pos", "content")).where(F.trim("content") != "")
    return lines.select(
        "rel_path", "pos", (F.col("pos") + 1).alias("start_line"), (F.col("pos") + 1).alias("end_line"), F.lit("line").alias("kind"), F.regexp_extract("content", T.WORD, 0).alias("symbol"),
        "content", F.sha2("content", 256).alias("content_hash"), T.token_estimate("content").alias("token_estimate"),
    )


def sections(corpus: DataFrame, heading: str = r"^(#{1,3})\s+(.+)") -> DataFrame:
    """Sections of markdown: a heading to the line before the next; lines before the first are the preamble."""
    lines = corpus.select("rel_path", F.posexplode(T.logical_lines("content")).alias("pos", "line")).withColumn("n", F.col("pos") + 1)
    last = F.max("n").over(Window.partitionBy("rel_path"))
    heads = lines.withColumn("last", last).where(F.col("line").rlike(heading) | (F.col("n") == 1))
    title = F.when(F.col("line").rlike(heading), F.trim(F.regexp_extract("line", heading, 2))).otherwise("preamble")
    end = F.coalesce(F.lead("n").over(Window.partitionBy("rel_path").orderBy("n")) - 1, F.col("last"))
    return heads.select("rel_path", title.alias("symbol"), F.col("n").alias("start_line"), end.alias("end_line"))


def with_parents(chunks: DataFrame) -> DataFrame:
    """parent_id: the first chunk of the file named as the part before the first dot; null without a dot or such a chunk."""
    named = chunks.groupBy("rel_path", "symbol").agg(F.min_by("chunk_id", "pos").alias("parent_id")).withColumnRenamed("symbol", "__parent")
    of = F.when(F.contains("symbol", F.lit(".")), F.substring_index("symbol", ".", 1))
    return chunks.withColumn("__parent", of).join(named, ["rel_path", "__parent"], "left").drop("__parent")


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of new, and those of old whose keys it does not hold."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def unreferenced(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Embeddings whose content_hash no chunk holds."""
    return embeddings.join(chunks.select("content_hash"), "content_hash", "left_anti")


def live(table: DataFrame, existing: DataFrame, *columns: str) -> DataFrame:
    """Rows whose every path column is among existing(rel_path)."""
    for c in columns:
        table = table.join(existing.select(F.col("rel_path").alias(c)).distinct(), c, "left_semi")
    return table


def stale(files: DataFrame, current: DataFrame) -> DataFrame:
    """Files whose checksum is no longer that of current(rel_path, checksum), or that are gone."""
    now = current.select("rel_path", F.col("checksum").alias("__now"))
    return files.join(now, "rel_path", "left").where(F.col("__now").isNull() | (F.col("__now") != F.col("checksum"))).drop("__now")


def changed(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Listed files (rel_path, size, modified) to read again: new, of another size, or modified after indexed_at, by the second."""
    known = files.select("rel_path", F.col("size").alias("__size"), "indexed_at")
    same = (F.col("size") == F.col("__size")) & (F.unix_timestamp("modified") <= F.unix_timestamp("indexed_at"))
    return listing.join(known, "rel_path", "left").where(~F.coalesce(same, F.lit(False))).drop("__size", "indexed_at")


def search_chunks(chunks: DataFrame, *, rel_path: str | None = None, symbol: str | None = None, content_hash: str | None = None, limit: int | None = None) -> DataFrame:
    """Chunks by exact path or hash and by part of the symbol (% and _ are wildcards), in order."""
    if rel_path is not None:
        chunks = chunks.where(F.col("rel_path") == rel_path)
    if symbol is not None:
        chunks = chunks.where(F.lower("symbol").like(f"%{symbol.lower()}%"))
    if content_hash is not None:
        chunks = chunks.where(F.col("content_hash") == content_hash)
    ordered = chunks.orderBy("rel_path", "start_line", "chunk_id")
    return ordered.limit(limit) if limit is not None else ordered


def relative_relations(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Edges of relative imports(rel_path, import): the path itself, then with an extension, then an index file; the first that exists."""
    tails = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".py", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
    wanted = imports.where(F.col("import").startswith(".")).select("rel_path", "import", F.posexplode(F.array(*[F.concat(normal_path(F.concat_ws("/", F.array_join(P.directories(F.col("rel_path")), "/"), "import")), F.lit(t)) for t in tails])).alias("priority", "target"))
    found = wanted.join(files.select(F.col("rel_path").alias("target")), "target")
    return found.groupBy("rel_path", "import").agg(F.min_by("target", "priority").alias("target")).where("target <> rel_path").select("rel_path", "target").distinct()


def normal_path(path: Column) -> Column:
    """The path without . and .. steps."""
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    empty = F.array().cast("array<string>")
    walk = F.aggregate(steps, empty, lambda done, s: F.when((s == "..") & (F.size(done) > 0), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))))
    return F.array_join(walk, "/")


def suffix_relations(imports: DataFrame, directories: DataFrame, piece: int = 4096) -> DataFrame:
    """Pairs of imports(source, import) and directories(target, dir) where one path is a whole-step suffix of the other.

    Suffixes of either side are joined by equality, and over distinct paths alone.
    Sources with the same imports are a class, as are targets with the same
    directories, so that no pair comes twice and pairs need not be dealt out to be
    made distinct: they are spelled out last, where they stay, from targets in pieces
    of about ``piece`` that are dealt evenly.
    """
    suffixes = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda k: F.call_function("substring_index", c, F.lit("/"), -k))
    classed = lambda df, of, path, to: df.where(F.col(path).isNotNull()).groupBy(of).agg(F.array_sort(F.collect_set(path)).alias(to))
    sources, targets = kept(classed(imports, "source", "import", "imports")), kept(classed(directories, "target", "dir", "dirs"))
    up, down = (df.select(c).distinct().withColumn(p, F.explode(c)) for df, c, p in ((sources, "imports", "import"), (targets, "dirs", "dir")))
    left, right = up.select("import").distinct(), down.select("dir").distinct()
    one = left.withColumn("key", F.explode(suffixes(F.col("import")))).join(right.withColumn("key", F.col("dir")), "key")
    other = right.withColumn("key", F.explode(suffixes(F.col("dir")))).join(left.withColumn("key", F.col("import")), "key")
    met = one.select("import", "dir").unionByName(other.select("import", "dir")).distinct()
    classes = met.join(up, "import").join(down, "dir").select("imports", "dirs").distinct()
    sizes = targets.groupBy("dirs").agg(F.ceil(F.count("*") / piece).alias("pieces"))
    dealt = targets.join(sizes, "dirs").groupBy("dirs", F.expr("pmod(xxhash64(target), pieces)").alias("piece")).agg(F.collect_list("target").alias("targets"))
    wide = sources.join(classes, "imports").select("source", "dirs").join(dealt, "dirs")
    return wide.select("source", F.explode("targets").alias("target")).where("source <> target")


def logic_map(relations: DataFrame) -> DataFrame:
    """For each path its dependencies and dependents, sorted and joined by commas, of relations(source, target)."""
    both = relations.select(F.col("source").alias("path"), F.col("target").alias("dependency"), F.lit(None).cast("string").alias("dependent")).unionByName(
        relations.select(F.col("target").alias("path"), F.lit(None).cast("string").alias("dependency"), F.col("source").alias("dependent"))
    )
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return both.groupBy("path").agg(listed("dependency").alias("dependencies"), listed("dependent").alias("dependents"))


def containing(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """part and text of distinct texts(text) and parts(part) where the part, not empty, lies within the text.

    Either side lists grams: a part its rarest one of three letters (itself if it is
    shorter), a text all of its own; so they meet by equality.
    """
    grams = lambda c, n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda k: F.substring(c, k, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    text, part = F.col("text"), F.col("part")
    held = texts.select("text").distinct().select("text", F.explode(F.array_distinct(F.concat(*(grams(text, n) for n in (1, 2, 3))))).alias("gram"))
    seen = held.groupBy("gram").agg(F.count("*").alias("n"))
    asked = parts.select("part").where("part <> ''").distinct().select("part", F.explode(F.array_distinct(F.when(F.length(part) < 3, F.array(part)).otherwise(grams(part, 3)))).alias("gram"))
    rarest = asked.join(seen, "gram").groupBy("part").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return held.join(rarest, "gram").where(F.contains("text", "part")).select("part", "text")


def related_tests(files: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Pairs (rel_path, test) of files(rel_path) and the tests near them, each once.

    Three ways: the production stems are equal or one lies within the other; the test
    depends on the file (relations(source, target)); the file is a test itself, and
    depends on what then counts as its test.  An empty stem is near no other.
    """
    stem = files.select("rel_path", P.production_stem(F.col("rel_path")).alias("stem"), P.is_test_path(F.col("rel_path")).alias("is_test"))
    own, tests = stem.select("rel_path", "stem"), stem.where("is_test").select(F.col("rel_path").alias("test"), F.col("stem").alias("test_stem"))
    of = lambda df, c, name: df.select(F.col(c).alias(name))
    within = containing(of(tests, "test_stem", "text"), of(own, "stem", "part")).select(F.col("part").alias("stem"), F.col("text").alias("test_stem"))
    around = containing(of(own, "stem", "text"), of(tests, "test_stem", "part")).select(F.col("text").alias("stem"), F.col("part").alias("test_stem"))
    found = own.join(within.unionByName(around).distinct(), "stem").join(tests, "test_stem").select("rel_path", "test")
    if relations is not None:
        edges = relations.select("source", "target")
        known = files.select("rel_path")
        into = edges.join(tests.select(F.col("test").alias("source")), "source").select(F.col("target").alias("rel_path"), F.col("source").alias("test"))
        out = edges.join(tests.select(F.col("test").alias("source")), "source").join(known.select(F.col("rel_path").alias("target")), "target").select(F.col("source").alias("rel_path"), F.col("target").alias("test"))
        found = found.unionByName(into.join(known, "rel_path").select("rel_path", "test")).unionByName(out)
    return found.distinct()
