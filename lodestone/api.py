"""The engine's tools over one repository of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import audit, bundles, chunk_search, excerpts, index, parsing, search, signals
from .session import kept
from .sources import files


class Engine:
    """Tables of a corpus(rel_path, content) and the tools that read them; every method returns a DataFrame."""

    def __init__(self, corpus: DataFrame, weights: search.SearchWeights | None = None):
        self.spark = corpus.sparkSession
        self.weights = weights or search.SearchWeights()
        self.corpus = corpus.select("rel_path", "content")
        self.files = index.file_table(self.corpus)
        self.sources = self.corpus.join(self.files.select("rel_path", "lang"), "rel_path")
        self.chunks = kept(parsing.code_chunks(self.sources))
        self.parsed = kept(parsing.parse(self.sources).select("rel_path", "symbols", "imports", "signature"))

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Engine:
        return cls(files.read_tree(spark, root))

    def questions(self, *texts: str) -> DataFrame:
        return self.spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "query_id long, text string")

    def search(self, questions: DataFrame, limit: int = 8, changed: DataFrame | None = None) -> DataFrame:
        symbols = self.parsed.select("rel_path", F.inline("symbols")).select("rel_path", "name")
        imports = self.parsed.select("rel_path", F.explode("imports").alias("imp"))
        relations = self.relations().select(F.col("rel_path").alias("source"), "target")
        return chunk_search.chunk_search(self.chunks, questions, self.weights, limit, changed=changed, relations=relations, symbols=symbols, imports=imports, files=self.sources)

    def excerpt(self, questions: DataFrame, rel_path: str) -> DataFrame:
        """What a file shows to each question: query_id, rel_path, excerpt and its tokens."""
        wanted = questions.select("query_id", F.lit(rel_path).alias("rel_path"), T.tokenise("text").alias("terms"))
        return excerpts.symbol_excerpts(wanted, self.sources).drop("terms")

    def context(self, questions: DataFrame, limit: int = 8) -> DataFrame:
        """The smallest answer to each question: query_id, route, rel_path and text.

        An open search whose best file tells most by its symbols is answered by an
        excerpt of the first hit's file, or by the hits if that has none; a question for
        an outline is only told its route (see ``stats`` and ``outline``); the rest get the hits.
        """
        symbols = self.parsed.select("rel_path", F.inline("symbols")).select("rel_path", "name")
        imports = self.parsed.select("rel_path", F.explode("imports").alias("imp"))
        hints = signals.structural_hints(symbols, imports, search.question_terms(questions).select("query_id", "term"), limit)
        routes = kept(signals.routes(hints, questions.select("query_id", T.intent("text").alias("intent"))))
        hits = kept(self.search(questions.join(routes.where("route <> 'outline'"), "query_id", "left_semi"), max(limit, 5)))
        first = hits.where("rank = 1").join(routes.where("route = 'excerpt'"), "query_id").join(questions, "query_id")
        shown = excerpts.symbol_excerpts(first.select("query_id", "rel_path", T.tokenise("text").alias("terms")), self.sources).where("excerpt is not null")
        line = F.concat("rel_path", F.lit(":"), F.col("start_line").cast("string"), F.lit(" "), F.coalesce("symbol", F.lit("")))
        listed = hits.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda r: r["line"]), "\n").alias("listed"), F.min_by("rel_path", "rank").alias("best"))
        told = routes.join(shown.select("query_id", "excerpt"), "query_id", "left").join(listed, "query_id", "left")
        route = F.when((F.col("route") == "excerpt") & F.col("excerpt").isNull(), "search").otherwise(F.col("route"))
        text = F.coalesce("excerpt", "listed", F.lit(""))
        return told.select("query_id", route.alias("route"), F.col("best").alias("rel_path"), text.alias("text"))

    def rank(self, questions: DataFrame, focus: str = "", changed: DataFrame | None = None) -> DataFrame:
        return search.rank_files(self.files, questions, focus=focus, changed=changed)

    def bundle(self, questions: DataFrame, budget: int = 8000) -> DataFrame:
        """Fragments of the best chunks under a token budget: query_id, query, pos, rel_path, lang, content, used."""
        body = self.chunks.select("rel_path", "start_line", "symbol", "content", "token_estimate")
        hits = kept(self.search(questions, 24).join(body, ["rel_path", "start_line", "symbol"]))
        packed = bundles.pack_greedy(hits.withColumn("tokens", F.col("token_estimate")), budget).select("query_id", "rank", "used")
        return packed.join(hits, ["query_id", "rank"]).join(questions.withColumnRenamed("text", "query"), "query_id").join(self.files.select("rel_path", "lang"), "rel_path").select("query_id", "query", F.col("rank").alias("pos"), "rel_path", "lang", "content", "used")

    def prompt(self, questions: DataFrame, budget: int = 8000) -> DataFrame:
        return bundles.render_prompt(self.bundle(questions, budget))

    def outline(self, rel_path: str) -> DataFrame:
        return index.search_chunks(self.chunks, rel_path=rel_path).select("chunk_id", "kind", "symbol", "start_line", "end_line")

    def view(self, rel_path: str, start: int = 1, end: int = 0) -> DataFrame:
        return self.corpus.where(F.col("rel_path") == rel_path).select("rel_path", T.lines_in_range("content", F.lit(start), F.lit(end)).alias("content"))

    def expand(self, spec: str) -> DataFrame:
        s = self.spark.range(1).select(T.expand_spec(F.lit(spec)).alias("s"))
        found = self.corpus.join(F.broadcast(s), F.col("rel_path") == F.col("s.path"))  # one row
        return found.select("rel_path", T.lines_in_range("content", F.coalesce("s.start", F.lit(1)), F.coalesce("s.end", F.lit(0))).alias("content"))

    def relations(self) -> DataFrame:
        imports = self.parsed.select("rel_path", F.explode("imports").alias("import"))
        return index.relative_relations(self.files, imports)

    def audit(self, questions: DataFrame, answers: DataFrame, budget: int = 8000) -> DataFrame:
        """Grounding and drift of answers(answer_id, text), where answer_id is the question's."""
        fragments = kept(self.bundle(questions, budget).withColumnRenamed("query_id", "answer_id"))
        checked = audit.validated(audit.cited(answers), fragments.select("answer_id", "rel_path"))
        context = fragments.groupBy("answer_id").agg(F.array_join(F.collect_list("content"), "\n").alias("text"))
        return audit.grounded_ratio(answers, checked).join(audit.drift(answers, context), "answer_id")

    def stats(self) -> DataFrame:
        return self.files.groupBy("lang").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("lines").alias("lines")).orderBy(F.desc("files"), "lang")
