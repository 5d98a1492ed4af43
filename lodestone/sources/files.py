"""Readers and writers: source trees, JSON lines, folders of JSON documents, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions import paths as P


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """corpus(rel_path, size, modified, content) of the readable files under a folder; what is skipped, unknown or too large is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1]
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^.*?{base.lstrip('/')}/", "")
    kept = found.select(rel.alias("rel_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    return kept.where(~P.skipped(F.col("rel_path")) & P.language(F.col("rel_path")).isNotNull() & (F.col("size") <= P.MOST_BYTES)).withColumn("content", F.decode("content", "UTF-8"))


def _json(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    try:
        reader = spark.read.schema(schema)
        for k, v in options.items():
            reader = reader.option(k, v)
        return reader.json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], T.StructType.fromDDL(schema))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank and malformed lines are dropped, a missing path has no row."""
    return _json(spark, path, schema, mode="DROPMALFORMED")


def read_jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; a malformed line is an error."""
    return _json(spark, path, schema, mode="FAILFAST")


def read_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One row for each JSON document of a folder, with its name."""
    return _json(spark, folder, schema, multiLine="true", mode="PERMISSIVE").withColumn("name", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Appends rows; a null ts is now."""
    if "ts" in rows.columns:
        rows = rows.withColumn("ts", F.coalesce("ts", F.current_timestamp()))
    rows.write.mode("append").json(path)


def manifest(texts: DataFrame) -> DataFrame:
    """name, main, module, types, bins and dependencies of package manifests(rel_path, content); bin is one path or several."""
    schema = "name string, main string, module string, types string, bin string, dependencies map<string,string>, devDependencies map<string,string>"
    p = texts.select("rel_path", F.from_json("content", schema, {"allowComments": "true"}).alias("p"), F.get_json_object("content", "$.bin").alias("bin"))
    several = F.map_values(F.from_json("bin", "map<string,string>"))
    bins = F.when(F.col("bin").startswith("{"), several).otherwise(F.array("bin"))
    entry = F.filter(F.concat(F.array("p.main", "p.module", "p.types"), F.coalesce(bins, F.array().cast("array<string>"))), lambda x: x.isNotNull())
    clean = F.transform(entry, lambda x: F.regexp_replace(x, r"^\./", ""))
    return p.select("rel_path", "p.name", clean.alias("entry_points"), F.coalesce(F.map_keys("p.dependencies"), F.array().cast("array<string>")).alias("dependencies"))


def aliases(texts: DataFrame) -> DataFrame:
    """Path aliases of tsconfig files(rel_path, content): alias and the first target, without stars."""
    paths = F.from_json(F.get_json_object(F.regexp_replace("content", r"(?m)^\s*//.*$", ""), "$.compilerOptions.paths"), "map<string,array<string>>")
    bare = lambda c: F.regexp_replace(c, r"/?\*$", "")
    return texts.select("rel_path", F.explode(paths).alias("alias", "targets")).select("rel_path", bare(F.col("alias")).alias("alias"), bare(F.regexp_replace(F.element_at("targets", 1), r"^\./", "")).alias("target"))


def porcelain(lines: DataFrame) -> DataFrame:
    """Changed paths of ``git status --porcelain`` lines(line): of a rename the new path, without quotes, once."""
    path = F.trim(F.substring_index(F.substring("line", 4, 1 << 20), " -> ", -1))
    return lines.where(F.length("line") > 3).select(F.regexp_replace(path, '^"|"$', "").alias("rel_path")).distinct()


def last_answer(lines: DataFrame) -> DataFrame:
    """The last assistant message of each transcript(transcript, line_no, line): its text blocks, a line each."""
    schema = "message struct<role:string,content:array<struct<type:string,text:string>>>"
    m = lines.select("transcript", "line_no", F.from_json("line", schema)["message"].alias("m")).where("m.role = 'assistant'")
    text = F.array_join(F.transform(F.filter("m.content", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    return m.withColumn("text", text).where("text <> ''").groupBy("transcript").agg(F.max_by("text", "line_no").alias("text"))
