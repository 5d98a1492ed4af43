"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
it kept, and returns the columns of documents, except the last, which returns
the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import new_dir, table, whole_texts, written
from lodestone.llm.decontamination import contaminations
from lodestone.llm.language_id import UNKNOWN, identify, train
from lodestone.llm.near_text import similar_texts
from lodestone.llm.packing import pack_documents
from lodestone.llm.pii import find_personal_data, sanitise
from lodestone.llm.tokens import public_path
from lodestone.session import ship

_ROW = "__row"


def _ready(spark: SparkSession) -> None:
    ship(spark)
    whole_texts(spark)
    # Shuffle files go when their job has ended; what is read again lies in the shared folder.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a digest of each whole row, which is the same whenever the row is read; equal rows share it."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in docs.columns]
    return docs.withColumn(_ROW, F.unhex(F.md5(F.concat_ws("\x00", *columns))))


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, written once, so that all readers see the same numbers."""
    return written(docs.withColumn(_ROW, F.monotonically_increasing_id()), "numbered")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those whose language is doubtful, go."""
    _ready(spark)
    found = identify(docs, train(docs))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= 0.5)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, 0.8 of their five-word shingles alike, the document with the smallest doc_id stays."""
    _ready(spark)
    rows = _keyed(docs)
    groups = similar_texts(rows.select(F.struct("doc_id", _ROW).alias("row"), "text"))
    first = groups.groupBy("label").agg(F.min("row").alias("row")).select(F.col(f"row.{_ROW}").alias(_ROW))
    return rows.join(first, _ROW, "left_semi").dropDuplicates([_ROW]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    _ready(spark)
    rows = _numbered(docs)
    found = contaminations(rows.select(F.col(_ROW).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return rows.join(found.select(F.col("doc_id").alias(_ROW)), _ROW, "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and what discloses it are replaced; no document goes."""
    _ready(spark)
    clean = sanitise(find_personal_data(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids."""
    _ready(spark)
    return pack_documents(docs, tokenizer=public_path(), end_id=1)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("packing", packing),
]

#: No SQL: the stages hold a trained net, a tokenizer and an iteration over components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each is written as Parquet in the shared folder and read again."""
    out = new_dir(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{k}")
        docs = spark.read.parquet(f"{out}/{k}")
    return docs
