"""The package on the executors, and results kept in the shared folder."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = Path(__file__).parent
    bundle = Path(tempfile.mkdtemp()) / f"{here.name}.zip"
    with zipfile.ZipFile(bundle, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(bundle))
    _SHIPPED.add(app)


def kept(df: DataFrame) -> DataFrame:
    """Computes df once, in the folder of spark.checkpoint.dir; a temporary one only on a local master that configures none."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if given is None and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="lodestone-"))
    return df.checkpoint(eager=True)


def whole_texts(spark: SparkSession) -> None:
    """For queries over whole texts: hands Python fewer rows at once than Spark's 10,000.  Operators don't call it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def parts(df: DataFrame, rows: int = 500_000) -> int:
    """Into how many parts of about ``rows`` rows df goes, no fewer than the session shuffles into; for tables, whose rows are told by their footers."""
    return max(-(-df.count() // rows), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str, rows: int = 500_000) -> DataFrame:
    """df dealt by keys into parts of about ``rows`` rows, however few the session shuffles into; what a task holds then does not grow with df."""
    return df.repartition(parts(df, rows), *keys)
