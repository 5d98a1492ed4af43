"""Figures that round as the SQL rounds them."""

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.plans import catalog
from tests.oracle import differences


def _copy(spark, sf_dir, folder, name, rows, columns):
    """The smallest tables with one of them replaced."""
    for t in ("supplier", "orders", "lineitem", "pages"):
        frame = spark.createDataFrame(rows, columns) if t == name else spark.read.parquet(f"{sf_dir}/{t}.parquet")
        frame.coalesce(1).write.parquet(f"{folder}/{t}.parquet")


def test_halves_of_sizes_go_to_the_even_digit(spark):
    sizes = [(1023, "1023 B"), (1280, "1.2 KB"), (1310720, "1.2 MB"), (1703936, "1.6 MB"), (1 << 30, "1.00 GB"), ((1 << 30) * 9 // 8, "1.12 GB"), (None, None)]
    df = spark.createDataFrame([(n,) for n, _ in sizes], "n long")
    assert [r.s for r in df.select(T.human_bytes("n").alias("s")).collect()] == [s for _, s in sizes]
    assert df.where(F.col("n") == 1 << 30).select(T.human_bytes("n", "MB")).first()[0] == "1024.0 MB"


def test_human_sizes_of_many_suppliers(spark, sf_dir, tmp_path):
    _copy(spark, sf_dir, tmp_path, "supplier", [(k,) for k in [*range(1, 1200), 262144, 300000]] + [(None,)], "s_suppkey long")
    con = _con(tmp_path, "supplier")
    assert differences(catalog.queries()["human_sizes"](spark, str(tmp_path)), con, catalog.oracle_sql()["human_sizes"]) == ""


def _con(folder, *names):
    import duckdb

    con = duckdb.connect()
    for n in names:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{folder}/{n}.parquet/*.parquet')")
    return con


def test_shares_round_as_doubles_and_overshoot_by_what_is_shown(spark, sf_dir, tmp_path):
    prices = [round((k * 40 + 20) / 100, 2) for k in range(2500, 6500)]  # each share ends in a half of the sixth decimal
    rows = [(str(k), p) for k, p in enumerate(prices)] + [("over", 400000.1), ("just", 400000.3), ("none", None)]
    _copy(spark, sf_dir, tmp_path, "orders", rows, "o_orderpriority string, o_totalprice double")
    con = _con(tmp_path, "orders")
    assert differences(catalog.queries()["gate_g2_percentiles"](spark, str(tmp_path)), con, catalog.oracle_sql()["gate_g2_percentiles"]) == ""
