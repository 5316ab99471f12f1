"""Results are rounded as the SQL rounds them, next to halves too."""

import duckdb

import __spark_entry__ as entry
from oracle_check import compare
from varienne.session import scratch_path
from varienne.workloads.registry import rnd

#: Orders with a draw of an exponential flux next to half a unit of the ninth digit.
KEYS = (3178086, 6118241)


def test_rounding_next_to_halves(spark):
    values = [4.2666691545, 2.0957758435, -4.2666691545, 0.5e-9, 1.5e-9, 2.5e-9, 0.0, 123456.7890123455, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    rows = ", ".join(f"({i}, {'NULL' if v is None else repr(str(v))}::DOUBLE)" for i, v in enumerate(values))
    for digits in (2, 6, 9):
        assert compare(df.select("i", rnd("v", digits).alias("r")), duckdb.connect(), f"SELECT CAST(i AS INTEGER) AS i, round(v, {digits}) + 0.0 AS r FROM (VALUES {rows}) t(i, v)") == ""


def test_synthetic_fluxes_next_to_halves(spark):
    path = scratch_path(spark, "orders")
    spark.createDataFrame([(k,) for k in KEYS], "o_orderkey bigint").write.parquet(f"{path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{path}/orders.parquet/*.parquet')")
    assert compare(entry.queries()["synthetic_history"](spark, path), con, entry.oracle_sql()["synthetic_history"]) == ""
