"""Cells that are born with no mass: the SQL divides by it and takes its logarithm as IEEE 754 has it."""

import duckdb
import pytest

import __spark_entry__ as entry
from oracle_check import compare
from varienne.operators import growth
from varienne.session import scratch_path

#: (user, value): born with nothing and growing, with nothing twice, with nothing only, one row of nothing, growing, one row.
VALUES = [(1, (0.0, 2.0, 3.0)), (2, (0.0, 0.0, 5.0)), (3, (0.0, 0.0)), (4, (0.0,)), (5, (1.0, 2.0, 4.0)), (6, (7.0,))]


@pytest.fixture(scope="module")
def zero_births(spark):
    rows = [(u, v, i) for u, values in VALUES for i, v in enumerate(values)]
    events = ", ".join(f"({n}, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL {i} HOUR, {u}, 'click', CAST({v} AS DOUBLE), '{{}}')" for n, (u, v, i) in enumerate(rows))
    path = scratch_path(spark, "zero-births")
    spark.sql(f"SELECT CAST(c0 AS BIGINT) event_id, CAST(c1 AS TIMESTAMP_NTZ) ts, CAST(c2 AS BIGINT) user_id, c3 event_type, c4 value, c5 props FROM VALUES {events} AS t(c0, c1, c2, c3, c4, c5)").write.parquet(f"{path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/events.parquet/*.parquet')")
    return path, con


def check(spark, zero_births, name):
    path, con = zero_births
    return compare(entry.queries()[name](spark, path), con, entry.oracle_sql()[name])


def test_mass_relative_to_a_birth_without_mass(spark, zero_births):
    assert check(spark, zero_births, "join_cell_stats") == ""


def test_stage_profile_of_births_without_mass(spark, zero_births):
    assert check(spark, zero_births, "stage_profile") == ""


def test_theta_per_cell_of_births_without_mass(spark, zero_births):
    assert check(spark, zero_births, "theta_per_cell") == ""


def test_theta_per_cell_keeps_its_floor_by_default(spark):
    df = spark.createDataFrame([("a", float(t), m) for t, m in enumerate((0.0, 1e-5, 1.0))], "k string, time double, m double")
    theta = lambda **o: [r.theta for r in growth.theta("per_cell", df, mass="m", keys=["k"], **o).orderBy("time").collect()]
    assert theta() == pytest.approx([0.0, 0.5, 1.0]) and theta(floor=None) == [1.0, 1.0, 1.0]
