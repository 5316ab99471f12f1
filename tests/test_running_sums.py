"""Compensated running sums of doubles do not drift with the rows before."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from oracle_check import compare
from varienne.operators.ordered import ordered
from varienne.session import scratch_path


@pytest.mark.parametrize("target", [100, 10**6])
@pytest.mark.parametrize("kind", ["double", "float"])
def test_running_sums_keep_what_additions_round_off(spark, target, kind):
    values = [2.0**53, *[1.0] * 1500, -(2.0**52), *[0.25] * 500]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], f"k string, t int, v {kind}").repartition(3)
    got = [r.s for r in ordered(df, ["k"], "t", running_sums={"s": "v"}, compensated=True, target_rows=target).orderBy("t").collect()]
    want = [math.fsum(values[: i + 1]) for i in range(len(values))]
    assert max(abs(g - w) for g, w in zip(got, want, strict=True)) <= 8  # four units in the last place of the largest sum; uncompensated 1500


@pytest.mark.parametrize("target", [1, 10**6])
def test_running_sums_of_nulls_and_infinities(spark, target):
    inf, nan = float("inf"), float("nan")
    values = {"null": [None, 0.5, None, 0.25], "inf": [1.0, inf, 2.0, None], "both": [inf, 1.0, -inf, 2.0], "nan": [1.0, nan, None, 1.0], "long": [0.1, 0.2, 0.3]}
    df = spark.createDataFrame([(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)], "k string, t int, v double")
    got: dict = {}
    for r in ordered(df, ["k"], "t", running_sums={"s": "v"}, compensated=True, target_rows=target).orderBy("t").collect():
        got.setdefault(r.k, []).append(r.s)
    want = {"null": [None, 0.5, 0.5, 0.75], "inf": [1.0, inf, inf, inf], "both": [inf, inf, nan, nan], "nan": [1.0, nan, nan, nan], "long": [0.1, 0.3, 0.6]}
    assert {k: [None if s is None else pytest.approx(s, nan_ok=True) for s in v] for k, v in want.items()} == got


def test_theta_per_cell_after_many_small_steps(spark):
    """A cell that shrinks, regrows in 20,000 steps that each round the same way, and then hardly grows: θ shows what was rounded off."""
    ulp = 2.0**-43  # of sums from 512 to 1024
    step = (round(0.02 / ulp) + 0.4) * ulp
    steps = [1000.0, -480.0, *[step] * 20000, 80.0005, 0.0002, 0.0003]
    rows = [(n, v) for n, v in enumerate(steps)]
    path = scratch_path(spark, "small-steps")
    spark.createDataFrame(rows, "event_id bigint, value double").selectExpr(
        "event_id", "timestampadd(SECOND, event_id, TIMESTAMP_NTZ '2024-01-01 00:00:00') AS ts", "1L AS user_id", "'click' AS event_type", "value", "'{}' AS props",
    ).write.parquet(f"{path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/events.parquet/*.parquet')")
    assert compare(entry.queries()["theta_per_cell"](spark, path), con, entry.oracle_sql()["theta_per_cell"]) == ""


def test_running_sums_within_the_slack_are_plain(spark):
    """Values of a short life keep their plain sums bit by bit; 1,500 lost units are beyond the slack and made good."""
    short, long = [round(0.37 * (i * i % 101), 2) for i in range(60)], [2.0**53, *[1.0] * 1500]
    df = spark.createDataFrame([(k, i, v) for k, vs in (("short", short), ("long", long)) for i, v in enumerate(vs)], "k string, t int, v double")
    sums = lambda **o: {(r.k, r.t): r.s for r in ordered(df, ["k"], "t", running_sums={"s": "v"}, **o).collect()}
    plain, slack = sums(), sums(compensated=True, slack=4)
    assert all(slack["short", t] == plain["short", t] for t in range(len(short)))
    assert max(abs(slack["long", t] - math.fsum(long[: t + 1])) for t in range(len(long))) <= 4 * 2 and plain["long", 1500] == 2.0**53


def test_masses_of_a_long_life(spark):
    """20,000 steps that each round the same way: the plain sum drifts by 8,000 units in its last place, which shows beside a small birth."""
    ulp = 2.0**-43  # of sums from 512 to 1024
    step = (round(math.sqrt(0.00045) / ulp) + 0.4) * ulp
    steps = [0.5, 999.5, -480.0, *[step] * 20000]
    rows = [(n, v) for n, v in enumerate(steps)]
    path = scratch_path(spark, "long-life")
    spark.createDataFrame(rows, "event_id bigint, value double").selectExpr(
        "event_id", "timestampadd(SECOND, event_id, TIMESTAMP_NTZ '2024-01-01 00:00:00') AS ts", "1L AS user_id", "'click' AS event_type", "value", "'{}' AS props",
    ).write.parquet(f"{path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/events.parquet/*.parquet')")
    assert compare(entry.queries()["join_cell_stats"](spark, path), con, entry.oracle_sql()["join_cell_stats"]) == ""
