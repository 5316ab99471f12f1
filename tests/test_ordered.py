import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varienne.operators import growth, replicates
from varienne.operators.ordered import add_chunks, even_spacing, growth_rate, ordered


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, with repeated times."""
    rng = np.random.default_rng(0)
    n = 400
    key = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 6, n))
    return pd.DataFrame({"k": key, "t": np.round(rng.random(n) * 50, 0), "id": np.arange(n), "v": np.round(rng.random(n) * 10 + 1, 3)})


@pytest.mark.parametrize("target", [1, 7, 50, 10**6])
def test_ordered_matches_whole_windows(spark, skewed, target):
    df = spark.createDataFrame(skewed)
    got = ordered(df, ["k"], "t", ties=["id"], lags={"prev": "v"}, running_sums={"cum": "v"}, row_number="rn", target_rows=target)
    got = got.toPandas().sort_values(["k", "t", "id"]).reset_index(drop=True)
    want = skewed.sort_values(["k", "t", "id"]).reset_index(drop=True)
    grouped = want.groupby("k")["v"]
    assert got["rn"].tolist() == (grouped.cumcount() + 1).tolist()
    assert np.allclose(got["cum"], grouped.cumsum())
    assert np.allclose(got["prev"].fillna(-1), grouped.shift().fillna(-1))


def test_prefix_order(spark, skewed):
    df = spark.createDataFrame(skewed.assign(s=lambda d: d["id"] % 2))
    got = ordered(df, ["k"], "t", prefix=["s"], ties=["id"], row_number="rn", running_sums={"cum": "v"}, target_rows=9).toPandas()
    want = skewed.assign(s=lambda d: d["id"] % 2).sort_values(["k", "s", "t", "id"])
    want["rn"] = want.groupby("k").cumcount() + 1
    want["cum"] = want.groupby("k")["v"].cumsum()
    merged = got.merge(want, on="id", suffixes=("", "_w"))
    assert (merged["rn"] == merged["rn_w"]).all() and np.allclose(merged["cum"], merged["cum_w"])


def test_only_hot_groups_are_cut(spark, skewed):
    df = add_chunks(spark.createDataFrame(skewed), ["k"], "t", 100)
    counts = {r.k: r.c for r in df.groupBy("k").agg(F.count_distinct("_chunk").alias("c")).collect()}
    assert counts[0] > 1 and all(c == 1 for k, c in counts.items() if k)


def test_uneven_times_give_even_chunks(spark):
    """Nearly all rows sit in a sliver of the time range."""
    t = np.concatenate([np.linspace(0, 1, 2000), np.linspace(1, 1000, 20)])
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "t": t, "v": 1.0}))
    sizes = add_chunks(df, ["k"], "t", 100).groupBy("_chunk").count().toPandas()["count"]
    assert sizes.max() <= 100
    got = ordered(df, ["k"], "t", row_number="rn", target_rows=100).orderBy("t").toPandas()["rn"].tolist()
    assert sorted(got) == list(range(1, 2021))


@pytest.mark.parametrize("ties", [[], ["id"]])
def test_a_tied_group_is_cut_too(spark, monkeypatch, ties):
    """Twenty times the target at one time, repeated rows and null times among them."""
    monkeypatch.setattr("varienne.operators.ordered.SCAN_BLOCK", 7)
    rows = pd.DataFrame({"k": ["hot"] * 2000 + ["x"] * 30, "t": 5.0, "id": [i % 900 for i in range(2000)] + list(range(30)), "v": 1.0})
    df = spark.createDataFrame(rows).withColumns({"t": F.when(F.col("id") % 50 > 0, F.col("t")), "k": F.when(F.col("k") == "x", F.col("k"))}).repartition(5)
    chunks = add_chunks(df, ["k"], "t", 100, ties).groupBy("k", "_chunk").count().toPandas()
    assert len(chunks[chunks.k.isna()]) >= 20 and chunks["count"].max() <= 100
    got = ordered(df, ["k"], "t", ties=ties, row_number="rn", running_sums={"cum": "v"}, lags={"prev": "id"}, target_rows=100)
    got = got.toPandas().sort_values(["k", "rn"]).reset_index(drop=True)
    hot = got[got.k.isna()]
    assert sorted(hot.rn) == list(range(1, 2001)) and np.allclose(hot.sort_values("rn").cum, range(1, 2001))
    assert hot.sort_values("rn").t.isna().to_numpy()[: (hot.t.isna()).sum()].all()
    in_order = hot.sort_values("rn")
    assert in_order.prev.iloc[1:].tolist() == in_order.id.iloc[:-1].tolist() and np.isnan(in_order.prev.iloc[0])
    if ties:
        want = df.where("k is null").toPandas().assign(n=lambda d: d.t.notna()).sort_values(["n", "id"], kind="stable")
        assert in_order.id.tolist() == want.id.tolist()
    assert sorted(got[got.k == "x"].rn) == list(range(1, 31))


def test_order_by_text_and_prefix_without_keys(spark):
    rows = pd.DataFrame({"p": [i % 3 for i in range(500)], "t": [f"t{i * 7 % 500:03}" for i in range(500)]})
    got = ordered(spark.createDataFrame(rows), [], "t", prefix=["p"], row_number="rn", target_rows=20).toPandas().sort_values("rn")
    assert got[["p", "t"]].values.tolist() == rows.sort_values(["p", "t"])[["p", "t"]].values.tolist()


def test_global_order(spark, skewed):
    got = ordered(spark.createDataFrame(skewed), [], "t", ties=["id"], row_number="rn", target_rows=30).toPandas()
    want = skewed.sort_values(["t", "id"]).reset_index(drop=True)
    assert got.sort_values("rn")["id"].tolist() == want["id"].tolist() and "_all" not in got


def test_growth_rate_divides_by_current_mass(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (1, 1.0, 4.0), (1, 2.0, 0.0), (2, 0.0, 5.0)], "c int, time double, m double")
    got = growth_rate(df, "m", ["c"]).orderBy("c", "time").toPandas()["growth_rate"].tolist()
    assert got == [0.0, 0.5, 0.0, 0.0]


def test_even_spacing_single_row(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 1.0), (2, 2.0), (2, 9.0)], "k int, t double")
    got = even_spacing(df, ["k"], "t").orderBy("k", "t").toPandas()["theta"].tolist()
    assert got == [0.0, 0.0, 0.5, 1.0]


def series(spark, values):
    return spark.createDataFrame([(k, float(i), float(v)) for k, vs in values.items() for i, v in enumerate(vs)], "k string, time double, m double")


def test_theta_variants(spark):
    df = series(spark, {"grow": [1, 2, 4], "flat": [3, 3, 3], "one": [5], "down": [8, 4, 2]})
    first_last = growth.theta("first_last", df, mass="m", keys=["k"]).orderBy("k", "time").toPandas()
    assert np.allclose(first_last[first_last.k == "grow"].theta, [0, 0.5, 1])
    assert np.allclose(first_last[first_last.k == "flat"].theta, [0, 0.5, 1])  # no growth: evenly spaced
    assert np.allclose(first_last[first_last.k == "down"].theta, [0, 0.5, 1])
    assert first_last[first_last.k == "one"].theta.tolist() == [0.0]
    min_max = growth.theta("min_max", df, mass="m", keys=["k"]).orderBy("k", "time").toPandas()
    assert np.allclose(min_max[min_max.k == "down"].theta, [1, 0.5, 0])
    per_cell = growth.theta("per_cell", df, mass="m", keys=["k"]).orderBy("k", "time").toPandas()
    assert np.allclose(per_cell[per_cell.k == "grow"].theta, [0, 0.5, 1])
    assert np.allclose(per_cell[per_cell.k == "down"].theta, [0, 0, 0])


def test_theta_nonpositive_mass_is_spaced(spark):
    out = growth.theta("min_max", series(spark, {"a": [0, -1, -2]}), mass="m", keys=["k"]).orderBy("time").toPandas()
    assert np.allclose(out.theta, [0, 0.5, 1])


def test_theta_dna_phases(spark):
    out = growth.theta("dna", series(spark, {"a": [1.0, 1.1, 1.5, 1.9, 2.0]}), dna="m", keys=["k"]).orderBy("time").toPandas()
    assert out.phase.tolist() == ["B", "B", "C", "D", "D"]


def test_theta_angle_range(spark):
    df = series(spark, {"a": [1, 2, 4, 8]}).withColumn("r", F.sin("time"))
    theta = growth.theta("angle", df, mass="m", rate="r", keys=["k"]).toPandas().theta
    assert theta.between(0, 1).all()


def test_theta_registry(spark):
    df = series(spark, {"a": [1, 2]})
    growth.register_theta("half")(lambda d: d.withColumn("theta", F.lit(0.5)))
    assert growth.theta("half", df).toPandas().theta.tolist() == [0.5, 0.5]
    with pytest.raises(ValueError):
        growth.theta("missing", df)
    scaled = growth.theta("custom", df, function=lambda b: b["m"] * 2, inputs=["m"], keys=["k"]).orderBy("time").toPandas()
    assert np.allclose(scaled.theta, [0, 1])


@pytest.mark.parametrize("target", [3, 10**6])
def test_replicate_median(spark, skewed, target):
    got = replicates.replicate_median(spark.createDataFrame(skewed), ["k"], "v", target).toPandas().set_index("k")["y"]
    want = skewed.groupby("k")["v"].median()
    assert np.allclose(got.sort_index(), want.sort_index())


def test_medians_by_counting(spark):
    """Groups far above the limit: mixed signs, tiny and huge values, repeats, infinities, null keys, and bits that need every pass."""
    rng = np.random.default_rng(0)
    groups = {
        "normal": rng.normal(size=501), "wide": np.exp(rng.normal(scale=200, size=400)) * rng.choice([-1, 1], 400), "same": np.full(300, 7.25), "zeros": np.array([0.0, -0.0] * 100 + [1.0]),
        "close": 1.0 + np.arange(320) * 2.0**-52, "infinite": np.array([np.inf] * 60 + [-np.inf] * 60 + [3.0]), "two": np.array([-1.0] * 50 + [1.0] * 50), "few": np.array([4.0, 2.0])}
    rows = [(k if k != "same" else None, float(v)) for k, vs in groups.items() for v in vs] + [("few", None)]
    got = {r.k or "same": r.y for r in replicates.replicate_median(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", gathered=10).collect()}
    assert got == {k: float(np.median(v)) for k, v in groups.items()}
    assert replicates.replicate_median(spark.createDataFrame([], "k string, v double"), ["k"], "v").count() == 0


def test_adaptive_replicates(spark):
    rows = [("calm", i, 10.0 + 0.01 * i) for i in range(30)] + [("wild", i, float((-1) ** i * (i + 1))) for i in range(30)] + [("few", 0, 1.0), ("few", 1, 9.0)]
    got = replicates.adaptive_replicates(spark.createDataFrame(rows, "k string, i int, v double"), ["k"], "v", ["i"], max_reps=20).toPandas().set_index("k")
    assert got["stopped"].to_dict() == {"calm": "target", "wild": "budget", "few": "replicates"}
    assert got.loc["calm", "n_used"] == 3 and got.loc["calm", "y"] == pytest.approx(10.01)
    assert got.loc["wild", "n_used"] == 20
    assert got.loc["few", "n_used"] == 2 and got.loc["few", "y"] == 5.0
    limited = replicates.adaptive_replicates(spark.createDataFrame(rows, "k string, i int, v double"), ["k"], "v", ["i"], max_reps=20)
    assert "WindowGroupLimit" in limited._jdf.queryExecution().toString()


def test_broadcasts_follow_rows_and_width(spark):
    from varienne.session import hint_if_small, materialize, measure

    wide = materialize(spark.range(100).selectExpr("id", "transform(sequence(1, 1000), x -> cast(x as double)) as a", "repeat('x', 50) as s"), "wide")
    rows, size = measure(wide)
    assert rows == 100 and 100 * (8000 + 50) < size < 100 * 8200
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(hint_if_small(wide)) and not hinted(hint_if_small(wide, max_rows=99)) and not hinted(hint_if_small(wide, max_bytes=size - 1))
