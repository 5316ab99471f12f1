import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varienne.operators import aggregate, conditions, design, morris, observables, signals, sobol, strategies

BOX = {"a": (0.0, 2.0), "b": (-1.0, 1.0), "c": (5.0, 5.5)}


# --- aggregates -------------------------------------------------------------------------


def test_nan_is_skipped_but_counted(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "v double")
    row = aggregate.grouped_stats(df, ["v"], ddof=0).first()
    assert (row["mean"], row["std"], row["n"]) == (2.0, 1.0, 4)


def test_single_row_group_has_zero_deviation(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (1, 0, 5.0), (1, 0, 7.0)], "generation int, lineage_seed int, v double")
    out = aggregate.aggregate_timeseries(df, ["v"]).toPandas()
    one = out[(out.strategy == "by_generation") & (out.group_value == 0)].iloc[0]
    assert one["std"] == 0.0 and one["n"] == 1 and len(out) == 4


def test_null_group_value_is_not_the_total(spark):
    df = spark.createDataFrame([(None, 0, 1.0), (1, 0, 5.0)], "generation int, lineage_seed int, v double")
    out = aggregate.aggregate_timeseries(df, ["v"]).toPandas()
    assert (out.strategy == "uniform").sum() == 1 and (out.strategy == "by_generation").sum() == 2


def test_vector_statistics_equal_exploded(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i % 3), rng.normal(50, 2, 5).tolist()) for i in range(40)] + [(9, [1.0] * 5), (0, None), (1, [])]
    df = spark.createDataFrame(rows, "g int, v array<double>")
    key = ["g", "idx"]
    a, b = (aggregate.array_stats(df, "v", ["g"], m).toPandas().sort_values(key).reset_index(drop=True) for m in ("explode", "vector"))
    assert a[key].equals(b[key].astype(a[key].dtypes)) and a["n"].tolist() == b["n"].tolist()
    assert np.allclose(a["mean"], b["mean"]) and np.allclose(a["std"].fillna(-1), b["std"].fillna(-1))


def test_unknown_and_unlabelled_strategy(spark):
    df = spark.createDataFrame([(1.0,)], "v double")
    with pytest.raises(ValueError):
        aggregate.strategy_groups(df, "by_colour")
    with pytest.raises(ValueError):
        aggregate.strategy_groups(df, "by_generation")


def test_variance_fractions(spark):
    rows = [(g, s, float(10 * g + s + e)) for g in range(3) for s in range(2) for e in (-0.5, 0.5)]
    df = spark.createDataFrame(rows, "generation int, lineage_seed int, v double")
    out = aggregate.variance_decomposition(aggregate.aggregate_timeseries(df, ["v"])).first()
    v = np.array([r[2] for r in rows])
    assert out.total_variance == pytest.approx(v.var(ddof=1))
    assert out.between_generation_variance == pytest.approx(np.var([0.5, 10.5, 20.5]))
    assert out.generation_fraction == pytest.approx(out.between_generation_variance / out.total_variance)


@pytest.mark.parametrize("widths", [(5, 4, 5), (17, 90, 33, 17)])
def test_align_dimensions(spark, widths):
    df = spark.createDataFrame([(i, [float(j) for j in range(w)]) for i, w in enumerate(widths)], "i int, v array<double>")
    with pytest.raises(ValueError, match=f"min={min(widths)}, max={max(widths)}"):
        aggregate.align_dimensions(df, "v")
    out = aggregate.align_dimensions(df, "v", strict=False).toPandas()
    assert all(list(v) == list(range(min(widths))) for v in out["v"])
    assert out.sort_values("i")["dropped"].tolist() == [w - min(widths) for w in widths]


def test_stage_profile_fills_empty_stages(spark):
    df = spark.createDataFrame([(0, 1.0), (2, 3.0), (2, 5.0)], "stage int, v double")
    out = aggregate.stage_profile(df, ["v"], 4).orderBy("stage").toPandas()
    assert out["mean"].tolist() == [1.0, 0.0, 4.0, 0.0]


def test_derived_properties(spark):
    m = observables
    rows = [(1, 2.0, None, 1.0, 0.5, 1e-4), (1, None, 4.0, 1.0, None, 3e-4), (2, -1.0, 0.0, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, f"variant int, {m.DRY_MASS} double, {m.CELL_MASS} double, {m.VOLUME} double, {m.DNA_MASS} double, {m.GROWTH_RATE} double")
    out = m.derive_properties(df).orderBy("variant", m.GROWTH_RATE).toPandas()
    assert out["doubling_time_hours"].tolist()[:2] == [pytest.approx(np.log(2) / 0.72)] * 2
    assert np.isnan(out["doubling_time_hours"][2])
    assert out["dry_mass_fraction"].tolist() == [2.0, 0.0, -1.0]
    assert out["dna_fraction_g_per_g_dw"].tolist() == [0.25, 0.0, 1.0]


def test_presets(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 4.0), (2, None, 0.0)], f"variant int, listeners__fba_results__base_reaction_fluxes array<double>, {observables.DRY_MASS} double")
    with pytest.raises(ValueError):
        observables.resolve_preset(df, "nothing")
    assert observables.resolve_preset(df, "mass") == [observables.DRY_MASS]
    out = observables.preset_features(df, "fluxome", ["variant"]).toPandas()
    assert out.values.tolist() == [[1, "base_reaction_fluxes_0", 0.25], [1, "base_reaction_fluxes_1", 0.5]]
    both = observables.concat_presets(df, ["mass", "fluxome"], ["variant"])
    assert both.where("block = 0").count() == 2 and both.where("block = 1").count() == 2


def test_select_positions(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [True, False, True])], "v array<double>, w array<boolean>")
    assert df.select(observables.select_positions(F.col("v"), F.col("w")).alias("s")).first().s == [1.0, 3.0]


# --- strategies ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def small(spark):
    rows = [(s, g, l, g / 3, float(s + g)) for s in range(3) for g in range(3) for l in range(2) if not (s == 2 and g == 2)]
    return spark.createDataFrame(rows, "sample_id int, generation int, lineage_seed int, theta double, v double")


def test_group_means_need_every_sample(small):
    out = strategies.group_means(small, "generation", ["v"]).toPandas()
    assert sorted(out.group_value.unique()) == [0, 1] and len(out) == 6
    assert strategies.group_means(small.drop("generation"), "generation", ["v"]).count() == 0


def test_stage_means_zero_or_null(small):
    zero = strategies.stage_means(small, ["v"], 3).toPandas()
    assert len(zero) == 9 and zero[(zero.sample_id == 2) & (zero.stage == 2)]["y"].tolist() == [0.0]
    assert strategies.stage_means(small, ["v"], 3, empty="null").count() == 8


def test_all_strategies_agree_with_single_ones(small):
    out = strategies.strategy_outputs(small, ["v"], 3).toPandas()
    counts = out.groupby("strategy").size().to_dict()
    assert counts == {"uniform": 3, "by_generation": 6, "by_lineage_seed": 6, "growth_stage": 9}
    one = strategies.sample_means(small, ["v"]).toPandas().set_index("sample_id")["y"]
    assert np.allclose(out[out.strategy == "uniform"].set_index("sample_id")["y"].sort_index(), one.sort_index())


def test_sample_fallback(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (3, 4.0)], "variant int, v double")
    got = {r.sample_id: r.variant for r in strategies.assign_samples(df, 5).select("sample_id", "variant").collect()}
    assert got == {0: 1, 1: 1, 2: 3, 3: 3, 4: 0}
    assert strategies.assign_samples(df, 5, "none").count() == 2
    with pytest.raises(ValueError):
        strategies.assign_samples(df, 5, "nearest")


# --- designs -------------------------------------------------------------------------------


def ids(spark, n, parts=4, name="sample_id"):
    return spark.range(0, n, 1, parts).withColumnRenamed("id", name)


@pytest.mark.parametrize("target", [7, 10**6])
def test_lhs_has_one_point_per_stratum(spark, target):
    out = design.sample_lhs(ids(spark, 50), BOX, 3, target_rows=target).toPandas()
    for name, (lo, hi) in BOX.items():
        u = (out[out.name == name]["x"] - lo) / (hi - lo)
        assert sorted(np.floor(u * 50).astype(int)) == list(range(50))
    wide = design.widen(design.sample_lhs(ids(spark, 50), BOX, 3), "sample_id", list(BOX)).toPandas()
    assert wide.shape == (50, 4) and not wide.isna().any().any()


def test_designs_do_not_depend_on_partitions(spark):
    for make in (
        lambda p: design.sample_uniform(ids(spark, 40, p), BOX, 1).orderBy("sample_id"),
        lambda p: design.sample_lhs(ids(spark, 40, p), BOX, 1).orderBy("sample_id", "name"),
        lambda p: design.morris_design(ids(spark, 9, p, "traj_id"), BOX, 1).orderBy("traj_id", "step"),
        lambda p: design.saltelli_design(ids(spark, 9, p), BOX, 1).orderBy("sample_id", "block"),
    ):
        assert make(1).collect() == make(8).collect()


def test_uniform_stays_in_bounds_and_seeds_differ(spark):
    a = design.sample_uniform(ids(spark, 200), BOX, 1).toPandas()
    b = design.sample_uniform(ids(spark, 200), BOX, 2).toPandas()
    for n, (lo, hi) in BOX.items():
        assert a[n].between(lo, hi).all() and not np.allclose(a[n], b[n])


def test_morris_moves_one_input_per_step(spark):
    out = design.morris_design(ids(spark, 12, 4, "traj_id"), BOX, 5).orderBy("traj_id", "step").toPandas()
    for _, walk in out.groupby("traj_id"):
        unit = np.stack(walk["unit"])
        assert ((unit >= 0) & (unit <= 1 + 1e-12)).all()
        moved = np.abs(np.diff(unit, axis=0))
        assert ((moved > 0).sum(axis=1) == 1).all() and np.allclose(moved.max(axis=1), 4 / 6)
        assert set(walk["changed"].dropna()) == set(BOX)


def test_saltelli_blocks(spark):
    out = design.saltelli_design(ids(spark, 5), BOX, 1).toPandas()
    assert len(out) == 5 * (2 * 3 + 2)
    one = out[out.sample_id == 0].set_index("block")
    assert one.loc["AB_b", "a"] == one.loc["A", "a"] and one.loc["AB_b", "b"] == one.loc["B", "b"]
    assert one.loc["BA_b", "a"] == one.loc["B", "a"] and one.loc["BA_b", "b"] == one.loc["A", "b"]


def test_morris_classes(spark):
    walk = design.morris_design(ids(spark, 40, 4, "traj_id"), {k: (0.0, 1.0) for k in "abc"}, 5)
    effects = morris.elementary_effects(walk.withColumn("y", 5 * F.col("a") + 8 * (F.col("b") - 0.5) * (F.col("b") - 0.5) * F.col("a") + 0.01 * F.col("c")), {k: (0.0, 1.0) for k in "abc"}, "y")
    out = morris.classify(morris.morris_indices(effects)).toPandas().set_index("param")
    assert out.loc["c", "category"] == "negligible" and out.loc["b", "category"] == "nonlinear"
    assert [r.param for r in morris.screen(morris.morris_indices(effects), top_n=1).collect()] == ["a"]
    assert morris.screen(morris.morris_indices(effects), threshold=0.0).count() == 3


def test_monte_carlo_indices(spark):
    box = {"a": (0.0, 1.0), "b": (0.0, 1.0)}
    runs = design.saltelli_design(ids(spark, 4000), box, 1, second_order=False).withColumn("y", 2 * F.col("a") + 0.5 * F.col("b"))
    out = sobol.sobol_mc(runs, ["a", "b"], ["y"]).toPandas().set_index("param")
    assert out.loc["a", "st"] == pytest.approx(4 / 4.25, abs=0.05) and out.loc["a", "s1"] == pytest.approx(4 / 4.25, abs=0.06)


def test_series_model_is_averaged(spark):
    model = lambda x: np.stack([x["a"].to_numpy() * k for k in (1, 3)], axis=1)[:, :, None]
    out = design.evaluate_design(spark.createDataFrame([(1.0,), (2.0,)], "a double"), model, ["y"], ["a"], series=True).orderBy("a").toPandas()
    assert out["y"].tolist() == [2.0, 4.0]


def test_modulated_series_and_counts(spark):
    out = design.modulate(spark.createDataFrame([(10.0,)], "y0 double"), ["y0"], [0.0], 5).orderBy("step").toPandas()
    assert np.allclose(out["y0"], 10 * (1 + 0.2 * np.sin(np.linspace(0, 2 * np.pi, 5))))
    assert design.planned_runs(50, 2, 2) == 204


def test_correlation_proxy_constant_input(spark):
    df = spark.createDataFrame([(float(i), 1.0, 2.0 * i) for i in range(5)], "a double, b double, y double")
    out = sobol.correlation_proxy(df, ["a", "b"], ["y"]).toPandas()
    assert out["s1"].tolist() == [pytest.approx(1.0), 0.0]


# --- conditions ----------------------------------------------------------------------------


def index_table(spark, values):
    return spark.createDataFrame([(c, p, float(v)) for c, row in values.items() for p, v in row.items()], "condition string, param string, st double")


def test_conditions(spark):
    st = index_table(spark, {"x": {"p": 0.6, "q": 0.3, "r": 0.02}, "y": {"p": 0.5, "q": 0.04, "r": 0.3}})
    assert [r.param for r in conditions.universal_drivers(st).collect()] == ["p"]
    assert {(r.condition, r.param) for r in conditions.condition_specific(st).collect()} == {("x", "q"), ("y", "r")}
    diff = {r.param: r.difference for r in conditions.differential_sobol(st).collect()}
    assert diff["q"] == pytest.approx(0.26) and conditions.differential_sobol(st).first().pair == "x_vs_y"
    stability = {r.param: r.stability for r in conditions.rank_stability(st).collect()}
    assert stability == {"p": 1.0, "q": 0.5, "r": 0.5}


def test_threshold_is_inclusive_and_single_condition_is_stable(spark):
    st = index_table(spark, {"x": {"p": 0.1, "q": 0.09}})
    assert [r.param for r in conditions.universal_drivers(st).collect()] == ["p"]
    assert {r.stability for r in conditions.rank_stability(st).collect()} == {1.0}
    assert conditions.condition_specific(st).count() == 0
    with pytest.raises(ValueError):
        conditions.union_conditions({"x": None})


def test_compare_missing_is_zero(spark):
    st = index_table(spark, {"x": {"p": 0.6, "q": 0.3}, "y": {"p": 0.5, "new": 0.9}})
    out = conditions.compare_runs(st, ["x", "y"], run="condition").orderBy("param").toPandas()
    assert out.values.tolist() == [["p", 0.6, 0.5, pytest.approx(-0.1)], ["q", 0.3, 0.0, -0.3]]


def test_top_table_missing_strategy_is_nan(spark):
    rows = spark.createDataFrame([("uniform", 0, "p", 0.5), ("uniform", 1, "q", 0.7)], "strategy string, param_id int, param string, st double")
    out = sobol.top_table(rows, ["uniform", "growth_stage"], "uniform", 1).toPandas()
    assert out["param"].tolist() == ["q"] and np.isnan(out["growth_stage"][0])


# --- signals -------------------------------------------------------------------------------


def waves(spark, n, k=2, seed=0):
    values = np.random.default_rng(seed).normal(size=(k, n))
    rows = [(f"s{i}", int(t), float(v)) for i, row in enumerate(values) for t, v in enumerate(row)]
    return values, spark.createDataFrame(rows, "series string, step bigint, value double")


@pytest.mark.parametrize("n", [1, 12, 60, 37])
def test_spectrum_matches_fft(spark, n):
    values, df = waves(spark, n)
    out = signals.spectrum(df).orderBy("series", "k").toPandas()
    got = (out["re"] + 1j * out["im"]).to_numpy().reshape(2, n)
    assert np.allclose(got, np.fft.fft(values, axis=1))
    back = signals.inverse_spectrum(signals.spectrum(df)).orderBy("series", "step").toPandas()["value"].to_numpy().reshape(2, n)
    assert np.allclose(back, values)


@pytest.mark.parametrize("n", [211, 2 * 127, 60])
def test_long_prime_series_go_through_a_chirp(spark, monkeypatch, n):
    """No part of a transform holds more points than the limit, whatever the length."""
    monkeypatch.setattr(signals, "PART_POINTS", 32)
    seen = []
    two_pass = signals._two_pass
    monkeypatch.setattr(signals, "_two_pass", lambda rows, sign: seen.append(rows) or two_pass(rows, sign))
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2, n))
    df = spark.createDataFrame([(f"s{i}", k, float(x[i, k])) for i in range(2) for k in range(n)], "series string, step bigint, value double")
    out = signals.spectrum(df).orderBy("series", "k").toPandas()
    got = (out.re + 1j * out.im).to_numpy().reshape(2, n)
    assert np.allclose(got, np.fft.fft(x), atol=1e-9)
    assert all((r.select(F.max(F.greatest("n1", F.expr("n div n1")))).first()[0] or 0) <= 32 for r in seen)
    back = signals.inverse_spectrum(signals.spectrum(df)).orderBy("series", "step").toPandas()["value"].to_numpy().reshape(2, n)
    assert np.allclose(back, x)


def test_every_block_is_transformed_once(spark):
    df = spark.createDataFrame([(f"s{i}", k, float(i + k % 7)) for i in range(5) for k in range(100)], "series string, step bigint, value double")
    spectra = signals.block_spectra(df, 16)
    assert spectra.count() == 5 * 7
    sums = signals.summed_products(spectra, 2)
    assert sums.count() == 10 * 5  # pairs of series times block offsets, whatever the number of blocks


@pytest.mark.parametrize("block", [8, 64, 4096])
def test_lag_products_match_correlate(spark, block):
    values, df = waves(spark, 50)
    out = signals.lag_products(df, 50, block=block).toPandas().set_index("lag")["c"]
    want = np.correlate(values[0], values[1], mode="full")
    assert np.allclose(out.reindex(range(-49, 50)), want)
    limited = signals.lag_products(df, 5, block=block).toPandas().set_index("lag")["c"]
    assert sorted(limited.index) == list(range(-5, 6)) and np.allclose(limited.sort_index(), want[44:55])


def test_delayed_series_leads(spark):
    x = np.random.default_rng(3).normal(size=80)
    rows = [("a", t, float(x[t])) for t in range(80)] + [("b", t, float(x[t - 4]) if t >= 4 else 0.0) for t in range(80)]
    df = spark.createDataFrame(rows, "series string, step bigint, value double")
    peak = signals.lag_correlation(df, 40, dt=0.5).first()
    assert peak.lag == -2.0 and peak.peak > 0.8
    scores = {(r.source, r.target): r.score for r in signals.lead_lag_matrix(df, 20).collect()}
    assert scores[("a", "b")] > 0 and scores[("b", "a")] == -scores[("a", "b")]


def test_coherence_of_scaled_copy(spark):
    values, _ = waves(spark, 64, 1)
    rows = [(s, t, float(v * f)) for s, f in (("a", 1.0), ("b", 3.0)) for t, v in enumerate(values[0])]
    out = signals.coherence(spark.createDataFrame(rows, "series string, step bigint, value double"), 16, 1.0).where("k > 0").toPandas()
    assert np.allclose(out["coherence"], 1.0) and np.allclose(out["transfer_re"], 3.0) and np.allclose(out["transfer_im"], 0.0, atol=1e-9)
