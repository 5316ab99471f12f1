import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varienne.functions.basis import PolynomialBasis
from varienne.operators import design, fit, multifit, qr, sobol, surrogate
from varienne.operators.sparse import sparse_bayes
from varienne.plans import quantify, sampling

BOX = {"x0": (0.0, 1.0), "x1": (0.0, 1.0)}
CUBE = {"x0": (0.0, 1.0), "x1": (0.0, 1.0), "x2": (0.0, 1.0)}


def frame(n, bounds, f, seed=0):
    rng = np.random.default_rng(seed)
    x = pd.DataFrame({k: lo + rng.random(n) * (hi - lo) for k, (lo, hi) in bounds.items()})
    out = f(x, rng)
    for k, v in (out if isinstance(out, dict) else {"y": out}).items():
        x[k] = v
    x.insert(0, "sample_id", range(n))
    return x


def fitted(spark, pdf, bounds, order, outputs=("y",), method="lsq", **options):
    basis = PolynomialBasis(tuple(bounds), order)
    df = spark.createDataFrame(pdf)
    stats = fit.wide_statistics(df, basis, design.germ_columns(bounds), list(outputs))
    return df, basis, stats, fit.fit(stats, [], method, **options)


def relerr(df, basis, fits, bounds, y="y"):
    out = surrogate.predict_at(df, fits, basis, bounds).withColumn("_y", F.col(y))
    return fit.relative_error(out, ["output_id"], "_y").first().relative_error


def linear(x, rng):
    return 2 * x.x0 + 0.5 * x.x1 + 0.1 * x.x2


def quadratic(x, rng):
    return 3 * x.x0**2 + x.x1 - 0.5 * x.x0 * x.x1


@pytest.mark.parametrize("f,bounds,order,n", [(linear, CUBE, 1, 50), (linear, CUBE, 2, 50), (quadratic, BOX, 2, 60), (quadratic, BOX, 3, 60)])
def test_lsq_is_exact_on_polynomials(spark, f, bounds, order, n):
    df, basis, _, fits = fitted(spark, frame(n, bounds, f), bounds, order)
    assert relerr(df, basis, fits, bounds) < 1e-10


def test_blocks_and_generated_sums_agree(spark):
    pdf = frame(40, BOX, lambda x, r: {"y": x.x0 + r.random(40), "z": x.x1 * x.x0})
    pdf["g"] = np.where(pdf.sample_id % 3 == 0, "a", "b")
    df, basis = spark.createDataFrame(pdf), PolynomialBasis(tuple(BOX), 2)
    germ = design.germ_columns(BOX)
    parts = [f(df, basis, germ, ["y", "z"], ["g"]).orderBy("g").toPandas() for f in (fit._generated_sums, fit._block_sums)]
    assert parts[0]["n"].tolist() == parts[1]["n"].tolist()
    assert np.allclose(np.stack(parts[0]["sums"]), np.stack(parts[1]["sums"]))


def test_lsq_matches_numpy(spark):
    pdf = frame(80, CUBE, lambda x, r: np.exp(x.x0) + x.x1 * x.x2 + 0.1 * r.standard_normal(80))
    _, basis, _, fits = fitted(spark, pdf, CUBE, 2, covariance=True)
    a = basis.matrix(2 * pdf[list(CUBE)].to_numpy() - 1)
    coef, res = np.linalg.lstsq(a, pdf["y"].to_numpy(), rcond=None)[:2]
    row = fits.first()
    assert np.allclose(row.coef, coef, atol=1e-9)
    assert row.sigma2 == pytest.approx(res[0] / (80 - 10))
    quality = fit.fit_quality(fits).first()
    assert quality.r_squared == pytest.approx(1 - res[0] / ((pdf.y - pdf.y.mean()) ** 2).sum())
    phi = fit.with_phi(spark.createDataFrame(pdf), basis, design.germ_columns(CUBE))
    var = phi.join(fits).select("sample_id", fit.predict_variance(F.col("phi"), F.col("ginv"), F.col("sigma2")).alias("v")).orderBy("sample_id").toPandas().v
    want = row.sigma2 * np.einsum("ij,jk,ik->i", a, np.linalg.inv(a.T @ a), a)
    assert np.allclose(var, want)


def test_underdetermined(spark):
    params = {f"x{i}": (0.0, 1.0) for i in range(6)}
    pdf = frame(10, params, lambda x, r: x.x0 + x.x5**2)
    df, basis, stats, fits = fitted(spark, pdf, params, 2)
    assert basis.n_terms == 28
    assert relerr(df, basis, fits, params) < 1e-6
    a = basis.matrix(2 * pdf[list(params)].to_numpy() - 1)
    assert np.allclose(fits.first().coef, np.linalg.pinv(a) @ pdf["y"].to_numpy(), atol=1e-6)
    with pytest.raises(Exception, match="10 samples for 28 terms"):
        fit.fit(stats, [], underdetermined="error").collect()


def test_unknown_method(spark):
    _, _, stats, _ = fitted(spark, frame(20, BOX, quadratic), BOX, 1)
    with pytest.raises(ValueError):
        fit.fit(stats, [], "ridge")


def test_anl_on_noise(spark):
    pdf = frame(40, CUBE, lambda x, r: linear(x, r) + 0.02 * r.standard_normal(40))
    df, basis, _, fits = fitted(spark, pdf, CUBE, 1, method="anl")
    assert relerr(df, basis, fits, CUBE) < 0.05
    assert np.sqrt(fits.first().sigma2) == pytest.approx(0.02, rel=0.4)


def test_bcs_is_sparse_and_close(spark):
    df, basis, _, fits = fitted(spark, frame(60, BOX, quadratic), BOX, 3, method="bcs", tolerance=1e-4)
    assert relerr(df, basis, fits, BOX) < 0.1
    used = [a for a, u in zip(basis.indices, fits.first().used) if u]
    assert len(used) < basis.n_terms and {(1, 0), (2, 0), (0, 1)} <= set(used)


def test_sobol_analytic(spark):
    _, basis, _, fits = fitted(spark, frame(60, BOX, lambda x, r: 2 * x.x0 + 0.5 * x.x1), BOX, 2)
    out = sobol.sobol_indices(fits, basis).toPandas().set_index("param")
    assert out.loc["x0", "st"] == pytest.approx(4 / 4.25, abs=1e-6)
    assert out["s1"].sum() == pytest.approx(1, abs=1e-9)
    assert (out["st"] >= out["s1"] - 1e-12).all()


def test_sobol_brute_force(spark):
    """Indices of a polynomial with interaction against a fine grid."""
    _, basis, _, fits = fitted(spark, frame(80, BOX, quadratic), BOX, 2)
    g = (np.arange(400) + 0.5) / 400
    y = 3 * g[:, None] ** 2 + g[None, :] - 0.5 * g[:, None] * g[None, :]
    var = y.var()
    out = sobol.sobol_indices(fits, basis).toPandas().set_index("param")
    assert out.loc["x0", "s1"] == pytest.approx(y.mean(axis=1).var() / var, abs=1e-4)
    assert out.loc["x0", "st"] == pytest.approx(1 - y.mean(axis=0).var() / var, abs=1e-4)
    joint = sobol.sobol_joint(fits, basis).first().s_ij
    assert joint == pytest.approx(1 - (y.mean(axis=1).var() + y.mean(axis=0).var()) / var, abs=1e-4)


def test_zero_variance_gives_zero(spark):
    _, basis, _, fits = fitted(spark, frame(20, BOX, lambda x, r: 0.0 * x.x0), BOX, 1)
    out = sobol.sobol_indices(fits, basis).toPandas()
    assert (out["st"] == 0).all() and out["degenerate"].all()


def test_higher_order_lowers_error(spark):
    pdf = frame(80, BOX, lambda x, r: np.exp(2 * x.x0) + np.sin(3 * x.x1))
    errors = []
    for order in (1, 2, 3):
        df, basis, _, fits = fitted(spark, pdf, BOX, order)
        errors.append(relerr(df, basis, fits, BOX))
    assert errors[0] > errors[1] > errors[2]


def test_fit_strategies_equals_separate_fits(spark):
    pdf = frame(30, BOX, lambda x, r: {"a": 3 * x.x0 + 0.1 * x.x1, "b": 0.2 * x.x0 + 5 * x.x1})
    df = spark.createDataFrame(pdf)
    parts = [
        df.selectExpr("'uniform' strategy", f"cast({g} as bigint) group_value", "sample_id", f"inline(array(struct('a' as output_id, a * {g + 1.0} as y), struct('b' as output_id, b as y)))")
        for g in range(2)
    ]
    out = quantify.fit_strategies(df.select("sample_id", *BOX), BOX, parts[0].unionByName(parts[1]), order=2)
    st = out.indices.toPandas().pivot_table(index=["group_value", "output_id"], columns="param", values="st")
    assert st.loc[(0, "a"), "x0"] > 0.99 and st.loc[(1, "b"), "x1"] > 0.99
    weighted = out.weighted.toPandas()
    assert len(weighted) == 4 and weighted.groupby("group_value")["st"].sum().between(0.999, 1.001).all()
    doc = quantify.summary_document(out).first()
    assert [g.group_value for g in doc.groups] == [0, 1]


def test_find_target(spark):
    _, basis, _, fits = fitted(spark, frame(60, BOX, quadratic), BOX, 2)
    targets = spark.createDataFrame([("y", 1.0, "a"), ("y", 2.5, "b"), ("y", 1.0, "c"), ("y", 90.0, "far"), ("y", -5.0, "low"), ("y", None, "none"), ("z", 1.0, "lost")], "output_id string, target double, tag string")
    out = {r.tag: r for r in surrogate.search_targets(fits, targets, basis, BOX, seed=1).collect()}
    assert set(out) == {"a", "b", "c", "far", "low", "none"}
    for tag in "abc":
        assert out[tag].reached and out[tag].converged and abs(out[tag].yhat - out[tag].target) < 1e-6 and 0 <= out[tag].x0 <= 1 and 0 <= out[tag].x1 <= 1
    # The largest value of 3 x0² + x1 - x0 x1 / 2 in the box is 3.5 at (1, 1), the smallest 0 at (0, 0).
    far, low = out["far"], out["low"]
    assert not far.reached and far.converged and (far.x0, far.x1) == pytest.approx((1, 1)) and far.yhat == pytest.approx(3.5)
    assert not low.reached and low.converged and (low.x0, low.x1) == pytest.approx((0, 0), abs=1e-6) and low.loss == pytest.approx(25)
    assert out["none"].x0 is None and out["none"].reached is None


def test_basis_gradient():
    for family in ("legendre", "hermite"):
        basis = PolynomialBasis(("a", "b", "c"), 3, family)
        x = np.random.default_rng(0).uniform(-0.9, 0.9, (5, 3))
        for i in range(3):
            step = np.zeros(3)
            step[i] = 1e-6
            assert np.allclose(basis.gradient(x)[:, i], (basis.matrix(x + step) - basis.matrix(x - step)) / 2e-6, atol=1e-7)


def test_adaptive_fit_stops_midway(spark):
    pdf = frame(3000, BOX, lambda x, r: {"y": np.exp(x.x0) + x.x1, "z": x.x0 + 0.01 * r.standard_normal(3000)})
    df, basis, germ = spark.createDataFrame(pdf), PolynomialBasis(tuple(BOX), 2), design.germ_columns(BOX)
    position = sampling.sample_position(["sample_id"])
    fits, rounds = sampling.adaptive_fit(df, basis, germ, ["y", "z"], position, 0.0118)
    rows = rounds.orderBy("round").collect()
    assert 0 < len(rows) < 9 and rows[-1].held_out_error <= 0.0118 and all(r.held_out_error > 0.0118 for r in rows[:-1])
    place = df.select("sample_id", position.alias("p")).toPandas().set_index("sample_id").p.reindex(range(3000)).to_numpy()
    x = basis.matrix(2 * pdf[list(BOX)].to_numpy() - 1)
    got = {r.output_id: r for r in fits.collect()}
    for o in ("y", "z"):
        use = place < rows[-1].share
        want = np.linalg.lstsq(x[use], pdf[o].to_numpy()[use], rcond=None)[0]
        assert np.allclose(got[o].coef, want, atol=1e-8) and got[o].n == use.sum() == rows[-1].n_samples
    everything = sampling.adaptive_fit(df, basis, germ, ["y", "z"], position, 0.0)[1].orderBy("round").collect()
    assert everything[-1].n_samples == 3000 and everything[-1].held_out_error is None


def test_every_fit_in_slices(spark, monkeypatch):
    monkeypatch.setattr(fit, "SLICE_BYTES", 300)
    coefs = spark.createDataFrame([(f"o{i}", [float(i)]) for i in range(7)], "output_id string, coef array<double>")
    out = fit.every_fit(spark.range(3), coefs, ["output_id", "coef"])
    assert out.count() == 21 and out.select("id", "output_id").distinct().count() == 21


def test_adaptive_sampling_stops(spark):
    model = lambda df: df.withColumn("y", F.col("x0") * 3 + F.col("x1") * F.col("x1"))
    _, rounds = sampling.adaptive_sampling(spark, BOX, model, ["y"], 60, order=2, tolerance=1e-4)
    assert rounds.count() == 1
    rough = lambda df: df.withColumn("y", F.when(F.col("x0") > 0.5, 1.0).otherwise(-1.0))
    _, rounds = sampling.adaptive_sampling(spark, BOX, rough, ["y"], 60, order=1, tolerance=1e-4)
    assert rounds.orderBy("round").toPandas()["n_samples"].tolist() == [19, 29, 39, 49, 59, 60]


def test_screened_surrogate(spark):
    model = lambda names: 5.0 * F.col("x0") + F.col("x2") * F.col("x2") + 0.001 * F.col("x1")
    out = sampling.screened_surrogate(
        spark.range(20).withColumnRenamed("id", "traj_id"), spark.range(40).withColumnRenamed("id", "sample_id"), CUBE, model, keep=2, order=2)
    assert out.kept == ["x0", "x2"]
    row = out.fits.first()
    assert row.n == 40 and row.sigma2 < 1e-10


@pytest.mark.parametrize("terms", [0, 10**6])
def test_missing_and_shifted_outputs(spark, monkeypatch, terms):
    monkeypatch.setattr(fit, "GENERATED_SUMS", terms)
    pdf = frame(60, BOX, lambda x, r: {"y": 6 + x.x0, "z": 1e9 + 2 * x.x0 + 0.1 * r.standard_normal(60), "w": x.x1})
    pdf["y"] = np.where(pdf.sample_id % 3 == 0, np.nan, pdf.y)
    pdf["g"] = np.where(pdf.sample_id % 2 == 0, "a", None)
    df = spark.createDataFrame(pdf).repartition(3)
    df = df.withColumn("y", F.when(F.col("sample_id") % 6 != 0, F.col("y")))  # nulls and NaN
    basis, germ = PolynomialBasis(tuple(BOX), 1), design.germ_columns(BOX)
    x = np.stack([2 * pdf.x0 - 1, 2 * pdf.x1 - 1], axis=1)
    phi = np.column_stack([np.ones(60), x])
    phi = phi if basis.indices[1] == (1, 0) else phi[:, [0, 2, 1]]

    def check(rows):
        assert len(rows) == 6
        for r in rows:
            use = ((pdf.g == "a") if r.g == "a" else pdf.g.isna()).to_numpy() & ~np.isnan(pdf[r.output_id].to_numpy())
            a, b = phi[use], pdf[r.output_id].to_numpy()[use]
            want, _, _, _ = np.linalg.lstsq(a, b - b.mean(), rcond=None)
            sse = ((b - b.mean() - a @ want) ** 2).sum()
            assert r.n == use.sum() and np.allclose(np.array(r.coef) - np.array([b.mean(), 0, 0]), want, atol=1e-6)
            assert r.sigma2 == pytest.approx(sse / (use.sum() - 3), rel=1e-3, abs=1e-12)
            assert r.syy / r.n == pytest.approx(b.var(), rel=1e-6)

    check(fit.fit(fit.wide_statistics(df, basis, germ, ["y", "z", "w"], ["g"]), ["g"]).collect())
    long_ = df.select("g", "sample_id", F.expr("stack(3, 'y', y, 'z', z, 'w', w) as (output_id, y)"))
    long_ = long_.withColumn("g", F.coalesce("g", F.lit("none")))
    sums = multifit.output_sums(long_, fit.with_phi(df, basis, germ).select("sample_id", "phi"), basis, ["g"])
    fits = multifit.fit_outputs(sums)
    check(fits.collect())
    quality = {(r.g, r.output_id): r.r_squared for r in fit.fit_quality(fits).collect()}
    assert all(q > 0.9 for q in quality.values())


def long_frame(spark, n, bounds, order, m, missing=(), seed=3):
    """Design with basis rows, m random outputs in long form, and both as arrays."""
    rng = np.random.default_rng(seed)
    pdf = frame(n, bounds, lambda x, r: {})
    basis = PolynomialBasis(tuple(bounds), order)
    phi = basis.matrix(2 * pdf[list(bounds)].to_numpy() - 1)
    y = phi @ rng.normal(size=(basis.n_terms, m)) + 0.1 * rng.normal(size=(n, m)) + 50 * rng.random(m)
    for s, o in missing:
        y[s, o] = np.nan
    df = spark.createDataFrame(pdf)
    rows = spark.createDataFrame(pd.DataFrame({"sample_id": np.repeat(np.arange(n), m), "output_id": np.tile([f"o{j:04}" for j in range(m)], n), "y": y.ravel()}))
    return basis, fit.with_phi(df, basis, design.germ_columns(bounds)).select("sample_id", "phi"), rows.withColumn("g", F.lit("g")), phi, y


def test_a_thousand_outputs_share_one_factor(spark, monkeypatch):
    monkeypatch.setattr(multifit, "BLOCK_VALUES", 286 * 300)
    bounds = {f"x{i}": (0.0, 1.0) for i in range(10)}
    basis, phi, rows, x, y = long_frame(spark, 400, bounds, 3, 1000, missing=[(7, 3), (7, 4), (9, 5)])
    sums = multifit.output_sums(rows, phi, basis, ["g"])
    assert basis.n_terms == 286 and sums.outputs.columns == ["g", "output_id", "folds", "_set"]
    assert sums.sets.count() == 3 and sums.grams.count() == 3  # all samples, without 7, without 9
    fits = {r.output_id: r for r in multifit.fit_outputs(sums).collect()}
    assert len(fits) == 1000
    for j in (0, 3, 4, 5, 999):
        use = ~np.isnan(y[:, j])
        want = np.linalg.lstsq(x[use], y[use, j], rcond=None)[0]
        assert np.allclose(fits[f"o{j:04}"].coef, want, atol=1e-7) and fits[f"o{j:04}"].n == use.sum()


def test_errors_of_folds_equal_separate_fits(spark):
    basis, phi, rows, x, y = long_frame(spark, 60, BOX, 2, 3, missing=[(4, 1), (11, 1)])
    fold = F.col("sample_id") % 4
    got = multifit.errors(multifit.fit_outputs(multifit.output_sums(rows, phi, basis, ["g"], fold=fold, folds=4), test_fold=0, cross=True), ["g"]).orderBy("output_id").collect()
    of = np.arange(60) % 4
    norm = np.linalg.norm
    for j, r in enumerate(got):
        use = ~np.isnan(y[:, j])
        solve = lambda rows: np.linalg.lstsq(x[rows], y[rows, j], rcond=None)[0]  # noqa: B023, E731
        train, test = use & (of != 0), use & (of == 0)
        e = y[:, j] - x @ solve(train)
        assert r.train_error == pytest.approx(norm(e[train]) / norm(y[train, j]), rel=1e-6)
        assert r.test_error == pytest.approx(norm(e[test]) / norm(y[test, j]), rel=1e-6)
        cross = np.concatenate([(y[:, j] - x @ solve(train & (of != f)))[train & (of == f)] for f in (1, 2, 3)])
        assert r.cross_error == pytest.approx(norm(cross) / norm(y[train, j]), rel=1e-6) and r.n == train.sum() and r.test_n == test.sum()


@pytest.mark.parametrize("method", ["anl", "bcs"])
def test_other_methods_of_many_outputs(spark, method):
    basis, phi, rows, x, y = long_frame(spark, 80, BOX, 2, 2)
    sums = multifit.output_sums(rows, phi, basis, ["g"])
    for j, r in enumerate(multifit.fit_outputs(sums, method).orderBy("output_id").collect()):
        want = np.linalg.lstsq(x, y[:, j], rcond=None)[0]
        assert r.converged and np.allclose(r.coef, want, atol=0.1) and r.sse == pytest.approx(((y[:, j] - x @ np.array(r.coef)) ** 2).sum(), rel=1e-6)


def test_qr_keeps_small_residuals_and_narrow_inputs(spark, monkeypatch):
    monkeypatch.setattr(qr, "FAN_IN", 3)
    pdf = frame(200, CUBE, lambda x, r: {"y": 1e3 + x.x0**3 - 2 * x.x0 * x.x1 * x.x2 + x.x2**2})
    pdf["g"] = np.where(pdf.sample_id % 3 == 0, "a", None)
    # The second half of the test: inputs that fill a hundredth of their range, so that the normal equations lose all digits.
    for width in (1.0, 0.01):
        narrow = pdf.copy()
        narrow[list(CUBE)] *= width
        narrow["y"] = 1e3 + narrow.x0**3 - 2 * narrow.x0 * narrow.x1 * narrow.x2 + narrow.x2**2
        df, basis = spark.createDataFrame(narrow).repartition(11), PolynomialBasis(tuple(CUBE), 3)
        factors = qr.qr_factors(df, basis, design.germ_columns(CUBE), ["y"], ["g"])
        rows = qr.fit_qr(factors, ["g"]).collect()
        x = basis.matrix(2 * narrow[list(CUBE)].to_numpy() - 1)
        assert len(rows) == 2
        for r in rows:
            use = ((narrow.g == "a") if r.g == "a" else narrow.g.isna()).to_numpy()
            e = narrow.y.to_numpy()[use] - x[use] @ np.array(r.coef)
            assert np.linalg.norm(e) < 1e-10 * np.linalg.norm(narrow.y[use]) and np.sqrt(r.sse) < 1e-10 * np.linalg.norm(narrow.y[use])
            assert r.n == use.sum() and r.mean == pytest.approx(narrow.y[use].mean()) and r.syy / r.n == pytest.approx(narrow.y[use].to_numpy().var(), rel=1e-6)


def test_qr_without_enough_samples_has_least_norm(spark):
    pdf = frame(6, BOX, linear_pair)
    df, basis = spark.createDataFrame(pdf).repartition(4), PolynomialBasis(tuple(BOX), 2)
    df = df.withColumn("z", F.when(F.col("sample_id") > 1, F.col("z")))
    rows = {r.output_id: r for r in qr.fit_qr(qr.qr_factors(df, basis, design.germ_columns(BOX), ["y", "z"])).collect()}
    x = basis.matrix(2 * pdf[list(BOX)].to_numpy() - 1)
    assert np.allclose(rows["y"].coef, np.linalg.lstsq(x, pdf.y, rcond=None)[0], atol=1e-8)
    assert np.allclose(rows["z"].coef, np.linalg.lstsq(x[2:], pdf.z[2:], rcond=None)[0], atol=1e-8) and rows["z"].n == 4


def linear_pair(x, rng):
    return {"y": x.x0 + 3 * x.x1, "z": x.x0 * x.x1 + rng.random(len(x))}


def test_leverages_give_leave_one_out(spark):
    pdf = frame(40, BOX, linear_pair)
    df, basis, germ = spark.createDataFrame(pdf), PolynomialBasis(tuple(BOX), 2), design.germ_columns(BOX)
    scores = qr.scored(df, qr.qr_factors(df, basis, germ, ["z"]), basis, germ, keep=["sample_id", "z"], block_rows=9)
    got = qr.leave_one_out(scores, y="z").first()
    x, z = basis.matrix(2 * pdf[list(BOX)].to_numpy() - 1), pdf.z.to_numpy()
    errors = [z[i] - x[i] @ np.linalg.lstsq(np.delete(x, i, 0), np.delete(z, i), rcond=None)[0] for i in range(40)]
    assert got.loo_error == pytest.approx(np.linalg.norm(errors) / np.linalg.norm(z), rel=1e-9) and got.n == 40 and got.undetermined == 0


@pytest.mark.parametrize("noise", [0.0, 0.1])
def test_sparse_bayes_follows_the_noise(noise):
    rng = np.random.default_rng(1)
    basis = PolynomialBasis(tuple("abcde"), 3)
    x = basis.matrix(rng.uniform(-1, 1, (300, 5)))
    true = np.zeros(56)
    true[[0, 3, 20, 41]] = [900, 5, -4, 3]
    y = x @ true + noise * rng.normal(size=300)
    c = y - y.mean()
    out = sparse_bayes(x.T @ x, x.T @ c, c @ c, 300, y.mean(), 1e-3)
    assert out.converged and 3 <= out.steps < 60 and out.used[[0, 3, 20, 41]].all()
    assert np.abs(out.coef - true).max() < (0.1 if noise else 1e-7) and out.sigma2 == pytest.approx(noise**2, rel=0.3, abs=1e-12)
    assert noise or out.used.sum() == 4
    stopped = sparse_bayes(x.T @ x, x.T @ c, c @ c, 300, y.mean(), 1e-3, steps_per_term=0)
    assert not stopped.converged and stopped.steps == 0
    flat = sparse_bayes(x.T @ x, np.zeros(56), 0.0, 300, 4.0, 1e-3)
    assert flat.coef[0] == 4 and flat.used.sum() == 1 and flat.converged
