import numpy as np
import pytest
from pyspark.sql import functions as F

from varienne.functions import numeric, rng
from varienne.functions.basis import PolynomialBasis, choose_order, choose_order_column, graded_indices, minimum_samples, term_count
from varienne.operators import design


def column(spark, values, c):
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double").select("i", c.alias("r"))
    return [r.r for r in rows.orderBy("i").collect()]


@pytest.mark.parametrize("n", [1, 3, 5, 7, 10, 20])
def test_stage_bin_matches_edges(spark, n):
    theta = np.concatenate([np.linspace(0, 1, 501), np.arange(n + 1) / n, np.linspace(0, 1, n + 1), [np.nextafter(0.3, 0), np.nextafter(0.3, 1)]])
    want = np.clip(np.digitize(theta, np.linspace(0, 1, n + 1)) - 1, 0, n - 1)
    assert column(spark, theta, numeric.stage_bin(F.col("v"), n)) == want.tolist()


def test_stage_bin_raw_is_unclipped(spark):
    assert column(spark, [-0.1, 0.0, 0.49, 0.5, 1.0], numeric.stage_bin_raw(F.col("v"), 2)) == [-1, 0, 0, 1, 2]


@pytest.mark.parametrize("family", ["legendre", "hermite"])
def test_basis_matches_numpy(spark, family):
    x = np.linspace(-1, 1, 9)
    basis = PolynomialBasis(("a", "b"), 4, family)
    rows = spark.createDataFrame([(i, float(v), float(v * v - 0.5)) for i, v in enumerate(x)], "i int, a double, b double")
    got = np.array([r.phi for r in rows.withColumn("phi", basis.phi([F.col("a"), F.col("b")])).orderBy("i").collect()])
    val = np.polynomial.legendre.legval if family == "legendre" else np.polynomial.hermite_e.hermeval
    one = lambda n, v: val(v, np.eye(n + 1)[n])
    want = np.array([[one(a, u) * one(b, u * u - 0.5) for a, b in basis.indices] for u in x])
    assert np.allclose(got, want, atol=1e-12)
    assert np.allclose(basis.matrix(np.column_stack([x, x * x - 0.5])), want, atol=1e-12)


@pytest.mark.parametrize("n,p,count", [(3, 2, 10), (5, 3, 56), (10, 3, 286), (20, 3, 1771), (6, 2, 28)])
def test_multi_index_counts(n, p, count):
    assert term_count(n, p) == count == len(graded_indices(n, p))
    assert graded_indices(n, p)[0] == (0,) * n
    assert minimum_samples(n, p) == 2 * count


def test_unknown_family():
    with pytest.raises(ValueError):
        PolynomialBasis(("a",), 1, "chebyshev")


@pytest.mark.parametrize("n,samples,order", [(3, 7, 1), (3, 20, 2), (3, 39, 2), (3, 40, 3), (6, 1, 1)])
def test_choose_order(n, samples, order):
    assert choose_order(n, samples) == order


def test_germ_round_trip_and_zero_width(spark):
    back = design.from_germ(design.to_germ(F.col("v"), 2.0, 5.0), 2.0, 5.0)
    assert np.allclose(column(spark, [2.0, 3.3, 5.0], back), [2.0, 3.3, 5.0])
    assert column(spark, [2.0, 2.5], design.to_germ(F.col("v"), 2.0, 2.0)) == [-1.0, 0.0]


@pytest.mark.parametrize("span,step", [(1.0, 0.02), (6.5, 0.1), (0.22, 0.005), (4.9e-8, 1e-9), (350.0, 5.0)])
def test_slider_step(spark, span, step):
    assert column(spark, [span], numeric.slider_step(F.lit(0.0), F.col("v")))[0] == pytest.approx(step)


def test_names(spark):
    row = spark.range(1).select(
        numeric.hive_name(F.lit("listeners.mass.dry_mass")).alias("h"), numeric.short_name(F.lit("listeners__mass__dry_mass")).alias("s")).first()
    assert (row.h, row.s) == ("listeners__mass__dry_mass", "dry_mass")


def test_draws_do_not_depend_on_partitions(spark):
    draw = lambda parts: spark.range(0, 500, 1, parts).select("id", rng.uniform(3, "id").alias("u"), rng.normal(3, "id").alias("z")).orderBy("id").collect()
    one, many = draw(1), draw(8)
    assert one == many
    u = np.array([r.u for r in one])
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.05


def test_poisson_and_exponential(spark):
    df = spark.range(4000).select(rng.poisson(5.0, rng.uniform(1, "id")).alias("p"), rng.exponential(2.0, rng.uniform(2, "id")).alias("e"))
    row = df.agg(F.avg("p").alias("p"), F.var_pop("p").alias("v"), F.avg("e").alias("e")).first()
    assert row.p == pytest.approx(5, abs=0.2) and row.v == pytest.approx(5, abs=0.5) and row.e == pytest.approx(2, abs=0.2)


def test_task_functions_travel_by_value(tmp_path):
    """Executors without the package can still load what runs inside tasks."""
    import subprocess
    import sys

    from pyspark import cloudpickle
    from varienne.operators import fit

    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(fit.pseudo_inverse))
    code = "import pickle, numpy; print(pickle.load(open('f.pkl', 'rb'))(numpy.eye(2) * 2)[0, 0])"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert float(out.stdout) == 0.5, out.stderr


@pytest.mark.parametrize("d", [1, 2, 3, 6])
def test_order_has_no_ceiling(spark, d):
    counts = [0, 1, 5, 12, 100, 1000, 12345, 3_000_000]
    counts = counts[:-1] if d == 1 else counts
    got = spark.createDataFrame([(n,) for n in counts], "n long").select("n", choose_order_column(d, F.col("n")).alias("o")).collect()
    assert {r.n: r.o for r in got} == {n: choose_order(d, n) for n in counts}
