"""Use of fitted surrogates: curves, local sensitivity, search and synthesis."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from varienne.functions.basis import PolynomialBasis
from varienne.operators.design import Bounds, germ_columns, to_germ
from varienne.operators.fit import predict, with_phi

SENSITIVITY_EPSILON = 1e-12
LOCAL_STEP = 0.005
SUGGEST_STEP = 0.01
DEFAULT_CURVE_POINTS = 80


def points_phi(points: DataFrame, basis: PolynomialBasis, bounds: Bounds) -> DataFrame:
    """Physical points with their basis row."""
    return with_phi(points, basis, germ_columns(bounds))


def predict_at(points: DataFrame, coefs: DataFrame, basis: PolynomialBasis, bounds: Bounds, groups: Sequence[str] = ()) -> DataFrame:
    return predict(points_phi(points, basis, bounds), coefs, groups, n_terms=basis.n_terms).drop("phi", "coef")


def sweep_points(base: DataFrame, bounds: Bounds, n_points: int = DEFAULT_CURVE_POINTS) -> DataFrame:
    """Rows (…, swept, step, inputs...) that move one input over its range at a base point."""
    spec = F.array(*[F.struct(F.lit(n).alias("swept"), F.lit(float(lo)).alias("_lo"), F.lit(float(hi)).alias("_hi")) for n, (lo, hi) in bounds.items()])
    rows = base.select("*", F.inline(spec)).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))))
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("step") / F.lit(float(n_points - 1))
    return rows.withColumns({n: F.when(F.col("swept") == n, value).otherwise(F.col(n)) for n in bounds}).drop("_lo", "_hi")


def response_curves(base, coefs, basis, bounds, n_points: int = DEFAULT_CURVE_POINTS, groups: Sequence[str] = ()) -> DataFrame:
    """Predicted response along every input at the base points."""
    return predict_at(sweep_points(base, bounds, n_points), coefs, basis, bounds, groups)


def local_sensitivity(points: DataFrame, coefs: DataFrame, basis: PolynomialBasis, bounds: Bounds, step: float = LOCAL_STEP, groups: Sequence[str] = ()) -> DataFrame:
    """Central difference |ŷ(x+δ)-ŷ(x-δ)|/(2δ) per point, output and input, clipped to the bounds.

    Both evaluations sit in one row, so nothing is paired up afterwards.
    """
    names = list(bounds)
    keep = [c for c in points.columns if c not in names]
    spec = F.array(*[
        F.struct(F.lit(i).alias("param_id"), F.lit(n).alias("param"), F.lit((hi - lo) * step).alias("_d"), F.lit(float(lo)).alias("_lo"), F.lit(float(hi)).alias("_hi"))
        for i, (n, (lo, hi)) in enumerate(bounds.items())
    ])
    rows = points.select("*", F.inline(spec))
    moved = lambda n, sign: F.when(
        F.col("param") == n, F.least(F.greatest(F.col(n) + sign * F.col("_d"), F.col("_lo")), F.col("_hi"))).otherwise(F.col(n))
    up = {f"_u_{n}": moved(n, 1.0) for n in names}
    down = {f"_l_{n}": moved(n, -1.0) for n in names}
    rows = rows.withColumns({**up, **down})
    germ = lambda prefix: [to_germ(F.col(f"{prefix}{n}"), lo, hi) for n, (lo, hi) in bounds.items()]
    rows = with_phi(rows, basis, germ("_u_")).withColumnRenamed("phi", "_phi_u")
    rows = with_phi(rows, basis, germ("_l_"))
    diff = F.zip_with("_phi_u", "phi", lambda a, b: a - b)
    rows = rows.withColumn("phi", diff)
    out = predict(rows, coefs, groups, n_terms=basis.n_terms)
    slope = F.abs(F.col("yhat")) / (2.0 * F.col("_d") + SENSITIVITY_EPSILON)
    labels = [c for c in dict.fromkeys([*groups, "output_id"]) if c not in keep]
    return out.select(*keep, *labels, "param_id", "param", slope.alias("sensitivity"))


def midpoint(spark, bounds: Bounds) -> DataFrame:
    """The middle of the input box as a one-row frame."""
    return spark.range(1).select(*[F.lit((lo + hi) / 2.0).alias(n) for n, (lo, hi) in bounds.items()])


def baseline_value(coef: Column, basis: PolynomialBasis) -> Column:
    """ŷ at the middle of the box: every germ is 0 there, so Φ is a constant vector."""
    phi0 = basis.matrix(np.zeros((1, len(basis.params))))[0]
    row = F.array(*[F.lit(float(v)) for v in phi0])
    return F.aggregate(F.zip_with(coef, row, lambda c, p: c * p), F.lit(0.0), lambda a, v: a + v)


def baseline_delta(points: DataFrame, coefs: DataFrame, basis: PolynomialBasis, bounds: Bounds, groups: Sequence[str] = ()) -> DataFrame:
    """Prediction beside the mid-box baseline and the change in percent (0 baseline gives 0)."""
    fits = coefs.withColumn("baseline", baseline_value(F.col("coef"), basis))
    out = predict(points_phi(points, basis, bounds), fits, groups, keep=("output_id", "coef", "baseline"), n_terms=basis.n_terms).drop("phi", "coef")
    change = F.when(F.col("baseline") != 0, (F.col("yhat") - F.col("baseline")) / F.abs("baseline") * 100.0).otherwise(0.0)
    return out.withColumn("change_percent", change)


def predicted_profile(points: DataFrame, coefs: DataFrame, basis: PolynomialBasis, bounds: Bounds, n_obs: int) -> DataFrame:
    """ŷ per stage and observable from fits laid out as output index = stage·n_obs + obs."""
    out = predict_at(points, coefs, basis, bounds)
    index = F.col("output_id").cast("int")
    return out.withColumns({"stage": F.floor(index / n_obs).cast("int"), "obs": index % n_obs})


def argmax_point(scanned: DataFrame, value: str, columns: Sequence[str], key: str, groups: Sequence[str] = ("output_id",)) -> DataFrame:
    """Row with the largest value per group, the smallest key on ties; combined map-side."""
    rank = F.struct(value, (-F.col(key)).alias("k"))
    best = scanned.groupBy(*groups).agg(F.max_by(F.struct(*columns), rank).alias("b"), F.max(value).alias(value))
    return best.select(*groups, "b.*", value)


def suggest_point(candidates: DataFrame, coefs: DataFrame, basis: PolynomialBasis, bounds: Bounds, key: str = "sample_id") -> DataFrame:
    """Per output the candidate farthest from the mid-box prediction, and its most sensitive input.

    The best candidate is a map-side combined max_by; local slopes are taken there only.
    """
    names = list(bounds)
    fits = coefs.withColumn("baseline", baseline_value(F.col("coef"), basis))
    scanned = predict(points_phi(candidates, basis, bounds), fits, keep=("output_id", "coef", "baseline"), n_terms=basis.n_terms)
    gap = F.col("yhat") - F.col("baseline")
    best = argmax_point(scanned.withColumn("deviation", gap * gap), "deviation", [key, *names], key)
    slopes = _slopes_at(best, coefs, basis, bounds)
    top = slopes.groupBy("output_id").agg(F.max_by("param", F.struct("sensitivity", -F.col("param_id"))).alias("top_param"))
    return best.join(top, "output_id")


def _slopes_at(best: DataFrame, coefs: DataFrame, basis: PolynomialBasis, bounds: Bounds) -> DataFrame:
    """Local slopes of each output at its own best point."""
    return local_sensitivity(best, coefs, basis, bounds, SUGGEST_STEP, ["output_id"])


def _start_germs(seed: int, starts: int, d: int) -> np.ndarray:
    """The middle of the box and seeded random points in it; the same for every row."""
    draws = np.random.default_rng(seed).uniform(-1.0, 1.0, (max(starts - 1, 0), d))
    return np.vstack([np.zeros((1, d)), draws])


def nearest_point(basis: PolynomialBasis, coef: np.ndarray, target: float, germs: np.ndarray, tolerance: float, max_steps: int) -> tuple[np.ndarray, float, int, bool]:
    """Germ point in the box whose value is nearest to the target, by projected Gauss-Newton steps from all starts at once.

    A step goes along the gradient of the inputs that are free to move, as far as the linear model asks, clipped to the box, and is halved until the
    distance falls.  Returns the point, its value, the steps taken and whether the search ended by itself: target met, or no free direction reduces
    the distance.
    """
    scale = max(abs(target), float(np.abs(coef).max(initial=0.0)), 1e-300)
    x, value = germs.copy(), basis.matrix(germs) @ coef
    live, steps = np.ones(len(x), bool), 0
    while steps < max_steps and live.any():
        if (np.abs(value - target) <= tolerance * scale).any():
            break
        steps += 1
        at = np.flatnonzero(live)
        residual = value[at] - target
        slope = basis.gradient(x[at]) @ coef
        move = -residual[:, None] * slope
        free = ~(((x[at] >= 1) & (move > 0)) | ((x[at] <= -1) & (move < 0)))
        slope = np.where(free, slope, 0.0)
        power = (slope**2).sum(1)
        stuck = power <= (1e-12 * scale) ** 2
        step = np.where(stuck[:, None], 0.0, -residual[:, None] * slope / np.where(stuck, 1, power)[:, None])
        better = np.zeros(len(at), bool)
        for half in range(30):
            todo = ~better & ~stuck
            if not todo.any():
                break
            trial = np.clip(x[at[todo]] + step[todo] * 0.5**half, -1, 1)
            tried = basis.matrix(trial) @ coef
            good = np.abs(tried - target) < np.abs(residual[todo]) * (1 - 1e-9)
            which = np.flatnonzero(todo)[good]
            x[at[which]], value[at[which]] = trial[good], tried[good]
            better[which] = True
        live[at[~better]] = False
    best = int(np.argmin(np.abs(value - target)))
    met = bool(abs(value[best] - target) <= tolerance * scale)
    return x[best], float(value[best]), steps, met or not live.any()


def search_targets(
    coefs: DataFrame, targets: DataFrame, basis: PolynomialBasis, bounds: Bounds, seed: int = 0, starts: int = 12, tolerance: float = 1e-8, max_steps: int = 200,
) -> DataFrame:
    """Inputs whose prediction comes closest to each target value, with yhat, loss, reached, converged and steps.

    ``targets`` has (output_id, target) and keeps its other columns.  The search runs inside the row, by Gauss-Newton steps with the derivatives of the basis from
    several starts, so targets are shared out over tasks and nothing else moves.  loss is the squared distance; reached tells whether it is within
    ``tolerance`` of the larger of target and coefficients, converged whether the search ended before ``max_steps``.  A target beyond
    what the box allows ends at the nearest point that was found.  Targets of outputs without a fit give no row; a null target gives nulls.
    """
    names = list(bounds)
    germs = _start_germs(seed, starts, len(names))
    kind = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("yhat", T.DoubleType()), T.StructField("steps", T.IntegerType()), T.StructField("converged", T.BooleanType())])

    @pandas_udf(kind)
    def solve(coef: pd.Series, target: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None, None) if t is None or np.isnan(t) else nearest_point(basis, np.asarray(c), float(t), germs, tolerance, max_steps) for c, t in zip(coef, target)]
        return pd.DataFrame([(None if x is None else list(x), y, s, ok) for x, y, s, ok in rows], columns=["x", "yhat", "steps", "converged"])

    found = targets.join(coefs.select("output_id", "coef"), "output_id").withColumn("_s", solve("coef", F.col("target").cast("double")))
    physical = {n: F.lit(float(lo)) + (F.col("_s.x")[i] + 1.0) / 2.0 * (hi - lo) for i, (n, (lo, hi)) in enumerate(bounds.items())}
    loss = (F.col("_s.yhat") - F.col("target")) * (F.col("_s.yhat") - F.col("target"))
    scale = F.greatest(F.abs("target"), F.array_max(F.transform("coef", lambda c: F.abs(c))))
    return found.select(*targets.columns, *[c.alias(n) for n, c in physical.items()], F.col("_s.yhat").alias("yhat"), loss.alias("loss"),
                        (F.sqrt(loss) <= tolerance * scale).alias("reached"), F.col("_s.converged").alias("converged"), F.col("_s.steps").alias("steps"))


# --- spectral outputs: (ω, σ, amplitude) triples per mode -------------------------------


def spectral_features(predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Predicted features 3k, 3k+1, 3k+2 as one row per mode with its frequency."""
    index = F.col("output_id").cast("int")
    pick = lambda r, name: F.max(F.when(index % 3 == r, F.col("yhat"))).alias(name)
    modes = predicted.groupBy(*keys, F.floor(index / 3).cast("int").alias("mode")).agg(pick(0, "omega"), pick(1, "sigma"), pick(2, "amplitude"))
    return modes.withColumn("freq_hz", F.col("omega") / (2.0 * math.pi))


def resynthesize(modes: DataFrame, keys: Sequence[str], t0: float, t1: float, n_times: int, dc: float = 0.0) -> DataFrame:
    """y(t) = dc + Σ a·exp(σt)·cos(ωt) on an even time grid; the grid is unrolled per mode."""
    step = (t1 - t0) / max(n_times - 1, 1)
    rows = modes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_times - 1))))
    t = F.lit(t0) + F.col("i") * F.lit(step)
    wave = F.col("amplitude") * F.exp(F.col("sigma") * t) * F.cos(F.col("omega") * t)
    return rows.groupBy(*keys, "i").agg((F.sum(wave) + dc).alias("y")).withColumn("t", F.lit(t0) + F.col("i") * F.lit(step))
