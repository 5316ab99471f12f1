"""Morris screening from one-at-a-time trajectories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varienne.functions.numeric import slider_step
from varienne.operators.design import Bounds
from varienne.session import checked_broadcast

SCREEN_FRACTION = 0.1
NEGLIGIBLE_BELOW = 0.1
LINEAR_BELOW = 0.5
NORM_EPSILON = 1e-10


def elementary_effects(evaluated: DataFrame, bounds: Bounds, output: str, key: str = "traj_id") -> DataFrame:
    """Δy/(Δx·range) between successive points of a trajectory.

    A trajectory has one point per input plus one, so its window is that small.
    """
    w = Window.partitionBy(key).orderBy("step")
    moved = F.array(*[F.lit(n) for n in bounds])
    ranges = F.array(*[F.lit(float(hi) - float(lo)) for lo, hi in bounds.values()])
    df = evaluated.withColumns({"_dy": F.col(output) - F.lag(output).over(w), "_before": F.lag("unit").over(w)}).where("step > 0")
    at = F.array_position(moved, F.col("changed")).cast("int")
    dx = F.element_at("unit", at) - F.element_at("_before", at)
    effect = F.when(dx != 0, F.col("_dy") / (dx * F.element_at(ranges, at))).otherwise(0.0)
    return df.select(key, (at - 1).alias("param_id"), F.col("changed").alias("param"), effect.alias("ee"))


def morris_indices(effects: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Mean, mean absolute value and population deviation of the effects per input."""
    return effects.groupBy(*groups, "param_id", "param").agg(
        F.avg("ee").alias("mu"), F.avg(F.abs("ee")).alias("mu_star"), F.stddev_pop("ee").alias("sigma"))


def _with_maxima(indices: DataFrame) -> DataFrame:
    top = indices.agg(F.max("mu_star").alias("m"), F.max("sigma").alias("s"))
    return indices.withColumns({"_max_mu": top.select("m").scalar(), "_max_sigma": top.select("s").scalar()})


def screen(indices: DataFrame, threshold: float | None = None, top_n: int | None = None) -> DataFrame:
    """Influential inputs, strongest first: a threshold on mu* (10% of the largest) or the top n."""
    ranked = indices.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mu_star"), "param_id")))  # one row per input
    if top_n is not None:
        return ranked.where(F.col("rank") <= top_n)
    if threshold is not None:
        return ranked.where(F.col("mu_star") >= threshold)
    return _with_maxima(ranked).where(F.col("mu_star") >= SCREEN_FRACTION * F.col("_max_mu")).drop("_max_mu", "_max_sigma")


def classify(indices: DataFrame) -> DataFrame:
    """Negligible, linear or nonlinear by the normalised mu* and sigma."""
    df = _with_maxima(indices)
    mu = F.col("mu_star") / (F.col("_max_mu") + NORM_EPSILON)
    sigma = F.col("sigma") / (F.col("_max_sigma") + NORM_EPSILON)
    label = F.when(mu < NEGLIGIBLE_BELOW, "negligible").when(sigma < LINEAR_BELOW, "linear").otherwise("nonlinear")
    return df.withColumn("category", label).drop("_max_mu", "_max_sigma")


def parameter_config(screened: DataFrame, params: DataFrame, n_steps: int = 50) -> DataFrame:
    """Slider settings of the screened inputs: bounds, middle as default and a round step."""
    bounds = params.select(F.col("name").alias("param"), "lo", "hi")
    return screened.join(checked_broadcast(bounds), "param").withColumns({
        "default": (F.col("lo") + F.col("hi")) / 2.0,
        "step": F.when(F.col("hi") > F.col("lo"), slider_step(F.col("lo"), F.col("hi"), n_steps)).otherwise(0.0),
    })
