"""Comparison of sensitivity tables across conditions, strategies and runs.

Inputs are index tables (condition, param, st), a few rows per condition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DRIVER_THRESHOLD = 0.1
LOW_FACTOR = 0.5
DOMINANT_ABOVE = 50.0
LEADING_ABOVE = 20.0


def union_conditions(results: dict[str, DataFrame | None], key: str = "condition") -> DataFrame:
    """Stack per-condition results; a missing one is skipped, none at all is an error."""
    parts = [df.withColumn(key, F.lit(name)) for name, df in results.items() if df is not None]
    if not parts:
        raise ValueError("no condition has results")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def param_ranks(st: DataFrame, condition: str = "condition") -> DataFrame:
    """1-based rank by total index inside each condition, ties by name."""
    return st.withColumn("rank", F.row_number().over(Window.partitionBy(condition).orderBy(F.desc("st"), "param")))


def rank_stability(st: DataFrame, condition: str = "condition") -> DataFrame:
    """1 - deviation of the ranks over its largest value, clipped to 0..1."""
    ranked = param_ranks(st, condition)
    sizes = ranked.agg(F.count_distinct("param").alias("d"), F.count_distinct(condition).alias("c"))
    d, c = sizes.select("d").scalar(), sizes.select("c").scalar()
    out = ranked.groupBy("param").agg(F.stddev_pop("rank").alias("_sd")).withColumns({"_d": d, "_c": c})
    worst = (F.col("_d") - 1) / 2.0
    value = F.when((F.col("_c") > 1) & (F.col("_d") > 1), 1.0 - F.col("_sd") / F.when(worst > 0, worst).otherwise(1.0)).otherwise(1.0)
    return out.select("param", F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)).alias("stability"))


def universal_drivers(st: DataFrame, threshold: float = DRIVER_THRESHOLD, condition: str = "condition") -> DataFrame:
    """Inputs at or above the threshold in every condition."""
    total = st.agg(F.count_distinct(condition).alias("n")).select("n").scalar()
    by_param = st.groupBy("param").agg(F.min("st").alias("min_st"), F.count_distinct(condition).alias("_n"))
    return by_param.where((F.col("min_st") >= threshold) & (F.col("_n") == total)).drop("_n")


def condition_specific(st: DataFrame, threshold: float = DRIVER_THRESHOLD, low_factor: float = LOW_FACTOR, condition: str = "condition") -> DataFrame:
    """Inputs that matter in a condition and are low in at least one other.

    The smallest index over the other conditions follows from the two smallest per input,
    so no pairs of conditions are formed.
    """
    entry = F.struct("st", condition)
    lowest = st.groupBy("param").agg(F.min(entry).alias("_low"))
    high = st.where(F.col("st") >= threshold).join(lowest, "param")
    # A row at or above the threshold cannot itself be below the low threshold.
    return high.where(F.col("_low.st") < threshold * low_factor).select(condition, "param", "st")


def exists_lower(st: DataFrame, high: float, low: float, condition: str = "condition") -> DataFrame:
    """Rows at or above one limit whose input lies below another limit in some other condition."""
    other = st.where(F.col("st") < low).select("param", F.col(condition).alias("_other"))
    match = (F.col("h.param") == F.col("l.param")) & (F.col(f"h.{condition}") != F.col("l._other"))
    return st.where(F.col("st") >= high).alias("h").join(other.alias("l"), match, "left_semi")


def differential_sobol(st: DataFrame, condition: str = "condition") -> DataFrame:
    """Difference of total indices for every ordered pair of conditions per input.

    The result has one row per pair by definition; both sides are index tables joined on
    the input.
    """
    a = st.select("param", F.col(condition).alias("condition_a"), F.col("st").alias("_a"))
    b = st.select("param", F.col(condition).alias("condition_b"), F.col("st").alias("_b"))
    pairs = a.join(b, "param").where(F.col("condition_a") < F.col("condition_b"))
    return pairs.select(
        F.concat_ws("_vs_", "condition_a", "condition_b").alias("pair"), "param", (F.col("_a") - F.col("_b")).alias("difference"))


def compare_runs(st: DataFrame, runs: Sequence[str], run: str = "run") -> DataFrame:
    """Total indices of runs side by side, missing as 0, for the inputs of the first run."""
    cols = [F.coalesce(F.max(F.when(F.col(run) == r, F.col("st"))), F.lit(0.0)).alias(r) for r in runs]
    known = F.max(F.when(F.col(run) == runs[0], F.lit(True)))
    out = st.groupBy("param").agg(*cols, known.alias("_known")).where("_known").drop("_known")
    if len(runs) == 2:
        out = out.withColumn("delta", F.col(runs[1]) - F.col(runs[0]))
    return out


def key_findings(st: DataFrame, stages: DataFrame | None = None, n_stages: int = 0) -> DataFrame:
    """One row: strongest and weakest input, peak stage and the recommendation."""
    first = F.struct("st", F.negate("param_id"))
    out = st.agg(
        F.max_by("param", first).alias("top_param"), (F.max("st") * 100.0).alias("top_percent"),
        F.min_by("param", F.struct("st", "param_id")).alias("bottom_param"), (F.min("st") * 100.0).alias("bottom_percent"),
    )
    advice = (
        F.when(F.col("top_percent") > DOMINANT_ABOVE, F.concat(F.lit("measure "), "top_param", F.lit(" first: more than half of the spread comes from it")))
        .when(F.col("top_percent") > LEADING_ABOVE, F.concat("top_param", F.lit(" matters most, but the others together matter more")))
        .otherwise("the spread is shared by many inputs")
    )
    out = out.withColumn("recommendation", advice)
    if stages is not None:
        peak = stages.select("stage").scalar()
        out = out.withColumns({
            "peak_stage": peak, "peak_from_percent": F.floor(peak * 100 / n_stages), "peak_to_percent": F.floor((peak + 1) * 100 / n_stages)})
    return out
