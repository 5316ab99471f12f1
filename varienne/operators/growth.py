"""Growth fraction θ in its variants, and the registry for custom ones."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varienne.functions.numeric import clip, ieee_log
from varienne.operators.ordered import even_spacing, group_stats, with_group_stats

MASS_FLOOR_FIRST_LAST = 1e-10
MASS_FLOOR_MIN_MAX = 1e-30
MIN_LOG_SPAN = 1e-15
CUSTOM_EPSILON = 1e-10

# Limits of the replication phases on the DNA fraction.
PHASE_B_BELOW = 0.2
PHASE_D_ABOVE = 0.8

_REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register_theta(name: str):
    """Register a function (df, **options) -> df with a ``theta`` column under a name."""

    def add(function):
        _REGISTRY[name] = function
        return function

    return add


def theta(name: str, df: DataFrame, **options) -> DataFrame:
    if name not in _REGISTRY:
        raise ValueError(f"unknown cell-cycle variable {name!r}, expected one of {sorted(_REGISTRY)}")
    return _REGISTRY[name](df, **options)


def registered_thetas() -> list[str]:
    return sorted(_REGISTRY)


def _scaled_or_spaced(df, keys, stats, lo, hi, value, usable, order, prefix, ties):
    """θ from the group statistics, evenly spaced in the groups that have no span.

    The usual rows only meet a broadcast join; just the rows of degenerate groups,
    if there are any, are sorted.
    """
    joined = df.join(stats, list(keys))
    scaled = joined.where(usable).withColumn("theta", clip((value - lo) / (hi - lo), 0.0, 1.0)).select(*df.columns, "theta")
    if stats.where(~usable).isEmpty():
        return scaled
    rest = joined.where(~usable).select(*df.columns)
    return scaled.unionByName(even_spacing(rest, keys, order, prefix=prefix, ties=ties))


@register_theta("first_last")
def theta_first_last(
    df: DataFrame, mass: str, keys: Sequence[str], order: str = "time", prefix: Sequence[str] = (), ties: Sequence[str] = (),
) -> DataFrame:
    """θ between the first and last log mass of a sample in history order."""
    m = F.log(F.greatest(F.col(mass), F.lit(MASS_FLOOR_FIRST_LAST)))
    position = F.struct(*prefix, order, *ties)
    stats = group_stats(df, keys, [F.min_by(m, position).alias("_lo"), F.max_by(m, position).alias("_hi")])
    lo, hi = F.col("_lo"), F.col("_hi")
    return _scaled_or_spaced(df, keys, stats, lo, hi, m, hi > lo, order, prefix, ties)


@register_theta("min_max")
def theta_min_max(
    df: DataFrame, mass: str, keys: Sequence[str], order: str = "time", prefix: Sequence[str] = (), ties: Sequence[str] = (),
) -> DataFrame:
    """θ between the smallest and largest log mass of a sample."""
    m = F.log(F.greatest(F.col(mass), F.lit(MASS_FLOOR_MIN_MAX)))
    stats = group_stats(df, keys, [F.min(m).alias("_lo"), F.max(m).alias("_hi"), F.max(mass).alias("_top")])
    lo, hi = F.col("_lo"), F.col("_hi")
    usable = (F.col("_top") > 0) & (hi - lo >= MIN_LOG_SPAN)
    return _scaled_or_spaced(df, keys, stats, lo, hi, m, usable, order, prefix, ties)


@register_theta("per_cell")
def theta_per_cell(
    df: DataFrame, mass: str, keys: Sequence[str] = ("variant", "lineage_seed", "generation", "agent_id"), order: str = "time",
    ties: Sequence[str] = (), floor: float | None = MASS_FLOOR_FIRST_LAST,
) -> DataFrame:
    """θ between birth and division mass of each cell; a cell that does not grow divides by 1.

    Masses below the floor count as the floor.  Without one, logarithms are those of IEEE 754: a cell born with mass 0
    starts at -infinity, and all its rows have θ = 1.
    """
    m = ieee_log(F.col(mass)) if floor is None else F.log(F.greatest(F.col(mass), F.lit(floor)))
    position = F.struct(order, *ties)
    stats = group_stats(df, keys, [F.min_by(m, position).alias("_lo"), F.max_by(m, position).alias("_hi")])
    span = F.col("_hi") - F.col("_lo")
    value = (m - F.col("_lo")) / F.when(span > 0, span).otherwise(1.0)
    return df.join(stats, list(keys)).withColumn("theta", clip(value, 0.0, 1.0)).drop("_lo", "_hi")


@register_theta("dna")
def theta_dna(df: DataFrame, dna: str, keys: Sequence[str]) -> DataFrame:
    """DNA mass scaled to 0..1 inside each cell, with the replication phase."""
    stats = group_stats(df, keys, [F.min(dna).alias("_lo"), F.max(dna).alias("_hi")])
    span = F.col("_hi") - F.col("_lo")
    value = F.when(span > 0, (F.col(dna) - F.col("_lo")) / span).otherwise(0.0)
    return df.join(stats, list(keys)).withColumn("theta", value).withColumn("phase", phase_label(F.col("theta"))).drop("_lo", "_hi")


def phase_label(theta_col: Column) -> Column:
    return F.when(theta_col < PHASE_B_BELOW, "B").when(theta_col <= PHASE_D_ABOVE, "C").when(theta_col > PHASE_D_ABOVE, "D").otherwise("unknown")


@register_theta("angle")
def theta_angle(df: DataFrame, mass: str, rate: str, keys: Sequence[str]) -> DataFrame:
    """Angle in the (log mass, growth rate) plane, both centred and scaled per cell, mapped to 0..1."""
    m = F.log(F.greatest(F.col(mass), F.lit(MASS_FLOOR_FIRST_LAST)))
    g = F.col(rate)
    stats = group_stats(df, keys, [
        F.avg(m).alias("_ma"), F.stddev_pop(m).alias("_ms"), F.avg(g).alias("_ga"), F.stddev_pop(g).alias("_gs"),
    ])
    z = lambda v, a, s: F.when(F.col(s) > 0, (v - F.col(a)) / F.col(s)).otherwise(0.0)
    angle = F.atan2(z(g, "_ga", "_gs"), z(m, "_ma", "_ms"))
    value = clip((angle + math.pi) / (2 * math.pi), 0.0, 1.0)
    return df.join(stats, list(keys)).withColumn("theta", value).drop("_ma", "_ms", "_ga", "_gs")


@register_theta("custom")
def theta_custom(
    df: DataFrame, expression: Column | str | None = None, function: Callable[[pd.DataFrame], pd.Series] | None = None,
    inputs: Sequence[str] = (), keys: Sequence[str] | None = None,
) -> DataFrame:
    """θ from a column expression, or from a pandas function of the named inputs.

    The function sees Arrow batches of rows, never a whole cell.  What it needs to know
    about the cell is computed by Spark: with ``keys`` the raw value is scaled to 0..1
    between its smallest and largest value per key group.
    """
    if expression is not None:
        raw = df.withColumn("theta", (F.expr(expression) if isinstance(expression, str) else expression).cast("double"))
    elif function is not None:
        schema = T.StructType([*df.schema.fields, T.StructField("theta", T.DoubleType())])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                values = function(batch[list(inputs)] if inputs else batch)
                yield batch.assign(theta=pd.Series(values, dtype="float64").to_numpy())

        raw = df.mapInPandas(run, schema)
    else:
        raise ValueError("theta_custom needs an expression or a function")
    if keys is None:
        return raw
    joined = with_group_stats(raw, keys, [F.min("theta").alias("_lo"), F.max("theta").alias("_hi")])
    return joined.withColumn("theta", (F.col("theta") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + CUSTOM_EPSILON)).drop("_lo", "_hi")
