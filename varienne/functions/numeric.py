"""Numeric guards, growth-stage bins and names as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix -> (unit, display label) for well-known observables.
OBSERVABLE_UNITS = {
    "dry_mass": ("fg", "Dry mass"),
    "cell_mass": ("fg", "Cell mass"),
    "volume": ("fL", "Volume"),
    "growth": ("fg/s", "Growth"),
    "instantaneous_growth_rate": ("1/s", "Growth rate"),
}

# Upper limit of stage/n and the label of the stage.
STAGE_LABELS = (
    (0.2, "Early growth (recently divided, small cell)"),
    (0.4, "Early-mid growth (active biosynthesis ramp-up)"),
    (0.6, "Mid growth (steady-state biosynthesis)"),
    (0.8, "Late-mid growth (approaching critical mass for division)"),
    (None, "Late growth (pre-division, maximal cell size)"),
)


def nan_to_null(c: Column) -> Column:
    """NaN counts as missing: averages skip it instead of becoming NaN."""
    return F.when(~F.isnan(c), c)


def finite_or(c: Column, default: float = 0.0) -> Column:
    """Replace null and NaN by a default."""
    return F.coalesce(nan_to_null(c), F.lit(default))


def guarded_divide(num: Column, den: Column, when_zero: Column | float = 0.0) -> Column:
    """num/den, or a default where den is zero (never an ANSI error)."""
    other = when_zero if isinstance(when_zero, Column) else F.lit(float(when_zero))
    return F.when(den != 0, num / den).otherwise(other)


def ieee_divide(num: Column, den: Column) -> Column:
    """num/den as IEEE 754 has it: infinity with the sign of num, or NaN for 0/0, where den is zero (never an ANSI error)."""
    by_zero = F.when(F.isnan(num) | (num == 0), float("nan")).when(num > 0, float("inf")).when(num < 0, float("-inf"))
    return F.when(den == 0, by_zero).otherwise(num / den)


def ieee_log(c: Column) -> Column:
    """Natural logarithm as IEEE 754 has it: -infinity at 0 and NaN below, where Spark has null."""
    return F.when(c == 0, float("-inf")).when(c < 0, float("nan")).otherwise(F.log(c))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def add_all(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols, F.lit(0.0))


def stage_bin(theta: Column, n_bins: int) -> Column:
    """Stage in 0..n-1: left-closed bins between the edges i·(1/n), θ=1 in the last bin.

    floor(θ·n) can be one off where θ sits exactly on an edge, so the candidate is
    corrected against the two neighbouring edges; all of it stays in codegen.
    """
    step = 1.0 / n_bins
    guess = F.floor(theta * F.lit(float(n_bins)))
    up = F.when(theta >= (guess + 1) * F.lit(step), 1).otherwise(0)
    down = F.when(theta < guess * F.lit(step), 1).otherwise(0)
    return F.least(F.greatest(guess + up - down, F.lit(0)), F.lit(n_bins - 1)).cast("int")


def stage_bin_raw(value: Column, n_bins: int, lo: Column | float = 0.0, hi: Column | float = 1.0) -> Column:
    """Unclipped bin over lo..hi: -1 below, n at or above hi."""
    lo, hi = (b if isinstance(b, Column) else F.lit(float(b)) for b in (lo, hi))
    return (F.width_bucket(value, lo, hi, F.lit(n_bins)) - 1).cast("int")


def stage_label(stage: Column, n_bins: int) -> Column:
    """Text label of a growth stage."""
    fraction = stage / F.lit(n_bins)
    column = F
    for limit, label in STAGE_LABELS[:-1]:
        column = column.when(fraction < limit, label)
    return column.otherwise(STAGE_LABELS[-1][1])


def stage_range(stage: Column, n_bins: int) -> tuple[Column, Column]:
    """θ limits of a stage, rounded for export."""
    return F.round(stage / F.lit(n_bins), 3), F.round((stage + 1) / F.lit(n_bins), 3)


def hive_name(path: Column) -> Column:
    """Dotted observable path to its history column name."""
    return F.replace(path, F.lit("."), F.lit("__"))


def short_name(column: Column) -> Column:
    """The part of a history column name after the last double underscore."""
    return F.element_at(F.split(column, "__"), -1)


def slider_step(lo: Column, hi: Column, n_steps: int = 50) -> Column:
    """(hi-lo)/n rounded to 1, 2, 5 or 10 times a power of ten."""
    step = (hi - lo) / F.lit(float(n_steps))
    magnitude = F.pow(F.lit(10.0), F.floor(F.log10(step)))
    scaled = step / magnitude
    nice = F.when(scaled < 1.5, 1.0).when(scaled < 3.5, 2.0).when(scaled < 7.5, 5.0).otherwise(10.0)
    return nice * magnitude
