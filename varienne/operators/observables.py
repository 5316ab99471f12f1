"""Observable presets: which history columns to read and how to derive outputs from them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varienne.functions.numeric import short_name
from varienne.operators.ordered import with_group_stats

DRY_MASS = "listeners__mass__dry_mass"
CELL_MASS = "listeners__mass__cell_mass"
VOLUME = "listeners__mass__volume"
GROWTH_RATE = "listeners__mass__instantaneous_growth_rate"
DNA_MASS = "listeners__mass__dna_mass"
RNA_MASS = "listeners__mass__rna_mass"

CELL_DENSITY = 1100.0
SECONDS_PER_HOUR = 3600.0
MIN_GROWTH_RATE = 1e-6
EXCHANGE_MARK = "EX_"


@dataclass(frozen=True)
class Preset:
    """Named set of history columns; ``kind`` is scalar, derived or array."""

    columns: tuple[str, ...] = ()
    kind: str = "scalar"
    normalize_by_dry_mass: bool = False
    pattern: str | None = None

    def resolve(self, available: Sequence[str]) -> list[str]:
        if self.pattern:
            return sorted(c for c in available if fnmatchcase(c, self.pattern))
        return [c for c in self.columns if c in available]


# The presets and the history columns they read.
PRESETS: dict[str, Preset] = {
    "mass": Preset((DRY_MASS, CELL_MASS, VOLUME, "listeners__mass__growth", GROWTH_RATE)),
    "higher_order": Preset((DRY_MASS, CELL_MASS, VOLUME, DNA_MASS, RNA_MASS, GROWTH_RATE), kind="derived"),
    "exchange_fluxes": Preset(("listeners__fba_results__external_exchange_fluxes",), kind="array"),
    "transcriptome": Preset(("listeners__rna_counts__mRNA_cistron_counts",), kind="array"),
    "proteome": Preset(("listeners__monomer_counts",), kind="array"),
    "fluxome": Preset(("listeners__fba_results__base_reaction_fluxes",), kind="array", normalize_by_dry_mass=True),
    "reaction_fluxes": Preset(("listeners__fba_results__reaction_fluxes",), kind="array"),
}


def resolve_preset(df: DataFrame, name: str) -> list[str]:
    """Columns of a preset that exist in the frame; an unknown preset is an error."""
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}, expected one of {sorted(PRESETS)}")
    return PRESETS[name].resolve(df.columns)


def scalar_columns(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Existing scalar columns as doubles, null as 0."""
    return [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns if c in df.columns]


def _positive(column: str, missing: float) -> Column:
    c = F.coalesce(F.col(column).cast("double"), F.lit(missing))
    return F.when(c > 0, c).otherwise(1.0)


def _zeroed(column: str) -> Column:
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0))


def derive_properties(df: DataFrame, by: Sequence[str] = ("variant",)) -> DataFrame:
    """Per-row ratios, plus the doubling time of each variant from its mean growth rate.

    Only the doubling time needs a second look at the rows: the mean is combined
    map-side and joined back, so no row is shuffled for it while the variants are few.
    """
    have = set(df.columns)
    out = {}
    if GROWTH_RATE in have:
        df = df.withColumn("growth_rate_per_hour", _zeroed(GROWTH_RATE) * SECONDS_PER_HOUR)
        df = with_group_stats(df, by, [F.avg("growth_rate_per_hour").alias("_mean_rate")])
        out["doubling_time_hours"] = F.when(
            F.col("_mean_rate") > MIN_GROWTH_RATE, F.lit(math.log(2.0)) / F.col("_mean_rate")
        ).otherwise(float("nan"))
    if {DNA_MASS, DRY_MASS} <= have:
        out["dna_fraction_g_per_g_dw"] = _zeroed(DNA_MASS) / _positive(DRY_MASS, 1.0)
    if {RNA_MASS, DRY_MASS} <= have:
        out["rna_fraction_g_per_g_dw"] = _zeroed(RNA_MASS) / _positive(DRY_MASS, 1.0)
    if {DRY_MASS, CELL_MASS} <= have:
        out["dry_mass_fraction"] = _zeroed(DRY_MASS) / _positive(CELL_MASS, 1.0)
    if VOLUME in have:
        out["cell_volume_um3"] = _zeroed(VOLUME)
    return df.withColumns(out).drop("_mean_rate") if out else df


def normalize_by_mass(values: Column, mass: Column) -> Column:
    """Array divided by the dry mass of its row; a missing or zero mass divides by 1."""
    mass = F.coalesce(mass, F.lit(1.0))
    denom = F.when(mass == 0, 1.0).otherwise(mass)
    return F.transform(values, lambda x: x / denom)


def convert_fluxes(fluxes: Column, dry_mass: Column, cell_mass: Column, density: float = CELL_DENSITY) -> Column:
    """Array divided by dry/cell mass times density; a zero coefficient yields nulls."""
    factor = F.try_divide(dry_mass, cell_mass) * F.lit(float(density))
    return F.transform(fluxes, lambda x: F.try_divide(x, factor))


def explode_with_index(df: DataFrame, array: str, keep: Sequence[str], base: int = 1, value: str = "value", index: str = "idx") -> DataFrame:
    """One row per element with its index; null and empty arrays add no rows."""
    exploded = df.select(*keep, F.posexplode(array).alias("_pos", value))
    return exploded.select(*keep, (F.col("_pos") + base).alias(index), value)


def array_features(df: DataFrame, array: str, keep: Sequence[str]) -> DataFrame:
    """Long form named like columns: (output_id = tail_<i>, value), 0-based."""
    name = F.concat(short_name(F.lit(array)), F.lit("_"), F.col("idx").cast("string"))
    long = explode_with_index(df, array, keep, base=0)
    return long.select(*keep, name.alias("output_id"), F.col("value").cast("double").alias("value"))


def melt(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Scalar columns to long form (output_id, value)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("output_id"), _zeroed(c).alias("value")) for c in columns])
    return df.select(*keep, F.inline(pairs))


def preset_features(df: DataFrame, name: str, keep: Sequence[str]) -> DataFrame:
    """One preset in long form."""
    preset, columns = PRESETS[name], resolve_preset(df, name)
    if preset.kind == "derived":
        wide = derive_properties(df)
        return melt(wide, [c for c in wide.columns if c not in df.columns], keep)
    if preset.kind == "scalar":
        return melt(df, columns, keep)
    parts = []
    for c in columns:
        source = df
        if preset.normalize_by_dry_mass and DRY_MASS in df.columns:
            source = df.withColumn(c, normalize_by_mass(F.col(c), F.col(DRY_MASS)))
        parts.append(array_features(source, c, keep))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def concat_presets(df: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Features of several presets, with the preset's position as ``block``."""
    out = None
    for block, name in enumerate(names):
        part = preset_features(df, name, keep).withColumn("block", F.lit(block))
        out = part if out is None else out.unionByName(part)
    return out


def attach_feature_ids(features: DataFrame, field_ids: DataFrame, exchange_only: bool = False) -> DataFrame:
    """Name positions through a (idx, id) table, optionally keeping exchange features only.

    The id table has one row per array position; its size is left to the optimizer.
    """
    if exchange_only:
        field_ids = field_ids.where(F.col("id").contains(EXCHANGE_MARK))
    return features.join(field_ids, "idx")


def select_positions(values: Column, wanted: Column) -> Column:
    """Array form of the same selection: keep elements whose flag in a parallel array is true."""
    flagged = F.arrays_zip(values.alias("v"), wanted.alias("w"))
    return F.transform(F.filter(flagged, lambda e: e["w"]), lambda e: e["v"])


def search_outputs(names: DataFrame, query: str, column: str = "output_id") -> DataFrame:
    """Case-insensitive substring search."""
    return names.where(F.contains(F.lower(F.col(column)), F.lit(query.lower())))


def describe_outputs(field_ids: DataFrame) -> DataFrame:
    """Features per output field and how many of them are exchanges."""
    return field_ids.groupBy("field").agg(
        F.count(F.lit(1)).alias("n_features"),
        F.count_if(F.col("id").contains(EXCHANGE_MARK)).alias("n_exchange"),
    )
