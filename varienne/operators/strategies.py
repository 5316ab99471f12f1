"""Per-sample outputs under the four grouping strategies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varienne.functions.numeric import stage_bin
from varienne.operators.fit import sum_vectors
from varienne.operators.observables import DRY_MASS, PRESETS, derive_properties, normalize_by_mass, resolve_preset
from varienne.session import checked_broadcast, materialize
from varienne.sources.history import bounds_filter

BASELINE_VARIANT = 0


def assign_samples(history: DataFrame, n_samples: int, fallback: str = "baseline") -> DataFrame:
    """Rows of sample i: variant i+1, else variant i, else the baseline variant 0.

    The choice is made on the distinct variants, then joined back once; with
    ``fallback='none'`` samples without their own variant are dropped.
    """
    variants = history.select(F.col("variant").cast("int").alias("v")).distinct()
    samples = history.sparkSession.range(n_samples).select(F.col("id").cast("int").alias("sample_id"))
    own = variants.select(F.col("v").alias("own"))
    near = variants.select(F.col("v").alias("near"))
    base = variants.where(F.col("v") == BASELINE_VARIANT).select(F.col("v").alias("base"))
    choice = samples.join(own, F.col("own") == F.col("sample_id") + 1, "left")
    if fallback == "baseline":
        choice = choice.join(near, F.col("near") == F.col("sample_id"), "left")
        choice = choice.join(base, F.col("base") == F.lit(BASELINE_VARIANT), "left")
        pick = F.coalesce("own", "near", "base")
    elif fallback == "none":
        pick = F.col("own")
    else:
        raise ValueError(f"unknown fallback {fallback!r}, expected 'baseline' or 'none'")
    choice = choice.select("sample_id", pick.alias("variant")).where(F.col("variant").isNotNull())
    # One row per sample.
    return history.withColumn("variant", F.col("variant").cast("int")).join(checked_broadcast(choice), "variant")


def fine_sums(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Sum per column and row count at the finest grain any strategy needs.

    Means of every coarser group follow from these, so the history is aggregated once.
    """
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in columns],
    )


def rollup_means(fine: DataFrame, columns: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Long means (groups..., output_id, y) from fine sums."""
    sums = fine.groupBy(*groups).agg(F.sum("n").alias("_n"), *[F.sum(c).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("output_id"), (F.col(c) / F.col("_n")).alias("y")) for c in columns])
    return sums.select(*groups, F.inline(pairs))


def sample_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Strategy 1: mean of every output over all rows of a sample."""
    return rollup_means(fine_sums(df, columns, ["sample_id"]), columns, ["sample_id"])


def common_groups(grouped: DataFrame, key: str) -> DataFrame:
    """Group values present in every sample, from a table with one row per (sample, group)."""
    pairs = grouped.select("sample_id", key).distinct()
    total = pairs.agg(F.count_distinct("sample_id").alias("_total"))
    seen = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("_seen"))
    return seen.join(F.broadcast(total), F.col("_seen") == F.col("_total")).select(key)


def group_means(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Strategies 2 and 3: mean per (sample, group) for groups found in every sample.

    A missing label column yields no rows.
    """
    if key not in df.columns:
        return df.sparkSession.createDataFrame([], "sample_id int, group_value bigint, output_id string, y double")
    fine = fine_sums(df, columns, ["sample_id", key])
    means = rollup_means(fine, columns, ["sample_id", key])
    return (
        means.join(common_groups(fine, key), key, "left_semi")
        .select("sample_id", F.col(key).cast("bigint").alias("group_value"), "output_id", "y")
    )


def densify_stages(means: DataFrame, columns: Sequence[str], n_bins: int, empty: str = "zero") -> DataFrame:
    """Give every sample every stage; a missing one is 0, or drops the sample's stage when 'null'.

    The stage and output lists are literals, so this is one explode per sample row and a
    join on (sample, stage, output), never a cross join of data.
    """
    if empty == "null":
        return means
    outputs = F.array(*[F.lit(c) for c in columns])
    grid = (
        means.select("sample_id").distinct()
        .select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("stage"))
        .select("sample_id", "stage", F.explode(outputs).alias("output_id"))
    )
    return grid.join(means, ["sample_id", "stage", "output_id"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))


def stage_means(df: DataFrame, columns: Sequence[str], n_bins: int, empty: str = "zero") -> DataFrame:
    """Strategy 4: mean per (sample, growth stage) from rows that carry ``theta``."""
    staged = df.withColumn("stage", stage_bin(F.col("theta"), n_bins))
    means = rollup_means(fine_sums(staged, columns, ["sample_id", "stage"]), columns, ["sample_id", "stage"])
    return densify_stages(means, columns, n_bins, empty)


STRATEGY_KEYS = {"uniform": None, "by_generation": "generation", "by_lineage_seed": "lineage_seed", "growth_stage": "stage"}


def _grouping_means(fine: DataFrame, total, mean) -> DataFrame:
    """Means of every (strategy, group, sample) from fine sums, in one shuffle, written out.

    ``total`` adds the sums up and ``mean`` divides them by the rows, both as lists of columns.
    """
    keys = [k for k in STRATEGY_KEYS.values() if k]
    sets = [["sample_id"] if k is None else ["sample_id", k] for k in STRATEGY_KEYS.values()]
    sums = fine.groupingSets(sets, "sample_id", *keys).agg(*[F.grouping(k).alias(f"_no_{k}") for k in keys], F.sum("n").alias("_n"), *total)
    strategy, group = F, F.lit(0).cast("bigint")
    for name, k in STRATEGY_KEYS.items():
        if k:
            strategy = strategy.when(F.col(f"_no_{k}") == 0, name)
            group = F.when(F.col(f"_no_{k}") == 0, F.col(k).cast("bigint")).otherwise(group)
    return materialize(sums.select(strategy.otherwise("uniform").alias("strategy"), group.alias("group_value"), "sample_id", *mean), "means")


def _complete(means: DataFrame, zeros: dict, n_bins: int, empty: str) -> DataFrame:
    """Keep groups that every sample has, and give every sample every stage."""
    samples = means.where("strategy = 'uniform'")
    total = samples.agg(F.count(F.lit(1)).alias("t")).select("t").scalar()
    shared = ["by_generation", "by_lineage_seed"]
    seen = means.where(F.col("strategy").isin(shared)).groupBy("strategy", "group_value").agg(F.count(F.lit(1)).alias("_seen"))
    common = means.join(seen.where(F.col("_seen") == total).select("strategy", "group_value"), ["strategy", "group_value"], "left_semi")

    stages = means.where("strategy = 'growth_stage'")
    if empty == "zero":
        grid = samples.select(
            F.lit("growth_stage").alias("strategy"), "sample_id",
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_bins - 1).cast("bigint"))).alias("group_value"))
        stages = grid.join(stages, ["strategy", "group_value", "sample_id"], "left").withColumns({c: F.coalesce(c, z) for c, z in zeros.items()})
    return samples.unionByName(common).unionByName(stages)


def strategy_outputs(df: DataFrame, columns: Sequence[str], n_bins: int, empty: str = "zero") -> DataFrame:
    """Outputs of all four strategies as one long table.

    (strategy, group_value, sample_id, output_id, y) from rows with sample_id, generation,
    lineage_seed and theta.  The history is read once and summed to the finest grain; the
    four views are grouping sets over those sums, in one shuffle.  The means, one row per
    (strategy, group, sample), are written out so that nothing later leads back to the history.
    """
    staged = df.withColumn("stage", stage_bin(F.col("theta"), n_bins))
    fine = fine_sums(staged, columns, ["sample_id", *[k for k in STRATEGY_KEYS.values() if k]])
    means = _grouping_means(fine, [F.sum(c).alias(c) for c in columns], [(F.col(c) / F.col("_n")).alias(c) for c in columns])
    wide = _complete(means, {c: F.lit(0.0) for c in columns}, n_bins, empty)
    pairs = F.array(*[F.struct(F.lit(c).alias("output_id"), F.col(c).alias("y")) for c in columns])
    return wide.select("strategy", "group_value", "sample_id", F.inline(pairs))


def strategy_vectors(df: DataFrame, arrays: Sequence[str], n_bins: int, empty: str = "zero") -> DataFrame:
    """The same outputs for every position of array columns, named tail_<position> (0-based).

    All arrays of a row form one vector, and whole vectors are summed map-side, so elements become rows
    only after the aggregation.  Rows may differ in length: the longest sets the width, and a
    missing or null element counts as 0, like a null scalar.  Two columns with one tail name share
    outputs and are refused.
    """
    tails = [a.split("__")[-1] for a in arrays]
    if len(set(tails)) < len(tails):
        raise ValueError(f"array columns share a name: {tails}")
    found = df.agg(*[F.coalesce(F.max(F.greatest(F.size(F.col(a)), F.lit(0))), F.lit(0)).alias(f"w{i}") for i, a in enumerate(arrays)]).first()
    widths = list(found)
    zero = lambda n: F.array_repeat(F.lit(0.0), n)

    def padded(a: str, width: int):
        values = F.transform(F.coalesce(F.col(a).cast("array<double>"), zero(F.lit(0))), lambda v: F.coalesce(v, F.lit(0.0)))
        return F.concat(values, zero(F.greatest(F.lit(width) - F.size(values), F.lit(0))))

    keys = [k for k in STRATEGY_KEYS.values() if k]
    rows = df.withColumn("stage", stage_bin(F.col("theta"), n_bins)).select("sample_id", *keys, F.concat(*[padded(a, w) for a, w in zip(arrays, widths)]).alias("v"))
    fine = rows.groupBy("sample_id", *keys).agg(F.count(F.lit(1)).alias("n"), sum_vectors(F.col("v")).alias("v"))
    means = _grouping_means(fine, [sum_vectors(F.col("v")).alias("v")], [F.transform("v", lambda x: x / F.col("_n")).alias("v")])
    wide = _complete(means, {"v": zero(F.lit(sum(widths)))}, n_bins, empty)
    long = wide.select("strategy", "group_value", "sample_id", F.posexplode("v").alias("_p", "y"))
    name, start = F, 0
    for t, w in zip(tails, widths):
        name, start = name.when(F.col("_p") < start + w, F.concat(F.lit(f"{t}_"), (F.col("_p") - start).cast("string"))), start + w
    return long.select("strategy", "group_value", "sample_id", name.alias("output_id"), "y")


def collect_outputs(history: DataFrame, presets: Sequence[str], n_bins: int, n_samples: int | None = None, generation_lower_bound: int | None = None,
                    time_lower_bound: float | None = None, empty: str = "zero") -> DataFrame:
    """Outputs of several presets under all four strategies, from rows that carry ``theta``.

    Early rows may be dropped and rows dealt to samples first.  Scalar and derived presets go through
    ``strategy_outputs``, arrays (normalised by dry mass where the preset says so) through ``strategy_vectors``.
    """
    rows = bounds_filter(history, generation_lower_bound, time_lower_bound)
    rows = rows if n_samples is None else assign_samples(rows, n_samples)
    scalars, arrays = [], []
    for name in presets:
        preset, columns = PRESETS[name], resolve_preset(rows, name)
        if preset.kind == "derived":
            known = set(rows.columns)
            rows = derive_properties(rows)
            columns = [c for c in rows.columns if c not in known]
        elif preset.kind != "scalar":
            if preset.normalize_by_dry_mass and DRY_MASS in rows.columns:
                rows = rows.withColumns({c: normalize_by_mass(F.col(c), F.col(DRY_MASS)) for c in columns})
            arrays += [c for c in columns if c not in arrays]
            continue
        scalars += [c for c in columns if c not in scalars]
    parts = [strategy_outputs(rows, scalars, n_bins, empty)] if scalars else []
    parts += [strategy_vectors(rows, arrays, n_bins, empty)] if arrays else []
    if not parts:
        raise ValueError(f"no column of {list(presets)} in the history")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def train_test(train: DataFrame, test: DataFrame) -> DataFrame:
    """Stack training and held-out designs with a ``split`` column."""
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
