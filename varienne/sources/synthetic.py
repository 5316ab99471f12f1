"""Deterministic histories for tests and dry runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varienne.functions import rng


def history_index(spark: SparkSession, experiments: int, seeds: int, generations: int, timepoints: int) -> DataFrame:
    """Id columns of a full factorial history, one row per time point."""
    n = experiments * seeds * generations * timepoints
    r = F.col("id")
    step = (r % timepoints).cast("int")
    gen = F.floor(r / timepoints) % generations
    seed = F.floor(r / (timepoints * generations)) % seeds
    exp = F.floor(r / (timepoints * generations * seeds))
    return spark.range(n).select(
        exp.cast("int").alias("experiment_id"),
        F.concat(F.lit("vio_"), exp, F.lit("_mec_"), exp).alias("variant"),
        (seed * 1000).cast("int").alias("lineage_seed"),
        gen.cast("int").alias("generation"),
        F.concat_ws("_", F.lit("agent"), seed, gen, step).alias("agent_id"),
        ((seed * generations + gen) * timepoints + step).cast("double").alias("time"),
        step.alias("step"),
        F.lit(timepoints).alias("n_steps"),
        F.concat_ws("/", exp, seed, gen, step).alias("row_key"),
    )


def synthesize(index: DataFrame, seed: int = 42, n_counts: int = 10, n_fluxes: int = 5, as_json: bool = True) -> DataFrame:
    """Attach observables to an index with (row_key, step, n_steps).

    Exponential mass, a DNA ramp, sinusoidal growth, Poisson counts and exponential
    fluxes; every draw is a function of (seed, row_key), so the result does not
    depend on how the index is partitioned.
    """
    t = F.col("step") / F.col("n_steps")
    dry = F.pow(F.lit(2.0), t) * (1.0 + 0.05 * rng.normal(seed, "row_key"))
    ramp = F.when(t <= 0.3, 0.03).when(t >= 0.7, 0.06).otherwise(0.03 + 0.03 * (t - 0.3) / 0.4)

    def block(n: int, tag: str, draw) -> Column:
        # Drawn first, so that a draw is not digested again for every entry that it is compared with.
        values = F.transform(F.array(*[rng.uniform(seed, F.lit(tag), F.lit(i), "row_key") for i in range(n)]), draw)
        return F.to_json(values) if as_json else values

    return (
        index.withColumn("listeners__mass__dry_mass", dry)
        .withColumns({
            "listeners__mass__cell_mass": 1.3 * F.col("listeners__mass__dry_mass"),
            "listeners__mass__dna_mass": ramp,
            "listeners__mass__protein_mass": 0.5 * F.col("listeners__mass__dry_mass"),
            "listeners__fba_results__growth": 0.01 * (1.0 + 0.2 * F.sin(2.0 * math.pi * t)),
            "listeners__rna_counts__mRNA_cistron_counts": block(n_counts, "count", lambda u: rng.poisson(5.0, u)),
            "listeners__fba_results__base_reaction_fluxes": block(n_fluxes, "flux", lambda u: rng.exponential(1.0, u)),
        })
        .drop("step", "n_steps", "row_key")
    )


def synthetic_history(spark: SparkSession, experiments: int = 5, seeds: int = 4, generations: int = 8, timepoints: int = 20, seed: int = 42) -> DataFrame:
    return synthesize(history_index(spark, experiments, seeds, generations, timepoints), seed)
