"""Adaptive sampling and the screened surrogate, as sequences of Spark jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varienne.functions.basis import PolynomialBasis
from varienne.operators import design as dsg
from varienne.operators import fit, morris, replicates
from varienne.operators.design import Bounds
from varienne.session import materialize

Model = Callable[[DataFrame], DataFrame]


def training_error(fits: DataFrame, statistics: DataFrame) -> DataFrame:
    """Relative training error per output from the sums: sqrt(Σ(y-ŷ)²/Σy²)."""
    df = fits.select("output_id", "coef", "n").join(statistics.select("output_id", "rhs", "syy", "mean"), "output_id")
    # The centred sums of the constant are zero, so the mean in its coefficient does not matter.
    sse = F.greatest(F.col("syy") - fit.dot(F.col("coef"), F.col("rhs")), F.lit(0.0))
    yy = fit.raw_squares(F.col("syy"), F.col("mean"), F.col("n"))
    return df.select("output_id", "n", F.when(yy > 0, F.sqrt(sse / yy)).otherwise(0.0).alias("training_error"))


def merge_statistics(parts: Sequence[DataFrame]) -> DataFrame:
    """Add statistics of disjoint sample sets about their common mean; as many rows as sets and outputs."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    n = F.sum("n")
    means = out.groupBy("output_id").agg((F.sum(F.col("mean") * F.col("n")) / n).alias("common"))
    out = out.join(means, "output_id").withColumn("shift", F.col("mean") - F.col("common"))
    moved = F.transform("rhs", lambda r, t: r + F.col("shift") * F.get("gram", (t * (t + 1) / 2).cast("int")))
    out = out.withColumn("moved", moved)
    return out.groupBy("output_id").agg(
        n.alias("n"), fit.sum_vectors(F.col("gram")).alias("gram"), fit.sum_vectors(F.col("moved")).alias("rhs"),
        F.sum(F.col("syy") + F.col("n") * F.col("shift") * F.col("shift")).alias("syy"), F.first("common").alias("mean"))


def adaptive_sampling(
    spark: SparkSession, bounds: Bounds, model: Model, outputs: Sequence[str], budget: int, order: int, seed: int = 42,
    tolerance: float = 0.05, batch_fraction: float = 0.33,
) -> tuple[DataFrame, DataFrame]:
    """Fit, stop when the mean training error is small enough, else draw a quarter of the rest.

    Sums of earlier rounds are kept and only new samples are evaluated.  Returns the fits
    and the convergence table (round, n_samples, mean_error).
    """
    basis = PolynomialBasis(tuple(bounds), order)
    used, take = 0, max(order + 2, int(budget * batch_fraction))
    remaining = budget - take
    step = max(1, remaining // 4)
    statistics, history = None, []
    while True:
        ids = spark.range(used, used + take).withColumnRenamed("id", "sample_id")
        evaluated = model(dsg.sample_uniform(ids, bounds, seed))
        new = fit.wide_statistics(evaluated, basis, dsg.germ_columns(bounds), outputs)
        statistics = materialize(new if statistics is None else merge_statistics([statistics, new]), "statistics")
        used += take
        fits = materialize(fit.fit(statistics, []), "fits")
        error = training_error(fits, statistics).agg(F.avg("training_error")).first()[0]  # one number per round
        history.append((len(history), used, float(error)))
        if error <= tolerance or remaining <= 0:
            break
        take = min(step, remaining)
        remaining -= take
    return fits, spark.createDataFrame(history, "round int, n_samples bigint, mean_error double")


def sample_position(key: Sequence[str]) -> Column:
    """A place in [0, 1) per row from a hash of its key."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 40)) / F.lit(float(1 << 40))


def adaptive_fit(
    table: DataFrame, basis: PolynomialBasis, germ: Sequence[Column], outputs: Sequence[str], position: Column, tolerance: float,
    first_share: float = 1 / 256, growth: float = 2.0, error: str = "held_out_error",
) -> tuple[DataFrame, DataFrame]:
    """Fit a growing sample of a table until the error is small enough or the table is used up.

    Samples are nested: those with ``position`` (a place in [0, 1) that hashes the key) below a share that starts at
    ``first_share`` and grows by ``growth``.  Every round sums only the rows between two shares and adds them to the sums so far; before that the
    current fit is tried on them, so held_out_error costs nothing more.  Returns the fits and one row per round: round, share,
    n_samples, train_error and held_out_error (means of the relative errors over the outputs; none is held out in a last round that uses all rows).

    ``error`` names which of both must reach ``tolerance``.  The result of a round does not depend on how rows are dealt to tasks.
    """
    if error not in ("held_out_error", "train_error"):
        raise ValueError(f"unknown error {error!r}, expected 'held_out_error' or 'train_error'")
    table = table.withColumn("_position", position)
    schema = "round int, share double, n_samples bigint, train_error double, held_out_error double"
    sums, low, share, history = None, 0.0, min(first_share, 1.0), []

    def part(lo: float, hi: float) -> DataFrame:
        inside = F.col("_position") >= lo if hi >= 1 else (F.col("_position") >= lo) & (F.col("_position") < hi)
        return materialize(fit.wide_statistics(table.where(inside), basis, germ, outputs), "statistics")

    fresh = part(low, share)
    while True:
        sums = fresh if sums is None else materialize(merge_statistics([sums, fresh]), "statistics")
        fits = materialize(fit.fit(sums, []), "fits")
        train = training_error(fits, sums).agg(F.max("n").alias("n"), F.avg("training_error").alias("e")).first()
        low, share = share, min(share * growth, 1.0)
        held = None
        if low < 1:
            fresh = part(low, share)
            tried = fits.select("output_id", "coef").join(fresh, "output_id").select(
                fit.squared_error("coef", "gram", "rhs", "syy", "mean").alias("sse"), fit.raw_squares(F.col("syy"), F.col("mean"), F.col("n")).alias("yy"))
            held = tried.agg(F.avg(F.sqrt("sse") / F.when(F.col("yy") > 0, F.sqrt("yy")).otherwise(1.0))).first()[0]
        history.append((len(history), low, train.n, train.e, held))
        reached = train.e if error == "train_error" else held
        if low >= 1 or (reached is not None and reached <= tolerance):
            return fits, table.sparkSession.createDataFrame(history, schema)


@dataclass
class ScreenedSurrogate:
    screening: DataFrame
    kept: list[str]
    basis: PolynomialBasis
    fits: DataFrame


def screened_surrogate(
    trajectories: DataFrame, samples: DataFrame, bounds: Bounds, model: Callable[[Sequence[str]], Column], keep: int, order: int,
    seed: int = 42, levels: int = 4, n_replicates: int = 5, noise: Callable[[Column, Column], Column] | None = None,
) -> ScreenedSurrogate:
    """Screen inputs, draw a Latin hypercube over the strongest, take replicate medians and fit.

    ``trajectories`` and ``samples`` are id tables whose size sets the effort.  Inputs that
    are dropped stay at the middle of their range.  The model is a column expression of the
    inputs; ``noise(sample, replicate)`` adds to it.
    """
    names = list(bounds)
    walked = dsg.morris_design(trajectories, bounds, seed, levels).withColumn("y", model(names))
    indices = materialize(morris.morris_indices(morris.elementary_effects(walked, bounds, "y")), "screening")
    kept = [r.param for r in morris.screen(indices, top_n=keep).orderBy("rank").collect()]  # input names
    inner = {n: bounds[n] for n in names if n in kept}
    wide = dsg.widen(dsg.sample_lhs(samples, inner, seed), "sample_id", list(inner))
    wide = wide.withColumns({n: F.lit((lo + hi) / 2.0) for n, (lo, hi) in bounds.items() if n not in inner})
    wide = materialize(wide, "samples")
    runs = wide.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n_replicates - 1))))
    value = model(names) if noise is None else model(names) + noise(F.col("sample_id"), F.col("replicate"))
    y = replicates.replicate_median(runs.withColumn("_y", value), ["sample_id"], "_y")
    basis = PolynomialBasis(tuple(inner), order)
    statistics = fit.wide_statistics(wide.join(y, "sample_id"), basis, dsg.germ_columns(inner), ["y"])
    return ScreenedSurrogate(indices, kept, basis, fit.fit(statistics, []))
