"""Variance-based sensitivity from fitted coefficients, and its report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varienne.functions.basis import PolynomialBasis
from varienne.functions.numeric import guarded_divide

MIN_INPUT_SPREAD = 1e-10


def _term_sum(weights: str, terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + F.element_at(F.col(weights), t + 1))


def _ints(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<int>")


def _weighted(coefs: DataFrame, basis: PolynomialBasis) -> DataFrame:
    """Variance contribution c²·E[Φ²] of every term and the total without the mean."""
    norms = F.array(*[F.lit(float(v)) for v in basis.norms])
    weights = F.zip_with("coef", norms, lambda c, v: c * c * v)
    df = coefs.withColumn("_w", weights)
    rest = F.slice("_w", 2, basis.n_terms)  # subtracting a large mean term would cost the digits of the others
    return df.withColumn("variance", F.aggregate(rest, F.lit(0.0), lambda a, v: a + v))


def sobol_indices(coefs: DataFrame, basis: PolynomialBasis, groups: Sequence[str] = ()) -> DataFrame:
    """First and total order index of every input per (group, output).

    Zero variance gives zero indices and ``degenerate``.  Works on one row per fit.
    """
    entries = []
    for i, name in enumerate(basis.params):
        total = [t for t, a in enumerate(basis.indices) if a[i]]
        first = [t for t in total if sum(1 for e in basis.indices[t] if e) == 1]
        entries.append(F.struct(
            F.lit(i).alias("param_id"), F.lit(name).alias("param"), _ints(first).alias("_first"), _ints(total).alias("_total")))
    rows = _weighted(coefs, basis).select(*groups, "output_id", "_w", "variance", F.inline(F.array(*entries)))
    share = lambda terms: guarded_divide(_term_sum("_w", F.col(terms)), F.col("variance"))
    return rows.select(
        *groups, "output_id", "param_id", "param", share("_first").alias("s1"), share("_total").alias("st"),
        "variance", (F.col("variance") == 0).alias("degenerate"),
    )


def sobol_joint(coefs: DataFrame, basis: PolynomialBasis, groups: Sequence[str] = ()) -> DataFrame:
    """Joint index of every input pair: share of the terms in which both appear."""
    entries = []
    d = len(basis.params)
    for i in range(d):
        for j in range(i + 1, d):
            both = [t for t, a in enumerate(basis.indices) if a[i] and a[j]]
            entries.append(F.struct(F.lit(basis.params[i]).alias("param_i"), F.lit(basis.params[j]).alias("param_j"), _ints(both).alias("_terms")))
    if not entries:
        return coefs.select(*groups, "output_id", F.lit("").alias("param_i"), F.lit("").alias("param_j"), F.lit(0.0).alias("s_ij")).limit(0)
    rows = _weighted(coefs, basis).select(*groups, "output_id", "_w", "variance", F.inline(F.array(*entries)))
    return rows.select(
        *groups, "output_id", "param_i", "param_j", guarded_divide(_term_sum("_w", F.col("_terms")), F.col("variance")).alias("s_ij"))


def output_variances(statistics: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Population variance of every output from its centred sums."""
    return statistics.select(*groups, "output_id", (F.col("syy") / F.col("n")).alias("output_variance"))


def output_weights(variances: DataFrame, groups: Sequence[str] = (), unit: Sequence[str] = ("output_id",)) -> DataFrame:
    """Share of every unit in the output variance of its group; all-zero variances weight equally.

    The total is an aggregate joined back, not a window.
    """
    totals = variances.groupBy(*groups).agg(F.sum("output_variance").alias("_sum"), F.count(F.lit(1)).alias("_k"))
    if groups:
        weights = variances.join(totals, list(groups))
    else:
        weights = variances.withColumns({c: totals.select(c).scalar() for c in ("_sum", "_k")})
    weight = F.when(F.col("_sum") > 0, F.col("output_variance") / F.col("_sum")).otherwise(1.0 / F.col("_k"))
    return weights.select(*groups, *unit, weight.alias("_weight"))


def variance_weighting(indices: DataFrame, variances: DataFrame, groups: Sequence[str] = (), unit: Sequence[str] = ("output_id",)) -> DataFrame:
    """Combine outputs into one index per input, weighted by output variance.

    ``unit`` names what is combined: the output, or (stage, output) for one index over all stages.
    """
    joined = indices.join(output_weights(variances, groups, unit), [*groups, *unit])
    return joined.groupBy(*groups, "param_id", "param").agg(
        F.sum(F.col("_weight") * F.col("s1")).alias("s1"), F.sum(F.col("_weight") * F.col("st")).alias("st"))


def joint_weighting(joint: DataFrame, variances: DataFrame, groups: Sequence[str] = (), unit: Sequence[str] = ("output_id",)) -> DataFrame:
    """The matrix of joint indices combined in the same way, one row per pair of inputs."""
    joined = joint.join(output_weights(variances, groups, unit), [*groups, *unit])
    return joined.groupBy(*groups, "param_i", "param_j").agg(F.sum(F.col("_weight") * F.col("s_ij")).alias("s_ij"))


def per_stage_sobol(indices: DataFrame, stage: str = "stage") -> DataFrame:
    """Mean of the per-output indices in every growth stage."""
    return indices.groupBy(stage, "param_id", "param").agg(F.avg("s1").alias("s1"), F.avg("st").alias("st"))


def interaction_gap(indices: DataFrame) -> DataFrame:
    """Share of an input that acts through interactions."""
    return indices.withColumn("interaction", F.col("st") - F.col("s1"))


def top_parameters(indices: DataFrame, n: int | None, by: str = "st", groups: Sequence[str] = ()) -> DataFrame:
    """Inputs ranked by mean index over outputs, the best n per group."""
    means = indices.groupBy(*groups, "param_id", "param").agg(F.avg("s1").alias("s1"), F.avg("st").alias("st"))
    w = Window.partitionBy(*groups).orderBy(F.desc(by), "param_id")
    ranked = means.withColumn("rank", F.row_number().over(w))
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def peak_stage(indices: DataFrame, stage: str = "stage") -> DataFrame:
    """Stage with the largest total sensitivity summed over inputs, the first on ties."""
    sums = indices.groupBy(stage).agg(F.sum("st").alias("total"))
    best = F.max(F.struct("total", (-F.col(stage)).alias("neg")))
    return sums.agg(best.alias("b")).select((-F.col("b.neg")).alias(stage), F.col("b.total").alias("total"))


def stage_pivot(indices: DataFrame, stages: Sequence[int], stage: str = "stage") -> DataFrame:
    """Input by stage matrix of total indices."""
    return indices.groupBy("param").agg(
        *[F.max(F.when(F.col(stage) == s, F.col("st"))).alias(f"stage_{s}") for s in stages])


def top_table(indices: DataFrame, strategies: Sequence[str], by: str, k: int) -> DataFrame:
    """Top-k inputs by one strategy's index with every strategy's mean beside it; missing is NaN."""
    cols = [F.coalesce(F.avg(F.when(F.col("strategy") == s, F.col("st"))), F.lit(float("nan"))).alias(s) for s in strategies]
    wide = indices.groupBy("param_id", "param").agg(*cols)
    return wide.orderBy(F.desc(by), "param_id").limit(k)


def correlation_proxy(df: DataFrame, inputs: Sequence[str], outputs: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Mean absolute input-output correlation, normalised over inputs; constant inputs get 0."""
    aggs = [F.stddev_pop(y).alias(f"o{j}") for j, y in enumerate(outputs)]
    for i, x in enumerate(inputs):
        aggs.append(F.stddev_pop(x).alias(f"s{i}"))
        aggs += [F.covar_pop(x, y).alias(f"c{i}_{j}") for j, y in enumerate(outputs)]
    wide = df.groupBy(*groups).agg(*aggs)
    # Correlations from the moments: the built-in one fails on a constant column under ANSI.
    wide = wide.withColumns({
        f"c{i}_{j}": guarded_divide(F.col(f"c{i}_{j}"), F.col(f"s{i}") * F.col(f"o{j}"))
        for i in range(len(inputs)) for j in range(len(outputs))
    })
    score = []
    for i in range(len(inputs)):
        total = sum((F.abs(F.coalesce(F.col(f"c{i}_{j}"), F.lit(0.0))) for j in range(len(outputs))), F.lit(0.0)) / len(outputs)
        score.append(F.when(F.col(f"s{i}") > MIN_INPUT_SPREAD, total).otherwise(0.0))
    wide = wide.withColumn("_scores", F.array(*score))
    names = F.array(*[F.lit(n) for n in inputs])
    total = F.aggregate("_scores", F.lit(0.0), lambda a, s: a + s) + MIN_INPUT_SPREAD
    return wide.select(*groups, F.posexplode(F.arrays_zip(names.alias("param"), F.col("_scores").alias("score"))).alias("param_id", "e"), total.alias("_total")).select(
        *groups, "param_id", F.col("e.param").alias("param"), (F.col("e.score") / F.col("_total")).alias("s1"))


def sobol_mc(evaluated: DataFrame, inputs: Sequence[str], outputs: Sequence[str], key: str = "sample_id", groups: Sequence[str] = ()) -> DataFrame:
    """Indices from A, B and AB_i evaluations: Saltelli's first and Jansen's total estimator.

    The blocks of a sample meet in one grouped row of fixed width, then everything is a sum.
    """
    pick = lambda block, y: F.max(F.when(F.col("block") == block, F.col(y)))
    aggs = []
    for j, y in enumerate(outputs):
        aggs += [pick("A", y).alias(f"a{j}"), pick("B", y).alias(f"b{j}")]
        aggs += [pick(f"AB_{n}", y).alias(f"ab{j}_{i}") for i, n in enumerate(inputs)]
    wide = evaluated.groupBy(*groups, key).agg(*aggs)
    sums = []
    for j in range(len(outputs)):
        a, b = F.col(f"a{j}"), F.col(f"b{j}")
        both = F.array(a, b)
        sums += [F.sum(a + b).alias(f"s{j}"), F.sum(F.aggregate(both, F.lit(0.0), lambda acc, v: acc + v * v)).alias(f"q{j}")]
        for i in range(len(inputs)):
            ab = F.col(f"ab{j}_{i}")
            sums += [F.avg(b * (ab - a)).alias(f"f{j}_{i}"), F.avg((a - ab) * (a - ab)).alias(f"t{j}_{i}")]
    wide = wide.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), *sums)
    entries = []
    for j, y in enumerate(outputs):
        m = 2.0 * F.col("_n")
        variance = F.col(f"q{j}") / m - (F.col(f"s{j}") / m) * (F.col(f"s{j}") / m)
        for i, n in enumerate(inputs):
            entries.append(F.struct(
                F.lit(y).alias("output_id"), F.lit(i).alias("param_id"), F.lit(n).alias("param"),
                guarded_divide(F.col(f"f{j}_{i}"), variance).alias("s1"), guarded_divide(F.col(f"t{j}_{i}") / 2.0, variance).alias("st")))
    return wide.select(*groups, F.inline(F.array(*entries)))
