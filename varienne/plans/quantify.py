"""From per-sample outputs to sensitivity tables, all strategies and groups in one plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varienne.functions.basis import PolynomialBasis
from varienne.operators import fit, multifit, sobol
from varienne.operators.design import Bounds, germ_columns
from varienne.session import checked_broadcast, materialize

STRATEGY_KEYS = ["strategy", "group_value"]


@dataclass
class Sensitivity:
    """Tables of one analysis."""

    basis: PolynomialBasis
    sums: multifit.OutputSums
    coefs: DataFrame
    errors: DataFrame
    indices: DataFrame
    joint: DataFrame
    weighted: DataFrame
    weighted_joint: DataFrame

    def combined(self, strategy: str = "growth_stage") -> tuple[DataFrame, DataFrame]:
        """One index per input and per pair of inputs over all (group, output) of a strategy, weighted by their variances.

        For growth stages this is the fit to all stages and observables at once: its coefficients are those of
        the single fits, its indices their mean weighted by the variance of every stage and observable.
        """
        mine = lambda df: df.where(F.col("strategy") == strategy)
        variances = sobol.output_variances(mine(self.coefs), STRATEGY_KEYS)
        unit = ["group_value", "output_id"]
        return (sobol.variance_weighting(mine(self.indices), variances, ["strategy"], unit), sobol.joint_weighting(mine(self.joint), variances, ["strategy"], unit))


def design_phi(design: DataFrame, basis: PolynomialBasis, bounds: Bounds, key: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Basis row per sample; broadcast only when the samples are few enough for their width."""
    phi = fit.with_phi(design, basis, germ_columns(bounds)).select(*key, "phi")
    return checked_broadcast(phi, max_rows=max(1, 8_000_000 // basis.n_terms))


def fit_strategies(
    design: DataFrame, bounds: Bounds, outputs: DataFrame, order: int, method: str = "lsq",
    tolerance: float = fit.DEFAULT_TOLERANCE, groups: list[str] | None = None, family: str = "legendre",
    key: Sequence[str] = ("sample_id",), held_out: Column | None = None, folds: int = 0,
    fold: Column | None = None,
) -> Sensitivity:
    """Fit every (strategy, group, output) at once and derive its indices and errors.

    ``design`` has (sample_id, inputs...), ``outputs`` the long strategy table.  Group labels
    stay key columns, so the number of strategies and groups does not change the plan.
    Several conditions, each with its own design, are fitted together by adding
    ``condition`` to both the groups and the key.

    Samples for which ``held_out`` (a condition on the key) is true are left out of the fit and give test_error.  With ``folds`` the others
    are dealt to as many folds, by ``fold`` (0 to folds - 1) or a hash of their key; cross_error is the error on each fold of the fit without it.
    """
    groups = STRATEGY_KEYS if groups is None else groups
    basis = PolynomialBasis(tuple(bounds), order, family)
    # Fold 0 is held out, the others are trained on.
    fold = F.pmod(F.xxhash64(*key), F.lit(max(folds, 1))) if fold is None else fold
    fold = fold + 1 if held_out is None else F.when(held_out, 0).otherwise(fold + 1)
    sums = multifit.output_sums(outputs, design_phi(design, basis, bounds, key), basis, groups, key, fold, max(folds, 1) + 1)
    coefs = materialize(multifit.fit_outputs(sums, method, tolerance, test_fold=0, cross=folds > 1), "coefs")
    indices = sobol.sobol_indices(coefs, basis, groups)
    joint = sobol.sobol_joint(coefs, basis, groups)
    variances = sobol.output_variances(coefs, groups)
    weighted = sobol.variance_weighting(indices, variances, groups)
    return Sensitivity(basis, sums, coefs, multifit.errors(coefs, groups), indices, joint, weighted, sobol.joint_weighting(joint, variances, groups))


def summary_document(result: Sensitivity, digits: int = 6) -> DataFrame:
    """Nested summary, one row per strategy: groups with their indices per input.

    Built from the weighted indices: one entry per (group, input).
    """
    index = F.struct("param", F.round("s1", digits).alias("first_order"), F.round("st", digits).alias("total_order"))
    per_group = result.weighted.groupBy("strategy", "group_value").agg(F.array_sort(F.collect_list(index)).alias("indices"))
    entry = F.struct("group_value", "indices")
    return per_group.groupBy("strategy").agg(F.array_sort(F.collect_list(entry)).alias("groups"))
