"""Regressions of very many outputs: one factorisation for all outputs over the same samples, and their errors.

Outputs that have values for the same samples share a Gram matrix, which is summed once and meets the right-hand sides
in blocks.  Sums are kept per fold of the samples, so held-out and cross-validated errors need no further pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varienne.functions.basis import PolynomialBasis
from varienne.operators.fit import DEFAULT_TOLERANCE, METHODS, PLAIN_RHS_TERMS, gram_sums, present, pseudo_inverse, sum_vectors, unpack_gram
from varienne.operators.sparse import sparse_bayes
from varienne.session import hint_if_small, materialize

#: Numbers in the right-hand sides of one block.
BLOCK_VALUES = 1_000_000
SET = "_set"


@dataclass
class OutputSums:
    """Sufficient statistics of a long output table.

    ``outputs``: groups, output_id, _set (which samples have a value) and folds, an array of (fold, n, rhs, syy, mean) with sums about the
    mean of the fold.  ``grams``: groups, _set, _fold, samples, gram.  ``sets``: groups, _set and the number of its outputs, with a broadcast hint if
    they are few.  Outputs and sets are written tables; Gram matrices are summed when they are used.
    """

    basis: PolynomialBasis
    groups: list[str]
    outputs: DataFrame
    grams: DataFrame
    sets: DataFrame
    folds: int = 1


def rhs_sums(rows: DataFrame, p: int, keys: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """Per key: n, rhs, syy and mean of rows with phi and y, beside further aggregates; combined map-side, about the mean."""
    value, count = F.col("y").cast("double"), F.count(F.lit(1))
    if p <= PLAIN_RHS_TERMS:
        # Very many keys: plain sums use the hash aggregate with its compact rows.
        sums = rows.groupBy(*keys).agg(
            count.alias("n"), *[(F.covar_pop(F.col("phi")[t], value) * count).alias(f"_r{t}") for t in range(p)],
            (F.var_pop(value) * count).alias("syy"), F.avg(value).alias("mean"), *extra)
        return sums.withColumn("rhs", F.array(*[F.col(f"_r{t}") for t in range(p)])).drop(*[f"_r{t}" for t in range(p)])
    means = rows.groupBy(*keys).agg(F.avg(value).alias("mean"))
    centred = rows.join(means, list(keys)).withColumn("_d", value - F.col("mean"))
    return centred.groupBy(*keys).agg(
        count.alias("n"), sum_vectors(F.transform("phi", lambda f: f * F.col("_d"))).alias("rhs"),
        F.sum(F.col("_d") * F.col("_d")).alias("syy"), F.first("mean").alias("mean"), *extra)


def output_sums(
    y: DataFrame, phi: DataFrame, basis: PolynomialBasis, groups: Sequence[str], key: Sequence[str] = ("sample_id",),
    fold: Column | None = None, folds: int = 1,
) -> OutputSums:
    """Sums of a long output table (groups..., key..., output_id, y) and (key..., phi).

    ``fold`` numbers the samples from 0 to ``folds - 1`` by their key.  Null and NaN count as missing, like an absent row.  Outputs with the same
    number and hash of samples per group form a set; the Gram matrix of a set is summed over the rows of one of its outputs.
    """
    groups, key = list(groups), list(key)
    h = F.xxhash64(*key)
    rows = y.where(present("y")).join(phi, key).withColumn("_fold", F.lit(0) if fold is None else fold.cast("int"))
    hashes = [F.sum(h.bitwiseAND(F.lit((1 << 31) - 1))).alias("_h0"), F.sum(F.shiftrightunsigned(h, 33)).alias("_h1")]
    part = rhs_sums(rows, basis.n_terms, [*groups, "output_id", "_fold"], hashes)
    entry = F.struct(F.col("_fold").alias("fold"), "n", "rhs", "syy", "mean")
    outputs = part.groupBy(*groups, "output_id").agg(F.collect_list(entry).alias("folds"), F.sum("n").alias("_n"), F.sum("_h0").alias("_h0"), F.sum("_h1").alias("_h1"))
    outputs = materialize(outputs.withColumn(SET, F.xxhash64("_n", "_h0", "_h1")).drop("_n", "_h0", "_h1"), "outputs")
    sets = materialize(outputs.groupBy(*groups, SET).agg(F.count(F.lit(1)).alias("_outputs"), F.min("output_id").alias("output_id")), "sets")
    sets = hint_if_small(sets)
    samples = rows.join(sets.drop("_outputs"), [*groups, "output_id"])
    return OutputSums(basis, groups, outputs, gram_sums(samples, basis.n_terms, [*groups, SET, "_fold"]), sets.drop("output_id"), folds)


def _moved(gram, n, rhs, syy, mean, common):
    """Sums about a common mean per output: rhs (outputs, terms) and syy."""
    shift = mean - common
    return rhs + shift[:, None] * gram[:, 0], syy + n * shift**2


def _squares(gram, rhs, syy, coef):
    """Sum of squared residuals of coefficients about the mean that rhs and syy are about."""
    return np.maximum(syy - 2 * np.einsum("ij,ij->i", coef, rhs) + np.einsum("ij,jk,ik->i", coef, gram, coef), 0.0)


def solve_many(gram: np.ndarray, n: int, rhs: np.ndarray, syy: np.ndarray, mean: np.ndarray, method: str, tolerance: float) -> dict:
    """All outputs of a block with one inverse: coefficients about zero, used terms, noise, squared residuals, convergence."""
    m, p = rhs.shape
    out = {"used": np.ones((m, p), bool), "converged": np.ones(m, bool), "steps": np.zeros(m, np.int64)}
    if method == "bcs":
        fits = [sparse_bayes(gram, b, s, n, c, tolerance) for b, s, c in zip(rhs, syy, mean)]
        out |= {name: np.array([getattr(f, name) for f in fits]).reshape((m, p) if name in ("coef", "used") else m) for name in ("coef", "used", "sigma2", "converged", "steps")}
        about = out["coef"].copy()
        about[:, 0] -= mean
        return out | {"sse": _squares(gram, rhs, syy, about)}
    inverse = pseudo_inverse(gram)
    short = n < p  # the minimum norm counts the constant too
    b = rhs + mean[:, None] * gram[:, 0] if short else rhs
    coef = b @ inverse
    coef += (b - coef @ gram) @ inverse
    sse = np.zeros(m) if short else np.maximum(syy - np.einsum("ij,ij->i", coef, b), 0.0)
    if not short:
        coef[:, 0] += mean
    freedom = n - p - (2 if method == "anl" else 0)
    return out | {"coef": coef, "sigma2": sse / freedom if freedom > 0 else np.zeros(m), "sse": sse}


def _block(p: int, groups: list[str], method: str, tolerance: float, underdetermined: str, test_fold: int | None, cross: bool, columns: list[str]):
    """Function for a cogrouped ``applyInPandas`` (outputs of a block, Gram matrices of their set)."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in columns})
        grams = {int(f): (unpack_gram(np.asarray(g), p), int(n)) for f, g, n in zip(right["_fold"], right["gram"], right["samples"])}
        m = len(left)
        rhs = {f: np.zeros((m, p)) for f in grams}
        syy, mean = {f: np.zeros(m) for f in grams}, {f: np.zeros(m) for f in grams}
        for i, folds in enumerate(left["folds"]):
            for e in folds:
                rhs[e["fold"]][i], syy[e["fold"]][i], mean[e["fold"]][i] = e["rhs"], e["syy"], e["mean"]

        def summed(chosen):
            n = sum(grams[f][1] for f in chosen)
            common = sum(grams[f][1] * mean[f] for f in chosen) / n
            parts = [_moved(*grams[f], rhs[f], syy[f], mean[f], common) for f in chosen]
            return sum(grams[f][0] for f in chosen), n, sum(b for b, _ in parts), sum(s for _, s in parts), common

        def outside(fit, common, f):
            """Squared residuals of a fit on a fold, and the fold's sum of squares."""
            about = fit["coef"].copy()
            about[:, 0] -= common
            gram, n = grams[f]
            return _squares(gram, *_moved(gram, n, rhs[f], syy[f], mean[f], common), about), syy[f] + n * mean[f] ** 2

        train = [f for f in grams if f != test_fold]
        frame = left[[*groups, "output_id"]].copy()
        if not train:
            return pd.DataFrame({c: [] for c in columns})
        total = summed(train)
        if underdetermined == "error" and total[1] < p:
            raise ValueError(f"{total[1]} samples for {p} terms")
        fit = solve_many(*total, method, tolerance)
        for name in ("coef", "used"):
            frame[name] = list(fit[name])
        for name in ("sigma2", "converged", "steps", "sse"):
            frame[name] = fit[name]
        frame["n"], frame["syy"], frame["mean"] = total[1], total[3], total[4]
        frame["test_n"] = grams[test_fold][1] if test_fold in grams else 0
        frame["test_sse"], frame["test_yy"] = outside(fit, total[4], test_fold) if test_fold in grams else (None, None)
        frame["cross_sse"], frame["cross_yy"] = None, None
        if cross and len(train) > 1:
            squares = np.zeros((2, m))
            for f in train:
                rest = summed([x for x in train if x != f])
                squares += outside(solve_many(*rest, method, tolerance), rest[4], f)
            frame["cross_sse"], frame["cross_yy"] = squares
        return frame[columns]

    return run


def fit_outputs(
    sums: OutputSums, method: str = "lsq", tolerance: float = DEFAULT_TOLERANCE, underdetermined: str = "min_norm",
    test_fold: int | None = None, cross: bool = False,
) -> DataFrame:
    """Fits per (group, output): coef, used, sigma2, n, syy, mean, sse, converged, steps and sums of squared errors.

    Outputs are dealt to blocks of at most ``BLOCK_VALUES`` numbers; every block meets the Gram matrix of its set once and
    solves all its outputs with one inverse.  Samples of ``test_fold`` are left out of the fit; test_sse and test_yy are their sums of
    squared residuals and values.  ``cross`` fits once more without each fold and adds up the residuals on it in cross_sse.
    All errors come from the sums, so residuals below about 1e-8 of the values are lost to rounding; ``qr`` keeps those.
    """
    if method not in METHODS:
        raise ValueError(f"unknown regression {method!r}, expected one of {METHODS}")
    if underdetermined not in ("min_norm", "error"):
        raise ValueError(f"unknown choice {underdetermined!r}, expected 'min_norm' or 'error'")
    p, groups = sums.basis.n_terms, sums.groups
    per_block = max(1, BLOCK_VALUES // (p * sums.folds))
    blocks = sums.sets.withColumn("_blocks", F.ceil(F.col("_outputs") / F.lit(per_block)).cast("int")).drop("_outputs")
    on = [*groups, SET]
    left = sums.outputs.join(blocks, on).withColumn("_block", F.pmod(F.xxhash64("output_id"), F.col("_blocks")).cast("int")).drop("_blocks")
    right = sums.grams.join(blocks, on).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    schema = sums.outputs.select(*groups, "output_id").schema
    for name, kind in (("coef", T.ArrayType(T.DoubleType())), ("used", T.ArrayType(T.BooleanType())), ("sigma2", T.DoubleType()), ("n", T.LongType()), ("syy", T.DoubleType()),
                       ("mean", T.DoubleType()), ("sse", T.DoubleType()), ("converged", T.BooleanType()), ("steps", T.LongType()), ("test_n", T.LongType()),
                       ("test_sse", T.DoubleType()), ("test_yy", T.DoubleType()), ("cross_sse", T.DoubleType()), ("cross_yy", T.DoubleType())):
        schema = schema.add(name, kind)
    keys = [*on, "_block"]
    run = _block(p, groups, method, tolerance, underdetermined, test_fold, cross, schema.names)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def errors(fits: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Relative errors per (group, output): root of squared residuals over root of squared values; a zero norm counts as 1.

    test_error and cross_error are null where nothing was held out.
    """
    values = F.col("syy") + F.col("n") * F.col("mean") * F.col("mean")
    relative = lambda sse, yy: F.sqrt(F.col(sse)) / F.when(yy > 0, F.sqrt(yy)).otherwise(1.0)
    return fits.select(*groups, "output_id", "n", "test_n", relative("sse", values).alias("train_error"), relative("test_sse", F.col("test_yy")).alias("test_error"),
                       relative("cross_sse", F.col("cross_yy")).alias("cross_error"))
