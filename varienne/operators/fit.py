"""Polynomial-chaos regression from sufficient statistics.

Spark sums the Gram matrix of the basis once per group and the right-hand side once per
(group, output); only those sums, whose size depends on the number of terms and not on
the data, reach the solver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from varienne.functions.basis import PolynomialBasis
from varienne.operators.sparse import sparse_bayes
from varienne.session import checked_broadcast, materialize, measure

METHODS = ("lsq", "anl", "bcs")
#: Up to this many sums per row generated code is faster; beyond, numpy blocks in Arrow tasks (measured).
GENERATED_SUMS = 32
#: Up to this many terms a basis row is multiplied out in generated code.
GENERATED_TERMS = 16
#: Up to this many terms the right-hand sides of long outputs are plain sums (``multifit``).
PLAIN_RHS_TERMS = 64
#: Numbers a task may hold in partial sums before it hands them on.
BUFFERED_VALUES = 4_000_000
EIGEN_CUTOFF = 1e-11
CONDITION_LIMIT = 1e12
USED_COEFFICIENT = 1e-10
DEFAULT_TOLERANCE = 1e-3
#: Bytes of fits that are unrolled at once.
SLICE_BYTES = 32 << 20


def sum_vectors(c: Column) -> Column:
    """Element-wise sum of equally long arrays, combined map-side."""
    return vector_to_array(Summarizer.metrics("sum").summary(array_to_vector(c)).getField("sum"))


def with_phi(df: DataFrame, basis: PolynomialBasis, germ: Sequence[Column]) -> DataFrame:
    """Add the basis row of every sample; the germ is computed once per row."""
    names = [f"_g{i}" for i in range(len(germ))]
    df = df.withColumns(dict(zip(names, germ)))
    return df.withColumn("phi", basis.phi([F.col(n) for n in names])).drop(*names)


def gram_entries(phi: Column | Sequence[Column], n_terms: int) -> list[Column]:
    """Lower triangle of φφᵀ in row order."""
    return [phi[i] * phi[j] for i in range(n_terms) for j in range(i + 1)]


def unpack_gram(tri: np.ndarray, n_terms: int) -> np.ndarray:
    gram = np.zeros((n_terms, n_terms))
    gram[np.tril_indices(n_terms)] = tri
    return gram + np.tril(gram, -1).T


def present(name: str) -> Column:
    """Whether an output has a value: neither null nor NaN."""
    y = F.col(name).cast("double")
    return y.isNotNull() & ~F.isnan(y)


def wide_statistics(df: DataFrame, basis: PolynomialBasis, germ: Sequence[Column], outputs: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Statistics of samples that carry their outputs as columns.

    Result: one row per (group, output) with n, gram, rhs, syy and mean, where rhs = sum of
    phi * (y - mean) and syy = sum of (y - mean)^2, so a large mean costs no digits.  Outputs without a
    missing value share one pass and one Gram matrix; a null or NaN leaves the sample out for
    that output alone, which then has a pass and a Gram matrix of its own.  Each task sends one vector of
    sums per group, whatever the number of samples or the skew of the groups.
    """
    missing = df.agg(*[F.sum((~present(o)).cast("bigint")).alias(f"m{j}") for j, o in enumerate(outputs)]).first()
    whole = [o for o, m in zip(outputs, missing) if not m]
    parts = [(whole, df)] if whole else []
    parts += [([o], df.where(present(o))) for o, m in zip(outputs, missing) if m]
    out = None
    for names, rows in parts:
        p = basis.n_terms
        small = p * (p + 1) // 2 + len(names) * (p + 2) <= GENERATED_SUMS
        part = _split_sums((_generated_sums if small else _block_sums)(rows, basis, germ, names, groups), p, names, groups)
        out = part if out is None else out.unionByName(part)
    return out


def _generated_sums(df, basis, germ, outputs, groups):
    """Plain sums and covariances in generated code, the fastest way while there are few products."""
    p = basis.n_terms
    rows = with_phi(df, basis, germ).select(*groups, *outputs, *[F.col("phi")[t].alias(f"_p{t}") for t in range(p)])
    phi = [F.col(f"_p{t}") for t in range(p)]
    entries = [F.sum(e) for e in gram_entries(phi, p)]
    for o in outputs:
        y = F.col(o).cast("double")
        entries += [F.covar_pop(f, y) * F.count(F.lit(1)) for f in phi] + [F.var_pop(y) * F.count(F.lit(1)), F.avg(y)]
    sums = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), *[e.alias(f"_e{k}") for k, e in enumerate(entries)])
    return sums.where("n > 0").select(*groups, "n", F.array(*[F.col(f"_e{k}") for k in range(len(entries))]).alias("sums"))


def _partial_blocks(df: DataFrame, groups: Sequence[str], block: Callable[[pd.DataFrame], np.ndarray], width: int, combine: Callable) -> DataFrame:
    """A vector per (task, group): numpy inside Arrow batches, merged by ``combine(n, a, m, b)``.

    A task holds at most ``BUFFERED_VALUES`` numbers; with very many groups it hands its
    partial sums on early and the final aggregation adds them up all the same.
    """
    schema = df.select(*groups).schema.add("n", T.LongType()).add("sums", T.ArrayType(T.DoubleType()))
    limit = max(1, BUFFERED_VALUES // width)

    def rows(totals: dict) -> pd.DataFrame:
        return pd.DataFrame([(*key, n, sums.tolist()) for key, (n, sums) in totals.items()], columns=[*groups, "n", "sums"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple, list] = {}
        for batch in batches:
            for key, frame in batch.groupby(list(groups), dropna=False, sort=False) if groups else [((), batch)]:
                if not len(frame):
                    continue
                sums = block(frame)
                if key in totals:
                    totals[key] = [totals[key][0] + len(frame), combine(totals[key][0], totals[key][1], len(frame), sums)]
                else:
                    totals[key] = [len(frame), sums]
                if len(totals) > limit:
                    yield rows(totals)
                    totals = {}
        if totals:
            yield rows(totals)

    return df.mapInPandas(run, schema)


def _block_sums(df, basis, germ, outputs, groups):
    """Centred sums by numpy blocks: partial vectors about their own means, moved to the common mean, then added."""
    d, m, p = len(germ), len(outputs), basis.n_terms
    inputs = df.select(*groups, *[g.alias(f"_g{i}") for i, g in enumerate(germ)], *[F.col(o).cast("double").alias(f"_y{j}") for j, o in enumerate(outputs)])
    lower = np.tril_indices(p)
    g = len(lower[0])
    first = np.array([t * (t + 1) // 2 for t in range(p)])  # sums of the terms: products with the constant one
    at = [g + j * (p + 2) for j in range(m)]

    def block(frame: pd.DataFrame) -> np.ndarray:
        phi = basis.matrix(frame[[f"_g{i}" for i in range(d)]].to_numpy(dtype=float))
        y = frame[[f"_y{j}" for j in range(m)]].to_numpy(dtype=float)
        mean = y.mean(axis=0)
        rhs, syy = phi.T @ (y - mean), ((y - mean) ** 2).sum(axis=0)
        return np.concatenate([(phi.T @ phi)[lower], *[np.append(rhs[:, j], [syy[j], mean[j]]) for j in range(m)]])

    def moved(n: int, v: np.ndarray, means: np.ndarray) -> np.ndarray:
        out = v.copy()
        for j, k in enumerate(at):
            shift = v[k + p + 1] - means[j]
            out[k:k + p] += shift * v[first]
            out[k + p] += n * shift * shift
            out[k + p + 1] = means[j]
        return out

    def combine(n: int, a: np.ndarray, k: int, b: np.ndarray) -> np.ndarray:
        places = [i + p + 1 for i in at]
        means = a[places] + (b[places] - a[places]) * (k / (n + k))
        out = moved(n, a, means) + moved(k, b, means)
        out[places] = means
        return out

    partial = materialize(_partial_blocks(inputs, groups, block, g + m * (p + 2), combine), "partial")
    means = F.array(*[F.try_divide(F.sum(F.col("sums")[i + p + 1] * F.col("n")), F.sum("n")) for i in at])
    total = partial.groupBy(*groups).agg(means.alias("means"))

    @pandas_udf(T.ArrayType(T.DoubleType()))
    def to_common(n: pd.Series, sums: pd.Series, common: pd.Series) -> pd.Series:
        return pd.Series([moved(k, np.asarray(v), np.asarray(c)) for k, v, c in zip(n, sums, common)])

    if groups:
        keys = total.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(groups)], "means")
        same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(groups)]
        condition = same[0]
        for c in same[1:]:
            condition = condition & c
        both = partial.join(keys, condition)
    else:
        both = partial.withColumn("means", total.select("means").scalar())
    summed = both.groupBy(*groups).agg(F.sum("n").alias("n"), sum_vectors(to_common("n", "sums", "means")).alias("sums"), F.first("means").alias("means")).where("n > 0")
    # The means were added too: put them back.
    tail = [F.concat(F.slice("sums", g + 1 + j * (p + 2), p + 1), F.array(F.col("means")[j])) for j in range(m)]
    return summed.select(*groups, "n", F.concat(F.slice("sums", 1, g), *tail).alias("sums"))


def gram_sums(samples: DataFrame, p: int, groups: Sequence[str]) -> DataFrame:
    """Gram matrix and number of samples per group from rows that carry ``phi``."""
    if p * (p + 1) // 2 <= GENERATED_SUMS:
        entries = gram_entries(F.col("phi"), p)
        sums = samples.groupBy(*groups).agg(F.count(F.lit(1)).alias("samples"), *[F.sum(e).alias(f"_e{k}") for k, e in enumerate(entries)])
        return sums.select(*groups, "samples", F.array(*[F.col(f"_e{k}") for k in range(len(entries))]).alias("gram"))
    lower = np.tril_indices(p)

    def block(frame: pd.DataFrame) -> np.ndarray:
        phi = np.stack(frame["phi"].to_numpy())
        return (phi.T @ phi)[lower]

    partial = _partial_blocks(samples.select(*groups, "phi"), groups, block, len(lower[0]), lambda n, a, m, b: a + b)
    return partial.groupBy(*groups).agg(F.sum("n").alias("samples"), sum_vectors(F.col("sums")).alias("gram"))


def _split_sums(partial: DataFrame, p: int, outputs: Sequence[str], groups: Sequence[str]) -> DataFrame:
    g = p * (p + 1) // 2
    part = lambda start, size: F.slice("sums", start + 1, size)
    entries = []
    for j, o in enumerate(outputs):
        at = g + j * (p + 2)
        entries.append(F.struct(
            F.lit(o).alias("output_id"), part(at, p).alias("rhs"),
            F.col("sums")[at + p].alias("syy"), F.col("sums")[at + p + 1].alias("mean"),
        ))
    return partial.select(*groups, "n", part(0, g).alias("gram"), F.inline(F.array(*entries)))


def raw_rhs(gram: Column, rhs: Column, mean: Column) -> Column:
    """Sums of phi * y: the centred sums and the mean times the sums of the terms."""
    return F.transform(rhs, lambda r, t: r + mean * F.get(gram, (t * (t + 1) / 2).cast("int")))


def raw_squares(syy: Column, mean: Column, n: Column) -> Column:
    """Sum of y * y."""
    return syy + n * mean * mean


# --- solvers on P-sized systems -----------------------------------------------------


def pseudo_inverse(gram: np.ndarray) -> np.ndarray:
    """Inverse of a Gram matrix; the Moore-Penrose one when it is singular."""
    scale = np.sqrt(np.clip(np.diag(gram), 1e-300, None))
    scaled = gram / np.outer(scale, scale)
    values, vectors = np.linalg.eigh(scaled)
    if values[0] > 0 and values[-1] / values[0] < CONDITION_LIMIT:
        return (vectors / values) @ vectors.T / np.outer(scale, scale)
    values, vectors = np.linalg.eigh(gram)
    keep = values > EIGEN_CUTOFF * values[-1]
    return (vectors[:, keep] / values[keep]) @ vectors[:, keep].T


def solve_normal(gram: np.ndarray, rhs: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Coefficients with one step of iterative refinement."""
    coef = inverse @ rhs
    return coef + inverse @ (rhs - gram @ coef)


FIT_TYPE = "coef array<double>, used array<boolean>, sigma2 double, converged boolean, steps int"


def _solver(method: str, tolerance: float, underdetermined: str, covariance: bool) -> Callable:
    @pandas_udf(FIT_TYPE + (", ginv array<double>" if covariance else ""))
    def solve(gram: pd.Series, rhs: pd.Series, syy: pd.Series, mean: pd.Series, n: pd.Series) -> pd.DataFrame:
        inverses: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        rows = []
        for tri, b, spread, centre, count in zip(gram, rhs, syy, mean, n):
            p = len(b)
            if underdetermined == "error" and count < p:
                raise ValueError(f"{count} samples for {p} terms")
            key = tri.tobytes()
            if key not in inverses:
                matrix = unpack_gram(tri, p)
                inverses[key] = (matrix, pseudo_inverse(matrix))
            matrix, inverse = inverses[key]
            if method == "bcs":
                coef, used, sigma2, converged, steps = sparse_bayes(matrix, b, spread, count, centre, tolerance)
            else:
                used, converged, steps = np.ones(p, dtype=bool), True, 0
                if count < p:  # the minimum norm counts the constant too
                    coef = solve_normal(matrix, b + centre * matrix[:, 0], inverse)
                    sse = 0.0
                else:
                    coef = solve_normal(matrix, b, inverse)
                    sse = max(spread - coef @ b, 0.0)
                    coef[0] += centre
                freedom = count - p - (2 if method == "anl" else 0)
                sigma2 = sse / freedom if freedom > 0 else 0.0
            row = (coef.tolist(), used.tolist(), float(sigma2), converged, steps)
            rows.append((*row, inverse[np.tril_indices(p)].tolist()) if covariance else row)
        return pd.DataFrame(rows, columns=["coef", "used", "sigma2", "converged", "steps", *(["ginv"] if covariance else [])])

    return solve


def fit(statistics: DataFrame, groups: Sequence[str], method: str = "lsq", tolerance: float = DEFAULT_TOLERANCE, underdetermined: str = "min_norm", covariance: bool = False) -> DataFrame:
    """Coefficients per (group, output): coef, used, sigma2, converged and steps beside the sums.

    ``covariance`` adds the lower triangle of the inverse Gram matrix for prediction variances.

    ``lsq`` and ``anl`` share the coefficients; ``anl`` takes the noise variance as the
    posterior mean SSE/(n-P-2).  ``bcs`` keeps a sparse set of terms and tells whether and after how many steps it converged.  With fewer samples
    than terms the minimum-norm solution is returned, or an error on request.
    """
    if method not in METHODS:
        raise ValueError(f"unknown regression {method!r}, expected one of {METHODS}")
    if underdetermined not in ("min_norm", "error"):
        raise ValueError(f"unknown choice {underdetermined!r}, expected 'min_norm' or 'error'")
    solved = _solver(method, tolerance, underdetermined, covariance)("gram", "rhs", "syy", "mean", "n")
    return statistics.withColumn("_fit", solved).select(*groups, "output_id", "_fit.*", "n", "syy", "mean")


# --- use and quality of a fit -------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def dot_terms(phi: Column, coef: Column, n_terms: int) -> Column:
    """Σ c·Φ as plain arithmetic while the terms are few, so it stays in generated code."""
    if n_terms > GENERATED_TERMS:
        return dot(phi, coef)
    total = phi[0] * coef[0]
    for t in range(1, n_terms):
        total = total + phi[t] * coef[t]
    return total


def every_fit(points: DataFrame, coefs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every point with every fit, for the operators whose result is exactly that product.

    Fits are model parameters, not data: they are gathered into one array of bounded size
    and unrolled in the row, slice by slice when there are very many of them.
    """
    fits = materialize(coefs.select(F.struct(*columns).alias("f"), F.pmod(F.xxhash64("output_id"), F.lit(2**31)).alias("h")), "fits")
    slices = -(-measure(fits)[1] // SLICE_BYTES) or 1
    out = None
    for k in range(slices):
        part = fits.where(F.pmod("h", F.lit(slices)) == k).agg(F.array_sort(F.collect_list("f")).alias("fits"))
        rows = points.select("*", F.inline(part.select("fits").scalar()))
        out = rows if out is None else out.unionByName(rows)
    return out


def predict(points: DataFrame, coefs: DataFrame, groups: Sequence[str] = (), phi: str = "phi", keep: Sequence[str] = ("output_id", "coef"), n_terms: int = 0) -> DataFrame:
    """ŷ for points that carry ``phi``: joined to the fits on the shared group columns.

    With the number of terms given, a short product stays in generated code.
    """
    if groups:
        joined = points.join(checked_broadcast(coefs.select(*groups, *[c for c in keep if c not in groups])), list(groups))
    else:
        joined = every_fit(points, coefs, list(keep))
    return joined.withColumn("yhat", dot_terms(F.col(phi), F.col("coef"), n_terms) if n_terms else dot(F.col(phi), F.col("coef")))


def predict_variance(phi: Column, ginv: Column, sigma2: Column, noise: bool = False) -> Column:
    """σ²(φᵀG⁻¹φ), plus σ² itself when the observation noise is included, in numpy blocks.

    For rows that already carry the lower triangle of the inverse, such as one point per fit; many points
    per fit meet it once per block in ``qr.scored``.
    """

    @pandas_udf(T.DoubleType())
    def quadratic(phi: pd.Series, ginv: pd.Series) -> pd.Series:
        rows = np.stack(phi.to_numpy()) if len(phi) else np.zeros((0, 1))
        lower = np.tril_indices(rows.shape[1])
        weight = np.where(lower[0] == lower[1], 1.0, 2.0)
        return pd.Series([float((row[lower[0]] * row[lower[1]] * weight) @ np.asarray(g)) for row, g in zip(rows, ginv)])

    return sigma2 * (quadratic(phi, ginv) + (1.0 if noise else 0.0))


def surrogate_std(coef: Column) -> Column:
    """Spread of a surrogate without fit information: root of Σ c² beyond the mean term."""
    rest = F.slice(coef, F.lit(2), F.greatest(F.size(coef) - 1, F.lit(0)))
    return F.sqrt(F.aggregate(rest, F.lit(0.0), lambda a, c: a + c * c))


def relative_error(df: DataFrame, groups: Sequence[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """‖y-ŷ‖/‖y‖ per group; a zero norm counts as 1."""
    e = F.col(y) - F.col(yhat)
    sums = df.groupBy(*groups).agg(F.sum(e * e).alias("_e"), F.sum(F.col(y) * F.col(y)).alias("_y"))
    norm = F.when(F.col("_y") > 0, F.sqrt("_y")).otherwise(1.0)
    return sums.select(*groups, (F.sqrt("_e") / norm).alias("relative_error"))


@pandas_udf(T.DoubleType())
def squared_error(coef: pd.Series, gram: pd.Series, rhs: pd.Series, syy: pd.Series, mean: pd.Series) -> pd.Series:
    """Sum of squared residuals of a fit on other samples, from the sums of those."""
    out = []
    for c, tri, b, spread, centre in zip(coef, gram, rhs, syy, mean):
        about = np.array(c)
        about[0] -= centre
        out.append(max(spread - 2 * about @ b + about @ unpack_gram(np.asarray(tri), len(about)) @ about, 0.0))
    return pd.Series(out, dtype=float)


def fit_quality(coefs: DataFrame, statistics: DataFrame | None = None) -> DataFrame:
    """R² and sparsity from the statistics alone, without another pass over the samples."""
    n = F.col("n")
    ss_tot = F.col("syy")
    ss_res = F.when(n > F.size("coef"), F.col("sigma2") * (n - F.size("coef"))).otherwise(0.0)
    small = F.size(F.filter("coef", lambda c: F.abs(c) > USED_COEFFICIENT))
    return coefs.withColumns({
        "r_squared": F.when(ss_tot > 0, 1.0 - ss_res / ss_tot).otherwise(0.0),
        "sparsity": 1.0 - small / F.size("coef"),
    })
