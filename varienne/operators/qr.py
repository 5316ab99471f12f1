"""Regression from orthogonal factors instead of sums of products.

Every task keeps one triangular factor of its rows per group; factors are merged in a tree.  Forming the Gram matrix would square the
condition number and lose residuals below 1e-8 of the values; the factors keep both.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varienne.functions.basis import PolynomialBasis
from varienne.operators.fit import BUFFERED_VALUES, FIT_TYPE, present
from varienne.session import hint_if_small, materialize

#: Factors that meet in one merge.
FAN_IN = 32
#: Rows of a group that meet its fit in one block.
BLOCK_ROWS = 50_000
#: Singular values below this share of the largest count as zero.
RANK_CUTOFF = 1e-13


class Factor:
    """R of the basis rows, Q'Y of the outputs and the squares that lie outside the basis."""

    def __init__(self, r: np.ndarray, z: np.ndarray, outside: np.ndarray, n: int):
        self.r, self.z, self.outside, self.n = r, z, outside, n

    @classmethod
    def of_rows(cls, phi: np.ndarray, y: np.ndarray) -> Factor:
        p = phi.shape[1]
        q, r = np.linalg.qr(phi)
        z = q.T @ y
        rest = y - q @ z
        again = q.T @ rest  # once more: what rounding left inside the basis
        z, rest = z + again, rest - q @ again
        k = len(r)
        out = cls(np.zeros((p, p)), np.zeros((p, y.shape[1])), (rest**2).sum(0), len(phi))
        out.r[:k], out.z[:k] = r, z
        return out

    def merged(self, *others: Factor) -> Factor:
        parts = [self, *others]
        out = Factor.of_rows(np.vstack([f.r for f in parts]), np.vstack([f.z for f in parts]))
        out.outside = out.outside + sum(f.outside for f in parts)
        out.n = sum(f.n for f in parts)
        return out

    def row(self) -> tuple:
        return self.n, self.r.ravel().tolist(), self.z.ravel().tolist(), self.outside.tolist()

    @classmethod
    def of_row(cls, n, r, z, outside) -> Factor:
        m = len(outside)
        p = int(round(len(r) ** 0.5))
        return cls(np.asarray(r).reshape(p, p), np.asarray(z).reshape(p, m), np.asarray(outside), int(n))

    def solve(self) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients (terms, outputs), of least norm where they are not unique, and squared residuals."""
        u, s, v = np.linalg.svd(self.r)
        keep = s > RANK_CUTOFF * s[0] if len(s) else np.zeros(0, bool)
        coef = v[keep].T @ ((u[:, keep].T @ self.z) / s[keep, None])
        left = self.z - self.r @ coef
        return coef, self.outside + (left**2).sum(0)


def _factor_schema(df: DataFrame, groups: Sequence[str]) -> T.StructType:
    schema = df.select(*groups).schema.add("_part", T.LongType()).add("n", T.LongType())
    for name in ("r", "z", "outside"):
        schema = schema.add(name, T.ArrayType(T.DoubleType()))
    return schema


def qr_factors(df: DataFrame, basis: PolynomialBasis, germ: Sequence[Column], outputs: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """(groups, outputs, n, r, z, outside): one factor per group of the samples that have all outputs, merged from those of the tasks.

    A task holds one factor per group and hands factors on early when there are very many groups.  Merges take ``FAN_IN`` factors, so neither a task nor a row
    grows with the data.  Outputs that miss samples (null or NaN) get factors of their own samples.
    """
    missing = df.agg(*[F.sum((~present(o)).cast("bigint")).alias(f"m{j}") for j, o in enumerate(outputs)]).first()
    whole = [o for o, m in zip(outputs, missing) if not m]
    parts = [(whole, df)] if whole else []
    parts += [([o], df.where(present(o))) for o, m in zip(outputs, missing) if m]
    out = None
    for names, rows in parts:
        part = _merged(_task_factors(rows, basis, germ, names, groups), groups).withColumn("outputs", F.array(*[F.lit(n) for n in names]))
        out = part if out is None else out.unionByName(part)
    return out


def _task_factors(df, basis, germ, outputs, groups) -> DataFrame:
    d, m, p, groups = len(germ), len(outputs), basis.n_terms, list(groups)
    inputs = df.select(*groups, *[g.alias(f"_g{i}") for i, g in enumerate(germ)], *[F.col(o).cast("double").alias(f"_y{j}") for j, o in enumerate(outputs)])
    limit = max(1, BUFFERED_VALUES // (p * (p + m)))
    columns = [*groups, "_part", "n", "r", "z", "outside"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Factor] = {}
        part = TaskContext.get().partitionId() << 32

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(*key, part, *f.row()) for key, f in held.items()], columns=columns)

        for batch in batches:
            for key, frame in batch.groupby(groups, dropna=False, sort=False) if groups else [((), batch)]:
                if len(frame):
                    phi = basis.matrix(frame[[f"_g{i}" for i in range(d)]].to_numpy(dtype=float))
                    factor = Factor.of_rows(phi, frame[[f"_y{j}" for j in range(m)]].to_numpy(dtype=float))
                    held[key] = held[key].merged(factor) if key in held else factor
            if len(held) > limit:
                yield rows()
                held, part = {}, part + 1
        if held:
            yield rows()

    return inputs.mapInPandas(run, _factor_schema(df, groups))


def _merged(factors: DataFrame, groups: Sequence[str]) -> DataFrame:
    """One factor per group, by rounds of merges of at most about ``FAN_IN``."""
    groups = list(groups)
    schema = _factor_schema(factors, groups)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [Factor.of_row(*x) for x in zip(frame["n"], frame["r"], frame["z"], frame["outside"])]
        whole = parts[0].merged(*parts[1:]) if len(parts) > 1 else parts[0]
        first = frame.iloc[0]
        return pd.DataFrame([(*[first[g] for g in groups], first["_part"], *whole.row())], columns=schema.names)

    while True:
        factors = materialize(factors, "factors")
        most = factors.groupBy(*groups).agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0] or 0
        if most <= 1:
            return factors.drop("_part")
        bins = -(-most // FAN_IN)
        factors = factors.withColumn("_bin", F.pmod(F.xxhash64("_part"), F.lit(bins)) if bins > 1 else F.lit(0))
        factors = factors.groupBy(*groups, "_bin").applyInPandas(merge, schema)


def fit_qr(factors: DataFrame, groups: Sequence[str] = (), method: str = "lsq") -> DataFrame:
    """Coefficients per (group, output) like ``fit.fit``, with the sum of squared residuals in ``sse``.

    A basis whose terms depend on each other gives the solution of least norm.
    """
    if method not in ("lsq", "anl"):
        raise ValueError(f"unknown regression {method!r}, expected 'lsq' or 'anl'")
    groups = list(groups)
    schema = T.StructType([*factors.select(*groups).schema.fields, T.StructField("output_id", T.StringType()), *T.StructType.fromDDL(FIT_TYPE).fields,
                           T.StructField("n", T.LongType()), T.StructField("syy", T.DoubleType()), T.StructField("mean", T.DoubleType()), T.StructField("sse", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for _, x in batch.iterrows():
                factor = Factor.of_row(x["n"], x["r"], x["z"], x["outside"])
                coef, sse = factor.solve()
                p, n = len(coef), factor.n
                freedom = n - p - (2 if method == "anl" else 0)
                # The first term is the constant: its row of R and Q'Y holds the means.
                means = factor.z[0] / factor.r[0, 0]
                spread = (factor.z[1:] ** 2).sum(0) + factor.outside
                for j, name in enumerate(x["outputs"]):
                    rows.append((*[x[g] for g in groups], name, coef[:, j].tolist(), [True] * p, float(sse[j] / freedom) if freedom > 0 else 0.0, True, 0, n,
                                 float(spread[j]), float(means[j]), float(sse[j])))
            yield pd.DataFrame(rows, columns=schema.names)

    return factors.mapInPandas(run, schema)


def scored(
    df: DataFrame, factors: DataFrame, basis: PolynomialBasis, germ: Sequence[Column], groups: Sequence[str] = (), keep: Sequence[str] = (), block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(groups, keep, output_id, yhat, leverage, sigma2): predictions of the fits and what they depend on, for every row and output.

    leverage is the row's entry on the diagonal of the hat matrix, the squared length of its basis row against R; sigma2 times it is the variance of the
    prediction.  Rows of a group are dealt to blocks, and every block meets the factor of its group once, so no row carries a matrix.
    """
    groups, keep = list(groups), list(keep)
    d = len(germ)
    factors = materialize(factors, "factors")
    blocks = materialize(df.groupBy(*groups).agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("_blocks")), "blocks")
    inputs = df.select(*groups, *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], *[g.alias(f"_g{i}") for i, g in enumerate(germ)])
    if groups:
        inputs, models = inputs.join(hint_if_small(blocks), groups), factors.join(hint_if_small(blocks), groups)
    else:
        inputs, models = (x.withColumn("_blocks", blocks.select("_blocks").scalar()) for x in (inputs, factors))
    inputs = inputs.withColumn("_block", F.pmod(F.xxhash64(*[f"_k{i}" for i in range(len(keep))], *[f"_g{i}" for i in range(d)]), F.col("_blocks")).cast("int"))
    models = models.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    kinds = df.select(*groups, *keep).schema
    schema = T.StructType([*kinds.fields, T.StructField("output_id", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("yhat", "leverage", "sigma2")]])

    def run(key, rows: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        out = []
        phi = basis.matrix(rows[[f"_g{i}" for i in range(d)]].to_numpy(dtype=float)) if len(rows) else None
        for _, x in models.iterrows() if len(rows) else ():
            factor = Factor.of_row(x["n"], x["r"], x["z"], x["outside"])
            coef, sse = factor.solve()
            u, s, v = np.linalg.svd(factor.r)
            inside = s > RANK_CUTOFF * s[0]
            leverage = ((phi @ v[inside].T / s[inside]) ** 2).sum(1)
            freedom = factor.n - len(coef)
            for j, name in enumerate(x["outputs"]):
                frame = rows[[*groups, *[f"_k{i}" for i in range(len(keep))]]].copy()
                frame.columns = [*groups, *keep]
                frame["output_id"], frame["yhat"], frame["leverage"] = name, phi @ coef[:, j], leverage
                frame["sigma2"] = sse[j] / freedom if freedom > 0 else 0.0
                out.append(frame)
        return pd.concat(out)[schema.names] if out else pd.DataFrame({c: [] for c in schema.names})

    on = [*groups, "_block"]
    return inputs.drop("_blocks").groupBy(*on).cogroup(models.drop("_blocks").groupBy(*on)).applyInPandas(run, schema)


def leave_one_out(scores: DataFrame, groups: Sequence[str] = (), y: str = "y") -> DataFrame:
    """Exact relative error per (group, output) with every sample predicted by the fit without it.

    The residual without a sample is its residual over 1 - leverage.  Samples that alone determine a term (leverage 1) have no such
    prediction; they are counted in ``undetermined`` and left out.
    """
    spare = 1 - F.col("leverage")
    open_ = spare > 1e-10
    e = F.when(open_, (F.col(y) - F.col("yhat")) / spare)
    values = F.when(open_, F.col(y) * F.col(y))
    sums = scores.groupBy(*groups, "output_id").agg(F.sum(e * e).alias("_e"), F.sum(values).alias("_y"), F.sum((~open_).cast("bigint")).alias("undetermined"), F.count(F.lit(1)).alias("n"))
    return sums.select(*groups, "output_id", "n", (F.sqrt("_e") / F.when(F.col("_y") > 0, F.sqrt("_y")).otherwise(1.0)).alias("loo_error"), "undetermined")
