"""Polynomial bases: multi-indices, norms and basis columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from itertools import combinations_with_replacement
from math import comb, factorial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAMILIES = ("legendre", "hermite")


def graded_indices(n_params: int, order: int) -> list[tuple[int, ...]]:
    """All exponent tuples with total degree up to the order, lowest degree first."""
    terms = []
    for degree in range(order + 1):
        for factors in combinations_with_replacement(range(n_params), degree):
            terms.append(tuple(factors.count(i) for i in range(n_params)))
    return terms


def term_count(n_params: int, order: int) -> int:
    return comb(n_params + order, order)


def minimum_samples(n_params: int, order: int) -> int:
    """Sample-size rule of thumb: twice the number of terms."""
    return 2 * term_count(n_params, order)


def choose_order(n_params: int, n_samples: int) -> int:
    """Largest order whose sample-size rule still holds, at least 1."""
    order = 1
    while minimum_samples(n_params, order + 1) <= n_samples:
        order += 1
    return order


def choose_order_column(n_params: int, n_samples: Column) -> Column:
    """The same choice for a column of sample counts.

    With r the n_params-th root of n_params! * n / 2 the order lies between r - (n_params + 1) / 2 and r
    (arithmetic and geometric mean of the factors), so only the few orders in between are tried.
    """
    d = n_params
    root = F.pow(n_samples * float(factorial(d)) / 2.0, F.lit(1.0 / d))
    tried = F.sequence(F.greatest(F.floor(root - (d + 1) / 2) - 1, F.lit(1).cast("bigint")), F.greatest(F.floor(root) + 1, F.lit(1).cast("bigint")))

    def fits(p: Column) -> Column:
        terms = F.lit(1.0)
        for k in range(1, d + 1):
            terms = terms * (p + k)
        return 2.0 * terms <= n_samples * float(factorial(d))

    return F.greatest(F.coalesce(F.array_max(F.filter(tried, fits)), F.lit(1).cast("bigint")), F.lit(1).cast("bigint")).cast("int")


def poly_coefficients(family: str, degree: int) -> np.ndarray:
    """Monomial coefficients (lowest power first) of one basis polynomial."""
    unit = np.eye(degree + 1)[degree]
    if family == "legendre":
        return np.polynomial.legendre.leg2poly(unit)
    if family == "hermite":
        return np.polynomial.hermite_e.herme2poly(unit)
    raise ValueError(f"unknown polynomial family {family!r}, expected one of {FAMILIES}")


def poly_column(family: str, degree: int, x: Column) -> Column:
    """One basis polynomial in Horner form, a plain arithmetic expression."""
    coefs = [float(c) for c in poly_coefficients(family, degree)]
    value = F.lit(coefs[-1])
    for c in reversed(coefs[:-1]):
        value = value * x if c == 0.0 else value * x + F.lit(c)
    return value


@dataclass(frozen=True)
class PolynomialBasis:
    """Total-degree basis over named inputs."""

    params: tuple[str, ...]
    order: int
    family: str = "legendre"

    def __post_init__(self) -> None:
        if self.family not in FAMILIES:
            raise ValueError(f"unknown polynomial family {self.family!r}, expected one of {FAMILIES}")

    @cached_property
    def indices(self) -> list[tuple[int, ...]]:
        return graded_indices(len(self.params), self.order)

    @property
    def n_terms(self) -> int:
        return len(self.indices)

    @cached_property
    def norms(self) -> np.ndarray:
        """E[Φ²] under the input measure: U(-1,1) for Legendre, N(0,1) for Hermite."""
        alpha = np.array(self.indices)
        if self.family == "legendre":
            return np.prod(1.0 / (2 * alpha + 1), axis=1)
        return np.prod(np.vectorize(factorial)(alpha), axis=1).astype(float)

    def phi(self, germ: list[Column]) -> Column:
        """Basis row as ARRAY<DOUBLE>; inputs are columns scaled to the germ range."""
        if len(germ) != len(self.params):
            raise ValueError(f"expected {len(self.params)} inputs, got {len(germ)}")
        cols = []
        for alpha in self.indices:
            value = None
            for x, degree in zip(germ, alpha):
                if degree:
                    p = poly_column(self.family, degree, x)
                    value = p if value is None else value * p
            cols.append(F.lit(1.0) if value is None else value)
        return F.array(*cols)

    def matrix(self, germ: np.ndarray) -> np.ndarray:
        """The same basis evaluated on a numpy block, used inside Arrow tasks."""
        power = [
            [np.polynomial.polynomial.polyval(germ[:, i], poly_coefficients(self.family, n)) for n in range(self.order + 1)]
            for i in range(len(self.params))
        ]
        out = np.ones((germ.shape[0], self.n_terms))
        for t, alpha in enumerate(self.indices):
            for i, degree in enumerate(alpha):
                if degree:
                    out[:, t] *= power[i][degree]
        return out

    def gradient(self, germ: np.ndarray) -> np.ndarray:
        """Derivatives of the basis by every germ input: (points, inputs, terms)."""
        coefs = [poly_coefficients(self.family, n) for n in range(self.order + 1)]
        value = [[np.polynomial.polynomial.polyval(germ[:, i], c) for c in coefs] for i in range(len(self.params))]
        slope = [[np.polynomial.polynomial.polyval(germ[:, i], np.polynomial.polynomial.polyder(c)) for c in coefs] for i in range(len(self.params))]
        out = np.ones((germ.shape[0], len(self.params), self.n_terms))
        for t, alpha in enumerate(self.indices):
            for i in range(len(self.params)):
                for j, degree in enumerate(alpha):
                    out[:, i, t] *= slope[j][degree] if i == j else value[j][degree]
        return out

    def terms(self, spark: SparkSession) -> DataFrame:
        """Dimension table of terms: (term_id, alpha, norm2)."""
        rows = [(t, list(a), float(n)) for t, (a, n) in enumerate(zip(self.indices, self.norms))]
        return spark.createDataFrame(rows, "term_id int, alpha array<int>, norm2 double")
