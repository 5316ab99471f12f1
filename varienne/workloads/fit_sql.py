"""SQL that solves the same least-squares problems by elimination on covariances."""

from __future__ import annotations

from collections.abc import Sequence

from varienne.functions.basis import PolynomialBasis, poly_coefficients


def term_sql(basis: PolynomialBasis, term: int, germ: Sequence[str]) -> str:
    """One basis function as an expression of the germ columns."""
    factors = []
    for g, degree in zip(germ, basis.indices[term]):
        if degree:
            coefs = poly_coefficients(basis.family, degree)
            factors.append("(" + " + ".join(f"{float(c)!r}::DOUBLE * {g} ** {k}" for k, c in enumerate(coefs) if c) + ")")
    return " * ".join(factors) if factors else "1.0::DOUBLE"


def fit_sql(source: str, basis: PolynomialBasis, germ: Sequence[str], keys: Sequence[str]) -> str:
    """SELECT keys, n, c0..cK, yy, sy, e2 (residual variance) from rows with keys, germ columns and y."""
    k = basis.n_terms - 1
    key = ", ".join(keys)
    terms = ", ".join(f"{term_sql(basis, t, germ)} AS f{t}" for t in range(1, k + 1))
    head = f"{key}, " if keys else ""
    group = f"GROUP BY {key}" if keys else ""
    covs = ", ".join(f"covar_pop(f{i}, f{j}) AS a{i}_{j}" for i in range(1, k + 1) for j in range(i, k + 1))
    rhs = ", ".join(f"covar_pop(f{i}, y) AS r{i}, avg(f{i}) AS m{i}" for i in range(1, k + 1))
    sql = f"SELECT {head}count(*) AS n, avg(y) AS my, var_pop(y) AS vy, sum(y * y) AS yy, sum(y) AS sy, {covs}, {rhs} FROM (SELECT {head}y, {terms} FROM ({source})) {group}"
    # b<i> keeps the right-hand side for the residual
    sql = f"SELECT *, {', '.join(f'r{i} AS b{i}' for i in range(1, k + 1))} FROM ({sql})"
    for p in range(1, k + 1):
        updated = [f"r{i} - a{p}_{i} / a{p}_{p} * r{p} AS r{i}" for i in range(p + 1, k + 1)]
        updated += [f"a{i}_{j} - a{p}_{i} / a{p}_{p} * a{p}_{j} AS a{i}_{j}" for i in range(p + 1, k + 1) for j in range(i, k + 1)]
        if updated:
            sql = f"SELECT * REPLACE ({', '.join(updated)}) FROM ({sql})"
    for p in range(k, 0, -1):
        rest = " ".join(f"- a{p}_{j} * c{j}" for j in range(p + 1, k + 1))
        sql = f"SELECT *, (r{p} {rest}) / a{p}_{p} AS c{p} FROM ({sql})"
    c0 = "my " + " ".join(f"- c{i} * m{i}" for i in range(1, k + 1))
    e2 = "vy " + " ".join(f"- c{i} * b{i}" for i in range(1, k + 1))
    coefs = ", ".join(f"c{i}" for i in range(1, k + 1))
    return f"SELECT {head}n, yy, sy, my, vy, {c0} AS c0{', ' if k else ''}{coefs}, {e2} AS e2 FROM ({sql})"


def share_sql(basis: PolynomialBasis, wanted) -> str:
    """Share of variance of the terms a predicate selects."""
    weight = lambda t: f"c{t} * c{t} * {float(basis.norms[t])!r}::DOUBLE"
    top = " + ".join(weight(t) for t in range(1, basis.n_terms) if wanted(basis.indices[t])) or "0.0::DOUBLE"
    return f"({top}) / ({' + '.join(weight(t) for t in range(1, basis.n_terms))})"


def sobol_sql(fits: str, basis: PolynomialBasis, keys: Sequence[str]) -> str:
    """SELECT keys, param_id, param, s1, st in long form."""
    parts = []
    for i, name in enumerate(basis.params):
        first = share_sql(basis, lambda a: a[i] and sum(1 for e in a if e) == 1)
        total = share_sql(basis, lambda a: a[i])
        parts.append(f"SELECT {', '.join(keys)}, CAST({i} AS INTEGER) AS param_id, '{name}' AS param, {first} AS s1, {total} AS st FROM f")
    return f"WITH f AS ({fits}) " + " UNION ALL ".join(parts)


def predict_sql(basis: PolynomialBasis, germ: Sequence[str]) -> str:
    return " + ".join(f"c{t} * {term_sql(basis, t, germ)}" for t in range(basis.n_terms))
