"""Designs, screening and Monte-Carlo index queries."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from varienne.functions import rng
from varienne.functions.basis import PolynomialBasis
from varienne.operators import design, morris, sobol
from varienne.plans import sampling
from varienne.sources import synthetic
from varienne.workloads.fit_sql import fit_sql, predict_sql
from varienne.workloads.registry import query, rnd, rounded, sr
from varienne.workloads.surrogates import drawn_sql, uniform_sql
from varienne.workloads.tables import LINEITEM_BOUNDS

BOUNDS = LINEITEM_BOUNDS
NAMES = list(BOUNDS)
D = len(NAMES)


def order_ids(t):
    return t.orders.select(F.col("o_orderkey").alias("sample_id"))


ORDER_IDS = "SELECT o_orderkey AS sample_id FROM orders"


@query("sample_uniform", f"""
SELECT sample_id, {sr('l_discount', 9)} AS l_discount, {sr('l_tax', 9)} AS l_tax, {sr('l_quantity', 7)} AS l_quantity FROM ({drawn_sql(ORDER_IDS, 'sample_id', 42)})""")
def _sample_uniform(t):
    return rounded(design.sample_uniform(order_ids(t), BOUNDS, 42), 9, l_quantity=7)


def lhs_sql(seed: int, bounds) -> str:
    return " UNION ALL ".join(f"""
SELECT sample_id, '{n}' AS name, {lo!r}::DOUBLE + (row_number() OVER (ORDER BY h, sample_id) - 1 + j) / (SELECT count(*) FROM orders) * {hi - lo!r}::DOUBLE AS x
FROM (SELECT sample_id, {uniform_sql(seed, "'stratum'", repr(n), 'sample_id')} AS h, {uniform_sql(seed, "'jitter'", repr(n), 'sample_id')} AS j FROM ({ORDER_IDS}))"""
        for n, (lo, hi) in bounds.items())


@query("sample_lhs", f"SELECT sample_id, name, {sr('x', 8)} AS x FROM ({lhs_sql(3, BOUNDS)})")
def _sample_lhs(t):
    return rounded(design.sample_lhs(order_ids(t), BOUNDS, 3), 8)


LEVELS = 4
DELTA = LEVELS / (2.0 * (LEVELS - 1))


def trajectories(t):
    return t.customer.select(F.col("c_custkey").alias("traj_id"))


def morris_sql() -> str:
    base = ", ".join(f"floor({uniform_sql(5, chr(39) + 'base' + chr(39), repr(n), 'traj_id')} * {LEVELS - 1}) / {LEVELS - 1}.0::DOUBLE AS b{i}" for i, n in enumerate(NAMES))
    draw = ", ".join(f"{uniform_sql(5, chr(39) + 'order' + chr(39), repr(n), 'traj_id')} AS h{i}" for i, n in enumerate(NAMES))
    rank = ", ".join("1 + " + " + ".join(f"CASE WHEN h{j} < h{i} THEN 1 ELSE 0 END" for j in range(D) if j != i) + f" AS p{i}" for i in range(D))
    unit = ", ".join(f"b{i} + CASE WHEN p{i} <= step THEN CASE WHEN b{i} + {DELTA!r}::DOUBLE <= 1 THEN {DELTA!r}::DOUBLE ELSE -{DELTA!r}::DOUBLE END ELSE 0 END AS u{i}" for i in range(D))
    return f"""SELECT traj_id, step, {', '.join(f'p{i}' for i in range(D))}, {unit} FROM (
      SELECT *, unnest(range({D + 1})) AS step FROM (SELECT *, {rank} FROM (SELECT traj_id, {base}, {draw} FROM (SELECT c_custkey AS traj_id FROM customer))))"""


MORRIS_SQL = morris_sql()
SCALED = {n: f"({lo!r}::DOUBLE + u{i} * {hi - lo!r}::DOUBLE)" for i, (n, (lo, hi)) in enumerate(BOUNDS.items())}
CHANGED_SQL = "CASE " + " ".join(f"WHEN p{i} = step THEN '{n}'" for i, n in enumerate(NAMES)) + " END"


@query("morris_design", f"""
SELECT traj_id, CAST(step AS INTEGER) AS step, {CHANGED_SQL} AS changed, {', '.join(f'{sr(e, 8)} AS {n}' for n, e in SCALED.items())} FROM ({MORRIS_SQL})""")
def _morris_design(t):
    out = design.morris_design(trajectories(t), BOUNDS, 5, LEVELS)
    return rounded(out.drop("unit"), 8)


def model_column(names=NAMES):
    """Test model of the screening queries: nonlinear in quantity, linear in tax, discount almost inert."""
    d, x, q = (F.col(n) for n in ("l_discount", "l_tax", "l_quantity"))
    return 0.02 * q * q + 400.0 * x + 30.0 * x * q + 0.5 * d


MODEL_SQL = "0.02::DOUBLE * q * q + 400 * x + 30 * x * q + 0.5::DOUBLE * d"
EFFECTS_SQL = f"""
SELECT traj_id, param, CAST(CASE param WHEN 'l_discount' THEN 0 WHEN 'l_tax' THEN 1 ELSE 2 END AS INTEGER) AS param_id,
  (y - y0) / ((u - v) * CASE param WHEN 'l_discount' THEN 0.1 WHEN 'l_tax' THEN 0.08 ELSE 49 END) AS ee FROM (
  SELECT traj_id, step, {CHANGED_SQL} AS param, y, lag(y) OVER w AS y0,
    CASE {' '.join(f'WHEN p{i} = step THEN u{i}' for i in range(D))} END AS u, CASE {' '.join(f'WHEN p{i} = step THEN lag(u{i}) OVER w' for i in range(D))} END AS v
  FROM (SELECT *, {MODEL_SQL} AS y FROM (SELECT *, {SCALED['l_discount']} AS d, {SCALED['l_tax']} AS x, {SCALED['l_quantity']} AS q FROM ({MORRIS_SQL})))
  WINDOW w AS (PARTITION BY traj_id ORDER BY step)) WHERE step > 0"""
INDICES_SQL = f"SELECT param_id, param, avg(ee) AS mu, avg(abs(ee)) AS mu_star, stddev_pop(ee) AS sigma FROM ({EFFECTS_SQL}) GROUP BY 1, 2"


def effects(t):
    walked = design.morris_design(trajectories(t), BOUNDS, 5, LEVELS).withColumn("y", model_column())
    return morris.elementary_effects(walked, BOUNDS, "y")


@query("elementary_effects", f"SELECT traj_id, param_id, param, {sr('ee', 5)} AS ee FROM ({EFFECTS_SQL})")
def _elementary_effects(t):
    return rounded(effects(t), 5)


@query("morris_indices", f"SELECT param_id, param, {sr('mu', 5)} AS mu, {sr('mu_star', 5)} AS mu_star, {sr('sigma', 5)} AS sigma FROM ({INDICES_SQL})")
def _morris_indices(t):
    return rounded(morris.morris_indices(effects(t)), 5)


@query("morris_screen", f"""
WITH i AS ({INDICES_SQL}) SELECT param, category, rank FROM (
  SELECT param, mu_star, CASE WHEN mu_star / (m + 1e-10) < 0.1 THEN 'negligible' WHEN sigma / (s + 1e-10) < 0.5 THEN 'linear' ELSE 'nonlinear' END AS category,
    CAST(row_number() OVER (ORDER BY mu_star DESC, param_id) AS INTEGER) AS rank, m FROM i, (SELECT max(mu_star) AS m, max(sigma) AS s FROM i))
WHERE mu_star >= 0.1 * m""")
def _morris_screen(t):
    labelled = morris.classify(morris.morris_indices(effects(t)))
    return morris.screen(labelled).select("param", "category", "rank")


@query("parameter_config", f"""
WITH i AS ({INDICES_SQL}), p AS (SELECT 'l_discount' AS param, 0.0::DOUBLE AS lo, max(l_discount) AS hi FROM lineitem
  UNION ALL SELECT 'l_tax', 0.0, max(l_tax) FROM lineitem UNION ALL SELECT 'l_quantity', 0.0, max(l_quantity) FROM lineitem)
SELECT param, lo, hi, {sr('hi / 2')} AS "default", {sr("CASE WHEN s < 1.5 THEN 1 WHEN s < 3.5 THEN 2 WHEN s < 7.5 THEN 5 ELSE 10 END * m", 9)} AS step FROM (
  SELECT *, power(10, floor(log10(hi / 50))) AS m, hi / 50 / power(10, floor(log10(hi / 50))) AS s FROM p) WHERE param IN (SELECT param FROM i ORDER BY mu_star DESC LIMIT 2)""")
def _parameter_config(t):
    bounds = t.lineitem.agg(*[F.max(n).alias(n) for n in NAMES])
    bounds = bounds.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(0.0).alias("lo"), F.col(n).alias("hi")) for n in NAMES])))
    top = morris.screen(morris.morris_indices(effects(t)), top_n=2)
    out = morris.parameter_config(top.select("param"), bounds)
    return rounded(out, 6, step=9)


@query("saltelli_design", " UNION ALL ".join(
    f"SELECT sample_id, '{b}' AS block, " + ", ".join(
        sr(f"{lo!r}::DOUBLE + {uniform_sql(9, repr('B' if (b == 'B' or b == 'AB_' + n or (b[:3] == 'BA_' and b != 'BA_' + n)) else 'A'), repr(n), 'sample_id')} * {hi - lo!r}::DOUBLE", 8) + f" AS {n}"
        for n, (lo, hi) in BOUNDS.items()) + f" FROM ({ORDER_IDS})"
    for b in ["A", "B", *[f"AB_{n}" for n in NAMES], *[f"BA_{n}" for n in NAMES]]))
def _saltelli_design(t):
    return rounded(design.saltelli_design(order_ids(t), BOUNDS, 9), 8)


def unit_model(block: str) -> str:
    cols = []
    for n, (lo, hi) in BOUNDS.items():
        side = "B" if (block == "B" or block == "AB_" + n) else "A"
        cols.append(f"({lo!r}::DOUBLE + {uniform_sql(9, repr(side), repr(n), 'sample_id')} * {hi - lo!r}::DOUBLE)")
    return MODEL_SQL.replace(" q", f" {cols[2]}").replace(" x", f" {cols[1]}").replace(" d", f" {cols[0]}")


@query("sobol_mc", f"""
WITH e AS (SELECT sample_id, {unit_model('A')} AS a, {unit_model('B')} AS b, {', '.join(f"{unit_model('AB_' + n)} AS ab{i}" for i, n in enumerate(NAMES))} FROM ({ORDER_IDS})),
v AS (SELECT var_pop(y) AS v FROM (SELECT a AS y FROM e UNION ALL SELECT b FROM e))
""" + " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS param_id, '{n}' AS param, {sr(f'avg(b * (ab{i} - a)) / max(v)', 6)} AS s1, {sr(f'avg((a - ab{i}) ** 2) / 2 / max(v)', 6)} AS st FROM e, v"
    for i, n in enumerate(NAMES)))
def _sobol_mc(t):
    evaluated = design.saltelli_design(order_ids(t), BOUNDS, 9, second_order=False).withColumn("y", model_column())
    return rounded(sobol.sobol_mc(evaluated, NAMES, ["y"]).drop("output_id"), 6)


@query("evaluate_design", f"""
SELECT sample_id, {sr(MODEL_SQL, 6)} AS y FROM (SELECT sample_id, l_discount AS d, l_tax AS x, l_quantity AS q FROM ({drawn_sql(ORDER_IDS, 'sample_id', 42)}))""")
def _evaluate_design(t):
    def model(frame):
        d, x, q = frame["l_discount"], frame["l_tax"], frame["l_quantity"]
        return np.asarray(0.02 * q * q + 400.0 * x + 30.0 * x * q + 0.5 * d)

    out = design.evaluate_design(design.sample_uniform(order_ids(t), BOUNDS, 42), model, ["y"], NAMES)
    return out.select("sample_id", rnd("y", 6).alias("y"))


COUPLING = design.coupling_matrix(2, D, 11)
SURFACE_SQL = ", ".join(
    f"m{k} + s{k} * ({' + '.join(f'{float(COUPLING[k][i])!r}::DOUBLE * (2 * (({n}) - {lo!r}::DOUBLE) / {hi - lo!r}::DOUBLE - 1)' for i, (n, (lo, hi)) in enumerate(BOUNDS.items()))}) AS y{k}"
    for k in range(2))


@query("response_surface", f"""
SELECT l_orderkey, l_linenumber, {sr('y0', 5)} AS y0, {sr('y1', 5)} AS y1 FROM (SELECT l_orderkey, l_linenumber, {SURFACE_SQL} FROM lineitem, (
  SELECT avg(l_extendedprice) AS m0, stddev_pop(l_extendedprice) AS s0, avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1 FROM lineitem))""")
def _response_surface(t):
    s = t.lineitem.agg(*[f(c).alias(f"{n}{k}") for k, c in enumerate(("l_extendedprice", "l_quantity")) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scalar = lambda c: s.select(c).scalar()
    out = design.response_surface(t.lineitem, BOUNDS, [scalar("m0"), scalar("m1")], [scalar("s0"), scalar("s1")], COUPLING)
    return rounded(out.select("l_orderkey", "l_linenumber", "y0", "y1"), 5)


@query("encode_variants", """
SELECT p_partkey, '{"process.size":' || CAST(p_size AS VARCHAR) || '.0,"mass.price":{"__index__":3,"__value__":' || CAST(p_size * 2 AS VARCHAR) || '.0}}' AS mutations FROM part""")
def _encode_variants(t):
    parts = t.part.select("p_partkey", "p_size", (F.col("p_size") * 2).alias("price"))
    return design.encode_variants(parts, ["p_size", "price"], {"p_size": "process.size", "price": "mass.price"}, "p_partkey", {"price": 3})


def _draw_sql(tag: str, i: int) -> str:
    """The uniform draw of one array element."""
    return f"CAST('0x' || substr(md5('1:{tag}:{i}:' || CAST(o_orderkey AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"


#: Cumulative probabilities of a Poisson count of mean 5, as far as the draws of this size can reach.
POISSON_SQL = "[" + ", ".join(f"{math.fsum(math.exp(-5.0) * 5.0**j / math.factorial(j) for j in range(k + 1))!r}::DOUBLE" for k in range(30)) + "]"


@query("synthetic_history", f"""
SELECT o_orderkey, {sr('power(2, t)', 8)} AS growth_curve, {sr("CASE WHEN t <= 0.3 THEN 0.03 WHEN t >= 0.7 THEN 0.06 ELSE 0.03 + 0.03 * (t - 0.3) / 0.4 END", 9)} AS dna_mass,
  {sr('0.01 * (1 + 0.2 * sin(2 * pi() * t))', 9)} AS growth,
  [{', '.join(f"CAST(len(list_filter({POISSON_SQL}, lambda c: c <= {_draw_sql('count', i)})) AS DOUBLE)" for i in range(3))}] AS counts,
  [{', '.join(sr(f"-ln(1 - {_draw_sql('flux', i)})", 9) for i in range(2))}] AS fluxes FROM (SELECT o_orderkey, (o_orderkey % 20) / 20.0::DOUBLE AS t FROM orders)""")
def _synthetic_history(t):
    index = t.orders.select(
        "o_orderkey", F.col("o_orderkey").cast("string").alias("row_key"), (F.col("o_orderkey") % 20).alias("step"), F.lit(20).alias("n_steps"))
    out = synthetic.synthesize(index, seed=1, n_counts=3, n_fluxes=2)
    noise = 1.0 + 0.05 * rng.normal(1, F.col("o_orderkey").cast("string"))
    numbers = lambda c: F.from_json(c, "array<double>")
    return out.select(
        "o_orderkey", rnd(F.col("listeners__mass__dry_mass") / noise, 8).alias("growth_curve"),
        rnd("listeners__mass__dna_mass", 9).alias("dna_mass"), rnd("listeners__fba_results__growth", 9).alias("growth"),
        numbers("listeners__rna_counts__mRNA_cistron_counts").alias("counts"), F.transform(numbers("listeners__fba_results__base_reaction_fluxes"), lambda v: rnd(v, 9) + 0.0).alias("fluxes"))


KEPT = {n: BOUNDS[n] for n in ("l_tax", "l_quantity")}
KEPT_BASIS = PolynomialBasis(tuple(KEPT), 2)
KEPT_SQL = "SELECT sample_id, " + ", ".join(
    f"max(CASE WHEN name = '{n}' THEN 2 * (x - {lo!r}::DOUBLE) / {hi - lo!r}::DOUBLE - 1 END) AS g{i}, max(CASE WHEN name = '{n}' THEN x END) AS {n}" for i, (n, (lo, hi)) in enumerate(KEPT.items())
) + f" FROM ({lhs_sql(42, KEPT)}) GROUP BY sample_id"
SCREENED_SQL = fit_sql(
    f"SELECT g0, g1, 0.02::DOUBLE * l_quantity * l_quantity + 400 * l_tax + 30 * l_tax * l_quantity + 0.5::DOUBLE * 0.05 AS y FROM ({KEPT_SQL})", KEPT_BASIS, ["g0", "g1"], [])


@query("screened_surrogate", f"""
SELECT 'y' AS output_id, CAST(t AS INTEGER) AS term_id, {sr('c')} AS coef, n FROM (
  SELECT n, unnest(range({KEPT_BASIS.n_terms})) AS t, unnest([{', '.join(f'c{i}' for i in range(KEPT_BASIS.n_terms))}]) AS c FROM ({SCREENED_SQL}))""")
def _screened_surrogate(t):
    out = sampling.screened_surrogate(trajectories(t), order_ids(t), BOUNDS, model_column, keep=2, order=2, n_replicates=3)
    return out.fits.select("output_id", F.posexplode("coef").alias("term_id", "coef"), "n").withColumn("coef", rnd("coef"))


#: The error never gets this small, so the rounds follow from the budget alone.
UNREACHED = 1e-9
BUDGET_SQL = "(SELECT count(*) FROM orders)"
FIRST_SQL = f"CAST(floor({BUDGET_SQL} * 0.33) AS BIGINT)"
STEP_SQL = f"(({BUDGET_SQL} - {FIRST_SQL}) // 4)"
ROUNDS_SQL = f"SELECT CAST(r AS INTEGER) AS round, least({FIRST_SQL} + r * {STEP_SQL}, {BUDGET_SQL}) AS n_samples FROM range(6) t(r) WHERE r <= 4 OR {FIRST_SQL} + 4 * {STEP_SQL} < {BUDGET_SQL}"
ADAPTIVE_BASIS = PolynomialBasis(tuple(BOUNDS), 2)
ADAPTIVE_SQL = fit_sql(f"""
SELECT round, n_samples, {', '.join(f'2 * ({n} - {lo!r}::DOUBLE) / {hi - lo!r}::DOUBLE - 1 AS g{i}' for i, (n, (lo, hi)) in enumerate(BOUNDS.items()))},
  exp(l_quantity / 20) + 0.02::DOUBLE * l_quantity * l_quantity + 400 * l_tax + 30 * l_tax * l_quantity + 0.5::DOUBLE * l_discount AS y
FROM ({drawn_sql(f'SELECT unnest(range({BUDGET_SQL})) AS sample_id', 'sample_id', 42)}) JOIN ({ROUNDS_SQL}) ON sample_id < n_samples""",
    ADAPTIVE_BASIS, ["g0", "g1", "g2"], ["round", "n_samples"])


@query("adaptive_sampling", f"SELECT round, n_samples, {sr('sqrt(e2 * n / yy)', 8)} AS mean_error FROM ({ADAPTIVE_SQL})")
def _adaptive_sampling(t):
    """The budget grows with the orders table."""
    model = lambda df: df.withColumn("y", F.exp(F.col("l_quantity") / 20.0) + model_column())
    budget = t.orders.count()
    _, rounds = sampling.adaptive_sampling(t.spark, BOUNDS, model, ["y"], budget, order=2, tolerance=UNREACHED)
    return rounded(rounds, 8)


#: Shares of the lineitem table in nested samples, the response that is learned, and the error at which to stop.
SHARES = [min(2.0**k / 256, 1.0) for k in range(9)]
ENOUGH = 0.02
POSITION_SQL = "CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"
NESTED_SQL = f"""
SELECT {POSITION_SQL} AS position, {', '.join(f'2 * ({n} - {lo!r}::DOUBLE) / {hi - lo!r}::DOUBLE - 1 AS g{i}' for i, (n, (lo, hi)) in enumerate(BOUNDS.items()))},
  exp(l_quantity / 20) + 0.02::DOUBLE * l_quantity * l_quantity + 400 * l_tax + 30 * l_tax * l_quantity + 0.5::DOUBLE * l_discount AS y FROM lineitem"""
NESTED_ROUNDS_SQL = f"SELECT CAST(unnest(range({len(SHARES)})) AS INTEGER) AS round, unnest({SHARES!r})::DOUBLE AS share, unnest({[*SHARES[1:], 2.0]!r})::DOUBLE AS next"
NESTED_FIT_SQL = fit_sql("SELECT round, g0, g1, g2, y FROM n JOIN k ON share = 1 OR position < share", ADAPTIVE_BASIS, ["g0", "g1", "g2"], ["round"])


@query("adaptive_table", f"""
WITH n AS ({NESTED_SQL}), k AS ({NESTED_ROUNDS_SQL}), f AS ({NESTED_FIT_SQL}),
h AS (SELECT round, sqrt(sum((y - yhat) ** 2)) / sqrt(sum(y * y)) AS held FROM (
  SELECT round, y, {predict_sql(ADAPTIVE_BASIS, ['g0', 'g1', 'g2'])} AS yhat FROM f JOIN k USING (round) JOIN n ON position >= share AND (next >= 1 OR position < next) WHERE share < 1) GROUP BY 1),
e AS (SELECT round, share, CAST(n AS BIGINT) AS n_samples, sqrt(greatest(e2, 0) * n / yy) AS train, held FROM f JOIN k USING (round) LEFT JOIN h USING (round))
SELECT round, share, n_samples, {sr('train', 6)} AS train_error, {sr('held', 6)} AS held_out_error FROM e
WHERE round <= coalesce((SELECT min(round) FROM e WHERE held <= {ENOUGH}), {len(SHARES)})""")
def _adaptive_table(t):
    """Nested samples of the lineitem table until a held-out error of two percent."""
    position = F.conv(F.substring(F.md5(F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    table = t.lineitem.withColumn("y", F.exp(F.col("l_quantity") / 20.0) + model_column())
    _, rounds = sampling.adaptive_fit(table, ADAPTIVE_BASIS, design.germ_columns(BOUNDS), ["y"], position, ENOUGH)
    return rounded(rounds, 6, share=12)
