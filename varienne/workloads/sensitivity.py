"""Design, basis, regression and sensitivity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from varienne.functions.basis import PolynomialBasis, choose_order_column
from varienne.operators import design, fit, qr, sobol, strategies
from varienne.operators.observables import DRY_MASS, VOLUME
from varienne.plans import quantify
from varienne.session import checked_broadcast
from varienne.workloads.aggregates import ARRAY_OUTPUTS_SQL, STAGE_MEANS_SQL, array_outputs, first_last_theta, group_means_sql
from varienne.workloads.fit_sql import fit_sql, predict_sql, share_sql, sobol_sql, term_sql
from varienne.workloads.registry import query, rnd, rounded, sr
from varienne.workloads.tables import DESIGN_SQL, GROWTH_SQL, LINEITEM_BOUNDS

PARAMS = tuple(LINEITEM_BOUNDS)
BASIS1 = PolynomialBasis(PARAMS, 1)
BASIS2 = PolynomialBasis(PARAMS, 2)
BASIS3 = PolynomialBasis(PARAMS, 3)
GERM = ["g0", "g1", "g2"]
OUTPUTS = ["y0", "y1"]
FLAG = ["l_returnflag"]

LONG_SQL = f"""SELECT l_returnflag, l_orderkey, l_linenumber, g0, g1, g2, unnest(['y0', 'y1']) AS output_id, unnest([y0, y1]) AS y FROM ({DESIGN_SQL})"""
FIT2_SQL = fit_sql(LONG_SQL, BASIS2, GERM, ["l_returnflag", "output_id"])
FIT1_SQL = fit_sql(LONG_SQL, BASIS1, GERM, ["l_returnflag", "output_id"])
FIT3_SQL = fit_sql(LONG_SQL, BASIS3, GERM, ["l_returnflag", "output_id"])
SOBOL2_SQL = sobol_sql(FIT2_SQL, BASIS2, ["l_returnflag", "output_id"])


def statistics(t, basis=BASIS2):
    return fit.wide_statistics(t.design, basis, design.germ_columns(LINEITEM_BOUNDS), OUTPUTS, FLAG)


def fitted(t, basis=BASIS2, method="lsq"):
    return fit.fit(statistics(t, basis), FLAG, method)


def indices(t, basis=BASIS2):
    return sobol.sobol_indices(fitted(t, basis), basis, FLAG)


# --- germ and basis ------------------------------------------------------------------


@query("physical_to_germ", f"""
SELECT l_orderkey, l_linenumber, name, {sr('germ', 9)} AS germ FROM (
  SELECT l_orderkey, l_linenumber, unnest(['l_discount', 'l_tax', 'l_quantity']) AS name, unnest([g0, g1, g2]) AS germ FROM ({DESIGN_SQL}))""")
def _physical_to_germ(t):
    from varienne.sources.params import params_table

    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("x")) for n in PARAMS])
    long = t.design.select("l_orderkey", "l_linenumber", F.inline(pairs))
    out = design.long_germ(long, params_table(t.spark, LINEITEM_BOUNDS))
    return rounded(out.select("l_orderkey", "l_linenumber", "name", "germ"), 9)


@query("germ_to_physical", """
SELECT l_orderkey, l_linenumber, l_discount, round(l_quantity, 8) + 0.0 AS l_quantity FROM lineitem""")
def _germ_to_physical(t):
    back = lambda n: design.from_germ(design.to_germ(F.col(n), *LINEITEM_BOUNDS[n]), *LINEITEM_BOUNDS[n])
    return t.lineitem.select("l_orderkey", "l_linenumber", rnd(back("l_discount"), 8).alias("l_discount"), rnd(back("l_quantity"), 8).alias("l_quantity"))


@query("legendre_basis", f"""
SELECT l_orderkey, l_linenumber, CAST(t AS INTEGER) AS term_id, {sr('phi', 9)} AS phi FROM (SELECT l_orderkey, l_linenumber,
  unnest(range({BASIS2.n_terms})) AS t, unnest([{', '.join(term_sql(BASIS2, i, GERM) for i in range(BASIS2.n_terms))}]) AS phi FROM ({DESIGN_SQL}))""")
def _legendre_basis(t):
    rows = fit.with_phi(t.design, BASIS2, design.germ_columns(LINEITEM_BOUNDS))
    return rows.select("l_orderkey", "l_linenumber", F.posexplode("phi").alias("term_id", "phi")).withColumn("phi", rnd("phi", 9))


HERMITE = PolynomialBasis(("z0", "z1"), 3, "hermite")
Z_SQL = """SELECT o_orderkey, (o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders) AS z0,
  CAST(o_orderkey % 7 - 3 AS DOUBLE) / 2 AS z1 FROM orders"""


@query("hermite_basis", f"""
SELECT o_orderkey, CAST(t AS INTEGER) AS term_id, {sr('phi', 7)} AS phi FROM (SELECT o_orderkey, unnest(range({HERMITE.n_terms})) AS t,
  unnest([{', '.join(term_sql(HERMITE, i, ['z0', 'z1']) for i in range(HERMITE.n_terms))}]) AS phi FROM ({Z_SQL}))""")
def _hermite_basis(t):
    stats = t.orders.agg(F.avg("o_totalprice").alias("m"), F.stddev_pop("o_totalprice").alias("s"))
    z0 = (F.col("o_totalprice") - stats.select("m").scalar()) / stats.select("s").scalar()
    rows = t.orders.withColumns({"z0": z0, "z1": (F.col("o_orderkey") % 7 - 3).cast("double") / 2})
    rows = rows.withColumn("phi", HERMITE.phi([F.col("z0"), F.col("z1")]))
    return rows.select("o_orderkey", F.posexplode("phi").alias("term_id", "phi")).withColumn("phi", rnd("phi", 7))


@query("multi_indices", " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS term_id, '{','.join(map(str, a))}' AS alpha, {float(BASIS2.norms[i])!r}::DOUBLE AS norm2, {sr(f'avg({term_sql(BASIS2, i, GERM)})', 11)} AS mean_phi FROM ({DESIGN_SQL})"
    for i, a in enumerate(BASIS2.indices)))
def _multi_indices(t):
    rows = fit.with_phi(t.design, BASIS2, design.germ_columns(LINEITEM_BOUNDS))
    means = rows.agg((F.array(*[rnd(F.avg(F.col("phi")[i]), 11) for i in range(BASIS2.n_terms)])).alias("m"))
    means = means.select(F.posexplode("m").alias("term_id", "mean_phi"))
    terms = BASIS2.terms(t.spark).withColumn("alpha", F.concat_ws(",", F.col("alpha").cast("array<string>")))
    return terms.join(means, "term_id")


@query("choose_order", """
SELECT l_suppkey, l_returnflag, count(*) AS n, CAST(greatest((SELECT count(*) FROM range(1, (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) + 10 FROM lineitem)) r(p) WHERE 2 * ((p + 1) * (p + 2) * (p + 3) // 6) <= g.n), 1) AS INTEGER) AS polynomial_order
FROM (SELECT l_suppkey, l_returnflag, count(*) OVER (PARTITION BY l_suppkey, l_returnflag) AS n FROM lineitem) g GROUP BY l_suppkey, l_returnflag, g.n""")
def _choose_order(t):
    counts = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("polynomial_order", choose_order_column(len(PARAMS), F.col("n")))


# --- statistics and fits -------------------------------------------------------------


@query("design_join_outputs", """
SELECT p_partkey, p_size, p_retailprice, round(y, 8) + 0.0 AS y FROM part JOIN (
  SELECT l_partkey, avg(l_quantity) AS y FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def _design_join_outputs(t):
    y = t.lineitem.groupBy("l_partkey").agg(F.avg("l_quantity").alias("y"))
    return t.part.join(y, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "p_size", "p_retailprice", rnd("y", 8).alias("y"))


#: A third of one output missing as null or NaN, the other far from zero.
MISSING_SQL = f"""
SELECT l_returnflag, g0, g1, g2, output_id, CASE WHEN output_id = 'y1' THEN y + 1e9 WHEN (l_orderkey + l_linenumber) % 3 <> 0 THEN y END AS y FROM ({LONG_SQL})"""
MISSING_FIT_SQL = fit_sql(f"SELECT * FROM ({MISSING_SQL}) WHERE y IS NOT NULL", BASIS2, GERM, ["l_returnflag", "output_id"])


def missing_statistics(t):
    gone = (F.col("l_orderkey") + F.col("l_linenumber")) % 6
    y0 = F.when(gone == 0, F.lit(float("nan"))).when(gone != 3, F.col("y0"))
    d = t.design.withColumns({"y0": y0, "y1": F.col("y1") + 1e9})
    return fit.wide_statistics(d, BASIS2, design.germ_columns(LINEITEM_BOUNDS), OUTPUTS, FLAG)


@query("fit_missing_shifted", f"""
SELECT l_returnflag, output_id, n, {sr('c0', 3)} AS c0, {sr('c1', 3)} AS c1, {sr('c9', 3)} AS c9, {sr('e2 * n / (n - 10)', 1)} AS sigma2, {sr('1 - e2 / vy', 7)} AS r_squared FROM ({MISSING_FIT_SQL})""")
def _fit_missing_shifted(t):
    out = fit.fit_quality(fit.fit(missing_statistics(t), FLAG))
    coefs = [F.col("coef")[i].alias(f"c{i}") for i in (0, 1, 9)]
    return rounded(out.select("l_returnflag", "output_id", "n", *coefs, "sigma2", "r_squared"), 3, sigma2=1, r_squared=7)


@query("variance_weighting_shifted", f"""
WITH f AS ({MISSING_FIT_SQL}), s AS ({sobol_sql(MISSING_FIT_SQL, BASIS2, ['l_returnflag', 'output_id'])})
SELECT s.l_returnflag, param, {sr('sum(s1 * vy) / sum(vy)', 7)} AS s1, {sr('sum(st * vy) / sum(vy)', 7)} AS st FROM s JOIN f USING (l_returnflag, output_id) GROUP BY ALL""")
def _variance_weighting_shifted(t):
    fits = fit.fit(missing_statistics(t), FLAG)
    out = sobol.variance_weighting(sobol.sobol_indices(fits, BASIS2, FLAG), sobol.output_variances(fits, FLAG), FLAG)
    return rounded(out.select("l_returnflag", "param", "s1", "st"), 7)


TRI1 = [(i, j) for i in range(BASIS1.n_terms) for j in range(i + 1)]


@query("gram_rhs", f"""
SELECT l_returnflag, output_id, n, CAST(e AS INTEGER) AS entry, {sr('v / n')} AS value FROM (
  SELECT l_returnflag, output_id, count(*) AS n, unnest(range({len(TRI1) + BASIS1.n_terms})) AS e, unnest([
    {', '.join(f'sum({term_sql(BASIS1, i, GERM)} * {term_sql(BASIS1, j, GERM)})' for i, j in TRI1)},
    {', '.join(f'sum({term_sql(BASIS1, i, GERM)} * y)' for i in range(BASIS1.n_terms))}]) AS v FROM ({LONG_SQL}) GROUP BY 1, 2)""")
def _gram_rhs(t):
    stats = statistics(t, BASIS1)
    return stats.select("l_returnflag", "output_id", "n", F.posexplode(F.concat("gram", fit.raw_rhs(F.col("gram"), F.col("rhs"), F.col("mean")))).alias("entry", "value")).withColumn("value", rnd(F.col("value") / F.col("n")))


def coef_rows(df, basis, digits=3):
    return df.select("l_returnflag", "output_id", F.posexplode("coef").alias("term_id", "coef")).withColumn("coef", rnd("coef", digits))


def coef_sql(fits, basis, digits=3):
    cs = ", ".join(f"c{i}" for i in range(basis.n_terms))
    return f"SELECT l_returnflag, output_id, CAST(t AS INTEGER) AS term_id, {sr('c', digits)} AS coef FROM (SELECT l_returnflag, output_id, unnest(range({basis.n_terms})) AS t, unnest([{cs}]) AS c FROM ({fits}))"


@query("fit_lsq", coef_sql(FIT2_SQL, BASIS2))
def _fit_lsq(t):
    return coef_rows(fitted(t), BASIS2)


@query("fit_lsq_order3", coef_sql(FIT3_SQL, BASIS3, 2))
def _fit_lsq_order3(t):
    return coef_rows(fitted(t, BASIS3), BASIS3, 2)


@query("fit_anl", f"""
SELECT l_returnflag, output_id, n, {sr('sqrt(e2 * n / (n - 10 - 2))', 4)} AS noise_std FROM ({FIT2_SQL})""")
def _fit_anl(t):
    return fitted(t, method="anl").select("l_returnflag", "output_id", "n", rnd(F.sqrt("sigma2"), 4).alias("noise_std"))


#: Cubic and sparse responses of the inputs: what a fit must return exactly.
CUBIC = "7 + 3 * g0 - 2 * g2 * g2 + 0.5::DOUBLE * g0 * g1 * g2 + g1 * g1 * g1"
SPARSE = "1000 + 200 * g2 - 50 * g0 * g1"
RESPONSE_SQL = f"SELECT l_returnflag, unnest(['cubic', 'sparse']) AS output_id, unnest([{CUBIC}, {SPARSE}]) AS y, g0, g1, g2, l_orderkey, l_linenumber FROM ({DESIGN_SQL})"


def responses(t):
    """The design with both responses as columns."""
    g = dict(zip(GERM, design.germ_columns(LINEITEM_BOUNDS)))
    spark_sql = lambda text: F.expr(text.replace("0.5::DOUBLE", "0.5D"))
    return t.design.withColumns(g).withColumns({"cubic": spark_sql(CUBIC), "sparse": spark_sql(SPARSE)}).drop(*GERM)


@query("fit_bcs", f"""
SELECT l_returnflag, output_id, term_id, {sr('coef', 4)} AS coef, abs(coef) > 1e-6 AS used, true AS converged FROM (
  SELECT l_returnflag, output_id, CAST(unnest(range({BASIS2.n_terms})) AS INTEGER) AS term_id, unnest([{', '.join(f'c{i}' for i in range(BASIS2.n_terms))}]) AS coef
  FROM ({fit_sql(f"SELECT * FROM ({RESPONSE_SQL}) WHERE output_id = 'sparse'", BASIS2, GERM, ['l_returnflag', 'output_id'])}))""")
def _fit_bcs(t):
    """Of a response with two of ten terms the sparse fit keeps those two and the constant."""
    fits = fit.fit(fit.wide_statistics(responses(t), BASIS2, design.germ_columns(LINEITEM_BOUNDS), ["sparse"], FLAG), FLAG, "bcs")
    return fits.select("l_returnflag", "output_id", "converged", F.posexplode(F.arrays_zip("coef", "used")).alias("term_id", "e")).select(
        "l_returnflag", "output_id", "term_id", rnd("e.coef", 4).alias("coef"), F.col("e.used").alias("used"), "converged")


def qr_factors(t, basis=BASIS2):
    return qr.qr_factors(t.design, basis, design.germ_columns(LINEITEM_BOUNDS), OUTPUTS, FLAG)


@query("fit_qr", coef_sql(FIT2_SQL, BASIS2))
def _fit_qr(t):
    return coef_rows(qr.fit_qr(qr_factors(t), FLAG), BASIS2)


@query("fit_qr_exact", f"""
SELECT l_returnflag, output_id, n, {', '.join(f"{sr(f'c{i}', 6)} AS c{i}" for i in range(BASIS3.n_terms))}, true AS exact FROM ({fit_sql(RESPONSE_SQL, BASIS3, GERM, ['l_returnflag', 'output_id'])})""")
def _fit_qr_exact(t):
    """Noiseless responses of order 3: coefficients, and whether the residual stays below 1e-10 of the values."""
    factors = qr.qr_factors(responses(t), BASIS3, design.germ_columns(LINEITEM_BOUNDS), ["cubic", "sparse"], FLAG)
    fits = qr.fit_qr(factors, FLAG)
    return fits.select("l_returnflag", "output_id", "n", *[rnd(F.col("coef")[i], 6).alias(f"c{i}") for i in range(BASIS3.n_terms)],
                       (F.sqrt("sse") < 1e-10 * F.sqrt(F.col("syy") + F.col("n") * F.col("mean") * F.col("mean"))).alias("exact"))


@query("predict", f"""
SELECT l.l_orderkey, l.l_linenumber, l.output_id, {sr('yhat', 3)} AS yhat, {sr('y', 7)} AS y FROM (
  SELECT l.l_orderkey, l.l_linenumber, l.output_id, l.y, {predict_sql(BASIS2, GERM)} AS yhat FROM ({LONG_SQL}) l JOIN ({FIT2_SQL}) f USING (l_returnflag, output_id)) l""")
def _predict(t):
    rows = fit.with_phi(t.design, BASIS2, design.germ_columns(LINEITEM_BOUNDS))
    out = fit.predict(rows, fitted(t), FLAG, n_terms=BASIS2.n_terms)
    y = F.when(F.col("output_id") == "y0", F.col("y0")).otherwise(F.col("y1"))
    return out.select("l_orderkey", "l_linenumber", "output_id", rnd("yhat", 3).alias("yhat"), rnd(y, 7).alias("y"))


BASIS_Q = PolynomialBasis(("l_quantity",), 1)
FITQ_SQL = fit_sql(LONG_SQL, BASIS_Q, ["g2"], ["l_returnflag", "output_id"])


@query("predict_std", f"""
SELECT l.l_orderkey, l.l_linenumber, l.output_id, {sr('sqrt(e2 * n / (n - 2) * (1.0 / n + (g2 - mg) ** 2 / (n * vg)))', 4)} AS std
FROM ({LONG_SQL}) l JOIN ({FITQ_SQL}) f USING (l_returnflag, output_id)
JOIN (SELECT l_returnflag, avg(g2) AS mg, var_pop(g2) AS vg FROM ({DESIGN_SQL}) GROUP BY 1) USING (l_returnflag)""")
def _predict_std(t):
    out = quantity_scores(t)
    return out.select("l_orderkey", "l_linenumber", "output_id", rnd(F.sqrt(F.col("sigma2") * F.col("leverage")), 4).alias("std"))


def quantity_scores(t):
    """Predictions of the fits to one input, with the leverage of every row."""
    germ = design.germ_columns({"l_quantity": LINEITEM_BOUNDS["l_quantity"]})
    factors = qr.qr_factors(t.design, BASIS_Q, germ, OUTPUTS, FLAG)
    return qr.scored(t.design, factors, BASIS_Q, germ, FLAG, ["l_orderkey", "l_linenumber", "y0", "y1"])


MOMENTS_SQL = f"SELECT l_returnflag, avg(g2) AS mg, var_pop(g2) AS vg FROM ({DESIGN_SQL}) GROUP BY 1"


@query("leave_one_out", f"""
SELECT l_returnflag, output_id, count(*) AS n, {sr('sqrt(sum((e / (1 - h)) ** 2)) / sqrt(sum(y * y))', 8)} AS loo_error, CAST(0 AS BIGINT) AS undetermined FROM (
  SELECT l_returnflag, l.output_id, l.y, l.y - ({predict_sql(BASIS_Q, ['g2'])}) AS e, 1.0::DOUBLE / n + (g2 - mg) ** 2 / (n * vg) AS h
  FROM ({LONG_SQL}) l JOIN ({FITQ_SQL}) f USING (l_returnflag, output_id) JOIN ({MOMENTS_SQL}) USING (l_returnflag)) GROUP BY 1, 2""")
def _leave_one_out(t):
    scores = quantity_scores(t).withColumn("y", F.when(F.col("output_id") == "y0", F.col("y0")).otherwise(F.col("y1")))
    return rounded(qr.leave_one_out(scores, FLAG), 8)


@query("anl_posterior", f"""
SELECT l_returnflag, output_id, {sr('sqrt(s2)', 4)} AS noise_std, {sr('sqrt(s2 * (1.0 / n + mg * mg / (n * vg)))', 6)} AS std0, {sr('sqrt(s2 / (n * vg))', 6)} AS std1,
  {sr('-s2 * mg / (n * vg)', 4)} AS cov01, {sr('sqrt(s2 * (1 + 1.0 / n + (0.5 - mg) ** 2 / (n * vg)))', 4)} AS predictive_std
FROM (SELECT l_returnflag, output_id, n, mg, vg, e2 * n / (n - 4) AS s2 FROM ({FITQ_SQL}) JOIN ({MOMENTS_SQL}) USING (l_returnflag))""")
def _anl_posterior(t):
    """Posterior of the coefficients (deviations and covariance) and the predictive deviation at germ 0.5."""
    germ = design.germ_columns({"l_quantity": LINEITEM_BOUNDS["l_quantity"]})
    fits = fit.fit(fit.wide_statistics(t.design, BASIS_Q, germ, OUTPUTS, FLAG), FLAG, "anl", covariance=True)
    cov = lambda i: F.col("sigma2") * F.col("ginv")[i]
    variance = fit.predict_variance(F.array(F.lit(1.0), F.lit(0.5)), F.col("ginv"), F.col("sigma2"), noise=True)
    return fits.select("l_returnflag", "output_id", rnd(F.sqrt("sigma2"), 4).alias("noise_std"), rnd(F.sqrt(cov(0)), 6).alias("std0"), rnd(F.sqrt(cov(2)), 6).alias("std1"),
                       rnd(cov(1), 4).alias("cov01"), rnd(F.sqrt(variance), 4).alias("predictive_std"))


@query("surrogate_std", f"""
SELECT l_returnflag, output_id, {sr('sqrt(' + ' + '.join(f'c{i} * c{i}' for i in range(1, BASIS2.n_terms)) + ')', 3)} AS std FROM ({FIT2_SQL})""")
def _surrogate_std(t):
    return fitted(t).select("l_returnflag", "output_id", rnd(fit.surrogate_std(F.col("coef")), 3).alias("std"))


@query("relative_error", f"""
SELECT l_returnflag, output_id, split, {sr('sqrt(sum((y - yhat) ** 2)) / sqrt(sum(y * y))', 8)} AS relative_error FROM (
  SELECT l.l_returnflag, l.output_id, l.y, CASE WHEN l.l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, {predict_sql(BASIS2, GERM)} AS yhat
  FROM ({LONG_SQL}) l JOIN ({fit_sql(LONG_SQL.replace('FROM (', 'FROM (SELECT * FROM (', 1) + ' WHERE l_orderkey % 5 <> 0)', BASIS2, GERM, ['l_returnflag', 'output_id'])}) f USING (l_returnflag, output_id)) GROUP BY ALL""")
def _relative_error(t):
    germ = design.germ_columns(LINEITEM_BOUNDS)
    split = F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train")
    d = t.design.withColumn("split", split)
    fits = fit.fit(fit.wide_statistics(d.where("split = 'train'"), BASIS2, germ, OUTPUTS, FLAG), FLAG)
    out = fit.predict(fit.with_phi(d, BASIS2, germ), fits, FLAG, n_terms=BASIS2.n_terms)
    out = out.withColumn("y", F.when(F.col("output_id") == "y0", F.col("y0")).otherwise(F.col("y1")))
    return rounded(fit.relative_error(out, ["l_returnflag", "output_id", "split"]), 8)


@query("r_squared_sparsity", f"""
SELECT l_returnflag, output_id, {sr('1 - e2 / vy', 8)} AS r_squared, 0.0::DOUBLE AS sparsity FROM ({FIT2_SQL})""")
def _r_squared(t):
    return rounded(fit.fit_quality(fitted(t)).select("l_returnflag", "output_id", "r_squared", "sparsity"), 8)


# --- indices -------------------------------------------------------------------------


@query("sobol_first_total", f"SELECT l_returnflag, output_id, param_id, param, {sr('s1', 8)} AS s1, {sr('st', 8)} AS st FROM ({SOBOL2_SQL})")
def _sobol_first_total(t):
    return rounded(indices(t).select("l_returnflag", "output_id", "param_id", "param", "s1", "st"), 8)


PAIRS = [(i, j) for i in range(3) for j in range(i + 1, 3)]


@query("sobol_joint", f"WITH f AS ({FIT2_SQL}) " + " UNION ALL ".join(
    f"SELECT l_returnflag, output_id, '{PARAMS[i]}' AS param_i, '{PARAMS[j]}' AS param_j, {sr(share_sql(BASIS2, lambda a: a[i] and a[j]), 8)} AS s_ij FROM f"
    for i, j in PAIRS))
def _sobol_joint(t):
    return rounded(sobol.sobol_joint(fitted(t), BASIS2, FLAG), 8)


WEIGHTED_SQL = f"""
SELECT s.l_returnflag, param_id, param, sum(s1 * w) AS s1, sum(st * w) AS st FROM ({SOBOL2_SQL}) s JOIN (
  SELECT l_returnflag, output_id, vy / sum(vy) OVER (PARTITION BY l_returnflag) AS w FROM ({FIT2_SQL})) USING (l_returnflag, output_id) GROUP BY ALL"""


@query("variance_weighting", f"SELECT l_returnflag, param_id, param, {sr('s1', 8)} AS s1, {sr('st', 8)} AS st FROM ({WEIGHTED_SQL})")
def _variance_weighting(t):
    fits = fitted(t)
    return rounded(sobol.variance_weighting(sobol.sobol_indices(fits, BASIS2, FLAG), sobol.output_variances(fits, FLAG), FLAG), 8)


@query("joint_weighting", f"""
WITH f AS (SELECT *, vy / sum(vy) OVER (PARTITION BY l_returnflag) AS w FROM ({FIT2_SQL})) """ + " UNION ALL ".join(
    f"SELECT l_returnflag, '{PARAMS[i]}' AS param_i, '{PARAMS[j]}' AS param_j, {sr(f'sum(w * ({share_sql(BASIS2, lambda a: a[i] and a[j])}))', 8)} AS s_ij FROM f GROUP BY 1"
    for i, j in PAIRS))
def _joint_weighting(t):
    fits = fitted(t)
    return rounded(sobol.joint_weighting(sobol.sobol_joint(fits, BASIS2, FLAG), sobol.output_variances(fits, FLAG), FLAG), 8)


@query("interaction_gap", f"SELECT l_returnflag, output_id, param, {sr('st - s1', 8)} AS interaction FROM ({SOBOL2_SQL})")
def _interaction_gap(t):
    return rounded(sobol.interaction_gap(indices(t)).select("l_returnflag", "output_id", "param", "interaction"), 8)


RANK_SQL = f"""
SELECT l_returnflag, param_id, param, avg(s1) AS s1, avg(st) AS st,
  CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY avg(st) DESC, param_id) AS INTEGER) AS rank FROM ({SOBOL2_SQL}) GROUP BY 1, 2, 3"""


@query("sensitivity_ranking", f"SELECT l_returnflag, param_id, param, {sr('s1', 8)} AS s1, {sr('st', 8)} AS st, rank FROM ({RANK_SQL})")
def _sensitivity_ranking(t):
    return rounded(sobol.top_parameters(indices(t), None, groups=FLAG), 8)


@query("top_parameters", f"SELECT l_returnflag, param_id, param, {sr('s1', 8)} AS s1, {sr('st', 8)} AS st, rank FROM ({RANK_SQL}) WHERE rank <= 2")
def _top_parameters(t):
    return rounded(sobol.top_parameters(indices(t), 2, groups=FLAG), 8)


@query("correlation_proxy", f"""
WITH c AS (SELECT l_returnflag, unnest([0, 1, 2]) AS i, unnest([
    (abs(corr(l_discount, y0)) + abs(corr(l_discount, y1))) / 2, (abs(corr(l_tax, y0)) + abs(corr(l_tax, y1))) / 2,
    (abs(corr(l_quantity, y0)) + abs(corr(l_quantity, y1))) / 2]) AS s FROM ({DESIGN_SQL}) GROUP BY 1)
SELECT l_returnflag, CAST(i AS INTEGER) AS param_id, ['l_discount', 'l_tax', 'l_quantity'][i + 1] AS param,
  {sr('s / (sum(s) OVER (PARTITION BY l_returnflag) + 1e-10)', 8)} AS s1 FROM c""")
def _correlation_proxy(t):
    return rounded(sobol.correlation_proxy(t.design, PARAMS, OUTPUTS, FLAG), 8)


# --- all strategies in one plan ------------------------------------------------------

SAMPLE_BOUNDS = {"x0": (0.0, 19.0), "x1": (0.0, 19.0)}
SAMPLE_BASIS = PolynomialBasis(tuple(SAMPLE_BOUNDS), 1)
COLUMNS = [DRY_MASS, VOLUME]
STRATEGY_Y_SQL = f"""
  SELECT 'uniform' AS strategy, 0 AS group_value, variant AS sample_id, '{DRY_MASS}' AS output_id, avg(dry_mass) AS y FROM g GROUP BY 3
  UNION ALL SELECT 'uniform', 0, variant, '{VOLUME}', avg(volume) FROM g GROUP BY 3
  UNION ALL SELECT 'by_generation', group_value, sample_id, output_id, y FROM ({group_means_sql('generation', 'g')})
  UNION ALL SELECT 'by_lineage_seed', group_value, sample_id, output_id, y FROM ({group_means_sql('lineage_seed', 'g')})
  UNION ALL SELECT 'growth_stage', stage, sample_id, output_id, y FROM ({STAGE_MEANS_SQL})"""
STRATEGY_KEYS = ["strategy", "group_value"]
STRATEGY_FIT_SQL = fit_sql(
    f"SELECT *, 2 * sample_id / 19.0 - 1 AS g0, 2 * ((sample_id * 7) % 20) / 19.0 - 1 AS g1 FROM ({STRATEGY_Y_SQL})",
    SAMPLE_BASIS, ["g0", "g1"], [*STRATEGY_KEYS, "output_id"])
STRATEGY_SOBOL_SQL = sobol_sql(f"WITH g AS ({GROWTH_SQL}) {STRATEGY_FIT_SQL}", SAMPLE_BASIS, [*STRATEGY_KEYS, "output_id"])


def sample_design(t):
    ids = t.history.select(F.col("variant").alias("sample_id")).distinct()
    return ids.select("sample_id", F.col("sample_id").cast("double").alias("x0"), ((F.col("sample_id") * 7) % 20).cast("double").alias("x1"))


def strategy_result(t):
    y = strategies.strategy_outputs(first_last_theta(t), COLUMNS, 10)
    return quantify.fit_strategies(sample_design(t), SAMPLE_BOUNDS, y, order=1)


@query("strategy_fit", f"""
SELECT strategy, CAST(group_value AS BIGINT) AS group_value, output_id, param_id, param, {sr('s1')} AS s1, {sr('st')} AS st FROM ({STRATEGY_SOBOL_SQL})""")
def _strategy_fit(t):
    return rounded(strategy_result(t).indices.select(*STRATEGY_KEYS, "output_id", "param_id", "param", "s1", "st"))


@query("combined_stage_sobol", f"""
WITH g AS ({GROWTH_SQL}), f AS ({STRATEGY_FIT_SQL}), w AS (SELECT *, vy / sum(vy) OVER () AS w FROM f WHERE strategy = 'growth_stage')
""" + " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS param_id, '{name}' AS param, {sr(f'sum(w * ({share_sql(SAMPLE_BASIS, lambda a: a[i])}))')} AS s1, {sr(f'sum(w * ({share_sql(SAMPLE_BASIS, lambda a: a[i])}))')} AS st FROM w"
    for i, name in enumerate(SAMPLE_BOUNDS)))
def _combined_stage_sobol(t):
    """One index per input over all stages and observables together."""
    indices, _ = strategy_result(t).combined()
    return rounded(indices.select("param_id", "param", "s1", "st"))


FOLDS = 4
POINTS_SQL = f"SELECT *, 2 * sample_id / 19.0 - 1 AS g0, 2 * ((sample_id * 7) % 20) / 19.0 - 1 AS g1 FROM ({STRATEGY_Y_SQL})"
_UNIT = [*STRATEGY_KEYS, "output_id"]
_ERROR = "sqrt(sum((y - yhat) ** 2)) / sqrt(sum(y * y))"


def _errors_sql(name, trained, tested):
    fits = fit_sql(f"SELECT * FROM p WHERE sample_id % 5 <> 0 AND {trained}", SAMPLE_BASIS, ["g0", "g1"], _UNIT)
    return f"SELECT strategy, group_value, output_id, '{name}' AS split, y, {predict_sql(SAMPLE_BASIS, ['g0', 'g1'])} AS yhat FROM p JOIN ({fits}) f USING (strategy, group_value, output_id) WHERE {tested}"


ERRORS_SQL = " UNION ALL ".join([
    _errors_sql("train", "true", "sample_id % 5 <> 0"), _errors_sql("test", "true", "sample_id % 5 = 0"),
    *[_errors_sql("cross", f"sample_id % {FOLDS} <> {k}", f"sample_id % 5 <> 0 AND sample_id % {FOLDS} = {k}") for k in range(FOLDS)]])


@query("strategy_errors", f"""
WITH g AS ({GROWTH_SQL}), p AS ({POINTS_SQL}), e AS (SELECT strategy, group_value, output_id, split, {_ERROR} AS error FROM ({ERRORS_SQL}) GROUP BY ALL)
SELECT strategy, CAST(group_value AS BIGINT) AS group_value, output_id, {', '.join(sr(f"max(CASE WHEN split = '{s}' THEN error END)") + f' AS {s}_error' for s in ('train', 'test', 'cross'))}
FROM e GROUP BY 1, 2, 3""")
def _strategy_errors(t):
    """Errors on the samples of the fit, on every fifth sample that is held out, and by cross-validation in four folds."""
    y = strategies.strategy_outputs(first_last_theta(t), COLUMNS, 10)
    sample = F.col("sample_id")
    result = quantify.fit_strategies(sample_design(t), SAMPLE_BOUNDS, y, order=1, held_out=sample % 5 == 0, folds=FOLDS, fold=sample % FOLDS)
    return rounded(result.errors.select(*STRATEGY_KEYS, "output_id", "train_error", "test_error", "cross_error"))


STAGE_SOBOL_SQL = f"SELECT CAST(group_value AS BIGINT) AS stage, param_id, param, avg(s1) AS s1, avg(st) AS st FROM ({STRATEGY_SOBOL_SQL}) WHERE strategy = 'growth_stage' GROUP BY ALL"


def stage_indices(t):
    result = strategy_result(t).indices.where("strategy = 'growth_stage'").withColumnRenamed("group_value", "stage")
    return sobol.per_stage_sobol(result)


@query("per_stage_sobol", f"SELECT stage, param_id, param, {sr('s1')} AS s1, {sr('st')} AS st FROM ({STAGE_SOBOL_SQL})")
def _per_stage_sobol(t):
    return rounded(stage_indices(t))


@query("peak_stage", f"""
SELECT stage, {sr('total')} AS total FROM (SELECT stage, round(sum(st), 9) AS total FROM ({STAGE_SOBOL_SQL}) GROUP BY 1) ORDER BY total DESC, stage LIMIT 1""")
def _peak_stage(t):
    return rounded(sobol.peak_stage(stage_indices(t).withColumn("st", F.round("st", 9))))


@query("stage_pivot", "SELECT param, " + ", ".join(f"{sr(f'max(CASE WHEN stage = {s} THEN st END)')} AS stage_{s}" for s in range(10)) + f" FROM ({STAGE_SOBOL_SQL}) GROUP BY 1")
def _stage_pivot(t):
    return rounded(sobol.stage_pivot(stage_indices(t), range(10)))


@query("top_table", f"""
SELECT param_id, param, {', '.join(f"{sr(f'''avg(CASE WHEN strategy = '{s}' THEN st END)''')} AS {s}" for s in ('uniform', 'by_generation', 'by_lineage_seed', 'growth_stage'))}
FROM ({STRATEGY_SOBOL_SQL}) GROUP BY 1, 2""")
def _top_table(t):
    order = ("uniform", "by_generation", "by_lineage_seed", "growth_stage")
    return rounded(sobol.top_table(strategy_result(t).indices, order, "uniform", 5))


#: Every array position under every strategy, fitted at once over two inputs of the samples.
ARRAY_BASIS = PolynomialBasis(("a", "b"), 1)
ARRAY_FIT_SQL = fit_sql(
    f"SELECT strategy, group_value, output_id, y, 2 * (sample_id * 7 % 11) / 10.0::DOUBLE - 1 AS g0, 2 * (sample_id * 5 % 13) / 12.0::DOUBLE - 1 AS g1 FROM ({ARRAY_OUTPUTS_SQL})",
    ARRAY_BASIS, ["g0", "g1"], ["strategy", "group_value", "output_id"])


@query("array_strategy_fit", f"""
SELECT strategy, group_value, output_id, CAST(t AS INTEGER) AS term_id, {sr('c', 6)} AS coef FROM (
  SELECT strategy, group_value, output_id, unnest(range(3)) AS t, unnest([c0, c1, c2]) AS c FROM ({ARRAY_FIT_SQL}))""")
def _array_strategy_fit(t):
    inputs = t.arrays.select(F.col("variant").alias("sample_id")).distinct()
    inputs = inputs.withColumns({"a": F.col("sample_id") * 7 % 11 / 10.0, "b": F.col("sample_id") * 5 % 13 / 12.0})
    result = quantify.fit_strategies(inputs, {"a": (0.0, 1.0), "b": (0.0, 1.0)}, array_outputs(t), order=1)
    return rounded(result.coefs.select("strategy", "group_value", "output_id", F.posexplode("coef").alias("term_id", "coef")), 6)
