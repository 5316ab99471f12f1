"""Queries that use fitted surrogates, and comparisons across conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from varienne.functions.basis import PolynomialBasis
from varienne.operators import conditions, design, fit, sobol, surrogate
from varienne.plans import quantify
from varienne.workloads.fit_sql import fit_sql, predict_sql, sobol_sql
from varienne.workloads.registry import query, rnd, rounded, sr
from varienne.workloads.sensitivity import (
    BASIS1, BASIS2, FIT2_SQL, FLAG, GERM, LONG_SQL, PARAMS, SOBOL2_SQL, fitted, indices, strategy_result, STRATEGY_SOBOL_SQL,
)
from varienne.workloads.tables import DESIGN_SQL, LINEITEM_BOUNDS

BOUNDS = LINEITEM_BOUNDS
LO_HI = [BOUNDS[p] for p in PARAMS]


def germ_sql(exprs) -> str:
    """germ columns g0.. from physical expressions."""
    return ", ".join(f"2 * (({e}) - {lo!r}::DOUBLE) / {hi - lo!r}::DOUBLE - 1 AS g{i}" for i, (e, (lo, hi)) in enumerate(zip(exprs, LO_HI)))


ALL_FIT_SQL = fit_sql(LONG_SQL, BASIS2, GERM, ["output_id"])


def global_fit(t, basis=BASIS2):
    germ = design.germ_columns(BOUNDS)
    return fit.fit(fit.wide_statistics(t.design, basis, germ, ["y0", "y1"]), [])


#: One point per supplier: mean inputs of its lines.
POINTS_SQL = "SELECT l_suppkey, avg(l_discount) AS l_discount, avg(l_tax) AS l_tax, avg(l_quantity) AS l_quantity FROM lineitem GROUP BY 1"


def supplier_points(t):
    return t.lineitem.groupBy("l_suppkey").agg(*[F.avg(p).alias(p) for p in PARAMS])


@query("grid_surrogate", f"""
SELECT l_suppkey, output_id, {sr(predict_sql(BASIS2, GERM), 4)} AS yhat FROM (SELECT l_suppkey, {germ_sql(PARAMS)} FROM ({POINTS_SQL})) p, ({ALL_FIT_SQL}) f""")
def _grid_surrogate(t):
    out = surrogate.predict_at(supplier_points(t), global_fit(t), BASIS2, BOUNDS)
    return out.select("l_suppkey", "output_id", rnd("yhat", 4).alias("yhat"))


SWEEP_N = 80
SWEEP_SQL = " UNION ALL ".join(
    f"SELECT l_returnflag, '{p}' AS swept, CAST(i AS INTEGER) AS step, "
    + germ_sql([f"{lo!r}::DOUBLE + {hi - lo!r}::DOUBLE * i / {SWEEP_N - 1}.0" if q == p else q for q, in zip(PARAMS)])
    + f" FROM (SELECT l_returnflag, avg(l_discount) AS l_discount, avg(l_tax) AS l_tax, avg(l_quantity) AS l_quantity FROM lineitem GROUP BY 1), range({SWEEP_N}) r(i)"
    for p, (lo, hi) in BOUNDS.items())


@query("response_curves", f"""
SELECT l_returnflag, output_id, swept, step, {sr(predict_sql(BASIS2, GERM), 4)} AS yhat FROM ({SWEEP_SQL}) JOIN ({FIT2_SQL}) f USING (l_returnflag)""")
def _response_curves(t):
    base = t.lineitem.groupBy("l_returnflag").agg(*[F.avg(p).alias(p) for p in PARAMS])
    out = surrogate.response_curves(base, fitted(t), BASIS2, BOUNDS, SWEEP_N, FLAG)
    return out.select("l_returnflag", "output_id", "swept", "step", rnd("yhat", 4).alias("yhat"))


def moved_sql(point: str, step: float, keys: str) -> str:
    """Germ columns of both sides of a central difference, one row per point and input."""
    parts = []
    for i, (p, (lo, hi)) in enumerate(BOUNDS.items()):
        d = (hi - lo) * step
        for sign in (1, -1):
            exprs = [f"least(greatest({q} + {sign * d!r}::DOUBLE, {lo!r}::DOUBLE), {hi!r}::DOUBLE)" if q == p else q for q in PARAMS]
            parts.append(f"SELECT {keys}, CAST({i} AS INTEGER) AS param_id, '{p}' AS param, {d!r}::DOUBLE AS d, {sign} AS side, {germ_sql(exprs)} FROM ({point})")
    return " UNION ALL ".join(parts)


LOCAL_SQL = f"""
SELECT l_suppkey, output_id, param_id, param, abs(sum(side * ({predict_sql(BASIS2, GERM)}))) / (2 * max(d) + 1e-12) AS sensitivity
FROM ({moved_sql(POINTS_SQL, 0.005, 'l_suppkey')}) p, ({ALL_FIT_SQL}) f GROUP BY ALL"""


@query("local_sensitivity", f"SELECT l_suppkey, output_id, param_id, param, {sr('sensitivity', 3)} AS sensitivity FROM ({LOCAL_SQL})")
def _local_sensitivity(t):
    return rounded(surrogate.local_sensitivity(supplier_points(t), global_fit(t), BASIS2, BOUNDS), 3)


MID_SQL = predict_sql(BASIS2, ["0.0::DOUBLE"] * 3)


@query("baseline_delta", f"""
SELECT l_suppkey, output_id, {sr('yhat', 4)} AS yhat, {sr('base', 4)} AS baseline, {sr('(yhat - base) / abs(base) * 100', 6)} AS change_percent FROM (
  SELECT l_suppkey, output_id, {predict_sql(BASIS2, GERM)} AS yhat, {MID_SQL} AS base FROM (SELECT l_suppkey, {germ_sql(PARAMS)} FROM ({POINTS_SQL})) p, ({ALL_FIT_SQL}) f)""")
def _baseline_delta(t):
    out = surrogate.baseline_delta(supplier_points(t), global_fit(t), BASIS2, BOUNDS)
    return rounded(out.select("l_suppkey", "output_id", "yhat", "baseline", "change_percent"), 4, change_percent=6)


#: Outputs laid out as index = stage * n_obs + obs: line number is the stage.
STAGED_SQL = f"""
SELECT CAST((l_linenumber - 1) * 2 + o AS VARCHAR) AS output_id, g0, g1, g2, CASE WHEN o = 0 THEN y0 ELSE y1 END AS y
FROM (SELECT *, unnest([0, 1]) AS o FROM ({DESIGN_SQL}))"""


def staged_fit(t):
    d = t.design.withColumn("stage", F.col("l_linenumber") - 1)
    fits = fit.fit(fit.wide_statistics(d, BASIS1, design.germ_columns(BOUNDS), ["y0", "y1"], ["stage"]), ["stage"])
    obs = F.when(F.col("output_id") == "y0", 0).otherwise(1)
    return fits.withColumn("output_id", (F.col("stage") * 2 + obs).cast("string")).drop("stage")


@query("predicted_profile", f"""
SELECT l_suppkey, CAST(CAST(output_id AS INTEGER) // 2 AS INTEGER) AS stage, CAST(CAST(output_id AS INTEGER) % 2 AS INTEGER) AS obs, {sr(predict_sql(BASIS1, GERM), 4)} AS yhat
FROM (SELECT l_suppkey, {germ_sql(PARAMS)} FROM ({POINTS_SQL})) p, ({fit_sql(STAGED_SQL, BASIS1, GERM, ['output_id'])}) f""")
def _predicted_profile(t):
    out = surrogate.predicted_profile(supplier_points(t), staged_fit(t), BASIS1, BOUNDS, 2)
    return out.select("l_suppkey", "stage", "obs", rnd("yhat", 4).alias("yhat"))


def uniform_sql(seed: int, *keys: str) -> str:
    parts = ", ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST('0x' || substr(md5(concat_ws(':', {parts})), 1, 13) AS BIGINT) / {float(2**52)!r}::DOUBLE)"


def drawn_sql(ids: str, key: str, seed: int) -> str:
    cols = ", ".join(
        f"0.5::DOUBLE * ({lo!r} + {hi!r}) + 0.5::DOUBLE * ({hi!r}::DOUBLE - {lo!r}::DOUBLE) * (2 * {uniform_sql(seed, chr(39) + p + chr(39), key)} - 1) AS {p}"
        for p, (lo, hi) in BOUNDS.items())
    return f"SELECT {key}, {cols} FROM ({ids})"


CANDIDATES_SQL = drawn_sql("SELECT o_orderkey AS sample_id FROM orders", "sample_id", 42)
BEST_SQL = f"""
SELECT output_id, sample_id, l_discount, l_tax, l_quantity, dev FROM (
  SELECT *, row_number() OVER (PARTITION BY output_id ORDER BY dev DESC, sample_id) AS rn FROM (
    SELECT output_id, sample_id, l_discount, l_tax, l_quantity, ({predict_sql(BASIS2, GERM)} - ({MID_SQL})) ** 2 AS dev
    FROM (SELECT *, {germ_sql(PARAMS)} FROM ({CANDIDATES_SQL})) p, ({ALL_FIT_SQL}) f)) WHERE rn = 1"""


@query("suggest_point", f"""
WITH b AS ({BEST_SQL}), s AS (
  SELECT p.output_id, param, param_id, abs(sum(side * ({predict_sql(BASIS2, GERM)}))) / (2 * max(d) + 1e-12) AS v
  FROM ({moved_sql('SELECT * FROM b', 0.01, 'output_id')}) p JOIN ({ALL_FIT_SQL}) f ON p.output_id = f.output_id GROUP BY ALL)
SELECT b.output_id, sample_id, {sr('l_discount', 8)} AS l_discount, {sr('l_tax', 8)} AS l_tax, {sr('l_quantity')} AS l_quantity, {sr('sqrt(dev)', 3)} AS deviation,
  (SELECT param FROM s WHERE s.output_id = b.output_id ORDER BY v DESC, param_id LIMIT 1) AS top_param FROM b""")
def _suggest_point(t):
    candidates = design.sample_uniform(t.orders.select(F.col("o_orderkey").alias("sample_id")), BOUNDS, 42)
    out = surrogate.suggest_point(candidates, global_fit(t), BASIS2, BOUNDS)
    return rounded(out.withColumn("deviation", F.sqrt("deviation")), 8, l_quantity=6, deviation=3)


@query("argmax_point", """
SELECT l_returnflag AS output_id, l_orderkey, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey) AS rn FROM lineitem) WHERE rn = 1""")
def _argmax_point(t):
    return surrogate.argmax_point(t.lineitem.withColumnRenamed("l_returnflag", "output_id"), "l_extendedprice", ["l_orderkey"], "l_orderkey")


@query("find_target", f"""
WITH f AS ({ALL_FIT_SQL}), r AS (SELECT output_id, min(yhat) AS lo, max(yhat) AS hi FROM (SELECT output_id, {predict_sql(BASIS2, GERM)} AS yhat FROM ({DESIGN_SQL}), f) GROUP BY 1),
m AS (SELECT p_type, avg(l_extendedprice) AS y0, avg(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS y1 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT p_type, output_id, {sr('target', 4)} AS target, target BETWEEN lo AND hi AS reached, true AS inside, true AS converged
FROM (SELECT p_type, unnest(['y0', 'y1']) AS output_id, unnest([y0, y1]) AS target FROM m) JOIN r USING (output_id)""")
def _find_target(t):
    """Inputs that reach the mean price of each part type; predictions below and above it in the box say that there are some."""
    price = F.col("l_extendedprice")
    priced = t.lineitem.select("l_partkey", price.alias("y0"), (price * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("y1"))
    means = priced.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type").agg(F.avg("y0").alias("y0"), F.avg("y1").alias("y1"))
    pairs = F.array(*[F.struct(F.lit(o).alias("output_id"), F.col(o).alias("target")) for o in ("y0", "y1")])
    fits = global_fit(t)
    found = surrogate.search_targets(fits, means.select("p_type", F.inline(pairs)), BASIS2, BOUNDS, seed=7).drop("yhat", "reached")
    again = fit.predict(surrogate.points_phi(found, BASIS2, BOUNDS), fits, ["output_id"])
    inside = F.lit(True)
    for n, (lo, hi) in BOUNDS.items():
        inside = inside & F.col(n).between(lo - 1e-9, hi + 1e-9)
    return again.select("p_type", "output_id", rnd("target", 4).alias("target"), (F.abs(F.col("yhat") - F.col("target")) < 1e-6 * F.abs("target")).alias("reached"),
                        inside.alias("inside"), "converged")


#: Modes per supplier from its lines: frequency, damping and amplitude; the last one lacks an amplitude.
SPECTRAL_SQL = f"""
SELECT l_suppkey, CAST(output_id AS INTEGER) AS idx, ({predict_sql(BASIS1, GERM)}) / 10000 AS yhat
FROM (SELECT l_suppkey, {germ_sql(PARAMS)} FROM ({POINTS_SQL})) p, ({fit_sql(STAGED_SQL, BASIS1, GERM, ['output_id'])}) f"""
MODES_SQL = f"""
SELECT l_suppkey, CAST(idx // 3 AS INTEGER) AS mode, max(CASE WHEN idx % 3 = 0 THEN yhat END) AS omega,
  max(CASE WHEN idx % 3 = 1 THEN yhat END) AS sigma, max(CASE WHEN idx % 3 = 2 THEN yhat END) AS amplitude FROM ({SPECTRAL_SQL}) GROUP BY ALL"""


def modes(t):
    out = surrogate.predict_at(supplier_points(t), staged_fit(t), BASIS1, BOUNDS)
    return surrogate.spectral_features(out.withColumn("yhat", F.col("yhat") / 10000), ["l_suppkey"])


@query("spectral_features", f"""
SELECT l_suppkey, mode, {sr('omega')} AS omega, {sr('sigma')} AS sigma, {sr('amplitude')} AS amplitude, {sr('omega / (2 * pi())')} AS freq_hz FROM ({MODES_SQL})""")
def _spectral_features(t):
    return rounded(modes(t))


@query("resynthesize", f"""
SELECT l_suppkey, CAST(i AS INTEGER) AS i, {sr('sum(amplitude * exp(-sigma * i * 0.25) * cos(omega * i * 0.25)) + 1.5')} AS y FROM ({MODES_SQL}), range(21) r(i) GROUP BY ALL""")
def _resynthesize(t):
    damped = modes(t).withColumn("sigma", -F.col("sigma"))
    return surrogate.resynthesize(damped, ["l_suppkey"], 0.0, 5.0, 21, dc=1.5).select("l_suppkey", "i", rnd("y").alias("y"))


# --- conditions ------------------------------------------------------------------------

#: The order priorities.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

#: Conditions are order priorities; a noisy output gives every input some weight.
CONDITION_DATA_SQL = """
SELECT o_orderpriority AS condition, 'z' AS output_id, 2 * l_discount / 0.1 - 1 AS g0, 2 * l_tax / 0.08 - 1 AS g1, 2 * (l_quantity - 1) / 49.0 - 1 AS g2,
  CAST((l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 11 AS DOUBLE) + l_discount * 5 AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
CONDITION_SQL = sobol_sql(fit_sql(CONDITION_DATA_SQL, BASIS1, GERM, ["condition", "output_id"]), BASIS1, ["condition", "output_id"])


def condition_indices(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    z = ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 3 + F.col("l_linenumber")) % 11).cast("double") + F.col("l_discount") * 5
    d = joined.select(F.col("o_orderpriority").alias("condition"), *PARAMS, z.alias("z"))
    fits = fit.fit(fit.wide_statistics(d, BASIS1, design.germ_columns(BOUNDS), ["z"], ["condition"]), ["condition"])
    return sobol.sobol_indices(fits, BASIS1, ["condition"])


@query("condition_sobol", f"SELECT condition, param, {sr('s1', 7)} AS s1, {sr('st', 7)} AS st FROM ({CONDITION_SQL})")
def _condition_sobol(t):
    return rounded(condition_indices(t).select("condition", "param", "s1", "st"), 7)


#: Suppliers are samples, priorities are conditions with their own designs.
CONDITION_MEANS_SQL = """
SELECT o_orderpriority AS condition, l_suppkey AS sample_id, avg(l_discount) AS x0, avg(l_tax) AS x1, avg(l_quantity) AS x2, avg(l_extendedprice) AS y
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"""
MULTI_SQL = sobol_sql(fit_sql(
    f"SELECT condition, 'price' AS output_id, y, {germ_sql(['x0', 'x1', 'x2'])} FROM ({CONDITION_MEANS_SQL})", BASIS1, GERM, ["condition", "output_id"]), BASIS1, ["condition", "output_id"])


@query("multi_condition_fit", f"SELECT condition, output_id, param, {sr('s1', 7)} AS s1, {sr('st', 7)} AS st FROM ({MULTI_SQL})")
def _multi_condition_fit(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    means = joined.groupBy(F.col("o_orderpriority").alias("condition"), F.col("l_suppkey").alias("sample_id")).agg(
        *[F.avg(p).alias(p) for p in PARAMS], F.avg("l_extendedprice").alias("y"))
    key = ["condition", "sample_id"]
    outputs = means.select(*key, F.lit("price").alias("output_id"), "y")
    result = quantify.fit_strategies(means.select(*key, *PARAMS), BOUNDS, outputs, order=1, groups=["condition"], key=key)
    return rounded(result.indices.select("condition", "output_id", "param", "s1", "st"), 7)


@query("union_conditions", f"SELECT condition, param, {sr('st', 7)} AS st FROM ({CONDITION_SQL})")
def _union_conditions(t):
    idx = condition_indices(t)
    parts = {c: idx.where(F.col("condition") == c).select("param", "st") for c in PRIORITIES}
    return rounded(conditions.union_conditions({**parts, "absent": None}), 7)


RANKS_SQL = f"SELECT condition, param, st, CAST(row_number() OVER (PARTITION BY condition ORDER BY st DESC, param) AS INTEGER) AS rank FROM ({CONDITION_SQL})"


@query("param_ranks", f"SELECT condition, param, rank FROM ({RANKS_SQL})")
def _param_ranks(t):
    return conditions.param_ranks(condition_indices(t)).select("condition", "param", "rank")


@query("rank_stability", f"""
SELECT param, {sr('least(greatest(1 - stddev_pop(rank) / 1.0, 0), 1)')} AS stability FROM ({RANKS_SQL}) GROUP BY 1""")
def _rank_stability(t):
    return rounded(conditions.rank_stability(condition_indices(t).select("condition", "param", "st")))


@query("universal_drivers", f"SELECT param, {sr('min(st)', 7)} AS min_st FROM ({CONDITION_SQL}) GROUP BY 1 HAVING min(st) >= 0.01")
def _universal_drivers(t):
    return rounded(conditions.universal_drivers(condition_indices(t), 0.01), 7)


SPECIFIC_SQL = f"""
WITH s AS ({CONDITION_SQL}) SELECT condition, param, {sr('st', 7)} AS st FROM s WHERE st >= 0.01
  AND EXISTS (SELECT 1 FROM s o WHERE o.param = s.param AND o.condition <> s.condition AND o.st < 0.01 * 0.5)"""


@query("condition_specific", SPECIFIC_SQL)
def _condition_specific(t):
    return rounded(conditions.condition_specific(condition_indices(t), 0.01), 7)


@query("exists_lower", SPECIFIC_SQL.replace("0.01", "0.012"))
def _exists_lower(t):
    st = condition_indices(t).select("condition", "param", "st")
    return rounded(conditions.exists_lower(st, 0.012, 0.006), 7)


@query("differential_sobol", f"""
WITH s AS ({CONDITION_SQL}) SELECT a.condition || '_vs_' || b.condition AS pair, a.param, {sr('a.st - b.st', 7)} AS difference
FROM s a JOIN s b ON a.param = b.param AND a.condition < b.condition""")
def _differential_sobol(t):
    return rounded(conditions.differential_sobol(condition_indices(t)), 7)


@query("condition_pairs", f"""
WITH s AS ({CONDITION_SQL}) SELECT a.condition || '_vs_' || b.condition AS pair, {sr('sum(abs(a.st - b.st))', 7)} AS distance
FROM s a JOIN s b ON a.param = b.param AND a.condition < b.condition GROUP BY 1""")
def _condition_pairs(t):
    diff = conditions.differential_sobol(condition_indices(t))
    return diff.groupBy("pair").agg(rnd(F.sum(F.abs("difference")), 7).alias("distance"))


@query("compare_runs", f"""
SELECT param, {sr("coalesce(max(CASE WHEN l_returnflag = 'A' THEN st END), 0)", 8)} AS A, {sr("coalesce(max(CASE WHEN l_returnflag = 'R' THEN st END), 0)", 8)} AS R,
  {sr("coalesce(max(CASE WHEN l_returnflag = 'N' THEN st END), 0)", 8)} AS N,
  {sr("coalesce(max(CASE WHEN l_returnflag = 'R' THEN st END), 0) - coalesce(max(CASE WHEN l_returnflag = 'A' THEN st END), 0)", 8)} AS delta
FROM ({SOBOL2_SQL}) WHERE output_id = 'y1' GROUP BY param HAVING count(*) FILTER (WHERE l_returnflag = 'A') > 0""")
def _compare_runs(t):
    st = indices(t).where("output_id = 'y1'").select("l_returnflag", "param", "st")
    two, three = (conditions.compare_runs(st, runs, run="l_returnflag") for runs in (["A", "R"], ["A", "N", "R"]))
    return rounded(three.join(two.select("param", "delta"), "param"), 8)


@query("key_findings", f"""
WITH s AS (SELECT param_id, param, avg(st) AS st FROM ({STRATEGY_SOBOL_SQL}) WHERE strategy = 'uniform' GROUP BY 1, 2),
  p AS (SELECT CAST(group_value AS BIGINT) AS stage, round(sum(st), 9) AS total FROM ({STRATEGY_SOBOL_SQL}) WHERE strategy = 'growth_stage' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
  b AS (SELECT arg_max(param, (st, -param_id)) AS top_param, max(st) * 100 AS top_percent, arg_min(param, (st, param_id)) AS bottom_param, min(st) * 100 AS bottom_percent FROM s)
SELECT top_param, {sr('top_percent', 5)} AS top_percent, bottom_param, {sr('bottom_percent', 5)} AS bottom_percent,
  CASE WHEN top_percent > 50 THEN 'measure ' || top_param || ' first: more than half of the spread comes from it'
    WHEN top_percent > 20 THEN top_param || ' matters most, but the others together matter more' ELSE 'the spread is shared by many inputs' END AS recommendation, stage AS peak_stage, stage * 10 AS peak_from_percent, (stage + 1) * 10 AS peak_to_percent FROM b, p""")
def _key_findings(t):
    result = strategy_result(t).indices
    uniform = result.where("strategy = 'uniform'").groupBy("param_id", "param").agg(F.avg("st").alias("st"))
    stages = result.where("strategy = 'growth_stage'").withColumnRenamed("group_value", "stage").withColumn("st", F.col("st"))
    peak = sobol.peak_stage(stages.groupBy("stage").agg(F.round(F.sum("st"), 9).alias("st")))
    return rounded(conditions.key_findings(uniform, peak, 10), 5)
