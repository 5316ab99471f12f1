"""Scans, projections, derived columns and array operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from varienne.functions import numeric
from varienne.operators import observables as obs
from varienne.operators import aggregate
from varienne.operators.observables import CELL_MASS, DRY_MASS, GROWTH_RATE
from varienne.operators.ordered import ordered
from varienne.sources import history as src
from varienne.workloads.registry import query, rnd, rounded, sr
from varienne.workloads.tables import ARRAYS_SQL, COUNTS, FIELD_IDS_SQL, GROWTH, HISTORY_SQL

H = f"WITH h AS ({HISTORY_SQL}) "
A = f"WITH a AS ({ARRAYS_SQL}) "


@query("scan_history", H + f"""
SELECT experiment_id, generation, count(*) AS n, count(DISTINCT agent_id) AS agents, {sr('sum(dry_mass)', 4)} AS total_mass,
  min(time) AS first_time, max(time) AS last_time FROM h GROUP BY ALL""")
def _scan_history(t):
    df = src.scan_history(t.spark, t.history_tree())
    return df.groupBy("experiment_id", "generation").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("agent_id").alias("agents"), rnd(F.sum(DRY_MASS), 4).alias("total_mass"),
        F.min("time").alias("first_time"), F.max("time").alias("last_time"),
    )


@query("scan_experiments", H + f"""
SELECT experiment_id, variant, count(*) AS n, {sr('sum(dry_mass)', 4)} AS total FROM h WHERE experiment_id IN ('exp0', 'exp2') GROUP BY ALL""")
def _scan_experiments(t):
    df = src.load_dataset(t.spark, t.history_tree(), ["exp0", "exp2"], [DRY_MASS])
    return df.groupBy("experiment_id", "variant").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum(DRY_MASS), 4).alias("total"))


@query("list_columns", H + """
SELECT unnest(['listeners__mass__cell_mass', 'listeners__mass__dna_mass', 'listeners__mass__dry_mass', 'listeners__mass__growth',
  'listeners__mass__instantaneous_growth_rate', 'listeners__mass__rna_mass', 'listeners__mass__volume']) AS column_name,
  unnest([count(cell_mass), count(dna_mass), count(dry_mass), count(growth), count(growth_rate), count(rna_mass), count(volume)]) AS present
FROM h""")
def _list_columns(t):
    names = src.list_columns(t.history, "listeners__mass__*")
    counts = t.history.agg(*[F.count(c).alias(c) for c in names])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("present")) for c in names])))


@query("load_timeseries", H + """
SELECT experiment_id, variant, lineage_seed, generation, agent_id, time, dry_mass AS listeners__mass__dry_mass, cell_mass AS listeners__mass__cell_mass
FROM h WHERE generation >= 2 AND time >= 1705700000""")
def _load_timeseries(t):
    return src.load_timeseries(t.history, [DRY_MASS, CELL_MASS, "not_there"], 2, 1705700000.0)


@query("filter_bounds", H + """
SELECT generation, count(*) AS n, min(time) AS first_time FROM h WHERE generation >= 1 AND time >= 1705000000 GROUP BY 1""")
def _filter_bounds(t):
    df = src.bounds_filter(t.history, 1, 1705000000.0)
    return df.groupBy("generation").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first_time"))


@query("preset_scalars", H + f"""
SELECT event_id, {sr('dry_mass')} AS listeners__mass__dry_mass, {sr('coalesce(cell_mass, 0.0)')} AS listeners__mass__cell_mass,
  {sr('volume')} AS listeners__mass__volume, CASE WHEN isnan(growth) THEN -1 ELSE {sr('growth')} END AS listeners__mass__growth,
  {sr('coalesce(growth_rate, 0.0)', 9)} AS listeners__mass__instantaneous_growth_rate FROM h""")
def _preset_scalars(t):
    df = t.history.select("event_id", *obs.scalar_columns(t.history, obs.resolve_preset(t.history, "mass")))
    df = df.withColumn(GROWTH, F.when(F.isnan(GROWTH), F.lit(-1.0)).otherwise(F.col(GROWTH)))
    return rounded(df, 6, **{GROWTH_RATE: 9})


@query("derive_properties", H + f""", d AS (
SELECT event_id, variant, 3600 * coalesce(growth_rate, 0.0) AS gr, dna_mass / CASE WHEN dry_mass > 0 THEN dry_mass ELSE 1 END AS dna,
  coalesce(rna_mass, 0.0) / CASE WHEN dry_mass > 0 THEN dry_mass ELSE 1 END AS rna,
  dry_mass / CASE WHEN coalesce(cell_mass, 1.0) > 0 THEN coalesce(cell_mass, 1.0) ELSE 1 END AS dmf, volume FROM h)
SELECT event_id, {sr('gr')} AS growth_rate_per_hour, {sr('ln(2) / avg(gr) OVER (PARTITION BY variant)')} AS doubling_time_hours,
  {sr('dna')} AS dna_fraction_g_per_g_dw, {sr('rna')} AS rna_fraction_g_per_g_dw, {sr('dmf')} AS dry_mass_fraction, {sr('volume')} AS cell_volume_um3
FROM d""")
def _derive_properties(t):
    d = obs.derive_properties(t.history)
    return rounded(d.select(
        "event_id", "growth_rate_per_hour", "doubling_time_hours", "dna_fraction_g_per_g_dw", "rna_fraction_g_per_g_dw",
        "dry_mass_fraction", "cell_volume_um3",
    ))


@query("normalize_by_mass", A + f"""
SELECT vec_id, CAST(i AS INTEGER) AS idx, {sr('v[i] / CASE WHEN dry_mass = 0 THEN 1 ELSE dry_mass END', 9)} AS value
FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM a)""")
def _normalize_by_mass(t):
    df = t.arrays.withColumn(COUNTS, obs.normalize_by_mass(F.col(COUNTS), F.col(DRY_MASS)))
    return rounded(obs.explode_with_index(df, COUNTS, ["vec_id"]), 9)


@query("flux_conversion", A + f"""
SELECT idx, count(value) AS n, {sr('avg(value)', 9)} AS mean FROM (
  SELECT CAST(i AS INTEGER) AS idx, CASE WHEN dry_mass <> 0 THEN v[i] / (dry_mass / cell_mass * 1100) END AS value
  FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM a)) GROUP BY idx""")
def _flux_conversion(t):
    df = t.arrays.withColumn("flux", obs.convert_fluxes(F.col(COUNTS), F.col(DRY_MASS), F.col(CELL_MASS)))
    long = obs.explode_with_index(df, "flux", [])
    return long.groupBy("idx").agg(F.count("value").alias("n"), rnd(F.avg("value"), 9).alias("mean"))


@query("select_features_by_id", A + f""", f AS ({FIELD_IDS_SQL})
SELECT f.id, count(*) AS n, {sr('avg(v[f.idx])', 9)} AS mean FROM a JOIN f ON f.id LIKE '%EX\\_%' ESCAPE '\\' GROUP BY f.id""")
def _select_features_by_id(t):
    long = obs.explode_with_index(t.arrays, COUNTS, [])
    named = obs.attach_feature_ids(long, t.field_ids, exchange_only=True)
    return named.groupBy("id").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("value"), 9).alias("mean"))


@query("metadata_columns", H + """
SELECT column_name, present FROM (SELECT unnest(['event_id', 'event_type', 'listeners__mass__cell_mass', 'listeners__mass__dna_mass', 'listeners__mass__dry_mass',
  'listeners__mass__growth', 'listeners__mass__instantaneous_growth_rate', 'listeners__mass__rna_mass', 'listeners__mass__volume']) AS column_name,
  unnest([count(event_id), count(event_type), count(cell_mass), count(dna_mass), count(dry_mass), count(growth), count(growth_rate), count(rna_mass), count(volume)]) AS present
FROM h)""")
def _metadata_columns(t):
    names = src.observable_columns(t.history)
    counts = t.history.agg(*[F.count(c).alias(c) for c in names])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("present")) for c in names])))


@query("hive_name", """
SELECT path, replace(path, '.', '__') AS column_name, string_split(path, '.')[-1] AS short, n FROM (
  SELECT 'listeners.' || source || '.' || lang AS path, count(*) AS n FROM documents GROUP BY 1)""")
def _hive_name(t):
    d = t.documents.groupBy(F.concat_ws(".", F.lit("listeners"), "source", "lang").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    name = numeric.hive_name(F.col("path"))
    return d.select("path", name.alias("column_name"), numeric.short_name(name).alias("short"), "n")


@query("search_observables", "SELECT p_partkey, p_name AS output_id FROM part WHERE contains(lower(p_name), 'red')")
def _search_observables(t):
    return obs.search_outputs(t.part.select("p_partkey", F.col("p_name").alias("output_id")), "RED")


@query("unnest_with_index", A + """
SELECT vec_id, CAST(i AS INTEGER) AS idx, v[i] AS value FROM (SELECT *, unnest(range(1, 61 + vec_id % 4)) AS i FROM a)""")
def _unnest_with_index(t):
    ragged = t.arrays.withColumn("v", F.slice(COUNTS, F.lit(1), (60 + F.col("vec_id") % 4).cast("int")))
    return obs.explode_with_index(ragged, "v", ["vec_id"])


@query("array_to_features", A + f"""
SELECT vec_id, 'monomer_counts_' || CAST(i - 1 AS VARCHAR) AS output_id, v[i] AS value
FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM a WHERE vec_id % 10 <> 3)""")
def _array_to_features(t):
    some_null = t.arrays.withColumn(COUNTS, F.when(F.col("vec_id") % 10 != 3, F.col(COUNTS)))
    return obs.array_features(some_null, COUNTS, ["vec_id"])


@query("concat_presets", A + f""", x AS (
SELECT vec_id, CAST(0 AS INTEGER) AS block, 'listeners__mass__dry_mass' AS output_id, dry_mass AS value FROM a
UNION ALL SELECT vec_id, 0, 'listeners__mass__cell_mass', cell_mass FROM a
UNION ALL SELECT vec_id, 1, 'monomer_counts_' || CAST(i - 1 AS VARCHAR), v[i] FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM a))
SELECT block, output_id, count(*) AS n, {sr('avg(value)', 9)} AS mean FROM x GROUP BY ALL""")
def _concat_presets(t):
    long = obs.concat_presets(t.arrays, ["mass", "proteome"], ["vec_id"])
    return long.groupBy("block", "output_id").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("value"), 9).alias("mean"))


@query("flatten_outputs", A + f""", s AS (
SELECT variant, 0 AS block, generation, i AS idx, avg(v[i]) AS mean FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM a) GROUP BY ALL
UNION ALL SELECT variant, 1, lineage_seed, i, avg(v[i]) FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM a) GROUP BY ALL)
SELECT variant, CAST(row_number() OVER (PARTITION BY variant ORDER BY block, generation, idx) AS INTEGER) AS position, {sr('mean', 8)} AS value FROM s""")
def _flatten_outputs(t):
    parts = [
        aggregate.array_stats(t.arrays, COUNTS, ["variant", key], method="vector")
        .select("variant", F.lit(block).alias("block"), F.col(key).alias("group_value"), "idx", "mean")
        for block, key in enumerate(("generation", "lineage_seed"))
    ]
    vectors = aggregate.flatten_outputs(parts[0].unionByName(parts[1]), ["variant"])
    return vectors.select("variant", F.posexplode("vector").alias("p", "value")).select(
        "variant", (F.col("p") + 1).alias("position"), rnd("value", 8).alias("value"))


@query("json_arrays", """
SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])), 6) + 0.0 AS total,
  CAST(len(embedding) AS INTEGER) AS width FROM embeddings""")
def _json_arrays(t):
    as_text = t.embeddings.select("vec_id", F.to_json(F.col("embedding").cast("array<double>")).alias("text"))
    parsed = src.parse_json_arrays(as_text, "text")
    total = F.aggregate("text", F.lit(0.0), lambda a, x: a + x)
    return parsed.select("vec_id", rnd(total).alias("total"), F.size("text").alias("width"))


@query("json_observable", "SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS DOUBLE)) AS total FROM events GROUP BY 1")
def _json_observable(t):
    k = src.json_number("props", "$.k")
    return t.events.groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"))


@query("order_history", H + """
SELECT event_id, row_number() OVER (ORDER BY variant, lineage_seed, generation, time, event_id) AS position FROM h""")
def _order_history(t):
    keys = ["variant", "lineage_seed", "generation"]
    placed = ordered(t.history, [], "time", prefix=keys, ties=["event_id"], row_number="position")
    return src.order_history(placed).select("event_id", "position")


@query("align_dimensions", A + f"""
SELECT idx, count(*) AS n, {sr('avg(value)', 9)} AS mean, (SELECT CAST(sum(vec_id % 4) AS BIGINT) FROM a) AS dropped FROM (
  SELECT CAST(i AS INTEGER) AS idx, v[i] AS value FROM (SELECT *, unnest(range(1, 61)) AS i FROM a)) GROUP BY idx""")
def _align_dimensions(t):
    ragged = t.arrays.withColumn("v", F.slice(COUNTS, F.lit(1), (60 + F.col("vec_id") % 4).cast("int")))
    aligned = aggregate.align_dimensions(ragged, "v", strict=False)
    means = obs.explode_with_index(aligned, "v", []).groupBy("idx").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("value"), 9).alias("mean"))
    return means.withColumn("dropped", aligned.agg(F.sum("dropped").alias("s")).select("s").scalar())


@query("idx_join_feature_id", A + f""", f AS ({FIELD_IDS_SQL})
SELECT f.idx, f.id, {sr('avg(v[f.idx])', 9)} AS mean FROM a JOIN f ON f.idx <= len(v) GROUP BY ALL""")
def _idx_join_feature_id(t):
    stats = aggregate.array_stats(t.arrays, COUNTS, method="vector")
    return rounded(obs.attach_feature_ids(stats, t.field_ids).select("idx", "id", "mean"), 9)


@query("describe_outputs", f"""
SELECT 'proteome' AS field, count(*) AS n_features, count(*) FILTER (WHERE contains(id, 'EX_')) AS n_exchange FROM ({FIELD_IDS_SQL})
UNION ALL SELECT l_returnflag, count(DISTINCT l_partkey), 0 FROM lineitem GROUP BY 1""")
def _describe_outputs(t):
    ids = t.field_ids.select(F.lit("proteome").alias("field"), "id")
    parts = t.lineitem.select(F.col("l_returnflag").alias("field"), F.col("l_partkey").cast("string").alias("id")).distinct()
    return obs.describe_outputs(ids.unionByName(parts))


@query("slider_step", f"""
SELECT p_brand, {sr('CASE WHEN s < 1.5 THEN 1 WHEN s < 3.5 THEN 2 WHEN s < 7.5 THEN 5 ELSE 10 END * m', 9)} AS step FROM (
  SELECT p_brand, power(10, floor(log10(w))) AS m, w / power(10, floor(log10(w))) AS s FROM (
    SELECT p_brand, (max(p_retailprice) - min(p_retailprice)) / 50 AS w FROM part GROUP BY 1))""")
def _slider_step(t):
    bounds = t.part.groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return bounds.select("p_brand", rnd(numeric.slider_step(F.col("lo"), F.col("hi")), 9).alias("step"))


@query("rounding_half_even", """
SELECT l_orderkey, l_linenumber, round_even(CAST(l_tax * 100 AS INTEGER) / 8.0::DOUBLE, 2) + 0.0 AS r2 FROM lineitem""")
def _rounding(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.bround(F.round(F.col("l_tax") * 100).cast("int") / 8.0, 2).alias("r2"))
