"""Summary tables, parameter documents, run collections, saved results and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varienne.functions.basis import PolynomialBasis
from varienne.operators import design, sobol
from varienne.operators.observables import DRY_MASS, VOLUME
from varienne.plans import quantify
from varienne.session import scratch_path
from varienne.sinks import designs
from varienne.sinks import tables as sinks
from varienne.sources import params, runs, summaries
from varienne.streaming import jobs
from varienne.workloads.fit_sql import fit_sql, share_sql, sobol_sql
from varienne.workloads.registry import query, rnd, rounded, sr
from varienne.workloads.sensitivity import (
    BASIS2, FIT2_SQL, FLAG, GERM, SOBOL2_SQL, STRATEGY_FIT_SQL, SAMPLE_BASIS, SAMPLE_BOUNDS, coef_rows, coef_sql, fitted, indices, strategy_result,
)
from varienne.workloads.tables import DESIGN_SQL, GROWTH_SQL, HISTORY_SQL, LINEITEM_BOUNDS

H = f"WITH h AS ({HISTORY_SQL}) "

# --- summary tables ----------------------------------------------------------------------

#: Per (supplier nation, module): mean and deviation of prices per brand, as a summary file.
MODULES = {"cd1_transcriptomics": ("transcriptomics.tsv", "l_quantity"), "cd1_proteomics": ("proteomics.tsv", "l_extendedprice")}
#: African suppliers never ran the second analysis, so their file has to come from another variant.
WITHOUT_AFRICA = "WHERE r_name <> 'AFRICA'"
SUMMARY_SQL = " UNION ALL ".join(
    f"SELECT s_nationkey AS variant, '{m}' AS module, p_brand AS identifier, avg({c}) AS mean, stddev_pop({c}) AS std FROM lineitem "
    f"JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey "
    f"{WITHOUT_AFRICA if m == 'cd1_proteomics' else ''} GROUP BY ALL"
    for m, (_, c) in MODULES.items())


def summary_tree(t) -> str:
    """Summary files in their usual layout: a header line and tab-separated rows."""

    def write(path: str) -> None:
        joined = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        joined = joined.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        rows = None
        for module, (_, column) in MODULES.items():
            part = joined if module != "cd1_proteomics" else joined.where("r_name <> 'AFRICA'")
            part = part.groupBy(F.col("s_nationkey").alias("variant"), F.col("p_brand").alias("identifier")).agg(
                F.avg(column).alias("mean"), F.stddev_pop(column).alias("std")).withColumn("module", F.lit(module))
            rows = part if rows is None else rows.unionByName(part)
        for module in MODULES:
            rows.where(F.col("module") == module).select(F.concat(F.lit("  "), "identifier").alias("identifier"), "mean", "std", "variant").repartition("variant").write.partitionBy("variant").option("sep", "\t").option("header", "true").csv(f"{path}/{module}")

    return t.written("summary", write)


def scanned(t):
    """All rows with the location read from this writer's layout."""
    raw = summaries.scan_summary_tsv(t.spark, summary_tree(t), glob="*.csv")
    here = F.regexp_extract("file_path", r"/(cd1_[a-z]+)/variant=(\d+)/", 1), F.regexp_extract("file_path", r"/(cd1_[a-z]+)/variant=(\d+)/", 2)
    module, variant = here
    name = F.when(module == "cd1_transcriptomics", "transcriptomics.tsv").otherwise("proteomics.tsv")
    usual = F.concat(F.lit("/out/analyses/variant="), variant, F.lit("/plots/analysis="), module, F.lit("/"), name)
    return raw.withColumn("file_path", usual)


@query("scan_summary_tsv", f"""
SELECT variant, module, identifier, {sr('mean', 5)} AS mean, {sr('std', 5)} AS std FROM ({SUMMARY_SQL}) WHERE std IS NOT NULL""")
def _scan_summary_tsv(t):
    return rounded(summaries.with_locations(scanned(t)).select("variant", "module", "identifier", "mean", "std"), 5)


@query("locate_summaries", f"""
WITH f AS (SELECT DISTINCT variant, module, CASE module WHEN 'cd1_transcriptomics' THEN 'transcriptome' ELSE 'proteome' END AS preset FROM ({SUMMARY_SQL})),
p AS (SELECT *, '/out/analyses/variant=' || variant || '/plots/analysis=' || module || '/' || CASE module WHEN 'cd1_transcriptomics' THEN 'transcriptomics.tsv' ELSE 'proteomics.tsv' END AS path FROM f)
SELECT n.n_nationkey AS wanted_variant, a.preset, coalesce(o.path, a.path) AS file_path, o.path IS NOT NULL AS exact
FROM nation n CROSS JOIN (SELECT preset, min(path) AS path FROM p GROUP BY 1) a LEFT JOIN p o ON o.preset = a.preset AND o.variant = n.n_nationkey""")
def _locate_summaries(t):
    return summaries.locate_summaries(scanned(t), t.nation.select(F.col("n_nationkey").alias("wanted_variant")))


@query("multi_sample_matrix", f"""
SELECT variant, module || ':' || identifier AS output_id, {sr('mean', 5)} AS y, {sr('std', 5)} AS std FROM ({SUMMARY_SQL}) WHERE std IS NOT NULL""")
def _multi_sample_matrix(t):
    return rounded(summaries.sample_matrix(scanned(t)), 5)


# --- parameter documents -------------------------------------------------------------------


def part_documents(t):
    """Nested parameter documents, one per part."""
    return t.part.select("p_partkey", F.struct(
        F.struct(F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand")).alias("shape")).alias("process"),
        F.struct(F.col("p_type").alias("type"), F.sequence(F.lit(1), F.col("p_size") * 10).alias("grid")).alias("mass"),
    ).alias("doc"))


@query("flatten_params", """
SELECT p_partkey, unnest(['process.shape.size', 'process.shape.brand', 'mass.type', 'mass.grid']) AS path,
  unnest([CAST(p_size AS VARCHAR), p_brand, p_type, '[' || array_to_string(range(1, p_size * 10 + 1), ',') || ']']) AS value, unnest(['int', 'string', 'string', 'array<int>']) AS dtype FROM part""")
def _flatten_params(t):
    return params.flatten_params(part_documents(t), "doc", ["p_partkey"]).drop("unit")


def spec_file(t) -> str:
    """Parameter specifications as one JSON list: a parameter per part brand."""

    def write(path: str) -> None:
        spec = t.part.groupBy("p_brand").agg(F.min("p_size").cast("double").alias("lo"), F.max("p_size").cast("double").alias("hi"))
        item = F.struct(F.col("p_brand").alias("name"), F.concat(F.lit("process.brands."), "p_brand").alias("attr_path"), F.array("lo", "hi").alias("bounds"), F.lit("a brand").alias("description"))
        spec.agg(F.to_json(F.collect_list(item)).alias("value")).coalesce(1).write.text(path)

    return t.written("specs", write)


PARAM_SQL = """SELECT CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS param_id, p_brand AS name, 'process.brands.' || p_brand AS attr_path,
  CAST(min(p_size) AS DOUBLE) AS lo, CAST(max(p_size) AS DOUBLE) AS hi FROM part GROUP BY p_brand"""


@query("read_params", f"SELECT *, 'a brand' AS description FROM ({PARAM_SQL})")
def _read_params(t):
    return params.read_params(t.spark, spec_file(t)).select("param_id", "name", "attr_path", "lo", "hi", "description")


@query("validate_paths", f"SELECT name, attr_path FROM ({PARAM_SQL}) WHERE attr_path NOT IN (SELECT 'process.brands.' || p_brand FROM part WHERE p_size > 49)")
def _validate_paths(t):
    tree = t.part.where("p_size > 49").select(F.concat(F.lit("process.brands."), "p_brand").alias("path"))
    return params.validate_paths(params.read_params(t.spark, spec_file(t)), tree).select("name", "attr_path")


@query("match_parameters", f"""
WITH p AS ({PARAM_SQL}), c AS (SELECT CASE WHEN p_brand < 'Brand#15' THEN p_brand ELSE p_brand || '_old' END AS name, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1)
SELECT c.name, coalesce(p.attr_path, c.name) AS attr_path, coalesce(p.lo, c.lo) AS lo, coalesce(p.hi, c.hi) AS hi, p.name IS NOT NULL AS matched FROM c LEFT JOIN p ON p.name = c.name""")
def _match_parameters(t):
    name = F.when(F.col("p_brand") < "Brand#15", F.col("p_brand")).otherwise(F.concat("p_brand", F.lit("_old")))
    cached = t.part.groupBy(name.alias("name")).agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return params.match_parameters(params.read_params(t.spark, spec_file(t)), cached)


@query("label_lookup", """
SELECT l_orderkey, l_linenumber, l_suppkey, s_name, n_name FROM lineitem LEFT JOIN (SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey) ON l_suppkey = s_suppkey""")
def _label_lookup(t):
    named = params.label_lookup(t.supplier.withColumnRenamed("s_nationkey", "n_nationkey"), t.nation, "n_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "n_name")
    return params.label_lookup(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"), named, "l_suppkey")


@query("index_runs", """
SELECT 'run_' || s_suppkey AS run_id, unnest(['balance', 'nation', 'missing']) AS param,
  unnest([s_acctbal, CAST(s_nationkey AS DOUBLE), 0.0::DOUBLE]) AS x FROM supplier""")
def _index_runs(t):
    # Configuration documents as the runs would have written them, alternating both layouts.
    pair = F.struct(F.col("s_acctbal").alias("balance"), F.struct(F.lit(2).alias("__index__"), F.col("s_nationkey").alias("__value__")).alias("nation"))
    single = F.to_json(F.struct(F.struct(F.struct(pair.alias("mutations")).alias("sim_data_setattr")).alias("variants")))
    batch = F.to_json(F.struct(F.struct(F.struct(F.struct(F.array(pair).alias("value")).alias("mutations")).alias("sim_data_setattr")).alias("variants")))
    configs = t.supplier.select(
        F.concat(F.lit("run_"), F.col("s_suppkey").cast("string")).alias("run_id"), F.when(F.col("s_suppkey") % 2 == 0, single).otherwise(batch).alias("config"))
    return params.run_parameters(configs, ["balance", "nation", "missing"])


# --- run collections -----------------------------------------------------------------------


def run_trees(t) -> str:
    """One history tree per line number, all written at once."""
    return t.written("runs", lambda path: t.lineitem.select(F.col("l_linenumber").alias("uq_sample"), "l_quantity", "l_extendedprice").write.partitionBy("uq_sample").parquet(path))


def planned_samples(t):
    """Every line number, and one more sample that never ran."""
    numbers = t.lineitem.select(F.col("l_linenumber").alias("sample_id")).distinct()
    extra = numbers.agg((F.max("sample_id") + 1).alias("sample_id"))
    return numbers.unionByName(extra)


@query("collect_runs", f"""
SELECT l_linenumber AS sample_id, {sr('avg(l_quantity)')} AS l_quantity, {sr('avg(l_extendedprice)', 4)} AS l_extendedprice, l_linenumber * 0.5::DOUBLE AS x
FROM lineitem GROUP BY l_linenumber""")
def _collect_runs(t):
    samples = planned_samples(t).withColumn("x", F.col("sample_id") * F.lit(0.5))
    trees = runs.scan_run_trees(t.spark, run_trees(t))
    return rounded(runs.collect_runs(trees, samples, ["l_quantity", "l_extendedprice"]), 6, l_extendedprice=4)


@query("missing_runs", "SELECT max(l_linenumber) + 1 AS sample_id FROM lineitem")
def _missing_runs(t):
    return runs.missing_runs(runs.scan_run_trees(t.spark, run_trees(t)), planned_samples(t))


# --- saved designs and results ---------------------------------------------------------------


def saved_design(t):
    """The lineitem design with germ, outputs, a series of three steps and labels; orders divisible by five are held out."""

    def write(path: str) -> None:
        d = t.design.withColumns(dict(zip(GERM, design.germ_columns(LINEITEM_BOUNDS))))
        keys = ["l_orderkey", "l_linenumber"]
        tables = {}
        for prefix, rows in (("", d.where("l_orderkey % 5 <> 0")), ("test_", d.where("l_orderkey % 5 = 0"))):
            tables |= {
                f"{prefix}design": rows.select(*keys, *LINEITEM_BOUNDS), f"{prefix}germ": rows.select(*keys, *GERM), f"{prefix}y": rows.select(*keys, "y0", "y1"),
                f"{prefix}series": rows.select(*keys, F.posexplode(F.array("y0", "y1", F.col("y1") - F.col("y0"))).alias("step", "value")),
                f"{prefix}labels": rows.select(*keys, "l_returnflag", "l_linestatus")}
        designs.save_design(t.spark, path, tables, keys, list(LINEITEM_BOUNDS), buckets=8)

    return designs.load_design(t.spark, t.written("design", write))


@query("save_design", """
SELECT l_orderkey, l_linenumber, l_discount, l_tax, l_quantity, CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM lineitem""")
def _save_design(t):
    saved = saved_design(t).tables
    return saved["design"].withColumn("split", F.lit("train")).unionByName(saved["test_design"].withColumn("split", F.lit("test")))


@query("load_design", f"""
SELECT l_orderkey, l_linenumber, {sr('g0', 9)} AS g0, {sr('g1', 9)} AS g1, {sr('g2', 9)} AS g2, {sr('y0', 6)} AS y0, {sr('y1', 6)} AS y1, l_returnflag, l_linestatus, l_orderkey % 5 = 0 AS test FROM ({DESIGN_SQL})
WHERE (l_orderkey, l_linenumber) IN (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1)""")
def _load_design(t):
    """Germ, outputs and labels of every line that its key names, by value, joined bucket by bucket."""
    saved, keys = saved_design(t), ["l_orderkey", "l_linenumber"]
    out = None
    for prefix in ("", "test_"):
        part = {n: saved.tables[prefix + n] for n in ("germ", "y", "labels")}
        once = part["y"].groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
        rows = once.join(part["germ"], keys).join(part["y"], keys).join(part["labels"], keys).withColumn("test", F.lit(prefix == "test_"))
        out = rows if out is None else out.unionByName(rows)
    return rounded(out, 6, g0=9, g1=9, g2=9)


@query("load_series", f"""
SELECT l_orderkey, l_linenumber, CAST(step AS INTEGER) AS step, {sr('value', 6)} AS value, l_orderkey % 5 = 0 AS test FROM (
  SELECT l_orderkey, l_linenumber, unnest([0, 1, 2]) AS step, unnest([y0, y1, y1 - y0]) AS value FROM ({DESIGN_SQL}))""")
def _load_series(t):
    saved = saved_design(t).tables
    return rounded(saved["series"].withColumn("test", F.lit(False)).unionByName(saved["test_series"].withColumn("test", F.lit(True))))


@query("design_manifest", """
SELECT * FROM (SELECT CAST(1 AS BIGINT) AS version, CAST(8 AS INTEGER) AS buckets, 'l_discount,l_tax,l_quantity' AS parameters, prefix || name AS table_name, CASE WHEN name = 'series' THEN 3 * n ELSE n END AS n_rows
FROM (SELECT unnest(['design', 'germ', 'y', 'series', 'labels']) AS name), (SELECT CASE WHEN l_orderkey % 5 = 0 THEN 'test_' ELSE '' END AS prefix, count(*) AS n FROM lineitem GROUP BY 1))""")
def _design_manifest(t):
    """What the manifest says of the tables; their rows have the digests that were saved."""
    saved = saved_design(t)
    if saved.changed():
        raise ValueError(f"tables differ from what was saved: {saved.changed()}")
    rows = [(saved.version, saved.buckets, ",".join(saved.parameters), name, n) for name, (n, _) in saved.hashes.items()]
    return t.spark.createDataFrame(rows, "version bigint, buckets int, parameters string, table_name string, n_rows bigint")


def exported(t) -> str:
    def write(path: str) -> None:
        fits = fitted(t).withColumns({"strategy": F.lit("flag"), "group_value": F.col("l_returnflag")})
        idx = indices(t).withColumns({"strategy": F.lit("flag"), "group_value": F.col("l_returnflag")})
        sinks.export_results(path, idx, fits.select("strategy", "group_value", "l_returnflag", "output_id", "coef"))

    return t.written("results", write)


@query("export_results", f"SELECT l_returnflag, output_id, param, {sr('s1', 8)} AS s1, {sr('st', 8)} AS st FROM ({SOBOL2_SQL})")
def _export_results(t):
    return rounded(sinks.read_results(t.spark, exported(t), "indices").select("l_returnflag", "output_id", "param", "s1", "st"), 8)


@query("read_results", coef_sql(FIT2_SQL, BASIS2))
def _read_results(t):
    return coef_rows(sinks.read_results(t.spark, exported(t), "surrogate"), BASIS2)


@query("summary_document", f"""
WITH g AS ({GROWTH_SQL}), f AS ({STRATEGY_FIT_SQL}), w AS (SELECT *, vy / sum(vy) OVER (PARTITION BY strategy, group_value) AS w FROM f)
""" + " UNION ALL ".join(
    f"SELECT strategy, CAST(group_value AS BIGINT) AS group_value, '{name}' AS param, {sr(f'sum(w * ({share_sql(SAMPLE_BASIS, lambda a: a[i])}))', 5)} AS first_order, {sr(f'sum(w * ({share_sql(SAMPLE_BASIS, lambda a: a[i])}))', 5)} AS total_order FROM w GROUP BY 1, 2"
    for i, name in enumerate(SAMPLE_BOUNDS)))
def _summary_document(t):
    """The nested summary, written as JSON, read back and unrolled."""
    doc = quantify.summary_document(strategy_result(t), digits=12)
    path = scratch_path(t.spark, "summary-json")
    doc.write.json(path)
    back = t.spark.read.schema(doc.schema).json(path)
    groups = back.select("strategy", F.inline("groups")).select("strategy", "group_value", F.inline("indices"))
    return rounded(groups.select("strategy", F.col("group_value").cast("bigint").alias("group_value"), "param", "first_order", "total_order"), 5)


MANIFEST = {"events": ["event_id", "user_id", "event_type", "props"], "nation": ["n_nationkey", "n_name"], "documents": ["doc_id", "text", "lang", "source"]}


@query("manifest", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, '{','.join(cols)}' AS columns, count(*) AS n_rows, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', {', '.join(f'CAST({c} AS VARCHAR)' for c in cols)})), 1, 13) AS BIGINT)) AS VARCHAR) AS data_hash FROM {name}"
    for name, cols in MANIFEST.items()))
def _manifest(t):
    return sinks.manifest({n: getattr(t, n) for n in MANIFEST}, digest="md5", columns=MANIFEST)


@query("export_table", f"""
SELECT rank, line FROM (SELECT CAST(row_number() OVER (ORDER BY avg(st) DESC, param_id) AS INTEGER) AS rank,
  replace(param, '_', '\\_') || ' & ' || printf('%.3f', avg(s1)) || ' & ' || printf('%.3f', avg(st)) || ' \\\\' AS line FROM ({SOBOL2_SQL}) GROUP BY param_id, param)""")
def _export_table(t):
    ranked = sobol.top_parameters(indices(t), None)
    path = scratch_path(t.spark, "report")
    sinks.export_table(ranked, path, "latex", "param", ["s1", "st"], "rank")
    written = t.spark.read.text(path).withColumnRenamed("value", "line")
    return sinks.latex_rows(ranked, "param", ["s1", "st"], "rank").join(written, "line")


# --- streams -----------------------------------------------------------------------------------


#: Rows of a history file in the stream, and the files of a small one.
CHUNK_ROWS = 1_000_000
MIN_CHUNKS = 4


def history_chunks(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows dealt by a hash of their id: as many chunks as keep each near ``chunk_rows`` rows, so that a task's share does not grow with the table."""
    return rows.repartition(max(MIN_CHUNKS, -(-rows.count() // chunk_rows)), "event_id")


def stream_source(t) -> str:
    """History files in chunks, as a growing directory would hold them."""
    return t.written("stream", lambda path: history_chunks(t.samples).write.parquet(path))


@query("stream_progress", H + "SELECT variant, count(*) AS n_rows, max(time) AS last_time FROM h GROUP BY 1")
def _stream_progress(t):
    source = stream_source(t)
    stream = jobs.stream_history(t.spark, source, t.spark.read.parquet(source).schema, max_files=2)
    output = scratch_path(t.spark, "progress")
    jobs.run_progress(stream, output, scratch_path(t.spark, "progress-state")).awaitTermination()
    return jobs.read_progress(t.spark, output)


PRELIM_BOUNDS = {"x0": (0.0, 19.0), "x1": (0.0, 19.0)}
PRELIM_BASIS = PolynomialBasis(tuple(PRELIM_BOUNDS), 2)
PRELIM_SQL = sobol_sql(fit_sql(f"""
SELECT output_id, y, 2 * sample_id / 19.0 - 1 AS g0, 2 * ((sample_id * 7) % 20) / 19.0 - 1 AS g1 FROM (
  SELECT variant AS sample_id, '{DRY_MASS}' AS output_id, avg(dry_mass) AS y FROM ({HISTORY_SQL}) GROUP BY 1
  UNION ALL SELECT variant, '{VOLUME}', avg(volume) FROM ({HISTORY_SQL}) GROUP BY 1)""", PRELIM_BASIS, ["g0", "g1"], ["output_id"]), PRELIM_BASIS, ["output_id"])


@query("stream_preliminary_sobol", f"SELECT output_id, param, {sr('s1')} AS s1, {sr('st')} AS st, (SELECT CAST(count(DISTINCT user_id % 20) AS INTEGER) FROM events) AS n_completed FROM ({PRELIM_SQL})")
def _stream_preliminary_sobol(t):
    from varienne.workloads.sensitivity import sample_design

    source = stream_source(t)
    stream = jobs.stream_history(t.spark, source, t.spark.read.parquet(source).schema, max_files=4)
    output = scratch_path(t.spark, "preliminary")
    jobs.run_preliminary_sobol(
        stream, sample_design(t), PRELIM_BOUNDS, [DRY_MASS, VOLUME], output, scratch_path(t.spark, "preliminary-state")).awaitTermination()
    return rounded(jobs.read_preliminary(t.spark, output).select("output_id", "param", "s1", "st", "n_completed"))
