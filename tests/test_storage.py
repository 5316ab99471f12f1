import json
import os

import pytest
from pyspark.sql import functions as F

from varienne.functions.basis import PolynomialBasis
from varienne.operators.observables import DRY_MASS
from varienne.session import scratch_path
from varienne.sinks import designs
from varienne.sinks import tables as sinks
from varienne.sources import history, params, runs, summaries, synthetic
from varienne.streaming import jobs


@pytest.fixture(scope="module")
def tree(spark):
    df = synthetic.synthetic_history(spark, experiments=2, seeds=2, generations=2, timepoints=5).withColumn("variant", F.col("experiment_id"))
    df = df.withColumn("agent_id", F.concat(F.lit("00"), (F.col("generation") % 2).cast("string")))
    path = scratch_path(spark, "tree")
    df.write.partitionBy("experiment_id", "variant", "lineage_seed", "generation", "agent_id").parquet(path)
    return path


def test_scan_history_types_and_pruning(spark, tree):
    df = history.scan_history(spark, tree)
    assert {f.name: f.dataType.simpleString() for f in df.schema if f.name in history.ID_COLUMNS} == history.ID_TYPES
    assert df.count() == 40
    plan = history.bounds_filter(df, 1, 3.0).select("time", DRY_MASS)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(generation" in plan and "PushedFilters: [IsNotNull(time), GreaterThanOrEqual(time,3.0)]" in plan
    assert "ReadSchema: struct<time:double,listeners__mass__dry_mass:double>" in plan
    assert history.load_dataset(spark, tree, "1", [DRY_MASS, "gone"]).columns == [*history.METADATA_COLUMNS, DRY_MASS]
    assert history.load_dataset(spark, tree, ["0", "1"], [DRY_MASS]).count() == 40


def test_missing_history(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        history.scan_history(spark, str(tmp_path / "nothing"))


def test_columns(spark, tree):
    df = history.scan_history(spark, tree)
    assert history.list_columns(df, "*growth*") == ["listeners__fba_results__growth"]
    assert not set(history.observable_columns(df)) & set(history.METADATA_COLUMNS)
    assert history.column_catalog(df, "listeners__mass__*").count() == 4
    counts = history.parse_json_arrays(df, "listeners__rna_counts__mRNA_cistron_counts").select(F.size("listeners__rna_counts__mRNA_cistron_counts").alias("n"))
    assert counts.distinct().first().n == 10


def test_synthetic_history_is_deterministic(spark):
    make = lambda p: synthetic.synthesize(synthetic.history_index(spark, 1, 1, 2, 10).repartition(p)).orderBy("time").collect()
    assert make(1) == make(5)


def test_summary_tsv(spark, tmp_path):
    def write(variant, module, name, text):
        folder = tmp_path / f"analyses/variant={variant}/plots/analysis={module}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)

    head = "identifier\tmean\tstd\n"
    write(0, "cd1_transcriptomics", "transcriptomics.tsv", head + " g1 \t1.5\t0.1\n\t9\t9\nshort\t1\ng2\t2.5\t0.2\n")
    write(3, "cd1_proteomics", "proteomics.tsv", head + "p1\t7\t1\n")
    write(0, "cd1_unknown", "x.tsv", head + "u\t7\t1\n")
    raw = summaries.scan_summary_tsv(spark, str(tmp_path))
    rows = {(r.variant, r.output_id): r.y for r in summaries.sample_matrix(raw).collect()}
    assert rows == {(0, "cd1_transcriptomics:g1"): 1.5, (0, "cd1_transcriptomics:g2"): 2.5, (3, "cd1_proteomics:p1"): 7.0}
    found = summaries.locate_summaries(raw, spark.createDataFrame([(0,)], "wanted_variant int")).toPandas().set_index("preset")
    assert bool(found.loc["transcriptome", "exact"]) and not bool(found.loc["proteome", "exact"])
    assert "variant=3" in found.loc["proteome", "file_path"]


def test_run_configs(spark, tmp_path):
    def config(name, mutations):
        os.makedirs(tmp_path / "deep" / name)
        (tmp_path / "deep" / name / "config.json").write_text(json.dumps({"variants": {"sim_data_setattr": {"mutations": mutations}}}, indent=1))

    config("one", {"a": 1.5, "b": {"__index__": 0, "__value__": 2}})
    config("two", {"value": [{"a": 7}, {"a": 8}]})
    got = {(r.run_id, r.param): r.x for r in params.run_parameters(params.read_run_configs(spark, str(tmp_path)), ["a", "b"]).collect()}
    assert got == {("one", "a"): 1.5, ("one", "b"): 2.0, ("two", "a"): 7.0, ("two", "b"): 0.0}


def test_params(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([
        {"name": "b", "attr_path": "m.b", "bounds": [1, 2]}, {"name": "a", "attr_path": "m.a", "bounds": [0.1, 0.5], "index": 3, "description": "d"}]))
    out = params.read_params(spark, str(tmp_path / "p.json")).orderBy("param_id").collect()
    assert [(r.name, r.lo, r.hi, r.idx) for r in out] == [("a", 0.1, 0.5, 3), ("b", 1.0, 2.0, None)]
    tree = spark.createDataFrame([("m.a",)], "path string")
    with pytest.raises(ValueError, match="m.b"):
        params.require_paths(params.read_params(spark, str(tmp_path / "p.json")), tree)
    assert params.default_params(spark).count() == 6


def test_flatten_depth(spark):
    df = spark.sql("select named_struct('a', named_struct('b', named_struct('c', named_struct('d', named_struct('e', 1)))), 'z', cast(null as int)) doc")
    rows = {r.path: r.value for r in params.flatten_params(df, "doc").collect()}
    assert rows == {"a.b.c.d": '{"e":1}', "z": ""}


def test_runs_must_exist(spark, tmp_path):
    for i in (0, 2):
        spark.createDataFrame([(1.0 + i,), (3.0 + i,)], "v double").write.parquet(str(tmp_path / f"uq_sample_{i:04d}/history"))
    trees = runs.scan_run_trees(spark, str(tmp_path))
    samples = spark.createDataFrame([(0, 0.1), (1, 0.2), (2, 0.3)], "sample_id int, x double")
    assert {r.sample_id: r.v for r in runs.collect_runs(trees, samples, ["v"]).collect()} == {0: 2.0, 2: 4.0}
    with pytest.raises(FileNotFoundError, match=r"\[1\]"):
        runs.require_runs(trees, samples)
    spark.createDataFrame([(4, 1.0), (11, 5.0)], "uq_sample int, v double").write.partitionBy("uq_sample").parquet(str(tmp_path / "at_once"))
    assert {r.sample_id: r.v for r in runs.scan_run_trees(spark, str(tmp_path / "at_once")).collect()} == {4: 1.0, 11: 5.0}


def test_saved_design_comes_back_by_value(spark):
    root = scratch_path(spark, "design")
    rows = lambda *r: spark.createDataFrame(list(r), "sample_id bigint, x double")
    series = spark.createDataFrame([(i, t, float(i * t)) for i in range(40) for t in range(3)], "sample_id bigint, time bigint, mass double")
    labels = spark.createDataFrame([(0, "g1", None), (1, "g2", 7)], "sample_id bigint, generation string, seed int")
    tables = {"design": rows(*[(i, i / 3) for i in range(40)]), "germ": rows((0, -1.0), (1, None)), "y": rows((0, 5.0)), "series": series, "labels": labels, "test_design": rows((90, 0.5)), "test_y": rows((90, 1.5))}
    assert designs.save_design(spark, root, tables, parameters=["x"], buckets=4) == 1
    saved = designs.load_design(spark, root)
    assert saved.version == 1 and saved.parameters == ["x"] and set(saved.tables) == set(tables) and saved.changed() == []
    for name, df in tables.items():
        assert saved.tables[name].schema == df.schema
        assert sorted(map(str, saved.tables[name].collect())) == sorted(map(str, df.collect()))
    plan = saved.tables["series"].hint("merge").join(saved.tables["design"], "sample_id")
    assert plan.count() == 120 and "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_large_buckets_are_cut_into_pieces(spark):
    """No file and no join task holds much more than ``piece_rows`` rows, and all tables share the pieces."""
    root = scratch_path(spark, "design")
    series = spark.range(1200).select((F.col("id") % 400).alias("sample_id"), F.floor(F.col("id") / 400).alias("time"), F.col("id").cast("double").alias("mass"))
    y = spark.range(400).select(F.col("id").alias("sample_id"), (F.col("id") / 4).alias("mean"))
    designs.save_design(spark, root, {"series": series, "y": y}, buckets=2, piece_rows=100)
    saved = designs.load_design(spark, root)
    assert (saved.buckets, saved.pieces, saved.changed()) == (2, 6, [])
    sizes = [r["count"] for r in spark.read.parquet(f"{root}/v000001/series").groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 1200 and max(sizes) < 200
    joined = saved.tables["series"].hint("merge").join(saved.tables["y"], "sample_id")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.rdd.getNumPartitions() == 12
    assert sorted((r.sample_id, r.time, r.mass, r["mean"]) for r in joined.collect()) == [(i, t, float(400 * t + i), i / 4) for i in range(400) for t in range(3)]


def test_a_version_counts_once_its_manifest_is_written(spark):
    root = scratch_path(spark, "design")
    one = spark.createDataFrame([(1, 2.0)], "sample_id bigint, x double")
    with pytest.raises(FileNotFoundError):
        designs.load_design(spark, root)
    assert designs.save_design(spark, root, {"design": one}, buckets=2) == 1
    # A writer that broke off before its manifest.
    one.write.parquet(f"{root}/v000002/design")
    assert designs.load_design(spark, root).version == 1 and designs.latest_version(spark, root) == 1
    assert designs.save_design(spark, root, {"design": one.withColumn("x", F.lit(3.0))}, buckets=2) == 3
    assert designs.load_design(spark, root).tables["design"].first().x == 3.0 and designs.load_design(spark, root, 1).tables["design"].first().x == 2.0
    with pytest.raises(FileNotFoundError, match="version 2"):
        designs.load_design(spark, root, 2)
    with pytest.raises(ValueError, match="wrong"):
        designs.save_design(spark, root, {"wrong": one})
    one.write.mode("append").parquet(f"{root}/v000003/design")
    assert designs.load_design(spark, root).changed() == ["design"]


def test_manifest_ignores_order(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    a, b = (sinks.manifest({"t": d}).first() for d in (df, df.orderBy(F.desc("id")).repartition(7)))
    assert a == b and a.n_rows == 100
    assert sinks.manifest({"t": df.where("id < 99")}).first().data_hash != a.data_hash


def test_export_csv_and_bad_format(spark):
    table = spark.createDataFrame([(1, "p_q", 0.5, float("nan"))], "rank int, param string, s1 double, st double")
    path = scratch_path(spark, "csv")
    sinks.export_table(table, path, "csv", "param", ["s1", "st"], "rank")
    assert spark.read.option("header", "true").csv(path).first().param == "p_q"
    assert sinks.latex_rows(table, "param", ["s1", "st"], "rank").first().line == "p\\_q & 0.500 & -- \\\\"
    with pytest.raises(ValueError):
        sinks.export_table(table, path, "xlsx", "param", ["s1"], "rank")


def test_progress_survives_new_files(spark):
    source, out, state = (scratch_path(spark, n) for n in ("source", "progress", "state"))
    make = lambda rows: spark.createDataFrame(rows, "variant int, time double").write.mode("append").parquet(source)
    make([(1, 1.0), (1, 2.0), (2, 1.0)])
    schema = spark.read.parquet(source).schema
    for rows in (None, [(2, 5.0), (3, 1.0)]):
        if rows:
            make(rows)
        jobs.run_progress(jobs.stream_history(spark, source, schema), out, state).awaitTermination()
    got = {r.variant: (r.n_rows, r.last_time) for r in jobs.read_progress(spark, out).collect()}
    assert got == {1: (2, 2.0), 2: (2, 5.0), 3: (1, 1.0)}


def test_chunks_of_the_stream_grow_in_number(spark):
    """Four even chunks for a small history, more for a larger one, and every row in one of them."""
    from varienne.workloads.storage import history_chunks

    for n, chunks in ((1000, 4), (4000, 8)):
        sizes = history_chunks(spark.range(n).withColumnRenamed("id", "event_id"), chunk_rows=500).groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(sizes) == chunks and sum(r["count"] for r in sizes) == n and max(r["count"] for r in sizes) < 650
    assert history_chunks(spark.range(0).withColumnRenamed("id", "event_id")).rdd.getNumPartitions() == 4


def test_preliminary_waits_for_samples(spark):
    source, out, state = (scratch_path(spark, n) for n in ("source", "preliminary", "state"))
    make = lambda ids: spark.createDataFrame([(i, float(i) * 2 + 1) for i in ids], "sample_id int, v double").coalesce(1).write.mode("append").parquet(source)
    design = spark.createDataFrame([(i, float(i)) for i in range(8)], "sample_id int, x double")
    make(range(3))
    schema = spark.read.parquet(source).schema
    run = lambda: jobs.run_preliminary_sobol(jobs.stream_history(spark, source, schema), design, {"x": (0.0, 7.0)}, ["v"], out, state).awaitTermination()
    run()
    make(range(3, 8))
    run()
    row = jobs.read_preliminary(spark, out).first()
    assert row.n_completed == 8 and row.st == pytest.approx(1.0)


def test_preliminary_batches_hold_changed_samples_only(spark):
    source, out, state = (scratch_path(spark, n) for n in ("source", "preliminary", "state"))
    make = lambda rows: spark.createDataFrame(rows, "sample_id int, v double").coalesce(1).write.mode("append").parquet(source)
    design = spark.createDataFrame([(i, float(i)) for i in range(8)], "sample_id int, x double")
    batches = [[(i, float(i)) for i in range(8)], [(2, 4.0)], [(2, 0.0), (5, 9.0)], [(7, 7.0)], [(0, 1.0)]]
    make(batches[0])
    schema = spark.read.parquet(source).schema
    for i, rows in enumerate(batches):
        if i:
            make(rows)
        jobs.run_preliminary_sobol(jobs.stream_history(spark, source, schema), design, {"x": (0.0, 7.0)}, ["v"], out, state, order=1, compact_every=2).awaitTermination()
    sizes = {r.batch_id: r["count"] for r in spark.read.parquet(f"{out}/samples").groupBy("batch_id").count().collect()}
    assert [sizes[i] for i in range(5)] == [8, 1, 2, 1, 1]
    assert [r.upto for r in spark.read.parquet(f"{out}/merged").select("upto").distinct().orderBy("upto").collect()] == [1, 3]
    values = {}
    for rows in batches:
        for k, v in rows:
            values.setdefault(k, []).append(v)
    assert {r.sample_id: r.v for r in jobs.current_samples(spark, out).collect()} == {k: sum(v) / len(v) for k, v in values.items()}
    assert jobs.read_preliminary(spark, out).first().n_completed == 8


def test_windowed_means_drop_closed_windows(spark):
    source, state = scratch_path(spark, "source"), scratch_path(spark, "state")
    spark.sql("select timestamp '2024-01-01 00:00:10' ts, 'a' k, 1.0d v union all select timestamp '2024-01-01 00:03:00', 'a', 3.0d").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    q = jobs.windowed_means(stream, "ts", ["v"], ["k"], "1 minute", "30 seconds").writeStream.format("memory").queryName("windows").option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("windows").collect()
    assert [(r.k, r.n, r.v) for r in rows] == [("a", 1, 1.0)]


def test_basis_terms_table(spark):
    terms = PolynomialBasis(("a", "b"), 2).terms(spark).orderBy("term_id").collect()
    assert [t.alpha for t in terms][:3] == [[0, 0], [1, 0], [0, 1]] and terms[1].norm2 == pytest.approx(1 / 3)


def test_columns_of_one_experiment_are_kept(spark, tmp_path):
    from varienne.sources.history import scan_history

    for name, column in (("e1", "a"), ("e2", "b")):
        spark.createDataFrame([(1.0,)], f"{column} double").write.parquet(str(tmp_path / f"experiment_id={name}"))
    rows = {r.experiment_id: (r.a, r.b) for r in scan_history(spark, str(tmp_path)).collect()}
    assert rows == {"e1": (1.0, None), "e2": (None, 1.0)}
