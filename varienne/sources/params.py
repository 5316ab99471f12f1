"""Input parameters: specifications, nested parameter documents, run configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARAM_SCHEMA = "name string, attr_path string, bounds array<double>, index int, description string"

# The default inputs as (name, attribute path, low, high).
DEFAULT_PARAMETERS = (
    ("fraction_active_rnap_free", "process.transcription.fraction_active_rnap_free", 0.25, 0.47),
    ("fraction_active_rnap_bound", "process.transcription.fraction_active_rnap_bound", 0.12, 0.22),
    ("basal_elongation_rate", "process.translation.basal_elongation_rate", 15.0, 28.0),
    ("kinetic_objective_weight", "process.metabolism.kinetic_objective_weight", 5e-8, 5e-7),
    ("secretion_penalty_coeff", "process.metabolism.secretion_penalty_coeff", 5e-4, 5e-3),
    ("cell_dry_mass_fraction", "mass.cell_dry_mass_fraction", 0.25, 0.35),
)


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """Parameter specifications from a JSON list: (param_id, name, attr_path, lo, hi, idx, description)."""
    spec = spark.read.schema(PARAM_SCHEMA).option("multiLine", "true").json(path)
    return normalize_params(spec)


def normalize_params(spec: DataFrame) -> DataFrame:
    """Give specifications an id in name order and split the bounds."""
    ordered = F.array_sort(F.collect_list(F.struct("name", "attr_path", "bounds", "index", "description")))
    rows = spec.agg(ordered.alias("specs")).select(F.posexplode("specs").alias("param_id", "spec"))  # dozens of rows
    return rows.select(
        "param_id", "spec.name", "spec.attr_path",
        F.element_at("spec.bounds", 1).alias("lo"), F.element_at("spec.bounds", 2).alias("hi"),
        F.col("spec.index").alias("idx"), "spec.description",
    )


def default_params(spark: SparkSession) -> DataFrame:
    rows = [(i, n, p, lo, hi, None, "") for i, (n, p, lo, hi) in enumerate(DEFAULT_PARAMETERS)]
    return spark.createDataFrame(
        rows, "param_id int, name string, attr_path string, lo double, hi double, idx int, description string"
    )


def params_table(spark: SparkSession, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Parameter table from a name -> (lo, hi) mapping, ids in mapping order."""
    rows = [(i, n, n, float(lo), float(hi)) for i, (n, (lo, hi)) in enumerate(bounds.items())]
    return spark.createDataFrame(rows, "param_id int, name string, attr_path string, lo double, hi double")


def _leaves(schema: T.DataType, path: tuple[str, ...], depth: int, max_depth: int):
    for field in schema:
        here = (*path, field.name)
        if isinstance(field.dataType, T.StructType) and depth < max_depth:
            yield from _leaves(field.dataType, here, depth + 1, max_depth)
        else:
            yield here, field.dataType


def _text(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    return F.coalesce(c.cast("string"), F.lit(""))


def flatten_params(df: DataFrame, column: str, keys: list[str] | None = None, max_depth: int = 3) -> DataFrame:
    """Nested parameter document to long rows (path, value, unit, dtype).

    The tree is walked in the schema; the rows come from one explode of a constant
    number of structs, so the document table is read once and never shuffled.  Arrays are
    kept whole, as JSON.
    """
    root = df.schema[column].dataType
    entries = []
    for path, dtype in _leaves(root, (), 0, max_depth):
        leaf = F.col(".".join(f"`{p}`" for p in (column, *path)))
        entries.append(
            F.struct(
                F.lit(".".join(path)).alias("path"),
                _text(leaf, dtype).alias("value"),
                F.lit(None).cast("string").alias("unit"),
                F.lit(dtype.simpleString()).alias("dtype"),
            )
        )
    return df.select(*(keys or []), F.explode(F.array(*entries)).alias("leaf")).select(*(keys or []), "leaf.*")


def validate_paths(params: DataFrame, tree: DataFrame) -> DataFrame:
    """Parameters whose attribute path is missing from the flattened tree."""
    return params.join(tree.select(F.col("path").alias("attr_path")).distinct(), "attr_path", "left_anti")


def require_paths(params: DataFrame, tree: DataFrame) -> None:
    missing = [r.attr_path for r in validate_paths(params, tree).select("attr_path").take(20)]
    if missing:
        raise ValueError(f"parameter paths not found: {missing}")


def match_parameters(params: DataFrame, cached: DataFrame) -> DataFrame:
    """Reconcile specifications with cached names and bounds.

    ``cached`` has (name, lo, hi).  A known name keeps its specification, an unknown
    one is rebuilt from the cached bounds, and ``matched`` tells which.
    """
    spec = params.select("name", F.col("attr_path").alias("_path"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    return cached.join(spec, "name", "left").select(
        "name",
        F.coalesce("_path", "name").alias("attr_path"),
        F.coalesce("_lo", "lo").alias("lo"),
        F.coalesce("_hi", "hi").alias("hi"),
        F.col("_path").isNotNull().alias("matched"),
    )


def label_lookup(df: DataFrame, labels: DataFrame, on: str) -> DataFrame:
    """Attach descriptions or units by name; unknown names keep null labels."""
    return df.join(labels, on, "left")


def read_run_configs(spark: SparkSession, root: str) -> DataFrame:
    """Every run's configuration document with the name of its directory."""
    return (
        spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="config.json")
        .select(
            F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/config\.json$", 1).alias("run_id"),
            F.col("value").alias("config"),
        )
    )


def run_parameters(configs: DataFrame, names: list[str]) -> DataFrame:
    """Long design (run_id, param, x) out of run configurations.

    Mutations are either one mapping or a batch whose first entry counts; a value is a
    number or a document with ``__value__``; a missing one is 0.
    """
    mutations = "$.variants.sim_data_setattr.mutations"
    doc = F.coalesce(
        F.get_json_object("config", f"{mutations}.value[0]"), F.get_json_object("config", mutations)
    )
    values = F.from_json(doc, "map<string,string>")
    base = configs.select("run_id", values.alias("m"))
    pairs = []
    for name in names:
        raw = F.try_element_at(F.col("m"), F.lit(name))
        value = F.coalesce(F.get_json_object(raw, "$.__value__"), raw).try_cast("double")
        pairs.append(F.struct(F.lit(name).alias("param"), F.coalesce(value, F.lit(0.0)).alias("x")))
    return base.select("run_id", F.explode(F.array(*pairs)).alias("p")).select("run_id", "p.*")
