"""Per-variant summary tables: tab separated (identifier, mean, std) files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Observable preset -> analysis module and file name.
SUMMARY_FILES = {
    "higher_order": ("cd1_higher_order_properties", "higher_order_properties.tsv"),
    "transcriptome": ("cd1_transcriptomics", "transcriptomics.tsv"),
    "proteome": ("cd1_proteomics", "proteomics.tsv"),
    "fluxome": ("cd1_fluxomics", "cd1_fluxomics_detailed.tsv"),
    "exchange_fluxes": ("cd1_metabolomics", "metabolomics.tsv"),
}
# Fixed value: layout of a summary file below the output directory.
SUMMARY_PATH = r"analyses/variant=(\d+)/plots/analysis=([^/]+)/([^/]+)$"


def scan_summary_tsv(spark: SparkSession, path: str, recursive: bool = True, glob: str = "*.tsv") -> DataFrame:
    """Rows of every summary file below a path, with the file they came from.

    Rows with fewer than three fields or a blank identifier are skipped.
    """
    raw = (
        spark.read.schema("identifier string, mean double, std double")
        .option("sep", "\t")
        .option("header", "true")
        .option("enforceSchema", "true")
        .option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", glob)
        .csv(path)
        .select("*", F.col("_metadata.file_path").alias("file_path"))
    )
    return (
        raw.withColumn("identifier", F.trim("identifier"))
        .where((F.col("identifier") != "") & F.col("mean").isNotNull() & F.col("std").isNotNull())
    )


def _preset_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, m, f) for p, (m, f) in SUMMARY_FILES.items()], "preset string, module string, file_name string")


def with_locations(summaries: DataFrame) -> DataFrame:
    """Add variant, module and preset read from the file path."""
    part = lambda i: F.regexp_extract("file_path", SUMMARY_PATH, i)
    located = summaries.withColumns({"variant": part(1).try_cast("int"), "module": part(2), "file_name": part(3)})
    presets = F.broadcast(_preset_table(summaries.sparkSession))  # one row per preset
    return located.join(presets, ["module", "file_name"])


def locate_summaries(summaries: DataFrame, variants: DataFrame) -> DataFrame:
    """File chosen per (variant, preset): the variant's own, else any variant's.

    ``variants`` has one column ``wanted_variant``.  Works on the distinct file list,
    which is what the driver already listed, never on the rows.
    """
    files = with_locations(summaries.select("file_path").distinct())
    fallback = files.groupBy("preset").agg(F.min("file_path").alias("any_path"))
    own = files.groupBy("preset", F.col("variant").alias("wanted_variant")).agg(F.min("file_path").alias("own_path"))
    presets = F.array(*[F.lit(p) for p in SUMMARY_FILES])
    wanted = variants.select("wanted_variant", F.explode(presets).alias("preset"))
    return (
        wanted.join(F.broadcast(fallback), "preset")  # one row per preset
        .join(own, ["preset", "wanted_variant"], "left")
        .select(
            "wanted_variant", "preset",
            F.coalesce("own_path", "any_path").alias("file_path"),
            F.col("own_path").isNotNull().alias("exact"),
        )
    )


def sample_matrix(summaries: DataFrame) -> DataFrame:
    """Long output matrix of many variants: (variant, output_id = module:identifier, y, std)."""
    return with_locations(summaries).select(
        "variant",
        F.concat_ws(":", "module", "identifier").alias("output_id"),
        F.col("mean").alias("y"),
        "std",
    )
