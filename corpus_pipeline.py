"""Training-data pipeline over ``documents``: quality, near duplicates, decontamination, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to
the shared folder and hands the reread table to the next.  All stages but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varienne.llm.credentials import linked_secrets, masked
from varienne.llm.decontaminate import contaminated
from varienne.llm.near import near_duplicates
from varienne.llm.packing import pack_sequences
from varienne.llm.quality import add_score, fit_quality
from varienne.llm.queries import held_out, table, tokenizer_path, trusted_ids
from varienne.session import materialize


def _id(docs: DataFrame) -> Column:
    return F.col("doc_id").cast("bigint")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the classifier scores at least one half."""
    model, _ = fit_quality(docs, trusted_ids(table(spark, sf_dir, "labels")), unlabelled=~held_out())
    return add_score(docs, model, score_col="__score").where("__score >= 0.5").drop("__score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group: its smallest id.

    Rows that repeat an id are kept or dropped together; rows without an id stay.
    """
    dropped = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("__dropped")).distinct()
    return docs.join(dropped, _id(docs) == F.col("__dropped"), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item or nearly so."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__found")).distinct()
    return docs.join(found, _id(docs) == F.col("__found"), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret span by its kind in brackets; all documents stay and n_chars follows."""
    found = masked(docs)
    return found.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint"))).select(*docs.columns) if "n_chars" in docs.columns else found


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of at most 4096 tokens."""
    return pack_sequences(docs, tokenizer_path())


STAGES = [("quality classifier", quality), ("near duplicates", near_dedup), ("decontamination", decontamination), ("secret scan", secrets), ("packing", packing)]

#: The classifier's fit and the token ids are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
