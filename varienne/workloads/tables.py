"""The provided tables in the roles the library expects, in Spark and in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varienne.operators.observables import CELL_MASS, DNA_MASS, DRY_MASS, GROWTH_RATE, RNA_MASS, VOLUME
from varienne.operators.ordered import ordered
from varienne.session import scratch_path

GROWTH = "listeners__mass__growth"
COUNTS = "listeners__monomer_counts"
EPOCH_US = 1704067200000000
WEEK_US = 604800000000
#: Units in the last place by which the mass of a life may be off as a plain running sum.
MASS_SLACK = 4

#: Inputs of the lineitem design and their ranges.
LINEITEM_BOUNDS = {"l_discount": (0.0, 0.1), "l_tax": (0.0, 0.08), "l_quantity": (1.0, 50.0)}

HISTORY_SQL = f"""
SELECT event_id, 'exp' || CAST(user_id % 3 AS VARCHAR) AS experiment_id, CAST(user_id % 20 AS INTEGER) AS variant,
  CAST((user_id // 20) % 3 AS INTEGER) AS lineage_seed,
  CAST((epoch_us(ts) - {EPOCH_US}) // {WEEK_US} AS INTEGER) AS generation,
  CAST(user_id AS VARCHAR) AS agent_id, epoch_us(ts) / 1000000.0::DOUBLE AS time, event_type,
  value AS dry_mass,
  CASE WHEN event_id % 101 <> 0 THEN 1.3::DOUBLE * value END AS cell_mass,
  value / 1.1::DOUBLE AS volume,
  CASE WHEN event_id % 89 = 0 THEN 'NaN'::DOUBLE ELSE 0.01::DOUBLE * value END AS growth,
  CASE WHEN event_id % 97 <> 0 THEN 0.000001::DOUBLE * value END AS growth_rate,
  0.03::DOUBLE * value * (1 + event_id % 10) AS dna_mass,
  CASE WHEN event_id % 103 <> 0 THEN 0.2::DOUBLE * value END AS rna_mass
FROM events"""

#: History with a mass that grows along each agent's life.
GROWTH_SQL = f"""
SELECT *, sum(dry_mass) OVER (PARTITION BY agent_id ORDER BY time, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mass FROM ({HISTORY_SQL})"""

#: Array history: one vector per row.
ARRAYS_SQL = """
SELECT vec_id, label AS variant, CAST(vec_id % 3 AS INTEGER) AS lineage_seed, CAST((vec_id // 3) % 4 AS INTEGER) AS generation,
  CAST(vec_id AS DOUBLE) AS time, CASE WHEN vec_id % 50 = 0 THEN 0.0 ELSE 1.0 + vec_id % 7 END::DOUBLE AS dry_mass,
  CAST(2.0 + vec_id % 5 AS DOUBLE) AS cell_mass, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"""

#: Feature ids of the array positions (1-based).
FIELD_IDS_SQL = """
SELECT DISTINCT CAST(i AS INTEGER) AS idx, CASE WHEN i % 4 = 0 THEN 'EX_dim_' ELSE 'dim_' END || CAST(i - 1 AS VARCHAR) AS id
FROM (SELECT unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"""

#: One sample per lineitem row, inputs scaled to [-1, 1].
DESIGN_SQL = """
SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_discount, l_tax, l_quantity,
  2 * (l_discount - 0.0) / 0.1 - 1 AS g0, 2 * (l_tax - 0.0) / 0.08 - 1 AS g1, 2 * (l_quantity - 1.0) / 49.0 - 1 AS g2,
  l_extendedprice AS y0, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS y1 FROM lineitem"""


class Tables:
    """Provided tables below one directory."""

    _trees: dict[tuple[str, str, str], str] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def history(self) -> DataFrame:
        """``events`` as a history of runs."""
        e, uid, v, eid = self.events, F.col("user_id"), F.col("value"), F.col("event_id")
        micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
        return e.select(
            "event_id",
            F.concat(F.lit("exp"), (uid % 3).cast("string")).alias("experiment_id"),
            (uid % 20).cast("int").alias("variant"),
            F.expr("cast((user_id div 20) % 3 as int)").alias("lineage_seed"),
            F.floor((micros - EPOCH_US) / WEEK_US).cast("int").alias("generation"),
            uid.cast("string").alias("agent_id"),
            (micros / F.lit(1000000.0)).alias("time"),
            "event_type",
            v.alias(DRY_MASS),
            F.when(eid % 101 != 0, 1.3 * v).alias(CELL_MASS),
            (v / 1.1).alias(VOLUME),
            F.when(eid % 89 == 0, float("nan")).otherwise(0.01 * v).alias(GROWTH),
            F.when(eid % 97 != 0, 0.000001 * v).alias(GROWTH_RATE),
            (0.03 * v * (1 + eid % 10)).alias(DNA_MASS),
            F.when(eid % 103 != 0, 0.2 * v).alias(RNA_MASS),
        )

    @cached_property
    def growth(self) -> DataFrame:
        """History with a mass that grows along each agent's life, derived once per directory."""
        return self.grown("growth")

    @cached_property
    def steady_growth(self) -> DataFrame:
        """The same with masses that are corrected once they have drifted, for what looks at the masses of long lives to many digits."""
        return self.grown("steady-growth", compensated=True, slack=MASS_SLACK)

    @cached_property
    def long_growth(self) -> DataFrame:
        """The same with masses that do not drift over the rows of a long life, for what looks at small differences of them."""
        return self.grown("long-growth", compensated=True)

    def grown(self, name: str, **sums) -> DataFrame:
        path = self.written(name, lambda p: ordered(
            self.history, ["agent_id"], "time", ties=["event_id"], running_sums={"mass": DRY_MASS}, **sums).write.parquet(p))
        return self.spark.read.parquet(path)

    @cached_property
    def samples(self) -> DataFrame:
        """Growing history with the variant as sample id."""
        return self.growth.withColumn("sample_id", F.col("variant"))

    @cached_property
    def arrays(self) -> DataFrame:
        """``embeddings`` as array-valued observables."""
        vid = F.col("vec_id")
        return self.embeddings.select(
            "vec_id", F.col("label").alias("variant"), (vid % 3).cast("int").alias("lineage_seed"),
            F.expr("cast((vec_id div 3) % 4 as int)").alias("generation"), vid.cast("double").alias("time"),
            F.when(vid % 50 == 0, 0.0).otherwise(1.0 + vid % 7).alias(DRY_MASS),
            (2.0 + vid % 5).alias(CELL_MASS), F.col("embedding").cast("array<double>").alias(COUNTS),
        )

    @cached_property
    def field_ids(self) -> DataFrame:
        """Ids of the array positions (1-based)."""
        i = F.col("i")
        return (
            self.embeddings.select(F.explode(F.sequence(F.lit(1), F.size("embedding"))).alias("i")).distinct()
            .select(i.alias("idx"), F.concat(F.when(i % 4 == 0, "EX_dim_").otherwise("dim_"), (i - 1).cast("string")).alias("id"))
        )

    @cached_property
    def design(self) -> DataFrame:
        """One sample per lineitem row with inputs in physical units and two outputs."""
        price = F.col("l_extendedprice")
        return self.lineitem.select(
            "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", *LINEITEM_BOUNDS,
            price.alias("y0"), (price * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("y1"),
        )

    def written(self, name: str, write) -> str:
        """Path of a derived table, written once per application and data directory."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in self._trees:
            path = scratch_path(self.spark, name)
            write(path)
            self._trees[key] = path
        return self._trees[key]

    def history_tree(self) -> str:
        """The history as a hive tree below the shared scratch folder."""
        return self.written("history", lambda path: (
            self.history.repartition("experiment_id", "generation", F.col("event_id") % 8)  # salted
            .write.partitionBy("experiment_id", "generation").parquet(path)
        ))
