"""Session settings, scratch space and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a pre-aggregated side may be broadcast once measured.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
#: Bytes that a row of a hash table takes beside its values.
ROW_OVERHEAD = 32


def build_session(app: str = "varienne", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the settings the library is tuned for.

    The shuffle partition count is only the upper bound that adaptive execution
    coalesces from, so a cluster run passes a large one and a test run a small one.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",  # rows may carry whole vectors
        # Vector sums keep one buffer per group; fall back to sorting only with many groups per task.
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "1024",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for written intermediates: the cluster's, or a local one in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = os.path.join(tempfile.gettempdir(), "varienne-scratch")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint folder; nothing is ever overwritten."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate to the shared folder and read it back.

    Cuts lineage like a checkpoint, but leaves a splittable, column-prunable
    table behind that survives lost executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measure(written: DataFrame) -> tuple[int, int]:
    """Rows of a written table and the bytes they take in memory; reads only columns of varying width."""
    fixed, varying = ROW_OVERHEAD, []
    for field in written.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.NumericType):
            varying.append(8 * F.coalesce(F.size(c), F.lit(0)))
        elif isinstance(field.dataType, (T.StringType, T.BinaryType)):
            varying.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            varying.append(F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)))
        fixed += 8
    width = sum((v.cast("bigint") for v in varying), F.lit(0).cast("bigint"))
    n, b = written.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0).cast("bigint"))).first()
    return n, n * fixed + b


def hint_if_small(written: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for a written table whose rows and bytes stay below the limits."""
    rows, size = measure(written)
    return F.broadcast(written) if rows <= max_rows and size <= max_bytes else written


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after measuring the side; otherwise leave the join to AQE.

    The side is written to the shared folder first: measuring it is then cheap,
    and a lost executor does not lead back to the history it was aggregated from.  Meant
    for aggregates such as one row per sample.
    """
    return hint_if_small(materialize(df, "side"), max_rows)
