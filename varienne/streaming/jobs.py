"""Progress and preliminary sensitivities while runs arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from varienne.operators.design import Bounds
from varienne.plans import quantify

MIN_COMPLETED = 5
PRELIMINARY_ORDER = 2


def stream_history(spark: SparkSession, root: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """History files as a stream; new files below the root become micro-batches."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.{pq,parquet}")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.parquet(root)


def with_progress(stream: DataFrame, keys: Sequence[str] = ("variant",)) -> DataFrame:
    """Rows and latest time per variant: one stateful aggregation of the size of the variants."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.max("time").alias("last_time"))


def _start(stream: DataFrame, mode: str, checkpoint: str, sink, once: bool) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.start()


def run_progress(stream: DataFrame, output: str, checkpoint: str, keys: Sequence[str] = ("variant",), once: bool = True) -> StreamingQuery:
    """Keep a table of changed variants per micro-batch; a replayed batch overwrites itself."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    return _start(with_progress(stream, keys), "update", checkpoint, sink, once)


def read_progress(spark: SparkSession, output: str, keys: Sequence[str] = ("variant",)) -> DataFrame:
    """Latest state per variant out of the batch tables."""
    batches = spark.read.parquet(output)
    latest = F.max_by(F.struct("n_rows", "last_time"), "batch_id").alias("s")
    return batches.groupBy(*keys).agg(latest).select(*keys, "s.n_rows", "s.last_time")


def windowed_means(stream: DataFrame, time: str, values: Sequence[str], keys: Sequence[str], window: str, watermark: str) -> DataFrame:
    """Event-time means per window and key; the watermark bounds the state."""
    means = [F.avg(v).alias(v) for v in values]
    grouped = stream.withWatermark(time, watermark).groupBy(F.window(time, window).alias("window"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), *means)


#: Micro-batches after which the samples changed by them are merged into one table.
COMPACT_EVERY = 20


def current_samples(spark: SparkSession, output: str) -> DataFrame:
    """Latest means per sample: the newest merged table and the batches since."""
    batches = spark.read.parquet(f"{output}/samples")
    columns = [c for c in batches.columns if c not in ("sample_id", "batch_id")]
    upto = _merged_upto(spark, output)
    rows = batches.where(F.col("batch_id") > upto)
    if upto >= 0:
        merged = spark.read.parquet(f"{output}/merged").where(F.col("upto") == upto)  # a partition: only its files are read
        rows = rows.unionByName(merged.select("sample_id", *columns, F.lit(-1).cast("int").alias("batch_id")))
    latest = F.max_by(F.struct(*columns), "batch_id").alias("s")
    return rows.groupBy("sample_id").agg(latest).select("sample_id", "s.*")


def _merged_upto(spark: SparkSession, output: str) -> int:
    try:
        return spark.read.parquet(f"{output}/merged").agg(F.max("upto")).first()[0]
    except Exception as err:
        if "PATH_NOT_FOUND" not in str(err):
            raise
        return -1


def run_preliminary_sobol(
    stream: DataFrame, design: DataFrame, bounds: Bounds, columns: Sequence[str], output: str, checkpoint: str,
    order: int = PRELIMINARY_ORDER, min_completed: int = MIN_COMPLETED, once: bool = True, compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Refit on every micro-batch from the running means per sample.

    The stream keeps one row of state per sample and hands on only the samples that a batch changed; they are written below
    ``samples``, and every ``compact_every`` batches the latest means become one table below ``merged``, after which older batches are no longer
    read.  A sample's mean changes as its rows arrive, so the right-hand sides are rebuilt from the current means; they are
    sums over samples, not over history rows.  A replayed batch overwrites what it wrote.
    """
    running = stream.groupBy("sample_id").agg(*[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in columns])

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{output}/samples/batch_id={batch_id}")
        if batch_id - _merged_upto(spark, output) >= compact_every:
            current_samples(spark, output).write.mode("overwrite").parquet(f"{output}/merged/upto={batch_id}")
        means = current_samples(spark, output)
        completed = means.count()
        if completed < min_completed:
            return
        pairs = F.array(*[F.struct(F.lit(c).alias("output_id"), F.col(c).alias("y")) for c in columns])
        y = means.select(F.lit("preliminary").alias("strategy"), F.lit(0).cast("bigint").alias("group_value"), "sample_id", F.inline(pairs))
        result = quantify.fit_strategies(design, bounds, y, order)
        table = result.indices.withColumn("n_completed", F.lit(completed))
        table.write.mode("overwrite").parquet(f"{output}/indices/batch_id={batch_id}")

    return _start(running, "update", checkpoint, sink, once)


def read_preliminary(spark: SparkSession, output: str) -> DataFrame:
    """Indices of the latest refit."""
    batches = spark.read.parquet(f"{output}/indices")
    newest = batches.agg(F.max("batch_id").alias("b")).select("b").scalar()
    return batches.where(F.col("batch_id") == newest).drop("batch_id")
