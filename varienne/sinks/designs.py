"""Saved designs: versioned folders of bucketed tables with a manifest as commit pointer.

A version is a folder of Parquet tables, all bucketed and sorted by the sample key with the same number of buckets, so that a series joins its design
without a shuffle.  Large designs cut every bucket into the same number of pieces, buckets of their own to Spark, so that no task
writes or joins more than about ``PIECE_ROWS`` rows.  A version counts once its manifest is written; what a broken writer leaves behind is never read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varienne.sinks.tables import table_hash

#: Inputs, their germ values, outputs, per-time rows and labels of a design; the same for its held-out samples.
TABLES = tuple(p + name for p in ("", "test_") for name in ("design", "germ", "y", "series", "labels"))
BUCKETS = 64
#: Rows of the largest table up to which a bucket stays whole.
PIECE_ROWS = 2_000_000
MANIFEST = "version bigint, key array<string>, buckets int, pieces int, parameters array<string>, tables array<struct<name:string,schema:string,n_rows:bigint,data_hash:string>>"


@dataclass
class SavedDesign:
    """A version of a saved design; ``tables`` has what was saved, in ``buckets`` as asked for, each cut into ``pieces``."""

    version: int
    key: list[str]
    buckets: int
    parameters: list[str]
    tables: dict[str, DataFrame] = field(default_factory=dict)
    hashes: dict[str, tuple[int, str]] = field(default_factory=dict)
    pieces: int = 1

    def changed(self) -> list[str]:
        """Names of tables whose rows are no longer those that were saved."""
        return [n for n, df in self.tables.items() if tuple(table_hash(df).first()) != self.hashes[n]]


def _path(root: str, version: int, name: str) -> str:
    return f"{root.rstrip('/')}/v{version:06d}/{name}"


def _manifests(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST).json(f"{root.rstrip('/')}/manifests/*")
    except Exception as err:
        if "PATH_NOT_FOUND" not in str(err):
            raise
        return None


def latest_version(spark: SparkSession, root: str) -> int:
    """Number of the newest committed version, 0 if there is none."""
    found = _manifests(spark, root)
    return 0 if found is None else found.agg(F.max("version")).first()[0] or 0


def _pieces(tables: dict[str, DataFrame], buckets: int, piece_rows: int) -> int:
    """Pieces per bucket, the same for all tables, by the rows of the largest one."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")) for df in tables.values()]
    largest = reduce(DataFrame.unionByName, counts).agg(F.max("n")).first()[0] if counts else 0
    return max(1, -(-largest // (buckets * piece_rows)))


def save_design(
    spark: SparkSession, root: str, tables: dict[str, DataFrame], key: Sequence[str] = ("sample_id",), parameters: Sequence[str] = (), buckets: int = BUCKETS,
    piece_rows: int = PIECE_ROWS,
) -> int:
    """Write the tables as the next version and return its number.

    Rows are counted before they are written: buckets of more than ``piece_rows`` rows on average are cut into pieces.  Every table must have the key columns.  Two writers that choose the same number collide on the folder, and the
    second fails; a version without manifest is skipped by later writers.
    """
    unknown = sorted(set(tables) - set(TABLES))
    if unknown:
        raise ValueError(f"unknown tables {unknown}, expected some of {TABLES}")
    key, version = list(key), latest_version(spark, root) + 1
    while _started(spark, root, version):
        version += 1
    pieces, entries = _pieces(tables, buckets, piece_rows), []
    for name, df in tables.items():
        path, table = _path(root, version, name), f"varienne_{uuid.uuid4().hex}"
        # Partitioned as the buckets are, so that every piece of a bucket is one file.
        df.repartition(buckets * pieces, *key).write.format("parquet").bucketBy(buckets * pieces, *key).sortBy(*key).option("path", path).saveAsTable(table)
        spark.sql(f"DROP TABLE {table}")
        rows, digest = table_hash(spark.read.schema(df.schema).parquet(path)).first()
        entries.append((name, df.schema.json(), rows, digest))
    row = spark.createDataFrame([(version, key, buckets, pieces, list(parameters), entries)], MANIFEST)
    row.coalesce(1).write.json(f"{root.rstrip('/')}/manifests/v{version:06d}")
    return version


def _started(spark: SparkSession, root: str, version: int) -> bool:
    """Whether some writer began this version."""
    for name in TABLES:
        try:
            spark.read.format("binaryFile").load(_path(root, version, name))
            return True
        except Exception as err:
            if "PATH_NOT_FOUND" not in str(err):
                raise
    return False


def load_design(spark: SparkSession, root: str, version: int | None = None) -> SavedDesign:
    """Tables of a version, the newest one by default.

    The tables are registered as bucketed ones, so joins and aggregations on the key need no shuffle.
    """
    found = _manifests(spark, root)
    rows = [] if found is None else found.where(F.lit(True) if version is None else F.col("version") == version).orderBy(F.desc("version")).take(1)
    if not rows:
        raise FileNotFoundError(f"no saved design {'' if version is None else f'of version {version} '}below {root}")
    m = rows[0]
    out = SavedDesign(m.version, list(m.key), m.buckets, list(m.parameters), pieces=m.pieces or 1)
    keys = ", ".join(f"`{k}`" for k in m.key)
    for entry in m.tables:
        path = _path(root, m.version, entry.name)
        table = f"varienne_{hashlib.sha256(path.encode()).hexdigest()[:32]}"
        schema = T.StructType.fromJson(json.loads(entry.schema))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {out.buckets * out.pieces} BUCKETS LOCATION '{path}'")
        spark.catalog.refreshTable(table)
        out.tables[entry.name], out.hashes[entry.name] = spark.table(table), (entry.n_rows, entry.data_hash)
    return out
