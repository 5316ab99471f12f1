"""Ordered operators that do not put a whole group into one task.

``lag``, ``row_number`` and running sums need a window per group.  A group that holds
a third of all rows would then sort in one task.  Groups are counted first: when all of
them are below ``target_rows`` a plain window is used.  Otherwise the rows of the large ones are dealt by
range of (group, order, ties, row) into chunks, whatever the types of these columns and however many rows tie; windows run
per chunk, and what a chunk hands on to the next comes from a two-level scan over one summary row per chunk.

Running sums of doubles may be compensated: what each addition rounds off is summed too and added at the end, so the error does
not grow with the rows before.  With ``slack`` a plain sum is left as it is until it is off by more than so many units in its last place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varienne.functions.numeric import nan_to_null
from varienne.session import checked_broadcast, hint_if_small, materialize

TARGET_ROWS = 2_000_000
CHUNK = "_chunk"
#: Chunks whose summaries are scanned together; blocks of them are scanned once more.
SCAN_BLOCK = 1000


def hot_groups(df: DataFrame, keys: Sequence[str], target_rows: int = TARGET_ROWS) -> DataFrame:
    """Groups with more rows than the target, numbered in ``_g``: at most rows / target_rows of them."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > target_rows)
    return materialize(counts.withColumn("_g", F.monotonically_increasing_id()), "hot")


def _same(hot: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """Hot groups under other names, and the condition that a row belongs to one; null is a key like others."""
    side = hint_if_small(hot).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_g")
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return side, condition


def _hot_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], target_rows: int, hot: DataFrame) -> DataFrame:
    """Rows of hot groups with a chunk number that grows with the order; two chunks per ``target_rows`` rows.

    The rows are written with a number of their own, which breaks the last ties, before the range boundaries are drawn from a
    sample: every later reader and every retried task sees the same chunks.
    """
    if keys:
        side, condition = _same(hot, keys)
        rows = df.join(side, condition).drop(*[f"_k{i}" for i in range(len(keys))])
    else:
        rows = df.withColumn("_g", F.lit(0).cast("bigint"))
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "hot-rows")
    chunks = -(-2 * (hot.agg(F.sum("_n")).first()[0]) // target_rows)
    ranged = rows.repartitionByRange(chunks, "_g", *order, "_row").withColumn(CHUNK, F.spark_partition_id())
    return materialize(ranged, "chunks")


def add_chunks(df: DataFrame, keys: Sequence[str], order: str, target_rows: int = TARGET_ROWS, ties: Sequence[str] = ()) -> DataFrame:
    """Add a chunk number that grows with (order, ties) inside hot groups and is 0 everywhere else."""
    keys = list(keys)
    hot = hot_groups(df, keys, target_rows)
    if hot.isEmpty():
        return df.withColumn(CHUNK, F.lit(0))
    chunked = _hot_chunks(df, keys, [order, *ties], target_rows, hot).drop("_g", "_row")
    if not keys:
        return chunked
    side, condition = _same(hot, keys)
    return chunked.unionByName(df.join(side, condition, "left_anti").withColumn(CHUNK, F.lit(0)))


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    prefix: Sequence[str] = (),
    ties: Sequence[str] = (),
    lags: dict[str, str] | None = None,
    running_sums: dict[str, str] | None = None,
    row_number: str | None = None,
    compensated: bool = False,
    slack: int = 0,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Add lags (new name -> column), running sums and a row number per key group.

    Rows of a group are ordered by (*prefix, order, *ties), nulls first; rows that tie on all of them stand in any order.
    Without keys all rows are one group.  Sums skip nulls; compensated ones of doubles are exact to a few units in the last place of the largest sum so far.
    With ``slack`` they equal the plain ones while these are no further off than that; groups that are cut into chunks are always compensated.
    """
    lags, running_sums = lags or {}, running_sums or {}
    keys, position = list(keys), [*prefix, order, *ties]
    hot = hot_groups(df, keys, target_rows)
    plain = lambda rows: _plain(rows, Window.partitionBy(*keys).orderBy(*position), lags, running_sums, row_number, compensated, slack)
    if hot.isEmpty():
        return plain(df)
    out = _chunked(_hot_chunks(df, keys, position, target_rows, hot), position, lags, running_sums, row_number, compensated)
    if not keys:
        return out
    side, condition = _same(hot, keys)
    return out.unionByName(plain(df.join(side, condition, "left_anti")))


def _plain(df, window, lags, running_sums, row_number, compensated=False, slack=0) -> DataFrame:
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    columns = {name: F.lag(c).over(window) for name, c in lags.items()}
    inexact = _inexact(df, running_sums) if compensated else {}
    columns |= {name: F.sum(c).over(upto) for name, c in running_sums.items() if name not in inexact}
    columns |= {f"_upto_{name}": F.sum(c).over(upto) for name, c in inexact.items()}
    columns |= {f"_before_{name}": F.sum(c).over(before) for name, c in inexact.items()}
    if row_number:
        columns[row_number] = F.row_number().over(window).cast("bigint")
    out = df.withColumns(columns)
    lost = {name: _rounded_off(F.col(f"_before_{name}"), F.col(c), F.col(f"_upto_{name}")) for name, c in inexact.items()}
    out = out.withColumns({f"_lost_{name}": F.coalesce(F.sum(e).over(upto), F.lit(0.0)) for name, e in lost.items()})
    sums = {name: _corrected(F.col(f"_upto_{name}"), F.col(f"_lost_{name}"), slack) for name in inexact}
    return out.withColumns(sums).drop(*[f"{side}_{name}" for name in inexact for side in ("_upto", "_before", "_lost")])


def _inexact(df: DataFrame, running_sums: dict[str, str]) -> dict[str, str]:
    """The sums whose additions round."""
    return {name: c for name, c in running_sums.items() if df.schema[c].dataType.simpleString() in ("double", "float")}


def _rounded_off(before: Column, value: Column, total: Column) -> Column:
    """What the addition before + value = total rounded off (Knuth's two-sum); null where a sum is infinite or NaN."""
    before, value = F.coalesce(before, F.lit(0.0)), F.coalesce(value.cast("double"), F.lit(0.0))
    added = total - before
    return nan_to_null((before - (total - added)) + (value - added))


def _corrected(total: Column, lost: Column, slack: int) -> Column:
    """The sum with what was rounded off, or as it is while that is within ``slack`` units in its last place."""
    return F.when(F.abs(lost) > F.abs(total) * (slack * 2.0**-52), total + lost).otherwise(total) if slack else total + lost


def _handed_on(summaries: DataFrame, lags, running_sums, compensated) -> DataFrame:
    """What the chunks before each one hand to it: rows, sums and last values, by a scan inside blocks of chunks and one over blocks."""
    block = F.floor(F.col(CHUNK) / SCAN_BLOCK)
    summaries = summaries.withColumn("_b", block)
    sums = {"_n0": "_seg_n", **{f"_s_{name}": f"_sum_{name}" for name in running_sums}}
    last = {f"_l_{name}": f"_last_{name}" for name in lags}

    def scanned(df, window, suffix):
        upto = _plain(df, window, {}, {o + suffix + "_upto": c for o, c in sums.items()}, None, compensated)
        return upto.withColumns({**{o + suffix: F.lag(o + suffix + "_upto").over(window) for o in sums}, **{o + suffix: F.lag(c).over(window) for o, c in last.items()}})

    inner = scanned(summaries, Window.partitionBy("_g", "_b").orderBy(CHUNK), "").withColumn("_first", F.row_number().over(Window.partitionBy("_g", "_b").orderBy(CHUNK)) == 1)
    blocks = inner.groupBy("_g", "_b").agg(*[F.max_by(o + "_upto", CHUNK).alias(c) for o, c in sums.items()], *[F.max_by(c, CHUNK).alias(c) for c in last.values()])
    outer = scanned(blocks, Window.partitionBy("_g").orderBy("_b"), "_o").select("_g", "_b", *[f"{o}_o" for o in (*sums, *last)])
    both = inner.join(outer, ["_g", "_b"])
    added = {o: F.when(F.col(o).isNull(), F.col(f"{o}_o")).otherwise(F.col(o) + F.coalesce(F.col(f"{o}_o"), F.lit(0))) for o in sums}
    return both.select("_g", CHUNK, *[c.alias(o) for o, c in added.items()], *[F.when(F.col("_first"), F.col(f"{o}_o")).otherwise(F.col(o)).alias(o) for o in last])


def _chunked(chunked, position, lags, running_sums, row_number, compensated) -> DataFrame:
    window = Window.partitionBy("_g", CHUNK).orderBy(*position, "_row")
    out = _plain(chunked, window, lags, running_sums, "_rn", compensated)
    place = F.struct(*position, "_row")
    inexact = _inexact(chunked, running_sums) if compensated else {}
    if inexact:  # their totals are the last compensated sums, so rows are read twice with them
        out = materialize(out, "running-sums")
    summaries = (out if inexact else chunked).groupBy("_g", CHUNK).agg(
        F.count(F.lit(1)).alias("_seg_n"),
        *[F.max_by(c, place).alias(f"_last_{name}") for name, c in lags.items()],
        *[(F.max_by(name, place) if name in inexact else F.sum(c)).alias(f"_sum_{name}") for name, c in running_sums.items()],
    )
    # At most 2 * rows / target_rows chunks, and one more per hot group.
    out = out.join(checked_broadcast(_handed_on(materialize(summaries, "summaries"), lags, running_sums, compensated)), ["_g", CHUNK], "left")
    fixed = {name: F.when(F.col("_rn") == 1, F.col(f"_l_{name}")).otherwise(F.col(name)) for name in lags}
    fixed |= {
        name: F.when(F.col(name).isNull(), F.col(f"_s_{name}")).otherwise(F.col(name) + F.coalesce(F.col(f"_s_{name}"), F.lit(0)))
        for name in running_sums
    }
    if row_number:
        fixed[row_number] = (F.col("_rn") + F.coalesce(F.col("_n0"), F.lit(0))).cast("bigint")
    helpers = [CHUNK, "_g", "_row", "_rn", "_n0", *[f"_l_{n}" for n in lags], *[f"_s_{n}" for n in running_sums]]
    return out.withColumns(fixed).drop(*helpers)


def group_stats(df: DataFrame, keys: Sequence[str], aggs: list) -> DataFrame:
    """Per-group aggregates, combined map-side; counted before they are broadcast."""
    return checked_broadcast(df.groupBy(*keys).agg(*aggs))


def with_group_stats(df: DataFrame, keys: Sequence[str], aggs: list) -> DataFrame:
    """Attach whole-group aggregates to every row without a window over the rows.

    When the groups are few the rows are never shuffled; otherwise the join is left to
    adaptive execution, which splits skewed partitions.
    """
    return df.join(group_stats(df, keys, aggs), list(keys))


def first_last(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """First and last value per group in order: birth and division mass."""
    position = F.struct(*order)
    return df.groupBy(*keys).agg(
        F.min_by(value, position).alias("first_value"), F.max_by(value, position).alias("last_value")
    )


def even_spacing(
    df: DataFrame, keys: Sequence[str], order: str, *, prefix: Sequence[str] = (), ties: Sequence[str] = (),
    out: str = "theta", target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Evenly spaced values 0..1 in row order per group; a single row gets 0."""
    counted = with_group_stats(df, keys, [F.count(F.lit(1)).alias("_group_n")])
    numbered = ordered(counted, keys, order, prefix=prefix, ties=ties, row_number="_pos", target_rows=target_rows)
    spaced = (F.col("_pos") - 1) / F.greatest(F.col("_group_n") - 1, F.lit(1))
    return numbered.withColumn(out, spaced).drop("_pos", "_group_n")


def growth_rate(
    df: DataFrame, mass: str, keys: Sequence[str], order: str = "time", *, ties: Sequence[str] = (),
    out: str = "growth_rate", target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """(m - previous m)/m inside each cell; 0 for the first row and for zero mass."""
    df = ordered(df, keys, order, ties=ties, lags={"_prev": mass}, target_rows=target_rows)
    m = F.col(mass)
    return df.withColumn(out, F.when(m != 0, F.coalesce((m - F.col("_prev")) / m, F.lit(0.0))).otherwise(0.0)).drop("_prev")
