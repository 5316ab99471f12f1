"""Replicated evaluations of a noisy model."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from varienne.operators.ordered import TARGET_ROWS, ordered
from varienne.session import checked_broadcast, hint_if_small, materialize

DEFAULT_TARGET_CV = 0.05
MIN_REPLICATES = 3
CV_EPSILON = 1e-10


#: Values of a sample that are gathered in one row; larger samples are narrowed down by counting first.
GATHERED_VALUES = 4096
#: Bits of the ordered pattern that one counting pass decides.
PASS_BITS = (20, 20, 24)


@pandas_udf(T.LongType())
def ordered_bits(values: pd.Series) -> pd.Series:
    """Whole numbers in the order of the values: the bit pattern of a double, mirrored for negative ones.  NaN comes last, zeros are one."""
    bits = (values.to_numpy(dtype=float) + 0.0).view(np.int64)
    out = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
    return pd.Series(np.where(np.isnan(values.to_numpy(dtype=float)), np.int64(0x7FFFFFFFFFFFFFFF), out))


@pandas_udf(T.DoubleType())
def value_of_bits(bits: pd.Series) -> pd.Series:
    b = bits.to_numpy(dtype=np.int64)
    return pd.Series(np.where(b < 0, b ^ np.int64(0x7FFFFFFFFFFFFFFF), b).view(np.float64))


def replicate_median(df: DataFrame, keys: Sequence[str], value: str, gathered: int = GATHERED_VALUES) -> DataFrame:
    """Exact median over the replicates of each sample; nulls do not count.

    Samples with up to ``gathered`` values are sorted in a row.  Of larger ones the middle values are selected by counting: each pass counts
    the values map-side by the next bits of their ordered pattern and keeps the cell that holds the wanted rank, until what is
    left can be gathered or all bits are known.  No table of values is written, only counts.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sizes = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    large = sizes.where(F.col("_n") > gathered)
    if large.isEmpty():
        return _sorted_middle(rows, keys)
    small = _sorted_middle(_matching(rows, large.select(*keys), keys, "left_anti"), keys)
    return small.unionByName(_counted_middle(rows, large, keys, gathered))


def _matching(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join with groups on keys that may be null."""
    side = hint_if_small(materialize(groups.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)}), "groups"))
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(side, condition, how).drop(*[f"_k{i}" for i in range(len(keys))])


def _sorted_middle(rows: DataFrame, keys: list[str]) -> DataFrame:
    taken = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("_v")).alias("_t"))
    return taken.select(*keys, ((F.expr("element_at(_t, int((size(_t) + 1) div 2))") + F.expr("element_at(_t, int(size(_t) div 2 + 1))")) / 2).alias("y"))


def _counted_middle(rows: DataFrame, large: DataFrame, keys: list[str], gathered: int) -> DataFrame:
    """Medians of large groups: both middle ranks of each are narrowed down together."""
    # One row per group and rank: the cell found so far (its leading bits) and the rank inside it.
    ranks = F.array_distinct(F.array(F.expr("(_n + 1) div 2"), F.expr("_n div 2 + 1")))
    state = large.select(*keys, F.explode(ranks).alias("_rank")).withColumns({"_id": F.col("_rank"), "_cell": F.lit(0).cast("bigint"), "_left": F.lit(2**62)})
    bits, shift, found = rows.withColumn("_b", ordered_bits("_v")), 64, []
    for width in PASS_BITS:
        cell = lambda s: F.shiftright("_b", s) if s < 64 else F.lit(0).cast("bigint")
        inside = _matching(bits, state, keys).where(cell(shift) == F.col("_cell"))
        shift -= width
        counts = materialize(inside.groupBy(*keys, "_id", "_rank", cell(shift).alias("_next")).agg(F.count(F.lit(1)).alias("_c")), "counts")
        upto = Window.partitionBy(*keys, "_id").orderBy("_next").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = counts.withColumn("_upto", F.sum("_c").over(upto))
        state = placed.where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_c") < F.col("_rank"))).select(
            *keys, (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank"), "_id", F.col("_next").alias("_cell"), F.col("_c").alias("_left"))
        state = materialize(state, "ranks")
        if shift == 0:
            found.append(state.select(*keys, "_id", value_of_bits("_cell").alias("_v")))
            break
        few = state.where(F.col("_left") <= gathered)
        taken = _matching(bits, few, keys).where(F.shiftright("_b", shift) == F.col("_cell")).groupBy(*keys, "_id", "_rank").agg(F.array_sort(F.collect_list("_v")).alias("_t"))
        found.append(taken.select(*keys, "_id", F.element_at("_t", F.col("_rank").cast("int")).alias("_v")))
        state = state.where(F.col("_left") > gathered)
        if state.isEmpty():
            break
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.groupBy(*keys).agg(F.avg("_v").alias("y"))


def running_cv(
    df: DataFrame, keys: Sequence[str], value: str, order: str, ties: Sequence[str] = (), target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Coefficient of variation over the replicates so far, for every replicate.

    Values are shifted by the group's first value, which keeps the running sums of
    squares well conditioned.
    """
    position = F.struct(order, *ties)
    origin = df.groupBy(*keys).agg(F.min_by(value, position).alias("_origin"))
    shifted = (
        df.join(checked_broadcast(origin), list(keys))
        .withColumn("_d", F.col(value) - F.col("_origin")).withColumn("_d2", F.col("_d") * F.col("_d"))
    )
    run = ordered(
        shifted, keys, order, ties=ties, running_sums={"_s1": "_d", "_s2": "_d2"}, row_number="rep", target_rows=target_rows)
    n, drift = F.col("rep"), F.col("_s1") / F.col("rep")
    variance = F.greatest(F.col("_s2") / n - drift * drift, F.lit(0.0))
    cv = F.sqrt(variance) / (F.abs(F.col("_origin") + drift) + CV_EPSILON)
    return run.withColumn("cv", cv).drop("_d", "_d2", "_s1", "_s2", "_origin")


def _prefix_cv(reps: Column, k: Column) -> Column:
    taken = F.slice(reps, F.lit(1), k)
    mean = F.aggregate(taken, F.lit(0.0), lambda a, x: a + x) / k
    variance = F.aggregate(taken, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / k
    return F.sqrt(variance) / (F.abs(mean) + CV_EPSILON)


def adaptive_replicates(
    df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], max_reps: int, target_cv: float = DEFAULT_TARGET_CV,
    min_reps: int = MIN_REPLICATES,
) -> DataFrame:
    """Median of the replicates taken until their cv falls below the target: y, n_used and the reason of the stop.

    ``max_reps`` is the budget of replicates per sample, which the caller states; the rank filter is
    applied before the shuffle as a group limit, so each task sends at most that many
    rows per sample.  stopped is ``target`` where the cv fell below the target, ``budget`` where the budget was used up first, ``replicates`` where
    the sample had fewer.
    """
    first = Window.partitionBy(*keys).orderBy(*order)
    head = df.select(*keys, *order, F.col(value).cast("double").alias("_v")).withColumn("_rep", F.row_number().over(first))
    head = head.where(F.col("_rep") <= max_reps)
    entries = F.array_sort(F.collect_list(F.struct("_rep", "_v")))  # at most max_reps entries
    reps = head.groupBy(*keys).agg(F.transform(entries, lambda e: e["_v"]).alias("reps"))
    good = F.filter(
        F.sequence(F.lit(min_reps), F.lit(max_reps)),
        lambda k: (k <= F.size("reps")) & (_prefix_cv(F.col("reps"), k) < target_cv),
    ) if max_reps >= min_reps else F.array().cast("array<int>")
    reps = reps.withColumn("_met", F.try_element_at(good, F.lit(1))).withColumn("n_used", F.coalesce("_met", F.size("reps")))
    reps = reps.withColumn("taken", F.array_sort(F.slice("reps", F.lit(1), F.col("n_used"))))
    middle = (F.expr("element_at(taken, int((n_used + 1) div 2))") + F.expr("element_at(taken, int(n_used div 2 + 1))")) / 2
    reason = F.when(F.col("_met").isNotNull(), "target").when(F.size("reps") >= max_reps, "budget").otherwise("replicates")
    return reps.select(*keys, middle.alias("y"), F.col("n_used").cast("bigint").alias("n_used"), reason.alias("stopped"))
