"""Input designs: germ scaling, random, Latin hypercube, trajectory and A/B designs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varienne.functions import rng
from varienne.functions.numeric import add_all
from varienne.operators.ordered import TARGET_ROWS, ordered
from varienne.session import checked_broadcast

Bounds = Mapping[str, tuple[float, float]]


def _columns(*bounds: float | Column) -> list[Column]:
    return [b if isinstance(b, Column) else F.lit(float(b)) for b in bounds]


def to_germ(x: Column, lo: float | Column, hi: float | Column) -> Column:
    """Physical value to [-1, 1]; a zero span counts as 1."""
    lo, hi = _columns(lo, hi)
    return 2.0 * (x - lo) / F.when(hi > lo, hi - lo).otherwise(1.0) - 1.0


def from_germ(g: Column, lo: float | Column, hi: float | Column) -> Column:
    """[-1, 1] to physical value: middle plus half span times germ."""
    lo, hi = _columns(lo, hi)
    return 0.5 * (lo + hi) + 0.5 * (hi - lo) * g


def germ_columns(bounds: Bounds) -> list[Column]:
    """Scaled inputs of a wide design as expressions."""
    return [to_germ(F.col(n).cast("double"), lo, hi) for n, (lo, hi) in bounds.items()]


def long_germ(design: DataFrame, params: DataFrame) -> DataFrame:
    """Long design (..., name, x) with its germ."""
    bounds = checked_broadcast(params.select("name", "lo", "hi"))
    return design.join(bounds, "name").withColumn("germ", to_germ(F.col("x"), F.col("lo"), F.col("hi"))).drop("lo", "hi")


def sample_uniform(ids: DataFrame, bounds: Bounds, seed: int, key: str = "sample_id") -> DataFrame:
    """Independent uniform inputs for every id, as columns; the same for any partitioning.

    ``ids`` is any frame with a key, e.g. ``spark.range``; a held-out set uses seed+1.
    """
    draws = {n: from_germ(2.0 * rng.uniform(seed, F.lit(n), key) - 1.0, lo, hi) for n, (lo, hi) in bounds.items()}
    return ids.withColumns(draws)


def sample_lhs(ids: DataFrame, bounds: Bounds, seed: int, key: str = "sample_id", target_rows: int = TARGET_ROWS) -> DataFrame:
    """Latin hypercube, long: (key, name, x) with one point per stratum and input.

    The stratum is the rank of a hashed draw.  Ranks run over chunks of the draw, so an
    input with very many samples is sorted by many tasks.
    """
    spec = F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for n, (lo, hi) in bounds.items()
    ])
    long = ids.select(key, F.inline(spec)).withColumn("_h", rng.uniform(seed, F.lit("stratum"), "name", key))
    ranked = ordered(long, ["name"], "_h", ties=[key], row_number="_rank", target_rows=target_rows)
    total = ids.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    unit = (F.col("_rank") - 1 + rng.uniform(seed, F.lit("jitter"), "name", key)) / total
    return ranked.select(key, "name", (F.col("lo") + unit * (F.col("hi") - F.col("lo"))).alias("x"))


def widen(long: DataFrame, key: str, names: Sequence[str], name: str = "name", value: str = "x") -> DataFrame:
    """Long design to one column per input."""
    return long.groupBy(key).agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names])


def morris_design(trajectories: DataFrame, bounds: Bounds, seed: int, levels: int = 4, key: str = "traj_id") -> DataFrame:
    """One-at-a-time trajectories: rows (key, step, changed, unit ARRAY, inputs...).

    An input moves by ±δ at the step given by its rank in the trajectory's hashed order
    and stays there, so every step is a function of the trajectory id alone.
    """
    names = list(bounds)
    delta = levels / (2.0 * (levels - 1))
    base = {n: F.floor(rng.uniform(seed, F.lit("base"), F.lit(n), key) * (levels - 1)) / F.lit(float(levels - 1)) for n in names}
    order = F.array_sort(F.array(*[
        F.struct(rng.uniform(seed, F.lit("order"), F.lit(n), key).alias("h"), F.lit(n).alias("name")) for n in names
    ]))
    df = trajectories.withColumns({f"_b_{n}": b for n, b in base.items()})
    df = df.withColumn("_order", F.transform(order, lambda e: e["name"]))
    df = df.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(names)))))
    unit = {}
    for n in names:
        b = F.col(f"_b_{n}")
        move = F.when(b + delta <= 1.0, F.lit(delta)).otherwise(F.lit(-delta))
        unit[n] = b + F.when(F.array_position("_order", F.lit(n)) <= F.col("step"), move).otherwise(0.0)
    df = df.withColumn("unit", F.array(*unit.values()))
    df = df.withColumn("changed", F.when(F.col("step") > 0, F.try_element_at("_order", F.col("step"))))
    scaled = [(F.lit(float(lo)) + F.col("unit")[i] * (hi - lo)).alias(n) for i, (n, (lo, hi)) in enumerate(bounds.items())]
    return df.select(key, "step", "changed", "unit", *scaled)


def saltelli_design(ids: DataFrame, bounds: Bounds, seed: int, key: str = "sample_id", second_order: bool = True) -> DataFrame:
    """Blocks A, B, AB_i (and BA_i): rows (key, block, inputs...), 2d+2 or d+2 per id.

    AB_i is A with input i from B.  Every block is a projection of two draws, no join.
    """
    names = list(bounds)
    blocks = ["A", "B", *[f"AB_{n}" for n in names], *([f"BA_{n}" for n in names] if second_order else [])]
    df = ids.withColumns({f"_a_{n}": rng.uniform(seed, F.lit("A"), F.lit(n), key) for n in names})
    df = df.withColumns({f"_b_{n}": rng.uniform(seed, F.lit("B"), F.lit(n), key) for n in names})
    df = df.withColumn("block", F.explode(F.array(*[F.lit(b) for b in blocks])))
    cols = []
    for n, (lo, hi) in bounds.items():
        from_b = (F.col("block") == "B") | (F.col("block") == f"AB_{n}") | (F.startswith("block", F.lit("BA_")) & (F.col("block") != f"BA_{n}"))
        cols.append((F.lit(float(lo)) + F.when(from_b, F.col(f"_b_{n}")).otherwise(F.col(f"_a_{n}")) * (hi - lo)).alias(n))
    return df.select(key, "block", *cols)


def evaluate_design(
    design: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame | np.ndarray], outputs: Sequence[str],
    inputs: Sequence[str], series: bool = False,
) -> DataFrame:
    """Apply a user model to every design row in Arrow batches.

    The model maps a frame of inputs to one column per output; with ``series`` it returns
    an array (row, time, output) whose time mean is the output.
    """
    schema = T.StructType([*design.schema.fields, *[T.StructField(name, T.DoubleType()) for name in outputs]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            result = model(batch[list(inputs)])
            values = np.asarray(result, dtype=float)
            if series:
                values = values.mean(axis=1)
            values = values.reshape(len(batch), len(outputs))
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(values, columns=list(outputs))], axis=1)

    return design.mapInPandas(run, schema)


def coupling_matrix(n_outputs: int, n_inputs: int, seed: int) -> np.ndarray:
    """Seeded coupling of outputs to inputs with unit rows."""
    a = np.random.default_rng(seed).standard_normal((n_outputs, n_inputs))
    norms = np.linalg.norm(a, axis=1, keepdims=True)
    return a / np.where(norms > 0, norms, 1.0)


def response_surface(design: DataFrame, bounds: Bounds, means: Sequence[Column | float], stds: Sequence[Column | float], coupling: np.ndarray) -> DataFrame:
    """Linear test model mean + std·(A·ξ), one column ``y<k>`` per output."""
    germ = germ_columns(bounds)
    outputs = {}
    for k, (mean, std) in enumerate(zip(means, stds)):
        mean, std = _columns(mean, std)
        outputs[f"y{k}"] = mean + std * add_all([F.lit(float(a)) * g for a, g in zip(coupling[k], germ)])
    return design.withColumns(outputs)


def modulate(df: DataFrame, outputs: Sequence[str], phases: Sequence[float], n_steps: int) -> DataFrame:
    """Time series of the test model: sinusoidal modulation over one period."""
    angle = F.col("step") * (2.0 * np.pi / max(n_steps - 1, 1))
    long = df.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1))))
    return long.withColumns({o: F.col(o) * (1.0 + 0.2 * F.sin(angle + float(p))) for o, p in zip(outputs, phases)})


def encode_variants(design: DataFrame, names: Sequence[str], paths: Mapping[str, str], key: str, positions: Mapping[str, int] | None = None) -> DataFrame:
    """One mutation document per sample: {path: value} or {path: {__index__, __value__}}."""
    positions = positions or {}
    fields = []
    for n in names:
        value = F.col(n).cast("double")
        if n in positions:
            value = F.struct(F.lit(positions[n]).alias("__index__"), value.alias("__value__"))
        fields.append(value.alias(paths[n]))
    return design.select(key, F.to_json(F.struct(*fields)).alias("mutations"))


def planned_runs(n_samples: int, seeds: int, generations: int) -> int:
    """Simulations in a campaign: samples and one baseline, per seed and generation."""
    return (n_samples + 1) * seeds * generations
