"""Counter-based random numbers: a pure function of seed and row key.

Values do not depend on partitioning, retries or row order, so a lost task
recomputes exactly the same draws.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO52 = float(2**52)


def uniform(seed: int, *keys: Column | str) -> Column:
    """Uniform draw in [0,1) from the first 52 bits of a digest of seed and keys."""
    parts = [F.lit(str(seed))] + [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(_TWO52)


def normal(seed: int, *keys: Column | str) -> Column:
    """Standard normal draw (Box-Muller on two uniforms)."""
    u = uniform(seed, F.lit("radius"), *keys)
    v = uniform(seed, F.lit("angle"), *keys)
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2.0 * math.pi * v)


def exponential(scale: float, u: Column) -> Column:
    return F.lit(-float(scale)) * F.log(1.0 - u)


def poisson(rate: float, u: Column) -> Column:
    """Poisson count by inverting the cumulative distribution."""
    top = int(rate + 12 * math.sqrt(rate) + 12)
    mass, total, cumulative = math.exp(-rate), 0.0, []
    for k in range(top):
        total += mass
        cumulative.append(total)
        mass *= rate / (k + 1)
    table = F.lit(cumulative)
    return F.size(F.filter(table, lambda c: c <= u)).cast("double")
