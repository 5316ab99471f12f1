"""Spectra and correlations of time series.

A series is rows (series, step, value) with steps 0..n-1.  Long series never meet one
task: correlations work on blocks of steps, spectra on strided parts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from varienne.operators.fit import sum_vectors
from varienne.operators.ordered import with_group_stats
from varienne.session import hint_if_small, materialize

STD_EPSILON = 1e-10
DB_EPSILON = 1e-10
TRANSFER_EPSILON = 1e-10
DEFAULT_BLOCK = 4096
#: Points of a series that one part of a transform may hold.
PART_POINTS = 1 << 16
_DOUBLES = T.ArrayType(T.DoubleType())

# Sample rate of the frequency axis and the band limits in Hz.
SAMPLE_RATE = 44100.0
MID_FROM = 300.0
HIGH_FROM = 3000.0


def normalize_series(series: DataFrame) -> DataFrame:
    """Zero mean and unit population deviation per series, with the length."""
    df = with_group_stats(series, ["series"], [
        F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"), F.count(F.lit(1)).alias("n")])
    return df.withColumn("value", (F.col("value") - F.col("_m")) / (F.col("_s") + STD_EPSILON)).drop("_m", "_s")


@pandas_udf(T.StructType([T.StructField("re", _DOUBLES), T.StructField("im", _DOUBLES)]))
def _block_spectrum(offsets: pd.Series, values: pd.Series, block: pd.Series) -> pd.DataFrame:
    """Spectrum of a sparse block, padded to twice its length so that products do not wrap around."""
    re, im = [], []
    for o, v, b in zip(offsets, values, block):
        data = np.zeros(2 * b)
        data[o] = v
        f = np.fft.rfft(data)
        re.append(f.real)
        im.append(f.imag)
    return pd.DataFrame({"re": re, "im": im})


@pandas_udf(_DOUBLES)
def _block_lags(z: pd.Series, block: pd.Series) -> pd.Series:
    """Correlations from 1 - block to block - 1 of a summed product of spectra (real parts, then imaginary ones)."""
    out = []
    for v, b in zip(z, block):
        raw = np.fft.irfft(v[:b + 1] + 1j * v[b + 1:], 2 * b)
        out.append(np.concatenate([raw[b + 1:], raw[:b]]))
    return pd.Series(out)


def block_spectra(series: DataFrame, block: int) -> DataFrame:
    """(series, b, re, im): the spectrum of every block of steps, transformed once and written."""
    entry = F.struct((F.col("step") % block).cast("int").alias("o"), F.col("value").alias("v"))
    blocks = series.groupBy("series", F.floor(F.col("step") / block).cast("int").alias("b")).agg(F.collect_list(entry).alias("x"))
    return materialize(blocks.select("series", "b", _block_spectrum("x.o", "x.v", F.lit(block)).alias("f")).select("series", "b", "f.re", "f.im"), "spectra")


def summed_products(spectra: DataFrame, reach: int) -> DataFrame:
    """(series_i, series_j, offset, z): products of spectra of blocks that lie ``offset`` blocks apart, summed over the blocks."""
    left = spectra.select(F.col("series").alias("series_i"), "b", F.col("re").alias("ar"), F.col("im").alias("ai"), F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("offset"))
    right = spectra.select(F.col("series").alias("series_j"), F.col("b").alias("q"), F.col("re").alias("br"), F.col("im").alias("bi"))
    pairs = left.withColumn("q", F.col("b") - F.col("offset")).join(right, "q").where(F.col("series_i") < F.col("series_j"))
    times = lambda a, b: F.zip_with(a, b, lambda x, y: x * y)
    real = F.zip_with(times("ar", "br"), times("ai", "bi"), lambda x, y: x + y)
    imaginary = F.zip_with(times("ai", "br"), times("ar", "bi"), lambda x, y: x - y)
    return pairs.groupBy("series_i", "series_j", "offset").agg(sum_vectors(F.concat(real, imaginary)).alias("z"))


def lag_products(series: DataFrame, max_lag: int, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Σ_t x_i[t]·x_j[t-lag] for every pair i<j of series and every lag up to the limit.

    Steps are grouped into blocks of fixed length, each transformed once.  Spectra of blocks within reach of the lag
    limit meet in an equi-join on the block number; their products add up per pair and block offset, map-side
    first, and only these sums are transformed back.  So transforms grow with blocks, not with pairs of blocks.
    """
    reach = math.ceil(max_lag / block) + 1
    sums = materialize(summed_products(block_spectra(series, block), reach), "products")
    products = sums.select(
        "series_i", "series_j", (F.col("offset") * block - (block - 1)).alias("_start"), F.posexplode(_block_lags("z", F.lit(block))).alias("p", "c"))
    lagged = products.withColumn("lag", (F.col("_start") + F.col("p")).cast("int"))
    lagged = lagged.where(F.abs("lag") <= max_lag)
    # Lags beyond the reach of any two steps of the series are no pairs at all.
    steps = series.groupBy("series").agg(F.min("step").alias("lo"), F.max("step").alias("hi"))
    side = lambda x: steps.select(F.col("series").alias(f"series_{x}"), F.col("lo").alias(f"lo_{x}"), F.col("hi").alias(f"hi_{x}"))
    lagged = lagged.groupBy("series_i", "series_j", "lag").agg(F.sum("c").alias("c"))
    lagged = lagged.join(side("i"), "series_i").join(side("j"), "series_j")
    return lagged.where((F.col("lag") >= F.col("lo_i") - F.col("hi_j")) & (F.col("lag") <= F.col("hi_i") - F.col("lo_j"))).select("series_i", "series_j", "lag", "c")


def lag_correlation(series: DataFrame, max_lag: int, dt: float = 1.0, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Peak normalised cross-correlation of every pair and the lag where it occurs."""
    z = normalize_series(series)
    lengths = z.groupBy("series").agg(F.max("n").alias("n"))
    products = lag_products(z.drop("n"), max_lag, block)
    rank = F.struct(F.abs("c").alias("a"), (-F.col("lag")).alias("l"))
    peak = products.groupBy("series_i", "series_j").agg(F.max_by(F.struct("c", "lag"), rank).alias("p"))
    peak = peak.join(lengths.withColumnRenamed("series", "series_i"), "series_i")
    return peak.select("series_i", "series_j", (F.col("p.c") / F.col("n")).alias("peak"), (F.col("p.lag") * dt).alias("lag"))


def lead_lag_matrix(series: DataFrame, max_lag: int = 50, block: int = DEFAULT_BLOCK) -> DataFrame:
    """How much more series i leads j than it follows: both directions of every pair."""
    products = lag_products(series, max_lag - 1, block)
    side = lambda cond: F.coalesce(F.max(F.when(cond, F.abs("c"))), F.lit(0.0))
    sides = products.groupBy("series_i", "series_j").agg(side(F.col("lag") < 0).alias("lead"), side(F.col("lag") > 0).alias("follow"))
    score = F.col("lead") - F.col("follow")
    both = F.array(
        F.struct(F.col("series_i").alias("source"), F.col("series_j").alias("target"), score.alias("score")),
        F.struct(F.col("series_j").alias("source"), F.col("series_i").alias("target"), (-score).alias("score")))
    return sides.select(F.inline(both))


# --- spectra ---------------------------------------------------------------------------


def _near_root_divisor(n: int) -> int:
    """Largest divisor of n up to its root."""
    d = math.isqrt(n)
    while n % d:
        d -= 1
    return d


@pandas_udf(T.LongType())
def _stride_count(n: pd.Series) -> pd.Series:
    lengths, position = np.unique(n.to_numpy(), return_inverse=True)
    return pd.Series(np.array([_near_root_divisor(int(v)) for v in lengths])[position])


_PART = "series string, n bigint, n1 bigint, origin bigint, a bigint, b bigint, re double, im double"


def _part_fft(index: str, length: str, sign: float, twiddle: bool):
    """FFT along one index of a series laid out as n1 × n2."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        n, n1 = int(part["n"].iloc[0]), int(part["n1"].iloc[0])
        size = n1 if length == "n1" else n // n1
        data = np.zeros(size, dtype=complex)
        data[part[index].to_numpy()] = part["re"].to_numpy() + 1j * part["im"].to_numpy()
        out = np.fft.fft(data) if sign < 0 else np.fft.ifft(data) * size
        k = np.arange(size)
        other = "b" if index == "a" else "a"
        fixed = int(part[other].iloc[0])
        if twiddle:
            out = out * np.exp(sign * 2j * math.pi * (k * fixed % n) / n)
        frame = pd.DataFrame({"series": part["series"].iloc[0], "n": n, "n1": n1, "origin": part["origin"].iloc[0], index: k, other: fixed, "re": out.real, "im": out.imag})
        return frame[["series", "n", "n1", "origin", "a", "b", "re", "im"]]

    return run


def _two_pass(rows: DataFrame, sign: float) -> DataFrame:
    """Transform of (series, n, n1, origin, step, re, im) in two passes over parts of n1 and n / n1 points; absent steps are zero.

    With n = n1·n2 and step = n2·a + b, the inner transforms run over a for each b, the
    outer ones over b for each output residue.
    """
    n2 = F.expr("n div n1")
    parts = rows.select("series", "n", "n1", "origin", F.expr("step div (n div n1)").alias("a"), (F.col("step") % n2).alias("b"), "re", "im")
    inner = parts.groupBy("series", "b").applyInPandas(_part_fft("a", "n1", sign, True), _PART)
    outer = inner.groupBy("series", "a").applyInPandas(_part_fft("b", "n2", sign, False), _PART)
    return outer.select("series", "n", "origin", (F.col("a") + F.col("n1") * F.col("b")).alias("k"), "re", "im")


def _turned(re: Column, im: Column, step: str, n: str, sign: float) -> list[Column]:
    """A number times exp(sign·πi·step²/n); the square is reduced before it becomes an angle."""
    angle = F.pmod(F.col(step) * F.col(step), 2 * F.col(n)) * math.pi / F.col(n)
    c, s = F.cos(angle), F.sin(angle) * sign
    return [(re * c - im * s).alias("re"), (re * s + im * c).alias("im")]


def _chirp(rows: DataFrame, sign: float) -> DataFrame:
    """Transform of any length as a convolution with a chirp, carried out on transforms of a power of two.

    k·step = (k² + step² - (k - step)²) / 2 turns the sum into a convolution of length 2n - 1, which fits a power of two with a divisor
    at its root.  The chirp is transformed once per distinct length.  Lengths up to 3·10**9, where the square of a step fits 64 bits.
    """
    padded = F.pow(F.lit(2.0), F.ceil(F.log2(2 * F.col("origin") - 1))).cast("bigint")
    root = F.pow(F.lit(2.0), F.floor(F.round(F.log2("n")) / 2)).cast("bigint")
    sized = lambda df: df.withColumn("n", padded).withColumn("n1", root)
    data = rows.select("series", F.col("n").alias("origin"), "step", *_turned(F.col("re"), F.col("im"), "step", "n", sign))
    forward = _two_pass(sized(data), -1.0)
    starts = rows.select(F.col("n").alias("origin")).distinct().select("origin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("origin") - 1, F.lit(PART_POINTS).cast("bigint"))).alias("start"))
    steps = starts.repartition("origin", "start").select("origin", F.explode(F.sequence("start", F.least(F.col("start") + PART_POINTS, F.col("origin")) - 1)).alias("step"))
    kernel = sized(steps.select("origin", "step", *_turned(F.lit(1.0), F.lit(0.0), "step", "origin", -sign)))
    kernel = kernel.unionByName(kernel.where("step > 0").withColumn("step", F.col("n") - F.col("step"))).withColumn("series", F.col("origin").cast("string"))
    kernel = _two_pass(kernel, -1.0).select("origin", "k", F.col("re").alias("cr"), F.col("im").alias("ci"))
    product = forward.join(kernel, ["origin", "k"]).select(
        "series", "origin", F.col("k").alias("step"), (F.col("re") * F.col("cr") - F.col("im") * F.col("ci")).alias("re"), (F.col("re") * F.col("ci") + F.col("im") * F.col("cr")).alias("im"))
    back = _two_pass(sized(product), 1.0).where(F.col("k") < F.col("origin"))
    return back.select("series", F.col("origin").alias("n"), "k", *_turned(F.col("re") / F.col("n"), F.col("im") / F.col("n"), "k", "origin", sign))


def _fft(rows: DataFrame, sign: float) -> DataFrame:
    """Discrete Fourier transform of (series, n, step, re, im).

    Two passes over parts of about √n points where n has a divisor near its root.  Lengths whose parts would hold more than
    ``PART_POINTS`` points, such as large primes, go through a chirp instead, so no part grows with the series.
    """
    lengths = materialize(rows.select("n").distinct().withColumn("n1", _stride_count("n")), "lengths")
    rows = rows.join(hint_if_small(lengths), "n")
    wide = F.greatest(F.col("n1"), F.expr("n div n1")) > PART_POINTS
    out = _two_pass(rows.where(~wide).withColumn("origin", F.col("n")), sign).drop("origin")
    if lengths.where(wide & (F.col("n") > PART_POINTS)).isEmpty():
        return out
    return out.unionByName(_chirp(rows.where(wide).drop("n1"), sign))


def spectrum(series: DataFrame) -> DataFrame:
    """Complex spectrum of every series: (series, n, k, re, im)."""
    df = with_group_stats(series, ["series"], [F.count(F.lit(1)).alias("n")])
    return _fft(df.select("series", "n", F.col("step").cast("bigint").alias("step"), F.col("value").alias("re"), F.lit(0.0).alias("im")), -1.0)


def band(k, n):
    """Band of a frequency bin on the fixed-rate axis; null beyond the axis."""
    frequency = k * F.lit(SAMPLE_RATE) / n
    return F.when(k > F.floor(n / 2), None).when(frequency < MID_FROM, "low").when(frequency < HIGH_FROM, "mid").otherwise("high")


def magnitudes(spectra: DataFrame) -> DataFrame:
    """Magnitude in dB and band of the positive frequencies."""
    size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    positive = spectra.where((F.col("k") >= 1) & (F.col("k") <= F.floor(F.col("n") / 2)))
    return positive.select("series", "k", (20.0 * F.log10(size + DB_EPSILON)).alias("magnitude_db"), band(F.col("k"), F.col("n")).alias("band"))


def band_gain(spectra: DataFrame, gain: float, name: str | None = None, bin_index: int | None = None) -> DataFrame:
    """Scale the bins of a band, or one bin."""
    hit = F.col("k") == bin_index if bin_index is not None else F.coalesce(band(F.col("k"), F.col("n")) == name, F.lit(False))
    factor = F.when(hit, F.lit(float(gain))).otherwise(1.0)
    return spectra.withColumns({"re": F.col("re") * factor, "im": F.col("im") * factor})


def inverse_spectrum(spectra: DataFrame) -> DataFrame:
    """Real part of the inverse transform: (series, step, value)."""
    out = _fft(spectra.select("series", "n", F.col("k").alias("step"), "re", "im"), 1.0)
    return out.select("series", F.col("k").alias("step"), (F.col("re") / F.col("n")).alias("value"))


# --- coherence ---------------------------------------------------------------------------


@pandas_udf(T.StructType([T.StructField("re", _DOUBLES), T.StructField("im", _DOUBLES)]))
def _segment_fft(offsets: pd.Series, values: pd.Series) -> pd.DataFrame:
    """Windowed, mean-free spectrum of one segment given as offsets and values."""
    re, im = [], []
    for o, v in zip(offsets, values):
        n = len(v)
        x = np.zeros(n)
        x[o] = v
        window = 0.5 - 0.5 * np.cos(2 * math.pi * np.arange(n) / n)
        f = np.fft.rfft((x - x.mean()) * window)
        re.append(f.real)
        im.append(f.imag)
    return pd.DataFrame({"re": re, "im": im})


def segment_spectra(series: DataFrame, length: int) -> DataFrame:
    """Spectra of half-overlapping segments: (series, segment, k, re, im).

    Every step belongs to at most two segments, and a segment has a fixed length.  Steps after the last whole
    segment (fewer than length - length // 2) belong to none.
    """
    hop = length - length // 2
    last = F.floor(F.col("step") / hop)
    first = F.greatest(F.ceil((F.col("step") - length + 1) / hop), F.lit(0))
    rows = series.withColumn("segment", F.explode(F.sequence(first, last)))
    entry = F.struct((F.col("step") - F.col("segment") * hop).cast("int").alias("o"), F.col("value").alias("v"))
    segments = rows.groupBy("series", "segment").agg(F.collect_list(entry).alias("e")).where(F.size("e") == length)
    spectra = segments.select("series", "segment", _segment_fft("e.o", "e.v").alias("s"))
    return spectra.select("series", "segment", F.posexplode(F.arrays_zip("s.re", "s.im")).alias("k", "z")).select(
        "series", "segment", "k", F.col("z.re").alias("re"), F.col("z.im").alias("im"))


def coherence(series: DataFrame, length: int, dt: float = 1.0) -> DataFrame:
    """Welch coherence and transfer function of every pair of series per frequency.

    Cross and auto spectra are averages over segments; segments of two series meet in an
    equi-join on (segment, frequency).
    """
    spectra = materialize(segment_spectra(series, length), "segments")
    a = spectra.select(F.col("series").alias("series_i"), "segment", "k", F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = spectra.select(F.col("series").alias("series_j"), "segment", "k", F.col("re").alias("br"), F.col("im").alias("bi"))
    pairs = a.join(b, ["segment", "k"]).where(F.col("series_i") < F.col("series_j"))
    ar, ai, br, bi = (F.col(c) for c in ("ar", "ai", "br", "bi"))
    sums = pairs.groupBy("series_i", "series_j", "k").agg(
        F.avg(ar * br + ai * bi).alias("cr"), F.avg(ar * bi - ai * br).alias("ci"),
        F.avg(ar * ar + ai * ai).alias("pa"), F.avg(br * br + bi * bi).alias("pb"))
    # One-sided density scale: inner bins count twice; it cancels in the coherence.
    inner = (F.col("k") > 0) & ((F.lit(length % 2) == 1) | (F.col("k") < length // 2))
    window_power = 3.0 * length / 8.0
    scale = F.when(inner, 2.0).otherwise(1.0) * dt / window_power
    cross = F.col("cr") * F.col("cr") + F.col("ci") * F.col("ci")
    power = F.col("pa") * F.col("pb")
    return sums.select(
        "series_i", "series_j", "k", (F.col("k") / (length * dt)).alias("frequency"),
        F.when(power > 0, cross / power).otherwise(0.0).alias("coherence"),
        (F.col("cr") * scale / (F.col("pa") * scale + TRANSFER_EPSILON)).alias("transfer_re"),
        (F.col("ci") * scale / (F.col("pa") * scale + TRANSFER_EPSILON)).alias("transfer_im"))
