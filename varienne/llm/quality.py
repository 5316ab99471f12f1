"""Quality classifier from trusted positives and unlabelled text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varienne.llm.store import materialize
from varienne.llm.text import Words, mix, slices

#: Labelled rows that a fit may use; more are thinned by a hash of their id.
MAX_LABELLED = 200_000
NEWTON_STEPS = 12
RIDGE = 1e-3
BINS = 2000

_CLASS = np.zeros(256, np.int64)  # of bytes: 0 other ASCII marks
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[65:91] = 2
_CLASS[97:123] = 3
_CLASS[48:58] = 4
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
_CLASS[128:] = 6
_CLASS[ord("!")] = 7
CLASSES = 8

NAMES = (
    *[f"bytes_{c}" for c in ("marks", "space", "upper", "lower", "digit", "punctuation", "beyond_ascii", "exclamation")],
    "log_words", "word_length", "long_words", "short_words", "capital_words", "mark_ended", "sentence_ended", "digit_words",
    "repeats_last", "distinct_words", "distinct_pairs", "distinct_runs", "distinct_lines", "commonest_word",
)


def _shares(flag: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean of a flag per range, 0 for empty ranges."""
    sums = np.concatenate([[0.0], np.cumsum(flag, dtype=np.float64)])
    return np.diff(sums[bounds]) / np.maximum(np.diff(bounds), 1)


def _distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes per range and the count of the commonest, as shares; 1 and 0 for empty ranges."""
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    if not len(doc):
        return np.ones(len(n)), np.zeros(len(n))
    keys = hashes ^ mix(doc.astype(np.uint64), 77)
    order = np.argsort(keys)
    h, d = keys[order], doc[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(h)))
    most = np.zeros(len(n))
    np.maximum.at(most, d[at], counts)
    return np.where(n > 0, np.bincount(d[at], minlength=len(n)) / np.maximum(n, 1), 1.0), most / np.maximum(n, 1)


def style(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Features of whole texts: shares of byte and word kinds, and how much repeats."""
    words = Words(data, offsets, seed=1)
    kinds = _CLASS[data]
    n_docs = len(offsets) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(offsets))
    out = [np.bincount(doc * CLASSES + kinds, minlength=n_docs * CLASSES).reshape(n_docs, CLASSES) / np.maximum(np.diff(offsets), 1)[:, None]]
    b, length = words.bounds, words.ends - words.starts
    last = kinds[words.ends - 1]
    upper = np.concatenate([[0], np.cumsum(kinds == 2)])
    digits = np.concatenate([[0], np.cumsum(kinds == 4)])
    capital = upper[words.ends] - upper[words.starts]
    same = np.concatenate([[False], words.hashes[1:] == words.hashes[:-1]]) if len(words.hashes) else np.zeros(0, bool)
    distinct, most = _distinct(words.hashes, b)
    runs = [_distinct(h, wb)[0] for _, h, wb in (words.windows(2, seed=1), words.windows(5, seed=1))]
    # Lines as words whose separator is the line break alone.
    ends = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], ends + 1]))
    starts = starts[starts < len(data)]
    line_bounds = np.searchsorted(starts, offsets)
    stops = np.append(starts[1:], len(data))
    forward = np.concatenate([[0], np.cumsum(kinds.astype(np.uint64) * np.uint64(31) + data.astype(np.uint64) * np.uint64(1099511628211) + data.astype(np.uint64) ** np.uint64(3))]).astype(np.uint64)
    lines = _distinct((forward[stops] - forward[starts]) * np.uint64(2654435761) + (stops - starts).astype(np.uint64), line_bounds)[0]
    out += [x[:, None] for x in (
        np.log1p(np.diff(b)), np.log1p(_shares(length, b)), _shares(length > 16, b), _shares(length <= 2, b), _shares((capital > 1) & (capital >= 0.5 * length), b),
        _shares((last == 0) | (last == 7), b), _shares(last == 5, b), _shares(digits[words.ends] > digits[words.starts], b), _shares(same, b), distinct, *runs, lines, most)]
    return np.hstack(out)


def style_rows(batches):
    """Function for ``mapInArrow``: (id, text, flag) to (id, flag, features)."""
    for batch in batches:
        for row, data, offsets in slices(batch.column(1)):
            x = style(data, offsets)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(x)), batch.column(2).slice(row, len(x)), flat], names=["id", "unlabelled", "x"])


def _sums(mean: np.ndarray, scale: np.ndarray, weights: np.ndarray | None):
    """Function for ``mapInArrow``: (positive, unlabelled, x) to numbered partial sums.

    Without weights: count, sum and sum of squares of the features over unlabelled rows.  With weights,
    for positives and for unlabelled rows: count, sum of log(1 + exp(f)), of z, of s z and of s (1 - s) z z',
    where z are standardised features with a constant, f the linear score and s its logistic function.
    """

    def run(batches):
        total = None
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(2).flatten().to_numpy().reshape(len(batch), -1)
            parts = []
            for column in (0, 1):
                rows = x[batch.column(column).to_numpy(zero_copy_only=False).astype(bool)]
                if weights is None:
                    parts += [[len(rows)], rows.sum(0), (rows * rows).sum(0)]
                    continue
                z = np.hstack([(rows - mean) / scale, np.ones((len(rows), 1))])
                f = z @ weights
                s = 1 / (1 + np.exp(-np.clip(f, -500, 500)))
                parts += [[len(rows)], [np.logaddexp(0, f).sum()], z.sum(0), s @ z, ((z * (s * (1 - s))[:, None]).T @ z).reshape(-1)]
            sums = np.concatenate(parts)
            total = sums if total is None else total + sums
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total.astype(np.float64))], names=["i", "v"])

    return run


def _totals(features: DataFrame, *args) -> np.ndarray:
    """Sums over all rows; as many numbers as a moment matrix has entries reach the driver."""
    rows = features.select("positive", "unlabelled", "x").mapInArrow(_sums(*args), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r.i] = r.v
    return out


class Moments:
    """Losses, gradients and curvatures of positives (p) and unlabelled rows (u), as means."""

    def __init__(self, totals: np.ndarray, d: int):
        self.parts = []
        for t in np.split(totals, 2):
            n = max(t[0], 1.0)
            self.parts.append((t[1] / n, t[2:2 + d] / n, t[2 + d:2 + 2 * d] / n, t[2 + 2 * d:].reshape(d, d) / n))


def fit_contrast(features: DataFrame, mean, scale, ridge: float, steps: int) -> np.ndarray:
    """Logistic weights that tell positives from unlabelled rows, each side with half the weight."""
    d = len(mean) + 1
    w = np.zeros(d)
    for _ in range(steps):
        (_, z, sz, h), (_, _, u_sz, u_h) = Moments(_totals(features, mean, scale, w), d).parts
        step = np.linalg.solve(h + u_h + ridge * np.eye(d), sz - z + u_sz + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-2:
            break
    return w


def linear(w: np.ndarray, mean: np.ndarray, scale: np.ndarray):
    """Logistic score of the column x."""
    shift = float(w[-1] - (w[:-1] * mean / scale).sum())
    f = F.lit(shift)
    for i, c in enumerate(w[:-1] / scale):
        f = f + F.get("x", F.lit(i)) * float(c)
    return 1 / (1 + F.exp(-F.greatest(F.least(f, F.lit(500.0)), F.lit(-500.0))))


def estimate_prior(features: DataFrame, mean, scale, w, bins: int = BINS, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Share of positives among the unlabelled rows.

    Above a score c the unlabelled rows hold at least prior times the share of positives above c; the
    estimate is the smallest ratio of the two shares, at the c with the best confidence bound.
    """
    counted = features.withColumn("bin", F.least(F.floor(linear(w, mean, scale) * bins), F.lit(bins - 1)).cast("int")).groupBy("bin").agg(
        F.sum(F.col("positive").cast("bigint")).alias("p"), F.sum(F.col("unlabelled").cast("bigint")).alias("u")).collect()
    p, u = np.zeros(bins), np.zeros(bins)
    for r in counted:
        p[r.bin], u[r.bin] = r.p, r.u
    if not p.sum() or not u.sum():
        return 0.5
    above_p, above_u = np.cumsum(p[::-1]) / p.sum(), np.cumsum(u[::-1]) / u.sum()
    ok = above_p > 0
    margin = (1 + gamma) / above_p[ok] * (np.sqrt(np.log(4 / delta) / 2 / u.sum()) + np.sqrt(np.log(4 / delta) / 2 / p.sum()))
    best = int(np.argmin(above_u[ok] / above_p[ok] + margin))
    return float(np.clip((above_u[ok] / above_p[ok])[best], 0.01, 0.99))


def fit_nnpu(features: DataFrame, mean, scale, prior: float, ridge: float = RIDGE, steps: int = NEWTON_STEPS) -> np.ndarray:
    """Weights of least non-negative unbiased risk with logistic loss.

    The risk is prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]).  While the second part is
    positive the whole is convex in the weights and Newton's method applies; once it turns negative,
    which a true risk cannot, the step goes up its own gradient instead, so that it is not fitted further.
    Without convergence the weights of the least risk seen are returned.
    """
    d = len(mean) + 1
    w, best, least = np.zeros(d), np.zeros(d), np.inf
    for _ in range(steps):
        (p_loss, z, sz, p_h), (u_loss, _, u_sz, u_h) = Moments(_totals(features, mean, scale, w), d).parts
        risk = prior * (p_loss - z @ w) + max(0.0, u_loss - prior * p_loss) + ridge / 2 * w @ w
        if risk < least:
            best, least = w, risk
        curve = u_h + ridge * np.eye(d)
        if u_loss - prior * p_loss < 0:
            step = -0.5 * np.linalg.solve(curve + prior * p_h, u_sz - prior * sz)
        else:
            step = np.linalg.solve(curve, u_sz - prior * z + ridge * w)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        w = w - step
        if np.abs(step).max() < 1e-3:
            return w
    return best


class Model:
    """Standardisation, weights and the prior they were fitted with."""

    def __init__(self, mean, scale, weights, prior):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior


def _features(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, unlabelled, max_labelled: int) -> DataFrame:
    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(unlabelled, F.lit(True)).alias("unlabelled"))
    known = trusted.select(F.col(f"`{trusted.columns[0]}`").cast("bigint").alias("id")).where("id is not null").distinct()
    n = known.count()
    if n > max_labelled:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * max_labelled / n))
    x = source.mapInArrow(style_rows, "id bigint, unlabelled boolean, x array<double>")
    return materialize(x.join(known.withColumn("positive", F.lit(True)), "id", "left").withColumn("positive", F.coalesce("positive", F.lit(False))), "style")


def _fit(features: DataFrame, ridge: float, steps: int, prior: float | None) -> Model:
    width = len(NAMES)
    t = _totals(features, None, None, None)
    if not len(t) or not t[1 + 2 * width] or not t[0]:
        return Model(np.zeros(width), np.ones(width), np.zeros(width + 1), 0.5)
    n, sums, squares = t[1 + 2 * width], t[2 + 2 * width:2 + 3 * width], t[2 + 3 * width:]
    mean = sums / n
    scale = np.sqrt(np.maximum(squares / n - mean * mean, 0))
    scale[scale < 1e-9] = 1.0
    if prior is None:
        prior = estimate_prior(features, mean, scale, fit_contrast(features, mean, scale, ridge, steps))
    return Model(mean, scale, fit_nnpu(features, mean, scale, prior, ridge, steps), prior)


def fit_quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", unlabelled=None, max_labelled: int = MAX_LABELLED,
                ridge: float = RIDGE, steps: int = NEWTON_STEPS, prior: float | None = None) -> tuple[Model, DataFrame]:
    """Fit a classifier from trusted positive ids and unlabelled documents; also returns the features.

    ``trusted`` has ids of good documents in its first column; above ``max_labelled`` ids they are
    thinned by a hash.  All documents for which the condition ``unlabelled`` holds (all by default) are the
    unlabelled sample.  Scores rest on the style of whole texts alone: shares of byte and word kinds
    and how much words, runs and lines repeat.  Every step of the fit is one pass over the written
    features that brings a moment matrix to the driver.  The class prior is estimated unless given.

    Without positives or documents the model gives 0.5 everywhere.  Null and empty texts have the
    features of a text without words.  Rows that repeat an id are samples of their own; equal texts have equal scores, and a
    score of exactly one half counts as good.  Texts of any length are read whole, about a megabyte of them at a time or one longer text.
    """
    features = _features(docs, trusted, id_col, text_col, F.lit(True) if unlabelled is None else unlabelled, max_labelled)
    return _fit(features, ridge, steps, prior), features


def quality_scores(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id_col and score (0 to 1, higher: more like the trusted documents), one row per input row."""
    model, features = fit_quality(docs, trusted, id_col, text_col, **options)
    return features.select(F.col("id").alias(id_col), linear(model.weights, model.mean, model.scale).alias("score"))


def add_score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of the documents and a score, in one pass and without a shuffle."""
    at = docs.columns.index(text_col)
    mean, scale, weights = model.mean, model.scale, model.weights

    def run(batches):
        for batch in batches:
            scores = [np.zeros(0)]
            for _, data, offsets in slices(batch.column(at)):
                f = np.clip((style(data, offsets) - mean) / scale @ weights[:-1] + weights[-1], -500, 500)
                scores.append(1 / (1 + np.exp(-f)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))
