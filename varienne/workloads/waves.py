"""Correlation and spectrum queries on hourly event series."""

from __future__ import annotations

from pyspark.sql import functions as F

from varienne.operators import signals
from varienne.workloads.registry import query, rounded, sr

HOUR_US = 3_600_000_000
FIRST_HOUR = f"(SELECT min(epoch_us(ts) // {HOUR_US}) FROM events)"
#: Hours from the first event to the last, whatever the table spans.
N_HOURS = f"(SELECT max(epoch_us(ts) // {HOUR_US}) - min(epoch_us(ts) // {HOUR_US}) + 1 FROM events)"
SERIES_SQL = f"""
SELECT e.series, CAST(h.step AS BIGINT) AS step, coalesce(v.value, 0.0) AS value FROM (SELECT DISTINCT event_type AS series FROM events) e
CROSS JOIN (SELECT unnest(range({N_HOURS})) AS step) h LEFT JOIN (
  SELECT event_type AS series, epoch_us(ts) // {HOUR_US} - {FIRST_HOUR} AS step, sum(value) AS value FROM events GROUP BY 1, 2) v ON v.series = e.series AND v.step = h.step"""
Z_SQL = "SELECT series, step, (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-10) AS z FROM s WINDOW w AS (PARTITION BY series)"


def series(t):
    """Summed value per event type and hour, every hour present."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    hour = F.floor(micros / HOUR_US)
    first, last = t.events.agg(F.min(hour), F.max(hour)).first()
    hour = hour - (first or 0)
    sums = t.events.groupBy(F.col("event_type").alias("series"), hour.alias("step")).agg(F.sum("value").alias("value"))
    grid = t.events.select(F.col("event_type").alias("series")).distinct().select(
        "series", F.explode(F.sequence(F.lit(0), F.lit(int((last or 0) - (first or 0))))).alias("step"))
    grid = grid.withColumn("step", F.col("step").cast("bigint"))
    return grid.join(sums, ["series", "step"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


#: Hours that two series may lie apart.
WEEK = 168
LAGS_SQL = """
SELECT a.series AS series_i, b.series AS series_j, CAST(a.step - b.step AS INTEGER) AS lag, sum(a.{v} * b.{v}) AS c
FROM {s} a JOIN {s} b ON a.series < b.series {limit} GROUP BY ALL"""


@query("lag_pairs", f"WITH s AS ({SERIES_SQL}) SELECT series_i, series_j, lag, {sr('c', 4)} AS c FROM (" + LAGS_SQL.format(v="value", s="s", limit="AND abs(a.step - b.step) <= 24") + ")")
def _lag_pairs(t):
    return rounded(signals.lag_products(series(t), 24, block=128), 4)


@query("lag_correlation", f"""
WITH s AS ({SERIES_SQL}), z AS ({Z_SQL}), c AS ({LAGS_SQL.format(v='z', s='z', limit=f'AND abs(a.step - b.step) <= {WEEK}')})
SELECT series_i, series_j, {sr(f'arg_max(c, (round(abs(c), 6), -lag)) / {N_HOURS}', 6)} AS peak, arg_max(lag, (round(abs(c), 6), -lag)) * 1.0::DOUBLE AS lag FROM c GROUP BY ALL""")
def _lag_correlation(t):
    return rounded(signals.lag_correlation(series(t), WEEK, block=256))


@query("lead_lag_matrix", f"""
WITH s AS ({SERIES_SQL}), c AS ({LAGS_SQL.format(v='value', s='s', limit='AND abs(a.step - b.step) < 50')}),
p AS (SELECT series_i, series_j, max(CASE WHEN lag < 0 THEN abs(c) END) - max(CASE WHEN lag > 0 THEN abs(c) END) AS score FROM c GROUP BY ALL)
SELECT series_i AS source, series_j AS target, {sr('score', 4)} AS score FROM p UNION ALL SELECT series_j, series_i, {sr('-score', 4)} FROM p""")
def _lead_lag_matrix(t):
    return rounded(signals.lead_lag_matrix(series(t), 50, block=256), 4)


DFT_SQL = f"""
SELECT series, k, sum(value * cos(2 * pi() * ((k * step) % {N_HOURS}) / {N_HOURS})) AS re, -sum(value * sin(2 * pi() * ((k * step) % {N_HOURS}) / {N_HOURS})) AS im
FROM s, (SELECT unnest(range({N_HOURS})) AS k) GROUP BY ALL"""
BAND_SQL = f"CASE WHEN k > {N_HOURS} // 2 THEN NULL WHEN k * 44100.0 / {N_HOURS} < 300 THEN 'low' WHEN k * 44100.0 / {N_HOURS} < 3000 THEN 'mid' ELSE 'high' END"


@query("series_spectrum", f"""
WITH s AS ({SERIES_SQL}) SELECT series, k, {sr('20 * log10(sqrt(re * re + im * im) + 1e-10)', 5)} AS magnitude_db, {BAND_SQL} AS band FROM ({DFT_SQL}) WHERE k BETWEEN 1 AND {N_HOURS} // 2""")
def _series_spectrum(t):
    return rounded(signals.magnitudes(signals.spectrum(series(t))), 5)


@query("band_gain_inverse", f"""
WITH s AS ({SERIES_SQL}), f AS (SELECT series, k, re * g AS re, im * g AS im FROM (SELECT *, CASE WHEN {BAND_SQL} = 'mid' THEN 0.5 ELSE 1.0 END::DOUBLE AS g FROM ({DFT_SQL})))
SELECT series, step, {sr(f'sum(re * cos(2 * pi() * ((k * step) % {N_HOURS}) / {N_HOURS}) - im * sin(2 * pi() * ((k * step) % {N_HOURS}) / {N_HOURS})) / {N_HOURS}', 4)} AS value
FROM f, (SELECT unnest(range({N_HOURS})) AS step) GROUP BY ALL""")
def _band_gain_inverse(t):
    return rounded(signals.inverse_spectrum(signals.band_gain(signals.spectrum(series(t)), 0.5, "mid")), 4)


SEG = 180
HOP = SEG - SEG // 2
SEGMENT_SQL = f"""
SELECT g.segment, series, step - g.segment * {HOP} AS o, value FROM s, (SELECT unnest(range(({N_HOURS} - {SEG}) // {HOP} + 1)) AS segment) g
WHERE step >= g.segment * {HOP} AND step < g.segment * {HOP} + {SEG}"""
SEGMENT_DFT_SQL = f"""
SELECT series, segment, k, sum(x * cos(2 * pi() * ((k * o) % {SEG}) / {SEG})) AS re, -sum(x * sin(2 * pi() * ((k * o) % {SEG}) / {SEG})) AS im FROM (
  SELECT series, segment, o, (value - avg(value) OVER (PARTITION BY series, segment)) * (0.5 - 0.5 * cos(2 * pi() * o / {SEG})) AS x FROM ({SEGMENT_SQL})),
  (SELECT unnest(range({SEG // 2 + 1})) AS k) GROUP BY ALL"""


@query("coherence", f"""
WITH s AS ({SERIES_SQL}), f AS ({SEGMENT_DFT_SQL}), p AS (
  SELECT a.series AS series_i, b.series AS series_j, a.k, avg(a.re * b.re + a.im * b.im) AS cr, avg(a.re * b.im - a.im * b.re) AS ci,
    avg(a.re * a.re + a.im * a.im) AS pa, avg(b.re * b.re + b.im * b.im) AS pb
  FROM f a JOIN f b ON a.segment = b.segment AND a.k = b.k AND a.series < b.series GROUP BY ALL)
SELECT series_i, series_j, CAST(k AS INTEGER) AS k, {sr(f'k / {SEG}', 8)} AS frequency, {sr('(cr * cr + ci * ci) / (pa * pb)')} AS coherence,
  {sr('cr / pa')} AS transfer_re, {sr('ci / pa')} AS transfer_im FROM p WHERE k > 0""")
def _coherence(t):
    out = signals.coherence(series(t), SEG)
    # The zero frequency of mean-free segments is only rounding noise.
    return rounded(out.where("k > 0"), 6, frequency=8)
