"""Queries: spectral, correlation and wavelet operators.

Series = the labelled samples (64 points each); the ragged event series
for the circular extension of the multilevel Haar transform.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tsq.operators import spectral as sp
from tsq.operators import spectrum as sq
from tsq.plans import sqlparts as S
from tsq.plans.registry import dbl, query, r, rnd, rounded
from tsq.plans.windows import EVENTS_SQL, indexed_events
from tsq.session import materialize
from tsq.sources import tables as tb

TOPK = 3
SHARED_ALPHA = 0.2
DECOMP_K = 5
EXTRA_K, EXTRA_H = 3, 16
LOW_MODES = 8
SHRINK = 0.01
DELAY_FACTOR = 1.0

TP = dbl(sp.TWO_PI)


def _ang(k, t, n):
    return f"{TP} * CAST({k} * {t} AS DOUBLE) / CAST({n} AS DOUBLE)"


SPEC_SQL = f"""s AS ({S.SEQUENCES}), ln AS (SELECT sample_id, count(*) AS L FROM s GROUP BY 1),
spec AS (SELECT s.sample_id, kk.k, sum(s.value * cos({_ang('kk.k', 's.t', 'ln.L')})) AS re,
                CASE WHEN kk.k = 0 OR 2 * kk.k = any_value(ln.L) THEN 0.0 ELSE -sum(s.value * sin({_ang('kk.k', 's.t', 'ln.L')})) END AS im, any_value(ln.L) AS L
         FROM s JOIN ln USING (sample_id) CROSS JOIN unnest(range(0, ln.L // 2 + 1)) AS kk(k) GROUP BY 1, 2),
sa AS (SELECT *, sqrt(re * re + im * im) AS amp FROM spec)"""


def _spec(spark, sf):
    return sq.frequencies(tb.sequence_arrays(spark, sf), "sample_id", "x")


def _idft_sql(spec_rel, times_rel, out):
    """SQL twin of sp.idft over (sample_id, k, re, im, L) x (sample_id, t)."""
    ang = _ang("f.k", "g.t", "f.L")
    c = "CASE WHEN f.k = 0 OR f.k * 2 = f.L THEN 1.0 ELSE 2.0 END"
    return (f"SELECT g.sample_id, g.t, sum({c} * (f.re * cos({ang}) - f.im * sin({ang}))) * (1.0 / CAST(any_value(f.L) AS DOUBLE)) AS {out} "
            f"FROM {times_rel} g JOIN {spec_rel} f USING (sample_id) GROUP BY g.sample_id, g.t")


@query("rfft_amplitude", f"WITH {SPEC_SQL} SELECT sample_id, k, {r('re')} AS re, {r('im')} AS im, {r('amp')} AS amp, "
       f"{r(f'CASE WHEN amp < {dbl(sq.NO_PHASE)} THEN 0.0 ELSE atan2(im, re) END')} AS phase FROM sa")
def q_rfft(spark, sf):
    """Real DFT of every window: real and imaginary part, amplitude and
    phase, one batch FFT over the windows of an Arrow batch."""
    return rounded(_spec(spark, sf).select("sample_id", "k", "re", "im", "amp", "phase"))


@query("topk_frequencies", f"""
WITH {SPEC_SQL}
SELECT sample_id, rk AS rank, k, {r('amp')} AS amp FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY amp DESC, k) AS rk FROM sa WHERE k > 0) WHERE rk <= {TOPK}
""")
def q_topk_freq(spark, sf):
    t = sp.rank_freqs(_spec(spark, sf), "sample_id", TOPK)
    return rounded(t.select("sample_id", F.col("rank"), "k", "amp"))


@query("detect_period", f"""
WITH {SPEC_SQL}, m AS (SELECT k, CASE WHEN k = 0 THEN 0.0 ELSE avg(amp) END AS mean_amp FROM sa GROUP BY k),
top AS (SELECT *, row_number() OVER (ORDER BY mean_amp DESC, k) AS rk FROM m WHERE k > 0 QUALIFY rk <= {TOPK}),
w AS (SELECT sa.sample_id, top.rk, top.k, CAST(sa.L // top.k AS BIGINT) AS period, top.mean_amp, sa.amp,
             exp(sa.amp - max(sa.amp) OVER (PARTITION BY sa.sample_id)) AS e FROM sa JOIN top USING (k))
SELECT sample_id, rk AS rank, k, period, {r('mean_amp')} AS mean_amp, {r('amp')} AS amp,
       {r('e / sum(e) OVER (PARTITION BY sample_id)')} AS weight FROM w
""")
def q_detect_period(spark, sf):
    """Top-k frequencies of the mean amplitude spectrum over all samples (DC
    left out) and their periods L // k; each sample weights these shared
    periods by the softmax of its own amplitudes there.

    The ranking runs over the L/2 + 1 frequencies (a bounded table), the
    selection is one row of k entries, and weights are made inside each
    sample's row: no sample is shuffled."""
    x = tb.sequence_arrays(spark, sf).select("sample_id", F.size("x").cast("long").alias("L"), sq.spectrum("x")["amp"].alias("amps"))
    m = x.select(F.posexplode("amps").alias("k", "amp")).where("k > 0").groupBy("k").agg(F.avg("amp").alias("mean_amp"))
    top = sp.rank_freqs(m.withColumn("_g", F.lit(0)), "_g", TOPK, score="mean_amp")
    top = top.agg(F.sort_array(F.collect_list(F.struct("rank", F.col("k").cast("long").alias("k"), "mean_amp"))).alias("top"))
    d = x.crossJoin(F.broadcast(top))
    amp = F.transform("top", lambda p: F.get("amps", p["k"].cast("int")))
    d = d.withColumn("amp", amp).withColumn("e", F.transform("amp", lambda a: F.coalesce(F.exp(a - F.array_max("amp")), F.lit(0.0))))
    total = F.aggregate("e", F.lit(0.0), lambda a, v: a + v)
    d = d.select("sample_id", "L", F.explode(F.arrays_zip("top", "amp", F.transform("e", lambda v: v / total).alias("weight"))).alias("p"))
    return rounded(d.select("sample_id", "p.top.rank", "p.top.k", F.floor(F.col("L") / F.col("p.top.k")).cast("long").alias("period"),
                            "p.top.mean_amp", "p.amp", "p.weight"))


N_SHARED = f"CAST(floor((SELECT count(DISTINCT k) FROM sa) * {dbl(SHARED_ALPHA)}) AS BIGINT)"
SHARED_SQL = f"""{SPEC_SQL}, ms AS (SELECT k, avg(amp) AS mean_amp FROM sa GROUP BY k),
sh AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY mean_amp DESC, k) AS rk FROM ms) WHERE rk <= {N_SHARED})"""


def _shared(spark, sf, spec=None):
    s = spec if spec is not None else _spec(spark, sf)
    m = s.groupBy("k").agg(F.avg("amp").alias("mean_amp"))
    nf = m.agg(F.floor(F.count(F.lit(1)) * F.lit(SHARED_ALPHA)).alias("_nk"))
    m = m.crossJoin(F.broadcast(nf)).withColumn("_g", F.lit(0))
    from pyspark.sql import Window
    w = Window.partitionBy("_g").orderBy(F.col("mean_amp").desc(), F.col("k"))
    return m.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= F.col("_nk"))


@query("spectrum_shared_topk", f"WITH {SHARED_SQL} SELECT rk AS rank, k, {r('mean_amp')} AS mean_amp FROM sh")
def q_shared(spark, sf):
    """Frequencies shared by all windows: top floor(alpha * F) of the mean
    amplitude spectrum (DC included)."""
    return rounded(_shared(spark, sf).select(F.col("rk").alias("rank"), "k", "mean_amp"))


@query("fourier_decompose", f"""
WITH {SPEC_SQL},
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY amp DESC, k) AS rk FROM sa WHERE k > 0) WHERE rk <= {DECOMP_K}),
se AS ({_idft_sql('top', 's', 'season')})
SELECT s.sample_id, s.t, {r('se.season')} AS season, {r('s.value - se.season')} AS trend FROM s JOIN se USING (sample_id, t)
""")
def q_fourier_decompose(spark, sf):
    """season = inverse DFT of the top-k frequencies (DC excluded), trend =
    the rest (DC goes to the trend)."""
    s = tb.sequences(spark, sf)
    top = sp.rank_freqs(_spec(spark, sf), "sample_id", DECOMP_K)
    se = sp.idft(top, s, "sample_id", "t", "season")
    return rounded(s.join(se, ["sample_id", "t"]).select("sample_id", "t", "season",
                                                         (F.col("value") - F.col("season")).alias("trend")))


@query("fourier_filter", f"""
WITH {SHARED_SQL}, msk AS (SELECT sa.* FROM sa JOIN sh USING (k)),
inv AS ({_idft_sql('msk', 's', 'x_inv')})
SELECT s.sample_id, s.t, {r('s.value - inv.x_inv')} AS x_var, {r('inv.x_inv')} AS x_inv FROM s JOIN inv USING (sample_id, t)
""")
def q_fourier_filter(spark, sf):
    """Split into the shared-spectrum part (time invariant, x_inv) and the
    rest (time variant, x_var)."""
    s = tb.sequences(spark, sf)
    spec = _spec(spark, sf)
    sh = _shared(spark, sf, spec).select("k")
    inv = sp.idft(spec.join(F.broadcast(sh), "k"), s, "sample_id", "t", "x_inv")
    return rounded(s.join(inv, ["sample_id", "t"]).select("sample_id", "t", (F.col("value") - F.col("x_inv")).alias("x_var"), "x_inv"))


@query("fourier_extrapolate", f"""
WITH {SPEC_SQL},
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY amp DESC, k) AS rk FROM sa
        WHERE k > 0 AND NOT (L % 2 = 0 AND k * 2 = L)) WHERE rk <= {EXTRA_K}),
tg AS (SELECT ln.sample_id, tt.t FROM ln CROSS JOIN unnest(range(0, ln.L + {EXTRA_H})) AS tt(t)),
ex AS ({_idft_sql('top', 'tg', 'value')})
SELECT sample_id, t, {r('value')} AS value FROM ex
""")
def q_fourier_extrapolate(spark, sf):
    """Top-k frequencies (DC and Nyquist skipped) continued ``pred_len``
    points past the window: sum of 2|X|/L cos(2 pi k t / L + phase)."""
    spec = _spec(spark, sf)
    top = sp.rank_freqs(spec, "sample_id", EXTRA_K, skip_nyquist=True)
    n = tb.sequences(spark, sf).groupBy("sample_id").agg(F.count(F.lit(1)).alias("L"))
    grid = n.select("sample_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("L") + F.lit(EXTRA_H - 1))).alias("t"))
    return rounded(sp.idft(top, grid, "sample_id", "t", "value"))


@query("fourier_lowpass", f"""
WITH {SPEC_SQL}, low AS (SELECT * FROM sa WHERE k < {LOW_MODES}), lp AS ({_idft_sql('low', 's', 'x_low')})
SELECT sample_id, t, {r('x_low')} AS x_low FROM lp
""")
def q_fourier_lowpass(spark, sf):
    """Keep the lowest m frequency modes and reconstruct."""
    s = tb.sequences(spark, sf)
    low = _spec(spark, sf).filter(F.col("k") < LOW_MODES)
    return rounded(sp.idft(low, s, "sample_id", "t", "x_low"))


@query("spectral_softshrink", f"""
WITH {SPEC_SQL},
o AS (SELECT sample_id, k, L, sign(re / sqrt(CAST(L AS DOUBLE))) * greatest(abs(re / sqrt(CAST(L AS DOUBLE))) - {dbl(SHRINK)}, 0.0) AS re,
             sign(im / sqrt(CAST(L AS DOUBLE))) * greatest(abs(im / sqrt(CAST(L AS DOUBLE))) - {dbl(SHRINK)}, 0.0) AS im FROM spec),
g AS (SELECT sample_id, t FROM s),
x AS (SELECT g.sample_id, g.t, sum(CASE WHEN f.k = 0 OR f.k * 2 = f.L THEN 1.0 ELSE 2.0 END
          * (f.re * cos({_ang('f.k', 'g.t', 'f.L')}) - f.im * sin({_ang('f.k', 'g.t', 'f.L')}))) * (1.0 / sqrt(CAST(any_value(f.L) AS DOUBLE))) AS x_shrunk
      FROM g JOIN o f USING (sample_id) GROUP BY g.sample_id, g.t)
SELECT sample_id, t, {r('x_shrunk')} AS x_shrunk FROM x
""")
def q_softshrink(spark, sf):
    """Orthonormal DFT, real and imaginary parts shrunk towards 0 by
    lambda, orthonormal inverse."""
    s = tb.sequences(spark, sf)
    spec = _spec(spark, sf)
    rt = F.sqrt(F.col("L").cast("double"))
    o = spec.select("sample_id", "k", "L", sp.softshrink(F.col("re") / rt, SHRINK).alias("re"),
                    sp.softshrink(F.col("im") / rt, SHRINK).alias("im"))
    return rounded(sp.idft(o, s, "sample_id", "t", "x_shrunk", scale=F.lit(1.0) / F.sqrt(F.col("L").cast("double"))))


CORR_SQL = f"""s AS ({S.SEQUENCES}), ln AS (SELECT sample_id, count(*) AS L FROM s GROUP BY 1),
ac AS (SELECT a.sample_id, tau.tau, sum(b.value * a.value) AS corr
       FROM s a JOIN ln USING (sample_id) CROSS JOIN unnest(range(0, ln.L)) AS tau(tau)
       JOIN s b ON b.sample_id = a.sample_id AND b.t = (a.t + tau.tau) % ln.L GROUP BY 1, 2)"""


@query("autocorrelation", f"WITH {CORR_SQL} SELECT sample_id, tau, {r('corr')} AS corr FROM ac")
def q_autocorr(spark, sf):
    """Circular autocorrelation r[tau] = sum_t x[(t+tau) mod L] x[t], all L lags."""
    return rounded(sq.correlations(tb.sequence_arrays(spark, sf), "sample_id", "x"))


DELAY_SQL = f"""{CORR_SQL},
td AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY {r('corr', 9)} DESC, tau) AS rk FROM ac
       JOIN ln USING (sample_id)) WHERE rk <= CAST(floor({dbl(DELAY_FACTOR)} * ln(CAST(L AS DOUBLE))) AS BIGINT))"""


@query("topk_delays", f"WITH {DELAY_SQL} SELECT sample_id, rk AS rank, tau, {r('corr')} AS corr FROM td")
def q_topk_delays(spark, sf):
    """Top floor(factor * ln L) delays by autocorrelation per series."""
    d = with_delays(spark, sf).select("sample_id", F.posexplode("lags").alias("at", "lag"))
    return rounded(d.select("sample_id", (F.col("at") + 1).alias("rank"), "lag.tau", "lag.corr"))


def with_delays(spark, sf):
    """Windows with their top delays."""
    d = tb.sequence_arrays(spark, sf).withColumn("corr", sq.correlation("x"))
    return d.withColumn("lags", sq.delays("corr", DELAY_FACTOR))


@query("delay_aggregate", f"""
WITH {DELAY_SQL},
wt AS (SELECT sample_id, tau, exp(corr - max(corr) OVER (PARTITION BY sample_id)) AS e FROM td),
wn AS (SELECT sample_id, tau, e / sum(e) OVER (PARTITION BY sample_id) AS w FROM wt)
SELECT a.sample_id, a.t, {r('sum(wn.w * b.value)')} AS value FROM s a JOIN ln USING (sample_id) JOIN wn USING (sample_id)
JOIN s b ON b.sample_id = a.sample_id AND b.t = (a.t + wn.tau) % ln.L GROUP BY a.sample_id, a.t
""")
def q_delay_aggregate(spark, sf):
    """Softmax of the top-k correlations weights the series rolled by each
    delay: out[t] = sum_i w_i x[(t + tau_i) mod L]."""
    d = with_delays(spark, sf).where(F.size("lags") > 0)
    return rounded(d.select("sample_id", F.posexplode(sq.delay_aggregate("x", "lags")).alias("t", "value")))


CONV_ALPHA, CONV_K = 0.3, 16


@query("fft_convolve", f"""
WITH s AS ({S.SEQUENCES}),
w AS (SELECT j, {dbl(CONV_ALPHA)} * pow({dbl(1 - CONV_ALPHA)}, j) AS w FROM range(0, {CONV_K}) r(j))
SELECT a.sample_id, a.t, {r('sum(w.w * b.value)')} AS y FROM s a CROSS JOIN w JOIN s b ON b.sample_id = a.sample_id AND b.t = a.t - w.j
GROUP BY a.sample_id, a.t
""")
def q_fft_convolve(spark, sf):
    """Causal convolution with an exponential kernel (alpha (1-alpha)^j,
    j < 16) as a direct weighted sum inside each window's row."""
    weights = [CONV_ALPHA * (1 - CONV_ALPHA) ** j for j in range(CONV_K)]
    return rounded(sq.causal_convolution(tb.sequence_arrays(spark, sf), "sample_id", "x", weights))


R2 = dbl(math.sqrt(2.0))


@query("haar_split", f"""
WITH s AS ({S.SEQUENCES}),
g AS (SELECT sample_id, CAST(floor(t / 2) AS BIGINT) AS i, sum(CASE WHEN t % 2 = 0 THEN value ELSE 0.0 END) AS e,
             sum(CASE WHEN t % 2 = 1 THEN value ELSE 0.0 END) AS o FROM s GROUP BY 1, 2)
SELECT sample_id, i, {r(f'(e + o) / {R2}')} AS smooth, {r(f'(e - o) / {R2}')} AS detail FROM g
""")
def q_haar_split(spark, sf):
    return rounded(sp.haar_split(tb.sequences(spark, sf), "sample_id", "t", "value"))


@query("haar_merge", f"SELECT sample_id, t, {r('value')} AS value FROM ({S.SEQUENCES})")
def q_haar_merge(spark, sf):
    """The samples from one level of their coefficients (inverse split)."""
    s = tb.sequences(spark, sf)
    c = sp.haar_split(s, "sample_id", "t", "value").join(s.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")), "sample_id")
    return rounded(sp.haar_merge(c, "sample_id", "i", "smooth", "detail", "t", "value", "n").withColumn("t", F.col("t").cast("int")))


HAAR_SQL = f"""{EVENTS_SQL}, c AS (SELECT series_id, count(*) AS n, CAST(ceil(log2(count(*))) AS INTEGER) AS top FROM ev GROUP BY 1),
x0 AS (SELECT ev.series_id, ev.t + rr.r * c.n AS t, ev.value AS v, c.top FROM ev JOIN c USING (series_id)
       CROSS JOIN unnest([0, 1]) AS rr(r) WHERE ev.t + rr.r * c.n < CAST(pow(2, c.top) AS BIGINT)),
lv AS (SELECT series_id, level, CAST(pow(2, level) AS BIGINT) AS span, t, v FROM x0, unnest(range(1, top + 1)) AS l(level)),
co AS (SELECT series_id, CAST(level AS INTEGER) AS level, t // span AS i, sum(v) / sqrt(any_value(span)) AS smooth,
              sum(CASE WHEN t % span < span // 2 THEN v ELSE -v END) / sqrt(any_value(span)) AS detail FROM lv GROUP BY ALL)"""


@query("haar_multilevel", f"WITH {HAAR_SQL} SELECT series_id, level, i, {r('smooth')} AS smooth, {r('detail')} AS detail FROM co")
def q_haar_multi(spark, sf):
    """Extend each series circularly to the next power of two, split log2(P)
    times; every level's (smooth, detail) coefficients, in one aggregate."""
    e = indexed_events(spark, sf).select("series_id", "t", "value")
    return rounded(sp.haar_analysis(e, "series_id", "t", "value").where("level > 0").drop("n"))


@query("haar_reconstruct", f"WITH {EVENTS_SQL} SELECT series_id, t, {r('value')} AS value FROM ev")
def q_haar_reconstruct(spark, sf):
    """The series from their coefficients on all levels, cut back to their
    own lengths."""
    e = indexed_events(spark, sf).select("series_id", "t", "value")
    return rounded(sp.haar_synthesis(materialize(sp.haar_analysis(e, "series_id", "t", "value"), "haar"), "series_id"))
