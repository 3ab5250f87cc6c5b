"""Queries of lag products, autoregression and directed connectivity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import connectivity as G
from ..operators import spectral
from ..sources import views as V
from .registry import query, rounded

RATE = 30.0
FREQS = [float(f) for f in range(1, 16)]
LP = "lp AS (SELECT a.subject, a.roi AS ci, b.roi AS cj, a.t_idx AS a, b.t_idx - a.t_idx AS lag, sum(a.x * b.x) AS c, count(*) AS n FROM sg a JOIN sg b ON a.epoch = b.epoch AND b.t_idx BETWEEN a.t_idx AND a.t_idx + {lag} GROUP BY ALL)"
RAW = "sg AS (SELECT * FROM sig)"
CENTRED = "sg AS (SELECT subject, epoch, roi, t_idx, x - avg(x) OVER (PARTITION BY subject, roi, t_idx, y) AS x FROM sig)"


def centred(spark, d):
    from ..operators.condition import remove_erp

    return remove_erp(V.events_signals(spark, d))


@query("g1_lag_products", V.EVENTS_SIGNALS, RAW, LP.format(lag=2), "SELECT subject, ci, cj, a, lag, round(c, 6) AS c, n FROM lp")
def g1(spark, d):
    return rounded(G.lag_products(V.events_signals(spark, d), 2), "c")


@query("g1_packed_lag_products", V.EVENTS_SIGNALS, RAW, LP.format(lag=3), "SELECT subject, ci, cj, a - 1 AS a, lag, round(c, 6) AS c, n FROM lp")
def g1p(spark, d):
    one = V.events_signals(spark, d).groupBy("subject", "epoch", "roi").agg(F.array_sort(F.collect_list(F.struct("t_idx", "x"))).alias("s")).select("subject", "epoch", "roi", F.col("s.x").alias("x"))
    packed = one.groupBy("subject", "epoch").agg(F.array_sort(F.collect_list(F.struct("roi", "x"))).alias("c")).select("subject", F.col("c.roi").alias("chans"), F.col("c.x").alias("xs"))
    return rounded(G.packed_lag_products(packed, 3), "c")


@query("g1_lag_means", V.EVENTS_SIGNALS, "SELECT subject, roi AS ci, t_idx AS a, round(avg(x), 6) AS mu, count(*) AS n FROM sig GROUP BY ALL")
def g1m(spark, d):
    return rounded(G.lag_means(V.events_signals(spark, d)), "mu")


def _sum(i, j, on):
    return f"sum(c) FILTER (ci = {i} AND cj = {j} AND {on})"


_M = ", ".join(
    [f"{_sum(i, j, 'lag = 0 AND a < 30')} AS p{k}, {_sum(i, j, 'lag = 0 AND a > 1')} AS q{k}" for i, j, k in (("src", "src", 11), ("src", "tgt", 12), ("tgt", "tgt", 22))]
    + [f"{_sum(i, j, 'lag = 1')} AS r{k}" for i, j, k in (("src", "src", 11), ("tgt", "src", 12), ("src", "tgt", 21), ("tgt", "tgt", 22))]
)
VAR = f"""prs AS (SELECT DISTINCT a.subject, a.ci AS src, b.ci AS tgt FROM lp a JOIN lp b ON a.subject = b.subject AND a.ci < b.ci),
  mm AS (SELECT subject, src, tgt, {_M}, sum(n) FILTER (ci = src AND cj = src AND lag = 1) AS n FROM prs JOIN lp USING (subject) GROUP BY ALL),
  av AS (SELECT *, (r11 * p22 - r12 * p12) / nullif(p11 * p22 - p12 * p12, 0) AS a11, (r12 * p11 - r11 * p12) / nullif(p11 * p22 - p12 * p12, 0) AS a12, (r21 * p22 - r22 * p12) / nullif(p11 * p22 - p12 * p12, 0) AS a21, (r22 * p11 - r21 * p12) / nullif(p11 * p22 - p12 * p12, 0) AS a22 FROM mm),
  vr AS (SELECT subject, src, tgt, a11, a12, a21, a22, (q11 - a11 * r11 - a12 * r12) / n AS s11, (q12 - a11 * r21 - a12 * r22) / n AS s12, (q22 - a21 * r21 - a22 * r22) / n AS s22 FROM av)"""
TR = f"""fz AS (SELECT vr.*, f.freq, cos(2 * pi() * freq / {RATE}) AS c, sin(2 * pi() * freq / {RATE}) AS s FROM vr CROSS JOIN (SELECT unnest(range(1, 16))::DOUBLE AS freq) f),
  de AS (SELECT *, (1 - a11 * c) * (1 - a22 * c) - a11 * s * a22 * s - (a12 * c * a21 * c - a12 * s * a21 * s) AS dr, (1 - a11 * c) * a22 * s + a11 * s * (1 - a22 * c) + a12 * c * a21 * s + a12 * s * a21 * c AS di FROM fz),
  tr AS (SELECT subject, src, tgt, freq, s11, s12, s22,
    ((1 - a22 * c) * dr + a22 * s * di) / nullif(dr * dr + di * di, 0) AS h11_re, (a22 * s * dr - (1 - a22 * c) * di) / nullif(dr * dr + di * di, 0) AS h11_im,
    (a12 * c * dr - a12 * s * di) / nullif(dr * dr + di * di, 0) AS h12_re, (-a12 * s * dr - a12 * c * di) / nullif(dr * dr + di * di, 0) AS h12_im,
    (a21 * c * dr - a21 * s * di) / nullif(dr * dr + di * di, 0) AS h21_re, (-a21 * s * dr - a21 * c * di) / nullif(dr * dr + di * di, 0) AS h21_im,
    ((1 - a11 * c) * dr + a11 * s * di) / nullif(dr * dr + di * di, 0) AS h22_re, (a11 * s * dr - (1 - a11 * c) * di) / nullif(dr * dr + di * di, 0) AS h22_im FROM de)"""
SP = """sp AS (SELECT *, s11 * (h11_re * h11_re + h11_im * h11_im) + 2 * s12 * (h11_re * h12_re + h11_im * h12_im) + s22 * (h12_re * h12_re + h12_im * h12_im) AS p11,
  s11 * (h21_re * h21_re + h21_im * h21_im) + 2 * s12 * (h21_re * h22_re + h21_im * h22_im) + s22 * (h22_re * h22_re + h22_im * h22_im) AS p22,
  s11 * (h11_re * h21_re + h11_im * h21_im) + s12 * (h11_re * h22_re + h11_im * h22_im + h12_re * h21_re + h12_im * h21_im) + s22 * (h12_re * h22_re + h12_im * h22_im) AS p12_re FROM tr)"""
GC = """gc AS (SELECT subject, src, tgt, freq, greatest(ln(p22 / nullif(p22 - (s11 - s12 * s12 / nullif(s22, 0)) * (h21_re * h21_re + h21_im * h21_im), 0)), 0) AS f_xy, greatest(ln(p11 / nullif(p11 - (s22 - s12 * s12 / nullif(s11, 0)) * (h12_re * h12_re + h12_im * h12_im), 0)), 0) AS f_yx FROM sp)"""
CHAIN = (V.EVENTS_SIGNALS, CENTRED, LP.format(lag=1), VAR, TR, SP, GC)


def var(spark, d):
    return G.fit_var_ols(G.lag_products(centred(spark, d), 1))


def freqs(spark):
    return spectral.freq_grid(spark, 1.0, 15.0, 1.0)


def gc(spark, d):
    return G.pairwise_gc(G.transfer(var(spark, d), freqs(spark), RATE)).select("subject", "src", "tgt", "freq", "f_xy", "f_yx")


@query("g2b_fit_var_ols", *CHAIN[:4], "SELECT subject, src, tgt, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("a11", "a12", "a21", "a22", "s11", "s12", "s22")) + " FROM vr")
def g2b(spark, d):
    return rounded(var(spark, d))


@query("g5_spectrum", *CHAIN[:6], "SELECT subject, src, tgt, freq, round(h12_re, 6) AS h12_re, round(h21_im, 6) AS h21_im, round(p11, 6) AS p11, round(p22, 6) AS p22, round(p12_re, 6) AS p12_re FROM sp")
def g5(spark, d):
    return rounded(G.spectrum(G.transfer(var(spark, d), freqs(spark), RATE)).select("subject", "src", "tgt", "freq", "h12_re", "h21_im", "p11", "p22", "p12_re"), "h12_re", "h21_im", "p11", "p22", "p12_re")


@query("g6_pairwise_gc", *CHAIN, "SELECT subject, src, tgt, freq, round(f_xy, 6) AS f_xy, round(f_yx, 6) AS f_yx FROM gc")
def g6(spark, d):
    return rounded(gc(spark, d), "f_xy", "f_yx")


BANDS = "bd AS (SELECT * FROM (VALUES ('theta', 4.0, 8.0, false), ('alpha', 8.0, 12.0, false), ('low_beta', 12.0, 18.0, false), ('high_beta', 18.0, 30.0, true)) t(band, lo, hi, closed))"


@query("b1_band_average", *CHAIN, BANDS, "SELECT g.subject, g.src, g.tgt, bd.band, round(avg(f_xy) FILTER (i), 6) AS f_xy, round(avg(f_yx) FILTER (i), 6) AS f_yx FROM (SELECT *, freq >= lo AND (freq < hi OR (closed AND freq = hi)) AS i FROM gc CROSS JOIN bd) g JOIN bd USING (band) GROUP BY ALL")
def b1(spark, d):
    return rounded(spectral.band_average(gc(spark, d), spectral.bands_table(spark), ["subject", "src", "tgt"], ["f_xy", "f_yx"]))


@query("g18_net_gc", *CHAIN, "SELECT subject, freq, src, tgt, round(f_xy - f_yx, 6) AS net FROM gc")
def g18(spark, d):
    g = gc(spark, d)
    edges = g.select("subject", "freq", "src", "tgt", F.col("f_xy").alias("gc")).unionByName(g.select("subject", "freq", F.col("tgt").alias("src"), F.col("src").alias("tgt"), F.col("f_yx").alias("gc")))
    return rounded(G.net_gc(edges, ["subject", "freq"]), "net")


@query("g19_returned_grid", *CHAIN, "SELECT subject, src, tgt, freq, round(f_xy, 6) AS f_xy FROM gc WHERE freq >= 5.0 * 30 / 30")
def g19(spark, d):
    return rounded(G.returned_grid(gc(spark, d), RATE, 30).select("subject", "src", "tgt", "freq", "f_xy"), "f_xy")


@query("g20_under_resolved_bands", BANDS, "SELECT e.event_type, band, lo::DOUBLE AS lo, hi::DOUBLE AS hi, closed AS hi_closed, lo * n / 1000.0::DOUBLE AS cycles, lo * n / 1000.0::DOUBLE < 10 AS under_resolved, round(10000 / lo::DOUBLE, 9) AS min_window_ms FROM bd CROSS JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY ALL) e")
def g20(spark, d):
    n = V.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    rows = n.join(F.broadcast(spectral.bands_table(spark)))
    return rounded(G.under_resolved(rows, F.col("n"), 10.0).drop("n"), "min_window_ms", places=9)


def wide(spark, d, lag):
    return G.lag_products(centred(spark, d), lag)


@query("g8_moving_window_pairwise")
def g8(spark, d):
    return G.moving_window_pairwise(wide(spark, d, 3), 12, 6, 3, [4.0, 8.0, 12.0], RATE)


@query("g7_diff_trgc")
def g7(spark, d):
    c = wide(spark, d, 2)
    return G.diff_trgc(G.moving_window_pairwise(c, 15, 15, 2, [4.0, 8.0], RATE), G.moving_window_pairwise(c, 15, 15, 2, [4.0, 8.0], RATE, reverse=True))


@query("g3_order_criteria")
def g3(spark, d):
    return G.order_criteria(wide(spark, d, 4), [1, 2, 3, 4])


@query("g4_bic_order")
def g4(spark, d):
    return G.best_order(G.order_criteria(wide(spark, d, 4), [1, 2, 3, 4]), "bic_full")


@query("g9_conditional_gc_time")
def g9(spark, d):
    return G.conditional_gc(wide(spark, d, 2), 2)


@query("g10_conditional_gc_spectral")
def g10(spark, d):
    return G.conditional_gc(wide(spark, d, 2), 2, [2.0, 6.0, 10.0], RATE)


@query("g11_moving_window_conditional")
def g11(spark, d):
    return G.moving_window_conditional(wide(spark, d, 2), 15, 5, 2, [2.0, 6.0, 10.0], RATE)
