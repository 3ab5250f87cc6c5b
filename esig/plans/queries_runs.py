"""Queries of whole connectivity runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import connectivity as G
from ..operators import spectral
from ..sources import views as V
from . import runs
from .queries_connectivity import RATE, centred, wide
from .queries_decode import vertices
from .queries_signals import CCF
from .registry import query, rounded


@query("g12_statespace_gc_time")
def g12(spark, d):
    return G.statespace_gc(wide(spark, d, 2), 30, 30, 2)


@query("g13_moving_window_statespace")
def g13(spark, d):
    return G.statespace_gc(wide(spark, d, 2), 15, 15, 2, [2.0, 6.0, 10.0], RATE)


@query("g14_subject_gc")
def g14(spark, d):
    return runs.subject_gc(vertices(spark, d), 6, 2, 2, [4.0, 6.0, 9.0, 14.0], 40.0, spectral.bands_table(spark))


@query("g14_subject_gc_conditional")
def g14c(spark, d):
    s = V.events_signals(spark, d)
    return runs.subject_gc(s, 15, 15, 2, [4.0, 6.0, 9.0, 14.0], RATE, spectral.bands_table(spark), mode="conditional")


@query("g15_sensor_gc")
def g15(spark, d):
    m = spark.createDataFrame([("p", "click"), ("p", "view"), ("q", "error"), ("q", "signup"), ("r", "purchase")], "roi string, sensor string")
    s = V.events_signals(spark, d).withColumnRenamed("roi", "chan")
    return runs.sensor_gc(s, m, win=15, step=15, order=2, freqs=[4.0, 6.0, 9.0, 14.0], rate=RATE, bands=spectral.bands_table(spark))


@query("g16_wavelet_csd")
def g16(spark, d):
    return G.wavelet_csd(runs.pack(centred(spark, d)), [2.0, 4.0, 6.0, 8.0], RATE, 500.0, step=5)


@query("g17_gc_from_csd")
def g17(spark, d):
    csd = G.wavelet_csd(runs.pack(centred(spark, d)), [float(f) for f in range(1, 15)], RATE, 500.0, step=15)
    return G.gc_from_csd(csd, {"a": ["click", "error"], "b": ["purchase", "signup", "view"]}, [("a", "b"), ("b", "a")], 3, RATE)


@query("a13_order_window_sweep")
def a13(spark, d):
    return runs.order_window_sweep(wide(spark, d, 4), [(10, 2), (20, 2), (20, 4), (4, 4)], 10, [4.0, 8.0], RATE, 30)


@query("a20_pair_diagnosis")
def a20(spark, d):
    return runs.pair_diagnosis(V.events_signals(spark, d), "click", "view", (1, 12), (16, 30), RATE, 4)


@query("a21_method_compare")
def a21(spark, d):
    return runs.method_compare(vertices(spark, d))


@query("m1_pack_unpack", V.EVENTS_SIGNALS, "SELECT subject, epoch, roi, t_idx - 1 AS t_idx, x FROM sig")
def m1(spark, d):
    return runs.unpack(runs.pack(V.events_signals(spark, d)))


@query("b2_ccf_peak", V.EVENTS_SIGNALS, CCF, "SELECT subject, arg_min(lag, (-round(abs(r), 9), lag)) AS peak_lag, round(max(abs(r)), 6) AS peak FROM ccf GROUP BY subject")
def b2p(spark, d):
    c = spectral.ensemble_ccf(V.events_signals(spark, d), 5, "click", "view")
    best = F.min(F.struct(-F.round(F.abs("r"), 9), "lag"))["lag"]
    return rounded(c.groupBy("subject").agg(best.alias("peak_lag"), F.max(F.abs("r")).alias("peak")), "peak")
