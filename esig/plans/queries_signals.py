"""Queries of conditioning, window and spectral operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import grid
from ..operators import condition, spectral, windows
from ..sources import views as V
from .registry import query, rounded

KEYS = ["subject", "epoch", "roi", "t_idx"]


@query("c1_resample", V.EVENTS_SIGNALS, "taps AS (SELECT unnest({ks}) AS k, unnest({hs}) AS h)".format(ks=[k for k, _ in condition.resample_taps(2, 5)], hs=[h for _, h in condition.resample_taps(2, 5)]), "outs AS (SELECT epoch, roi, unnest(range(12)) AS j FROM (SELECT DISTINCT epoch, roi FROM sig))", "src AS (SELECT epoch, roi, j, h, (j * 5 - k) // 2 AS i FROM outs, taps WHERE (j * 5 - k) % 2 = 0)", "ref AS (SELECT epoch, roi, j, h, CASE WHEN m <= 29 THEN m ELSE 58 - m END AS i FROM (SELECT *, ((i % 58) + 58) % 58 AS m FROM src))", "SELECT epoch, roi, j::INTEGER AS t_idx, round(sum(h * x), 6) AS x FROM ref JOIN sig USING (epoch, roi) WHERE sig.t_idx - 1 = i GROUP BY ALL")
def c1(spark, d):
    s = V.events_signals(spark, d).withColumn("t_idx", F.col("t_idx") - 1)
    return rounded(condition.resample(s, 500.0, 200.0), "x")


@query("c2_resample_zero_pad", V.EVENTS_SIGNALS, "taps AS (SELECT unnest({ks}) AS k, unnest({hs}) AS h)".format(ks=[k for k, _ in condition.resample_taps(1, 2)], hs=[h for _, h in condition.resample_taps(1, 2)]), "outs AS (SELECT epoch, roi, unnest(range(15)) AS j FROM (SELECT DISTINCT epoch, roi FROM sig))", "SELECT epoch, roi, j::INTEGER AS t_idx, round(sum(h * x), 6) AS x FROM outs CROSS JOIN taps JOIN sig USING (epoch, roi) WHERE sig.t_idx - 1 = j * 2 - k GROUP BY ALL")
def c2(spark, d):
    s = V.events_signals(spark, d).withColumn("t_idx", F.col("t_idx") - 1)
    return rounded(condition.resample(s, 400.0, 200.0, pad="zero"), "x")


@query("c3_demean_trials", V.EVENTS_SIGNALS, "SELECT epoch, roi, t_idx, round(x - avg(x) OVER (PARTITION BY epoch, roi), 6) AS x FROM sig")
def c3(spark, d):
    return rounded(condition.demean_trials(V.events_signals(spark, d)).select("epoch", "roi", "t_idx", "x"), "x")


@query("c4_remove_erp", V.EVENTS_SIGNALS, "SELECT epoch, roi, t_idx, round(x - avg(x) OVER (PARTITION BY subject, roi, t_idx, y), 6) AS x FROM sig")
def c4(spark, d):
    return rounded(condition.remove_erp(V.events_signals(spark, d)).select("epoch", "roi", "t_idx", "x"), "x")


@query("c4_remove_erp_zscore", V.EVENTS_SIGNALS, "SELECT epoch, roi, t_idx, round((x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w > 0 THEN stddev_pop(x) OVER w ELSE 1 END, 6) AS x FROM sig WINDOW w AS (PARTITION BY subject, roi, t_idx, y)")
def c4z(spark, d):
    return rounded(condition.remove_erp(V.events_signals(spark, d), scale=True).select("epoch", "roi", "t_idx", "x"), "x")


@query("c5_average_reference", V.EVENTS_SIGNALS, "SELECT epoch, roi, t_idx, round(x - avg(x) OVER (PARTITION BY epoch, t_idx), 6) AS x FROM sig")
def c5(spark, d):
    return rounded(condition.average_reference(V.events_signals(spark, d)).select("epoch", "roi", "t_idx", "x"), "x")


@query("c6_pseudo_channels", V.EVENTS_SIGNALS, "m AS (SELECT unnest(['p', 'p', 'q']) AS grp, unnest(['click', 'view', 'error']) AS roi)", "SELECT subject, epoch, t_idx, grp AS roi, round(avg(x), 6) AS x FROM sig JOIN m USING (roi) GROUP BY ALL")
def c6(spark, d):
    m = spark.createDataFrame([("p", "CLICK"), ("p", "View"), ("q", "error"), ("r", "nothing")], "roi string, sensor string")
    return rounded(condition.pseudo_channels(V.events_signals(spark, d).withColumnRenamed("roi", "chan"), m), "x")


@query("c7_zscore", V.EVENTS_SIGNALS, "SELECT epoch, roi, t_idx, round((x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w > 0 THEN stddev_pop(x) OVER w ELSE 1 END, 6) AS x FROM sig WINDOW w AS (PARTITION BY epoch, roi)")
def c7(spark, d):
    return rounded(condition.zscore(V.events_signals(spark, d), ["epoch", "roi"]).select("epoch", "roi", "t_idx", "x"), "x")


@query("c8_add_matched_noise")
def c8(spark, d):
    return condition.add_matched_noise(V.events_signals(spark, d), 0.9).select("epoch", "roi", "t_idx", "x")


@query("c9_normalise_by_peak", V.ORDERS_RESULTS, "SELECT subject, roi, ms, round(value / max(abs(value)) OVER (PARTITION BY subject, roi), 6) AS value FROM res")
def c9(spark, d):
    return rounded(condition.normalise_by_peak(V.orders_results(spark, d), ["subject", "roi"], "value"), "value")


@query("w1_sliding_mean", V.EVENTS_SIGNALS, "SELECT epoch, roi, ((t_idx - 1) // 2)::INTEGER AS w, t_idx, round(mean, 6) AS mean FROM (SELECT *, avg(x) OVER f AS mean, count(*) OVER f AS n FROM sig WINDOW f AS (PARTITION BY epoch, roi ORDER BY t_idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE n = 5 AND (t_idx - 1) % 2 = 0")
def w1(spark, d):
    return rounded(windows.sliding_mean(V.events_signals(spark, d), 5, 2), "mean")


@query("w2_prepare_windowed", V.EMBEDDING_SIGNALS, "w AS (SELECT subject, epoch, y, chan, (t_idx - 2) AS s, avg(x) OVER f AS m, count(*) OVER f AS n FROM emb WHERE t_idx BETWEEN 2 AND 13 WINDOW f AS (PARTITION BY epoch, chan ORDER BY t_idx ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))", "SELECT subject, 'all' AS roi, epoch, y, (s // 2)::INTEGER AS w, 20.0 + s * 10.0::DOUBLE AS ms_start, 20.0 + s * 10.0::DOUBLE + 15.0 AS ms_center, list(round(m, 6) ORDER BY chan) AS features FROM w WHERE n = 4 AND s % 2 = 0 GROUP BY ALL")
def w2(spark, d):
    s = V.embedding_signals(spark, d).withColumnsRenamed({"chan": "vertex"}).withColumn("roi", F.lit("all")).withColumn("t_s", F.col("t_idx") / 100.0)
    out = windows.prepare_windowed(s, 0.02, 0.13, 100.0, 40.0, 20.0)
    return out.withColumn("features", F.transform("features", lambda v: grid(v)))


@query("w3_moving_windows", V.EVENTS_SIGNALS, "SELECT subject, unnest(range(1, 30 - 7 + 2, 3))::INTEGER AS start FROM (SELECT DISTINCT subject FROM sig)")
def w3(spark, d):
    return windows.moving_windows(V.events_signals(spark, d), 7, 3)


RUNS = "isl AS (SELECT *, n - row_number() OVER (PARTITION BY subject, roi ORDER BY ms) AS i FROM (SELECT *, row_number() OVER (PARTITION BY subject, roi ORDER BY ms) AS n FROM res) WHERE value > 200)"


@query("w4_runs", V.ORDERS_RESULTS, RUNS, 'SELECT subject, roi, min(ms) AS start, max(ms) AS "end", count(*) AS n, row_number() OVER (PARTITION BY subject, roi ORDER BY min(ms))::INTEGER AS run FROM isl GROUP BY subject, roi, i')
def w4(spark, d):
    return windows.runs(V.orders_results(spark, d), F.col("value") > 200, ["subject", "roi"])


@query("w5_run_report", V.ORDERS_RESULTS, RUNS, 'g AS (SELECT subject, roi, min(ms) AS start, max(ms) AS "end", max(value) AS peak, arg_min(ms, (-value, ms)) AS peak_at FROM isl GROUP BY subject, roi, i)', 'SELECT subject, roi, row_number() OVER (PARTITION BY subject, roi ORDER BY start)::INTEGER AS run, start, "end", peak, peak_at, min(start) OVER (PARTITION BY subject, roi) AS onset, m.global_peak FROM g JOIN (SELECT subject, roi, max(value) AS global_peak FROM res GROUP BY ALL) m USING (subject, roi)')
def w5(spark, d):
    return windows.run_report(V.orders_results(spark, d), F.col("value") > 200, "value", ["subject", "roi"])


@query("w6_edge_windows", V.ORDERS_RESULTS, "SELECT subject, roi, round(avg(value) FILTER (e), 6) AS edge_mean, arg_min(e, (-value, ms)) AS at_edge FROM (SELECT *, row_number() OVER (PARTITION BY subject, roi ORDER BY ms) <= 5 OR row_number() OVER (PARTITION BY subject, roi ORDER BY ms DESC) <= 5 AS e FROM res) GROUP BY ALL")
def w6(spark, d):
    return rounded(windows.edge_windows(V.orders_results(spark, d), 5, "value", ["subject", "roi"]), "edge_mean")


@query("w7_center_labels", V.ORDERS_RESULTS, "SELECT subject, roi, ms, ms + 12.5::DOUBLE AS ms_center FROM res")
def w7(spark, d):
    return windows.center_labels(V.orders_results(spark, d), 25.0, "ms").select("subject", "roi", "ms", "ms_center")


@query("w8_average_rank", "SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0::DOUBLE AS r FROM lineitem")
def w8(spark, d):
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", windows.average_rank("l_quantity", "l_suppkey").alias("r"))


@query("k1_first_peak", V.LINEITEM_SWEEP, "SELECT subject, classifier, sw_dur, max(accuracy) AS peak, arg_min(ms, (-accuracy, ms)) AS peak_at FROM swp GROUP BY ALL")
def k1(spark, d):
    return windows.first_peak(V.lineitem_sweep(spark, d), "accuracy", ["subject", "classifier", "sw_dur"])


CCF = """z AS (SELECT subject, epoch, roi, t_idx, (x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-20) AS z FROM sig WINDOW w AS (PARTITION BY epoch, roi)),
  tr AS (SELECT a.subject, a.epoch, l.lag, avg(a.z * b.z) AS r FROM (SELECT unnest(range(-5, 6)) AS lag) l JOIN z a ON a.roi = 'click' JOIN z b ON b.roi = 'view' AND b.epoch = a.epoch AND b.t_idx = a.t_idx + l.lag GROUP BY ALL),
  ccf AS (SELECT subject, lag::INTEGER AS lag, avg(r) AS r FROM tr GROUP BY ALL)"""


@query("b2_ensemble_ccf", V.EVENTS_SIGNALS, CCF, "SELECT subject, lag, round(r, 6) AS r FROM ccf")
def b2(spark, d):
    return rounded(spectral.ensemble_ccf(V.events_signals(spark, d), 5, "click", "view"), "r")


@query("b3_coherence", V.EVENTS_SIGNALS, "t AS (SELECT subject, epoch, roi, t_idx - 1 AS i, x * (0.5 - 0.5 * cos(2 * pi() * (t_idx - 1) / 29)) AS x FROM sig WHERE roi IN ('click', 'view'))", "dft AS (SELECT subject, epoch, f, sum(x * cos(2 * pi() * f * i / 30)) FILTER (roi = 'click') AS ar, -sum(x * sin(2 * pi() * f * i / 30)) FILTER (roi = 'click') AS ai, sum(x * cos(2 * pi() * f * i / 30)) FILTER (roi = 'view') AS br, -sum(x * sin(2 * pi() * f * i / 30)) FILTER (roi = 'view') AS bi FROM t CROSS JOIN (SELECT unnest(range(16)) AS f) GROUP BY ALL)", "SELECT subject, f * 100.0::DOUBLE / 30 AS freq, round((pow(avg(ar * br + ai * bi), 2) + pow(avg(ai * br - ar * bi), 2)) / (avg(ar * ar + ai * ai) * avg(br * br + bi * bi) + 1e-30), 6) AS coh FROM dft GROUP BY subject, f")
def b3(spark, d):
    return rounded(spectral.coherence(V.events_signals(spark, d), "click", "view", 100.0, 30), "coh")


@query("b4_power_ratio", V.EVENTS_SIGNALS, "SELECT subject, roi, round(avg(x * x) FILTER (t_idx BETWEEN 16 AND 30) / avg(x * x) FILTER (t_idx BETWEEN 1 AND 10), 6) AS power_ratio, round(var_pop(x) FILTER (t_idx BETWEEN 16 AND 30) / var_pop(x) FILTER (t_idx BETWEEN 1 AND 10), 6) AS var_ratio FROM sig GROUP BY ALL")
def b4(spark, d):
    return rounded(spectral.power_ratio(V.events_signals(spark, d), ["subject", "roi"], (1, 10), (16, 30)))


@query("b5_ccf_similarity", V.EVENTS_SIGNALS, CCF, "SELECT a.subject, round(corr(a.r, b.r), 6) AS similarity, arg_min(a.lag, (-round(abs(a.r), 9), a.lag)) AS peak_base, arg_min(a.lag, (-round(abs(b.r), 9), a.lag)) AS peak_task FROM ccf a JOIN ccf b ON a.subject = b.subject AND a.lag = -b.lag GROUP BY a.subject")
def b5(spark, d):
    c = spectral.ensemble_ccf(V.events_signals(spark, d), 5, "click", "view")
    return rounded(spectral.ccf_similarity(c, c.withColumn("lag", -F.col("lag")), ["subject"]), "similarity")


@query("b6_coupling", V.EVENTS_SIGNALS, "SELECT a.subject, round(corr(a.x, b.x), 6) AS r FROM sig a JOIN sig b USING (epoch, t_idx) WHERE a.roi = 'click' AND b.roi = 'view' AND t_idx BETWEEN 5 AND 25 GROUP BY ALL")
def b6(spark, d):
    return rounded(spectral.coupling(V.events_signals(spark, d), "click", "view", ["subject"], 5, 25), "r")


@query("b7_freq_grid", V.EVENTS_SIGNALS, "SELECT subject, f.freq, count(*) AS n FROM sig CROSS JOIN (SELECT 4 + unnest(range(53)) * 0.5::DOUBLE AS freq) f WHERE x > freq GROUP BY ALL")
def b7(spark, d):
    return V.events_signals(spark, d).join(F.broadcast(spectral.freq_grid(spark, 4.0, 30.0, 0.5)), F.col("x") > F.col("freq")).groupBy("subject", "freq").agg(F.count("*").alias("n"))
