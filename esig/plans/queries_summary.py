"""Queries of group summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import align, sets, summary, windows
from ..sources import views as V
from .registry import query, rounded

GRP = ["roi", "ms"]
CFG = ["subject", "classifier", "sw_dur"]


@query("a1_group_mean_sem", V.ORDERS_RESULTS, "SELECT roi, ms, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(value)), 6) AS sem FROM res GROUP BY ALL")
def a1(spark, d):
    return rounded(summary.group_mean_sem(V.orders_results(spark, d), GRP))


@query("a2_class_erp", V.EVENTS_SIGNALS, "SELECT roi, y, t_idx, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x) / sqrt(count(*)), 6) AS sem FROM sig GROUP BY ALL")
def a2(spark, d):
    return rounded(summary.class_erp(V.events_signals(spark, d)))


@query("a3_sensor_erp", V.EMBEDDING_SIGNALS, "SELECT y, chan, t_idx, round(avg(x), 6) AS mean, count(DISTINCT epoch) AS n_trials FROM emb GROUP BY ALL")
def a3(spark, d):
    return rounded(summary.sensor_erp(V.embedding_signals(spark, d)))


SUMMARY = "sm AS (SELECT subject, classifier, sw_dur, max(accuracy) AS peak_acc, arg_min(ms, (-accuracy, ms)) AS peak_ms, avg(accuracy) AS mean_acc FROM swp GROUP BY ALL)"


@query("a4_sweep_summary", V.LINEITEM_SWEEP, SUMMARY, "SELECT subject, classifier, sw_dur, peak_acc, peak_ms, round(mean_acc, 6) AS mean_acc FROM sm")
def a4(spark, d):
    return rounded(summary.sweep_summary(V.lineitem_sweep(spark, d), CFG), "mean_acc")


@query("a5_config_summary", V.LINEITEM_SWEEP, SUMMARY, "SELECT classifier, sw_dur, count(*) AS n_subjects, round(avg(peak_acc), 6) AS mean_peak, round(stddev_samp(peak_acc), 6) AS std_peak, round(avg(mean_acc), 6) AS mean_mean FROM sm GROUP BY ALL")
def a5(spark, d):
    return rounded(summary.config_summary(summary.sweep_summary(V.lineitem_sweep(spark, d), CFG), CFG[1:]))


@query("a6_peak_heatmap", V.LINEITEM_SWEEP, SUMMARY, 'SELECT classifier, round(avg(peak_acc) FILTER (sw_dur = 40), 6) AS "40", round(avg(peak_acc) FILTER (sw_dur = 80), 6) AS "80" FROM sm GROUP BY classifier')
def a6(spark, d):
    return rounded(summary.peak_heatmap(V.lineitem_sweep(spark, d), [40, 80]), "40", "80")


@query("a7_complete_subjects", V.LINEITEM_SWEEP, "SELECT classifier, sw_dur, subject, ms, accuracy FROM (SELECT *, count(*) OVER (PARTITION BY classifier, sw_dur, subject) AS n FROM swp) JOIN (SELECT classifier, sw_dur, count(DISTINCT ms) AS m FROM swp GROUP BY ALL) USING (classifier, sw_dur) WHERE n = m")
def a7(spark, d):
    return summary.complete_subjects(V.lineitem_sweep(spark, d), ["classifier", "sw_dur"]).select("classifier", "sw_dur", "subject", "ms", "accuracy")


MODES = "mn AS (SELECT classifier, sw_dur, ms, round(avg(accuracy), 6) AS m FROM swp GROUP BY ALL), pk AS (SELECT classifier, sw_dur, arg_min(ms, (-m, ms)) AS ms FROM mn GROUP BY ALL), cnt AS (SELECT classifier, sw_dur, best_c, count(*) AS k FROM swp JOIN pk USING (classifier, sw_dur, ms) GROUP BY ALL)"


@query("a8_modal_choice", V.LINEITEM_SWEEP, MODES, "SELECT classifier, sw_dur, arg_min(best_c, (-k, best_c)) AS mode, max(k) || '/' || sum(k)::BIGINT AS support FROM cnt GROUP BY ALL")
def a8(spark, d):
    keys = ["classifier", "sw_dur"]
    return summary.modal_choice(summary.at_group_peak(V.lineitem_sweep(spark, d), keys, "accuracy"), keys, "best_c")


_COUNTS = ", ".join(f"count(*) FILTER (best_c = {v}::DOUBLE) AS n_{i}" for i, v in enumerate((1.0, 0.1, 0.01, 0.001)))
_SHARES = ", ".join(f"round(100 * n_{i} / n, 6) AS pct_{i}" for i in range(4))


@query("a9_pooled_hyperparams", V.LINEITEM_SWEEP, f"t AS (SELECT classifier AS roi, {_COUNTS}, count(best_c) AS n FROM swp GROUP BY ROLLUP (classifier))", f"SELECT roi, n_0, n_1, n_2, n_3, n, {_SHARES} FROM t")
def a9(spark, d):
    return rounded(summary.pooled_hyperparams(V.lineitem_sweep(spark, d).withColumnRenamed("classifier", "roi"), [10.0**0, 0.1, 0.01, 0.001]))


CONTRAST = "con AS (SELECT subject, roi, avg(value) FILTER (ms BETWEEN 1 AND 12) AS base, avg(value) FILTER (ms BETWEEN 13 AND 60) AS task FROM res GROUP BY ALL)"


def contrast(spark, d):
    return summary.task_baseline_contrast(V.orders_results(spark, d), ["subject", "roi"], (1, 12), (13, 60))


@query("a10_task_baseline_contrast", V.ORDERS_RESULTS, CONTRAST, "SELECT subject, roi, round(base, 6) AS base, round(task, 6) AS task, round(task - base, 6) AS diff FROM con")
def a10(spark, d):
    return rounded(contrast(spark, d))


@query("a11_contrast_group_summary", V.ORDERS_RESULTS, CONTRAST, "g AS (SELECT roi, count(*) AS n, avg(task - base) AS mean, stddev_pop(task - base) / sqrt(count(*)) AS sem, count(*) FILTER (task > base) AS n_positive, avg(task - base) / (stddev_samp(task - base) / sqrt(count(*))) AS t FROM con WHERE task IS NOT NULL AND base IS NOT NULL GROUP BY roi)", f"SELECT roi, n, round(mean, 6) AS mean, round(sem, 6) AS sem, n_positive, round(t, 6) AS t, round(2 * ({scalar.t_sf_sql('abs(t)', '(n - 1)')}), 6) AS p FROM g")
def a11(spark, d):
    return rounded(summary.contrast_summary(contrast(spark, d), ["roi"]))


@query("a12_all_pairs_curve", V.ORDERS_RESULTS, "o AS (SELECT subject, ms, avg(value) AS v FROM res GROUP BY ALL)", "SELECT ms, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(*)), 6) AS sem FROM o GROUP BY ms")
def a12(spark, d):
    return rounded(summary.all_pairs_curve(V.orders_results(spark, d), ["roi"], ["ms"]))


@query("a14_config_decision", V.LINEITEM_SWEEP, "m AS (SELECT classifier, sw_dur, subject, avg(accuracy - 0.5) AS m FROM swp GROUP BY ALL)", "SELECT a.classifier, a.sw_dur, round(avg(a.m), 6) AS mean, count(*) FILTER (sign(a.m) = sign(r.m)) AS agree, count(*) FILTER (sign(a.m) <> sign(r.m)) AS flips FROM m a JOIN m r ON a.subject = r.subject AND r.classifier = 'A' AND r.sw_dur = 80 GROUP BY ALL")
def a14(spark, d):
    s = V.lineitem_sweep(spark, d).withColumn("net", F.col("accuracy") - 0.5)
    return rounded(summary.config_decision(s, ["classifier", "sw_dur"], (F.col("classifier") == "A") & (F.col("sw_dur") == 80), ["subject"]))


EDGE_RUNS = "two AS (SELECT a.roi AS src, b.roi AS tgt, a.subject, a.ms, a.value AS v, b.value AS w FROM res a JOIN res b ON a.subject = b.subject AND a.ms = b.ms AND a.roi < b.roi)"


def edge_runs(spark, d):
    r = V.orders_results(spark, d)
    b = r.select("subject", "ms", F.col("roi").alias("tgt"), F.col("value").alias("w"))
    return r.withColumnsRenamed({"roi": "src", "value": "v"}).join(b, ["subject", "ms"]).where("src < tgt")


@query("a15_config_compare", V.ORDERS_RESULTS, EDGE_RUNS, "SELECT src, tgt, round(avg(v), 6) AS fwd_a, round(avg(w), 6) AS rev_a, round(avg(v - w), 6) AS net_a, round(stddev_pop(v - w) / sqrt(count(*)), 6) AS sem_a, round(avg(v + 1), 6) AS fwd_b, round(avg(w * 2), 6) AS rev_b, round(avg(v + 1 - w * 2), 6) AS net_b, round(stddev_pop(v + 1 - w * 2) / sqrt(count(*)), 6) AS sem_b FROM two GROUP BY ALL")
def a15(spark, d):
    e = edge_runs(spark, d)
    one = e.select("subject", "ms", "src", "tgt", F.col("v").alias("fxy"), F.col("w").alias("fyx"))
    two = e.select("subject", "ms", "src", "tgt", (F.col("v") + 1).alias("fxy"), (F.col("w") * 2).alias("fyx"))
    return rounded(summary.config_compare(align.match_pairs(one, two, exact=True, keys=("subject", "ms")), ["src", "tgt"]))


@query("a16_estimator_compare", V.ORDERS_RESULTS, EDGE_RUNS, "k AS (SELECT *, rank() OVER (PARTITION BY src, tgt ORDER BY v) + (count(*) OVER (PARTITION BY src, tgt, v) - 1) / 2.0::DOUBLE AS rv, rank() OVER (PARTITION BY src, tgt ORDER BY w) + (count(*) OVER (PARTITION BY src, tgt, w) - 1) / 2.0::DOUBLE AS rw FROM two)", "SELECT src, tgt, count(*) AS n, round(corr(v, w), 6) AS pearson, round(corr(rv, rw), 6) AS spearman, round(regr_slope(w, v), 6) AS slope, round(avg(w) / avg(v), 6) AS scale FROM k GROUP BY ALL")
def a16(spark, d):
    return rounded(summary.estimator_compare(edge_runs(spark, d), ["src", "tgt"], "v", "w"))


TWO_CHANNELS = "tc AS (SELECT a.subject, a.epoch, a.t_idx, a.x AS a, b.x AS b FROM sig a JOIN sig b USING (epoch, t_idx) WHERE a.roi = 'click' AND b.roi = 'view')"


def two_channels(spark, d):
    s = V.events_signals(spark, d)
    one, two = (s.where(F.col("roi") == r).select("subject", "epoch", "t_idx", F.col("x").alias(n)) for r, n in (("click", "a"), ("view", "b")))
    return one.join(two, ["subject", "epoch", "t_idx"])


@query("a17_pipeline_agreement", V.EVENTS_SIGNALS, TWO_CHANNELS, "r AS (SELECT subject, epoch, corr(a, b) AS r FROM tc GROUP BY ALL)", "SELECT subject, round(avg(r), 6) AS mean_r, round(avg(abs(r)), 6) AS mean_abs_r, avg((r < 0)::INTEGER)::DOUBLE AS share_negative, avg((abs(r) < 0.9)::INTEGER)::DOUBLE AS share_low, nrmse FROM r JOIN (SELECT subject, round(sqrt(avg(pow(a - b, 2))) / stddev_pop(a), 6) AS nrmse FROM tc GROUP BY subject) USING (subject) GROUP BY subject, nrmse")
def a17(spark, d):
    return rounded(summary.pipeline_agreement(two_channels(spark, d), ["subject"]), "mean_r", "mean_abs_r", "nrmse")


@query("a18_edge_artifact_report", V.EVENTS_SIGNALS, TWO_CHANNELS, "SELECT t_idx, round(avg(abs(a - b)), 6) AS mean_abs, max(abs(a - b)) AS max_abs, round(median(abs(a - b)), 6) AS median_abs FROM tc GROUP BY t_idx")
def a18(spark, d):
    return rounded(summary.edge_artifact_report(two_channels(spark, d), ["t_idx"]), "mean_abs", "median_abs")


@query("a19_group_washout", V.ORDERS_RESULTS, CONTRAST, "SELECT roi, round(avg(task - base), 6) AS mean_diff, round(median(task - base), 6) AS median_diff, avg((base > 200)::INTEGER)::DOUBLE AS share_above FROM con GROUP BY roi")
def a19(spark, d):
    return rounded(summary.group_washout(V.orders_results(spark, d), ["roi"], (1, 12), (13, 60), 200.0), "mean_diff", "median_diff")


@query("a22_status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def a22(spark, d):
    return summary.status_counts(V.table(spark, d, "orders").withColumnRenamed("o_orderstatus", "status"))


@query("k2_mode", V.LINEITEM_SWEEP, "c AS (SELECT subject, best_c, count(*) AS k FROM swp GROUP BY ALL)", "SELECT subject, arg_min(best_c, (-k, best_c)) AS mode, max(k) || '/' || sum(k)::BIGINT AS support FROM c GROUP BY subject")
def k2(spark, d):
    return summary.modal_choice(V.lineitem_sweep(spark, d), ["subject"], "best_c")


@query("k4_canonical_order", V.ORDERS_RESULTS, "SELECT subject, roi, ms, value FROM res ORDER BY roi, ms")
def k4(spark, d):
    return sets.canonical_order(V.orders_results(spark, d))


@query("k5_floor_ranking", V.ORDERS_RESULTS, "f AS (SELECT subject, round(avg(value), 6) AS floor FROM res WHERE ms <= 6 GROUP BY ALL)", "SELECT subject, floor, row_number() OVER (ORDER BY floor, subject)::INTEGER AS place FROM f")
def k5(spark, d):
    f = rounded(V.orders_results(spark, d).where("ms <= 6").groupBy("subject").agg(F.avg("value").alias("floor")))
    return summary.floor_ranking(f, "floor")


@query("w5_peak_of_mean", V.ORDERS_RESULTS, "m AS (SELECT roi, ms, round(avg(value), 6) AS mean FROM res GROUP BY ALL)", "SELECT roi, max(mean) AS peak, arg_min(ms, (-mean, ms)) AS peak_at FROM m GROUP BY roi")
def w5m(spark, d):
    m = rounded(V.orders_results(spark, d).groupBy(*GRP).agg(F.avg("value").alias("mean")))
    return windows.first_peak(m, "mean", ["roi"])
