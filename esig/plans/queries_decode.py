"""Queries of spatial reduction and decoding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import decode, select, spatial, windows
from ..sources import views as V
from .registry import query, rounded

SUBJECT = 10


def vertices(spark, d):
    """subject, roi, epoch, y, vertex, t_idx, x: the embeddings as 8 vertices of 8 samples in two regions."""
    e = V.embedding_signals(spark, d, 8).withColumnRenamed("chan", "vertex")
    return e.withColumn("roi", F.when(F.col("vertex") < 4, "front").otherwise("back"))


VTX = "vx AS (SELECT vec_id % 10 AS subject, vec_id AS epoch, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, (p // 8)::INTEGER AS vertex, CASE WHEN p // 8 < 4 THEN 'front' ELSE 'back' END AS roi, (p % 8)::INTEGER AS t_idx, v::DOUBLE AS x FROM (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(len(embedding))) AS p FROM embeddings))"
COV = "cv AS (SELECT a.subject, a.vertex AS i, b.vertex AS j, covar_samp(a.x, b.x) AS cov FROM vx a JOIN vx b ON a.epoch = b.epoch AND a.t_idx = b.t_idx AND a.vertex <= b.vertex WHERE a.t_idx <= 4 GROUP BY ALL)"


@query("r1_first_pc")
def r1(spark, d):
    return spatial.first_pc(vertices(spark, d))


@query("r2_top_pcs")
def r2(spark, d):
    return spatial.top_pcs(vertices(spark, d), 2)


@query("r3_aggregate_variants", VTX, "pw AS (SELECT subject, roi, vertex, round(var_pop(x), 9) AS p FROM vx GROUP BY ALL)", "tp AS (SELECT subject, roi, arg_min(vertex, (-p, vertex)) AS v FROM pw GROUP BY ALL)", "SELECT subject, roi, epoch, t_idx, round(avg(x), 6) AS mean, max(x) FILTER (vertex = v) AS maxpower FROM vx JOIN tp USING (subject, roi) GROUP BY ALL")
def r3(spark, d):
    return rounded(spatial.aggregate_variants(vertices(spark, d)), "mean")


@query("r3_mean_flip")
def r3f(spark, d):
    v = vertices(spark, d)
    return spatial.mean_flip(v, spatial.top_pcs(v, 1))


@query("r4_epoch_summary")
def r4(spark, d):
    return spatial.epoch_summary(vertices(spark, d))


@query("r5_pca_flip")
def r5(spark, d):
    v = vertices(spark, d)
    flip = v.select("roi", "vertex").distinct().withColumn("flip", F.when(F.col("vertex") % 3 == 1, -1.0).otherwise(1.0))
    return spatial.pca_flip(v, flip)


@query("r6_orthogonalise")
def r6(spark, d):
    return spatial.orthogonalise(spatial.epoch_summary(vertices(spark, d)))


@query("r7_regress_out")
def r7(spark, d):
    v = vertices(spark, d)
    return spatial.regress_out(v, spatial.epoch_summary(v))


@query("r8_baseline_covariance", VTX, COV, "SELECT subject, i, j, round(cov, 6) AS cov FROM cv")
def r8(spark, d):
    return rounded(spatial.covariance(vertices(spark, d).where("t_idx <= 4"), ["subject"], "vertex"), "cov")


@query("r9_shrunk_covariance", VTX, "z AS (SELECT subject, epoch, t_idx, vertex, x - avg(x) OVER (PARTITION BY subject, vertex) AS x FROM vx)", "s AS (SELECT a.subject, a.vertex AS i, b.vertex AS j, sum(a.x * b.x) / count(*) AS c FROM z a JOIN z b ON a.epoch = b.epoch AND a.t_idx = b.t_idx GROUP BY ALL)", "q AS (SELECT subject, sum(r * r) AS r4, count(*) AS n FROM (SELECT subject, epoch, t_idx, sum(x * x) AS r FROM z GROUP BY ALL) GROUP BY ALL)", "t AS (SELECT subject, sum(c) FILTER (i = j) / count(*) FILTER (i = j) AS mu, sum(c * c) AS ss, count(*) FILTER (i = j) AS p FROM s GROUP BY ALL)", "k AS (SELECT subject, mu, greatest(least((r4 / n - ss) / (n * p) / ((ss - p * mu * mu) / p), 1), 0) AS k FROM t JOIN q USING (subject))", "SELECT subject, i, j, round((1 - k) * c + CASE WHEN i = j THEN k * mu ELSE 0 END, 6) AS cov, round(k, 6) AS shrinkage FROM s JOIN k USING (subject) WHERE i <= j")
def r9(spark, d):
    return rounded(spatial.shrunk_covariance(vertices(spark, d), ["subject"], "vertex"))


FILTER = "w AS (SELECT v AS vertex2, c AS vertex, cos(v + c * 0.5::DOUBLE) AS w FROM (SELECT unnest(range(3)) AS v) CROSS JOIN (SELECT unnest(range(8)) AS c))"


def filters(spark):
    return spark.range(24).select((F.col("id") / 8).cast("int").alias("out"), (F.col("id") % 8).cast("int").alias("vertex"), F.cos(F.floor(F.col("id") / 8) + (F.col("id") % 8) * 0.5).alias("w"))


@query("r10_apply_spatial_filter", VTX, FILTER, "SELECT epoch, t_idx, vertex2::INTEGER AS out, round(sum(w * x), 6) AS x FROM vx JOIN w USING (vertex) GROUP BY ALL")
def r10(spark, d):
    return rounded(spatial.apply_filter(vertices(spark, d), F.broadcast(filters(spark)), (), "vertex", "out"), "x")


def gain(spark):
    return filters(spark).select(F.col("out").alias("vertex"), F.col("vertex").alias("chan"), F.col("w").alias("g"))


@query("r11_lcmv_weights")
def r11(spark, d):
    c = spatial.covariance(vertices(spark, d).where("t_idx > 4"), ["subject"], "vertex")
    return spatial.lcmv_weights(gain(spark), c)


@query("r11_lcmv_max_power")
def r11m(spark, d):
    """Data after the event against the baseline's noise; the gains of three orientations are those of ``gain``, turned."""
    g = gain(spark)
    three = reduce(lambda a, b: a.unionByName(b), [g.select("vertex", "chan", F.lit(k).alias("ori"), F.cos(F.col("vertex") * (k + 1) + F.col("chan") * (0.3 + 0.4 * k)).alias("g")) for k in range(3)])
    v = vertices(spark, d)
    return spatial.lcmv_max_power(three, *(spatial.covariance(v.where(w), ["subject"], "vertex") for w in ("t_idx > 4", "t_idx <= 4")))


@query("r12_dspm_weights")
def r12(spark, d):
    c = spatial.covariance(vertices(spark, d).where("t_idx <= 4"), ["subject"], "vertex")
    return spatial.dspm_weights(gain(spark), c)


@query("r13_rank_and_shared_fraction")
def r13(spark, d):
    return spatial.eigen_shares(vertices(spark, d), ["subject"], "vertex")


@query("r15_collapsed_check", VTX, "r AS (SELECT a.subject, a.roi, a.vertex AS i, b.vertex AS j, corr(a.x, b.x) AS r FROM vx a JOIN vx b ON a.epoch = b.epoch AND a.t_idx = b.t_idx AND a.roi = b.roi AND a.vertex < b.vertex GROUP BY ALL)", "s AS (SELECT subject, roi, avg(s) AS spread FROM (SELECT subject, roi, epoch, t_idx, stddev_pop(x) AS s FROM vx GROUP BY ALL) GROUP BY ALL)", "SELECT subject, roi, round(min(r), 6) AS min_r, round(spread, 6) AS spread, min(r) > 0.999 AS collapsed FROM r JOIN s USING (subject, roi) GROUP BY subject, roi, spread")
def r15(spark, d):
    return rounded(spatial.collapsed_check(vertices(spark, d), ["subject", "roi"]), "min_r", "spread")


EP = "ep AS (SELECT vec_id % 10 AS subject, vec_id AS epoch, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y FROM embeddings)"


@query("d1_repeated_stratified_folds", EP, "SELECT subject, epoch, y, rep::INTEGER AS rep, ((row_number() OVER (PARTITION BY subject, rep, y ORDER BY md5(rep || ':' || epoch), epoch) - 1) % 5)::INTEGER AS fold FROM ep CROSS JOIN (SELECT unnest(range(3)) AS rep)")
def d1(spark, d):
    return decode.stratified_folds(V.embedding_epochs(spark, d), ["subject"], 3)


@query("d2_pseudo_trials", VTX, "rk AS (SELECT subject, epoch, y, row_number() OVER (PARTITION BY subject, y ORDER BY md5('0:' || epoch), epoch) AS n, count(*) OVER (PARTITION BY subject, y) AS c FROM (SELECT DISTINCT subject, epoch, y FROM vx))", "SELECT subject, y, ((n - 1) // 4)::INTEGER AS grp, vertex, roi, t_idx, round(avg(x), 6) AS x FROM vx JOIN rk USING (subject, epoch, y) WHERE (n - 1) // 4 < c // 4 GROUP BY ALL")
def d2(spark, d):
    return rounded(decode.pseudo_trials(vertices(spark, d), 4, ["subject"]), "x")


@query("d3_standardise", VTX, "m AS (SELECT subject, vertex, t_idx, avg(x) AS m, stddev_pop(x) AS s FROM vx WHERE epoch % 5 <> 0 GROUP BY ALL)", "SELECT subject, epoch, vertex, t_idx, round((x - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS x FROM vx JOIN m USING (subject, vertex, t_idx)")
def d3(spark, d):
    return rounded(decode.standardise(vertices(spark, d), F.col("epoch") % 5 != 0, ["subject", "vertex", "t_idx"]).select("subject", "epoch", "vertex", "t_idx", "x"), "x")


@query("d4_select_k_best", VTX, "m AS (SELECT subject, t_idx, vertex, y, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM vx GROUP BY ALL)", "t AS (SELECT subject, t_idx, vertex, round(((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1)) / ((sum(q) - sum(s * s / n)) / (sum(n) - count(*))), 9) AS f FROM m GROUP BY ALL)", "p AS (SELECT *, row_number() OVER (PARTITION BY subject, t_idx ORDER BY f DESC NULLS LAST, vertex)::INTEGER AS place FROM t)", "SELECT subject, t_idx, vertex, round(f, 6) AS f, place FROM p WHERE place <= 3")
def d4(spark, d):
    return rounded(decode.select_k_best(vertices(spark, d), ["subject", "t_idx"], 3), "f")


def sessions(spark, d):
    """The vertices with 200 trials to a subject, so that more rows are more subjects and no cell grows."""
    return vertices(spark, d).withColumn("subject", F.floor(F.col("epoch") / 200)).withColumn("t_s", F.col("t_idx") / 100.0)


def windowed(spark, d, sw_ms=40):
    return windows.prepare_windowed(sessions(spark, d), 0.0, 0.07, 100.0, float(sw_ms), 20.0).withColumn("sw_dur", F.lit(sw_ms))


def grid(spark, names, durations=(40,), tuned=(False, True)):
    return select.explore_grid(spark, names, list(durations), tuned).withColumn("c", F.lit(None).cast("double"))


@query("d5_decode_pca")
def d5(spark, d):
    return decode.decode_window(decode.decode_tasks(windowed(spark, d), grid(spark, ["svm", "lda"], tuned=(False,)), k_best=None, pca=True))


@query("d10_decode_window")
def d10(spark, d):
    return decode.decode_window(decode.decode_tasks(windowed(spark, d), grid(spark, ["svm", "lda"], tuned=(False,))))


@query("d11_decode_sliding")
def d11(spark, d):
    return decode.decode_sliding(sessions(spark, d), grid(spark, ["lda"], (20, 40), (False,)), 0.0, 0.07, 100.0, 20.0)


@query("d12_decode_sweep")
def d12(spark, d):
    return decode.decode_sliding(sessions(spark, d), grid(spark, ["svm", "logistic"], (20, 40)), 0.0, 0.07, 100.0, 20.0)


@query("d13_decode_subjects")
def d13(spark, d):
    done, failed = decode.decode_subjects(windowed(spark, d), "svm", 40)
    ok = done.groupBy("subject", "roi").agg(F.count("*").alias("n_windows"), F.avg("decode_acc").alias("mean_acc"))
    return ok.join(failed, ["subject", "roi"], "full")


@query("d14_best_params_text", V.LINEITEM_SWEEP, "SELECT subject, classifier, sw_dur, ms, CASE WHEN classifier = 'R' THEN 'lda' ELSE 'svm(C=' || CASE best_c WHEN 1 THEN '1' WHEN 0.1::DOUBLE THEN '0.1' WHEN 0.01::DOUBLE THEN '0.01' ELSE '0.001' END || '; C_sel=' || round_even(accuracy * 100, 0)::INTEGER || '%)' END AS label FROM swp")
def d14(spark, d):
    name = F.when(F.col("classifier") == "R", "lda").otherwise("svm")
    return V.lineitem_sweep(spark, d).select("subject", "classifier", "sw_dur", "ms", decode.best_params_text(name, F.col("best_c"), F.col("accuracy")).alias("label"))
