"""Queries of statistical tests and the flagship composition."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import t_sf_sql
from ..operators import stats
from ..sources import views as V
from . import group_stats
from .registry import query, rounded

MU = 260.0
TT = f"tt AS (SELECT *, CASE WHEN n > 1 AND sem > 0 THEN (mean - {MU}) / sem END AS t FROM (SELECT roi, ms, count(value) AS n, avg(value) AS mean, stddev_samp(value) / sqrt(count(value)) AS sem FROM res GROUP BY ALL))"
TP = f"tp AS (SELECT *, CASE WHEN t IS NOT NULL THEN {t_sf_sql('t', '(n - 1)')} END AS p FROM tt)"


def tests(spark, d):
    return stats.ttest(V.orders_results(spark, d), ["roi", "ms"], mu=MU)


@query("t1_ttest_greater", V.ORDERS_RESULTS, TT, TP, "SELECT roi, ms, n, round(mean, 6) AS mean, round(sem, 6) AS sem, round(t, 6) AS t, round(p, 6) AS p FROM tp")
def t1(spark, d):
    return rounded(tests(spark, d))


@query("t2_ttest_two_sided", V.ORDERS_RESULTS, TT, f"SELECT roi, ms, n, round(mean, 6) AS mean, round(sem, 6) AS sem, round(t, 6) AS t, round(CASE WHEN t IS NOT NULL THEN 2 * ({t_sf_sql('abs(t)', '(n - 1)')}) END, 6) AS p FROM tt")
def t2(spark, d):
    return rounded(stats.ttest(V.orders_results(spark, d), ["roi", "ms"], mu=MU, tail="two-sided"))


_PHI = "CASE WHEN z >= 0 THEN q ELSE 1 - q END"
WIL = f"""dd AS (SELECT roi, ms, value - {MU} AS d FROM res WHERE value <> {MU}),
  rk AS (SELECT *, rank() OVER (PARTITION BY roi, ms ORDER BY abs(d)) + (count(*) OVER (PARTITION BY roi, ms, abs(d)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY roi, ms, abs(d)) AS c FROM dd),
  ww AS (SELECT roi, ms, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w, sum(c * c - 1) AS ties FROM rk GROUP BY ALL),
  zz AS (SELECT *, (w - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - ties / 48.0::DOUBLE) AS z FROM ww),
  kk AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS k FROM zz),
  qq AS (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) * k * (0.319381530::DOUBLE + k * (-0.356563782::DOUBLE + k * (1.781477937::DOUBLE + k * (-1.821255978::DOUBLE + k * 1.330274429::DOUBLE)))) AS q FROM kk)"""


@query("t3_wilcoxon_greater", V.ORDERS_RESULTS, WIL, f"SELECT roi, ms, n, w, round({_PHI}, 6) AS p FROM qq")
def t3(spark, d):
    return rounded(stats.wilcoxon_greater(V.orders_results(spark, d), ["roi", "ms"], mu=MU), "p")


#: Counts of subsets of 1..n by their sum, as signed_rank_tail builds them.
COUNTS = "cnt AS (SELECT * FROM (WITH RECURSIVE c AS (SELECT 0 AS n, [1.0::DOUBLE] AS f UNION ALL SELECT n + 1, [coalesce(f[i], 0) + CASE WHEN i > n + 1 THEN f[i - n - 1] ELSE 0 END FOR i IN range(1, len(f) + n + 2)] FROM c WHERE n < 50) SELECT * FROM c))"


@query("t3_wilcoxon_exact", V.ORDERS_RESULTS, WIL, COUNTS, f"SELECT roi, ms, qq.n AS n, w, round(CASE WHEN qq.n <= 50 AND ties = 0 THEN list_sum(f[1:(qq.n * (qq.n + 1) // 2 - w + 1)::INTEGER]) / pow(2, qq.n) ELSE {_PHI} END, 6) AS p FROM qq LEFT JOIN cnt ON cnt.n = qq.n")
def t3_exact(spark, d):
    return rounded(stats.wilcoxon_greater(V.orders_results(spark, d), ["roi", "ms"], mu=MU, exact_to=50), "p")


def tvb(a, b):
    return f"""pt AS (SELECT roi, ms, count(value) AS n, avg(value) AS mean, stddev_samp(value) / sqrt(count(value)) AS sem FROM res GROUP BY ALL),
  fl AS (SELECT roi, avg(mean) AS baseline_mean FROM pt WHERE ms BETWEEN {a[0]} AND {a[1]} GROUP BY roi),
  st AS (SELECT *, CASE WHEN ms BETWEEN {b[0]} AND {b[1]} AND n > 1 AND sem > 0 THEN (mean - baseline_mean) / sem END AS t FROM pt JOIN fl USING (roi)),
  tb AS (SELECT *, CASE WHEN t IS NOT NULL THEN {t_sf_sql('t', '(n - 1)')} END AS p FROM st)"""


@query("t4_task_vs_baseline", V.ORDERS_RESULTS, tvb((1, 6), (7, 70)), "SELECT roi, ms, n, round(mean, 6) AS mean, round(sem, 6) AS sem, round(baseline_mean, 6) AS baseline_mean, round(t, 6) AS t, round(p, 6) AS p, coalesce(p < 0.05, false) AS sig FROM tb")
def t4(spark, d):
    return rounded(stats.task_vs_baseline(V.orders_results(spark, d), ["roi"], (1, 6), (7, 70)))


@query("t5_run_stats", V.ORDERS_RESULTS, tvb((1, 11), (11.5, 80)), "dd AS (SELECT roi, ms, value - baseline_mean AS d FROM res JOIN fl USING (roi) WHERE ms BETWEEN 11.5 AND 80 AND value <> baseline_mean)", WIL.split("),\n", 1)[1], f"SELECT roi, ms AS window_ms, 't' AS test, round(mean, 6) AS gc_mean, round(sem, 6) AS gc_sem, round(baseline_mean, 6) AS baseline_mean, round(p, 6) AS pval, coalesce(p < 0.05, false) AS sig FROM tb UNION ALL SELECT t.roi, t.ms, 'wilcoxon', round(mean, 6), round(sem, 6), round(baseline_mean, 6), round({_PHI}, 6), coalesce({_PHI} < 0.05, false) FROM st t LEFT JOIN qq ON t.roi = qq.roi AND t.ms = qq.ms")
def t5(spark, d):
    return rounded(group_stats.run_stats(V.orders_results(spark, d), ["roi"], base_ms=10.0, value="value"))


@query("t6_bonferroni", V.ORDERS_RESULTS, TT, TP, "SELECT roi, ms, round(p, 6) AS p, round(least(p * count(p) OVER (PARTITION BY roi), 1), 6) AS p_bonf FROM tp")
def t6(spark, d):
    return rounded(stats.bonferroni(tests(spark, d), ["roi"]).select("roi", "ms", "p", "p_bonf"))


@query("t7_fdr_bh", V.ORDERS_RESULTS, TT, TP, "q AS (SELECT *, p * count(p) OVER (PARTITION BY roi) / row_number() OVER (PARTITION BY roi ORDER BY p NULLS LAST, ms) AS q FROM tp)", "SELECT roi, ms, round(p, 6) AS p, round(CASE WHEN p IS NOT NULL THEN least(min(q) OVER (PARTITION BY roi ORDER BY p NULLS LAST, ms ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) END, 6) AS p_fdr FROM q")
def t7(spark, d):
    return rounded(stats.fdr_bh(tests(spark, d), ["roi"]).select("roi", "ms", "p", "p_fdr"))


PERMS = 1024
FLIPS = f"fl AS (SELECT s.subject, p.perm, CASE WHEN p.perm = 0 THEN 1.0::DOUBLE WHEN instr('0123456789abcdef', substr(md5('0:' || p.perm || ':' || s.subject), 1, 1)) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign FROM (SELECT DISTINCT subject FROM res) s CROSS JOIN (SELECT unnest(range({PERMS})) AS perm) p)"
PT = f"""cen AS (SELECT subject, roi, ms, value - {MU} AS value FROM res),
  sq AS (SELECT roi, ms, sum(value * value) AS ss, count(*) AS n FROM cen GROUP BY ALL),
  sg AS (SELECT roi, perm, ms, sum(value * sign) AS s FROM cen JOIN fl USING (subject) GROUP BY ALL),
  pt AS (SELECT roi, perm, ms, CASE WHEN v > 0 THEN s / n / sqrt(v / n) ELSE 0 END AS stat FROM (SELECT *, (ss - s * s / n) / nullif(n - 1, 0) AS v FROM sg JOIN sq USING (roi, ms)))"""
CL = """isl AS (SELECT *, n - row_number() OVER (PARTITION BY roi, perm ORDER BY ms) AS i FROM (SELECT *, row_number() OVER (PARTITION BY roi, perm ORDER BY ms) AS n FROM pt) WHERE stat > 1.2),
  cl AS (SELECT roi, perm, min(ms) AS start, max(ms) AS "end", round(sum(stat), 9) AS mass FROM isl GROUP BY roi, perm, i),
  top AS (SELECT roi, perm, max(mass) AS top FROM cl GROUP BY ALL)"""


def centred(spark, d):
    return V.orders_results(spark, d).withColumn("value", F.col("value") - MU)


T8 = (V.ORDERS_RESULTS, FLIPS, PT, CL, f'SELECT c.roi, row_number() OVER (PARTITION BY c.roi ORDER BY c.start)::INTEGER AS run, c.start, c."end", round(c.mass, 6) AS mass, (SELECT count(*) FROM top WHERE top.roi = c.roi AND top.top >= c.mass)::DOUBLE / {PERMS} AS p_cluster FROM cl c WHERE c.perm = 0')


@query("t8_cluster_permutation", *T8)
@query("t8_cluster_permutation_all", *T8)
def t8(spark, d):
    return rounded(stats.cluster_permutation(centred(spark, d), ["roi"], 1.2, PERMS), "mass")


TF = """hh AS (SELECT roi, perm, ms, n, unnest(range(1, greatest(floor(stat / 0.5)::INTEGER, 1) + 1)) AS k, stat FROM (SELECT *, row_number() OVER (PARTITION BY roi, perm ORDER BY ms) AS n FROM pt) WHERE stat > 0),
  hi AS (SELECT *, n - row_number() OVER (PARTITION BY roi, perm, k ORDER BY n) AS i FROM hh WHERE k * 0.5 <= stat),
  hs AS (SELECT roi, perm, ms, sqrt(count(*) OVER (PARTITION BY roi, perm, k, i)) * pow(k * 0.5::DOUBLE, 2) * 0.5::DOUBLE AS s FROM hi),
  sc AS (SELECT roi, perm, ms, CASE WHEN s > 0 THEN round_even(s * pow(2, 29 - floor(log2(s))), 0) / pow(2, 29 - floor(log2(s))) ELSE 0 END AS tfce FROM pt LEFT JOIN (SELECT roi, perm, ms, sum(s) AS s FROM hs GROUP BY ALL) USING (roi, perm, ms)),
  tops AS (SELECT roi, perm, max(tfce) AS top FROM sc GROUP BY ALL)"""


T9 = (V.ORDERS_RESULTS, FLIPS, PT, TF, f"SELECT s.roi, s.ms, round(s.tfce, 3) AS tfce, count(*) FILTER (t.top >= s.tfce)::DOUBLE / {PERMS} AS p_tfce FROM sc s JOIN tops t ON s.roi = t.roi WHERE s.perm = 0 GROUP BY ALL")


@query("t9_tfce", *T9)
@query("t9_tfce_all", *T9)
def t9(spark, d):
    return rounded(stats.tfce_permutation(centred(spark, d), ["roi"], PERMS, 0.5), "tfce", places=3)


@query("t10_across_roi_bonferroni", V.ORDERS_RESULTS, TT, TP, "SELECT roi, ms, round(p, 6) AS p, round(least(p * (SELECT count(DISTINCT roi) FROM tp), 1), 6) AS p_rois FROM tp")
def t10(spark, d):
    return rounded(stats.across_roi_bonferroni(tests(spark, d), "p").select("roi", "ms", "p", "p_rois"))


def crit(name, keys, sizes):
    """Upper 5 % point of Student's t of every group of ``sizes`` (keys, n_subjects), by bisection."""
    return f"""{name} AS (SELECT * FROM (WITH RECURSIVE b AS (SELECT {keys}, n_subjects AS k, 0.0::DOUBLE AS lo, 64.0::DOUBLE AS hi, 0 AS i FROM {sizes}
    UNION ALL SELECT {keys}, k, CASE WHEN p > 0.05 THEN mid ELSE lo END, CASE WHEN p > 0.05 THEN hi ELSE mid END, i + 1 FROM (SELECT *, {t_sf_sql('mid', '(k - 1)')} AS p FROM (SELECT *, (lo + hi) / 2 AS mid FROM b WHERE i < 60)))
    SELECT {keys}, CASE WHEN k < 2 THEN 'inf'::DOUBLE ELSE hi END AS cut FROM b WHERE i = 60))"""


SWEPT = f"""n AS (SELECT classifier, sw_dur, count(DISTINCT subject) AS n_subjects FROM swp GROUP BY ALL),
  big AS (SELECT * FROM n WHERE n_subjects >= 3),
  {crit("crit", "classifier, sw_dur", "big")},
  pk AS (SELECT classifier, sw_dur, max(mean) AS peak, arg_min(ms, (-mean, ms)) AS peak_at FROM (SELECT classifier, sw_dur, ms, round(avg(accuracy), 6) AS mean FROM swp GROUP BY ALL) GROUP BY ALL),
  cen AS (SELECT subject, classifier, sw_dur, ms, accuracy - 0.49::DOUBLE AS value FROM swp JOIN n USING (classifier, sw_dur) WHERE n_subjects >= 3),
  fl AS (SELECT s.subject, p.perm, CASE WHEN p.perm = 0 THEN 1.0::DOUBLE WHEN instr('0123456789abcdef', substr(md5('0:' || p.perm || ':' || s.subject), 1, 1)) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign FROM (SELECT DISTINCT subject FROM cen) s CROSS JOIN (SELECT unnest(range({PERMS})) AS perm) p),
  sq AS (SELECT classifier, sw_dur, ms, sum(value * value) AS ss, count(*) AS n FROM cen GROUP BY ALL),
  sg AS (SELECT classifier, sw_dur, perm, ms, sum(value * sign) AS s FROM cen JOIN fl USING (subject) GROUP BY ALL),
  pt AS (SELECT classifier, sw_dur, perm, ms, CASE WHEN v > 0 THEN s / n / sqrt(v / n) ELSE 0 END AS stat FROM (SELECT *, (ss - s * s / n) / nullif(n - 1, 0) AS v FROM sg JOIN sq USING (classifier, sw_dur, ms))),
  isl AS (SELECT *, n - row_number() OVER (PARTITION BY classifier, sw_dur, perm ORDER BY ms) AS i FROM (SELECT *, row_number() OVER (PARTITION BY classifier, sw_dur, perm ORDER BY ms) AS n FROM pt) JOIN crit USING (classifier, sw_dur) WHERE stat > cut),
  cl AS (SELECT classifier, sw_dur, perm, min(ms) AS start, round(sum(stat), 9) AS mass FROM isl GROUP BY classifier, sw_dur, perm, i),
  top AS (SELECT classifier, sw_dur, perm, max(mass) AS top FROM cl GROUP BY ALL),
  pc AS (SELECT c.classifier, c.sw_dur, c.start, count(*) FILTER (t.top >= c.mass)::DOUBLE / {PERMS} AS p FROM cl c JOIN top t ON c.classifier = t.classifier AND c.sw_dur = t.sw_dur WHERE c.perm = 0 GROUP BY c.classifier, c.sw_dur, c.start, c.mass),
  ht AS (SELECT classifier, sw_dur, count(*) AS k, min(start) AS onset FROM pc WHERE p < 0.05 GROUP BY ALL)"""


@query("t11_config_cluster_stats", V.LINEITEM_SWEEP, SWEPT, "SELECT classifier, sw_dur, n.n_subjects, peak, peak_at, CASE WHEN n.n_subjects >= 3 THEN coalesce(k, 0) END AS n_clusters, onset FROM n JOIN pk USING (classifier, sw_dur) LEFT JOIN ht USING (classifier, sw_dur)")
def t11(spark, d):
    return group_stats.config_cluster_stats(V.lineitem_sweep(spark, d), ["classifier", "sw_dur"], 0.49)


SIZES = "n12 AS (SELECT roi, count(DISTINCT subject) AS n_subjects FROM res GROUP BY roi)"
BOTH = f"""bt AS (SELECT *, least(p * count(p) OVER (PARTITION BY roi), 1) AS p_bonf, p * count(p) OVER (PARTITION BY roi) / row_number() OVER (PARTITION BY roi ORDER BY p NULLS LAST, ms) AS q FROM tp),
  bf AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(min(q) OVER (PARTITION BY roi ORDER BY p NULLS LAST, ms ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) END AS p_fdr FROM bt),
  cp AS (SELECT c.roi, c.start, c."end", c.mass, (SELECT count(*) FROM top WHERE top.roi = c.roi AND top.top >= c.mass)::DOUBLE / {PERMS} AS p_cluster FROM cl c WHERE c.perm = 0),
  tq AS (SELECT s.roi, s.ms, s.tfce, count(*) FILTER (t.top >= s.tfce)::DOUBLE / {PERMS} AS p_tfce FROM sc s JOIN tops t ON s.roi = t.roi WHERE s.perm = 0 GROUP BY ALL),
  nr AS (SELECT count(DISTINCT roi) AS r FROM tp)"""
T12 = "SELECT b.roi, b.ms, n, round(mean, 6) AS mean, round(sem, 6) AS sem, round(b.t, 6) AS t, round(p, 6) AS p, round(p_bonf, 6) AS p_bonf, round(p_fdr, 6) AS p_fdr, round(mass, 6) AS mass, round(p_cluster, 6) AS p_cluster, round(tfce, 3) AS tfce, round(p_tfce, 6) AS p_tfce, round(least(p_cluster * r, 1), 6) AS p_cluster_rois, round(least(p_tfce * r, 1), 6) AS p_tfce_rois FROM bf b LEFT JOIN cp c ON b.roi = c.roi AND b.ms BETWEEN c.start AND c.\"end\" JOIN tq q ON q.roi = b.roi AND q.ms = b.ms, nr"


@query("t12_roi_stats", V.ORDERS_RESULTS, TT, TP, FLIPS, PT, SIZES, crit("crit", "roi", "n12"), CL.replace("WHERE stat > 1.2", "JOIN crit USING (roi) WHERE stat > cut"), TF, BOTH, T12)
def t12(spark, d):
    out = group_stats.roi_stats(V.orders_results(spark, d), MU)
    return rounded(rounded(out, *[c for c, t in out.dtypes if t == "double" and c != "tfce"]), "tfce", places=3)


FLAG = f"""dm AS (SELECT subject, epoch, roi, t_idx, x - avg(x) OVER (PARTITION BY subject, epoch, roi) AS x FROM sig),
  sm AS (SELECT subject, roi, t_idx AS ms, avg(mean) AS value FROM (SELECT *, avg(x) OVER f AS mean, count(*) OVER f AS n FROM dm WINDOW f AS (PARTITION BY subject, epoch, roi ORDER BY t_idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE n = 5 GROUP BY ALL),
  pt AS (SELECT roi, ms, count(value) AS n, avg(value) AS mean, stddev_samp(value) / sqrt(count(value)) AS sem FROM sm GROUP BY ALL),
  fl AS (SELECT roi, avg(mean) AS b FROM pt WHERE ms BETWEEN 1 AND 5 GROUP BY roi),
  st AS (SELECT *, CASE WHEN ms > 5 AND n > 1 AND sem > 0 THEN (mean - b) / sem END AS t FROM pt JOIN fl USING (roi)),
  tb AS (SELECT *, CASE WHEN t IS NOT NULL THEN {t_sf_sql('t', '(n - 1)')} END AS p FROM st),
  qv AS (SELECT *, p * count(p) OVER (PARTITION BY roi) / row_number() OVER (PARTITION BY roi ORDER BY p NULLS LAST, ms) AS q FROM tb),
  fd AS (SELECT roi, ms, round(t, 6) AS t, round(CASE WHEN p IS NOT NULL THEN least(min(q) OVER (PARTITION BY roi ORDER BY p NULLS LAST, ms ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) END, 6) AS p_fdr FROM qv),
  isl AS (SELECT *, n - row_number() OVER (PARTITION BY roi ORDER BY ms) AS i FROM (SELECT *, row_number() OVER (PARTITION BY roi ORDER BY ms) AS n FROM fd) WHERE p_fdr < 0.2)"""


@query("flagship_significant_runs", V.EVENTS_SIGNALS, FLAG, 'SELECT roi, row_number() OVER (PARTITION BY roi ORDER BY min(ms))::INTEGER AS run, min(ms) AS start, max(ms) AS "end", count(*) AS n, round(max(t), 6) AS peak_t, round(min(p_fdr), 6) AS least_p FROM isl GROUP BY roi, i')
def flagship(spark, d):
    return rounded(group_stats.significant_runs(V.events_signals(spark, d)), "peak_t", "least_p")
