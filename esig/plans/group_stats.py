"""Compositions: per-region statistics, task-against-baseline tables and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import grid
from ..operators import condition, stats, windows


def roi_stats(df: DataFrame, mu: float, permutations: int = 1024, threshold: float | None = None, value: str = "value", t: str = "ms", roi: str = "roi", step: float = 0.5) -> DataFrame:
    """Everything per (roi, ms): mean, sem, t, p, p_bonf, p_fdr, p_cluster, tfce, p_tfce and the two corrected for the
    number of regions. ``df`` has one value per (subject, roi, ms). Clusters are cut at the upper 5 % point of Student's t
    for the region's own number of subjects unless ``threshold`` is given."""
    base = stats.fdr_bh(stats.bonferroni(stats.ttest(df, [roi, t], value, mu), [roi]), [roi], tie=t)
    centred = df.withColumn(value, F.col(value) - mu)
    clusters = stats.cluster_permutation(centred, [roi], threshold, permutations, value, t)
    inside = clusters.select(F.col(roi).alias("_r"), "start", "end", "mass", "p_cluster")
    out = base.join(inside, (F.col(roi) == F.col("_r")) & F.col(t).between(F.col("start"), F.col("end")), "left").drop("_r", "start", "end")
    scores = stats.tfce_permutation(centred, [roi], permutations, step, value, t)
    out = out.join(scores, [roi, t], "left")
    return stats.across_roi_bonferroni(stats.across_roi_bonferroni(out, "p_cluster", roi), "p_tfce", roi)


def run_stats(edges: DataFrame, keys: list[str], guard_ms: float = 0.0, base_ms: float = 100.0, cap: float | None = None, value: str = "gc", t: str = "ms") -> DataFrame:
    """Task against baseline of every directed edge: the baseline is the first ``base_ms`` of the window axis (after an
    edge guard), the task starts where it ends and stops at ``cap``. One row per (keys, time, test)."""
    lo, hi = edges.agg(F.min(t), F.max(t)).first()
    start = (lo or 0) + guard_ms
    base, task = (start, start + base_ms), (start + base_ms + 1e-9, cap if cap is not None else (hi or 0))
    out = []
    for test in ("t", "wilcoxon"):
        r = stats.task_vs_baseline(edges, keys, base, task, value, t, test=test)
        out.append(r.select(*keys, F.col(t).alias("window_ms"), F.lit(test).alias("test"), F.col("mean").alias("gc_mean"), F.col("sem").alias("gc_sem"), "baseline_mean", F.col("p").alias("pval"), "sig"))
    return out[0].unionByName(out[1])


def significant_runs(signals: DataFrame, win: int = 5, base: tuple[int, int] = (1, 5), alpha: float = 0.2) -> DataFrame:
    """The end-to-end slice: demean trials, sliding means, mean per subject, each task window against the baseline,
    false discovery rate per region, and the runs of windows under ``alpha`` with their strongest window."""
    means = windows.sliding_mean(condition.demean_trials(signals, ("subject", "epoch", "roi")), win, 1, ("subject", "epoch", "roi"))
    per_subject = means.groupBy("subject", "roi", F.col("t_idx").alias("ms")).agg(F.avg("mean").alias("value"))
    tests = stats.fdr_bh(stats.task_vs_baseline(per_subject, ["roi"], base, (base[1] + 1, 1 << 30)), ["roi"])
    tests = tests.withColumn("p_fdr", grid(F.col("p_fdr"))).withColumn("t", grid(F.col("t")))
    best = F.max(F.struct("t", -F.col("ms"))).alias("b")
    runs = windows.runs(tests, F.col("p_fdr") < alpha, ["roi"], "ms", best, F.min("p_fdr").alias("least_p"))
    return runs.select("roi", "run", "start", "end", "n", F.col("b.t").alias("peak_t"), "least_p")


def config_cluster_stats(df: DataFrame, keys: list[str], mu: float, threshold: float | None = None, permutations: int = 1024, value: str = "accuracy") -> DataFrame:
    """Per configuration: subjects, significant clusters, earliest onset and the peak of the mean; fewer than three
    subjects are not tested. Clusters are cut at the upper 5 % point of Student's t for the configuration's own number of
    subjects unless ``threshold`` is given."""
    n = df.groupBy(*keys).agg(F.countDistinct("subject").alias("n_subjects"))
    mean = df.groupBy(*keys, "ms").agg(grid(F.avg(value)).alias("mean"))
    peak = windows.first_peak(mean, "mean", keys)
    tested = df.join(n.where("n_subjects >= 3"), keys).withColumn(value, F.col(value) - mu)
    c = stats.cluster_permutation(tested, keys, threshold, permutations, value).where("p_cluster < 0.05")
    hits = c.groupBy(*keys).agg(F.count("*").alias("n_clusters"), F.min("start").alias("onset"))
    out = n.join(peak, keys).join(hits, keys, "left")
    return out.withColumn("n_clusters", F.when(F.col("n_subjects") >= 3, F.coalesce("n_clusters", F.lit(0))))
