"""Group aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import grid, t_sf
from .windows import average_rank, first_peak


def mean_sem(value: str, ddof: int = 1) -> list[Column]:
    sd = F.stddev_samp(value) if ddof else F.stddev_pop(value)
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), (sd / F.sqrt(F.count(value))).alias("sem")]


def group_mean_sem(df: DataFrame, keys: list[str], value: str = "value", ddof: int = 1) -> DataFrame:
    return df.groupBy(*keys).agg(*mean_sem(value, ddof))


def class_erp(df: DataFrame, x: str = "x", ddof: int = 0) -> DataFrame:
    """Per (roi, y, t_idx) mean and SEM over trials; vertices are averaged first."""
    return group_mean_sem(df.groupBy("subject", "roi", "y", "epoch", "t_idx").agg(F.avg(x).alias("value")), ["roi", "y", "t_idx"], "value", ddof)


def sensor_erp(df: DataFrame, x: str = "x") -> DataFrame:
    """Per (y, chan, t_idx) mean over trials, with the number of trials."""
    return df.groupBy("y", "chan", "t_idx").agg(F.avg(x).alias("mean"), F.countDistinct("epoch").alias("n_trials"))


def sweep_summary(df: DataFrame, keys: list[str], value: str = "accuracy", t: str = "ms") -> DataFrame:
    """Per subject and configuration: peak_acc, peak_ms (the first on ties), mean_acc."""
    best = F.min(F.struct((-F.col(value)).alias("v"), F.col(t).alias("t"))).alias("b")
    return df.groupBy(*keys).agg(best, F.avg(value).alias("mean_acc")).select(*keys, (-F.col("b.v")).alias("peak_acc"), F.col("b.t").alias("peak_ms"), "mean_acc")


def config_summary(summary: DataFrame, keys: list[str]) -> DataFrame:
    return summary.groupBy(*keys).agg(F.count("*").alias("n_subjects"), F.avg("peak_acc").alias("mean_peak"), F.stddev_samp("peak_acc").alias("std_peak"), F.avg("mean_acc").alias("mean_mean"))


def peak_heatmap(df: DataFrame, columns: list, row: str = "classifier", col: str = "sw_dur", value: str = "accuracy") -> DataFrame:
    """Mean over subjects of each subject's maximum, one column for each of ``columns``."""
    peak = df.groupBy("subject", row, col).agg(F.max(value).alias("p"))
    return peak.groupBy(row).pivot(col, columns).agg(F.avg("p"))


def complete_subjects(df: DataFrame, keys: list[str], t: str = "ms") -> DataFrame:
    """Rows of the subjects that have every time that occurs under the same keys."""
    have = df.groupBy(*keys, "subject").agg(F.countDistinct(t).alias("_n"))
    every = df.groupBy(*keys).agg(F.countDistinct(t).alias("_m"))
    full = have.join(every, keys).where("_n = _m").select(*keys, "subject")
    return df.join(full, [*keys, "subject"], "left_semi")


def at_group_peak(df: DataFrame, keys: list[str], value: str, t: str = "ms") -> DataFrame:
    """Rows at the time where the mean over all rows of the keys is largest (the first on ties)."""
    mean = df.groupBy(*keys, t).agg(grid(F.avg(value)).alias("_m"))
    peak = first_peak(mean, "_m", keys, t).select(*keys, F.col("peak_at").alias(t))
    return df.join(peak, [*keys, t], "left_semi")


def modal_choice(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, mode (the smallest on ties), k of n as text."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("k"))
    best = F.min(F.struct((-F.col("k")).alias("c"), F.col(value).alias("v"))).alias("b")
    out = counts.groupBy(*keys).agg(best, F.sum("k").alias("n"))
    return out.select(*keys, F.col("b.v").alias("mode"), F.concat((-F.col("b.c")).cast("string"), F.lit("/"), F.col("n").cast("string")).alias("support"))


def pooled_hyperparams(df: DataFrame, values: list[float], roi: str = "roi", value: str = "best_c") -> DataFrame:
    """Counts of each value per region, with a pooled row (region null), and the pooled row's share of each."""
    out = df.rollup(roi).agg(*[F.count(F.when(F.col(value) == v, 1)).alias(f"n_{i}") for i, v in enumerate(values)], F.count(value).alias("n"))
    return out.select(roi, *[f"n_{i}" for i in range(len(values))], "n", *[F.try_divide(100 * F.col(f"n_{i}"), F.col("n")).alias(f"pct_{i}") for i in range(len(values))])


def task_baseline_contrast(df: DataFrame, keys: list[str], base: tuple[float, float], task: tuple[float, float], value: str = "value", t: str = "ms") -> DataFrame:
    inside = lambda w: F.avg(F.when(F.col(t).between(*w), F.col(value)))
    out = df.groupBy(*keys).agg(inside(base).alias("base"), inside(task).alias("task"))
    return out.withColumn("diff", F.col("task") - F.col("base"))


def contrast_summary(contrast: DataFrame, keys: list[str], diff: str = "diff") -> DataFrame:
    """keys, n, mean, sem, n_positive, t, p (two-sided) of the subjects' differences; null differences don't count, and
    without spread or a second subject there is no test."""
    t = F.try_divide(F.avg(diff), F.stddev_samp(diff) / F.sqrt(F.count(diff)))
    out = contrast.where(F.col(diff).isNotNull()).groupBy(*keys).agg(*mean_sem(diff, 0), F.sum((F.col(diff) > 0).cast("long")).alias("n_positive"), t.alias("t"))
    return out.withColumn("p", 2 * t_sf(F.abs("t"), F.col("n") - 1))


def all_pairs_curve(df: DataFrame, pair: list[str], keys: list[str], value: str = "value", ddof: int = 1) -> DataFrame:
    """Mean over pairs within each subject first, then over subjects."""
    one = df.groupBy("subject", *keys).agg(F.avg(value).alias("value"))
    return group_mean_sem(one, keys, "value", ddof)


def config_compare(matched: DataFrame, keys: list[str]) -> DataFrame:
    """Per pair: mean forward, backward and net of both runs, SEM with ddof 0."""
    cols = []
    for s in ("a", "b"):
        net = F.col(f"fxy_{s}") - F.col(f"fyx_{s}")
        cols += [F.avg(f"fxy_{s}").alias(f"fwd_{s}"), F.avg(f"fyx_{s}").alias(f"rev_{s}"), F.avg(net).alias(f"net_{s}"), (F.stddev_pop(net) / F.sqrt(F.count(net))).alias(f"sem_{s}")]
    return matched.groupBy(*keys).agg(*cols)


def estimator_compare(df: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Pearson and Spearman correlation, slope of b on a and ratio of means; null with fewer than 3 points."""
    rows = df.select(*keys, a, b, average_rank(a, *keys).alias("_ra"), average_rank(b, *keys).alias("_rb"))
    few = lambda c: F.when(F.count("*") > 2, c)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), few(F.corr(a, b)).alias("pearson"), few(F.corr("_ra", "_rb")).alias("spearman"), few(F.regr_slope(b, a)).alias("slope"), F.try_divide(F.avg(b), F.avg(a)).alias("scale"))


def pipeline_agreement(df: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """From per-trial correlations: mean r, mean |r|, shares below 0 and of |r| under 0.9; and the normalised RMS error."""
    r = df.groupBy(*keys, "epoch").agg(F.corr(a, b).alias("r"))
    out = r.groupBy(*keys).agg(F.avg("r").alias("mean_r"), F.avg(F.abs("r")).alias("mean_abs_r"), F.avg((F.col("r") < 0).cast("double")).alias("share_negative"), F.avg((F.abs("r") < 0.9).cast("double")).alias("share_low"))
    err = df.groupBy(*keys).agg(F.try_divide(F.sqrt(F.avg(F.pow(F.col(a) - F.col(b), 2))), F.stddev_pop(a)).alias("nrmse"))
    return out.join(err, keys)


def edge_artifact_report(df: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    d = F.abs(F.col(a) - F.col(b))
    return df.groupBy(*keys).agg(F.avg(d).alias("mean_abs"), F.max(d).alias("max_abs"), F.percentile(d, 0.5).alias("median_abs"))


def group_washout(df: DataFrame, keys: list[str], base: tuple[float, float], task: tuple[float, float], above: float, value: str = "value", t: str = "ms") -> DataFrame:
    """Mean and median task-minus-baseline over subjects, and the share of subjects whose baseline exceeds ``above``."""
    c = task_baseline_contrast(df, ["subject", *keys], base, task, value, t)
    return c.groupBy(*keys).agg(F.avg("diff").alias("mean_diff"), F.percentile("diff", 0.5).alias("median_diff"), F.avg((F.col("base") > above).cast("double")).alias("share_above"))


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))


def config_decision(df: DataFrame, cell: list[str], reference: Column, keys: list[str], value: str = "net") -> DataFrame:
    """Per cell: group mean, and how many keys have the sign of the reference cell and how many flip."""
    mean = df.groupBy(*cell, *keys).agg(F.avg(value).alias("m"))
    ref = mean.where(reference).select(*keys, F.col("m").alias("r"))
    return mean.join(ref, keys).groupBy(*cell).agg(F.avg("m").alias("mean"), F.sum((F.signum("m") == F.signum("r")).cast("long")).alias("agree"), F.sum((F.signum("m") != F.signum("r")).cast("long")).alias("flips"))


def floor_ranking(df: DataFrame, value: str, key: str = "subject") -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.orderBy(value, key)))
