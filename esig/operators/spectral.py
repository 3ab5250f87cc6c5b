"""Frequency and lag descriptors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The reference bands, half-open but for the last.
BANDS = (("theta", 4.0, 8.0, False), ("alpha", 8.0, 12.0, False), ("low_beta", 12.0, 18.0, False), ("high_beta", 18.0, 30.0, True))


def bands_table(spark, bands=BANDS) -> DataFrame:
    return spark.createDataFrame(list(bands), "band string, lo double, hi double, hi_closed boolean")


def band_average(df: DataFrame, bands: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, band and the mean of each value over the band's frequencies; a band without any gives null.

    Bands are a small table, and frequencies fall into few of them: each row meets its bands in a broadcast join.
    """
    inside = (F.col("freq") >= F.col("lo")) & ((F.col("freq") < F.col("hi")) | (F.col("hi_closed") & (F.col("freq") == F.col("hi"))))
    got = df.join(F.broadcast(bands), inside).groupBy(*keys, "band").agg(*[F.avg(v).alias(v) for v in values])
    every = df.select(*keys).distinct().withColumn("band", F.explode(F.array(*[F.lit(r["band"]) for r in bands.select("band").collect()])))
    return every.join(got, [*keys, "band"], "left")


def freq_grid(spark, lo: float, hi: float, step: float) -> DataFrame:
    """lo, lo + step, ... up to hi."""
    n = int(math.floor((hi - lo) / step + 0.5)) + 1
    return spark.range(n).select((lo + F.col("id") * step).alias("freq"))


def ensemble_ccf(df: DataFrame, max_lag: int, a: str, b: str, chan: str = "roi", keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    """keys, lag, r: mean over trials of the mean over t of a(t) b(t + lag), both normalised within the trial; positive
    lags mean that a leads."""
    w = Window.partitionBy(*keys, "epoch", chan)
    z = df.where(F.col(chan).isin(a, b)).select(*keys, "epoch", chan, "t_idx", ((F.col("x") - F.avg("x").over(w)) / (F.stddev_pop("x").over(w) + 1e-20)).alias("z"))
    one = z.where(F.col(chan) == a).select(*keys, "epoch", "t_idx", F.col("z").alias("za"), F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag")).withColumn("u", F.col("t_idx") + F.col("lag"))
    two = z.where(F.col(chan) == b).select(*keys, "epoch", F.col("t_idx").alias("u"), F.col("z").alias("zb"))
    trial = one.join(two, [*keys, "epoch", "u"]).groupBy(*keys, "epoch", "lag").agg(F.avg(F.col("za") * F.col("zb")).alias("r"))
    return trial.groupBy(*keys, "lag").agg(F.avg("r").alias("r"))


def coherence(df: DataFrame, a: str, b: str, rate: float, n: int, chan: str = "roi", keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    """keys, freq, coh over trials of n samples (t_idx from its first): Hann taper and DFT by a join with the angles.

    Null for fewer than 8 samples.
    """
    first = F.min("t_idx").over(Window.partitionBy(*keys, "epoch", chan))
    rows = df.where(F.col(chan).isin(a, b)).select(*keys, "epoch", chan, (F.col("t_idx") - first).alias("i"), "x")
    taper = 0.5 - 0.5 * F.cos(2 * math.pi * F.col("i") / (n - 1))
    rows = rows.select(*keys, "epoch", chan, "i", (F.col("x") * taper).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(n // 2))).alias("f"))
    angle = 2 * math.pi * F.col("f") * F.col("i") / n
    side = lambda c, fn: F.sum(F.when(F.col(chan) == c, F.col("x") * fn(angle)))
    dft = rows.groupBy(*keys, "epoch", "f").agg(side(a, F.cos).alias("ar"), (-side(a, F.sin)).alias("ai"), side(b, F.cos).alias("br"), (-side(b, F.sin)).alias("bi"))
    m = dft.groupBy(*keys, "f").agg(F.avg(F.col("ar") * F.col("br") + F.col("ai") * F.col("bi")).alias("re"), F.avg(F.col("ai") * F.col("br") - F.col("ar") * F.col("bi")).alias("im"), F.avg(F.col("ar") * F.col("ar") + F.col("ai") * F.col("ai")).alias("sa"), F.avg(F.col("br") * F.col("br") + F.col("bi") * F.col("bi")).alias("sb"))
    coh = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("sa") * F.col("sb") + 1e-30)
    return m.select(*keys, (F.col("f") * rate / n).alias("freq"), F.when(F.lit(n >= 8), coh).alias("coh"))


def power_ratio(df: DataFrame, keys: list[str], base: tuple[int, int], task: tuple[int, int]) -> DataFrame:
    """keys, power_ratio (mean squares) and var_ratio of task over baseline samples."""
    inside = lambda w: F.when(F.col("t_idx").between(*w), F.col("x"))
    sq = lambda w: F.avg(inside(w) * inside(w))
    return df.groupBy(*keys).agg(F.try_divide(sq(task), sq(base)).alias("power_ratio"), F.try_divide(F.var_pop(inside(task)), F.var_pop(inside(base))).alias("var_ratio"))


def ccf_similarity(base: DataFrame, task: DataFrame, keys: list[str]) -> DataFrame:
    """keys, similarity (correlation over lags) and the lag of the largest magnitude in each (the smallest on ties)."""
    both = base.select(*keys, "lag", F.col("r").alias("rb")).join(task.select(*keys, "lag", F.col("r").alias("rt")), [*keys, "lag"])
    peak = lambda c: F.min(F.struct(-F.round(F.abs(c), 9), "lag"))["lag"]
    return both.groupBy(*keys).agg(F.corr("rb", "rt").alias("similarity"), peak("rb").alias("peak_base"), peak("rt").alias("peak_task"))


def coupling(df: DataFrame, a: str, b: str, keys: list[str], lo: int, hi: int, chan: str = "roi") -> DataFrame:
    """keys, r: correlation of two channels pooled over trials and the samples lo to hi."""
    rows = df.where(F.col("t_idx").between(lo, hi)).groupBy(*keys, "epoch", "t_idx").agg(F.max(F.when(F.col(chan) == a, F.col("x"))).alias("a"), F.max(F.when(F.col(chan) == b, F.col("x"))).alias("b"))
    return rows.groupBy(*keys).agg(F.corr("a", "b").alias("r"))
