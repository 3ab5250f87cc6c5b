"""Window operators over samples and curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .select import crop_time


def sample_window(ms: float, rate: float, least: int = 1) -> int:
    """Whole samples of a duration, half-even, at least ``least``."""
    return max(least, round(ms / 1000 * rate))


def sliding_mean(df: DataFrame, win: int, step: int = 1, keys: tuple[str, ...] = ("epoch", "roi"), x: str = "x", t: str = "t_idx") -> DataFrame:
    """keys, w (window number), t (its first sample), mean of every full window of ``win`` samples."""
    over = Window.partitionBy(*keys)
    frame = over.orderBy(t).rowsBetween(0, win - 1)
    first = F.min(t).over(over)
    rows = df.select("*", F.avg(x).over(frame).alias("mean"), F.count(x).over(frame).alias("_n"), (F.col(t) - first).alias("_at"))
    rows = rows.where((F.col("_n") == win) & (F.col("_at") % step == 0))
    return rows.select(*keys, F.floor(F.col("_at") / step).cast("int").alias("w"), F.col(t), "mean")


def prepare_windowed(df: DataFrame, tmin: float, tmax: float, rate: float, sw_ms: float, step_ms: float, keys: tuple[str, ...] = ("subject", "roi", "epoch", "y"), feature: str = "vertex") -> DataFrame:
    """keys, w, ms_start, ms_center and the features of every window, ordered by vertex. ``df`` has t_s."""
    win, step = sample_window(sw_ms, rate), sample_window(step_ms, rate)
    rows = crop_time(df, tmin, tmax, keys=(*keys, feature))
    w = sliding_mean(rows, win, step, (*keys, feature))
    packed = w.groupBy(*keys, "w", "t_idx").agg(F.array_sort(F.collect_list(F.struct(feature, "mean"))).alias("f"))
    start = tmin * 1000 + F.col("t_idx") * 1000.0 / rate
    return packed.select(*keys, "w", start.alias("ms_start"), (start + (win - 1) * 500.0 / rate).alias("ms_center"), F.col("f.mean").alias("features"))


def moving_windows(df: DataFrame, win: int, step: int, keys: tuple[str, ...] = ("subject",), t: str = "t_idx") -> DataFrame:
    """keys, start of every window of max(2, win) samples that fits between the first and last sample."""
    win = max(2, win)
    span = df.groupBy(*keys).agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    return span.where(F.col("hi") - F.col("lo") + 1 >= win).select(*keys, F.explode(F.sequence("lo", F.col("hi") - win + 1, F.lit(step))).alias("start"))


def runs(df: DataFrame, flag: Column, keys: list[str], t: str = "ms", *more: Column) -> DataFrame:
    """Maximal runs of rows that follow each other in t and all satisfy ``flag``: keys, run, start, end, n and ``more``."""
    w = Window.partitionBy(*keys).orderBy(t)
    marked = df.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_n", F.row_number().over(w))
    on = marked.where("_f").withColumn("_island", F.col("_n") - F.row_number().over(w))
    out = on.groupBy(*keys, "_island").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("n"), *more)
    return out.withColumn("run", F.row_number().over(Window.partitionBy(*keys).orderBy("start"))).drop("_island")


def run_report(df: DataFrame, flag: Column, value: str, keys: list[str], t: str = "ms") -> DataFrame:
    """Runs with their peak and its earliest time, the first onset and the global peak of the series."""
    best = F.min(F.struct((-F.col(value)).alias("col1"), F.col(t))).alias("_p")
    out = runs(df, flag, keys, t, best).select(*keys, "run", "start", "end", (-F.col("_p.col1")).alias("peak"), F.col(f"_p.{t}").alias("peak_at"), F.min("start").over(Window.partitionBy(*keys)).alias("onset"))
    return out.join(df.groupBy(*keys).agg(F.max(value).alias("global_peak")), keys)


def edge_windows(df: DataFrame, k: int, value: str, keys: list[str], t: str = "ms") -> DataFrame:
    """keys, edge_mean over the first and last k windows, and at_edge: whether the first maximum lies there."""
    w = Window.partitionBy(*keys)
    rows = df.select("*", F.row_number().over(w.orderBy(t)).alias("_a"), F.row_number().over(w.orderBy(F.desc(t))).alias("_z"))
    rows = rows.withColumn("_e", (F.col("_a") <= k) | (F.col("_z") <= k))
    top = F.min(F.struct(-F.col(value), F.col(t), F.col("_e"))).alias("_m")
    return rows.groupBy(*keys).agg(F.avg(F.when(F.col("_e"), F.col(value))).alias("edge_mean"), top).select(*keys, "edge_mean", F.col("_m._e").alias("at_edge"))


def center_labels(df: DataFrame, win_ms: float, start: str = "ms_start") -> DataFrame:
    return df.withColumn("ms_center", F.col(start) + win_ms / 2)


def average_rank(value: Column | str, *keys: str) -> Column:
    """Ranks within keys; ties share their mean rank."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2


def first_peak(df: DataFrame, value: str, keys: list[str], t: str = "ms") -> DataFrame:
    """keys, peak, peak_at: the largest value and the earliest time that has it."""
    best = F.min(F.struct((-F.col(value)).alias("v"), F.col(t).alias("t"))).alias("b")
    return df.groupBy(*keys).agg(best).select(*keys, (-F.col("b.v")).alias("peak"), F.col("b.t").alias("peak_at"))
