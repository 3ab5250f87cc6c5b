"""Compositions of whole runs: connectivity per subject or sensor group, order and window sweeps, pair diagnosis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import condition, spatial, spectral
from ..operators import connectivity as G
from ..sources.signals import staged


def pack(df: DataFrame, chan: str = "roi") -> DataFrame:
    """Long signals to one row per trial: subject, epoch, chans and xs, both in order."""
    one = df.groupBy("subject", "epoch", chan).agg(F.array_sort(F.collect_list(F.struct("t_idx", "x"))).alias("s")).select("subject", "epoch", F.col(chan).alias("c"), F.col("s.x").alias("x"))
    return one.groupBy("subject", "epoch").agg(F.array_sort(F.collect_list(F.struct("c", "x"))).alias("p")).select("subject", "epoch", F.col("p.c").alias("chans"), F.col("p.x").alias("xs"))


def unpack(packed: DataFrame, chan: str = "roi") -> DataFrame:
    rows = packed.select("subject", "epoch", F.posexplode("xs").alias("i", "v"), "chans")
    return rows.select("subject", "epoch", F.get("chans", F.col("i")).alias(chan), F.posexplode("v").alias("t_idx", "x"))


def subject_gc(signals: DataFrame, win: int, step: int, order: int, freqs: list[float], rate: float, bands: DataFrame, normalise: str = "demean", mode: str = "pairwise", target_rate: float | None = None) -> DataFrame:
    """subject, src, tgt, band, start, gc, dtrgc: regions reduced to their first component (where there are vertices),
    resampled, trials demeaned, the event-related mean removed within labels, then GC on moving windows in bands.

    ``mode`` is pairwise or conditional; both have the same columns, dtrgc null for conditional. Trials are read
    once, into lag products, which are written out and serve the forward and the time-reversed fit in one pass.
    """
    keys = ("subject", "epoch", "y", "roi")
    if "vertex" in signals.columns:
        w = spatial.top_pcs(signals, 1)
        signals = spatial.apply_filter(signals, w, more=("epoch", "y", "t_idx")).drop("pc")
    if target_rate:
        signals, rate = condition.resample(signals, rate, target_rate, keys), target_rate
    signals = condition.demean_trials(signals, ("subject", "epoch", "roi"))
    if normalise != "none":
        signals = condition.remove_erp(signals, scale=normalise == "zscore")
    c = staged(G.packed_lag_products(pack(signals), order), "lag-products")
    if mode == "conditional":
        f = G.statespace_gc(c, win, step, order, freqs, rate).where("status = 'ok'")
        out = spectral.band_average(f, bands, ["subject", "src", "tgt", "start"], ["f"])
        return out.select("subject", "src", "tgt", "band", "start", F.col("f").alias("gc"), F.lit(None).cast("double").alias("dtrgc"))
    d = G.moving_window_trgc(c, win, step, order, freqs, rate)
    b = staged(spectral.band_average(d, bands, ["subject", "src", "tgt", "start"], ["f_xy", "f_yx", "d_xy", "d_yx"]), "band-gc")
    one = b.select("subject", "src", "tgt", "band", "start", F.col("f_xy").alias("gc"), F.col("d_xy").alias("dtrgc"))
    two = b.select("subject", F.col("tgt").alias("src"), F.col("src").alias("tgt"), "band", "start", F.col("f_yx").alias("gc"), F.col("d_yx").alias("dtrgc"))
    return one.unionByName(two)


def sensor_gc(sensors: DataFrame, members: DataFrame, **params) -> DataFrame:
    """``subject_gc`` on pseudo-channels, the means of sensor groups."""
    return subject_gc(condition.pseudo_channels(sensors, members, ("subject", "epoch", "y", "t_idx")), **params)


def order_window_sweep(c: DataFrame, cells: list[tuple[int, int]], step: int, freqs: list[float], rate: float, length: int) -> DataFrame:
    """Net GC per (win, order) cell, averaged over frequencies; cells with win <= order + 1 or longer than the data are
    left out. All cells share the lag products and one pass over them, and all orders of a window length one recursion. No
    rows if no cell is left."""
    by_win: dict[int, list[int]] = {}
    for win, order in cells:
        if order + 1 < win <= length and order not in by_win.setdefault(win, []):
            by_win[win].append(order)
    by_win = {win: orders for win, orders in by_win.items() if orders}
    if not by_win:
        return c.sparkSession.createDataFrame([], "subject bigint, src string, tgt string, start int, net double, win int, p int")
    g = G.moving_window_orders(c, by_win, step, freqs, rate).where("status = 'ok'")
    return g.groupBy("subject", "src", "tgt", "start", "win", "p").agg(F.avg(F.col("f_xy") - F.col("f_yx")).alias("net")).select("subject", "src", "tgt", "start", "net", "win", "p")


def pair_diagnosis(signals: DataFrame, a: str, b: str, base: tuple[int, int], task: tuple[int, int], rate: float, max_lag: int) -> DataFrame:
    """Per subject: power ratios of both channels, coherence in both windows, and how alike their lag curves are."""
    power = spectral.power_ratio(signals.where(F.col("roi").isin(a, b)), ["subject", "roi"], base, task).groupBy("subject").pivot("roi", [a, b]).agg(F.first("power_ratio")).withColumnsRenamed({a: "power_a", b: "power_b"})
    cut = {k: signals.where(F.col("t_idx").between(*w)) for k, w in (("base", base), ("task", task))}
    coh = [spectral.coherence(cut[k], a, b, rate, w[1] - w[0] + 1).groupBy("subject").agg(F.avg("coh").alias(f"coh_{k}")) for k, w in (("base", base), ("task", task))]
    ccf = spectral.ccf_similarity(*(spectral.ensemble_ccf(cut[k], max_lag, a, b) for k in ("base", "task")), ["subject"])
    return reduce(lambda x, y: x.join(y, "subject"), [power, *coh, ccf])


def method_compare(vertices: DataFrame) -> DataFrame:
    """Per (subject, roi): correlation of the mean, sign-flipped mean and strongest-vertex series with the first component."""
    w = spatial.top_pcs(vertices, 1)
    pc = spatial.apply_filter(vertices, w).drop("pc").withColumnRenamed("x", "pc")
    other = spatial.aggregate_variants(vertices)
    flip = spatial.mean_flip(vertices, w).withColumnRenamed("x", "flip")
    keys = ["subject", "roi", "epoch", "t_idx"]
    rows = pc.join(other, keys).join(flip, keys)
    return rows.groupBy("subject", "roi").agg(*[F.corr("pc", c).alias(f"r_{c}") for c in ("mean", "flip", "maxpower")])
