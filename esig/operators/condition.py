"""Signal conditioning on long tables."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .select import small
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType


def demean_trials(df: DataFrame, keys: tuple[str, ...] = ("epoch", "roi"), x: str = "x") -> DataFrame:
    """Subtract each trial's mean over time."""
    return df.withColumn(x, F.col(x) - F.avg(x).over(Window.partitionBy(*keys)))


def remove_erp(df: DataFrame, keys: tuple[str, ...] = ("subject", "roi", "t_idx", "y"), x: str = "x", scale: bool = False) -> DataFrame:
    """Subtract the mean over trials of the same label at each (channel, time); with ``scale`` divide by the population
    standard deviation as well (0 counts as 1). Means are aggregated before they are joined back, so that the shuffle
    carries partial sums instead of trials."""
    stats = df.groupBy(*keys).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    out = F.col(x) - F.col("_m")
    if scale:
        out = out / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    return df.join(stats, list(keys)).withColumn(x, out).drop("_m", "_s").select(*df.columns)


def average_reference(df: DataFrame, keys: tuple[str, ...] = ("epoch", "t_idx"), x: str = "x") -> DataFrame:
    """Subtract the mean over channels of each sample."""
    return demean_trials(df, keys, x)


def pseudo_channels(df: DataFrame, members: DataFrame, keys: tuple[str, ...] = ("subject", "epoch", "t_idx"), chan: str = "chan", x: str = "x") -> DataFrame:
    """Mean over the sensors of each group per trial and sample. ``members`` (roi, sensor) matches whatever the case."""
    m = members.select("roi", F.lower(F.col("sensor").cast("string")).alias("_s")).distinct()
    rows = df.drop("roi").withColumn("_s", F.lower(F.col(chan).cast("string"))).join(small(m), "_s")
    return rows.groupBy(*keys, "roi").agg(F.avg(x).alias(x))


def zscore(df: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """(x - mean) / population standard deviation within keys; a deviation of 0 counts as 1, NaN as missing."""
    w, clean = Window.partitionBy(*keys), F.when(~F.isnan(x), F.col(x))
    s = F.stddev_pop(clean).over(w)
    return df.withColumn(x, (F.col(x) - F.avg(clean).over(w)) / F.when(s > 0, s).otherwise(1.0))


def normalise_by_peak(df: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    peak = F.max(F.abs(x)).over(Window.partitionBy(*keys))
    return df.withColumn(x, F.when(peak > 0, F.col(x) / peak).otherwise(F.col(x)))


def add_matched_noise(df: DataFrame, r: float, keys: tuple[str, ...] = ("epoch", "roi"), x: str = "x", seed: int = 0) -> DataFrame:
    """Gaussian noise that leaves a correlation of ``r`` (kept within 0.5 to 0.99999) with the original. The draw depends
    on the keys and t_idx alone (Box-Muller on hashes), so a task that runs again draws the same."""
    r = min(max(r, 0.5), 0.99999)
    u = lambda s: (F.pmod(F.xxhash64(F.lit(seed), F.lit(s), *keys, "t_idx"), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    noise = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(2))
    sd = F.stddev_pop(x).over(Window.partitionBy(*keys))
    return df.withColumn(x, F.col(x) + noise * sd * math.sqrt(1 / r**2 - 1))


def resample_taps(up: int, down: int) -> list[tuple[int, float]]:
    """(offset, weight) of the anti-alias filter: 2 * 10 * max(up, down) + 1 taps of a Kaiser (beta 5) windowed sinc."""
    half, cut = 10 * max(up, down), 1 / max(up, down)
    k = np.arange(-half, half + 1)
    h = cut * np.sinc(cut * k) * np.i0(5 * np.sqrt(1 - (k / half) ** 2)) / np.i0(5.0)
    return [(int(i), float(v)) for i, v in zip(k, h * up / h.sum(), strict=True)]


def resample(df: DataFrame, rate: float, target: float, keys: tuple[str, ...] = ("epoch", "roi"), pad: str = "reflect") -> DataFrame:
    """keys, t_idx, x at the new rate; unchanged if the rates are within 1 Hz. ``df`` has t_idx from 0 without gaps.

    Output sample j stands at input position j * down / up. It is the sum over taps of the reflected input (``reflect``;
    ``zero`` leaves the outside at 0). Series are cut into stretches of samples, each with as many of its neighbours' as the
    filter is wide, so that a long series spreads over tasks; a stretch is filtered phase by phase, by one product of a
    matrix of its samples and the taps of the phase. Null samples count as 0.
    """
    if abs(rate - target) <= 1:
        return df.select(*keys, "t_idx", "x")
    ratio = Fraction(target).limit_denominator(10**6) / Fraction(rate).limit_denominator(10**6)
    up, down = ratio.numerator, ratio.denominator
    halo = -(-10 * max(up, down) // up) + 1
    length = max(STRETCH, 20 * halo)
    packed = in_stretches(df, keys, length, halo).groupBy(*keys, "stretch").agg(F.collect_list(F.struct("t_idx", "x")).alias("p"))
    packed = packed.select(*keys, "stretch", F.col("p.t_idx").alias("t"), F.col("p.x").alias("x"))
    phases = [[] for _ in range(up)]
    for k, h in resample_taps(up, down):
        phases[k % up].append((k, h))
    taps = [(np.array([k for k, _ in p]), np.array([h for _, h in p])) for p in phases]
    schema = StructType([*(df.schema[c] for c in keys), StructField("t_idx", IntegerType()), StructField("x", DoubleType())])
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, places, values = [], [], []
            for r in range(b.num_rows):
                start = b.column(width)[r].as_py() * length
                t = b.column(width + 1)[r].values.to_numpy()
                low = int(t.min())
                line = np.zeros(int(t.max()) - low + 1)
                line[t - low] = b.column(width + 2)[r].values.cast(pa.float64()).fill_null(0.0).to_numpy()
                end = low + len(line)  # of the series, if this is its last stretch or the halo reaches it
                stop = min(start + length, end)
                j = np.arange(-(-start * up // down), -(-stop * up // down))
                out = np.zeros(len(j))
                for phase in np.unique(j * down % up):
                    at = np.flatnonzero(j * down % up == phase)
                    k, h = taps[phase]
                    i = (j[at] * down)[:, None] - k
                    i //= up
                    inside = (i >= 0) & (i < end)
                    if pad == "reflect":
                        cycle = np.mod(i, max(2 * (end - 1), 1))
                        i = np.where(inside, i, np.where(cycle <= end - 1, cycle, 2 * (end - 1) - cycle) if end > 1 else 0)
                    else:
                        h = np.where(inside, h, 0.0)
                    x = line[np.clip(i - low, 0, len(line) - 1)]
                    out[at] = (x * h).sum(axis=1)
                row.append(np.full(len(j), r))
                places.append(j)
                values.append(out)
            if row:
                rest = b.select(list(range(width))).take(pa.array(np.concatenate(row)))
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(values))], names=schema.names)

    return packed.mapInArrow(run, schema)


#: Samples of a stretch of a series at least.
STRETCH = 4096


def in_stretches(df: DataFrame, keys: tuple[str, ...], length: int, halo: int) -> DataFrame:
    """keys, t_idx, x and the stretch that a sample is for: its own, and a neighbour's if it lies within ``halo`` of it."""
    own = F.floor(F.col("t_idx") / length).cast("int")
    before = F.when((own > 0) & (F.col("t_idx") - own * length < halo), own - 1)
    after = F.when((own + 1) * length - F.col("t_idx") <= halo, own + 1)
    every = F.explode(F.filter(F.array(own, before, after), lambda s: s.isNotNull()))
    rows = df.select(*keys, F.col("t_idx").cast("int").alias("t_idx"), F.col("x").cast("double").alias("x"), every.alias("stretch"))
    return rows
