"""Directed connectivity from trial-summed lag products.

Every fit needs the trials only through C(a, b) = sum over trials of x(a) x(b) with |a - b| up to the order, so one
aggregation over trials serves every window, order, pair and the time-reversed fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..leaf import mvar, statespace

PAIR = "subject bigint, src string, tgt string, start int, freq double, f_xy double, f_yx double, status string"


#: Values that a task turns into dense arrays at a time, and sums that it holds before it passes them on.
DENSE_VALUES, HELD_SUMS = 4_000_000, 8_000_000
#: Samples of a stretch of time; sums are kept by stretch, so that they follow the data and not the span of its times.
STRETCH = 1024


def lag_products(df: DataFrame, max_lag: int, keys: tuple[str, ...] = ("subject",), chan: str = "roi", x: str = "x") -> DataFrame:
    """keys, ci, cj, a, lag, c, n: sums over trials of x_ci(a) x_cj(a + lag) for 0 <= lag <= max_lag.

    Samples are brought together trial by trial, in one exchange, and multiplied in blocks of trials inside the tasks;
    missing samples count in neither c nor n.
    """
    trial = F.collect_list(F.struct(F.col(chan).alias("c"), F.col("t_idx").cast("int").alias("t"), F.col(x).cast("double").alias("x"))).alias("p")
    packed = df.where(F.col(x).isNotNull()).groupBy(*keys, "epoch").agg(trial).select(*keys, "p.c", "p.t", "p.x")
    return _summed(packed, max_lag, keys)


def packed_lag_products(packed: DataFrame, max_lag: int, keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    """The same from one row per trial with ``chans`` (array of string) and ``xs`` (array of arrays of double), times from 0.

    Trials are never shuffled.
    """
    series = F.transform("xs", lambda v, i: F.transform(v, lambda x, t: F.struct(F.get(F.col("chans"), i).alias("c"), t.alias("t"), x.cast("double").alias("x"))))
    return _summed(packed.select(*keys, F.flatten(series).alias("p")).select(*keys, "p.c", "p.t", "p.x"), max_lag, keys)


def _summed(trials: DataFrame, max_lag: int, keys: tuple[str, ...]) -> DataFrame:
    """Lag products of trials (keys, c, t, x as arrays side by side): tasks add up dense blocks, Spark adds up tasks."""
    kinds = dict(trials.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", ci string, cj string, a int, lag int, c double, n bigint"
    width = len(keys)

    def tell(sums: dict, types: list) -> Iterator[pa.RecordBatch]:
        for (key, chans, t0), (c, n) in sums.items():
            lag, a, i, j = np.nonzero(n)
            names = np.array(chans, dtype=object)
            head = [pa.array([k] * len(a), type=t) for k, t in zip(key, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*head, pa.array(names[i], pa.string()), pa.array(names[j], pa.string()), pa.array((a + t0).astype(np.int32)), pa.array(lag.astype(np.int32)), pa.array(c[lag, a, i, j]), pa.array(n[lag, a, i, j])], names=[*keys, "ci", "cj", "a", "lag", "c", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, sums, held = [], {}, 0
        for batch in batches:
            types = [batch.schema.field(i).type for i in range(width)]
            length = np.array([len(v) if v is not None else 0 for v in batch.column(width + 2)], dtype=np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(length) // DENSE_VALUES)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part, size = batch.slice(lo, hi - lo), length[lo:hi]
                own = pd.MultiIndex.from_arrays([part.column(i).to_pylist() for i in range(width)]) if width > 1 else pd.Index(part.column(0).to_pylist())
                codes, found = pd.factorize(own)
                row = np.repeat(np.arange(part.num_rows), size)
                c, chans = pd.factorize(part.column(width).flatten().to_numpy(zero_copy_only=False), sort=True)
                t, x = (part.column(width + k).flatten().to_numpy(zero_copy_only=False) for k in (1, 2))
                for k, key in enumerate(found):
                    at = np.flatnonzero(codes[row] == k)
                    if not len(at):
                        continue
                    used, ci = np.unique(c[at], return_inverse=True)
                    place, ri = np.unique(row[at], return_inverse=True)
                    when, values = t[at], x[at]
                    for stretch in np.unique(when // STRETCH):
                        t0 = int(stretch) * STRETCH
                        live = (when >= t0) & (when < t0 + STRETCH + max_lag)
                        first, last = int(when[live].min()), int(when[live].max())
                        near = min(last, t0 + STRETCH - 1) - first + 1  # samples that begin a product
                        dense = np.full((last - first + 1, len(used), len(place)), np.nan)
                        dense[when[live] - first, ci[live], ri[live]] = values[live]
                        name = (key if width > 1 else (key,), tuple(chans[used]), first)
                        shape = (max_lag + 1, near, len(used), len(used))
                        if name not in sums or sums[name][0].shape != shape:
                            if name in sums:
                                held -= 2 * sums[name][0].size
                                yield from tell({name: sums.pop(name)}, types)
                            sums[name] = (np.zeros(shape), np.zeros(shape, np.int64))
                            held += 2 * sums[name][0].size
                        full = not np.isnan(dense).any()
                        there = None if full else (~np.isnan(dense)).astype(np.float64)
                        dense = dense if full else np.nan_to_num(dense, nan=0.0)
                        for lag in range(min(max_lag, len(dense) - 1) + 1):
                            n = min(near, len(dense) - lag)
                            sums[name][0][lag, :n] += dense[:n] @ dense[lag : lag + n].swapaxes(1, 2)
                            sums[name][1][lag, :n] += len(place) if full else (there[:n] @ there[lag : lag + n].swapaxes(1, 2)).round().astype(np.int64)
                        if held > HELD_SUMS:
                            yield from tell(sums, types)
                            sums, held = {}, 0
                if held > HELD_SUMS:
                    yield from tell(sums, types)
                    sums, held = {}, 0
        yield from tell(sums, types)

    return trials.mapInArrow(run, schema).groupBy(*keys, "ci", "cj", "a", "lag").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def by_pair(c: DataFrame, keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    """Lag products with src < tgt, once for each pair that holds both of their channels: a product of two channels has one
    pair, one of a channel with itself those with every other channel."""
    names = c.groupBy(*keys).agg(F.sort_array(F.collect_set("ci")).alias("_names"))
    pair = lambda o: F.struct(F.least("ci", o).alias("src"), F.greatest("ci", o).alias("tgt"))
    pairs = F.when(F.col("ci") != F.col("cj"), F.array(pair(F.col("cj")))).otherwise(F.transform(F.filter("_names", lambda o: o != F.col("ci")), pair))
    return c.join(names, list(keys)).withColumn("_p", F.explode(pairs)).select(*c.columns, "_p.src", "_p.tgt")


def lag_means(df: DataFrame, keys: tuple[str, ...] = ("subject",), chan: str = "roi") -> DataFrame:
    return df.groupBy(*keys, F.col(chan).alias("ci"), F.col("t_idx").alias("a")).agg(F.avg("x").alias("mu"), F.count("*").alias("n"))


def fit_var_ols(c: DataFrame, keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    """Order-1 least-squares VAR of every channel pair src < tgt, in closed form from lag products.

    keys, src, tgt, a11..a22 (x(t) = A x(t-1) + e), s11, s12, s22 (residual covariance); null where the lag products are singular.
    """
    later = F.col("lag") == 1
    pair = lambda i, j, on: F.sum(F.when((F.col("ci") == F.col(i)) & (F.col("cj") == F.col(j)) & on, F.col("c")))
    span = c.groupBy(*keys).agg(F.min("a").alias("t0"), F.max(F.col("a") + F.col("lag")).alias("t1"))
    rows = by_pair(c, keys).join(span, list(keys))
    early, late = (F.col("lag") == 0) & (F.col("a") < F.col("t1")), (F.col("lag") == 0) & (F.col("a") > F.col("t0"))
    m = rows.groupBy(*keys, "src", "tgt").agg(
        *[pair(i, j, early).alias(f"p{k}") for i, j, k in (("src", "src", 11), ("src", "tgt", 12), ("tgt", "tgt", 22))],
        *[pair(i, j, late).alias(f"q{k}") for i, j, k in (("src", "src", 11), ("src", "tgt", 12), ("tgt", "tgt", 22))],
        *[pair(i, j, later).alias(f"r{k}") for i, j, k in (("src", "src", 11), ("tgt", "src", 12), ("src", "tgt", 21), ("tgt", "tgt", 22))],
        F.sum(F.when((F.col("ci") == F.col("src")) & (F.col("cj") == F.col("src")) & later, F.col("n"))).alias("n"),
    )
    # r[i][j] = sum x_i(t) x_j(t-1): the later channel first, so ci is the earlier sample.
    det = F.col("p11") * F.col("p22") - F.col("p12") * F.col("p12")
    a = {f"{i}{j}": F.try_divide(v, det) for i in (1, 2) for j, v in ((1, F.col(f"r{i}1") * F.col("p22") - F.col(f"r{i}2") * F.col("p12")), (2, F.col(f"r{i}2") * F.col("p11") - F.col(f"r{i}1") * F.col("p12")))}
    s = {k: F.try_divide(F.col(f"q{k}") - a[f"{k[0]}1"] * F.col(f"r{k[1]}1") - a[f"{k[0]}2"] * F.col(f"r{k[1]}2"), F.col("n")) for k in ("11", "12", "22")}
    return m.select(*keys, "src", "tgt", *[v.alias(f"a{k}") for k, v in a.items()], *[v.alias(f"s{k}") for k, v in s.items()])


def transfer(model: DataFrame, freqs: DataFrame, rate: float) -> DataFrame:
    """Order-1 models x frequencies: real and imaginary parts of H = (I - A e^{-i w})^-1."""
    w = 2 * math.pi * F.col("freq") / rate
    rows = model.join(F.broadcast(freqs)).withColumn("_c", F.cos(w)).withColumn("_s", F.sin(w))
    re = {k: (F.lit(1.0 if k in ("11", "22") else 0.0) - F.col(f"a{k}") * F.col("_c")) for k in ("11", "12", "21", "22")}
    im = {k: F.col(f"a{k}") * F.col("_s") for k in re}
    det_re = re["11"] * re["22"] - im["11"] * im["22"] - (re["12"] * re["21"] - im["12"] * im["21"])
    det_im = re["11"] * im["22"] + im["11"] * re["22"] - (re["12"] * im["21"] + im["12"] * re["21"])
    rows = rows.select("*", *[v.alias(f"_re{k}") for k, v in re.items()], *[v.alias(f"_im{k}") for k, v in im.items()], det_re.alias("_dr"), det_im.alias("_di"))
    size = F.col("_dr") * F.col("_dr") + F.col("_di") * F.col("_di")
    place = {"11": ("22", 1), "12": ("12", -1), "21": ("21", -1), "22": ("11", 1)}
    out = []
    for k, (p, sign) in place.items():
        r, i = sign * F.col(f"_re{p}"), sign * F.col(f"_im{p}")
        out += [F.try_divide(r * F.col("_dr") + i * F.col("_di"), size).alias(f"h{k}_re"), F.try_divide(i * F.col("_dr") - r * F.col("_di"), size).alias(f"h{k}_im")]
    return rows.select(*[c for c in rows.columns if not c.startswith("_")], *out)


def spectrum(h: DataFrame) -> DataFrame:
    """Adds the auto-spectra p11, p22 and the cross-spectrum p12 of S = H Sigma H*."""
    return h.select("*", *[v.alias(k) for k, v in _spectra().items()])


def _spectra() -> dict[str, Column]:
    c = F.col

    def times(i: str, j: str, part: str) -> Column:
        """Part of h_i * conj(h_j)."""
        if part == "re":
            return c(f"h{i}_re") * c(f"h{j}_re") + c(f"h{i}_im") * c(f"h{j}_im")
        return c(f"h{i}_im") * c(f"h{j}_re") - c(f"h{i}_re") * c(f"h{j}_im")

    auto = lambda a, b: c("s11") * times(a, a, "re") + 2 * c("s12") * times(a, b, "re") + c("s22") * times(b, b, "re")
    cross = lambda part: c("s11") * times("11", "21", part) + c("s12") * (times("11", "22", part) + times("12", "21", part)) + c("s22") * times("12", "22", part)
    return {"p11": auto("11", "12"), "p22": auto("21", "22"), "p12_re": cross("re"), "p12_im": cross("im")}


def pairwise_gc(h: DataFrame) -> DataFrame:
    """Adds f_xy (src -> tgt) and f_yx: Geweke's measure in both directions; not finite counts as 0, as does below 0."""
    s = spectrum(h)
    c = F.col

    def measure(auto: str, noise: Column, hop: str) -> Column:
        power = c(f"h{hop}_re") * c(f"h{hop}_re") + c(f"h{hop}_im") * c(f"h{hop}_im")
        v = F.log(F.try_divide(c(auto), c(auto) - noise * power))
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(F.greatest(v, F.lit(0.0)))

    return s.select("*", measure("p22", c("s11") - F.try_divide(c("s12") * c("s12"), c("s22")), "21").alias("f_xy"), measure("p11", c("s22") - F.try_divide(c("s12") * c("s12"), c("s11")), "12").alias("f_yx"))


def net_gc(df: DataFrame, keys: list[str], value: str = "gc") -> DataFrame:
    """Of directed rows: src < tgt with the forward value less the backward one."""
    a, b = F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")
    return df.groupBy(*keys, a, b).agg(F.sum(F.when(F.col("src") < F.col("tgt"), F.col(value)).otherwise(-F.col(value))).alias("net"))


def _band(g: pd.DataFrame, names: list[str], order: int) -> tuple[mvar.Band, np.ndarray, int]:
    """(band up to ``order``, most trials by first sample, first sample) of the lag product rows of one group; its memory is
    that of order x samples x channels^2."""
    at = {c: i for i, c in enumerate(names)}
    t0 = int(g["a"].min())
    size = int((g["a"] + g["lag"]).max()) - t0 + 1
    a, lag, c = g["a"].to_numpy() - t0, g["lag"].to_numpy(), g["c"].to_numpy()
    i, j = g["ci"].map(at).to_numpy(), g["cj"].map(at).to_numpy()
    diagonals = []
    for d in range(min(order, size - 1) + 1):
        out, here = np.zeros((size, len(names), len(names))), lag == d
        out[a[here] + d, j[here], i[here]] = c[here]
        if d == 0:
            out[a[here], i[here], j[here]] = c[here]
        diagonals.append(out)
    trials = np.zeros(size, np.int64)
    np.maximum.at(trials, a, g["n"].to_numpy())
    return mvar.Band(diagonals), trials, t0


def _pair_windows(c: DataFrame, cells: dict[int, list[int]], step: int, freqs: list[float], rate: float, ways: tuple[bool, ...]) -> DataFrame:
    """PAIR, win, p and reversed of every pair src < tgt on all windows of all lengths in ``cells`` (length: orders), forward
    or reversed in time. One recursion for each window and way gives every order; a pair of a subject is one group."""
    rows = by_pair(c)
    top = {win: max(orders) for win, orders in cells.items()}
    names = ["subject", "src", "tgt", "start", "freq", "f_xy", "f_yx", "status", "win", "p", "reversed"]

    def fit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        subject, src, tgt = key
        band, trials, t0 = _band(g, [src, tgt], max(top.values()))
        n, out = int(trials.max()), []
        for way in ways:
            b = band.reversed() if way else band
            for win, orders in cells.items():
                for s in range(0, band.size - win + 1, step):
                    fits, wrong = _fits(b, n, top[win], band.size - win - s if way else s, win, orders)
                    for p in orders:
                        if p in fits:
                            fxy, fyx = mvar.geweke(*fits[p], np.array(freqs), rate)
                            out += [(subject, src, tgt, t0 + s, f, x, y, "ok", win, p, way) for f, x, y in zip(freqs, fxy, fyx, strict=True)]
                        else:
                            out += [(subject, src, tgt, t0 + s, f, None, None, wrong[p], win, p, way) for f in freqs]
        return pd.DataFrame(out, columns=names)

    return rows.groupBy("subject", "src", "tgt").applyInPandas(fit, f"{PAIR}, win int, p int, reversed boolean")


def _fits(band: mvar.Band, n: int, top: int, start: int, win: int, orders: list[int]) -> tuple[dict, dict[int, str]]:
    """Fits of a window by order, and the reason of those that can't be made: if the largest fails, each is tried alone."""
    try:
        return mvar.lwr_orders(band, n, top, start, win), {}
    except np.linalg.LinAlgError:
        fits, wrong = {}, {}
        for p in orders:
            try:
                fits[p] = mvar.lwr(band, n, p, start, win)
            except np.linalg.LinAlgError as e:
                wrong[p] = str(e)[:60]
        return fits, wrong


def moving_window_pairwise(c: DataFrame, win: int, step: int, order: int, freqs: list[float], rate: float, reverse: bool = False) -> DataFrame:
    """Geweke GC of every pair src < tgt on every window, from lag products (subject, ci, cj, a, lag, c, n).

    One task group is one pair of one subject; its windows share the running sums. ``reverse`` fits the time-reversed data. A
    window that can't be fitted gives null values and the reason as status.
    """
    return _pair_windows(c, {win: [order]}, step, freqs, rate, (reverse,)).drop("win", "p", "reversed")


def moving_window_orders(c: DataFrame, cells: dict[int, list[int]], step: int, freqs: list[float], rate: float) -> DataFrame:
    """``moving_window_pairwise`` for many window lengths and orders at once, with columns win and p: ``cells`` has the orders
    of each length. A window is gone through once for all of its orders."""
    return _pair_windows(c, cells, step, freqs, rate, (False,)).drop("reversed")


def moving_window_trgc(c: DataFrame, win: int, step: int, order: int, freqs: list[float], rate: float) -> DataFrame:
    """``diff_trgc`` of the fits on the data and on the time-reversed data, both from one pass over the lag products."""
    both = _pair_windows(c, {win: [order]}, step, freqs, rate, (False, True))
    keys = ["subject", "src", "tgt", "start", "freq"]
    of = lambda name, way: F.max(F.when(F.col("reversed") == F.lit(way), F.col(name)))
    one = both.groupBy(*keys).agg(of("f_xy", False).alias("f_xy"), of("f_yx", False).alias("f_yx"), of("status", False).alias("status"), of("f_xy", True).alias("r_xy"), of("f_yx", True).alias("r_yx"))
    d = (F.col("f_xy") - F.col("f_yx")) - (F.col("r_xy") - F.col("r_yx"))
    return one.withColumn("d_xy", d).withColumn("d_yx", -d)


def diff_trgc(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """d_xy = (f_xy - f_yx) - (r_xy - r_yx) of the fits on data and on time-reversed data; d_yx = -d_xy."""
    keys = ["subject", "src", "tgt", "start", "freq"]
    r = backward.select(*keys, F.col("f_xy").alias("r_xy"), F.col("f_yx").alias("r_yx"))
    d = (F.col("f_xy") - F.col("f_yx")) - (F.col("r_xy") - F.col("r_yx"))
    return forward.join(r, keys).withColumn("d_xy", d).withColumn("d_yx", -d)


def order_criteria(c: DataFrame, orders: list[int]) -> DataFrame:
    """subject, p, aic, bic and bic_full (on all N samples instead of N - p) of fits to all channels over the whole epoch.

    One recursion gives the residual covariance at every order.
    """
    schema = "subject bigint, p int, aic double, bic double, bic_full double"

    def fit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        names = sorted(g["ci"].unique())
        m, trials, _ = _band(g, names, max(orders))
        n, k, out = int(trials.max()), len(names), []
        try:
            every = mvar.lwr_orders(m, n, max(orders))
        except np.linalg.LinAlgError:
            every = {}
        for p in orders:
            if p in every:
                det = np.linalg.slogdet(every[p][1])[1]
                size, full = n * (m.size - p), n * m.size
                out.append((key[0], p, det + 2 * p * k * k / size, det + math.log(size) * p * k * k / size, full * det + k * k * p * math.log(full)))
        return pd.DataFrame(out, columns=["subject", "p", "aic", "bic", "bic_full"])

    return c.groupBy("subject").applyInPandas(fit, schema)


def best_order(criteria: DataFrame, by: str = "bic") -> DataFrame:
    return criteria.groupBy("subject").agg(F.min(F.struct(by, "p")).alias("b")).select("subject", F.col("b.p").alias("p"))


def conditional_gc(c: DataFrame, order: int, freqs: list[float] | None = None, rate: float = 1.0) -> DataFrame:
    """subject, src, tgt, f: time-domain conditional GC ln(reduced / full) of every ordered pair given all other channels.

    With ``freqs`` also freq and the spectral measure of the partition method; its mean over all frequencies would be f if
    negative values didn't count as 0.
    """
    schema = "subject bigint, src string, tgt string, freq double, f double, status string"

    def fit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        names = sorted(g["ci"].unique())
        band, trials, _ = _band(g, names, order)
        return pd.DataFrame(_conditional(key, names, band, int(trials.max()), order, freqs, rate, 0, None), columns=["subject", "src", "tgt", "freq", "f", "status"])

    return c.groupBy("subject").applyInPandas(fit, schema)


def moving_window_conditional(c: DataFrame, win: int, step: int, order: int, freqs: list[float] | None = None, rate: float = 1.0) -> DataFrame:
    """``conditional_gc`` on every window, which adds its first sample as start; a window that can't be fitted has one row
    with the reason as status."""
    fit = lambda key, names, band, n, s: _conditional(key, names, band, n, order, freqs, rate, s, win)
    return _on_windows(c, win, step, order, fit)


#: Windows are gone through in blocks of starts; a block is so many windows long.
BLOCK_WINDOWS = 4


def in_blocks(c: DataFrame, win: int, step: int, order: int) -> DataFrame:
    """Lag products up to ``order`` with t0 and t1, the ends of the subject's time, and the blocks of window starts that need
    them. Blocks overlap by a window, so that a lag product goes to two of them at most, whatever the step."""
    span = c.groupBy("subject").agg(F.min("a").alias("t0"), F.max(F.col("a") + F.col("lag")).alias("t1"))
    length = BLOCK_WINDOWS * max(win, step)
    rows = c.where(F.col("lag") <= order).join(span, "subject").where(F.col("t1") - F.col("t0") + 1 >= win)
    first = F.greatest(F.col("a") + F.col("lag") - win + 1 - F.col("t0"), F.lit(0))
    return rows.withColumn("block", F.explode(F.sequence(F.floor(first / length).cast("int"), F.floor((F.col("a") - F.col("t0")) / length).cast("int"))))


def _on_windows(c: DataFrame, win: int, step: int, order: int, leaf) -> DataFrame:
    """subject, start, src, tgt, freq, f, status of ``leaf`` on every window of all channels. A group is a subject and a block
    of neighbouring windows, which share one band and its running sums."""
    length = BLOCK_WINDOWS * max(win, step)
    schema = "subject bigint, start int, src string, tgt string, freq double, f double, status string"

    def fit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        t0, t1, names, out = int(g["t0"].iloc[0]), int(g["t1"].iloc[0]), sorted(g["ci"].unique()), []
        band, trials, at = _band(g, names, order)
        begin = -(-key[1] * length // step) * step
        for s in range(t0 + begin, min(t0 + (key[1] + 1) * length, t1 - win + 2), step):
            if at <= s and s + win <= at + band.size:
                out += leaf((key[0], s), names, band, int(trials[s - at : s - at + win].max()), s - at)
        return pd.DataFrame(out, columns=["subject", "start", "src", "tgt", "freq", "f", "status"])

    return in_blocks(c, win, step, order).groupBy("subject", "block").applyInPandas(fit, schema)


def _conditional(key: tuple, names: list[str], band: mvar.Band, n: int, order: int, freqs: list[float] | None, rate: float, start: int, size: int | None) -> list[tuple]:
    """Rows of the conditional measure of all ordered pairs on one window of a band."""
    out = []
    try:
        full = mvar.lwr(band, n, order, start, size)
        for s, src in enumerate(names):
            keep = [i for i in range(len(names)) if i != s]
            reduced = mvar.lwr(band.take(keep), n, order, start, size)
            for t in keep:
                if freqs is None:
                    out.append((*key, src, names[t], None, float(np.log(reduced[1][keep.index(t), keep.index(t)] / full[1][t, t])), "ok"))
                else:
                    out += [(*key, src, names[t], f, v, "ok") for f, v in zip(freqs, mvar.conditional_spectral(full, reduced, s, t, np.array(freqs), rate), strict=True)]
    except np.linalg.LinAlgError as e:
        out = [(*key, None, None, None, None, str(e)[:60])]
    return out


def returned_grid(df: DataFrame, rate: float, n_times: int) -> DataFrame:
    """Frequencies that an epoch of n_times samples can resolve: f >= 5 * rate / n_times."""
    return df.where(F.col("freq") >= 5.0 * rate / n_times)


def under_resolved(bands: DataFrame, sw_ms: float, min_cycles: float = 2.0) -> DataFrame:
    """Bands with the cycles of their lower edge in a window, whether they are too few, and the least window."""
    cycles = F.col("lo") * sw_ms / 1000
    return bands.select("*", cycles.alias("cycles"), (cycles < min_cycles).alias("under_resolved"), (1000 * min_cycles / F.col("lo")).alias("min_window_ms"))


def statespace_gc(c: DataFrame, win: int, step: int, order: int, freqs: list[float] | None = None, rate: float = 1.0) -> DataFrame:
    """subject, start, src, tgt, freq, f, status: state-space GC of every ordered pair given all other channels, on every
    window. Without ``freqs`` the time-domain measure, freq null."""

    def fit(key: tuple, names: list[str], band: mvar.Band, n: int, s: int) -> list[tuple]:
        out = []
        try:
            m = statespace.from_var(*mvar.lwr(band, n, order, s, win))
            for a, b in ((a, b) for a in range(len(names)) for b in range(len(names)) if a != b):
                if freqs is None:
                    out.append((*key, names[a], names[b], None, statespace.time_gc(m, [a], [b]), "ok"))
                else:
                    out += [(*key, names[a], names[b], f, float(v), "ok") for f, v in zip(freqs, statespace.spectral_gc(m, [a], [b], np.array(freqs), rate), strict=True)]
        except np.linalg.LinAlgError as e:
            out.append((*key, None, None, None, None, str(e)[:60]))
        return out

    return _on_windows(c, win, step, order, fit)


#: Complex values of one batch of transforms.
FFT_VALUES = 1 << 21


def wavelet_csd(packed: DataFrame, freqs: list[float], rate: float, sw_ms: float, least_cycles: float = 3.0, step: int = 1) -> DataFrame:
    """subject, ci, cj, freq, t, re, im, n: Morlet cross-spectra averaged over trials; cycles are max(f * sw / 1000, least).

    Trials (subject, chans, xs) are transformed where they lie, and only sums of products leave a task.
    """

    def kernel(f: float) -> np.ndarray:
        sd = max(f * sw_ms / 1000, least_cycles) / (2 * np.pi * f)
        t = np.arange(-int(4 * sd * rate), int(4 * sd * rate) + 1) / rate
        w = np.exp(2j * np.pi * f * t - t * t / (2 * sd * sd))
        return w / np.sqrt((np.abs(w) ** 2).sum())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kernels, sums = [kernel(f) for f in freqs], {}
        middle = [len(k) // 2 for k in kernels]
        for part in parts:
            sizes = part["xs"].map(lambda v: len(v[0]) if len(v) else 0)
            for (subject, chans, size), rows in part.groupby([part["subject"], part["chans"].map(tuple), sizes], sort=False):
                length = 1 << int(size + max(map(len, kernels)) - 2).bit_length()
                filters = np.stack([np.fft.fft(k, length) for k in kernels])
                block = max(1, FFT_VALUES // (len(chans) * len(kernels) * length))
                total = sums.setdefault((subject, chans, size), [0, 0])
                for at in range(0, len(rows), block):  # all trials of a block, channels and frequencies in one transform
                    x = np.array([[np.asarray(v, dtype=float) for v in xs] for xs in rows["xs"].iloc[at : at + block]])
                    z = np.fft.ifft(np.fft.fft(x, length)[:, :, None, :] * filters)
                    z = np.stack([z[:, :, k, m : m + size : step] for k, m in enumerate(middle)], axis=2)
                    total[0] = total[0] + np.einsum("nift,njft->ijft", z, z.conj(), optimize=True)
                    total[1] += len(x)
        for (subject, chans, _), (s, n) in sums.items():
            i, j, f, t = (v.ravel() for v in np.indices(s.shape))
            yield pd.DataFrame({"subject": subject, "ci": np.array(chans)[i], "cj": np.array(chans)[j], "freq": np.array(freqs)[f], "t": t * step, "re": s.real.ravel(), "im": s.imag.ravel(), "n": n})

    sums = packed.mapInPandas(run, "subject bigint, ci string, cj string, freq double, t int, re double, im double, n bigint")
    return sums.groupBy("subject", "ci", "cj", "freq", "t").agg((F.sum("re") / F.sum("n")).alias("re"), (F.sum("im") / F.sum("n")).alias("im"), F.sum("n").alias("n"))


def gc_from_csd(csd: DataFrame, blocks: dict[str, list[str]], pairs: list[tuple[str, str]], order: int, rate: float) -> DataFrame:
    """subject, src, tgt, t, freq, gc, dtrgc, status: block GC from cross-spectra at every time.

    ``csd`` holds equally spaced frequencies. They give autocovariances by a cosine and sine sum, these a VAR and its
    state-space GC between the channel blocks, on the data and reversed in time; dtrgc is the difference of net values.
    """
    spark = csd.sparkSession
    edges = spark.createDataFrame([(s, t, sorted({*blocks[s], *blocks[t]})) for s, t in pairs], "src string, tgt string, chans array<string>")
    rows = csd.join(F.broadcast(edges), F.array_contains("chans", F.col("ci")) & F.array_contains("chans", F.col("cj"))).drop("chans")
    schema = "subject bigint, src string, tgt string, t int, freq double, gc double, dtrgc double, status string"

    def fit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        subject, src, tgt, t = key
        names = [*blocks[src], *[b for b in blocks[tgt] if b not in blocks[src]]]
        at, freqs = {c: i for i, c in enumerate(names)}, np.sort(g["freq"].unique())
        s = np.zeros((len(freqs), len(names), len(names)), complex)
        s[np.searchsorted(freqs, g["freq"]), g["ci"].map(at), g["cj"].map(at)] = g["re"] + 1j * g["im"]
        a, b = [at[c] for c in blocks[src]], [at[c] for c in blocks[tgt]]
        try:
            w = np.exp(2j * np.pi * np.outer(np.arange(order + 1), freqs) / rate)
            cov = np.real(np.einsum("kf,fij->kij", w, s)) / len(freqs)
            cov[0] += 1e-9 * np.trace(cov[0]) / len(names) * np.eye(len(names))
            net, out = [], None
            for g_ in (cov, np.swapaxes(cov, 1, 2)):
                m = statespace.from_var(*statespace.var_from_autocovariance(g_))
                f = statespace.spectral_gc(m, a, b, freqs, rate)
                net.append(f - statespace.spectral_gc(m, b, a, freqs, rate))
                out = f if out is None else out
            rows_ = [(subject, src, tgt, t, float(x), float(v), float(d), "ok") for x, v, d in zip(freqs, out, net[0] - net[1], strict=True)]
        except np.linalg.LinAlgError as e:
            rows_ = [(subject, src, tgt, t, None, None, None, str(e)[:60])]
        return pd.DataFrame(rows_, columns=["subject", "src", "tgt", "t", "freq", "gc", "dtrgc", "status"])

    return rows.groupBy("subject", "src", "tgt", "t").applyInPandas(fit, schema)
