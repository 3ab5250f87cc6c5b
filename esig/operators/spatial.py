"""Spatial reduction and linear projection.

Gram matrices and covariances are partial sums of the tasks, the application of filters is a join and a sum; only the
small matrix of one region, trial or subject is solved in a grouped leaf.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..leaf import beamformer
from ..leaf.classify import leading
from .select import small

SIGNAL = ("subject", "roi", "epoch", "t_idx")


#: Sums of products that a task holds before it passes them on, what the entry of a group counts besides, and pairs that go out
#: at once.
HELD_SUMS, HELD_EACH, TOLD_PAIRS = 4_000_000, 200, 50_000


def moments(df: DataFrame, keys: list[str], unit: str, sample: tuple[str, ...]) -> DataFrame:
    """keys, i, j, n, g, mi, mj, cij, cii, cjj for i <= j: over the samples that hold both units their number, the sum of
    x_i x_j, the means and the sums of products of deviations.

    The units of a sample are brought together in one exchange; tasks multiply blocks of samples and pass on partial
    sums, which Spark adds up. No row meets another by a join.
    """
    over = list(dict.fromkeys([*keys, *sample]))
    kinds = dict(df.dtypes)
    packed = df.where(F.col("x").isNotNull()).groupBy(*over).agg(F.array_sort(F.collect_list(F.struct(F.col(unit).alias("u"), F.col("x").cast("double").alias("x")))).alias("p"))
    head, width = ", ".join(f"{c} {kinds[c]}" for c in keys), len(keys)
    fields = ["n", "g", "mi", "mj", "cij", "cii", "cjj"]

    def tell(sums: dict) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in range(width + 2 + len(fields))]
        for (key, units), (n, g, mean, c) in sums.items():
            if len(columns[-1]) > TOLD_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(columns, target, strict=True)], schema=target)
                columns = [[] for _ in columns]
            i, j = np.triu_indices(len(units))
            d = np.diag(c)
            for at, v in enumerate((*[[k] * len(i) for k in key], [units[k] for k in i], [units[k] for k in j], [n] * len(i), g[i, j], mean[i], mean[j], c[i, j], d[i], d[j])):
                columns[at].extend(v)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(columns, target, strict=True)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held = {}, 0
        for b in batches:
            size = np.array([len(v) for v in b.column(width)], dtype=np.int64)
            ends = np.cumsum(size)
            u, x = (b.column(width + k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1))
            own = list(zip(*[b.column(i).to_pylist() for i in range(width)], strict=True)) if width else [()] * b.num_rows
            groups: dict[tuple, list[int]] = {}
            for row, key in enumerate(own):
                groups.setdefault((key, tuple(u[ends[row] - size[row] : ends[row]].tolist())), []).append(row)
            for name, rows in groups.items():
                m = len(name[1])
                block = x[(ends[rows] - m)[:, None] + np.arange(m)]
                n, mean = len(rows), block.mean(axis=0)
                off = block - mean
                g, c = block.T @ block, off.T @ off
                if name in sums:
                    n0, g0, mean0, c0 = sums[name]
                    step = mean - mean0
                    c = c + c0 + np.outer(step, step) * (n * n0 / (n + n0))
                    n, g, mean = n + n0, g + g0, mean0 + step * (n / (n + n0))
                else:
                    held += 2 * m * m + HELD_EACH
                sums[name] = (n, g, mean, c)
            if held > HELD_SUMS:
                yield from tell(sums)
                sums, held = {}, 0
        yield from tell(sums)

    schema = f"{head}{', ' if head else ''}i {kinds[unit]}, j {kinds[unit]}, n bigint, " + ", ".join(f"{c} double" for c in fields[1:])
    target = to_arrow_schema(StructType.fromDDL(schema))
    parts = packed.select(*keys, "p.u", "p.x").mapInArrow(run, schema)
    n = F.sum("n")
    mean = {c: F.sum(F.col("n") * F.col(c)) / n for c in ("mi", "mj")}
    between = lambda a, b: F.sum(F.col("n") * F.col(a) * F.col(b)) - F.sum(F.col("n") * F.col(a)) * F.sum(F.col("n") * F.col(b)) / n
    pooled = {"cij": ("mi", "mj"), "cii": ("mi", "mi"), "cjj": ("mj", "mj")}
    return parts.groupBy(*keys, "i", "j").agg(n.alias("n"), F.sum("g").alias("g"), *[m.alias(c) for c, m in mean.items()], *[F.when(F.count("*") > 1, F.sum(c) + between(*ab)).otherwise(F.sum(c)).alias(c) for c, ab in pooled.items()])


def gram(df: DataFrame, keys: list[str], unit: str = "vertex", sample: tuple[str, ...] = ("epoch", "t_idx")) -> DataFrame:
    """keys, i, j, g, n: sums over samples of x_i x_j for i <= j."""
    return moments(df, keys, unit, sample).select(*keys, "i", "j", "g", "n")


def covariance(df: DataFrame, keys: list[str], unit: str = "chan", sample: tuple[str, ...] = ("epoch", "t_idx")) -> DataFrame:
    """keys, i, j, cov (denominator n - 1) of units over samples pooled across trials, i <= j."""
    return moments(df, keys, unit, sample).select(*keys, "i", "j", F.when(F.col("n") > 1, F.col("cij") / (F.col("n") - 1)).alias("cov"))


def _square(g: pd.DataFrame, value: str) -> tuple[list, np.ndarray]:
    units = sorted(set(g["i"]) | set(g["j"]))
    at = {u: k for k, u in enumerate(units)}
    m = np.zeros((len(units),) * 2)
    i, j = g["i"].map(at).to_numpy(), g["j"].map(at).to_numpy()
    m[i, j] = m[j, i] = g[value].to_numpy()
    return units, m


def top_pcs(df: DataFrame, k: int = 1, keys: tuple[str, ...] = ("subject", "roi")) -> DataFrame:
    """keys, pc, vertex, w: leading unit filters of the mean-centred ensemble, their largest loading positive; at most as
    many as vertices, and 1 for a single vertex."""
    types = dict(df.dtypes)
    head = ", ".join(f"{c} {types[c]}" for c in keys)
    c = covariance(df, list(keys), "vertex")

    def solve(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        units, m = _square(g, "cov")
        v = leading(m, min(k, len(units))) if len(units) > 1 else np.ones((1, 1))
        return pd.DataFrame([(*key, p, u, float(v[p, n])) for p in range(len(v)) for n, u in enumerate(units)], columns=[*keys, "pc", "vertex", "w"])

    return c.groupBy(*keys).applyInPandas(solve, f"{head}, pc int, vertex {types['vertex']}, w double")


def apply_filter(df: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ("subject", "roi"), unit: str = "vertex", out: str = "pc", more: tuple[str, ...] = ("epoch", "t_idx")) -> DataFrame:
    """keys, more, out, x: sum over units of w x, on the uncentred data."""
    rows = df.join(weights, [*keys, unit])
    return rows.groupBy(*keys, *more, out).agg(F.sum(F.col("w") * F.col("x")).alias("x"))


def first_pc(df: DataFrame, keys: tuple[str, ...] = ("subject", "roi")) -> DataFrame:
    return apply_filter(df, top_pcs(df, 1, keys), keys).drop("pc")


def aggregate_variants(df: DataFrame, keys: tuple[str, ...] = ("subject", "roi")) -> DataFrame:
    """keys, epoch, t_idx, mean and maxpower: the vertices' mean, and the series of the vertex of largest variance (the
    smallest on ties)."""
    power = df.groupBy(*keys, "vertex").agg(F.round(F.var_pop("x"), 9).alias("p"))
    top = power.groupBy(*keys).agg(F.min(F.struct((-F.col("p")).alias("p"), "vertex")).alias("b")).select(*keys, F.col("b.vertex").alias("_v"))
    return df.join(top, list(keys)).groupBy(*keys, "epoch", "t_idx").agg(F.avg("x").alias("mean"), F.max(F.when(F.col("vertex") == F.col("_v"), F.col("x"))).alias("maxpower"))


def mean_flip(df: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ("subject", "roi")) -> DataFrame:
    """Mean over vertices of sign(w) x, with the sign of the first filter."""
    rows = df.join(weights.where("pc = 0"), [*keys, "vertex"])
    return rows.groupBy(*keys, "epoch", "t_idx").agg(F.avg(F.signum("w") * F.col("x")).alias("x"))


def eigen_shares(df: DataFrame, keys: list[str], unit: str = "chan", rank_tol: float = 1e-6) -> DataFrame:
    """keys, shared (largest eigenvalue over their sum), rank (eigenvalues over ``rank_tol`` of the largest) of the covariance."""
    types = dict(df.dtypes)
    head = ", ".join(f"{c} {types[c]}" for c in keys)

    def solve(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        e = np.linalg.eigvalsh(_square(g, "cov")[1])
        total = e.sum()
        return pd.DataFrame([(*key, float(e[-1] / total) if total > 0 else None, int((e > rank_tol * e[-1]).sum()) if e[-1] > 0 else 0)], columns=[*keys, "shared", "rank"])

    return covariance(df, keys, unit).groupBy(*keys).applyInPandas(solve, f"{head}, shared double, rank int")


def _trial(g: pa.Table, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units with a value, times at which they have rows, the matrix of units by times (0 where nothing is), and whether a time
    has a value."""
    there = g["x"].is_valid().to_numpy(zero_copy_only=False)
    name, x = g[unit].to_numpy(zero_copy_only=False), g["x"].to_numpy(zero_copy_only=False)
    units = np.unique(name[there])
    rows = np.isin(name, units)
    times, t = np.unique(g["t_idx"].to_numpy(zero_copy_only=False)[rows], return_inverse=True)
    m, some = np.zeros((len(units), len(times))), np.zeros(len(times), bool)
    full = there[rows]
    np.add.at(m, (np.searchsorted(units, name[rows][full]), t[full]), x[rows][full])
    some[t[full]] = True
    return units, times, m, some


def _each_trial(df: DataFrame, keys: list[str], unit: str, leaf, out: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """``out`` from one call of ``leaf`` for every trial, whose rows come together once: ``leaf`` takes the matrix of units by
    times, the units and the trial's rows, and gives series, by unit where ``out`` has it. A task holds one trial at a time."""
    rows = df.where(" AND ".join(f"{c} IS NOT NULL" for c in (*keys, unit))).select(*keys, *[c for c in (unit, "t_idx") if c not in keys], F.col("x").cast("double").alias("x"), *more)
    schema = StructType([rows.schema[c] for c in out])
    target = to_arrow_schema(schema)

    def run(key: tuple, g: pa.Table) -> pa.Table:
        units, times, m, some = _trial(g, unit)
        if not len(units):
            return target.empty_table()
        x = leaf(m, units, g)
        n = len(x)
        known = {k: pa.repeat(v, n * len(times)) for k, v in zip(keys, key, strict=True)}
        known |= {"t_idx": pa.array(np.tile(times, n)), "x": pa.array(x.ravel(), mask=np.tile(~some, n))}
        if unit in out:
            known[unit] = pa.array(np.repeat(units, len(times)))
        return pa.table([known[c].cast(target.field(c).type) for c in out], schema=target)

    return rows.groupBy(*keys).applyInArrow(run, schema)


def epoch_summary(df: DataFrame, keys: tuple[str, ...] = ("subject", "roi", "epoch")) -> DataFrame:
    """keys, t_idx, x: per trial the projection on the leading vertex vector, without centring (s[0] * Vt[0])."""
    return _each_trial(df, list(keys), "vertex", lambda m, units, g: leading(m @ m.T) @ m, [*keys, "t_idx", "x"])


def pca_flip(df: DataFrame, flip: DataFrame, keys: tuple[str, ...] = ("subject", "roi", "epoch")) -> DataFrame:
    """keys, t_idx, x: per trial the first right singular vector of vertices by samples, times the norm of the singular
    values over the root of the number of vertices, with the sign of the leading vertex vector along ``flip``.

    ``flip`` (roi, vertex, flip) gives each vertex its sign; vertices that it lacks count as 0, and so does the series
    where they cancel or the trial is zero.
    """

    def leaf(m: np.ndarray, units: np.ndarray, g: pa.Table) -> np.ndarray:
        gram = m @ m.T
        v = leading(gram)[0]
        top = float(v @ gram @ v)
        w = v * (np.sqrt(np.trace(gram) / len(units) / top) if top > 0 else 0.0)
        sign = dict(zip(g["vertex"].to_pylist(), g["flip"].to_pylist(), strict=True))
        along = sum(a * (sign[u] or 0.0) for a, u in zip(w.tolist(), units.tolist(), strict=True))
        return (w * np.sign(round(along, 12)))[None] @ m

    rows = df.join(small(flip.select("roi", "vertex", F.col("flip").cast("double").alias("flip"))), ["roi", "vertex"], "left")
    return _each_trial(rows, list(keys), "vertex", leaf, [*keys, "t_idx", "x"], ("flip",))


def orthogonalise(df: DataFrame, floor: float = 1e-10) -> DataFrame:
    """subject, epoch, roi, t_idx, x: per trial C^-1/2 D over regions, eigenvalues floored; one series per region."""

    def leaf(m: np.ndarray, units: np.ndarray, g: pa.Table) -> np.ndarray:
        e, v = np.linalg.eigh(m @ m.T)
        return (v / np.sqrt(np.maximum(e, floor))) @ v.T @ m

    return _each_trial(df, ["subject", "epoch"], "roi", leaf, ["subject", "epoch", "roi", "t_idx", "x"])


def regress_out(df: DataFrame, summaries: DataFrame, ridge: float = 1e-6) -> DataFrame:
    """Residual of every vertex on the summaries of all other regions of its trial (normal equations with a ridge).

    ``df`` has subject, epoch, roi, vertex, t_idx, x; ``summaries`` subject, epoch, roi, t_idx, x. A trial is one group, in
    which its samples and summaries come together once, as two dense matrices; vertices of a region share one solve.
    Samples at times at which no other region has a summary give no row.
    """
    types = dict(df.dtypes)
    schema = f"subject {types['subject']}, epoch {types['epoch']}, roi string, vertex {types['vertex']}, t_idx int, x double"
    head = ["subject", "epoch", "roi"]
    one = df.select(*head, "vertex", F.col("t_idx").cast("int").alias("t_idx"), F.col("x").cast("double").alias("x"), F.lit(False).alias("sums"))
    two = summaries.select(*head, F.lit(None).cast(types["vertex"]).alias("vertex"), F.col("t_idx").cast("int").alias("t_idx"), F.col("x").cast("double").alias("x"), F.lit(True).alias("sums"))

    def solve(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        have, here = g[g["sums"]], g[~g["sums"]]
        if not len(have) or not len(here):
            return pd.DataFrame(columns=["subject", "epoch", "roi", "vertex", "t_idx", "x"])
        times, t = np.unique(g["t_idx"], return_inverse=True)
        rois, r = np.unique(have["roi"], return_inverse=True)
        s, there = np.zeros((len(rois), len(times))), np.zeros((len(rois), len(times)), bool)
        s[r, t[g["sums"].to_numpy()]] = have["x"].fillna(0.0)
        there[r, t[g["sums"].to_numpy()]] = True
        m, out, place = s @ s.T, [], t[~g["sums"].to_numpy()]
        for roi in pd.unique(here["roi"]):
            at = np.flatnonzero(here["roi"].to_numpy() == roi)
            vertices, v = np.unique(here["vertex"].to_numpy()[at], return_inverse=True)
            x = np.zeros((len(vertices), len(times)))
            x[v, place[at]] = here["x"].to_numpy()[at]
            keep = np.flatnonzero(rois != roi)
            if not len(keep):
                continue
            a = m[np.ix_(keep, keep)]
            w = np.linalg.solve(a + ridge * np.trace(a) / len(keep) * np.eye(len(keep)), s[keep] @ np.nan_to_num(x).T)
            rest = x - w.T @ s[keep]
            at, v = at[there[keep].any(axis=0)[place[at]]], v[there[keep].any(axis=0)[place[at]]]
            out.append(pd.DataFrame({"subject": key[0], "epoch": key[1], "roi": roi, "vertex": vertices[v], "t_idx": times[place[at]], "x": rest[v, place[at]]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["subject", "epoch", "roi", "vertex", "t_idx", "x"])

    return one.unionByName(two).groupBy("subject", "epoch").applyInPandas(solve, schema)


def shrunk_covariance(df: DataFrame, keys: list[str], unit: str = "chan") -> DataFrame:
    """keys, i, j, cov, shrinkage: Ledoit and Wolf's analytic shrinkage toward the scaled identity, moments in Spark.

    cov has denominator n. Needs sum over samples of the squared norm to the fourth power, besides the covariance.
    """
    over = [*keys, "epoch", "t_idx"]
    mean = df.groupBy(*keys, unit).agg(F.avg("x").alias("_m"))
    z = df.join(mean, [*keys, unit]).select(*over, unit, (F.col("x") - F.col("_m")).alias("x"))
    s = gram(z, keys, unit).withColumn("cov", F.col("g") / F.col("n"))
    norm = z.groupBy(*over).agg(F.sum(F.col("x") * F.col("x")).alias("r")).groupBy(*keys).agg(F.sum(F.col("r") * F.col("r")).alias("r4"), F.count("*").alias("n"))
    double = F.when(F.col("i") == F.col("j"), 1).otherwise(2)
    tot = s.groupBy(*keys).agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("cov"))).alias("tr"), F.sum(double * F.col("cov") * F.col("cov")).alias("ss"), F.sum(F.when(F.col("i") == F.col("j"), 1)).alias("p")).join(norm, keys)
    mu = F.col("tr") / F.col("p")
    d2 = (F.col("ss") - F.col("p") * mu * mu) / F.col("p")
    b2 = (F.col("r4") / F.col("n") - F.col("ss")) / (F.col("n") * F.col("p"))
    k = F.when(d2 > 0, F.greatest(F.least(b2 / d2, F.lit(1.0)), F.lit(0.0))).otherwise(0.0)
    tot = tot.select(*keys, mu.alias("mu"), k.alias("shrinkage"))
    target = F.when(F.col("i") == F.col("j"), F.col("mu")).otherwise(0.0)
    return s.join(tot, keys).select(*keys, "i", "j", ((1 - F.col("shrinkage")) * F.col("cov") + F.col("shrinkage") * target).alias("cov"), "shrinkage")


def _inverse(c: DataFrame, reg: float) -> DataFrame:
    """subject, i, j, v of the regularised inverse, full."""
    types = dict(c.dtypes)

    def solve(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        units, m = _square(g, "cov")
        v = np.linalg.inv(m + reg * np.trace(m) / len(m) * np.eye(len(m)))
        return pd.DataFrame([(key[0], a, b, float(v[n, k])) for n, a in enumerate(units) for k, b in enumerate(units)], columns=["subject", "i", "j", "v"])

    return c.groupBy("subject").applyInPandas(solve, f"subject {types['subject']}, i {types['i']}, j {types['j']}, v double")


def lcmv_weights(gain: DataFrame, data_cov: DataFrame, reg: float = 0.05) -> DataFrame:
    """subject, vertex, chan, w for fixed orientation with unit noise gain: C^-1 g / |C^-1 g|.

    ``gain`` is (vertex, chan, g) and ``data_cov`` (subject, i, j, cov), i <= j, both for all channels.
    """
    inv = _inverse(data_cov, reg)
    raw = gain.join(inv, gain["chan"] == inv["j"]).groupBy("subject", "vertex", F.col("i").alias("chan")).agg(F.sum(F.col("g") * F.col("v")).alias("w"))
    return raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("subject", "vertex"))))


#: Vertices whose filters are worked out together.
VERTEX_BLOCK = 1024


def lcmv_max_power(gain: DataFrame, data_cov: DataFrame, noise_cov: DataFrame, reg: float = 0.05, rank: int | None = None, reduce_rank: bool = True) -> DataFrame:
    """subject, vertex, chan, w, ori: filters with unit noise gain in the orientation of most power, on whitened data.

    ``gain`` is (vertex, chan, ori, g) with three orientations 0, 1, 2 (a missing one counts as 0), ``data_cov`` and
    ``noise_cov`` (subject, i, j, cov), i <= j, for all channels. ``reduce_rank`` leaves out the weakest direction of each
    gain; ``rank`` is that of the noise, found from its eigenvalues if not given. ori (array) is the unit vector chosen.
    A subject's covariances go once to each block of vertices.
    """
    types = dict(gain.dtypes)
    blocks = max(1, -(-gain.select("vertex").distinct().count() // VERTEX_BLOCK))
    packed = gain.groupBy("vertex").agg(F.collect_list(F.struct(F.col("chan").alias("c"), F.col("ori").cast("int").alias("o"), "g")).alias("p")).withColumn("block", F.pmod(F.xxhash64("vertex"), F.lit(blocks)).cast("int"))
    rows = [df.groupBy("subject").agg(F.collect_list(F.struct("i", "j", "cov")).alias(name)) for df, name in ((data_cov, "data"), (noise_cov, "noise"))]
    covs = rows[0].join(rows[1], "subject")
    left = packed.join(data_cov.select(F.col("subject").alias("s")).distinct(), F.lit(True)).withColumnRenamed("s", "subject")  # every subject wants every vertex
    right = covs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = f"subject {dict(covs.dtypes)['subject']}, vertex {types['vertex']}, chan {types['chan']}, w double, ori array<double>"

    def full(p: list, at: dict) -> np.ndarray:
        m = np.zeros((len(at), len(at)))
        for r in p:
            m[at[r["i"]], at[r["j"]]] = m[at[r["j"]], at[r["i"]]] = r["cov"]
        return m

    def solve(key: tuple, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame(columns=["subject", "vertex", "chan", "w", "ori"])
        one, data, noise = one.sort_values("vertex"), two["data"].iloc[0], two["noise"].iloc[0]
        chans = sorted({r[k] for r in data for k in ("i", "j")})
        at, g = {c: n for n, c in enumerate(chans)}, np.zeros((len(one), len(chans), 3))
        for n, p in enumerate(one["p"]):
            for r in p:
                g[n, at[r["c"]], r["o"]] = r["g"]
        w, o = beamformer.max_power(g, full(data, at), full(noise, at), reg, rank, 2 if reduce_rank else 3)
        v = np.repeat(np.arange(len(one)), len(chans))
        return pd.DataFrame({"subject": key[0], "vertex": one["vertex"].to_numpy()[v], "chan": np.tile(chans, len(one)), "w": w.ravel(), "ori": [o[n].tolist() for n in v]})

    return left.groupBy("subject", "block").cogroup(right.groupBy("subject", "block")).applyInPandas(solve, schema)


def dspm_weights(gain: DataFrame, noise_cov: DataFrame, snr: float = 3.0) -> DataFrame:
    """subject, vertex, chan, w: minimum norm with lambda2 = 1 / snr^2, each vertex scaled to unit noise."""
    two = gain.select("vertex", F.col("chan").alias("j"), F.col("g").alias("h"))
    gg = gain.withColumnRenamed("chan", "i").join(two, "vertex").groupBy("i", "j").agg(F.sum(F.col("g") * F.col("h")).alias("gg"))
    full = noise_cov.unionByName(noise_cov.where("i <> j").select("subject", F.col("j").alias("i"), F.col("i").alias("j"), "cov"))
    trace = full.where("i = j").groupBy("subject").agg(F.sum("cov").alias("tn")).join(F.broadcast(gg.where("i = j").agg(F.sum("gg").alias("tg"))))
    both = full.join(gg, ["i", "j"]).join(trace, "subject").where("i <= j")
    m = both.select("subject", "i", "j", (F.col("gg") + F.col("cov") * F.col("tg") / F.col("tn") / snr**2).alias("cov"))
    inv = _inverse(m, 0.0)
    raw = gain.join(inv, gain["chan"] == inv["j"]).groupBy("subject", "vertex", F.col("i").alias("chan")).agg(F.sum(F.col("g") * F.col("v")).alias("w"))
    noise = raw.join(full.withColumnRenamed("i", "chan"), ["subject", "chan"]).join(raw.select("subject", "vertex", F.col("chan").alias("j"), F.col("w").alias("u")), ["subject", "vertex", "j"])
    size = noise.groupBy("subject", "vertex").agg(F.sqrt(F.sum(F.col("w") * F.col("cov") * F.col("u"))).alias("s"))
    return raw.join(size, ["subject", "vertex"]).select("subject", "vertex", "chan", (F.col("w") / F.col("s")).alias("w"))


def collapsed_check(df: DataFrame, keys: list[str], unit: str = "vertex", r_above: float = 0.999) -> DataFrame:
    """keys, min_r, spread, collapsed: least correlation of two vertices and mean deviation across vertices."""
    over = [*keys, "epoch", "t_idx"]
    r = F.try_divide(F.col("cij"), F.sqrt(F.col("cii") * F.col("cjj")))
    r = moments(df, keys, unit, ("epoch", "t_idx")).where("i < j").groupBy(*keys).agg(F.min(r).alias("min_r"))
    spread = df.groupBy(*over).agg(F.stddev_pop("x").alias("s")).groupBy(*keys).agg(F.avg("s").alias("spread"))
    return r.join(spread, keys).withColumn("collapsed", F.col("min_r") > r_above)
