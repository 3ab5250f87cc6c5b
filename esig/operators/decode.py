"""Distributed cross-validated decoding.

Folds, pseudo-trials, standardisation and feature scores are DataFrame expressions; a task (subject, roi, duration,
window) fits the folds of every configuration and repeat in a grouped leaf on that window's trials only.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import classifier_tag, default_c, md5_order
from ..leaf import classify
from .windows import prepare_windowed

GRID = (0.01, 0.1, 1.0, 10.0)
RESULT = "subject bigint, roi string, classifier string, sw_dur int, tuned boolean, w int, ms double, rep int, accuracy double, c double, status string"


def stratified_folds(epochs: DataFrame, keys: list[str], repeats: int = 5, k: int = 5, seed: int = 0) -> DataFrame:
    """keys, epoch, y, rep, fold: within each repeat and class, trials in hashed order dealt over k folds."""
    rows = epochs.select(*keys, "epoch", "y").distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = Window.partitionBy(*keys, "rep", "y").orderBy(md5_order(F.lit(seed) + F.col("rep"), "epoch"), "epoch")
    return rows.withColumn("fold", ((F.row_number().over(order) - 1) % k).cast("int"))


def pseudo_trials(df: DataFrame, g: int, keys: list[str], x: str = "x", seed: int = 0, trial: str = "epoch") -> DataFrame:
    """keys, y, grp, x: means of complete groups of g trials of a class in hashed order; the remainder is dropped."""
    ids = df.select(*keys, "y", trial).distinct()
    w = Window.partitionBy(*keys, "y")
    ranked = ids.select("*", F.row_number().over(w.orderBy(md5_order(F.lit(seed), trial), trial)).alias("_n"), F.count("*").over(w).alias("_c"))
    ranked = ranked.withColumn("grp", F.floor((F.col("_n") - 1) / g).cast("int")).where(F.col("grp") < F.floor(F.col("_c") / g))
    more = [c for c in df.columns if c not in (*keys, "y", trial, x)]
    return df.join(ranked.drop("_n", "_c"), [*keys, "y", trial]).groupBy(*keys, "y", "grp", *more).agg(F.avg(x).alias(x))


def standardise(df: DataFrame, is_train: Column, keys: list[str], x: str = "x") -> DataFrame:
    """All rows scaled by the mean and population deviation of the training rows; a deviation of 0 counts as 1."""
    stats = df.where(is_train).groupBy(*keys).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    return df.join(stats, keys).withColumn(x, (F.col(x) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)).drop("_m", "_s")


def select_k_best(df: DataFrame, keys: list[str], k: int, feature: str = "vertex", x: str = "x") -> DataFrame:
    """keys, feature, f, place of the k features with the largest ANOVA F, from per-class sums alone."""
    m = df.groupBy(*keys, feature, "y").agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(F.col(x) * F.col(x)).alias("q"))
    t = m.groupBy(*keys, feature).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.count("*").alias("g"))
    between = F.try_divide(F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("g") - 1)
    within = F.try_divide(F.col("q") - F.col("b"), F.col("n") - F.col("g"))
    t = t.select(*keys, feature, F.round(F.try_divide(between, within), 9).alias("f"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("f"), feature))
    return t.withColumn("place", place).where(F.col("place") <= k)


def _fold_ids(epochs: np.ndarray, y: np.ndarray, rep: int, k: int, seed: int) -> np.ndarray:
    """The folds of ``stratified_folds`` for one repeat."""
    out = np.zeros(len(y), int)
    keys = [hashlib.md5(f"{seed + rep}:{e}".encode()).hexdigest() for e in epochs]
    for c in (0, 1):
        at = sorted(np.flatnonzero(y == c), key=lambda i: (keys[i], epochs[i]))
        out[at] = np.arange(len(at)) % k
    return out


def _prepare(x: np.ndarray, y: np.ndarray, t: np.ndarray, k_best: int | None, pca: bool) -> tuple[np.ndarray, np.ndarray]:
    x, t = classify.standardise(x, t)
    if k_best:
        at = classify.top_k(x, y, k_best)
        x, t = x[:, at], t[:, at]
    if pca:
        mean, basis = classify.pca_basis(x)
        x, t = (x - mean) @ basis.T, (t - mean) @ basis.T
    return x, t


def _grouped(x: np.ndarray, y: np.ndarray, epochs: np.ndarray, g: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    if g <= 1:
        return x, y
    rows, labels = [], []
    for c in (0, 1):
        at = sorted(np.flatnonzero(y == c), key=lambda i: hashlib.md5(f"{seed}:{epochs[i]}".encode()).hexdigest())
        for i in range(len(at) // g):
            rows.append(x[at[i * g : (i + 1) * g]].mean(axis=0))
            labels.append(c)
    return np.array(rows), np.array(labels)


def fits_of(classifier: str, tuned: bool, k: int, inner: int) -> int:
    """Fits of one repeat of a configuration: one per fold, and if tuned the grid on each inner fold before."""
    return k * (1 + (inner * len(GRID) if tuned and classifier != "lda" else 0))


def shares(work: list[tuple[int, tuple]], most: int) -> list[list[tuple]]:
    """Pieces of ``work`` (cost, piece) in as many shares as keep each at about ``most``, or at the dearest piece's cost: each
    piece, the dearest first, goes to the lightest share."""
    if not work:
        return []
    n = -(-sum(c for c, _ in work) // max(most, max(c for c, _ in work)))
    out: list[list] = [[0, []] for _ in range(n)]
    for cost, piece in sorted(work, key=lambda w: -w[0]):
        least = min(out, key=lambda s: s[0])
        least[0] += cost
        least[1].append(piece)
    return [pieces for _, pieces in out]


def decode_tasks(windowed: DataFrame, configs: DataFrame, repeats: int = 5, k: int = 5, inner: int = 3, pseudo: int = 1, k_best: int | None = 200, pca: bool = False, seed: int = 0, fits_per_task: int = 350) -> DataFrame:
    """One row per (subject, roi, classifier, sw_dur, tuned, window, repeat) with its mean accuracy over folds.

    ``windowed`` has subject, roi, epoch, y, sw_dur, w, ms_center, features; ``configs``, a grid of a few rows that is read
    first, classifier, sw_dur, tuned, c. The configurations and repeats of a window are dealt into shares of like numbers
    of fits (``shares``), and each share with the window's trials is a group of its own, so that an expensive window
    spreads over tasks; trials cross the exchange once for each share. Of values of c that score alike the smallest is taken.
    Cells that can't be fitted have a status.
    """
    every = [tuple(r) for r in configs.select("classifier", "sw_dur", "tuned", default_c(F.col("classifier"), F.col("c"))).distinct().orderBy("classifier", "sw_dur", "tuned").collect()]
    keys = ["subject", "roi", "sw_dur", "w"]
    dealt = {dur: shares([(fits_of(c[0], c[2], k, inner), (*c, rep)) for c in every if c[1] == dur for rep in range(repeats)], fits_per_task) for dur in sorted({c[1] for c in every})}

    def decoded(x: np.ndarray, y: np.ndarray, epochs: np.ndarray, pieces: list[tuple]) -> list[tuple]:
        """(accuracy, c, status) of each piece. The training data of a repeat's folds are prepared once for all of its pieces,
        and the fits of a classifier are solved together."""
        if min((y == 0).sum(), (y == 1).sum()) < k:
            return [(None, None, "fewer trials of a class than folds")] * len(pieces)
        known: dict[tuple, tuple] = {}

        def fold_data(rep: int, f: int, i: int | None) -> tuple:
            """Prepared training rows, their labels, prepared test rows and theirs: of fold f, or of its inner fold i."""
            if (rep, f, i) not in known:
                fold = _fold_ids(epochs, y, rep, k, seed) if (rep,) not in known else known[(rep,)]
                known[(rep,)] = fold
                tx, ty, te, sx, sy = x[fold != f], y[fold != f], epochs[fold != f], x[fold == f], y[fold == f]
                if i is not None:
                    if (rep, f) not in known:
                        known[(rep, f)] = _fold_ids(te, ty, 100 + rep, inner, seed)
                    part = known[(rep, f)]
                    tx, ty, te, sx, sy = tx[part != i], ty[part != i], te[part != i], tx[part == i], ty[part == i]
                px, py = _grouped(tx, ty, te, pseudo, seed)
                known[(rep, f, i)] = (*_prepare(px, py, sx, k_best, pca), py, sy)
            return known[(rep, f, i)]

        def hits(name: str, data: list[tuple], c: np.ndarray) -> np.ndarray:
            """Share of test rows that each value of c (data, values) gets right."""
            fits = classify.fit_many(name, [d[0] for d in data], [d[2] for d in data], c)
            return np.array([((b @ w[:, :-1].T + w[:, -1] > 0) == (sy == 1)[:, None]).mean(axis=0) for (_, b, _, sy), w in zip(data, fits, strict=True)])

        def together(name: str, some: list[tuple]) -> list[tuple]:
            best = np.repeat([[p[2]] for p in some], k, axis=1)
            grid = [at for at, p in enumerate(some) if p[1] and name != "lda"]
            if grid:
                data = [fold_data(some[at][3], f, i) for at in grid for f in range(k) for i in range(inner)]
                score = hits(name, data, np.tile(GRID, (len(data), 1))).reshape(len(grid), k, inner, len(GRID))
                best[grid] = np.array(GRID)[score.mean(axis=2).round(12).argmax(axis=2)]  # equal scores: the smallest
            right = hits(name, [fold_data(p[3], f, None) for p in some for f in range(k)], best.reshape(-1, 1)).reshape(-1, k)
            out = []
            for chosen, h in zip(best, right, strict=True):
                values, n = np.unique(chosen, return_counts=True)
                out.append((float(np.mean(h)), float(values[n.argmax()]), "ok"))
            return out

        def safely(name: str, some: list[tuple]) -> list[tuple]:
            try:
                return together(name, some)
            except (ValueError, np.linalg.LinAlgError) as e:
                if len(some) > 1:  # one that fails doesn't stop the rest
                    return [r for p in some for r in safely(name, [p])]
                return [(None, None, str(e)[:60])]

        out: list = [None] * len(pieces)
        for name in dict.fromkeys(p[0] for p in pieces):
            at = [n for n, p in enumerate(pieces) if p[0] == name]
            for n, r in zip(at, safely(name, [(name, pieces[n][2], pieces[n][3], pieces[n][4]) for n in at]), strict=True):
                out[n] = r
        return out

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("epoch")
        x, y, epochs, ms = np.array(g["features"].tolist()), g["y"].to_numpy(), g["epoch"].to_numpy(), float(g["ms_center"].iloc[0])
        pieces = dealt[key[2]][key[4]]
        out = [(key[0], key[1], name, key[2], tuned, key[3], ms, rep, *r) for (name, _, tuned, _, rep), r in zip(pieces, decoded(x, y, epochs, pieces), strict=True)]
        return pd.DataFrame(out, columns=[p.split()[0] for p in RESULT.split(", ")])

    sizes = F.create_map(*[F.lit(v) for dur, parts in dealt.items() for v in (dur, len(parts))]) if dealt else F.lit(None).cast("map<int,int>")
    rows = windowed.withColumn("_n", F.try_element_at(sizes, F.col("sw_dur"))).where(F.col("_n").isNotNull())
    rows = rows.withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.drop("_n").groupBy(*keys, "_share").applyInPandas(run, RESULT)


def decode_sliding(signals: DataFrame, configs: DataFrame, tmin: float, tmax: float, rate: float, step_ms: float, **params) -> DataFrame:
    """``decode_window`` on every sliding window of signals (subject, roi, epoch, y, vertex, t_s, x), of each duration of
    ``configs``: windows are averaged, their trials packed and decoded in one call. ``params`` go to ``decode_tasks``."""
    durations = sorted(r[0] for r in configs.select("sw_dur").distinct().collect())
    parts = [prepare_windowed(signals, tmin, tmax, rate, d, step_ms).withColumn("sw_dur", F.lit(d)) for d in durations]
    return decode_window(decode_tasks(reduce(DataFrame.unionByName, parts), configs, **params))


def decode_subjects(windowed: DataFrame, classifier: str, sw_dur: int, tuned: bool = False, c: float | None = None, **params) -> tuple[DataFrame, DataFrame]:
    """(results, failed): every subject decoded with one fixed configuration.

    ``results`` are those of ``decode_window``; ``failed`` has subject, roi, n_failed and reason (the first by text) of the
    subjects and regions of which some window could not be fitted, so that one bad subject doesn't stop the rest.
    """
    grid = windowed.sparkSession.createDataFrame([(classifier, sw_dur, tuned, c)], "classifier string, sw_dur int, tuned boolean, c double")
    tasks = decode_tasks(windowed, grid, **params)
    failed = tasks.where("status <> 'ok'").groupBy("subject", "roi").agg(F.countDistinct("w").alias("n_failed"), F.min("status").alias("reason"))
    return decode_window(tasks), failed


def decode_window(tasks: DataFrame) -> DataFrame:
    """Per cell: mean_list over repeats, decode_acc, modal c (the smallest on ties) and its frequency."""
    keys = ["subject", "roi", "classifier", "sw_dur", "tuned", "w", "ms"]
    ok = tasks.where("status = 'ok'")
    base = ok.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rep", "accuracy"))).alias("l"), F.avg("accuracy").alias("decode_acc"), F.count("*").alias("n"))
    modes = ok.groupBy(*keys, "c").agg(F.count("*").alias("k")).groupBy(*keys).agg(F.min(F.struct((-F.col("k")).alias("k"), "c")).alias("m"))
    return base.join(modes, keys).select(*keys, F.col("l.accuracy").alias("mean_list"), "decode_acc", F.col("m.c").alias("best_c"), (-F.col("m.k") / F.col("n")).alias("best_c_freq"))


def best_params_text(classifier: Column, c: Column, freq: Column) -> Column:
    """svm(C=0.01; C_sel=48%) style text; the classifier alone without a choice."""
    tag = F.regexp_extract(classifier_tag(F.lit("x"), c), "^x_(.*)$", 1)
    return F.when(c.isNull() | (classifier == "lda"), classifier).otherwise(F.concat(classifier, F.lit("(C="), F.replace(tag, F.lit("_"), F.lit(".")), F.lit("; C_sel="), F.bround(freq * 100).cast("int").cast("string"), F.lit("%)")))
