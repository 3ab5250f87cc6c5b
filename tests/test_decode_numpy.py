"""The decoding queries against a plain version on the given tables: folds dealt with dictionaries, windows averaged by numpy,
classifiers solved by other ways than the library's."""

import hashlib
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from esig.catalog import QUERIES

TABLES = "/root/testdata/sf0.001"
CS = (0.01, 0.1, 1.0, 10.0)


@pytest.fixture(scope="module")
def cells():
    """(subject, roi) -> (trial ids, labels, trials by vertices by samples): 200 vectors to a subject, 8 vertices of 8 samples."""
    e = pd.read_parquet(f"{TABLES}/embeddings.parquet").sort_values("vec_id")
    x = np.array([np.asarray(v, dtype=float) for v in e["embedding"]]).reshape(len(e), 8, 8)
    ids, y = e["vec_id"].to_numpy(), (e["label"].to_numpy() >= 5).astype(int)
    out = {}
    for s in np.unique(ids // 200):
        at = ids // 200 == s
        out[int(s), "front"], out[int(s), "back"] = (ids[at], y[at], x[at, :4]), (ids[at], y[at], x[at, 4:])
    return out


def views(x, ms):
    """Window number -> (centre in ms, trials by vertices): means of ``ms`` at 100 Hz, every 20 ms."""
    n = round(ms / 10)
    return {w: (s * 10 + (n - 1) * 5.0, x[:, :, s : s + n].mean(axis=2)) for w, s in enumerate(range(0, x.shape[2] - n + 1, 2))}


def folds(ids, y, rep, k):
    fold = {}
    for c in (0, 1):
        mine = sorted((hashlib.md5(f"{rep}:{i}".encode()).hexdigest(), i) for i, v in zip(ids, y, strict=True) if v == c)
        fold |= {i: place % k for place, (_, i) in enumerate(mine)}
    return np.array([fold[i] for i in ids])


def scaled(a, b):
    m, s = a.mean(axis=0), np.sqrt(((a - a.mean(axis=0)) ** 2).mean(axis=0))
    return (a - m) / s, (b - m) / s


def descend(z, gradient, steepness, steps=20_000, shrink=lambda w: w):
    """Weights at which a convex function is least, by plain (proximal) gradient steps."""
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        new = shrink(w - gradient(w) / steepness)
        if np.abs(new - w).max() < 1e-13:
            break
        w = new
    return w


def svm(x, y, c):
    z, s = np.c_[x, np.ones(len(x))], 2.0 * y - 1
    return descend(z, lambda w: w - 2 * c * (s * np.maximum(0, 1 - s * (z @ w))) @ z, 1 + 2 * c * np.linalg.eigvalsh(z.T @ z)[-1])


def logistic(x, y, c):
    """Sum of losses + (0.45 |w|^2 + 0.1 |w|_1) / c without the intercept."""
    z, free = np.c_[x, np.ones(len(x))], np.r_[np.ones(x.shape[1]), 0]
    top = 0.25 * np.linalg.eigvalsh(z.T @ z)[-1] + 0.9 / c
    soft = lambda w: np.sign(w) * np.maximum(np.abs(w) - 0.1 / c / top * free, 0)
    return descend(z, lambda w: (1 / (1 + np.exp(-(z @ w))) - y) @ z + 0.9 / c * free * w, top, shrink=soft)


def lda(x, y):
    """Pooled covariance of classes, each shrunk toward a multiple of the unit matrix by the mean squared error of its own
    entries, summed trial by trial."""
    sd = x.std(axis=0)
    means, priors, pooled = [], [], 0
    for c in (0, 1):
        v = x[y == c] / sd
        v = v - v.mean(axis=0)
        n, p = v.shape
        s = sum(np.outer(r, r) for r in v) / n
        mu = np.trace(s) / p
        far = ((s - mu * np.eye(p)) ** 2).sum()
        noise = min(far, sum(((np.outer(r, r) - s) ** 2).sum() for r in v) / n**2)
        k = noise / far
        means.append(x[y == c].mean(axis=0))
        priors.append(n / len(x))
        pooled = pooled + n / len(x) * np.diag(sd) @ ((1 - k) * s + k * mu * np.eye(p)) @ np.diag(sd)
    w = np.linalg.solve(pooled, means[1] - means[0])
    return np.append(w, math.log(priors[1] / priors[0]) - 0.5 * (means[0] + means[1]) @ w)


def share_right(name, c, a, y, b, truth, pca=False):
    a, b = scaled(a, b)
    if pca:
        m = a.mean(axis=0)
        value, vector = np.linalg.eigh(np.cov(a.T, bias=True))
        value, vector = value[::-1], vector[:, ::-1]
        n = 1 + int((np.cumsum(value) / value.sum() < 0.95 - 1e-12).sum())
        a, b = (a - m) @ vector[:, :n], (b - m) @ vector[:, :n]
    w = lda(a, y) if name == "lda" else svm(a, y, c) if name == "svm" else logistic(a, y, c)
    return float((((b @ w[:-1] + w[-1]) > 0) == (truth == 1)).mean())


def decoded(ids, y, x, name, tuned, pca=False, repeats=5):
    """(mean accuracy of every repeat, modal c, its share of the repeats)"""
    accuracies, chosen = [], []
    for rep in range(repeats):
        fold, hits, best = folds(ids, y, rep, 5), [], []
        for f in range(5):
            tr, te = fold != f, fold == f
            c = {"svm": 0.01, "logistic": 0.1}.get(name, 1.0)
            if tuned:
                part = folds(ids[tr], y[tr], 100 + rep, 3)
                score = [np.mean([share_right(name, v, x[tr][part != i], y[tr][part != i], x[tr][part == i], y[tr][part == i]) for i in range(3)]) for v in CS]
                c = CS[int(np.argmax(np.round(score, 12)))]
            hits.append(share_right(name, c, x[tr], y[tr], x[te], y[te], pca))
            best.append(c)
        accuracies.append(np.mean(hits))
        chosen.append(min(Counter(best).items(), key=lambda b: (-b[1], b[0]))[0])
    c, n = min(Counter(chosen).items(), key=lambda b: (-b[1], b[0]))
    return accuracies, c, n / repeats


def compare(spark, cells, query, configs, **how):
    """Every row of the query is the plain version's, and none is missing."""
    got = {(r.subject, r.roi, r.classifier, r.sw_dur, r.tuned, r.w): r for r in QUERIES[query](spark, TABLES).collect()}
    keys = set()
    for (subject, roi), (ids, y, x) in cells.items():
        if min((y == 0).sum(), (y == 1).sum()) < 5:
            continue
        for name, ms, tuned in configs:
            for w, (centre, v) in views(x, ms).items():
                key = (subject, roi, name, ms, tuned, w)
                keys.add(key)
                accuracies, c, share = decoded(ids, y, v, name, tuned, **how)
                assert got[key].ms == pytest.approx(centre)
                assert got[key].mean_list == pytest.approx(accuracies, abs=1e-12), key
                assert got[key].decode_acc == pytest.approx(np.mean(accuracies), abs=1e-12)
                assert (got[key].best_c, got[key].best_c_freq) == (c, share), key
    assert keys and set(got) == keys


def test_fixed_windows(spark, cells):
    compare(spark, cells, "d10_decode_window", [("svm", 40, False), ("lda", 40, False)])


def test_principal_components(spark, cells):
    compare(spark, cells, "d5_decode_pca", [("svm", 40, False), ("lda", 40, False)], pca=True)


def test_sliding_windows(spark, cells):
    compare(spark, cells, "d11_decode_sliding", [("lda", 20, False), ("lda", 40, False)])


def test_sweep_with_choice_of_c(spark, cells):
    compare(spark, cells, "d12_decode_sweep", [(name, ms, tuned) for name in ("svm", "logistic") for ms in (20, 40) for tuned in (False, True)])


def test_subjects(spark, cells):
    got = {(r.subject, r.roi): r for r in QUERIES["d13_decode_subjects"](spark, TABLES).collect()}
    assert set(got) == set(cells)
    for key, (ids, y, x) in cells.items():
        w = views(x, 40)
        assert got[key].n_windows == len(w) and got[key].n_failed is None
        assert got[key].mean_acc == pytest.approx(np.mean([np.mean(decoded(ids, y, v, "svm", False)[0]) for _, v in w.values()]), abs=1e-12)
