"""Stable autoregressive systems with known directions, made from poles and links and driven by seeded noise."""

import numpy as np


def run(coefficients, mixing, trials, samples, seed):
    """(trials, n, samples) of x(t) = sum_k A_k x(t - k) + M e(t), from rest and after as many samples as the slowest mode
    takes to fade to a millionth."""
    a, p = np.asarray(coefficients, dtype=float), len(coefficients)
    n = a.shape[1]
    companion = np.eye(n * p, k=-n)
    companion[:n] = np.concatenate(list(a), axis=1)
    slowest = np.abs(np.linalg.eigvals(companion)).max()
    assert slowest < 1, "not stable"
    fade = int(np.ceil(np.log(1e-6) / np.log(max(slowest, 0.1)))) + p
    noise = np.random.default_rng(seed).standard_normal((samples + fade, trials, n)) @ np.asarray(mixing, dtype=float).T
    state = np.zeros((trials, n * p))
    out = []
    for e in noise:
        state = state @ companion.T
        state[:, :n] += e
        out.append(state[:, :n].copy())
    return np.array(out[fade:]).transpose(1, 2, 0)


def network(trials, samples, links, n=2, own=0.45, seed=0):
    """Channels with one real pole each and links (from, to, weight) at lag 1."""
    a = own * np.eye(n)
    for source, target, weight in links:
        a[target, source] = weight
    return run([a], np.eye(n), trials, samples, seed)


def ar2(trials, samples, seed=0):
    """Two channels that ring at poles 0.55 e^(+-i) and 0.4 e^(+-0.7i), the first drives the second, and their noise is mixed."""
    first, second = np.zeros((2, 2)), np.zeros((2, 2))
    for k, (radius, angle) in enumerate(((0.55, 1.0), (0.4, 0.7))):
        first[k, k], second[k, k] = 2 * radius * np.cos(angle), -(radius**2)
    first[1, 0] = 0.35
    mixing = np.array([[1.0, 0.0], [0.3, 0.8]])
    return run([first, second], mixing, trials, samples, seed), first, second, mixing @ mixing.T


def packed(spark, x, names="abcdefgh"):
    rows = [(0, [names[i] for i in range(x.shape[1])], [[float(v) for v in s] for s in trial]) for trial in x]
    return spark.createDataFrame(rows, "subject bigint, chans array<string>, xs array<array<double>>").repartition(4)


def long(spark, x, names="abcdefgh"):
    rows = [(0, e, e % 2, names[i], t, float(x[e, i, t])) for e in range(x.shape[0]) for i in range(x.shape[1]) for t in range(x.shape[2])]
    return spark.createDataFrame(rows, "subject bigint, epoch bigint, y int, roi string, t_idx int, x double")
