"""The connectivity queries without SQL against a plain recursion on residuals, all rows of the tables at 0.01, as the smallest ones
have too few trials for a fit."""

import math

import numpy as np
import pytest

from esig.catalog import QUERIES
from esig.plans.queries_connectivity import RATE, centred

TABLES = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def trials(spark):
    """subject -> trials by channels by samples of the signals that the queries start from; the names of the channels."""
    rows = centred(spark, TABLES).select("subject", "epoch", "roi", "t_idx", "x").toPandas()
    names = sorted(rows["roi"].unique())
    cubes = {}
    for subject, part in rows.groupby("subject"):
        wide = part.pivot(index="epoch", columns=["roi", "t_idx"], values="x").sort_index(axis=1)
        cubes[int(subject)] = wide.to_numpy().reshape(len(wide), len(names), -1)
    return names, cubes


def over(a, b):
    """Sum over trials and samples of the outer product of two residuals."""
    return np.einsum("eit,ejt->ij", a, b)


def fits(x, order):
    """(coefficients, residual covariance) of orders 1..order by the normalised lattice, on residuals of the raw trials."""
    e, n, t = x.shape
    root = np.linalg.cholesky
    lag = lambda k, lo: x[:, :, lo - k : t - k]
    fwd = [np.linalg.inv(root(over(lag(0, 1), lag(0, 1)) / (e * (t - 1))))]
    back = [np.linalg.inv(root(over(lag(1, 1), lag(1, 1)) / (e * (t - 1))))]
    out = []
    for m in range(order):
        lo = m + 1
        f = sum(np.einsum("ij,ejt->eit", a, lag(k, lo)) for k, a in enumerate(fwd))
        g = sum(np.einsum("ij,ejt->eit", b, lag(k + 1, lo)) for k, b in enumerate(back))
        rf, rb = root(over(f, f)), root(over(g, g))
        rho = np.linalg.inv(rf) @ over(f, g) @ np.linalg.inv(rb).T
        scale = math.sqrt(e * (t - lo))
        p, q = np.linalg.inv(root(np.eye(n) - rho @ rho.T)), np.linalg.inv(root(np.eye(n) - rho.T @ rho))
        zero = np.zeros((n, n))
        ahead = [scale * np.linalg.inv(rf) @ a for a in [*fwd, zero]]
        behind = [scale * np.linalg.inv(rb) @ b for b in [zero, *back]]
        fwd = [p @ (a - rho @ b) for a, b in zip(ahead, behind, strict=True)]
        back = [q @ (b - rho.T @ a) for a, b in zip(ahead, behind, strict=True)]
        lead = np.linalg.inv(fwd[0])
        out.append(([-lead @ a for a in fwd[1:]], lead @ lead.T))
    return out


def spectral_gc(x, order, freq):
    """(first to second, second to first) at one frequency."""
    a, sigma = fits(x, order)[-1]
    h = np.linalg.inv(np.eye(2) - sum(c * np.exp(-2j * np.pi * freq * (k + 1) / RATE) for k, c in enumerate(a)))
    s = h @ sigma @ h.conj().T
    gc = lambda i, j: max(0.0, math.log(s[j, j].real / (s[j, j].real - (sigma[i, i] - sigma[i, j] ** 2 / sigma[j, j]) * abs(h[j, i]) ** 2)))
    return gc(0, 1), gc(1, 0)


def windows(trials, win, step, order, freqs, reverse=False):
    """(subject, src, tgt, place of the window, freq) -> both directions."""
    names, cubes = trials
    out = {}
    for subject, x in cubes.items():
        for i in range(len(names)):
            for j in range(i + 1, len(names)):
                for s in range(0, x.shape[2] - win + 1, step):
                    part = x[:, [i, j], s : s + win]
                    for f in freqs:
                        out[subject, names[i], names[j], s, f] = spectral_gc(part[:, :, ::-1] if reverse else part, order, f)
    return out


def rows(spark, name, first):
    """The query's rows by subject, pair, place of the window from 0 and frequency."""
    return {(r["subject"], r["src"], r["tgt"], r["start"] - first, r["freq"]): r for r in QUERIES[name](spark, TABLES).collect()}


def test_moving_windows(spark, trials):
    want = windows(trials, 12, 6, 3, [4.0, 8.0, 12.0])
    got = rows(spark, "g8_moving_window_pairwise", 1)
    assert set(got) == set(want) and {r["status"] for r in got.values()} == {"ok"}
    assert np.allclose([(got[k]["f_xy"], got[k]["f_yx"]) for k in want], list(want.values()), rtol=1e-5, atol=1e-8)


def test_difference_from_reversed_time(spark, trials):
    ahead, back = (windows(trials, 15, 15, 2, [4.0, 8.0], r) for r in (False, True))
    want = {k: (ahead[k][0] - ahead[k][1]) - (back[k][0] - back[k][1]) for k in ahead}
    got = rows(spark, "g7_diff_trgc", 1)
    assert set(got) == set(want)
    assert np.allclose([got[k]["d_xy"] for k in want], list(want.values()), rtol=1e-5, atol=1e-8)
    assert all(r["d_yx"] == -r["d_xy"] for r in got.values())


def test_order_criteria(spark, trials):
    names, cubes = trials
    k, want = len(names), {}
    for subject, x in cubes.items():
        e, _, t = x.shape
        for p, (_, sigma) in enumerate(fits(x, 4), 1):
            det, size = math.log(np.linalg.det(sigma)), e * (t - p)
            want[subject, p] = (det + 2 * p * k * k / size, det + math.log(size) * p * k * k / size, e * t * det + k * k * p * math.log(e * t))
    got = {(r["subject"], r["p"]): (r["aic"], r["bic"], r["bic_full"]) for r in QUERIES["g3_order_criteria"](spark, TABLES).collect()}
    assert set(got) == set(want)
    assert np.allclose([got[w] for w in want], list(want.values()), rtol=1e-7)
    best = {s: min((want[s, p][2], p) for p in range(1, 5))[1] for s in cubes}
    assert {r["subject"]: r["p"] for r in QUERIES["g4_bic_order"](spark, TABLES).collect()} == best


def test_conditional(spark, trials):
    """In time the log ratio of the target's residual variances; over frequency the share of the target's own noise in the
    reduced model's innovation: its inverse transfer's row times the full model's response to that noise, negative values as 0."""
    names, cubes = trials
    freqs, time, spectral = (2.0, 6.0, 10.0), {}, {}
    for subject, x in cubes.items():
        a, sigma = fits(x, 2)[-1]
        for s, src in enumerate(names):
            keep = [i for i in range(len(names)) if i != s]
            b, gamma = fits(x[:, keep], 2)[-1]
            for at, t in enumerate(keep):
                time[subject, src, names[t]] = math.log(gamma[at, at] / sigma[t, t])
                for f in freqs:
                    turn = [np.exp(-2j * np.pi * f * k / RATE) for k in (1, 2)]
                    response = np.linalg.solve(np.eye(len(names)) - a[0] * turn[0] - a[1] * turn[1], sigma[:, t] / sigma[t, t])
                    own = np.eye(len(keep))[at] - b[0][at] * turn[0] - b[1][at] * turn[1]
                    spectral[subject, src, names[t], f] = max(0.0, math.log(gamma[at, at] / (abs(own @ response[keep]) ** 2 * sigma[t, t])))
    got = {(r["subject"], r["src"], r["tgt"]): r["f"] for r in QUERIES["g9_conditional_gc_time"](spark, TABLES).collect()}
    assert set(got) == set(time)
    assert np.allclose([got[k] for k in time], list(time.values()), rtol=1e-5, atol=1e-8)
    got = {(r["subject"], r["src"], r["tgt"], r["freq"]): r["f"] for r in QUERIES["g10_conditional_gc_spectral"](spark, TABLES).collect()}
    assert set(got) == set(spectral)
    assert np.allclose([got[k] for k in spectral], list(spectral.values()), rtol=1e-5, atol=1e-8)


def partition(full, reduced, names, s, freq):
    """Spectral measure from s to every other channel given the rest, from coefficients and covariances of both models."""
    (a, sigma), (b, gamma) = full, reduced
    keep = [i for i in range(len(names)) if i != s]
    turn = lambda k: np.exp(-2j * np.pi * freq * k / RATE)
    out = {}
    for at, t in enumerate(keep):
        response = np.linalg.solve(np.eye(len(names)) - sum(c * turn(k + 1) for k, c in enumerate(a)), sigma[:, t] / sigma[t, t])
        own = np.eye(len(keep))[at] - sum(c[at] * turn(k + 1) for k, c in enumerate(b))
        out[names[t]] = max(0.0, math.log(gamma[at, at] / (abs(own @ response[keep]) ** 2 * sigma[t, t])))
    return out


def test_conditional_windows(spark, trials):
    names, cubes = trials
    want = {}
    for subject, x in cubes.items():
        for w in range(0, x.shape[2] - 15 + 1, 5):
            part = x[:, :, w : w + 15]
            full = fits(part, 2)[-1]
            for s, src in enumerate(names):
                reduced = fits(part[:, [i for i in range(len(names)) if i != s]], 2)[-1]
                for f in (2.0, 6.0, 10.0):
                    want |= {(subject, w, src, t, f): v for t, v in partition(full, reduced, names, s, f).items()}
    got = {(r["subject"], r["start"] - 1, r["src"], r["tgt"], r["freq"]): r["f"] for r in QUERIES["g11_moving_window_conditional"](spark, TABLES).collect()}
    assert set(got) == set(want)
    assert np.allclose([got[k] for k in want], list(want.values()), rtol=1e-4, atol=1e-7)


def without(full, s, order=60):
    """(coefficients, covariance) of the process of a model without channel s: a long autoregression on its autocovariances."""
    a, sigma = full
    n, p = len(sigma), len(a)
    big = np.zeros((n * p, n * p))
    big[:n] = np.concatenate(a, axis=1)
    big[n:, : -n or None] += np.eye(n * (p - 1))
    noise = np.zeros_like(big)
    noise[:n, :n] = sigma
    cov = np.linalg.solve(np.eye((n * p) ** 2) - np.kron(big, big), noise.ravel()).reshape(n * p, n * p)
    keep, lags, state = [i for i in range(n) if i != s], [], cov
    for _ in range(order + 1):
        lags.append(state[:n, :n][np.ix_(keep, keep)])
        state = big @ state
    m = len(keep)
    block = np.zeros((m * order, m * order))
    for i in range(order):
        for j in range(order):
            block[i * m : (i + 1) * m, j * m : (j + 1) * m] = lags[j - i] if j >= i else lags[i - j].T
    right = np.concatenate([g.T for g in lags[1:]], axis=0)
    solved = np.linalg.solve(block, right)
    b = [solved[k * m : (k + 1) * m].T for k in range(order)]
    return b, lags[0] - sum(c @ g.T for c, g in zip(b, lags[1:], strict=True))


@pytest.mark.parametrize("name,win,freqs", [("g12_statespace_gc_time", 30, None), ("g13_moving_window_statespace", 15, (2.0, 6.0, 10.0))])
def test_state_space(spark, trials, name, win, freqs):
    """Without a channel the process has a model of its own, here as a long autoregression on the model's autocovariances."""
    names, cubes = trials
    want = {}
    for subject, x in cubes.items():
        for w in range(0, x.shape[2] - win + 1, win):
            full = fits(x[:, :, w : w + win], 2)[-1]
            for s, src in enumerate(names):
                reduced = without(full, s)
                keep = [i for i in range(len(names)) if i != s]
                if freqs is None:
                    want |= {(subject, w, src, names[t], None): math.log(reduced[1][at, at] / full[1][t, t]) for at, t in enumerate(keep)}
                for f in freqs or ():
                    want |= {(subject, w, src, t, f): v for t, v in partition(full, reduced, names, s, f).items()}
    got = {(r["subject"], r["start"] - 1, r["src"], r["tgt"], r["freq"]): r["f"] for r in QUERIES[name](spark, TABLES).where("status = 'ok'").collect()}
    assert set(got) == set(want)
    assert np.allclose([got[k] for k in want], list(want.values()), rtol=1e-3, atol=1e-6)


def test_wavelets(spark, trials):
    names, cubes = trials
    got = {(r["subject"], r["ci"], r["cj"], r["freq"], r["t"]): complex(r["re"], r["im"]) for r in QUERIES["g16_wavelet_csd"](spark, TABLES).collect()}
    assert len(got) == len(cubes) * len(names) ** 2 * 4 * 6
    for f in (2.0, 4.0, 6.0, 8.0):
        sd = max(f * 0.5, 3.0) / (2 * np.pi * f)
        t = np.arange(-int(4 * sd * RATE), int(4 * sd * RATE) + 1) / RATE
        k = np.exp(2j * np.pi * f * t - t * t / (2 * sd * sd))
        k /= np.sqrt((np.abs(k) ** 2).sum())
        for subject, x in cubes.items():
            z = np.array([[np.convolve(s, k)[len(k) // 2 : len(k) // 2 + len(s)][::5] for s in e] for e in x])
            cross = np.einsum("eit,ejt->ijt", z, z.conj()) / len(x)
            mine = np.array([[[got[subject, a, b, f, 5 * q] for q in range(z.shape[2])] for b in names] for a in names])
            assert np.allclose(mine, cross, rtol=1e-8, atol=1e-8 * np.abs(cross).max())


def test_order_and_window_sweep(spark, trials):
    want = {}
    for win, p in ((10, 2), (20, 2), (20, 4)):
        one = windows(trials, win, 10, p, [4.0, 8.0])
        for k in {k[:4] for k in one}:
            want[(*k, win, p)] = np.mean([one[(*k, f)][0] - one[(*k, f)][1] for f in (4.0, 8.0)])
    got = {(r["subject"], r["src"], r["tgt"], r["start"] - 1, r["win"], r["p"]): r["net"] for r in QUERIES["a13_order_window_sweep"](spark, TABLES).collect()}
    assert set(got) == set(want)
    assert np.allclose([got[k] for k in want], list(want.values()), rtol=1e-5, atol=1e-8)
