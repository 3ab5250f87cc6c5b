"""Granger measures of innovations-form state-space models (Barnett and Seth 2015). numpy only.

x(t+1) = A x(t) + K e(t), y(t) = C x(t) + e(t), cov(e) = V.
"""

from __future__ import annotations

import numpy as np


def from_var(a: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The state-space form of a VAR: the state holds the last p samples."""
    p, n = a.shape[:2]
    c = np.concatenate(list(a), axis=1)
    big = np.zeros((p * n, p * n))
    big[:n] = c
    big[n:, : (p - 1) * n] = np.eye((p - 1) * n)
    k = np.zeros((p * n, n))
    k[:n] = np.eye(n)
    return big, c, k, sigma


def riccati(a: np.ndarray, c: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(K, V) of the innovations form with state noise q, output noise r and their covariance s, by doubling.

    The cross term is removed first; each step then doubles the horizon of the recursion.
    """
    ri = np.linalg.inv(r)
    f = (a - s @ ri @ c).T
    g, h = c.T @ ri @ c, q - s @ ri @ s.T
    eye = np.eye(len(a))
    for _ in range(steps):
        w = np.linalg.inv(eye + g @ h)
        new = h + f.T @ h @ w @ f
        g = g + f @ w @ g @ f.T
        f = f @ w @ f
        done = np.abs(new - h).max() <= 1e-13 * max(1.0, np.abs(new).max())
        h = (new + new.T) / 2
        if done:
            break
    else:
        raise np.linalg.LinAlgError("no stationary solution")
    v = c @ h @ c.T + r
    return (a @ h @ c.T + s) @ np.linalg.inv(v), v


def _reduced(m: tuple, keep: list[int]) -> tuple[np.ndarray, np.ndarray]:
    a, c, k, v = m
    return riccati(a, c[keep], k @ v @ k.T, v[np.ix_(keep, keep)], k @ v[:, keep])


def time_gc(m: tuple, src: list[int], tgt: list[int]) -> float:
    """From the channels src to tgt given all others."""
    keep = [i for i in range(len(m[3])) if i not in src]
    _, vr = _reduced(m, keep)
    at = [keep.index(i) for i in tgt]
    return float(np.linalg.slogdet(vr[np.ix_(at, at)])[1] - np.linalg.slogdet(m[3][np.ix_(tgt, tgt)])[1])


def transfer(m: tuple, freqs: np.ndarray, rate: float) -> np.ndarray:
    a, c, k, v = m
    z = np.exp(2j * np.pi * np.asarray(freqs) / rate)
    return np.array([np.eye(len(v)) + c @ np.linalg.solve(w * np.eye(len(a)) - a, k) for w in z])


def spectral_gc(m: tuple, src: list[int], tgt: list[int], freqs: np.ndarray, rate: float) -> np.ndarray:
    """Spectral GC from src to tgt given all others; its mean over all frequencies is ``time_gc``."""
    a, c, k, v = m
    n = len(v)
    keep = [i for i in range(n) if i not in src]
    kr, vr = _reduced(m, keep)
    at = [keep.index(i) for i in tgt]
    other = [i for i in range(n) if i not in tgt]
    part = v[np.ix_(other, other)] - v[np.ix_(other, tgt)] @ np.linalg.inv(v[np.ix_(tgt, tgt)]) @ v[np.ix_(tgt, other)]
    root = np.linalg.cholesky((part + part.T) / 2)
    h, target = transfer(m, freqs, rate), vr[np.ix_(at, at)]
    base, out = np.linalg.slogdet(target)[1], []
    for w, hf in zip(np.exp(2j * np.pi * np.asarray(freqs) / rate), h, strict=True):
        inverse = np.eye(len(keep)) - c[keep] @ np.linalg.solve(w * np.eye(len(a)) - (a - kr @ c[keep]), kr)
        x = inverse[at] @ hf[np.ix_(keep, other)] @ root
        out.append(base - np.linalg.slogdet(target - x @ x.conj().T)[1])
    return np.maximum(np.real(out), 0)


def var_from_autocovariance(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A, Sigma) of order p from autocovariances g[k] = E x(t) x(t-k)^T, k = 0..p (block Toeplitz equations)."""
    p, n = len(g) - 1, g.shape[1]
    big = np.block([[g[j - i] if j >= i else g[i - j].T for j in range(p)] for i in range(p)])
    row = np.concatenate(list(g[1:]), axis=1)
    a = np.linalg.solve(big.T, row.T).T
    sigma = g[0] - a @ row.T
    np.linalg.cholesky((sigma + sigma.T) / 2)
    return a.reshape(n, p, n).transpose(1, 0, 2), (sigma + sigma.T) / 2
