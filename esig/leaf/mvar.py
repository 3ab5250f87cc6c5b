"""Multichannel autoregression from second moments, and spectral Granger measures. numpy only.

Moments are C[a, b] = sum over trials of x(a) x(b)^T. A fit of order p needs them only for |a - b| <= p, so that they are
kept as a band of p + 1 diagonals of n x n blocks. The model is x(t) = sum_k A_k x(t - k) + e(t).
"""

from __future__ import annotations

import numpy as np


def _root(s: np.ndarray) -> np.ndarray:
    return np.linalg.cholesky((s + s.T) / 2)


class Band:
    """Diagonals d = 0, 1, ... of moments over ``size`` samples, ``diagonals[d][t]`` = C[t, t - d], and their running sums.

    The sum over any window is the difference of two of these, so windows share one band.
    """

    def __init__(self, diagonals: list[np.ndarray]):
        self.diagonals, self.size = diagonals, len(diagonals[0])
        self.sums = [np.concatenate([np.zeros((1, *d.shape[1:])), np.cumsum(d, axis=0)]) for d in diagonals]

    @classmethod
    def dense(cls, c: np.ndarray, order: int) -> Band:
        """Of moments as one array (T, T, n, n)."""
        t = np.arange(len(c))
        return cls([np.where((t >= d)[:, None, None], c[t, np.maximum(t - d, 0)], 0.0) for d in range(min(order, len(c) - 1) + 1)])

    def reversed(self) -> Band:
        """Of the samples in reverse: C'[a, b] = C[T - 1 - a, T - 1 - b]."""
        out = []
        for d, x in enumerate(self.diagonals):
            y = np.zeros_like(x)
            y[d:] = np.swapaxes(x[d:][::-1], 1, 2)
            out.append(y)
        return Band(out)

    def take(self, keep: list[int]) -> Band:
        return Band([d[:, keep][:, :, keep] for d in self.diagonals])


def lwr_orders(c: Band | np.ndarray, trials: int, order: int, start: int = 0, size: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{p: (A of shape (p, n, n), Sigma)} for p = 1..order by Morf's normalised multichannel recursion, on the ``size``
    samples from ``start`` on.

    At stage m the forward residual at t and the backward residual at t - m are linear in the last m + 1 samples, so
    their sums over t and trials come from C alone, with the residuals' coefficients as weights.
    """
    band = c if isinstance(c, Band) else Band.dense(c, order)
    size, n = band.size - start if size is None else size, band.diagonals[0].shape[1]
    if order >= size:
        raise np.linalg.LinAlgError("order not below window length")

    def total(lo: int, hi: int, i: int, j: int) -> np.ndarray:
        """Sum of C[t - i, t - j] over lo <= t < hi of the window, for j >= i."""
        if hi <= lo or j - i >= len(band.sums):
            return np.zeros((n, n))
        return band.sums[j - i][start + hi - i] - band.sums[j - i][start + lo - i]

    head, tail = total(1, size, 0, 0), total(0, size - 1, 0, 0)
    # Normalised forward (a) and backward (b) prediction filters, coefficient k on sample t - k.
    a, b = [np.linalg.inv(_root(head / (trials * (size - 1))))], [np.linalg.inv(_root(tail / (trials * (size - 1))))]
    out = {}
    for m in range(order):
        lo = m + 1
        width = m + 2
        s = np.zeros((width * n, width * n))
        for i in range(width):
            for j in range(i, width):
                block = total(lo, size, i, j)
                s[i * n : (i + 1) * n, j * n : (j + 1) * n] = block
                s[j * n : (j + 1) * n, i * n : (i + 1) * n] = block.T
        f = np.concatenate([*a, np.zeros((n, n))], axis=1)
        g = np.concatenate([np.zeros((n, n)), *b], axis=1)
        pf, pb, pfb = f @ s @ f.T, g @ s @ g.T, f @ s @ g.T
        rf, rb = _root(pf), _root(pb)
        rho = np.linalg.solve(rf, pfb) @ np.linalg.inv(rb).T
        p, q = np.linalg.inv(_root(np.eye(n) - rho @ rho.T)), np.linalg.inv(_root(np.eye(n) - rho.T @ rho))
        # Scale by the residuals' own covariance of this stage, so that filters keep unit residuals.
        count = trials * (size - lo)
        f, g = np.linalg.solve(rf, f) * np.sqrt(count), np.linalg.solve(rb, g) * np.sqrt(count)
        new_f, new_g = p @ (f - rho @ g), q @ (g - rho.T @ f)
        a = [new_f[:, k * n : (k + 1) * n] for k in range(width)]
        b = [new_g[:, k * n : (k + 1) * n] for k in range(width)]
        lead = np.linalg.inv(a[0])
        out[m + 1] = (np.array([-lead @ x for x in a[1:]]), lead @ lead.T)
    return out


def lwr(c: Band | np.ndarray, trials: int, order: int, start: int = 0, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    return lwr_orders(c, trials, order, start, size)[order]


def transfer(a: np.ndarray, freqs: np.ndarray, rate: float) -> np.ndarray:
    """H(f) of shape (f, n, n)."""
    z = np.exp(-2j * np.pi * np.outer(freqs, np.arange(1, len(a) + 1)) / rate)
    return np.linalg.inv(np.eye(a.shape[1]) - np.einsum("fk,kij->fij", z, a))


def spectrum(h: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    return h @ sigma @ np.conj(np.swapaxes(h, 1, 2))


def geweke(a: np.ndarray, sigma: np.ndarray, freqs: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(first to second, second to first) spectral GC of a two-channel model; not finite counts as 0."""
    h = transfer(a, freqs, rate)
    s = spectrum(h, sigma)
    out = []
    for x, y in ((0, 1), (1, 0)):
        own = s[:, y, y].real
        part = sigma[x, x] - sigma[x, y] ** 2 / sigma[y, y]
        with np.errstate(all="ignore"):
            v = np.log(own / (own - part * np.abs(h[:, y, x]) ** 2))
        out.append(np.maximum(np.where(np.isfinite(v), v, 0), 0))
    return out[0], out[1]


def conditional_spectral(full: tuple, reduced: tuple, src: int, tgt: int, freqs: np.ndarray, rate: float) -> np.ndarray:
    """Spectral GC from src to tgt given all others: both models normalised to independent target noise, the reduced
    one's transfer inverted and applied to the full one's (partition method); not finite or negative counts as 0."""
    (a, sigma), (b, gamma) = full, reduced
    n = len(sigma)
    rest = [i for i in range(n) if i not in (src, tgt)]
    order = [tgt, src, *rest]
    h = transfer(a, freqs, rate)[:, order][:, :, order]
    sig = sigma[np.ix_(order, order)]
    keep = [i for i in range(n) if i != src]
    at = [keep.index(tgt), *[keep.index(i) for i in rest]]
    g = transfer(b, freqs, rate)[:, at][:, :, at]
    gam = gamma[np.ix_(at, at)]
    ht, st = _decorrelate(h, sig, [[0], [1], list(range(2, n))])
    gt, rt = _decorrelate(g, gam, [[0], list(range(1, n - 1))])
    wide = np.zeros((len(freqs), n, n), complex)
    others = [0, *range(2, n)]
    wide[np.ix_(range(len(freqs)), others, others)] = gt
    wide[:, 1, 1] = 1
    q = np.linalg.solve(wide, ht)
    own = np.abs(q[:, 0, 0]) ** 2 * st[0, 0]
    with np.errstate(all="ignore"):
        v = np.log(rt[0, 0] / own)
    return np.maximum(np.where(np.isfinite(v), v, 0), 0)


def _decorrelate(h: np.ndarray, sigma: np.ndarray, blocks: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Transfer and noise after regressing each block's noise out of the later ones."""
    p, s = np.eye(len(sigma)), sigma.copy()
    for k, block in enumerate(blocks[:-1]):
        later = [i for x in blocks[k + 1 :] for i in x]
        if not later:
            continue
        step = np.eye(len(sigma))
        step[np.ix_(later, block)] = -s[np.ix_(later, block)] @ np.linalg.inv(s[np.ix_(block, block)])
        s = step @ s @ step.T
        p = step @ p
    return h @ np.linalg.inv(p), s
