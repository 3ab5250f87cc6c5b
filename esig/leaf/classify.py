"""Small binary classifiers and dense helpers. numpy only."""

from __future__ import annotations

import numpy as np


def standardise(train: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean, sd = train.mean(axis=0), train.std(axis=0)
    sd = np.where(sd > 0, sd, 1.0)
    return (train - mean) / sd, (test - mean) / sd


def anova_f(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """F statistic of each feature for two classes."""
    a, b = x[y == 0], x[y == 1]
    grand = x.mean(axis=0)
    between = len(a) * (a.mean(axis=0) - grand) ** 2 + len(b) * (b.mean(axis=0) - grand) ** 2
    within = ((a - a.mean(axis=0)) ** 2).sum(axis=0) + ((b - b.mean(axis=0)) ** 2).sum(axis=0)
    return np.where(within > 0, between / np.where(within > 0, within / (len(x) - 2), 1), np.where(between > 0, np.inf, 0))


def top_k(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    if k >= x.shape[1]:
        return np.arange(x.shape[1])
    return np.sort(np.argsort(-anova_f(x, y), kind="stable")[: min(k, x.shape[1])])


def pca_basis(x: np.ndarray, share: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the fewest components that reach the share of variance."""
    mean = x.mean(axis=0)
    _, s, v = np.linalg.svd(x - mean, full_matrices=False)
    total = np.cumsum(s**2) / max((s**2).sum(), 1e-300)
    return mean, v[: int(np.searchsorted(total, share - 1e-12)) + 1]


def svm(x: np.ndarray, y: np.ndarray, c: float, steps: int = 60) -> np.ndarray:
    """Weights with the intercept last: L2 penalty on all of them, squared hinge, by Newton steps on the active set."""
    z, s = np.hstack([x, np.ones((len(x), 1))]), np.where(y > 0, 1.0, -1.0)
    w = np.zeros(z.shape[1])
    loss = lambda v: 0.5 * v @ v + c * (np.maximum(0, 1 - s * (z @ v)) ** 2).sum()
    for _ in range(steps):
        m = 1 - s * (z @ w)
        on = m > 0
        g = w - 2 * c * z[on].T @ (s[on] * m[on])
        if np.abs(g).max() < 1e-8 * max(1, np.abs(w).max()):
            break
        a = z[on]
        if len(a) < len(w):  # (I + 2c A'A)^-1 g through the smaller Gram matrix
            d = g - 2 * c * a.T @ np.linalg.solve(np.eye(len(a)) + 2 * c * a @ a.T, a @ g)
        else:
            d = np.linalg.solve(np.eye(len(w)) + 2 * c * a.T @ a, g)
        step, now = 1.0, loss(w)
        while loss(w - step * d) > now - 1e-4 * step * (g @ d) and step > 1e-8:
            step /= 2
        w = w - step * d
    return w


def ledoit_wolf(x: np.ndarray) -> np.ndarray:
    """Covariance shrunk toward the scaled identity by the analytic coefficient."""
    n, p = x.shape
    x = x - x.mean(axis=0)
    s = x.T @ x / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = min(d2, (((x**2).T @ x**2).sum() / n - (s**2).sum()) / (n * p)) if n else 0
    k = b2 / d2 if d2 > 0 else 0.0
    return (1 - k) * s + k * mu * np.eye(p)


def _shrinkage(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(centred rows, shrinkage, target) of ``ledoit_wolf`` without the covariance itself: its square sum is that of the rows'
    products."""
    n, p = x.shape
    x = x - x.mean(axis=0)
    power = (x * x).sum(axis=1)
    mu, square = power.sum() / n / p, ((x @ x.T) ** 2).sum() / n**2
    d2 = (square - p * mu * mu) / p
    b2 = min(d2, ((power**2).sum() / n - square) / (n * p))
    return x, b2 / d2 if d2 > 0 else 0.0, mu


def lda(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights with the intercept last: class covariances shrunk on standardised data, weighted by class share.

    With more features than trials the covariance is a multiple of the unit matrix and a product of few rows, and its
    system is solved in the space of the trials.
    """
    sd = x.std(axis=0)
    sd = np.where(sd > 0, sd, 1.0)
    means, share, rows, ridge = [], [], [], 0.0
    for k in (0, 1):
        part = x[y == k]
        share.append(len(part) / len(x))
        means.append(part.mean(axis=0))
        if x.shape[1] > len(x):
            z, shrunk, mu = _shrinkage(part / sd)
            rows.append(z * np.sqrt(share[k] * (1 - shrunk) / len(part)))
            ridge += share[k] * shrunk * mu
    if ridge > 1e-12:
        b, v = np.concatenate(rows), (np.array(means) / sd).T
        coef = (v - b.T @ np.linalg.solve(ridge * np.eye(len(b)) + b @ b.T, b @ v)) / ridge / sd[:, None]
    else:
        cov = sum(share[k] * (ledoit_wolf(x[y == k] / sd) * np.outer(sd, sd)) for k in (0, 1))
        coef = np.linalg.lstsq(cov, np.array(means).T, rcond=None)[0]
    bias = [-0.5 * means[k] @ coef[:, k] + np.log(share[k]) for k in (0, 1)]
    return np.append(coef[:, 1] - coef[:, 0], bias[1] - bias[0])


def logistic(x: np.ndarray, y: np.ndarray, c: float, l1: float = 0.1, steps: int = 400) -> np.ndarray:
    """Elastic-net weights, free intercept last: accelerated proximal gradient on sum of losses plus penalty / c."""
    z, s = np.hstack([x, np.ones((len(x), 1))]), np.where(y > 0, 1.0, -1.0)
    rate = 1 / (0.25 * np.linalg.norm(z, 2) ** 2 + (1 - l1) / c)
    w = v = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(steps):
        g = -z.T @ (s / (1 + np.exp(np.clip(s * (z @ v), -30, 30))))
        g[:-1] += (1 - l1) / c * v[:-1]
        new = v - rate * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * l1 / c, 0)
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, moved = new + (t - 1) / u * (new - w), np.abs(new - w).max()
        w, t = new, u
        if moved < 1e-9:
            break
    return w


def fit(name: str, x: np.ndarray, y: np.ndarray, c: float) -> np.ndarray:
    return svm(x, y, c) if name == "svm" else lda(x, y) if name == "lda" else logistic(x, y, c)


#: Features up to which fits are solved together, and doubles that a block of them holds in products of features.
MANY_WIDTH, MANY_HELD = 24, 2_000_000


def _stacked(xs: list[np.ndarray], ys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a one at the end, (fits, rows, features + 1), and signs of labels; rows that fill up have sign 0."""
    rows = max(map(len, xs))
    z, s = np.zeros((len(xs), rows, xs[0].shape[1] + 1)), np.zeros((len(xs), rows))
    for k, (x, y) in enumerate(zip(xs, ys, strict=True)):
        z[k, : len(x), :-1], z[k, : len(x), -1] = x, 1.0
        s[k, : len(x)] = np.where(y > 0, 1.0, -1.0)
    return z, s


def _products(z: np.ndarray) -> np.ndarray:
    return (z[..., :, None] * z[..., None, :]).reshape(*z.shape[:2], -1)


def _svm_many(z: np.ndarray, s: np.ndarray, c: np.ndarray, steps: int = 60) -> np.ndarray:
    """``svm`` of every fit and every c (fits, values) at once."""
    q, zt, zz, s = z.shape[2], z.transpose(0, 2, 1), _products(z), s[:, None]
    w, c1 = np.zeros((*c.shape, q)), c[..., None]
    slack = lambda v: np.where(s != 0, np.maximum(0, 1 - s * (v @ zt)), 0.0)
    loss = lambda v: 0.5 * (v * v).sum(axis=-1) + c * (slack(v) ** 2).sum(axis=-1)
    for _ in range(steps):
        m = slack(w)
        g = w - 2 * c1 * ((s * m) @ z)
        live = np.abs(g).max(axis=-1) >= 1e-8 * np.maximum(1, np.abs(w).max(axis=-1))
        if not live.any():
            break
        h = np.eye(q) + 2 * c1[..., None] * ((m > 0).astype(float) @ zz).reshape(*c.shape, q, q)
        d = np.linalg.solve(h, g[..., None])[..., 0]
        down, now, step = (g * d).sum(axis=-1), loss(w), live.astype(float)
        while (far := live & (loss(w - step[..., None] * d) > now - 1e-4 * step * down) & (step > 1e-8)).any():
            step[far] /= 2
        w = w - step[..., None] * d
    return w


def _logistic_many(z: np.ndarray, s: np.ndarray, c: np.ndarray, l1: float = 0.1, steps: int = 60) -> np.ndarray:
    """The optimum of ``logistic`` of every fit and every c (fits, values) at once.

    Newton steps among the weights that aren't 0 or are drawn away from it, each kept on its side of 0; should fits remain
    after half of the steps, theirs are minima of the quadratic model and the penalty by coordinate descent.
    """
    q, zt, zz, s = z.shape[2], z.transpose(0, 2, 1), _products(z), s[:, None]
    real, free = np.abs(s), np.r_[np.ones(q - 1), 0.0]
    flat, edge = (1 - l1) / c[..., None] * free, l1 / c[..., None] * free
    w, d = np.zeros((*c.shape, q)), np.zeros((*c.shape, q))
    u = s * (w @ zt)

    def loss(v: np.ndarray, u: np.ndarray) -> np.ndarray:
        return (real * (np.log1p(np.exp(-np.abs(u))) - np.minimum(u, 0))).sum(axis=-1) + (0.5 * flat * v * v + edge * np.abs(v)).sum(axis=-1)

    now = loss(w, u)
    for turn in range(steps):
        miss = 1 / (1 + np.exp(np.minimum(u, 700)))
        g = flat * w - (s * miss) @ z
        side = np.where(w != 0, np.sign(w), -np.sign(g))
        slope = np.where((w != 0) | (np.abs(g) > edge), g + edge * side, 0.0)
        live = np.abs(slope).max(axis=-1) >= 1e-9
        if not live.any():
            break
        h = ((real * miss * (1 - miss)) @ zz).reshape(*c.shape, q, q) + (flat + 1e-12)[..., None] * np.eye(q)
        if turn < steps // 2:
            on = ((w != 0) | (slope != 0)).astype(float)
            d = -np.linalg.solve(h * on[..., None] * on[..., None, :] + (1 - on)[..., None] * np.eye(q), slope[..., None])[..., 0]
            held = (free != 0) & (on != 0)
        else:
            d, hd, own, held = np.zeros_like(w), np.zeros_like(w), np.diagonal(h, axis1=-2, axis2=-1), False
            for _ in range(1000):
                most = 0.0
                for j in range(q):
                    v = own[..., j] * (w[..., j] + d[..., j]) - g[..., j] - hd[..., j]
                    move = np.sign(v) * np.maximum(np.abs(v) - edge[..., j], 0) / own[..., j] - w[..., j] - d[..., j]
                    d[..., j] += move
                    hd += h[..., j] * move[..., None]
                    most = max(most, np.abs(move[live]).max(initial=0.0))
                if not most >= 1e-12:
                    break
        step = live.astype(float)
        while True:
            v = w + step[..., None] * d
            v = np.where(held & (v * side < 0), 0.0, v)
            u = s * (v @ zt)
            new = loss(v, u)
            far = live & (new > now + 1e-4 * (slope * (v - w)).sum(axis=-1) + 1e-13 * np.abs(now)) & (step > 1e-8)
            if not far.any():
                break
            step[far] /= 2
        w, now = v, new
    return w


def fit_many(name: str, xs: list[np.ndarray], ys: list[np.ndarray], c: np.ndarray) -> list[np.ndarray]:
    """The weights of ``fit`` for every data set and each of its values of c (data sets, values): an array (values, features
    + 1) for each. Data sets of few features are solved together, as one stack of matrices of each width."""
    out: list = [None] * len(xs)
    widths: dict[int, list[int]] = {}
    for k, x in enumerate(xs):
        widths.setdefault(x.shape[1], []).append(k)
    for width, at in widths.items():
        if name == "lda" or width > MANY_WIDTH:
            for k in at:
                out[k] = np.array([fit(name, xs[k], ys[k], v) for v in c[k]])
            continue
        size = max(1, MANY_HELD // (max(len(xs[k]) for k in at) * max((width + 1) ** 2, 2 * c.shape[1])))
        for i in range(0, len(at), size):
            part = at[i : i + size]
            w = (_svm_many if name == "svm" else _logistic_many)(*_stacked([xs[k] for k in part], [ys[k] for k in part]), c[part])
            for k, v in zip(part, w, strict=True):
                out[k] = v
    return out


def predict(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (x @ w[:-1] + w[-1] > 0).astype(int)


def leading(gram: np.ndarray, k: int = 1) -> np.ndarray:
    """(k, n) leading eigenvectors of a symmetric matrix, each with its largest loading positive."""
    v = np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1][:, :k].T
    at = np.abs(v).round(12).argmax(axis=1)
    return v * np.sign(v[np.arange(len(v)), at])[:, None]
