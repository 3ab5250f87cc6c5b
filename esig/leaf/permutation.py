"""Sign-flip permutation statistics of one group: all sign patterns at once, as columns of a matrix. numpy only."""

from __future__ import annotations

import hashlib

import numpy as np


def signs(subjects: list, permutations: int, seed: int = 0) -> np.ndarray:
    """(permutations, subjects) of +1 and -1 by the MD5 of seed, pattern and subject; the first pattern is the observed one."""
    out = np.ones((permutations, len(subjects)))
    odd = {d: -1.0 if k % 2 == 0 else 1.0 for k, d in enumerate("0123456789abcdef")}
    for k, s in enumerate(subjects):
        out[1:, k] = [odd[hashlib.md5(f"{seed}:{p}:{s}".encode()).hexdigest()[0]] for p in range(1, permutations)]
    return out


def t_statistics(values: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """One-sample t of ``values`` under each sign pattern; 0 without spread. Squares don't change with signs."""
    return t_of_sums(len(values), flips @ values, float(values @ values))


def t_of_sums(n: int, s: np.ndarray, ss: float) -> np.ndarray:
    """The same from the number of values, their sum under each pattern and the sum of their squares."""
    if n < 2:
        return np.zeros(len(s))
    var = (ss - s * s / n) / (n - 1)
    with np.errstate(all="ignore"):
        return np.where(var > 0, (s / n) / np.sqrt(np.where(var > 0, var, 1) / n), 0.0)


def clusters(stat: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(column, first row, last row, mass) of every run of rows over ``threshold`` in the columns of ``stat`` (times, patterns)."""
    on = np.zeros((stat.shape[1], stat.shape[0] + 2), bool)
    on[:, 1:-1] = (stat > threshold).T
    edge = np.diff(on.astype(np.int8), axis=1)
    col, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    if not len(col):
        return col, first, last, np.zeros(0)
    flat = np.concatenate([stat, np.zeros((1, stat.shape[1]))]).T.ravel()  # a zero ends each column, so that runs don't meet
    width = stat.shape[0] + 1
    bounds = np.stack([col * width + first, col * width + last + 1], axis=1).ravel()
    return col, first, last, np.round(np.add.reduceat(flat, bounds)[::2], 9)


def p_of_largest(seen: np.ndarray, largest: np.ndarray) -> np.ndarray:
    """Share of patterns whose largest score reaches each of ``seen``; patterns without any have minus infinity."""
    return (len(largest) - np.searchsorted(np.sort(largest), seen, side="left")) / len(largest)


def cluster_test(stat: np.ndarray, threshold: float) -> list[tuple[int, int, float, float]]:
    """(first row, last row, mass, p) of the clusters of the first column."""
    col, first, last, mass = clusters(stat, threshold)
    top = np.full(stat.shape[1], -np.inf)
    np.maximum.at(top, col, mass)
    own = col == 0
    return list(zip(first[own].tolist(), last[own].tolist(), mass[own].tolist(), p_of_largest(mass[own], top).tolist(), strict=True))


def tfce(stat: np.ndarray, step: float) -> np.ndarray:
    """Threshold-free scores of every time under every pattern: the sum over heights h = step, 2 step, ... up to the
    statistic of sqrt(extent) * h^2 * step, where extent is the length of the run at or over h that holds the time.

    The component tree of a column: a time's component at its own height reaches to the nearest lower times on either
    side, and its parent is the higher of these two. Between its height and its parent's the extent stays the same, so the
    score is the parent's and one product more. All columns go along together; work is linear in times and patterns.
    """
    times, patterns = stat.shape
    level = np.floor(np.maximum(stat, 0) / step)
    level = np.maximum(level - (level * step > stat), 0).astype(np.int64)
    padded = np.full((times + 2, patterns), -1)
    padded[1:-1] = level
    cols = np.arange(patterns)
    sides = []
    for back in (True, False):
        near = np.zeros((times + 2, patterns), np.int64)
        for i in range(1, times + 1) if back else range(times, 0, -1):
            at = np.full(patterns, i - 1 if back else i + 1)
            while (high := padded[at, cols] >= padded[i]).any():
                at[high] = near[at[high], cols[high]]
            near[i] = at
        sides.append(near)
    left, right = sides
    parent = np.where(padded[left, cols] >= padded[right, cols], left, right)
    heights = np.concatenate([[0.0], np.cumsum((np.arange(1, level.max(initial=0) + 1) * step) ** 2 * step)])
    own = heights[np.maximum(padded, 0)] - heights[np.maximum(padded[parent, cols], 0)]
    gain = np.sqrt(np.maximum(right - left - 1, 0)) * own
    score = np.zeros((times + 2, patterns))
    order = np.argsort(padded[1:-1], axis=0, kind="stable") + 1
    for i in order:  # parents are lower, so they come first
        score[i, cols] = gain[i, cols] + score[parent[i, cols], cols]
    return np.where(stat > 0, score[1:-1], 0.0)


def tfce_test(stat: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the first column and the share of patterns whose largest score reaches each."""
    part, power = np.frexp(tfce(stat, step))
    score = np.ldexp(np.round(part * (1 << 30)), power - 30)  # to 30 bits, so that scores that are equal but for rounding tie
    return score[:, 0], p_of_largest(score[:, 0], score.max(axis=0))
