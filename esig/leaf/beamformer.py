"""Spatial filters of vertices with three orientations from covariances. numpy only."""

from __future__ import annotations

import numpy as np


def whitener(noise: np.ndarray, rank: int | None = None, floor: float = 1e-10) -> np.ndarray:
    """(rank, channels): the root of the inverse of a covariance on its own range; the rank is that of the eigenvalues over
    ``floor`` of the largest unless it is given."""
    e, v = np.linalg.eigh((noise + noise.T) / 2)
    order = np.argsort(e)[::-1]
    e, v = e[order], v[:, order]
    rank = int((e > floor * e[0]).sum()) if rank is None else rank
    return (v[:, :rank] / np.sqrt(e[:rank])).T


def max_power(gain: np.ndarray, data: np.ndarray, noise: np.ndarray, reg: float = 0.05, rank: int | None = None, keep: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(filters (vertices, channels), orientations (vertices, 3)) of ``gain`` (vertices, channels, 3).

    In whitened data with covariance C, regularised by ``reg`` of its mean eigenvalue, the filter of orientation o is along
    C^-1 G o, scaled to unit noise. o maximises its output power, a generalised eigenproblem of 3 x 3 matrices that is
    solved for all vertices at once, in the ``keep`` leading directions of each whitened gain. The largest component of o
    is positive.
    """
    w = whitener(noise, rank)
    c = w @ data @ w.T
    inverse = np.linalg.inv(c + reg * np.trace(c) / len(c) * np.eye(len(c)))
    g = w @ gain
    u, s, vt = np.linalg.svd(g, full_matrices=False)
    u, s, vt = u[:, :, :keep], s[:, :keep], vt[:, :keep]
    fine = s > 1e-12 * s[:, :1]
    # In the basis u of a gain's range: top = u' C^-1 u and size = u' C^-2 u; a direction it lacks gets no power.
    cu = inverse @ u
    top, size = np.swapaxes(u, 1, 2) @ cu, np.swapaxes(cu, 1, 2) @ cu
    both = fine[:, :, None] & fine[:, None, :]
    top, size = np.where(both, top, 0.0), np.where(both, size, np.eye(u.shape[2]))
    root = np.linalg.inv(np.linalg.cholesky(size))
    q = np.linalg.eigh(root @ top @ np.swapaxes(root, 1, 2))[1][:, :, -1]
    q = (np.swapaxes(root, 1, 2) @ q[:, :, None])[:, :, 0]  # along G o in the basis u
    o = (np.swapaxes(vt, 1, 2) @ np.where(fine, q / np.where(fine, s, 1.0), 0.0)[:, :, None])[:, :, 0]
    o /= np.maximum(np.linalg.norm(o, axis=1, keepdims=True), 1e-300)
    most = np.take_along_axis(o, np.abs(o).argmax(axis=1)[:, None], axis=1)
    o *= np.where(most < 0, -1.0, 1.0)
    f = (inverse @ g @ o[:, :, None])[:, :, 0]
    size = np.linalg.norm(f, axis=1, keepdims=True)
    return np.where(size > 0, f / np.where(size > 0, size, 1.0), 0.0) @ w, o
