"""Filters of most power with noise covariance: their defining properties, and sources with known orientations."""

import numpy as np
import pytest

from esig.leaf import beamformer
from esig.operators import spatial


def simulated(seed=0, channels=12, vertices=15, planted=4):
    """(gains, data covariance, noise covariance, orientation) of one source of known orientation in coloured noise."""
    rng = np.random.default_rng(seed)
    gain = rng.normal(size=(vertices, channels, 3))
    mix = np.eye(channels) + 0.3 * rng.normal(size=(channels, channels))
    noise, o = mix @ mix.T, rng.normal(size=3)
    o /= np.linalg.norm(o)
    field = gain[planted] @ o
    return gain, noise + 400 * np.outer(field, field), noise, o * np.sign(o[np.abs(o).argmax()])


@pytest.mark.parametrize("seed", range(4))
def test_no_other_orientation_has_more_power(seed):
    gain, data, noise, o = simulated(seed)
    w, ori = beamformer.max_power(gain, data, noise)
    assert np.allclose(np.einsum("vi,ij,vj->v", w, noise, w), 1)
    assert abs(ori[4] @ o) > 0.999
    white = beamformer.whitener(noise)
    c = white @ data @ white.T
    inverse = np.linalg.inv(c + 0.05 * np.trace(c) / len(c) * np.eye(len(c)))
    for v in range(len(gain)):
        g, best = white @ gain[v], -1.0
        share = lambda x, g=g: (x @ g.T @ inverse @ g @ x) / (x @ g.T @ inverse @ inverse @ g @ x)
        for x in np.random.default_rng(seed).normal(size=(2000, 3)):
            best = max(best, share(x))
        assert share(ori[v]) >= best - 1e-9
        f = inverse @ g @ ori[v]
        assert np.allclose(w[v], f / np.linalg.norm(f) @ white) and ori[v][np.abs(ori[v]).argmax()] > 0


def test_reduced_ranks():
    """Noise without power in two directions, and gains without one: filters stay in the range of both."""
    gain, data, noise, _ = simulated(7)
    cut = np.eye(12) - np.full((12, 12), 1 / 12)  # average reference
    w, o = beamformer.max_power(cut @ gain, cut @ data @ cut, cut @ noise @ cut, keep=2)
    assert beamformer.whitener(cut @ noise @ cut).shape == (11, 12)
    assert np.allclose(w.sum(axis=1), 0, atol=1e-9) and np.allclose(np.linalg.norm(o, axis=1), 1)
    flat = gain.copy()
    flat[:, :, 2] = 0
    assert np.allclose(beamformer.max_power(flat, data, noise)[1][:, 2], 0, atol=1e-9)
    assert (beamformer.max_power(np.zeros((1, 12, 3)), data, noise)[0] == 0).all()


def test_in_spark(spark, monkeypatch):
    monkeypatch.setattr(spatial, "VERTEX_BLOCK", 4)
    made = {s: simulated(s) for s in (1, 2)}
    gain = made[1][0]
    g = spark.createDataFrame([(v, c, k, float(gain[v, c, k])) for v in range(15) for c in range(12) for k in range(3)], "vertex int, chan int, ori int, g double")
    cov = lambda n: spark.createDataFrame([(s, i, j, float(m[n][i, j])) for s, m in made.items() for i in range(12) for j in range(i, 12)], "subject int, i int, j int, cov double")
    got = spatial.lcmv_max_power(g, cov(1), cov(2), reduce_rank=False).collect()
    assert len(got) == 2 * 15 * 12
    for s, (_, data, noise, _) in made.items():
        w, o = beamformer.max_power(gain, data, noise)
        for r in got:
            if r.subject == s:
                assert r.w == pytest.approx(w[r.vertex, r.chan], abs=1e-9) and r.ori == pytest.approx(o[r.vertex].tolist(), abs=1e-9)


def test_registered_rows(spark):
    """Every row of the query from the raw vectors: noise whitened by its symmetric root, the orientation of most power by an
    unsymmetric eigenproblem."""
    import pandas as pd

    from esig.catalog import QUERIES

    tables = "/root/testdata/sf0.001"
    e = pd.read_parquet(f"{tables}/embeddings.parquet")
    x, subject = np.array([np.asarray(v, dtype=float) for v in e["embedding"]]).reshape(len(e), 8, 8), e["vec_id"].to_numpy() % 10
    got = {(r.subject, r.vertex, r.chan): (r.w, r.ori) for r in QUERIES["r11_lcmv_max_power"](spark, tables).collect()}
    want = {}
    for s in np.unique(subject):
        mine = x[subject == s]
        data, noise = (np.cov(np.swapaxes(part, 0, 1).reshape(8, -1)) for part in (mine[:, :, 5:], mine[:, :, :5]))
        value, vector = np.linalg.eigh(noise)
        white = vector @ np.diag(value**-0.5) @ vector.T
        c = white @ data @ white
        inverse = np.linalg.inv(c + 0.05 * np.trace(c) / 8 * np.eye(8))
        for v in range(3):
            g = white @ np.array([[np.cos(v * (k + 1) + chan * (0.3 + 0.4 * k)) for k in range(3)] for chan in range(8)])
            strong = np.linalg.eigh(g.T @ g)[1][:, 1:]
            a = strong.T @ g.T @ inverse @ g @ strong
            b = strong.T @ g.T @ inverse @ inverse @ g @ strong
            power, direction = np.linalg.eig(np.linalg.solve(b, a))
            o = strong @ direction[:, power.argmax()]
            o = o / np.linalg.norm(o) * np.sign(o[np.abs(o).argmax()])
            f = inverse @ g @ o
            f = white @ f / np.linalg.norm(f)
            want |= {(int(s), v, chan): (f[chan], o.tolist()) for chan in range(8)}
    assert set(got) == set(want)
    for k, (w, o) in want.items():
        assert got[k][0] == pytest.approx(w, rel=1e-6, abs=1e-7) and got[k][1] == pytest.approx(o, rel=1e-6, abs=1e-7), k
