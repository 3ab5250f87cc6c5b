"""The spatial queries without SQL against plain numpy: singular vectors of the raw blocks, all rows of the smallest tables."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from esig.catalog import QUERIES
from esig.operators import spatial

TABLES = "/root/testdata/sf0.001"
ROIS = {"front": slice(0, 4), "back": slice(4, 8)}
#: The projection that the queries of weights use: 3 outputs of 8 channels.
GAIN = np.cos(np.arange(3)[:, None] + np.arange(8) * 0.5)


@pytest.fixture(scope="module")
def blocks():
    """epoch -> 8 vertices by 8 samples."""
    rows = pq.read_table(f"{TABLES}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pylist()
    return {r["vec_id"]: np.array(r["embedding"], dtype=float).reshape(8, 8) for r in rows}


def positive(u):
    """The vector, its largest loading positive."""
    return u * np.sign(u[np.argmax(np.abs(u))])


def pooled(blocks, part=slice(None), samples=slice(None)):
    """subject -> units by samples of all its trials."""
    by = {}
    for e, x in blocks.items():
        by.setdefault(e % 10, []).append(x[part, samples])
    return {s: np.concatenate(v, axis=1) for s, v in by.items()}


def centred_vectors(x, k):
    u = np.linalg.svd(x - x.mean(axis=1, keepdims=True), full_matrices=False)[0]
    return [positive(u[:, i]) for i in range(k)]


def trial_summary(x):
    return positive(np.linalg.svd(x)[0][:, 0]) @ x


def same(spark, name, want, *keys, value="x"):
    got = {tuple(r[k] for k in keys): r[value] for r in QUERIES[name](spark, TABLES).collect()}
    assert set(got) == set(want)
    assert np.allclose([got[k] for k in want], list(want.values()), rtol=1e-6, atol=1e-7)


def series(blocks, f, rois=tuple(ROIS)):
    """(subject, roi, epoch, t_idx) -> f(subject, roi, block of the region)[t_idx]."""
    return {(e % 10, r, e, t): v for e, x in blocks.items() for r in rois for t, v in enumerate(f(e % 10, r, x[ROIS[r]]))}


SERIES = ("subject", "roi", "epoch", "t_idx")


def test_leading_vectors(spark, blocks):
    want = {(s, r, p, range(8)[at][v]): float(w[v]) for r, at in ROIS.items() for s, x in pooled(blocks, at).items() for p, w in enumerate(centred_vectors(x, 2)) for v in range(4)}
    same(spark, "r2_top_pcs", want, "subject", "roi", "pc", "vertex", value="w")


@pytest.mark.parametrize("name", ["r1_first_pc", "r3_mean_flip"])
def test_projections_on_the_leading_vector(spark, blocks, name):
    lead = {(s, r): centred_vectors(x, 1)[0] for r, at in ROIS.items() for s, x in pooled(blocks, at).items()}
    weigh = (lambda w: w) if name == "r1_first_pc" else (lambda w: np.sign(w) / len(w))
    same(spark, name, series(blocks, lambda s, r, x: weigh(lead[s, r]) @ x), *SERIES)


def test_summary_of_a_trial(spark, blocks):
    same(spark, "r4_epoch_summary", series(blocks, lambda s, r, x: trial_summary(x)), *SERIES)


def test_flipped_vector_of_a_trial(spark, blocks):
    def flipped(_, r, x):
        u, s, vt = np.linalg.svd(x, full_matrices=False)
        flip = np.where(np.arange(8)[ROIS[r]] % 3 == 1, -1.0, 1.0)
        return vt[0] * np.sign(u[:, 0] @ flip) * np.linalg.norm(s) / np.sqrt(len(x))

    same(spark, "r5_pca_flip", series(blocks, flipped), *SERIES)


def test_orthogonalised_summaries(spark, blocks):
    want = {}
    for e, x in blocks.items():
        names = sorted(ROIS)
        u, _, vt = np.linalg.svd(np.array([trial_summary(x[ROIS[r]]) for r in names]), full_matrices=False)
        want |= {(e % 10, r, e, t): v for r, row in zip(names, u @ vt, strict=True) for t, v in enumerate(row)}
    same(spark, "r6_orthogonalise", want, *SERIES)


def test_residuals_on_the_other_region(spark, blocks):
    want = {}
    for e, x in blocks.items():
        for r, other in (("front", "back"), ("back", "front")):
            s = trial_summary(x[ROIS[other]])
            for v in range(8)[ROIS[r]]:
                rest = x[v] - (x[v] @ s) / (s @ s * (1 + 1e-6)) * s
                want |= {(e % 10, r, e, v, t): float(y) for t, y in enumerate(rest)}
    same(spark, "r7_regress_out", want, "subject", "roi", "epoch", "vertex", "t_idx")


def test_beamformer_weights(spark, blocks):
    want = {}
    for s, x in pooled(blocks, samples=slice(5, 8)).items():
        c = np.cov(x)
        w = np.linalg.solve(c + 0.05 * np.trace(c) / 8 * np.eye(8), GAIN.T).T
        w /= np.linalg.norm(w, axis=1, keepdims=True)
        want |= {(s, v, k): float(w[v, k]) for v in range(3) for k in range(8)}
    same(spark, "r11_lcmv_weights", want, "subject", "vertex", "chan", value="w")


def test_minimum_norm_weights(spark, blocks):
    want = {}
    for s, x in pooled(blocks, samples=slice(0, 5)).items():
        noise, power = np.cov(x), GAIN.T @ GAIN
        w = np.linalg.solve(power + noise * np.trace(power) / np.trace(noise) / 9, GAIN.T).T
        w /= np.sqrt(np.einsum("vi,ij,vj->v", w, noise, w))[:, None]
        want |= {(s, v, k): float(w[v, k]) for v in range(3) for k in range(8)}
    same(spark, "r12_dspm_weights", want, "subject", "vertex", "chan", value="w")


def test_shares_of_the_spectrum(spark, blocks):
    x = pooled(blocks)
    e = {s: np.linalg.svd(v - v.mean(axis=1, keepdims=True), compute_uv=False) ** 2 for s, v in x.items()}
    same(spark, "r13_rank_and_shared_fraction", {(s,): v[0] / v.sum() for s, v in e.items()}, "subject", value="shared")
    same(spark, "r13_rank_and_shared_fraction", {(s,): int((v > 1e-6 * v[0]).sum()) for s, v in e.items()}, "subject", value="rank")


def test_trials_come_together_once(spark):
    """Each trial's rows cross one exchange to one call; no row for a pair of vertices is exchanged or joined back."""
    rows = [(s, r, e, v, t, float((v + 1) * (t + 1) + e * (v == 2)) if (v, t) != (1, 1) else None) for s in (0, 1) for r in "ab" for e in range(3) for v in range(3) for t in range(4)]
    rows += [(0, "a", 0, 7, t, None) for t in range(6)] + [(0, "c", 0, 0, t, 0.0 if t else None) for t in range(2)]
    df = spark.createDataFrame(rows, "subject int, roi string, epoch int, vertex int, t_idx int, x double")
    flip = spark.createDataFrame([("a", 0, 1.0), ("a", 1, -1.0), ("b", 2, -1.0)], "roi string, vertex int, flip double")
    for out in (spatial.epoch_summary(df), spatial.pca_flip(df, flip), spatial.orthogonalise(spatial.epoch_summary(df))):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "Aggregate" not in plan
    got = {(r.subject, r.roi, r.epoch, r.t_idx): r.x for r in spatial.epoch_summary(df).collect()}
    assert len(got) == 2 * 2 * 3 * 4 + 2 and got[0, "c", 0, 0] is None and got[0, "c", 0, 1] == 0
    for s, r, e in {k[:3] for k in got if k[1] != "c"}:
        m = np.array([[x or 0.0 for (a, b, c, v, _, x) in rows if (a, b, c, v) == (s, r, e, u)] for u in range(3)])
        v = np.linalg.svd(m, full_matrices=False)[0][:, 0]
        v = v * np.sign(v[np.abs(v).round(12).argmax()])
        assert np.allclose([got[s, r, e, t] for t in range(4)], v @ m)
