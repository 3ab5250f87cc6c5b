"""Permutation kernels against plain loops, and thresholds by the group's own number of subjects."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from esig.functions.scalar import t_critical
from esig.leaf import permutation as P
from esig.operators import stats
from esig.plans import group_stats


def plain_t(v, s):
    v = [a * b for a, b in zip(v, s, strict=True)]
    n, m = len(v), sum(v) / len(v)
    var = sum((x - m) ** 2 for x in v) / (n - 1) if n > 1 else 0
    return m / math.sqrt(var / n) if var > 0 else 0.0


def plain_runs(x, threshold):
    out, at = [], None
    for i, v in enumerate([*x, -math.inf]):
        if v > threshold and at is None:
            at = i
        elif not v > threshold and at is not None:
            out.append((at, i - 1, round(math.fsum(x[at:i]), 9)))
            at = None
    return out


def plain_tfce(x, step):
    score = [0.0] * len(x)
    for k in range(1, int(max(x, default=0) / step) + 2):
        for i, v in enumerate(x):
            if v > 0 and k * step <= v and k <= math.floor(v / step):
                a = b = i
                while a > 0 and math.floor(x[a - 1] / step) >= k:
                    a -= 1
                while b + 1 < len(x) and math.floor(x[b + 1] / step) >= k:
                    b += 1
                score[i] += math.sqrt(b - a + 1) * (k * step) ** 2 * step
    return score


def test_signs_are_those_of_the_hash():
    got = P.signs(["3", "x"], 9, seed=5)
    assert got[0].tolist() == [1, 1]
    for p in range(1, 9):
        for k, s in enumerate(("3", "x")):
            assert got[p, k] == (-1.0 if int(hashlib.md5(f"5:{p}:{s}".encode()).hexdigest()[0], 16) % 2 == 0 else 1.0)


@pytest.mark.parametrize("seed,step", [(1, 0.5), (2, 0.25), (3, 2.0), (4, 0.125)])
def test_component_tree_equals_all_heights(seed, step):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0.5, 1.5, (40, 25)) * 8) / 8
    x[:, 0], x[:, 1], x[:, 2], x[5:9, 3] = -1, 2.5, np.arange(40) / 8, 4
    got = P.tfce(x, step)
    for k in range(x.shape[1]):
        assert got[:, k] == pytest.approx(plain_tfce(x[:, k].tolist(), step), rel=1e-12)
    assert P.tfce(np.zeros((0, 4)), step).shape == (0, 4) and (P.tfce(np.full((3, 2), 1e-3), step) == 0).all()


def test_clusters_equal_plain_runs():
    x = np.round(np.random.default_rng(7).normal(0, 2, (30, 50)), 3)
    col, first, last, mass = P.clusters(x, 0.8)
    for k in range(50):
        assert list(zip(first[col == k], last[col == k], mass[col == k], strict=True)) == plain_runs(x[:, k].tolist(), 0.8)
    assert P.cluster_test(np.zeros((3, 4)), 1.0) == []


def test_regions_of_unequal_size_have_their_own_threshold(spark):
    """Three subjects need a t over 2.92, twenty one over 1.73: a t of about 2.3 is a cluster for the many alone."""
    rng, rows = np.random.default_rng(2), []
    for roi, n in (("few", 3), ("many", 20)):
        z = rng.normal(size=n)
        z = (z - z.mean()) / z.std(ddof=1)
        for ms in range(4):
            rows += [(s, roi, ms, float(z[s] + (2.3 / math.sqrt(n) if ms in (1, 2) else -1))) for s in range(n)]
    rows += [(99, "few", 2, None)]
    df = spark.createDataFrame(rows, "subject int, roi string, ms int, value double")
    got = {(r.roi, r.start, r.end) for r in stats.cluster_permutation(df, ["roi"], None, 64).collect()}
    assert got == {("many", 1, 2)} and t_critical(2) > 2.3 > t_critical(19)
    out = group_stats.roi_stats(df.where("value IS NOT NULL"), 0.0, 64)
    assert {(r.roi, r.ms) for r in out.where("mass IS NOT NULL").collect()} == {("many", 1), ("many", 2)}
    one = group_stats.config_cluster_stats(df.withColumnRenamed("value", "accuracy"), ["roi"], 0.0, permutations=64)
    assert Counter((r.roi, r.n_clusters is not None) for r in one.collect()) == Counter([("few", True), ("many", True)])


def test_cluster_p_by_brute_force(spark):
    rng, perms = np.random.default_rng(9), 128
    x = rng.normal(0.4, 1, (8, 12))
    df = spark.createDataFrame([(s, "r", t, float(x[s, t])) for s in range(8) for t in range(12)], "subject int, roi string, ms int, value double")
    flips = P.signs([str(s) for s in range(8)], perms)
    every = [plain_runs([plain_t(x[:, t], f) for t in range(12)], 1.0) for f in flips]
    tops = [max((m for *_, m in r), default=-1) for r in every]
    want = {(a, b): sum(t >= m - 1e-9 for t in tops) / perms for a, b, m in every[0]}
    assert {(r.start, r.end): r.p_cluster for r in stats.cluster_permutation(df, ["roi"], 1.0, perms).collect()} == want
    scores = [plain_tfce([plain_t(x[:, t], f) for t in range(12)], 0.5) for f in flips]
    for r in stats.tfce_permutation(df, ["roi"], perms, 0.5).collect():
        assert r.tfce == pytest.approx(scores[0][r.ms]) and r.p_tfce == sum(max(s) >= scores[0][r.ms] - 1e-9 for s in scores) / perms


def test_many_subjects_are_summed_in_parts(spark, monkeypatch):
    """The same statistics from partial sums of blocks of subjects as from one row for a time."""
    rng = np.random.default_rng(8)
    rows = [(i, r, m, float(v)) for i in range(300) for r in "ab" for m in range(5) for v in [rng.normal() + 0.2 * (m == 3)] if rng.random() < 0.9]
    rows += [(0, "c", 0, 1.5), (0, "d", 1, None), (5, None, 2, 1.0), (6, None, 2, 3.0), (7, None, 2, 4.5)]
    df = spark.createDataFrame(rows, "subject bigint, roi string, ms int, value double").repartition(7)
    known = {(r.roi, r.ms): np.frombuffer(r.stats) for r in stats.permuted_t(df, ["roi"], 40, few=10**6).collect()}
    monkeypatch.setattr(stats, "HELD_SIGNS", 40 * 17)
    monkeypatch.setattr(stats, "HELD_SUMS", 40 * 6)
    got = stats.permuted_t(df, ["roi"], 40)
    assert got.columns == ["roi", "ms", "stats"] and len(known) == 12
    got = {(r.roi, r.ms): np.frombuffer(r.stats) for r in got.collect()}
    assert set(got) == set(known) and all(np.allclose(got[k], known[k], atol=1e-10) for k in known)


def test_no_task_gets_all_subjects_of_a_time(spark, monkeypatch):
    """With many subjects the signs that a task makes at once are those of a block."""
    df = spark.range(600).selectExpr("id AS subject", "'a' AS roi", "0 AS ms", "cast(id % 7 AS double) AS value")
    plan = stats.permuted_t(df, ["roi"], 8)._jdf.queryExecution().analyzed().toString()
    assert "_sums" in plan
    assert stats.cluster_permutation(df, ["roi"], 0.5, 8).count() == 1
