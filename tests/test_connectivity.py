import math

import numpy as np
import pytest
import simulate
from pyspark.sql import functions as F

from esig.leaf import mvar, statespace
from esig.operators import condition
from esig.operators import connectivity as G


def moments(x, p):
    t = x.shape[2]
    c = np.zeros((t, t, x.shape[1], x.shape[1]))
    for a in range(t):
        for b in range(max(0, a - p), min(t, a + p + 1)):
            c[a, b] = x[:, :, a].T @ x[:, :, b]
    return c


def test_recovers_a_known_model_and_its_order():
    x, a1, a2, sigma = simulate.ar2(100, 400)
    c = moments(x, 5)
    a, s = mvar.lwr(c, 100, 2)
    assert np.abs(a - [a1, a2]).max() < 0.03 and np.abs(s - sigma).max() < 0.03
    z = np.concatenate([x[:, :, 1:-1], x[:, :, :-2]], axis=1).transpose(0, 2, 1).reshape(-1, 4)
    ols = np.linalg.lstsq(z, x[:, :, 2:].transpose(0, 2, 1).reshape(-1, 2), rcond=None)[0].T
    assert np.abs(np.concatenate(list(a), axis=1) - ols).max() < 0.03


def test_order_criterion(spark):
    x, *_ = simulate.ar2(60, 200, seed=3)
    c = G.packed_lag_products(simulate.packed(spark, x), 5)
    crit = G.order_criteria(c, [1, 2, 3, 4, 5])
    assert G.best_order(crit).first()["p"] == 2
    assert G.best_order(crit, "bic_full").first()["p"] == 2


def test_direction_null_and_reversal(spark):
    freqs = [float(f) for f in range(2, 100, 7)]
    for weight, seed in ((0.4, 1), (0.0, 2)):
        x = simulate.network(60, 200, [(0, 1, weight)] if weight else [], seed=seed)
        c = G.packed_lag_products(simulate.packed(spark, x), 3)
        f = G.moving_window_pairwise(c, 200, 200, 2, freqs, 200.0)
        r = G.moving_window_pairwise(c, 200, 200, 2, freqs, 200.0, reverse=True)
        d = G.diff_trgc(f, r)
        m = d.agg(*[F.avg(k).alias(k) for k in ("f_xy", "f_yx", "d_xy", "d_yx")]).first()
        assert m.d_xy == pytest.approx(-m.d_yx)
        if weight:
            assert m.f_xy > 0.05 > 0.01 > m.f_yx and m.d_xy > 0
        else:
            assert max(m.f_xy, m.f_yx) < 0.02


def test_scaling_and_partitions_change_nothing(spark):
    x = simulate.network(30, 60, [(0, 1, 0.4)])
    one = {(r.start, r.freq): (r.f_xy, r.f_yx) for r in G.moving_window_pairwise(G.packed_lag_products(simulate.packed(spark, x), 2), 20, 10, 2, [5.0, 20.0], 200.0).collect()}
    x[:, 0] *= 1000
    two = {(r.start, r.freq): (r.f_xy, r.f_yx) for r in G.moving_window_pairwise(G.lag_products(simulate.long(spark, x).repartition(7), 2), 20, 10, 2, [5.0, 20.0], 200.0).collect()}
    assert len(one) == 10 and all(np.allclose(one[k], two[k], atol=1e-8) for k in one)


def test_short_windows_and_failures(spark):
    x = simulate.network(120, 20, [(0, 1, 0.4)])
    out = G.moving_window_pairwise(G.packed_lag_products(simulate.packed(spark, x), 6), 20, 5, 6, [10.0], 500.0).first()
    assert math.isfinite(out.f_xy) and out.status == "ok"
    x[:, 1] = -x[:, 0]
    bad = G.moving_window_pairwise(G.packed_lag_products(simulate.packed(spark, x), 2), 10, 10, 2, [10.0], 500.0).collect()
    assert all(r.f_xy is None and r.status != "ok" for r in bad)


def test_conditional(spark):
    chain = simulate.network(80, 300, [(0, 2, 0.5), (2, 1, 0.5)], n=3, seed=5)  # a -> c -> b
    c = G.packed_lag_products(simulate.packed(spark, chain), 4)
    got = {(r.src, r.tgt): r.f for r in G.conditional_gc(c, 4).collect()}
    assert got["a", "c"] > 0.1 and got["c", "b"] > 0.1 and got["a", "b"] < 0.01
    direct = simulate.network(80, 300, [(0, 2, 0.5), (2, 1, 0.5), (0, 1, 0.5)], n=3, seed=6)
    c = G.packed_lag_products(simulate.packed(spark, direct), 4)
    time = {(r.src, r.tgt): r.f for r in G.conditional_gc(c, 4).collect()}
    assert time["a", "b"] > 0.1
    freqs = [float(f) for f in np.linspace(0.5, 99.5, 100)]
    spectral = G.conditional_gc(c, 4, freqs, 200.0).groupBy("src", "tgt").agg(F.avg("f").alias("f")).collect()
    for r in spectral:
        assert r.f == pytest.approx(time[r.src, r.tgt], rel=0.12, abs=0.01)


def test_conditional_of_two_is_pairwise(spark):
    x = simulate.network(80, 300, [(0, 1, 0.4)], seed=7)
    c = G.packed_lag_products(simulate.packed(spark, x), 3)
    freqs = [3.0, 20.0, 60.0]
    pair = {r.freq: (r.f_xy, r.f_yx) for r in G.moving_window_pairwise(c, 300, 300, 3, freqs, 200.0).collect()}
    cond = {(r.src, r.freq): r.f for r in G.conditional_gc(c, 3, freqs, 200.0).collect()}
    for f in freqs:
        assert cond["a", f] == pytest.approx(pair[f][0], rel=0.1, abs=0.01)


def test_erp_removal_leaves_means_of_zero(spark):
    x = simulate.network(20, 15, [], seed=8) + np.linspace(0, 3, 15)
    out = condition.remove_erp(simulate.long(spark, x))
    assert out.groupBy("roi", "t_idx", "y").agg(F.abs(F.avg("x")).alias("m")).agg(F.max("m")).first()[0] < 1e-12


def test_resample_keeps_a_constant(spark):
    df = spark.createDataFrame([(0, "a", t, 1.89) for t in range(60)], "epoch bigint, roi string, t_idx int, x double")
    out = condition.resample(df, 500.0, 200.0).toPandas()
    assert len(out) == 24 and np.abs(out["x"] - 1.89).max() < 0.01
    zero = condition.resample(df, 500.0, 200.0, pad="zero").toPandas()
    assert np.abs(zero.sort_values("t_idx")["x"].iloc[0] - 1.89) > 0.5
    assert condition.resample(df, 200.5, 200.0).count() == 60


def test_moments_of_windows_equal_raw_fits():
    x = simulate.network(40, 50, [(0, 1, 0.4)], seed=9)
    c = moments(x, 10)
    for s, w, p in ((0, 20, 5), (7, 30, 10)):
        a = mvar.lwr(c[s : s + w, s : s + w], 40, p)
        b = mvar.lwr(moments(x[:, :, s : s + w], p), 40, p)
        assert np.abs(a[0] - b[0]).max() < 1e-10 and np.abs(a[1] - b[1]).max() < 1e-10


def test_statespace(spark):
    direct = simulate.network(80, 300, [(0, 2, 0.5), (2, 1, 0.5)], n=3, seed=11)
    c = G.packed_lag_products(simulate.packed(spark, direct), 4)
    time = {(r.src, r.tgt): r.f for r in G.statespace_gc(c, 300, 300, 4).collect()}
    assert time["a", "c"] > 0.1 and time["c", "b"] > 0.1 and time["a", "b"] < 0.01
    freqs = [float(f) for f in np.linspace(0.25, 99.75, 200)]
    spectral = G.statespace_gc(c, 300, 300, 4, freqs, 200.0).groupBy("src", "tgt").agg(F.avg("f").alias("f")).collect()
    for r in spectral:
        assert r.f == pytest.approx(time[r.src, r.tgt], rel=0.02, abs=0.003)


def test_statespace_of_two_is_pairwise():
    x = simulate.network(100, 120, [(0, 1, 0.4)], seed=12)
    a, s = mvar.lwr(moments(x, 3), 100, 3)
    m = statespace.from_var(a, s)
    freqs = np.array([3.0, 20.0, 60.0])
    assert np.allclose(statespace.spectral_gc(m, [0], [1], freqs, 200.0), mvar.geweke(a, s, freqs, 200.0)[0], atol=1e-8)


def test_csd_gives_the_model_back(spark):
    x, a1, a2, sigma = simulate.ar2(1, 10, seed=13)
    a = np.array([a1, a2])
    m = statespace.from_var(a, sigma)
    freqs = np.arange(256) * 200.0 / 256
    s = np.array([h @ sigma @ h.conj().T for h in mvar.transfer(a, freqs, 200.0)])
    cov = np.real(np.einsum("kf,fij->kij", np.exp(2j * np.pi * np.outer(np.arange(9), freqs) / 200.0), s)) / 256
    b, v = statespace.var_from_autocovariance(cov)
    assert np.abs(b[:2] - a).max() < 1e-6 and np.abs(b[2:]).max() < 1e-6 and np.abs(v - sigma).max() < 1e-6
    assert np.allclose(statespace.transfer(m, freqs[:5], 200.0), mvar.transfer(a, freqs[:5], 200.0))


def test_wavelet_csd_peaks_at_the_common_rhythm(spark):
    rng = np.random.default_rng(14)
    t = np.arange(200) / 100
    x = np.array([[np.sin(2 * np.pi * 10 * t + p) + 0.5 * rng.normal(size=200), np.sin(2 * np.pi * 10 * t + p - 0.5) + 0.5 * rng.normal(size=200)] for p in rng.uniform(0, 6, 30)])
    out = G.wavelet_csd(simulate.packed(spark, x), [5.0, 10.0, 20.0], 100.0, 500.0).where("t = 100 AND ci = 'a' AND cj = 'b'").collect()
    power = {r.freq: math.hypot(r.re, r.im) for r in out}
    assert power[10.0] > 5 * max(power[5.0], power[20.0])
    assert math.atan2(*[next((r.im, r.re) for r in out if r.freq == 10.0)][0]) == pytest.approx(0.5, abs=0.1)


def test_queries_read_every_channel(spark):
    from esig import catalog

    run = lambda name: catalog.QUERIES[name](spark, "/root/testdata/sf0.01")
    assert run("g9_conditional_gc_time").select("src", "tgt").distinct().count() == 20
    assert run("g12_statespace_gc_time").select("src", "tgt").distinct().count() == 20
    assert run("g16_wavelet_csd").select("ci").union(run("g16_wavelet_csd").select("cj")).distinct().count() == 5
