"""Banded lag products: memory by the data, windows from running sums, one pass for sweeps and reversed time."""

import numpy as np
import pytest
import simulate
from pyspark.sql import functions as F

from esig.leaf import mvar
from esig.operators import connectivity as G
from esig.plans import runs


def test_band_equals_dense_moments():
    x = np.random.default_rng(1).normal(size=(30, 3, 24))
    c = np.einsum("eia,ejb->abij", x, x)
    band = mvar.Band.dense(c, 4)
    assert sum(d.size for d in band.diagonals) == 5 * 24 * 9
    for start, size in ((0, 24), (5, 12), (12, 12)):
        part = c[start : start + size, start : start + size]
        for b, dense, at in ((band, part, start), (band.reversed(), part[::-1, ::-1], 24 - size - start), (band.take([2, 0]), part[:, :, [2, 0]][:, :, :, [2, 0]], start)):
            for p, (a, s) in mvar.lwr_orders(b, 30, 4, at, size).items():
                want = mvar.lwr_orders(dense.copy(), 30, 4)[p]
                assert np.allclose(a, want[0], atol=1e-10) and np.allclose(s, want[1], atol=1e-10)


def test_sums_follow_the_data_not_the_span_of_time(spark):
    """Samples two million apart: a dense array over their span would need gigabytes."""
    times = [0, 1, 3, 1023, 1024, 1030, 2_000_000, 2_000_001, 4_000_000]
    rng = np.random.default_rng(3)
    rows = [(0, e, c, t, float(rng.integers(-9, 9))) for e in range(3) for c in "ab" for t in times if not (e == 2 and t == 1024)]
    df = spark.createDataFrame(rows, "subject bigint, epoch bigint, roi string, t_idx int, x double").repartition(3)
    want = {}
    for _, e, c, t, x in rows:
        for _, e2, d, u, y in rows:
            if e == e2 and 0 <= u - t <= 20:
                s = want.setdefault((c, d, t, u - t), [0.0, 0])
                s[0] += x * y
                s[1] += 1
    got = {(r.ci, r.cj, r.a, r.lag): [r.c, r.n] for r in G.lag_products(df, 20).collect()}
    assert got == want


def test_windows_share_sums_whatever_the_step(spark):
    """The rows that go to the groups don't grow as the step shrinks, and windows equal fits on their own samples."""
    x = simulate.network(60, 200, [(0, 1, 0.4), (1, 2, 0.3)], n=3)
    c = G.packed_lag_products(simulate.packed(spark, x), 2)
    fine = {(r.start, r.src, r.tgt): r.f for r in G.moving_window_conditional(c, 20, 3, 2).collect()}
    coarse = {(r.start, r.src, r.tgt): r.f for r in G.moving_window_conditional(c, 20, 30, 2).collect()}
    assert {k[0] for k in fine} == set(range(0, 181, 3)) and {k[0] for k in coarse} == set(range(0, 181, 30))
    for s in (0, 30, 60, 180):
        part = np.ascontiguousarray(x[:, :, s : s + 20])
        alone = {(r.src, r.tgt): r.f for r in G.conditional_gc(G.packed_lag_products(simulate.packed(spark, part), 2), 2).collect()}
        assert all(fine[s, *k] == pytest.approx(v, abs=1e-9) for k, v in alone.items())
        assert all(coarse[s, *k] == pytest.approx(v, abs=1e-9) for k, v in alone.items())
    counts = {G.in_blocks(c, 20, step, 2).count() for step in (1, 7, 20)}
    assert len(counts) == 1 and counts.pop() <= 1.3 * c.count()


def test_reversed_time_in_the_same_pass(spark):
    x = simulate.network(50, 60, [(0, 1, 0.4)], n=3, seed=4)
    c = G.packed_lag_products(simulate.packed(spark, x), 2)
    one = {(r.src, r.tgt, r.start, r.freq): (r.f_xy, r.f_yx, r.d_xy, r.d_yx) for r in G.moving_window_trgc(c, 20, 10, 2, [5.0, 20.0], 200.0).collect()}
    two = G.diff_trgc(*(G.moving_window_pairwise(c, 20, 10, 2, [5.0, 20.0], 200.0, way) for way in (False, True)))
    two = {(r.src, r.tgt, r.start, r.freq): (r.f_xy, r.f_yx, r.d_xy, r.d_yx) for r in two.collect()}
    assert set(one) == set(two) and all(one[k] == pytest.approx(two[k], abs=1e-9) for k in one)


def test_sweep_of_no_admissible_cell_has_no_rows(spark):
    x = simulate.network(20, 30, [], n=2)
    c = G.packed_lag_products(simulate.packed(spark, x), 4)
    assert runs.order_window_sweep(c, [], 5, [4.0], 30.0, 30).count() == 0
    empty = runs.order_window_sweep(c, [(4, 4), (40, 2)], 5, [4.0], 30.0, 30)
    assert empty.count() == 0 and empty.columns == runs.order_window_sweep(c, [(20, 2)], 5, [4.0], 30.0, 30).columns
    few = G.packed_lag_products(simulate.packed(spark, x[:3]), 4)  # too few trials for order 4 on 10 samples, enough for 1
    some = runs.order_window_sweep(few, [(6, 1), (6, 4), (6, 1)], 6, [4.0], 30.0, 30)
    assert some.groupBy("win", "p").count().where(F.col("p") == 1).count() == 1
