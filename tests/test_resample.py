"""Resampling by stretches: long series, edges and gaps against a plain filter."""

import numpy as np
import pytest

from esig.operators import condition


def plain(x, up, down, pad):
    """The filter on the whole series, sample by sample."""
    n, out = len(x), []
    taps = condition.resample_taps(up, down)
    for j in range(-(-n * up // down)):
        total = 0.0
        for k, h in taps:
            if (j * down - k) % up == 0:
                i = (j * down - k) // up
                if pad == "zero":
                    total += h * x[i] if 0 <= i < n else 0.0
                else:
                    cycle = i % max(2 * (n - 1), 1)
                    total += h * x[0 if n == 1 else cycle if cycle <= n - 1 else 2 * (n - 1) - cycle]
        out.append(total)
    return out


@pytest.mark.parametrize("rates,pad", [((500.0, 200.0), "reflect"), ((200.0, 500.0), "reflect"), ((400.0, 100.0), "zero"), ((100.0, 160.0), "zero")])
def test_stretches_join_without_a_seam(spark, monkeypatch, rates, pad):
    monkeypatch.setattr(condition, "STRETCH", 64)
    rng, series = np.random.default_rng(5), {0: 1, 1: 7, 2: 150, 3: 1200, 4: 1201, 5: 1339}
    made = {e: rng.normal(size=n).round(3) for e, n in series.items()}
    df = spark.createDataFrame([(e, "r", t, float(v)) for e, x in made.items() for t, v in enumerate(x)], "epoch int, roi string, t_idx int, x double").repartition(4)
    got = {(r.epoch, r.t_idx): r.x for r in condition.resample(df, *rates, pad=pad).collect()}
    ratio = rates[1] / rates[0]
    up, down = {2.5: (5, 2), 0.4: (2, 5), 0.25: (1, 4), 1.6: (8, 5)}[ratio]
    want = {(e, j): v for e, x in made.items() for j, v in enumerate(plain(x, up, down, pad))}
    assert set(got) == set(want) and np.allclose([got[k] for k in want], list(want.values()), atol=1e-9)


def test_few_samples_go_to_two_stretches(spark):
    df = spark.range(100_000).selectExpr("cast(id % 2 as int) epoch", "'r' roi", "cast(id div 2 as int) t_idx", "cast(id as double) x")
    rows = condition.in_stretches(df, ("epoch", "roi"), 4096, 51)
    assert 100_000 < rows.count() <= 110_000
    assert condition.resample(df.withColumn("x", (df.x * 0 + 3)), 500.0, 200.0).where("abs(x - 3) > 1e-3").count() == 0
    holes = df.withColumn("x", df.x * None)
    assert condition.resample(holes, 500.0, 200.0).where("x <> 0").count() == 0
