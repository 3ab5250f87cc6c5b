"""Whole-run queries without SQL against numpy on the given tables."""

import math

import numpy as np
import pytest
from test_connectivity_numpy import RATE, fits, partition, without

from esig.catalog import QUERIES
from esig.operators import connectivity, spectral
from esig.plans import runs
from esig.plans.queries_connectivity import centred
from esig.plans.queries_decode import vertices
from esig.sources import views as V

TABLES = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def cubes(spark):
    """(subject -> (labels, trials by channels by samples), channels) of the events."""
    rows = V.events_signals(spark, TABLES).select("subject", "epoch", "y", "roi", "t_idx", "x").toPandas()
    names, out = sorted(rows["roi"].unique()), {}
    for subject, part in rows.groupby("subject"):
        wide = part.pivot(index=["epoch", "y"], columns=["roi", "t_idx"], values="x").sort_index(axis=1)
        out[int(subject)] = (np.array([y for _, y in wide.index]), wide.to_numpy().reshape(len(wide), len(names), -1))
    return out, names


def cleaned(y, x):
    """Trials without their mean over time, and then without the mean of their label at each sample."""
    x = x - x.mean(axis=2, keepdims=True)
    for c in np.unique(y):
        x[y == c] -= x[y == c].mean(axis=0)
    return x


def two_way(x, order, freq, rate):
    a, sigma = fits(x, order)[-1]
    h = np.linalg.inv(np.eye(2) - sum(c * np.exp(-2j * np.pi * freq * (k + 1) / rate) for k, c in enumerate(a)))
    s = h @ sigma @ h.conj().T
    one = lambda i, j: max(0.0, math.log(s[j, j].real / (s[j, j].real - (sigma[i, i] - sigma[i, j] ** 2 / sigma[j, j]) * abs(h[j, i]) ** 2)))
    return one(0, 1), one(1, 0)


def in_bands(spark, x, names, win, step, order, freqs, rate):
    """(src, tgt, band, place) -> (gc, dtrgc) of all ordered pairs of a subject."""
    bands = [tuple(r) for r in spectral.bands_table(spark).select("band", "lo", "hi", "hi_closed").collect()]
    out = {}
    for i in range(len(names)):
        for j in range(i + 1, len(names)):
            for s in range(0, x.shape[2] - win + 1, step):
                part = x[:, [i, j], s : s + win]
                every = {f: (*two_way(part, order, f, rate), *two_way(part[:, :, ::-1], order, f, rate)) for f in freqs}
                for band, lo, hi, closed in bands:
                    inside = [every[f] for f in freqs if lo <= f and (f <= hi if closed else f < hi)]
                    if inside:
                        xy, yx, rxy, ryx = np.mean(inside, axis=0)
                        d = (xy - yx) - (rxy - ryx)
                        out[names[i], names[j], band, s], out[names[j], names[i], band, s] = (xy, d), (yx, -d)
    return out


def same(spark, name, want, first):
    got = {(r.subject, r.src, r.tgt, r.band, r.start - first): (r.gc, r.dtrgc) for r in QUERIES[name](spark, TABLES).collect() if r.gc is not None}
    assert set(got) == set(want)
    assert np.allclose([got[k] for k in want], list(want.values()), rtol=1e-4, atol=1e-7)


def test_sensor_groups(spark, cubes):
    """Means of groups that hold all five channels, then the run on moving windows."""
    data, names = cubes
    groups = {"p": ["click", "view"], "q": ["error", "signup"], "r": ["purchase"]}
    want = {}
    for subject, (y, x) in data.items():
        z = np.stack([x[:, [names.index(c) for c in g]].mean(axis=1) for g in groups.values()], axis=1)
        want |= {(subject, *k): v for k, v in in_bands(spark, cleaned(y, z), list(groups), 15, 15, 2, [4.0, 6.0, 9.0, 14.0], RATE).items()}
    same(spark, "g15_sensor_gc", want, 0)


def test_subject_run(spark):
    """First components of both regions from the raw vertices, then the run on moving windows at 40 Hz."""
    rows, want = vertices(spark, TABLES).select("subject", "epoch", "y", "roi", "vertex", "t_idx", "x").toPandas(), {}
    for subject, part in rows.groupby("subject"):
        parts = []
        for _, region in part.groupby("roi"):
            wide = region.pivot(index=["epoch", "y", "t_idx"], columns="vertex", values="x").sort_index()
            x, y = wide.to_numpy(), np.array([y for _, y, t in wide.index if t == 0])
            parts.append((x @ np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][0]).reshape(len(y), -1))
        x = cleaned(y, np.stack(parts, axis=1))
        want |= {(int(subject), *k): v for k, v in in_bands(spark, x, ["back", "front"], 6, 2, 2, [4.0, 6.0, 9.0, 14.0], 40.0).items()}
    same(spark, "g14_subject_gc", want, 0)


def test_conditional_run(spark, cubes):
    """Each source left out of the model of all channels by a long autoregression, averaged over the bands."""
    data, names = cubes
    freqs, want = [4.0, 6.0, 9.0, 14.0], {}
    bands = [tuple(r) for r in spectral.bands_table(spark).select("band", "lo", "hi", "hi_closed").collect()]
    for subject, (y, x) in data.items():
        x = cleaned(y, x)
        for w in range(0, x.shape[2] - 15 + 1, 15):
            full = fits(x[:, :, w : w + 15], 2)[-1]
            for s, src in enumerate(names):
                reduced = without(full, s)
                every = {f: partition(full, reduced, names, s, f) for f in freqs}
                for band, lo, hi, closed in bands:
                    inside = [every[f] for f in freqs if lo <= f and (f <= hi if closed else f < hi)]
                    if inside:
                        want |= {(subject, src, t, band, w): np.mean([v[t] for v in inside]) for t in inside[0]}
    rows = [r for r in QUERIES["g14_subject_gc_conditional"](spark, TABLES).collect() if r.gc is not None]
    first = min(r.start for r in rows)
    got = {(r.subject, r.src, r.tgt, r.band, r.start - first): r.gc for r in rows}
    assert set(got) == set(want) and all(r.dtrgc is None for r in rows)
    assert np.allclose([got[k] for k in want], list(want.values()), rtol=1e-3, atol=1e-6)


def test_blocks_from_cross_spectra(spark):
    """Autocovariances by a sum over the frequencies, the Yule-Walker equations solved whole, and the measure of the two blocks
    in closed form, wherever the model is stable."""
    names, order = ["click", "error", "purchase", "signup", "view"], 3
    freqs = np.arange(1.0, 15.0)
    csd = connectivity.wavelet_csd(runs.pack(centred(spark, TABLES)), freqs.tolist(), RATE, 500.0, step=15).toPandas()
    got = {(r.subject, r.src, r.tgt, r.t, r.freq): (r.gc, r.dtrgc) for r in QUERIES["g17_gc_from_csd"](spark, TABLES).where("status = 'ok'").collect()}
    n, seen = len(names), 0
    for (subject, t), part in csd.groupby(["subject", "t"]):
        s = np.zeros((len(freqs), n, n), complex)
        for r in part.itertuples():
            s[int(r.freq) - 1, names.index(r.ci), names.index(r.cj)] = complex(r.re, r.im)
        gamma = [np.mean([(s[f] * np.exp(2j * np.pi * k * freqs[f] / RATE)).real for f in range(len(freqs))], axis=0) for k in range(order + 1)]
        gamma[0] = gamma[0] + 1e-9 * np.trace(gamma[0]) / n * np.eye(n)
        both = []
        for g in (gamma, [m.T for m in gamma]):
            at = lambda k, g=g: g[k] if k >= 0 else g[-k].T
            big = np.block([[at(k - m) for k in range(order)] for m in range(order)])
            a = np.linalg.solve(big.T, np.concatenate(g[1:], axis=1).T).T
            sigma = g[0] - sum(a[:, k * n : (k + 1) * n] @ g[k + 1].T for k in range(order))
            radius = np.abs(np.linalg.eigvals(np.block([[a], [np.eye(n * (order - 1)), np.zeros((n * (order - 1), n))]]))).max()
            both.append((a, sigma, radius))
        if max(r for *_, r in both) > 0.999 or min(np.linalg.eigvalsh(m)[0] for _, m, _ in both) <= 0:
            continue
        for f in freqs:
            net = []
            for a, sigma, _ in both:
                h = np.linalg.inv(np.eye(n) - sum(a[:, k * n : (k + 1) * n] * np.exp(-2j * np.pi * f * (k + 1) / RATE) for k in range(order)))
                full, one = h @ sigma @ h.conj().T, {}
                for src, tgt, i, j in (("a", "b", [0, 1], [2, 3, 4]), ("b", "a", [2, 3, 4], [0, 1])):
                    rest = sigma[np.ix_(i, i)] - sigma[np.ix_(i, j)] @ np.linalg.solve(sigma[np.ix_(j, j)], sigma[np.ix_(j, i)])
                    seen_from = h[np.ix_(j, i)]
                    own = full[np.ix_(j, j)] - seen_from @ rest @ seen_from.conj().T
                    one[src, tgt] = max(0.0, math.log(np.linalg.det(full[np.ix_(j, j)]).real / np.linalg.det(own).real))
                net.append(one)
            d = (net[0]["a", "b"] - net[0]["b", "a"]) - (net[1]["a", "b"] - net[1]["b", "a"])
            for (src, tgt), v in net[0].items():
                assert got[subject, src, tgt, t, f] == pytest.approx((v, d if src == "a" else -d), rel=1e-3, abs=1e-5)
                seen += 1
    assert seen > 100


def test_pair_diagnosis(spark, cubes):
    """Power ratios by their definition on the subject's samples, and columns that stay in their range."""
    data, names = cubes
    got = {r.subject: r for r in QUERIES["a20_pair_diagnosis"](spark, TABLES).collect()}
    assert set(got) == set(data)
    for subject, (_, x) in data.items():
        for c, col in (("click", "power_a"), ("view", "power_b")):
            s = x[:, names.index(c)]
            base, task = s[:, :12], s[:, 15:30]
            assert got[subject][col] == pytest.approx((task**2).mean() / (base**2).mean(), rel=1e-9)
        for name in ("coh_base", "coh_task"):
            assert 0 <= got[subject][name] <= 1 + 1e-12


def test_method_compare(spark):
    rows = vertices(spark, TABLES).select("subject", "roi", "epoch", "t_idx", "vertex", "x").toPandas()
    got = {(r.subject, r.roi): r for r in QUERIES["a21_method_compare"](spark, TABLES).collect()}
    for key, part in rows.groupby(["subject", "roi"]):
        m = part.pivot(index=["epoch", "t_idx"], columns="vertex", values="x").sort_index(axis=1)
        x = m.to_numpy()
        v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][0]
        pc = x @ v
        strongest = x[:, np.argmax(x.var(axis=0).round(9))]
        assert abs(got[key].r_mean) == pytest.approx(abs(np.corrcoef(pc, x.mean(axis=1))[0, 1]), abs=1e-6)
        assert abs(got[key].r_maxpower) == pytest.approx(abs(np.corrcoef(pc, strongest)[0, 1]), abs=1e-6)
    assert set(got) == {k for k, _ in rows.groupby(["subject", "roi"])}


def test_matched_noise_leaves_the_asked_correlation(spark):
    """All samples of the query: mean 0, the deviation that the formula asks for, and unrelated to the signal."""
    from esig.operators import condition

    s = V.events_signals(spark, TABLES).select("epoch", "roi", "t_idx", "x")
    noisy = condition.add_matched_noise(s, 0.9).withColumnRenamed("x", "z").join(s, ["epoch", "roi", "t_idx"]).toPandas()
    spread = noisy.groupby(["epoch", "roi"])["x"].transform(lambda v: v.std(ddof=0))
    unit = ((noisy["z"] - noisy["x"]) / (spread * math.sqrt(1 / 0.81 - 1)))[spread > 0]
    assert abs(unit.mean()) < 0.02 and unit.std() == pytest.approx(1, abs=0.02) and abs(np.corrcoef(unit, noisy["x"][spread > 0])[0, 1]) < 0.02
