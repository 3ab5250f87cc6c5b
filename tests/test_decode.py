import numpy as np
import pytest
from pyspark.sql import functions as F

from esig.functions import scalar
from esig.leaf import classify
from esig.operators import decode, select, spatial, stats


def blobs(n=80, p=6, gap=1.5, seed=0):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 2
    x = rng.normal(size=(n, p))
    x[:, 0] += gap * y
    return x, y


def test_classifiers_reach_their_optimum():
    x, y = blobs()
    s = np.where(y > 0, 1.0, -1.0)
    for c in (0.01, 1.0):
        w = classify.svm(x, y, c)
        z = np.hstack([x, np.ones((len(x), 1))])
        m = np.maximum(0, 1 - s * (z @ w))
        assert np.abs(w - 2 * c * z.T @ (s * m)).max() < 1e-6
    w = classify.logistic(x, y, 0.5)
    loss = lambda v: np.logaddexp(0, -s * (np.hstack([x, np.ones((len(x), 1))]) @ v)).sum() + (0.45 * (v[:-1] ** 2).sum() + 0.1 * np.abs(v[:-1]).sum()) / 0.5
    rng = np.random.default_rng(1)
    assert all(loss(w) <= loss(w + 1e-3 * rng.normal(size=len(w))) + 1e-9 for _ in range(50))
    x, y = blobs(gap=3.0)
    for name in ("svm", "lda", "logistic"):
        assert np.mean(classify.predict(classify.fit(name, x, y, 0.1), x) == y) > 0.85


def test_fits_together_equal_fits_alone():
    rng, c = np.random.default_rng(4), np.tile((0.01, 0.1, 1.0, 10.0), (9, 1))
    sets = [blobs(40 + 3 * k, 5, seed=k) for k in range(9)]
    sets[2][0][:, 3] = 0
    sets[3][0][:, 1] = sets[3][0][:, 2]
    xs, ys = [x for x, _ in sets], [y for _, y in sets]
    for name in ("svm", "lda"):
        got = classify.fit_many(name, xs, ys, c)
        assert all(np.allclose(w, [classify.fit(name, x, y, v) for v in c[0]]) for w, x, y in zip(got, xs, ys, strict=True))
    xs[5][:, 0] += 9 * ys[5]  # separable: long ways to the optimum
    for w, x, y in zip(classify.fit_many("logistic", xs, ys, c), xs, ys, strict=True):
        z, s = np.hstack([x, np.ones((len(x), 1))]), np.where(y > 0, 1.0, -1.0)
        for v, k in zip(w, c[0], strict=True):
            g = -z.T @ (s / (1 + np.exp(s * (z @ v)))) + 0.9 / k * np.append(v[:-1], 0)
            edge = 0.1 / k * np.append(np.ones(5), 0)
            assert np.where(v != 0, np.abs(g + edge * np.sign(v)), np.abs(g) - edge).max() < 1e-8
    wide = [rng.normal(size=(30, classify.MANY_WIDTH + k)) for k in (0, 1)]
    got = classify.fit_many("svm", wide, [ys[0][:30]] * 2, c[:2])
    assert all(np.allclose(w, [classify.svm(x, ys[0][:30], v) for v in c[0]]) for w, x in zip(got, wide, strict=True))


def test_ledoit_wolf_is_between_its_ends():
    x = np.random.default_rng(2).normal(size=(30, 5))
    s = np.cov(x.T, bias=True)
    k = classify.ledoit_wolf(x)
    assert np.trace(k) == pytest.approx(np.trace(s)) and abs(k[0, 1]) <= abs(s[0, 1])


def windowed(spark, gap):
    x, y = blobs(gap=gap)
    rows = [(0, "r", i, int(y[i]), 40, 0, 20.0, [float(v) for v in x[i]]) for i in range(len(y))]
    return spark.createDataFrame(rows, "subject bigint, roi string, epoch bigint, y int, sw_dur int, w int, ms_center double, features array<double>")


def test_decoding_finds_signal_and_not_noise(spark):
    grid = select.explore_grid(spark, ["svm", "lda"], [40]).withColumn("c", F.lit(None).cast("double"))
    tasks = decode.decode_tasks(windowed(spark, 2.5), grid, repeats=2)
    out = decode.decode_window(tasks).collect()
    assert len(out) == 3 and all(r.decode_acc > 0.8 and len(r.mean_list) == 2 for r in out)
    noise = decode.decode_window(decode.decode_tasks(windowed(spark, 0.0), grid.where("NOT tuned"), repeats=3)).collect()
    assert all(abs(r.decode_acc - 0.5) < 0.15 for r in noise)
    few = decode.decode_tasks(windowed(spark, 1.0).where("epoch < 6"), grid, repeats=1).collect()
    assert all(r.status != "ok" and r.accuracy is None for r in few)


def test_leaf_folds_are_the_frame_folds(spark):
    w = windowed(spark, 1.0)
    frame = {(r.epoch, r.rep): r.fold for r in decode.stratified_folds(w, ["subject"], 2, 5, 3).collect()}
    x, y = blobs()
    for rep in (0, 1):
        leaf = decode._fold_ids(np.arange(len(y)), y, rep, 5, 3)
        assert [frame[i, rep] for i in range(len(y))] == leaf.tolist()


def test_first_component_recovers_a_latent_series(spark):
    rng = np.random.default_rng(4)
    latent, load = rng.normal(size=(20, 30)), rng.normal(size=8)
    rows = [(0, "r", e, v, t, float(load[v] * latent[e, t] + 0.3 * rng.normal())) for e in range(20) for v in range(8) for t in range(30)]
    df = spark.createDataFrame(rows, "subject bigint, roi string, epoch bigint, vertex int, t_idx int, x double")
    got = spatial.first_pc(df).toPandas().sort_values(["epoch", "t_idx"])["x"].to_numpy()
    assert abs(np.corrcoef(got, latent.ravel())[0, 1]) > 0.95
    w = spatial.top_pcs(df, 2).toPandas()
    assert w.groupby("pc")["w"].apply(lambda v: (v**2).sum()).to_numpy() == pytest.approx([1, 1])


def test_flipped_summary_equals_the_decomposition(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3, 4, 30))
    x[2] = 0
    rows = [(1, "a", e, v, t, float(x[e, v, t])) for e in range(3) for v in range(4) for t in range(30)]
    sign = np.array([1.0, -1.0, 1.0, -1.0])
    flip = spark.createDataFrame([("a", v, float(sign[v])) for v in range(4)], "roi string, vertex int, flip double")
    df = spark.createDataFrame(rows, "subject int, roi string, epoch int, vertex int, t_idx int, x double")
    got = {(r.epoch, r.t_idx): r.x for r in spatial.pca_flip(df, flip).collect()}
    for e in range(2):
        u, s, v = np.linalg.svd(x[e], full_matrices=False)
        want = np.sign(u[:, 0] @ sign) * np.linalg.norm(s) / 2 * v[0]
        assert np.allclose([got[e, t] for t in range(30)], want)
    assert all(got[2, t] == 0 for t in range(30))


def test_exact_signed_ranks_equal_enumeration(spark):
    values = [0.5, -1.5, 2.5, 3.5, -4.5, 6.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", v) for v in (1.0, 1.0, -1.0)] + [("c", float(v)) for v in range(1, 61)], "k string, value double")
    got = {r.k: r.p for r in stats.wilcoxon_greater(df, ["k"], exact_to=50).collect()}
    near = {r.k: r.p for r in stats.wilcoxon_greater(df, ["k"]).collect()}
    sums = [sum(r for r in range(1, 7) if bits >> (r - 1) & 1) for bits in range(64)]
    assert got["a"] == sum(s >= 1 + 3 + 4 + 6 for s in sums) / 64
    assert got["b"] == near["b"] and got["c"] == near["c"]


def test_orthogonalised_regions_are_orthonormal(spark):
    rng = np.random.default_rng(5)
    rows = [(0, e, r, t, float(v)) for e in range(3) for n, r in enumerate("abc") for t, v in enumerate(rng.normal(size=40) + n * np.sin(np.arange(40)))]
    out = spatial.orthogonalise(spark.createDataFrame(rows, "subject bigint, epoch bigint, roi string, t_idx int, x double"))
    for _, g in out.toPandas().groupby("epoch"):
        m = g.pivot(index="roi", columns="t_idx", values="x").to_numpy()
        assert np.abs(m @ m.T - np.eye(3)).max() < 1e-6


def test_t_distribution(spark):
    df = spark.createDataFrame([(1.729133, 19), (1.724718, 20), (6.313752, 1), (2.919986, 2), (-1.729133, 19)], "t double, n int")
    p = [r.p for r in df.select(scalar.t_sf(F.col("t"), F.col("n")).alias("p")).collect()]
    assert p[:4] == pytest.approx([0.05] * 4, abs=1e-6) and p[4] == pytest.approx(0.95, abs=1e-6)


def test_cluster_of_a_shifted_stretch(spark):
    rng = np.random.default_rng(6)
    rows = [(s, "r", t, float(rng.normal() + (1.5 if 10 <= t < 18 else 0))) for s in range(16) for t in range(30)]
    df = spark.createDataFrame(rows, "subject bigint, roi string, ms int, value double")
    got = stats.cluster_permutation(df, ["roi"], 1.75, 256).orderBy("p_cluster").first()
    assert got.p_cluster < 0.02 and got.start <= 11 and got.end >= 16
    points = stats.tfce_permutation(df, ["roi"], 128, 0.5).where("p_tfce < 0.05").collect()
    assert {12, 13, 14, 15} <= {r.ms for r in points} and all(8 <= r.ms <= 20 for r in points)


def test_permutation_queries_cover_all_months(spark):
    from esig import catalog
    from esig.plans import queries_stats

    sf_dir = "/root/testdata/sf0.001"
    months = {r.ms for r in queries_stats.tests(spark, sf_dir).collect()}
    assert max(months) > 40
    for name in ("t9_tfce_all", "t12_roi_stats"):
        got = catalog.QUERIES[name](spark, sf_dir).select("ms", "p_tfce").collect()
        assert {r.ms for r in got} == months
        assert all((r.p_tfce * 1024).is_integer() for r in got)
    ends = [(r.start, r.end) for r in catalog.QUERIES["t8_cluster_permutation_all"](spark, sf_dir).collect()]
    assert max(e for _, e in ends) > 40


def test_errors(spark):
    df = spark.createDataFrame([("A",)], "roi string")
    with pytest.raises(ValueError, match="no region Z"):
        select.select_rois(df, ["Z"])
    with pytest.raises(ValueError, match="unknown contrast"):
        select.assign_class(df.withColumnRenamed("roi", "word"), select.word_classes(spark), "none")


def test_shares_are_even_and_lose_nothing():
    from esig.operators import decode

    work = [(decode.fits_of(n, t, 5, 3), (n, t, r)) for n in ("svm", "lda", "logistic") for t in (False, True) for r in range(5)]
    parts = decode.shares(work, 65)
    cost = {piece: c for c, piece in work}
    sums = sorted(sum(cost[p] for p in part) for part in parts)
    assert sorted(p for part in parts for p in part) == sorted(cost) and sums[-1] <= 2 * sums[len(sums) // 2]
    assert decode.shares([], 10) == [] and len(decode.shares(work, 10**6)) == 1


def test_shares_give_the_same_accuracies(spark):
    """However a window's work is dealt; a subject with too few trials is reported and doesn't stop the rest."""
    import numpy as np

    from esig.operators import decode

    rng = np.random.default_rng(3)
    rows = [(s, "r", e, e % 2, 40, w, float(w), (rng.normal(size=6) + (e % 2)).tolist()) for s, n in ((0, 40), (1, 4)) for e in range(n) for w in range(2)]
    df = spark.createDataFrame(rows, "subject int, roi string, epoch int, y int, sw_dur int, w int, ms_center double, features array<double>")
    grid = spark.createDataFrame([("svm", 40, t, None) for t in (False, True)] + [("lda", 40, False, None), ("lda", 99, False, None)], "classifier string, sw_dur int, tuned boolean, c double")
    key = lambda r: (r.subject, r.classifier, r.tuned, r.w, r.rep)
    got = [{key(r): (r.accuracy, r.c, r.status) for r in decode.decode_tasks(df, grid, repeats=2, fits_per_task=n).collect()} for n in (1, 65, 10**6)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 2 * 2 * 3 * 2
    done, failed = decode.decode_subjects(df, "svm", 40)
    assert {r.subject for r in done.collect()} == {0}
    assert [(r.subject, r.n_failed, r.reason) for r in failed.collect()] == [(1, 2, "fewer trials of a class than folds")]


def test_lda_in_the_space_of_the_trials_equals_the_dense_solve():
    import numpy as np

    from esig.leaf import classify

    rng = np.random.default_rng(1)
    for n, p in ((20, 60), (70, 200), (12, 13)):
        x, y = rng.normal(size=(n, p)) * rng.uniform(0.5, 3, p) + rng.normal(size=p), np.arange(n) % 2
        x[y == 1, :3] += 0.7
        sd = x.std(axis=0)
        share, means = [np.mean(y == k) for k in (0, 1)], [x[y == k].mean(axis=0) for k in (0, 1)]
        cov = sum(share[k] * classify.ledoit_wolf(x[y == k] / sd) * np.outer(sd, sd) for k in (0, 1))
        coef = np.linalg.solve(cov, np.array(means).T)
        bias = [-0.5 * means[k] @ coef[:, k] + np.log(share[k]) for k in (0, 1)]
        assert np.allclose(classify.lda(x, y), np.append(coef[:, 1] - coef[:, 0], bias[1] - bias[0]), rtol=1e-6, atol=1e-9)
