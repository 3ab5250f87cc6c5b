"""Operators 11 to 13 against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from esig.llm import centroids, phrases, vector_dedup

VECTORS = "vec_id bigint, embedding array<double>, label int, at string, n string, node string"


def crowd(rng, n, dim=12, spread=0.1, groups=8):
    """Directions in groups around centres, some copied, some scaled."""
    middle = rng.normal(size=(groups, dim))
    x = middle[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim)) * rng.choice([0.3, 1.0, 2.0], size=(n, 1))
    x[n // 2 : n // 2 + n // 8] = x[: n // 8]
    x[n // 3 : n // 3 + n // 10] = x[: n // 10] * 3
    return x


def plain_links(rows, cosine):
    """{position: (links, component)} of (vec_id, embedding, label)."""
    live = [(k, i, np.array(v, dtype=float), lab) for k, (i, v, lab, *_) in enumerate(rows) if lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near, root = defaultdict(set), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for p, (k, _, v, lab) in enumerate(live):
        for m, _, w, other in live[p + 1 :]:
            if lab == other and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= cosine:
                near[k].add(m), near[m].add(k)
                root[find(k)] = find(m)
    low = defaultdict(list)
    for k in range(len(rows)):
        low[find(k)].append(rows[k][0])
    least = {k: min((x for x in low[find(k)] if x is not None), default=None) for k in range(len(rows))}
    return Counter((rows[k][0], len(near[k]), least[k], rows[k][0] == least[k]) for k in range(len(rows)))


def judged(df):
    return Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect())


# 11 ----------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("seed,spread", [(1, 0.02), (2, 0.1), (3, 0.3), (4, 3.0)])
def test_dual_traversal_finds_every_link(seed, spread):
    rng = np.random.default_rng(seed)
    x = vector_dedup.unit(crowd(rng, 700, spread=spread))
    w = rng.integers(1, 4, len(x))
    near = x @ x.T >= 0.98
    np.fill_diagonal(near, False)
    tree = vector_dedup.Tree(x)
    one = vector_dedup.traverse(tree, tree, w, w, 0.98)
    assert (one.n == near @ w).all()
    k = 300
    two = vector_dedup.traverse(vector_dedup.Tree(x[:k]), vector_dedup.Tree(x[k:]), w[:k], w[k:], 0.98)
    assert (two.n == np.r_[near[:k, k:] @ w[k:], near[k:, :k] @ w[:k]]).all()
    p, q = np.nonzero(near)
    assert (vector_dedup.forest(np.stack([p, q]), len(x)) == one.edges).all()
    for t in (tree,):  # every point lies within the covering radius of each node above it, and children have half the radius
        for c, r, below, kids in zip(t.center, t.radius, t.below, t.kids, strict=True):
            assert np.linalg.norm(x[below] - x[c], axis=1).max() <= r + 1e-12
            assert not len(kids) or sorted(np.concatenate([t.below[m] for m in kids])) == sorted(below)


def test_thousands_of_near_copies_are_counted_without_being_listed():
    rng = np.random.default_rng(5)
    x = vector_dedup.unit(np.ones(40) + 0.01 * rng.normal(size=(5000, 40)))
    tree = vector_dedup.Tree(x)
    found = vector_dedup.traverse(tree, tree, np.ones(5000, int), np.ones(5000, int), 0.98)
    assert (found.n == 4999).all() and found.edges.shape == (2, 4999)


@pytest.mark.parametrize("block", [4096, 64])
def test_near_vectors(spark, block):
    rng = np.random.default_rng(block)
    rows = [(int(i), v.tolist(), int(lab)) for i, (v, lab) in enumerate(zip(crowd(rng, 400), rng.choice([3, 3, 3, 5], 400), strict=True))]
    rows += [(400 + i, rows[0][1], 3) for i in range(90)]  # a hot vector
    rows += [(600, None, 3), (601, [0.0] * 12, 3), (602, [None] + [1.0] * 11, 3), (603, [math.nan] * 12, 3), (604, rows[0][1], None), (605, [], 3), (606, [math.inf] + [1.0] * 11, 3), (607, [1.0, 2.0], 3), (608, [2.0, 4.0], 3), (609, [1e300] * 12, 7), (610, [1e-300] * 12, 7), (None, rows[1][1], 3), (5, rows[2][1], 3)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VECTORS).repartition(5)
    assert judged(vector_dedup.near_vectors(df, block=block)) == plain_links([r if r[0] not in (609, 610) else (r[0], [1.0] * 12, 7) for r in rows], 0.98)


def test_near_vectors_empty(spark):
    assert vector_dedup.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    only = spark.createDataFrame([(1, None, 2, "", "", ""), (None, None, None, "", "", "")], VECTORS)
    assert judged(vector_dedup.near_vectors(only)) == Counter([(1, 0, 1, True), (None, 0, None, True)])


# 12 ----------------------------------------------------------------------------------------------------------------
def plain_clusters(rows, clusters, rounds, dim):
    """Exact k-means with Python's integers: {(vec_id, cluster, distance)} and centroids."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)[:clusters]
    cs = [v for *_, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min(range(len(cs)), key=lambda k: (far(v, cs[k]), k))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _i, v in kept:
            groups[near(v)].append(v)
        cs = [[sum(col) // len(groups[k]) for col in zip(*groups[k], strict=True)] if k in groups else c for k, c in enumerate(cs)]
    return Counter((i, near(v), far(v, cs[near(v)])) for i, v in kept), cs


@pytest.mark.parametrize("big", [1.0, 4e4])
def test_clusters_equal_plain_ones(spark, big):
    rng = np.random.default_rng(3)
    x = crowd(rng, 300, dim=7, spread=0.5) * big
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(7, x[9].tolist(), 0), (7, x[9].tolist(), 0), (None, x[3].tolist(), 0)]
    rows += [(400, None, 0), (401, x[0, :6].tolist(), 0), (402, [None] * 7, 0), (403, [math.nan] * 7, 0), (404, [0.0] * 7, 0), (405, [-0.5] * 7, 0)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VECTORS).repartition(4)
    found, cs = centroids.cluster_vectors(df, clusters=9, rounds=4, dim=7)
    want, plain = plain_clusters(rows, 9, 4, 7)
    assert cs.tolist() == plain
    assert Counter((r.vec_id, r.cluster, r.distance) for r in found.collect()) == want
    out = centroids.clusters_digest(df, clusters=9, rounds=4, dim=7).collect()
    sums = Counter()
    for (_, c, d), n in want.items():
        sums[c] += d * n
    assert all((r.cluster_inertia, r.inertia) == (sums[r.cluster], sum(sums.values())) and r.centroid_sha256 == hashlib.sha256(",".join(map(str, plain[r.cluster])).encode()).hexdigest() for r in out)


def test_chunks_hold_the_vectors_without_loss(spark):
    x = np.random.default_rng(1).integers(-5, 5, (1000, 5))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, v array<bigint>").coalesce(2)
    for r in centroids.encode_chunks(rows, chunk=128).collect():
        back = np.zeros((len(r.ids), 5), int)
        for dims, code, book in centroids.dictionaries(r.codes, r.sizes, r.subvectors, 5):
            assert len(np.unique(book, axis=0)) == len(book) <= 100
            back[:, dims] = book[code]
        assert (back == x[r.ids]).all()


def test_clusters_edges(spark):
    assert centroids.clusters_digest(spark.createDataFrame([], VECTORS)).count() == 0
    same = spark.createDataFrame([(i, [0.25] * 64, 0, "", "", "") for i in range(50)], VECTORS)
    assert {(r.cluster, r.distance, r.inertia) for r in centroids.clusters_digest(same).collect()} == {(0, 0, 0)}
    far = spark.createDataFrame([(i, [x] * 64, 0, "", "", "") for i, x in enumerate([1e15, -1e15, 1e300])], VECTORS)
    got = centroids.clusters_digest(far, clusters=1).collect()
    assert [(r.distance, r.inertia) for r in got] == [(None, None)] * 2  # the sums can't be longs; the third component passes 2^62


# 13 ----------------------------------------------------------------------------------------------------------------
def plain_phrases(docs, least, most, top):
    """docs: (lang, text) -> {lang: [(phrase, a, l, r, n, score)]}"""
    f, size = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            size[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, every in f.items():
        fine = {p: a for p, a in every.items() if len(p) > 1 and a >= least}
        inside = {p for q, b in fine.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) for p in [q[i : i + k]] if 100 * b >= 100 * every[p]}
        rows = []
        for p, a in fine.items():
            if p not in inside:
                score, k = min((1000 * a * size[lang] // (every[p[:k]] * every[p[k:]]), k) for k in range(1, len(p)))
                rows.append((" ".join(p), a, every[p[:k]], every[p[k:]], size[lang], score))
        out[lang] = sorted(rows, key=lambda r: (-r[5], -r[1], r[0].encode()))[:top]
    return {lang: rows for lang, rows in out.items() if rows}


def sayings(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}é" if k % 7 == 0 else f"W{k}" for k in range(60)] + ["(a)", "x-y", " ", "don't"]
    stock = ["once upon a time there", "as a matter of fact", "to be or not", "new york", "a a a a a a"]
    docs = []
    for i in range(400):
        words = [rng.choice(vocabulary[: 5 + i % 60]) for _ in range(rng.randrange(0, 60))]
        for _ in range(3):
            words.insert(rng.randrange(len(words) + 1), rng.choice(stock))
        docs.append((rng.choice(["en", "en", "fr", None]), rng.choice([" ", "  ", "\t"]).join(w + rng.choice(["", "", "", ".", "\n", "!?"]) for w in words)))
    return docs + [("en", None), ("en", ""), ("de", "  \t"), ("en", "new york " * 3000), ("und", "to be or not " * 20)] + [docs[5]] * 30


@pytest.mark.parametrize("chunk,least,most,top", [(1 << 19, 20, 5, 2000), (97, 12, 4, 15), (1000, 30, 2, 3)])
def test_collocations(spark, chunk, least, most, top):
    docs = sayings(chunk)
    df = spark.createDataFrame([(i, lang, text, "x", 0) for i, (lang, text) in enumerate(docs)], "doc_id bigint, lang string, text string, key string, n int").repartition(5)
    got = defaultdict(list)
    for r in phrases.collocations(df, least, most, top, chunk).orderBy("lang", "rank").collect():
        got[r.lang].append((r.phrase, r.a, r.l, r.r, r.n, r.score))
    want = plain_phrases(docs, least, most, top)
    assert dict(got) == want and len(want) == 3


def test_collocations_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", "too few words")], "lang string, text string")).count() == 0


@pytest.mark.parametrize("dense", [0.0, 0.01, 1.0, 1e9])
def test_tiles_count_pairs_like_a_counter(dense):
    rng = np.random.default_rng(4)
    one, two = rng.zipf(1.3, (2, 20000)) % 5000
    keys, times, at = phrases.count_pairs(one, two, tile=16, dense=dense)
    assert dict(zip(keys.tolist(), times.tolist(), strict=True)) == Counter((int(a) << 32) + int(b) for a, b in zip(one, two, strict=True))
    assert (keys[at] == (one << 32 | two)).all()


def test_exact_scores_beyond_64_bits(spark):
    """1000 * a * n passes 64 bits: the score comes from decimals."""
    from pyspark.sql import functions as F

    a, n, part = 3_000_000_007, 90_000_000_001, 5_000_000_011
    row = spark.createDataFrame([(a, n, [part, a], [part + 2, a])], "a bigint, n bigint, starts array<bigint>, ends array<bigint>")
    assert row.select(F.expr(phrases.LOWEST_CUT).alias("c")).first().c.score == 1000 * a * n // (part * (part + 2))
