"""Near-duplicate vectors by a dual traversal of cover trees.

Vectors of one label are put on the unit sphere, where a cosine of c is a Euclidean distance of sqrt(2 - 2c). Equal
vectors of a label become one point with a weight.

A cover tree has nested levels: the nodes of a level have half the radius of those above, each node is a point, and
the points below it lie within its covering radius, which is measured. Two trees are traversed together, from pairs of
nodes to pairs of their children. A pair of nodes is dropped when its distance less both covering radii exceeds the
threshold; if its distance plus both radii stays below, all pairs below are links and none has to be looked at; what
remains ends in pairs of small nodes, which are measured. So links are exactly those of all pairs.

On Spark a label is one tree in two parts. A label that fits in a block is one task. For a larger one the upper part is
built from a sample of its points, in the task of the label, and all points go down to their nearest node of its last
level, their cell, in tasks of bounded size. Every cell has its covering radius. A point visits those later cells that
may hold something within the threshold: by the ball of the cell, and by the plane between the cell and its own. Cells and
their visitors meet in blocks, and each pair of blocks builds its two lower trees and traverses them. Tasks return how
many vectors each point is linked with and a forest that spans the links, never the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dedup import components
from .util import hash128, salted_join, stage_table

COSINE = 0.98
#: Points of a block, expected sample points per cell, and most cells of a label.
BLOCK, SAMPLE, MOST_CELLS = 4096, 8, 2048
#: Points of a node that isn't split any further, and pairs of points below two nodes that are measured at once.
LEAF, DIRECT = 16, 1 << 14
#: What rounding may add to a distance on the unit sphere.
SLACK = 1e-9


class Tree:
    """A cover tree of unit vectors: nested levels, radii halving from one to the next."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.center, self.radius, self.kids, self.below = [], [], [], []
        if len(x):
            self.root = self._node(0, np.arange(len(x)), 2.0)

    def _node(self, center: int, points: np.ndarray, radius: float) -> int:
        """The node of ``points``; its children are centres of half the radius, the nearest radii that split it."""
        far = np.sqrt(np.maximum(((self.x[points] - self.x[center]) ** 2).sum(axis=1), 0))
        at = len(self.center)
        self.center.append(center), self.radius.append(float(far.max())), self.kids.append(np.zeros(0, int)), self.below.append(points)
        if len(points) > LEAF and self.radius[at] > 0:
            while radius >= self.radius[at] and radius > 1e-12:
                radius /= 2
            groups = cover(self.x, points, center, radius)
            if len(groups) > 1:
                self.kids[at] = np.array([self._node(c, g, radius) for c, g in groups])
        return at


def cover(x: np.ndarray, points: np.ndarray, center: int, radius: float) -> list[tuple[int, np.ndarray]]:
    """(centre, its points): ``center`` and then the next point that no centre is within ``radius`` of, until all are covered."""
    points = np.r_[center, points[points != center]]
    y, owner, centers = x[points], np.full(len(points), -1), []
    while True:
        rest = np.flatnonzero(owner < 0)
        if not len(rest):
            break
        ask = rest[:256]
        near = y[rest] @ y[ask].T >= 1 - radius * radius / 2
        for k, c in enumerate(ask):
            if owner[c] < 0:
                own = rest[near[:, k] & (owner[rest] < 0)]
                owner[own] = owner[c] = len(centers)
                centers.append(int(points[c]))
    order = np.argsort(owner, kind="stable")
    return list(zip(centers, np.split(points[order], np.cumsum(np.bincount(owner))[:-1]), strict=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of paired rows of unit vectors in double precision, components added in order."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * y[:, d]
    return total


class Links:
    """Links found between two sets of points: the weight linked to each, and edges that span them. Points of the second
    set are numbered behind those of the first, unless both are one."""

    def __init__(self, one: int, two: int, same: bool):
        self.n, self.shift, self.edges, self.held = np.zeros(one if same else one + two, np.int64), 0 if same else one, np.zeros((2, 0), int), 0
        self.fresh: list[np.ndarray] = []

    def join(self, p: np.ndarray, q: np.ndarray) -> None:
        self.fresh.append(np.stack([p, q + self.shift]))
        self.held += len(p)
        if self.held > 1 << 20:
            self.settle()

    def settle(self) -> None:
        """Edges so far become a forest, so that they never hold more than one for each point."""
        self.edges = forest(np.concatenate([self.edges, *self.fresh], axis=1), len(self.n))
        self.fresh, self.held = [], 0


def traverse(a: Tree, b: Tree, w1: np.ndarray, w2: np.ndarray, cosine: float) -> Links:
    """Links between the points of two trees with weights, or within one; a point isn't linked with itself here."""
    same, t = a is b, math.sqrt(2 - 2 * cosine)
    out = Links(len(a.x), len(b.x), same)
    if not len(a.x) or not len(b.x):
        return out
    one, two = np.array(a.center), np.array(b.center)
    ca, cb, ra, rb = a.x[one], b.x[two], np.array(a.radius), np.array(b.radius)
    na, nb = (np.array([len(p) for p in tree.below]) for tree in (a, b))

    def count(p: np.ndarray, q: np.ndarray) -> None:
        """Single pairs of points that are links; within one tree each comes once."""
        np.add.at(out.n, p, w2[q])
        np.add.at(out.n, q + out.shift, w1[p])
        out.join(p, q)

    def measure(p: np.ndarray, q: np.ndarray, own: bool) -> None:
        """All pairs of ``p`` and ``q``."""
        dot = a.x[p] @ b.x[q].T
        i, j = np.nonzero(dot >= cosine - SLACK)
        if own:
            i, j = i[i < j], j[i < j]
        fine = dot[i, j] >= cosine + SLACK
        fine[~fine] = cosines(a.x[p[i[~fine]]], b.x[q[j[~fine]]]) >= cosine
        count(p[i[fine]], q[j[fine]])

    stack = [(a.root, b.root)]
    while stack:
        i, j = stack.pop()
        own, open_a, open_b = same and i == j, len(a.kids[i]) > 0, len(b.kids[j]) > 0
        if own and 2 * ra[i] < t - SLACK:
            _all_links(out, a.below[i], a.below[i], w1, w2, True)
            continue
        if na[i] * nb[j] <= DIRECT or not (open_a or open_b):
            measure(a.below[i], b.below[j], own)
            continue
        if open_a and open_b and not own:  # of two different nodes the wider one is opened
            open_a, open_b = ra[i] >= rb[j], ra[i] < rb[j]
        u, v = a.kids[i] if open_a else np.array([i]), b.kids[j] if open_b else np.array([j])
        for s in range(0, len(u), 512):
            part = u[s : s + 512]
            d = np.sqrt(np.maximum(2 - 2 * ca[part] @ cb[v].T, 0))
            reach = ra[part][:, None] + rb[v][None, :]
            meet = d - reach <= t + SLACK
            if own:
                meet &= (part[:, None] < v[None, :]) | ((part[:, None] == v[None, :]) & (na[part] > 1)[:, None])
            inside = meet & (d + reach < t - SLACK)
            single = (na[part] == 1)[:, None] & (nb[v] == 1)[None, :]
            p, q = np.nonzero(meet & single)
            p, q = one[part[p]], two[v[q]]
            hit = cosines(a.x[p], b.x[q]) >= cosine
            count(p[hit], q[hit])
            for p, q in zip(*np.nonzero(inside & ~single), strict=True):
                _all_links(out, a.below[part[p]], b.below[v[q]], w1, w2, same and part[p] == v[q])
            p, q = np.nonzero(meet & ~inside & ~single)
            stack.extend(zip(part[p].tolist(), v[q].tolist(), strict=True))
    out.settle()
    return out


def _all_links(out: Links, p: np.ndarray, q: np.ndarray, w1: np.ndarray, w2: np.ndarray, own: bool) -> None:
    """Every pair of ``p`` and ``q`` is a link: sums of weights, and edges along one point of each."""
    if own:
        out.n[p] += w1[p].sum() - w1[p]
        out.join(np.full(len(p), p[0]), p)
        return
    out.n[p] += w2[q].sum()
    out.n[q + out.shift] += w1[p].sum()
    out.join(np.full(len(q), p[0]), q)
    out.join(p, np.full(len(p), q[0]))


def forest(edges: np.ndarray, n: int) -> np.ndarray:
    """Edges (v, root) that span what ``edges`` (2, m) join, by smallest numbers that are passed on until none changes."""
    root = np.arange(n)
    while True:
        new = root.copy()
        low = np.minimum(root[edges[0]], root[edges[1]])
        for end in edges:
            np.minimum.at(new, root[end], low)
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == root).all():
            v = np.flatnonzero(root != np.arange(n))
            return np.stack([v, root[v]])
        root = new


def unit(v: list | np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by their largest component, so that no square passes the range of a double."""
    x = np.array([np.frombuffer(r) if isinstance(r, bytes) else r for r in v], dtype=np.float64)
    if not len(x):
        return x.reshape(0, 1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def top_level(x: np.ndarray, most: int) -> np.ndarray:
    """Centres of the last level with at most ``most``, each level with the centres of those above; if that is one alone,
    the first ``most`` of the next."""
    centers, radius = [0], 2.0
    while radius > 1e-12:
        radius /= 2
        left = np.setdiff1d(np.arange(len(x)), centers, assume_unique=True)
        far = left[(x[left] @ x[centers].T < 1 - radius * radius / 2).all(axis=1)]
        new = centers + ([c for c, _ in cover(x, far, int(far[0]), radius)] if len(far) else [])
        if len(new) > most:
            return np.array(new[:most] if len(centers) == 1 else centers)
        centers = new
    return np.array(centers)


def take_part(vectors: DataFrame) -> DataFrame:
    """at, vec_id, label, dim, h1, h2, v of every row; label is null and so is v for those that link with nothing."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0) & F.col("label").isNotNull()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.monotonically_increasing_id().alias("at"), "vec_id", F.when(F.col("fine"), F.col("label")).alias("label"), F.when(F.col("fine"), v).alias("v"))
    return rows.select("at", "vec_id", "label", F.size("v").alias("dim"), *hash128(v), "v")


KEY = ["label", "dim"]
POINT = "label string, dim int, cell int, far double, node bigint, w bigint, v binary"


def _in_parts(points: DataFrame, cells: DataFrame, parts: DataFrame, run, schema: str) -> DataFrame:
    """``run`` on bounded parts of each label's points, each with all cells of the label (cell, v, r)."""
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")
    left = points.join(parts, KEY).select(*KEY, own, "cell", "far", "node", "w", "v", F.lit(None).cast("double").alias("r"))
    right = cells.join(parts, KEY).select(*KEY, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "cell", F.lit(None).cast("double").alias("far"), F.lit(None).cast("bigint").alias("node"), F.lit(None).cast("bigint").alias("w"), "v", "r")
    return left.unionByName(right).groupBy(*KEY, "part").applyInPandas(run, schema)


def _split(g: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Points and cells of a part, cells in order."""
    cells = g["node"].isna()
    return g[~cells], g[cells].sort_values("cell")


def _descend(_: tuple, g: pd.DataFrame) -> pd.DataFrame:
    """Points with their nearest cell and the distance to it."""
    points, cells = _split(g)
    if not len(points):
        return pd.DataFrame(columns=[c.split()[0] for c in POINT.split(", ")])
    x, c = unit(list(points["v"])), unit(list(cells["v"]))
    near = (x @ c.T).argmax(axis=1)
    far = np.sqrt(((x - c[near]) ** 2).sum(axis=1))
    return points.assign(cell=cells["cell"].to_numpy()[near], far=far).astype({"node": "int64", "w": "int64"}).drop(columns=["part", "r"])


def _visits(cosine: float):
    """Points with each later cell that the bounds of ball and plane don't rule out."""
    t = math.sqrt(2 - 2 * cosine) + SLACK

    def run(_: tuple, g: pd.DataFrame) -> pd.DataFrame:
        points, cells = _split(g)
        x, c = unit(list(points["v"])), unit(list(cells["v"]))
        if not len(points) or not len(cells):
            return pd.DataFrame(columns=[n.split()[0] for n in POINT.split(", ")])
        dot, own = x @ c.T, np.searchsorted(cells["cell"].to_numpy(), points["cell"].to_numpy())
        ball = np.sqrt(np.maximum(2 - 2 * dot, 0)) <= cells["r"].to_numpy()[None, :] + t
        apart = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))[own]
        plane = dot >= dot[np.arange(len(x)), own][:, None] - t * apart - SLACK
        i, j = np.nonzero(ball & plane & (np.arange(len(c))[None, :] > own[:, None]))
        return points.iloc[i].assign(cell=cells["cell"].to_numpy()[j]).astype({"node": "int64", "w": "int64"}).drop(columns=["part", "r"])

    return run


def _meet(cosine: float):
    """Links of one pair of blocks: each point with what it is linked with, and its root in the forest of the links."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("node")
        one, two = g[g["own"] == key[3]], g[g["own"] == key[4]]
        a = Tree(unit(list(one["v"])))
        b = a if key[3] == key[4] else Tree(unit(list(two["v"])))
        found = traverse(a, b, one["w"].to_numpy(), two["w"].to_numpy(), cosine)
        nodes = one["node"].to_numpy() if a is b else np.concatenate([one["node"].to_numpy(), two["node"].to_numpy()])
        root = np.arange(len(nodes))
        root[found.edges[0]] = found.edges[1]
        some = found.n > 0
        return pd.DataFrame({"node": nodes[some], "n": found.n[some], "root": nodes[root[some]]})

    return run


def linked(points: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """node, n, root: what each of ``points`` (label, dim, node, w, v) is linked with by the blocks that it meets in."""
    sizes = stage_table(points.groupBy(*KEY).agg(F.count("*").alias("m"), F.min("node").alias("first")), "vec-sizes")
    points = points.select(*KEY, F.lit(0).alias("cell"), F.lit(0.0).alias("far"), "node", "w", "v")
    parts = sizes.where(F.col("m") > block).select(*KEY, F.ceil(F.col("m") / block).cast("int").alias("parts"))
    cells = F.least(F.lit(MOST_CELLS), F.ceil(2 * F.col("m") / block)).cast("int").alias("cells")
    drawn = points.join(sizes.where(F.col("m") > block).select(*KEY, "m", "first", cells), KEY)
    drawn = drawn.where((F.col("node") == F.col("first")) | (F.pmod(F.xxhash64("node", F.lit(1)), F.col("m")) < SAMPLE * F.col("cells")))

    def top(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("node")
        centers = top_level(unit(list(g["v"])), int(g["cells"].iloc[0]))
        return pd.DataFrame({"label": key[0], "dim": key[1], "cell": range(len(centers)), "v": g["v"].iloc[centers]})

    top_cells = stage_table(drawn.select(*KEY, "node", "v", "cells").groupBy(*KEY).applyInPandas(top, "label string, dim int, cell int, v binary"), "vec-cells")
    large = stage_table(_in_parts(points, top_cells.withColumn("r", F.lit(0.0)), parts, _descend, POINT), "vec-homes")
    reach = large.groupBy(*KEY, "cell").agg(F.count("*").alias("n"), F.max("far").alias("r"))
    reach = stage_table(reach, "vec-reach")
    visits = stage_table(_in_parts(large, top_cells.join(reach.select(*KEY, "cell", "r"), [*KEY, "cell"]), parts, _visits(cosine), POINT), "vec-visits")

    blocks = lambda name: F.ceil(F.col(name) / block).cast("int")
    size = reach.join(visits.groupBy(*KEY, "cell").agg(F.count("*").alias("nv")), [*KEY, "cell"], "left").select(*KEY, "cell", blocks("n").alias("h"), F.coalesce(blocks("nv"), F.lit(0)).alias("g"))
    up_to = lambda n: F.sequence(F.lit(0), n - 1)
    pick = lambda n: F.pmod(F.xxhash64("node", F.lit(2)), n).cast("int")
    home = large.join(size, [*KEY, "cell"]).select(*KEY, "cell", pick(F.col("h")).alias("own"), "node", "w", "v", F.explode(up_to(F.col("h") + F.col("g"))).alias("o"))
    away = visits.join(size, [*KEY, "cell"]).select(*KEY, "cell", (F.col("h") + pick(F.col("g"))).alias("own"), "node", "w", "v", F.explode(up_to(F.col("h"))).alias("o"))
    small = points.join(sizes.where(F.col("m") <= block).select(*KEY), KEY).select(*KEY, "cell", F.lit(0).alias("own"), "node", "w", "v", F.lit(0).alias("o"))
    met = small.unionByName(home).unionByName(away).select(*KEY, "cell", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "node", "w", "v")
    return met.groupBy(*KEY, "cell", "i", "j").applyInPandas(_meet(cosine), "node bigint, n bigint, root bigint")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Rows of equal, non-null labels and equal numbers of components are linked if their cosine is at least ``cosine``;
    vectors that are null or zero or hold null or non-finite components are linked with nothing. n_links counts the other
    rows linked directly, copies too; component_id is the smallest vec_id that links reach, and kept tells whether it is
    the row's own. Rows that share a vec_id are judged by their own vectors. Other columns aren't read.
    """
    rows = stage_table(take_part(vectors), "vec-rows")
    same = [*KEY, "h1", "h2"]
    live = rows.where("label IS NOT NULL")
    classes = live.groupBy(*same).agg(F.min("at").alias("node"), F.count("*").alias("w"), F.min("vec_id").alias("low"))
    classes = stage_table(classes, "vec-classes")
    points = live.select("at", "v").join(classes.select(*KEY, F.col("node").alias("at"), "w"), "at")
    points = points.select(*KEY, F.col("at").alias("node"), "w", "v").mapInPandas(_pack, "label string, dim int, node bigint, w bigint, v binary")
    found = stage_table(linked(stage_table(points, "vec-points"), cosine, block), "vec-links")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    ids = classes.join(roots, "node", "left").join(counts, "node", "left").select(*same, "w", "low", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "node").alias("root"))
    lowest = ids.groupBy("root").agg(F.min("low").alias("component"))
    ids = stage_table(ids.join(lowest, "root").select(*same, (F.col("n") + F.col("w") - 1).alias("n"), "component"), "vec-ids")
    judged = salted_join(live.select("at", "vec_id", *same), ids, same, F.xxhash64("at")).select("vec_id", "n", "component")
    apart = rows.where("label IS NULL").select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("component"))
    return judged.unionByName(apart).select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors as the bytes of their doubles."""
    for b in batches:
        yield b.assign(v=[np.asarray(v, dtype=np.float64).tobytes() for v in b["v"]])


VECTOR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT r.vec_id, (SELECT count(*) FROM links l WHERE l.a = r.vec_id) AS n_links, component_id, component_id = r.vec_id AS kept FROM roots r
"""
