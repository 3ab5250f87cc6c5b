"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation.

1. One pass over the texts gives every document the size and a 128-bit hash of its set of word shingles, a
   signature of 504 MinHash values cut to a byte each, and 42 band keys of 6 values. Documents of equal sets
   become one node.
2. Nodes that share a band key are candidates. First every member of a bucket meets the bucket's smallest node and
   the smallest of its size class, which is linear in the bucket. Where a bucket still holds several components,
   their members meet in blocks of bounded size, signatures only: first every node offers its most similar
   candidate, then, as components have grown, all pairs that remain between components.
3. Candidates are compared signature batch by signature batch. After each, the posterior of their similarity under
   a uniform prior is bounded; pairs whose chance to reach the threshold is under ``MISS`` are pruned.
4. Survivors are confirmed on their full shingle sets, and links are closed to components by large-star and
   small-star steps.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import salted_join, sieve, sift, stage_table, text_chunks

WORDS = 5
#: Similarity from which documents are linked, as a fraction.
LINK = (80, 100)
BANDS, ROWS = 42, 6
#: Values of a signature, and of the part that is compared at a time; the bands use the first 252.
HASHES, BATCH = 504, 42
#: Chance at which a pair is given up after a signature batch.
MISS = 1e-6
#: Rows of a block of a bucket: outside and inside the component of its hub.
BLOCK, INNER_BLOCK = 256, 1024
SIGNATURE_SCHEMA = "doc_id bigint, at bigint, t bigint, n bigint, s1 bigint, s2 bigint, sig binary, bands array<bigint>"
_RNG = np.random.default_rng(0x5117)
_MUL = _RNG.integers(1, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_BAND = _RNG.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_STEP = _RNG.integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles.

    Words are runs outside ASCII white space with A-Z lower-cased. A text of fewer words has one shingle, its whole
    sequence; one without words has none.
    """
    split = [t.encode().lower().split() if t else [] for t in texts]
    every = np.array([w for ws in split for w in ws], dtype=object)
    hashed = pd.util.hash_array(every, categorize=False) if len(every) else np.zeros(0, np.uint64)
    out, at = [], 0
    for ws in split:
        h, at = hashed[at : at + len(ws)], at + len(ws)
        if not len(h):
            out.append(h)
            continue
        k = min(words, len(h))
        x = np.full(len(h) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            x += _mix(h[i : len(h) - k + 1 + i]) * _STEP[i]
        out.append(np.unique(_mix(x)))
    return out


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of 32 bits, in blocks that stay in cache."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 256):
        np.minimum(low, (x[i : i + 256, None] * _MUL + _ADD).min(axis=0), out=low)
    return low


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SIGNATURE_SCHEMA.split(", ")]
    for b in text_chunks(batches, 3):
        n, s1, s2, sig, bands = [], [], [], [], []
        for s in shingle_sets(b.column(3).to_pylist()):
            n.append(len(s))
            if not len(s):
                s1.append(None), s2.append(None), sig.append(None), bands.append(None)
                continue
            digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype="<i8")
            low = min_hashes(s)
            keys = _mix((low[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64) * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
            s1.append(int(digest[0])), s2.append(int(digest[1]))
            sig.append(((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes())
            bands.append(keys.view(np.int64).tolist())
        cols = [b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def posterior_bounds(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches that keep a pair) after each signature batch.

    Under a uniform prior m matches of n leave the match rate c with a Beta(m + 1, n - m + 1) posterior, whose
    upper tail is a binomial sum: P(rate >= c) = P(Binomial(n + 1, c) <= m). Byte values match by chance in 1 of
    256 cases, so a similarity s means a rate of at least s.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _prune(pairs: DataFrame, signatures: DataFrame, link: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) whose sizes allow a link and whose similarity the signatures don't rule out."""
    one = signatures.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    two = signatures.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    bounds = posterior_bounds(link[0] / link[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, HASHES)
            right = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, HASHES)
            live, same = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
            for n, least in bounds:
                same = same + (left[live, n - BATCH : n] == right[live, n - BATCH : n]).sum(axis=1)
                live, same = live[same >= least], same[same >= least]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(live)), b.column(1).take(pa.array(live))], names=["a", "b"])

    both = pairs.join(one, "a").join(two, "b").where(link[1] * F.least("na", "nb") >= link[0] * F.greatest("na", "nb"))
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


class _Texts:
    """Texts of nodes, fetched from the documents once for each node that a pair needs. A sieve of bounded size holds
    back the others before anything moves."""

    def __init__(self, docs: DataFrame, nodes: DataFrame):
        self.docs, self.nodes, self.have = docs, nodes, None

    def of(self, pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        if self.have is not None:
            wanted = wanted.join(self.have.select("node"), "node", "left_anti")
        wanted = stage_table(self.nodes.join(wanted, "node").select("node", F.col("doc_id").alias("d"), F.col("t").alias("w")), "near-wanted")
        docs = sift(self.docs.select("doc_id", "text", F.xxhash64("text").alias("t")), F.col("t"), sieve(wanted, F.col("w"))).where("maybe")
        found = docs.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("w")))
        found = stage_table(found.select("node", "text").dropDuplicates(["node"]), "near-texts")
        self.have = found if self.have is None else self.have.unionByName(found)
        return self.have


def _confirm(pairs: DataFrame, fetch: _Texts, link: tuple[int, int]) -> DataFrame:
    """Pairs whose full shingle sets reach the link threshold."""
    pairs = stage_table(pairs, "near-pairs")
    texts = fetch.of(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, np.ndarray] | None = None
        for b in text_chunks(batches, 3):
            a, hit = b.column(0).to_pylist(), []
            ones = b.column(2).to_pylist()
            for i, two in enumerate(shingle_sets(b.column(3).to_pylist())):
                if last is None or last[0] != a[i]:
                    last = (a[i], shingle_sets([ones[i]])[0])
                both = len(np.intersect1d(last[1], two, assume_unique=True))
                hit.append(link[1] * both >= link[0] * (len(last[1]) + len(two) - both))
            keep = pa.array(np.flatnonzero(hit))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], names=["a", "b"])

    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return stage_table(both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint"), "near-links")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of ``edges`` (a, b).

    Alternates large-star and small-star steps, each written out, until the edges no longer change.
    """
    mark, edges = None, edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v")
    edges = stage_table(edges.distinct(), "near-edges")
    while True:
        for large in (True, False):
            near = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u"))) if large else edges
            low = near.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
            met = near.join(low, "v")
            if large:
                new = met.where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
            else:
                new = met.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(low.select("v", F.col("m").alias("u")))
            edges = stage_table(new.where("u <> v").distinct(), "near-edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        mark = now


def _by_group(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pd.DataFrame]:
    """Runs of rows that agree in the first ``width`` columns; the rows come sorted by them."""
    rest: list[pd.DataFrame] = []
    for b in batches:
        rows = b.to_pandas()
        keys = rows.iloc[:, :width].to_numpy()
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(rows)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if rest and j > i and (rest[-1].iloc[0, :width].to_numpy() != keys[i]).any():
                yield pd.concat(rest) if len(rest) > 1 else rest[0]
                rest = []
            if j > i:
                rest.append(rows.iloc[i:j])
    if rest:
        yield pd.concat(rest) if len(rest) > 1 else rest[0]


def _cross(members: DataFrame, nodes: DataFrame, roots: DataFrame, link: tuple[int, int], best: bool) -> DataFrame:
    """Candidates (a, b) between components that meet in a bucket, pruned by their signatures.

    The members outside the component of the bucket's hub are cut into blocks, and so are those inside it. A task
    compares one block of the former with one other block, so no bucket has to fit into a task, and pairs inside the
    hub's component, which is the large one, are never looked at. ``best`` keeps for each node its most similar
    candidate alone; else a pair comes out once, from the first band that it shares.
    """
    root = lambda c, name: F.coalesce(F.col(name), F.col(c)).alias(name)
    met = members.join(roots.withColumnRenamed("root", "r"), "node", "left").select("k", "node", "hub", root("node", "r"))
    met = met.join(roots.select(F.col("node").alias("hub"), F.col("root").alias("h")), "hub", "left").select("k", "node", "hub", "r", root("hub", "h"))
    met = met.where("node <> hub")
    outside = F.col("r") != F.col("h")
    mixed = met.groupBy("k").agg(F.sum(outside.cast("long")).alias("out"), F.sum((~outside).cast("long")).alias("inn"), F.min("r").alias("lo"), F.max("r").alias("hi"))
    mixed = mixed.where("lo <> hi").select("k", F.ceil(F.col("out") / BLOCK).cast("int").alias("no"), F.ceil(F.col("inn") / INNER_BLOCK).cast("int").alias("ni"))
    met = met.join(mixed, "k")
    own = F.when(outside, F.pmod(F.xxhash64("node"), F.col("no"))).otherwise(F.col("no") + F.pmod(F.xxhash64("node"), F.col("ni"))).cast("int")
    every = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j"))
    others = F.when(outside, every(F.col("no") + F.col("ni"))).otherwise(every(F.col("no")))
    dealt = met.withColumn("own", own).select("k", "node", "hub", "r", "own", F.explode(F.transform(others, pair)).alias("p"))
    dealt = dealt.join(nodes, "node").select("k", "p.i", "p.j", "own", "node", "r", "n", "sig", "bands")
    dealt = dealt.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
    bounds = posterior_bounds(link[0] / link[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _by_group(batches, 3):
            k, i, j = (int(x) for x in g.iloc[0, :3])
            one = g[g.own == i]
            two = one if i == j else g[g.own == j]
            if not len(one) or not len(two):
                continue
            na, nb = one.n.to_numpy()[:, None], two.n.to_numpy()[None, :]
            fit = (one.r.to_numpy()[:, None] != two.r.to_numpy()[None, :]) & (link[1] * np.minimum(na, nb) >= link[0] * np.maximum(na, nb))
            a, b = np.nonzero(np.triu(fit, 1) if i == j else fit)
            left = np.frombuffer(b"".join(one.sig), np.uint8).reshape(-1, HASHES)
            right = np.frombuffer(b"".join(two.sig), np.uint8).reshape(-1, HASHES)
            same = np.zeros(len(a), np.int64)
            for n, least in bounds:
                same = same + (left[a, n - BATCH : n] == right[b, n - BATCH : n]).sum(axis=1)
                live = same >= least
                a, b, same = a[live], b[live], same[live]
            if not len(a):
                continue
            x, y = one.node.to_numpy()[a], two.node.to_numpy()[b]
            if best:
                order = np.argsort(-same, kind="stable")
                first = np.unique(x[order], return_index=True)[1]
                again = np.unique(y[order], return_index=True)[1] if i == j or two.own.iloc[0] < one.own.iloc[0] else np.zeros(0, np.int64)
                keep = np.unique(np.concatenate([order[first], order[again]]))
            else:
                ba, bb = np.array(one.bands.tolist()), np.array(two.bands.tolist())
                equal = ba[a] == bb[b]
                keep = np.flatnonzero(ba[a, equal.argmax(axis=1)] == k)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[keep]), pa.array(np.maximum(x, y)[keep]), pa.array(x[keep]), pa.array(same[keep])], names=["a", "b", "x", "same"])

    found = dealt.mapInArrow(run, "a bigint, b bigint, x bigint, same bigint")
    if best:
        found = found.groupBy("x").agg(F.max(F.struct("same", "a", "b")).alias("t")).select("t.a", "t.b")
    return found.select("a", "b").distinct()


def keep_one(docs: DataFrame, link: tuple[int, int] = LINK) -> DataFrame:
    """One row of each group of ``docs``, all columns kept: of the rows with the smallest doc_id, null last, the first.

    Groups are those of ``near_duplicates``, so repeated rows are a group too; rows without shingles all stay.
    """
    rows = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at"))  # packed, so that no name of a column can clash
    rows = stage_table(rows, "near-rows")
    judged = _judged(rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"), "at"), link)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "at"))["at"]
    kept = judged.groupBy(F.coalesce("root", "at").alias("group"), F.col("root").isNull().alias("alone")).agg(first.alias("at"))
    return rows.join(stage_table(kept.select("at"), "near-stay").hint("shuffle_hash"), "at", "left_semi").select("row.*")


def near_duplicates(docs: DataFrame, link: tuple[int, int] = LINK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash for every row of ``docs`` (doc_id, text).

    Two documents are linked if the Jaccard similarity of their shingle sets is at least ``link``; a component_id
    is the smallest doc_id that links reach, and the document that bears it is kept. Null, empty and blank texts
    have no shingles and are linked with nothing. Rows that share a doc_id are judged by their own texts. Other
    columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = _judged(docs.withColumn("at", F.monotonically_increasing_id()), link)
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.col("t").alias("text_hash"))


def _judged(docs: DataFrame, link: tuple[int, int]) -> DataFrame:
    """doc_id, at, n, t, component_id and root of every row of ``docs`` (doc_id, text, at); root names the row's group, null without shingles."""
    rows = docs.select("doc_id", "at", F.xxhash64("text").alias("t"), "text").mapInArrow(_sign, SIGNATURE_SCHEMA)
    rows = stage_table(rows, "near-signatures")
    classes = rows.where("n > 0").groupBy("s1", "s2").agg(F.min("at").alias("node"), F.min("doc_id").alias("low"))
    classes = stage_table(classes, "near-classes")
    nodes = stage_table(rows.join(classes.select("node"), F.col("at") == F.col("node")).select("node", "doc_id", "t", "n", "sig", "bands"), "near-nodes")

    size = F.floor(F.log("n") / math.log(link[1] / link[0])).cast("int")
    spread = nodes.select("node", "n", size.alias("c"), F.explode("bands").alias("k"))
    hubs = spread.groupBy("k").agg(F.min("node").alias("hub"), F.count("*").alias("m")).where("m > 1").select("k", "hub")
    members = stage_table(salted_join(spread, hubs, ["k"], F.xxhash64("node")), "near-members")
    close = members.groupBy("k", "c").agg(F.min("node").alias("hub2"))
    stars = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    stars = stars.unionByName(salted_join(members, close, ["k", "c"], F.xxhash64("node")).where("node <> hub2 AND hub2 <> hub").select(F.col("hub2").alias("a"), F.col("node").alias("b"))).distinct()
    texts = _Texts(docs, nodes)
    edges = _confirm(_prune(stars, nodes, link), texts, link)
    roots = components(edges)
    for best in (True, False):
        found = _confirm(_cross(members, nodes, roots, link, best), texts, link)
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))

    ids = classes.join(roots, "node", "left").select("s1", "s2", "low", F.coalesce("root", "node").alias("root"))
    lowest = ids.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = stage_table(ids.join(lowest, "root").select("s1", "s2", "component_id", "root"), "near-ids")
    rows, ends = rows.select("doc_id", "at", "n", "s1", "s2", "t"), ids.select("s1", "s2", "component_id", "root")
    some = salted_join(rows.where("n > 0"), ends, ["s1", "s2"], F.xxhash64("at"), "left").drop("s1", "s2")  # a set may have many copies
    bare = rows.where("n = 0").drop("s1", "s2").withColumns({"component_id": F.lit(None).cast("long"), "root": F.lit(None).cast("long")})
    return some.unionByName(bare)


NEAR_SQL = r"""
WITH RECURSIVE lists AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS p, len(w) AS n FROM lists),
runs AS (
  SELECT doc_id, n, p, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS x
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
shingles AS (SELECT DISTINCT doc_id, hash(x) AS x FROM runs WHERE p <= greatest(n - 5, 0)),
sets AS (SELECT l.doc_id, count(x) AS s FROM lists l LEFT JOIN shingles USING (doc_id) GROUP BY l.doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b
  WHERE 100 * n >= 85 * (p.s + q.s - n)),
reach(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, s AS n_shingles, component_id, component_id = doc_id AS kept FROM sets JOIN roots USING (doc_id)
"""
