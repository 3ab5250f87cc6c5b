"""Nearest neighbours with additive quantisation.

A vector is approximated by the sum of one codeword from each of M full-dimensional codebooks; the codebooks are
learned on residuals and a vector's codes are found by beam search. The index keeps the codes, the squared norm of
the vector and the length of what the codes miss, and is partitioned by the first codeword. The search has three
passes, and only the last one touches vectors:

1. *Home*: a query meets the cells nearest to it. A table of its inner products with all codewords and the stored
   norms give an estimate of every squared distance, which is off by at most twice the query's length times the
   missing length. The best estimates are measured on the original vectors; the k-th distance is a first radius.
2. *Scan*: it meets the cells that reach into this radius, again by codes alone. Rows whose lower bound exceeds the
   radius drop out.
3. *Rerank*: the best estimates of those that stay are measured as well, which shortens the radius, and then the
   few rows whose lower bound still lies within it.

So the result is exact, ties included, and vectors move only for pairs that are measured. Exact copies of a vector are
searched once: of each group of equal vectors the index keeps the rows that could be among anyone's k nearest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import hash128, stage_table

BOOKS, WORDS, BEAM = 48, 64, 4
#: Vectors that the codebooks are learned on; every vector is indexed.
FIT_ROWS = 16_384
FIT_STEPS = 6
#: Rows of the cells that give a query its first radius.
HOME_ROWS = 16_384
#: Rows of a cell and queries that meet in one group; they are compared tile by tile.
BLOCK_ROWS, BLOCK_QUERIES = 32_768, 4096
TILE_ROWS, TILE_QUERIES = 512, 512
#: Estimates per neighbour that are measured first in either pass.
SHORTLIST = 3
#: Above so many query groups cells aren't checked for visits, as the table of these is broadcast.
MAX_VISIT_GROUPS = 100_000


def learn_codebooks(x: np.ndarray, books: int = BOOKS, words: int = WORDS, steps: int = FIT_STEPS, seed: int = 7) -> np.ndarray:
    """(books, words, dim): k-means on the residuals that the codebooks before leave."""
    scale = max(float(np.abs(x).max()), 1e-300)
    rng, rest, out = np.random.default_rng(seed), (x / scale).astype(np.float32), []
    for _ in range(books):
        c = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for step in range(steps + 1):
            near = ((c * c).sum(axis=1) - 2 * rest @ c.T).argmin(axis=1)
            if step < steps:
                n = np.bincount(near, minlength=words)
                starts = np.concatenate([[0], np.cumsum(n)])[:-1][n > 0]
                c[n > 0] = np.add.reduceat(rest[np.argsort(near, kind="stable")], starts, axis=0) / n[n > 0, None]
        rest = rest - c[near]
        out.append(c)
    return np.array(out, dtype=np.float64) * scale


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows, books): the best of ``beam`` partial sums at each book goes on."""
    scale = max(float(np.abs(books).max()), 1e-300)
    rows, m, dim = len(x), len(books), x.shape[1]
    rest, codes = (x / scale).astype(np.float32)[:, None, :], np.zeros((rows, 1, m), np.uint8)
    at = np.arange(rows)[:, None]
    for k, c in enumerate((books / scale).astype(np.float32)):
        width = min(beam, rest.shape[1] * len(c))
        cost = (-2 * rest.reshape(-1, dim) @ c.T + (c * c).sum(axis=1)).reshape(rows, rest.shape[1], len(c))
        cost += np.einsum("rbd,rbd->rb", rest, rest)[..., None]
        flat = cost.reshape(rows, -1)
        pick = np.argpartition(flat, width - 1, axis=1)[:, :width]
        src, word = pick // len(c), pick % len(c)
        rest = rest[at, src] - c[word]
        codes = codes[at, src]
        codes[:, :, k] = word
    best = np.einsum("rbd,rbd->rb", rest, rest).argmin(axis=1)
    return codes[np.arange(rows), best]


def approximate(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[m][codes[:, m]] for m in range(len(books)))


def usable(vectors: DataFrame) -> DataFrame:
    """id, v (array of double) of the vectors that take part: not null, not zero, all components finite, and of the
    most common length (the shorter on a tie); others can't be compared with the rest."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & fine)
    size = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return rows.where(F.size("v") == (size["dim"] if size else -1))


def build_index(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """at (a row number), id, v (its doubles as bytes), codes, cell (the first code), norm (squared), miss (length of what
    the codes miss) and reach (distance from the first codeword)."""
    data = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                with np.errstate(all="ignore"):
                    codes = encode(x, data.value)
                    miss = np.sqrt(((x - approximate(codes, data.value)) ** 2).sum(axis=1))
                    reach = np.sqrt(((x - data.value[0][codes[:, 0]]) ** 2).sum(axis=1))
                bytes_of = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), bytes_of(x), bytes_of(codes), pa.array(codes[:, 0].astype(np.int32)), pa.array((x * x).sum(axis=1)), pa.array(miss), pa.array(reach)], names=["id", "v", "codes", "cell", "norm", "miss", "reach"])

    coded = rows.mapInArrow(run, "id bigint, v binary, codes binary, cell int, norm double, miss double, reach double")
    return coded.withColumn("at", F.monotonically_increasing_id())


def without_copies(index: DataFrame, k: int) -> DataFrame:
    """The rows that can be among the k nearest of anything: of equal vectors at most k of each id, and the k + 1
    smallest ids, one of which may be the query's own. Both ranks are cut before rows move, so a hot vector is too."""
    rows = index.select("at", "id", "codes", "cell", "norm", "miss", "reach", *hash128(F.col("v")))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2", "id").orderBy("at"))).where(F.col("n") <= k)
    rows = rows.withColumn("n", F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("n") <= k + 1)
    return rows.drop("n", "h1", "h2")


def exact_distance(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, components summed in order."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        step = q[:, d] - x[:, d]
        total += step * step
    return np.sqrt(total)


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th smallest value of each row as a column; infinite if there are fewer."""
    return np.partition(x, k - 1, axis=1)[:, k - 1 : k] if x.shape[1] >= k else np.full((len(x), 1), np.inf)


def table_scores(q: np.ndarray, codes: np.ndarray, norm: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Estimated squared distances (rows, queries): each query's inner products with all codewords, looked up and added
    code by code, and the stored norms."""
    table = np.einsum("mwd,qd->mwq", books, q, optimize=True)
    dot = np.zeros((len(codes), len(q)))
    for i in range(0, len(codes), TILE_ROWS):
        for m in range(len(books)):
            dot[i : i + TILE_ROWS] += table[m][codes[i : i + TILE_ROWS, m]]
    return (q * q).sum(axis=1)[None, :] + norm[:, None] - 2 * dot


class _Search:
    """One search over one index; cells are described by their rows and their radius, one row for each first codeword."""

    def __init__(self, asked: DataFrame, codes: DataFrame, books: np.ndarray, k: int):
        self.asked, self.codes, self.books, self.k = asked, codes, books, k
        self.spark = codes.sparkSession
        self.data = self.spark.sparkContext.broadcast(books)
        cells = {r["cell"]: (r["n"], r["radius"]) for r in codes.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("radius")).collect()}
        words = books.shape[1]
        self.rows = np.array([cells.get(w, (0, 0.0))[0] for w in range(words)])
        self.radius = np.array([cells.get(w, (0, 0.0))[1] for w in range(words)])
        self.blocks = np.maximum(1, -(-self.rows // BLOCK_ROWS)).astype(int)
        self.groups = max(1, -(-asked.count() // BLOCK_QUERIES))

    def visits(self, home: bool) -> DataFrame:
        """cell, b, g, q, id, v, tau: every query with the blocks of its home cells, or of the cells within its radius tau."""
        data, rows, radius, blocks, groups = self.data, self.rows, self.radius, self.blocks, self.groups

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = b.column(2).to_pylist()
                if not v:
                    continue
                q = np.frombuffer(b"".join(v)).reshape(len(v), -1)
                far = np.sqrt(np.maximum(((q[:, None, :] - data.value[0][None]) ** 2).sum(axis=2), 0))
                if home:
                    order = np.argsort(far, axis=1, kind="stable")
                    before = np.cumsum(rows[order], axis=1) - rows[order]
                    meet = np.zeros(far.shape, bool)
                    np.put_along_axis(meet, order, before < HOME_ROWS, axis=1)
                else:
                    tau = b.column(3).to_numpy(zero_copy_only=False)[:, None]
                    meet = ~(far - radius - 1e-9 * (1 + far + radius) > tau)
                at, cell = np.nonzero(meet & (rows > 0))
                at, cell = np.repeat(at, blocks[cell]), np.repeat(cell, blocks[cell])
                first = np.r_[True, (at[1:] != at[:-1]) | (cell[1:] != cell[:-1])] if len(at) else np.zeros(0, bool)
                place = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
                rest = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(place.astype(np.int32)), *rest.columns], names=["cell", "b", *b.schema.names])

        met = self.asked if not home else self.asked.withColumn("tau", F.lit(float("inf")))
        met = met.select("q", "id", "v", "tau").mapInArrow(run, "cell int, b int, q bigint, id bigint, v binary, tau double")
        return met.withColumn("g", F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int"))

    def meet(self, home: bool) -> DataFrame:
        """q, at, est, low of the rows that the codes can't rule out; in a home pass the best estimates of each group alone."""
        visits, k, data, short = self.visits(home), self.k, self.data, SHORTLIST * self.k
        here = F.pmod(F.xxhash64("at"), F.get(F.array(*[F.lit(int(n)) for n in self.blocks]), F.col("cell"))).cast("int").alias("b")
        rows = self.codes.select("cell", here, F.lit(False).alias("asks"), F.lit(0).cast("long").alias("q"), "at", "id", F.lit(None).cast("binary").alias("v"), F.lit(0.0).alias("tau"), "codes", "norm", "miss")
        if self.groups == 1:
            rows = rows.withColumn("g", F.lit(0))
        elif self.groups <= MAX_VISIT_GROUPS:
            visits = stage_table(visits, "ann-visits")
            rows = rows.join(F.broadcast(visits.groupBy("cell").agg(F.collect_set("g").alias("gs"))), "cell").withColumn("g", F.explode("gs")).drop("gs")
        else:
            rows = rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))))
        left = visits.select("cell", "b", "g", F.lit(True).alias("asks"), "q", F.lit(0).cast("long").alias("at"), "id", "v", "tau", F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("norm"), F.lit(0.0).alias("miss"))
        schema = "q bigint, at bigint, est double, low double"

        def run(_: tuple, g: pd.DataFrame) -> pd.DataFrame:
            asks, have, out = g[g["asks"]], g[~g["asks"]], []
            if len(asks) and len(have):
                books = data.value
                codes = np.frombuffer(b"".join(have["codes"]), np.uint8).reshape(len(have), -1)
                norm, miss, at, ids = (have[c].to_numpy() for c in ("norm", "miss", "at", "id"))
                slack = 1e-9 * float(np.sqrt((books * books).sum(axis=2)).max(axis=1).sum())
                for i in range(0, len(asks), TILE_QUERIES):
                    part = asks.iloc[i : i + TILE_QUERIES]
                    q = np.frombuffer(b"".join(part["v"])).reshape(len(part), -1)
                    length = np.sqrt((q * q).sum(axis=1))
                    with np.errstate(all="ignore"):
                        est = table_scores(q, codes, norm, books).T
                        off = 2 * length[:, None] * (miss + slack)[None, :] + 1e-9 * (1 + length[:, None] ** 2 + norm[None, :])
                        other = part["id"].to_numpy()[:, None] != ids[None, :]
                        high = np.where(other & ~np.isnan(est + off), est + off, np.inf)
                        if home:
                            guess = np.where(other & ~np.isnan(est), est, np.inf)
                            a, b = np.nonzero(other & (guess <= _kth(guess, short)))
                        else:
                            top = np.minimum(_kth(high, k), (part["tau"].to_numpy() ** 2)[:, None])
                            a, b = np.nonzero(other & ~(est - off > top * (1 + 1e-9)))
                        out.append(pd.DataFrame({"q": part["q"].to_numpy()[a], "at": at[b], "est": est[a, b], "low": (est - off)[a, b]}))
            return pd.concat(out) if out else pd.DataFrame({"q": [], "at": [], "est": [], "low": []}).astype({"q": "int64", "at": "int64"})

        both = left.unionByName(rows)
        return both.groupBy("cell", "b", "g").applyInPandas(run, schema)


def _measure(pairs: DataFrame, asked: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, q, vec_id, at, score of pairs (q, at), on the original vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q, x = (np.frombuffer(b"".join(b.column(i).to_pylist())).reshape(b.num_rows, -1) for i in (4, 5))
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(exact_distance(q, x))], names=["query_id", "q", "vec_id", "at", "score"])

    both = pairs.select("q", "at").join(index.select("at", F.col("id").alias("vec_id"), F.col("v").alias("x")), "at")
    both = both.join(asked.select("q", F.col("id").alias("query_id"), "v"), "q")
    return both.select("query_id", "q", "vec_id", "at", "v", "x").mapInArrow(run, "query_id bigint, q bigint, vec_id bigint, at bigint, score double")


def _shortlist(pairs: DataFrame, k: int) -> DataFrame:
    """The pairs of the best estimates of each query."""
    place = F.row_number().over(Window.partitionBy("q").orderBy("est", "at"))
    return pairs.withColumn("n", place).where(F.col("n") <= SHORTLIST * k).drop("n")


def _radius(measured: DataFrame, k: int) -> DataFrame:
    """q, tau: the k-th distance of each query that has so many."""
    nth = F.row_number().over(Window.partitionBy("q").orderBy("score"))
    return measured.withColumn("n", nth).where(F.col("n") == k).select("q", F.col("score").alias("tau"))


def search_stages(vectors: DataFrame, k: int, modulus: int) -> dict[str, DataFrame] | None:
    """The tables of a search: index, asked (q, id, v), pairs (q, at, est, low) that the scan leaves, and the measured
    ones (query_id, q, vec_id, at, score) of the three steps. None without usable vectors."""
    rows = usable(vectors)
    fit = rows.orderBy(F.xxhash64("id"), "id", "v").limit(FIT_ROWS).select("v").toArrow()["v"].combine_chunks()
    if not len(fit):
        return None
    books = learn_codebooks(fit.flatten().to_numpy(zero_copy_only=False).reshape(len(fit), -1))
    index = stage_table(build_index(rows, books), "ann-index")
    codes = stage_table(without_copies(index, k), "ann-codes")
    asked = stage_table(index.where(F.pmod("id", F.lit(modulus)) == 0).select(F.col("at").alias("q"), "id", "v"), "ann-asked")
    search = _Search(asked, codes, books, k)
    home = stage_table(_measure(_shortlist(search.meet(home=True), k), asked, index), "ann-home")
    search.asked = asked.join(_radius(home, k), "q", "left").select("q", "id", "v", F.coalesce("tau", F.lit(float("inf"))).alias("tau"))
    pairs = stage_table(search.meet(home=False), "ann-pairs")
    fresh = pairs.join(home.select("q", "at"), ["q", "at"], "left_anti")
    near = stage_table(_measure(_shortlist(fresh, k), asked, index), "ann-near")
    tau = _radius(home.unionByName(near), k)
    last = fresh.join(near.select("q", "at"), ["q", "at"], "left_anti").join(tau, "q", "left")
    last = last.where(F.col("tau").isNull() | ~(F.col("low") > F.col("tau") * F.col("tau") * (1 + 1e-9)))
    return {"index": index, "asked": asked, "pairs": pairs, "home": home, "near": near, "last": _measure(last, asked, index)}


def nearest(vectors: DataFrame, k: int = 10, modulus: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each row whose id ``modulus`` divides.

    ``vectors`` has vec_id and embedding. Euclidean distance in double precision; ties go to the smaller vec_id;
    fewer rows if there are fewer candidates. Vectors that are null or zero or hold null or non-finite components
    take no part, nor do null ids. Rows that share a vec_id are each a candidate; as queries they count as one, which
    finds the rows nearest to any of them; a query never meets rows of its own id. Other columns are not read.
    """
    found = search_stages(vectors, k, modulus)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    every = reduce(DataFrame.unionByName, [found[c] for c in ("home", "near", "last")])
    return every.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


ANN_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce([(q.e[i] - c.e[i]) * (q.e[i] - c.e[i]) FOR i IN range(1, len(q.e) + 1)], lambda x, y: x + y)) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
