"""Centroid clustering of integer vectors by subvector dictionaries.

Vectors are cut into blocks of ``WIDTH`` dimensions. A chunk of vectors keeps, for each block, the distinct subvectors
that occur in it and one code per vector, from which the vectors come back without loss. In a round a task computes the
exact squared distances of each distinct subvector to the centroids' part in that block once, and adds them up for a vector
by its codes. Sums of a cluster's vectors come from the codes too: each distinct subvector times the number of its
vectors in the cluster.

Dictionaries belong to chunks, not to the table: no dictionary grows with the data, none is broadcast, and vectors
don't move. A task adds up what its chunks give, and a round exchanges one row per task and cluster. All arithmetic is
in integers: 64-bit ones where no sum can pass them, Python's own where one could.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import stage_table

CLUSTERS, ROUNDS, DIM, SCALE, SEED = 40, 5, 64, 256, 2
#: Dimensions of a block and vectors of a chunk.
WIDTH, CHUNK = 2, 1 << 15
#: Components up to this size keep every sum of a chunk within 64 bits; vectors with one beyond LIMIT take no part.
SMALL, LIMIT = 1 << 24, 1 << 62
CHUNK_SCHEMA = "ids array<bigint>, codes binary, sizes array<int>, subvectors binary, small boolean"
MOST = (1 << 63) - 1


def integer_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of long): floor(``scale`` * x) of the vectors with exactly ``dim`` components, none null or non-finite."""
    v = F.col("embedding").cast("array<double>")
    limit = float(LIMIT)
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < limit))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """(clusters, dim): the vectors whose hashed ids come first; rows of one id in order of their components."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select("v", mark.alias("mark")).orderBy(F.col("mark").asc_nulls_last(), "v").limit(clusters).collect()
    return np.array([r["v"] for r in first], dtype=np.int64)


def encode_chunks(rows: DataFrame, width: int = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """One row per chunk: ids, codes (blocks x vectors, 32-bit), sizes of the dictionaries, their subvectors, and whether all are small."""

    def encode(ids: list[pa.Array], parts: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(parts)
        codes, sizes, books = [], [], []
        for at in range(0, x.shape[1], width):
            book, code = np.unique(x[:, at : at + width], axis=0, return_inverse=True)
            codes.append(code.reshape(-1).astype(np.int32))
            sizes.append(len(book))
            books.append(book.tobytes())
        data = [pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64())), pa.array([b"".join(c.tobytes() for c in codes)]), pa.array([sizes], pa.list_(pa.int32())), pa.array([b"".join(books)]), pa.array([bool(np.abs(x).max() <= SMALL)])]
        return pa.RecordBatch.from_arrays(data, names=["ids", "codes", "sizes", "subvectors", "small"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n = [], [], 0
        for b in batches:
            for i in range(0, b.num_rows, chunk):
                part = b.slice(i, chunk)
                ids.append(part.column(0))
                parts.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                n += part.num_rows
                if n >= chunk:
                    yield encode(ids, parts)
                    ids, parts, n = [], [], 0
        if n:
            yield encode(ids, parts)

    return rows.mapInArrow(run, CHUNK_SCHEMA)


def dictionaries(codes: bytes, sizes: list[int], subvectors: bytes, dim: int, width: int = WIDTH) -> list[tuple[slice, np.ndarray, np.ndarray]]:
    """(dimensions, codes, subvectors) of every block of a chunk."""
    out, at = [], 0
    every = np.frombuffer(codes, np.int32).reshape(len(sizes), -1)
    flat = np.frombuffer(subvectors, np.int64)
    for k, size in enumerate(sizes):
        dims = slice(k * width, min(dim, (k + 1) * width))
        w = dims.stop - dims.start
        out.append((dims, every[k], flat[at : at + size * w].reshape(size, w)))
        at += size * w
    return out


def assign(blocks: list[tuple[slice, np.ndarray, np.ndarray]], centroids: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and squared distance of every vector of a chunk, from one distance per distinct subvector and centroid."""
    kind = np.int64 if small and (not centroids.size or np.abs(centroids).max() <= SMALL) else object
    c, total = centroids.astype(kind), None
    for dims, code, book in blocks:
        b = book.astype(kind)
        part = sum((b[:, j, None] - c[None, :, dims.start + j]) ** 2 for j in range(b.shape[1]))
        total = part[code] if total is None else total + part[code]
    best = np.argmin(total, axis=1) if kind is np.int64 else np.array([min(range(len(r)), key=r.__getitem__) for r in total], dtype=np.int64)
    return best, total[np.arange(len(best)), best]


def cluster_sums(blocks: list[tuple[slice, np.ndarray, np.ndarray]], cluster: np.ndarray, clusters: int, dim: int, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of each cluster and the sums of their components: distinct subvectors times how many of the cluster have them."""
    kind = np.int64 if small else object
    sums = np.zeros((clusters, dim), dtype=kind)
    for dims, code, book in blocks:
        hits = np.bincount(cluster * len(book) + code, minlength=clusters * len(book)).reshape(clusters, -1)
        sums[:, dims] = hits.astype(kind) @ book.astype(kind)
    return np.bincount(cluster, minlength=clusters), sums


def _sums(chunks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, n, sums (exact) with one row per task and cluster."""
    clusters, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = [0] * clusters, np.zeros((clusters, dim), dtype=object)
        for b in batches:
            for r in b.to_pylist():
                blocks = dictionaries(r["codes"], r["sizes"], r["subvectors"], dim)
                cluster, _ = assign(blocks, centroids, r["small"])
                hits, part = cluster_sums(blocks, cluster, clusters, dim, r["small"])
                n = [x + int(y) for x, y in zip(n, hits, strict=True)]
                sums = sums + part.astype(object)
        some = [k for k in range(clusters) if n[k]]
        values = [[Decimal(int(x)) for x in sums[k]] for k in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([n[k] for k in some], pa.int64()), pa.array(values, pa.list_(pa.decimal128(38, 0)))], names=["cluster", "n", "sums"])

    return chunks.select("codes", "sizes", "subvectors", "small").mapInArrow(run, "cluster int, n bigint, sums array<decimal(38,0)>")


def move_centroids(chunks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor(sum / count) of what is nearest to each; one that nothing is nearest to stays."""
    dim = centroids.shape[1]
    parts = _sums(chunks, centroids).groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(j))) for j in range(dim)]).alias("sums"))
    out = centroids.copy()
    for r in parts.collect():  # one row per cluster
        out[r["cluster"]] = [int(x) // r["n"] for x in r["sums"]]
    return out


def assigned(chunks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector; a distance that no long holds is null."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i] for c in b.schema.names}
                cluster, distance = assign(dictionaries(r["codes"].as_py(), r["sizes"].as_py(), r["subvectors"].as_py(), dim), centroids, r["small"].as_py())
                held = pa.array(distance if distance.dtype == np.int64 else [int(x) if x <= MOST else None for x in distance], pa.int64())
                yield pa.RecordBatch.from_arrays([r["ids"].values, pa.array(cluster.astype(np.int32)), held], names=["vec_id", "cluster", "distance"])

    return chunks.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of every vector that takes part; the centroids) after ``rounds`` rounds.

    ``vectors`` has vec_id and embedding; other columns aren't read. Those with exactly ``dim`` components, none null or
    non-finite, take part, each component x as floor(``scale`` * x); components beyond 2^62 count as non-finite, as no
    distance to them is a long. Centroids start as the vectors whose ids hash first, null ids last; fewer vectors give
    fewer clusters, and none gives no rows. Ties go to the smaller number, so that of equal centroids only the first keeps
    vectors. Repeated rows count again and each gets its result. Distances and sums are exact.
    """
    rows = integer_vectors(vectors, dim, scale)
    centroids = first_centroids(rows, clusters, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), centroids
    chunks = stage_table(encode_chunks(rows), "centroid-chunks")
    for _ in range(rounds):
        centroids = move_centroids(chunks, centroids)
    return assigned(chunks, centroids), centroids


def clusters_digest(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of ``cluster_vectors``; sums beyond a long are null."""
    found, centroids = cluster_vectors(vectors, clusters, rounds, dim, scale, seed)
    spark = vectors.sparkSession
    marks = [(k, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centroids)]
    found = stage_table(found, "centroid-assigned")
    whole = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(whole.alias("s")).collect()}
    held = lambda x: None if x is None or x > MOST else int(x)
    every = held(None if None in sums.values() else sum(sums.values()))
    facts = spark.createDataFrame([(k, held(sums.get(k)), every, h) for k, h in marks], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row per cluster


def _round_sql(k: int, rounds: int = ROUNDS) -> str:
    near = f"""n{k} AS MATERIALIZED (SELECT id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT id, c, list_sum([(x[j] - m[j]) * (x[j] - m[j]) FOR j IN range(1, 65)])::BIGINT AS d FROM v, c{k}) GROUP BY id)"""
    if k == rounds:
        return near
    return near + f""",
s{k} AS (SELECT c, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM n{k} JOIN v USING (id), unnest(range(1, 65)) AS t(j) GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT a.c, coalesce(b.m, a.m) AS m FROM c{k} a LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS m FROM s{k} GROUP BY c) b USING (c))"""


CENTROID_SQL = f"""
WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS id, [floor(256 * e)::BIGINT FOR e IN embedding::DOUBLE[]] AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x AS m FROM (SELECT sha256('2:' || vec_id) AS h, x FROM v ORDER BY h LIMIT 40)),
{", ".join(_round_sql(k) for k in range(ROUNDS + 1))}
SELECT vec_id, n.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY n.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM n{ROUNDS} n JOIN v USING (id) JOIN c{ROUNDS} c ON c.c = n.c
"""
