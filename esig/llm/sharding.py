"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

For every input partition the number of rows it sends to each shard is drawn beforehand, so that row and column
sums come out exactly (multivariate hypergeometric). Each partition permutes its rows and deals them out by those
counts; after the exchange every shard permutes what it got. The result is a uniformly random permutation cut into
shards whose row counts differ by at most one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import stage_table

SHARDS = 40
SEED = 20_240_601
#: Partitions are joined to at most so many rows of the matrix, which the driver draws.
MAX_GROUPS = 8192
#: Rows of a shard that one task orders.
SLOT_BLOCK = 200_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` taken without return from good + bad are good, for counts of any size.

    Inversion over the values within 14 standard deviations of the mode, whose ratios are exact.
    """
    lo, hi = max(0, draws - bad), min(draws, good)
    if lo == hi:
        return lo
    total = good + bad
    share = good / total
    spread = int(14 * np.sqrt(max(draws * share * (1 - share) * (total - draws) / max(1, total - 1), 1.0))) + 20
    mode = min(max(int((draws + 1) * (good + 1) / (total + 2)), lo), hi)
    k = np.arange(max(lo, mode - spread), min(hi, mode + spread) + 1, dtype=np.float64)
    up = np.log(good - k[:-1]) + np.log(draws - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - draws + k[:-1] + 1)
    logs = np.concatenate([[0.0], np.cumsum(up)])
    p = np.cumsum(np.exp(logs - logs.max()))
    return int(k[min(np.searchsorted(p, rng.random() * p[-1], side="right"), len(k) - 1)])


def communication_matrix(rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """Counts sent from each partition to each shard; columns are even to within one."""
    rng, total = np.random.default_rng(seed), sum(rows)
    left = [total // shards + (j < total % shards) for j in range(shards)]
    out = []
    for n in rows:
        sent, rest = [], sum(left)
        for have in left:
            rest -= have
            got = hypergeometric(rng, have, rest, n)
            sent.append(got)
            n -= got
        left = [a - b for a, b in zip(left, sent, strict=True)]
        out.append(sent)
    return out


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of ``docs``.

    Size is the text's UTF-8 bytes (null: none) plus 16; the CRC of a null text is that of an empty one. Slots run
    from 0 without a gap in every shard that has rows. Each row counts by itself, whether or not its doc_id or text
    repeats. Only ids, sizes and checksums move. Other columns are not read.

    The draw depends on how the rows are cut into partitions: reruns on the same partitions agree, and within one run the
    rows are numbered in a written table, so tasks that run again deal alike; other partitions give another shuffle.
    """
    spark, text = docs.sparkSession, F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = stage_table(rows.withColumn("at", F.monotonically_increasing_id()), "shard-rows")
    part = F.shiftright("at", 33)
    last = rows.agg(F.max(part)).first()[0]
    width = ((last or 0) + MAX_GROUPS) // MAX_GROUPS
    group = F.floor(part / width).cast("long")
    sizes = {r["g"]: r["n"] for r in rows.groupBy(group.alias("g")).agg(F.count("*").alias("n")).collect()}
    order = sorted(sizes)
    matrix = communication_matrix([sizes[g] for g in order], shards, seed)
    deal = spark.createDataFrame([(g, [int(x) for x in np.cumsum(sent)]) for g, sent in zip(order, matrix, strict=True)], "g bigint, ends array<bigint>")
    drawn = F.xxhash64(F.lit(seed), "at")
    rows = rows.select("*", group.alias("g"), F.row_number().over(Window.partitionBy(group).orderBy(drawn, "at")).alias("nth"))
    rows = rows.join(deal, "g").select("doc_id", "size", "text_crc32", "at", F.size(F.filter("ends", lambda e: e < F.col("nth"))).alias("shard"))
    blocks = max(1, -(-sum(sizes.values()) // (shards * SLOT_BLOCK)))
    again = F.xxhash64(F.lit(seed + 1), "at")
    rows = stage_table(rows.select("*", again.alias("r"), F.pmod(again, F.lit(blocks)).cast("int").alias("b")), "shard-dealt")
    offsets = rows.groupBy(F.col("shard").alias("s"), F.col("b").alias("q")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stage_table(offsets.select("s", "q", before.alias("before")), "shard-offsets")
    rows = rows.select("*", F.row_number().over(Window.partitionBy("shard", "b").orderBy("r", "at")).alias("i"))
    rows = rows.join(offsets, (F.col("shard") == F.col("s")) & (F.col("b") == F.col("q")))
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("i") - 1).cast("long").alias("slot"))
