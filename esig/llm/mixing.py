"""Mixing sources to target weights by systematic sampling.

Within a source every document has the same expected number of copies, target / source size. The prefix sum of
these along the source, in order of size and doc_id, plus one random offset per source is cut at the integers: a
document comes once for each integer that its step crosses. Neighbours in that order have near-equal sizes, so the
words taken come close to the target.

The prefix sum needs each document's rank in its source. Documents are range-partitioned by (source, size,
doc_id), so that a hot source spreads over many partitions; a rank is the count of the source's rows in earlier
partitions plus the position within the own one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import BLANK_CLASS, BLANKS, stage_table

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters outside ASCII white space; null counts as none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, BLANK_CLASS + "+"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target of a table (source, size): weights cycle over the sources in code point order, null last.

    Targets share the total by weight and stop at ``cap`` times the source's size; what is over is shared again
    by weight. That process ends where every target is the smaller of the cap and weight times one common level,
    which is found in closed form: sources in order of cap per weight, the level if the first k are capped, and the
    first k whose level the next source's cap bears. Sums are integers, so the result doesn't depend on their order.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (n % len(weights) + 1).cast("int")).cast("long")).withColumn("n", n)
    order = Window.orderBy(F.col("source_size") / F.col("w"), "n")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    capped, light = F.coalesce(F.sum("source_size").over(before), F.lit(0)), F.coalesce(F.sum("w").over(before), F.lit(0))
    by = by.withColumn("level", (F.sum("source_size").over(every) - cap * capped) / (F.sum("w").over(every) - light))
    fits = F.min(F.when(F.col("level") * F.col("w") <= cap * F.col("source_size"), F.struct(F.col("source_size") / F.col("w"), "n", "level"))).over(every)
    target = F.least((cap * F.col("source_size")).cast("double"), F.col("w") * fits["level"])
    return by.select("source", "source_size", target.alias("target"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every row of ``docs`` (doc_id, text, source).

    Null and empty texts have size 0 and take no words; sources of size 0 have target 0. Copies never exceed
    ``cap``. Equal rows are told apart by order only, so reruns return the same rows. Other columns are not read.
    """
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    return _plan(sizes, weights, cap, seed)


def _plan(sizes: DataFrame, weights: tuple[int, ...], cap: int, seed: str, more: tuple[str, ...] = ()) -> DataFrame:
    """The plan of rows (doc_id, source, size) and the columns ``more``, which order rows that are equal in these."""
    sizes = stage_table(sizes, "mix-sizes")
    targets = stage_table(source_targets(sizes, weights, cap), "mix-targets")
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id"), *map(F.col, more)]
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage_table(sizes.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "mix-order")
    part = F.shiftright("at", 33)
    blocks = ranged.groupBy(part.alias("p"), F.col("source").alias("s")).agg(F.count("*").alias("n"), F.min("at").alias("first_at"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = stage_table(blocks.select("p", "s", "first_at", before.alias("before")), "mix-blocks")
    ranked = ranged.join(blocks, (part == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    ranked = ranked.select("doc_id", "source", "size", *more, (F.col("before") + F.col("at") - F.col("first_at") + 1).alias("rank"))
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    rows = ranked.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    digest = F.md5(F.concat(F.lit(seed), F.when(F.col("source").isNull(), "?").otherwise(F.concat(F.lit(":"), F.col("source")))))
    offset = F.conv(F.substring(digest, 1, 5), 16, 10).cast("double") / 1048576.0
    crossed = F.floor(offset + each * F.col("rank")) - F.floor(offset + each * (F.col("rank") - 1))
    return rows.select("doc_id", "source", "size", "source_size", "target", F.least(crossed, F.lit(cap)).cast("long").alias("copies"), *more)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """``docs`` with each row as often as its mix takes it, all columns kept.

    Copies are planned by row; rows that share doc_id, source and size are told apart by their texts, and equal rows
    by order.
    """
    rows = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("row_at"))  # packed, so that no name of a column can clash
    rows = stage_table(rows, "mix-rows")
    text = F.col("row.text").cast("string")
    sizes = rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("text_hash"), "row_at")
    plan = _plan(sizes, weights, cap, seed, ("text_hash", "row_at")).where("copies > 0").select("row_at", "copies")
    each = F.sequence(F.lit(1), F.col("copies").cast("int"))
    return rows.join(plan.hint("shuffle_hash"), "row_at").select("row", F.explode(each)).select("row.*")


MIX_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM sizes GROUP BY source),
weighted AS (SELECT *, CASE n % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0))::DOUBLE
            / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS level
  FROM weighted WINDOW before AS (ORDER BY source_size::DOUBLE / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT level AS l FROM levels WHERE level * w <= 3 * source_size ORDER BY source_size::DOUBLE / w, n LIMIT 1),
targets AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, w * l) AS target,
         ('0x' || substr(md5('mix-1' || CASE WHEN source IS NULL THEN '?' ELSE ':' || source END), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u,
         CASE WHEN source_size > 0 THEN least((3 * source_size)::DOUBLE, w * l) / source_size ELSE 0 END AS e
  FROM levels, chosen),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS r FROM sizes)
SELECT r.doc_id, r.size::BIGINT AS size, t.source_size, t.target,
       (least(floor(u + e * r.r) - floor(u + e * (r.r - 1)), 3))::BIGINT * r.size AS taken
FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
"""
