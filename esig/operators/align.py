"""Joins and alignments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .select import small


def merge_parcels(parcels: DataFrame, wanted: DataFrame) -> DataFrame:
    """Vertices of each region: the distinct union of its parcels. ``wanted`` (roi, parcel) may overlap."""
    return parcels.join(small(wanted), "parcel").select("roi", "vertex").distinct()


def unknown_parcels(parcels: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(parcels.select("parcel").distinct(), "parcel", "left_anti")


def minus_mask(members: DataFrame, mask: DataFrame) -> DataFrame:
    return members.join(mask.select("vertex").distinct(), "vertex", "left_anti")


def in_source_space(members: DataFrame, space: DataFrame) -> DataFrame:
    return members.join(space.select("vertex").distinct(), "vertex", "left_semi")


def all_pairs(rois: DataFrame, roi: str = "roi", directed: bool = False) -> DataFrame:
    """Unordered pairs i < j of the distinct names, or all ordered pairs. The names are a small dimension."""
    names = rois.select(roi).distinct().agg(F.sort_array(F.collect_set(roi)).alias("names"))
    one = names.select("names", F.explode("names").alias("pair_i")).select("pair_i", F.explode("names").alias("pair_j"))
    return one.where(F.col("pair_i") != F.col("pair_j") if directed else F.col("pair_i") < F.col("pair_j"))


def explicit_pairs(texts: DataFrame, rois: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, unresolved) of texts 'a:b' or 'a->b', whatever their case."""
    parts = F.split("text", r"\s*(?:->|:)\s*")
    asked = texts.select("text", F.lower(F.trim(F.get(parts, F.lit(0)))).alias("a"), F.lower(F.trim(F.get(parts, F.lit(1)))).alias("b"))
    names = small(rois.select("roi").distinct())
    left, right = (names.select(F.lower("roi").alias(k), F.col("roi").alias(v)) for k, v in (("a", "src"), ("b", "tgt")))
    found = asked.join(left, "a", "left").join(right, "b", "left")
    good = F.col("src").isNotNull() & F.col("tgt").isNotNull()
    return found.where(good).select("src", "tgt"), found.where(~good).select("text")


def match_pairs(one: DataFrame, two: DataFrame, exact: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of both runs (src, tgt, fxy, fyx each) side by side as _a and _b.

    Unless ``exact``, the orientation doesn't matter: ``flip`` marks pairs that the second run has the other way round,
    and its two directions are swapped to fit.
    """
    name = lambda df, s: df.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in ("src", "tgt", "fxy", "fyx")])
    a, b = name(one, "a"), name(two, "b")
    if exact:
        on = (F.col("src_a") == F.col("src_b")) & (F.col("tgt_a") == F.col("tgt_b"))
    else:
        on = (F.least("src_a", "tgt_a") == F.least("src_b", "tgt_b")) & (F.greatest("src_a", "tgt_a") == F.greatest("src_b", "tgt_b"))
    on = reduce(lambda x, k: x & (a[k] == b[k]), keys, on)
    flip = F.col("src_a") != F.col("src_b")
    return a.join(b, on).select(*[a[k] for k in keys], F.col("src_a").alias("src"), F.col("tgt_a").alias("tgt"), "fxy_a", "fyx_a", F.when(flip, F.col("fyx_b")).otherwise(F.col("fxy_b")).alias("fxy_b"), F.when(flip, F.col("fxy_b")).otherwise(F.col("fyx_b")).alias("fyx_b"), flip.alias("flip"))


def common_subjects(one: DataFrame, two: DataFrame, key: str = "subject") -> DataFrame:
    return one.select(key).intersect(two.select(key))


def nearest_time_align(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two series (keys, t, x) from the later start on, index by index from each one's sample nearest to it.

    Returns keys, i, t_a, t_b, x_a, x_b and offset, the largest distance of paired times.
    """
    w = Window.partitionBy(*keys)
    start = a.groupBy(*keys).agg(F.min("t").alias("ta")).join(b.groupBy(*keys).agg(F.min("t").alias("tb")), keys).select(*keys, F.greatest("ta", "tb").alias("t0"))

    def shifted(df: DataFrame, s: str) -> DataFrame:
        n = df.join(start, keys).withColumn("n", F.row_number().over(w.orderBy("t")))
        first = F.min(F.struct(F.abs(F.col("t") - F.col("t0")), "t", "n")).over(w)["n"]
        return n.withColumn("i", F.col("n") - first).where("i >= 0").select(*keys, "i", F.col("t").alias(f"t_{s}"), F.col("x").alias(f"x_{s}"))

    both = shifted(a, "a").join(shifted(b, "b"), [*keys, "i"])
    return both.withColumn("offset", F.max(F.abs(F.col("t_a") - F.col("t_b"))).over(w))


def interpolate(series: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Linear interpolation of (keys, t, x) at the times g of ``grid`` (keys, g): the bracketing samples are found by one
    ordered pass over both; null outside the series."""
    rows = series.select(*keys, "t", "x", F.lit(0).alias("ask")).unionByName(grid.select(*keys, F.col("g").alias("t"), F.lit(None).cast("double").alias("x"), F.lit(1).alias("ask")))
    w = Window.partitionBy(*keys).orderBy("t", "ask")
    known = F.when(F.col("ask") == 0, F.struct("t", "x"))
    lo = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    hi = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    found = rows.select(*keys, "t", "ask", lo.alias("lo"), hi.alias("hi")).where("ask = 1")
    share = F.try_divide(F.col("t") - F.col("lo.t"), F.col("hi.t") - F.col("lo.t"))
    x = F.when(F.col("lo.t") == F.col("t"), F.col("lo.x")).otherwise(F.col("lo.x") + share * (F.col("hi.x") - F.col("lo.x")))
    return found.select(*keys, F.col("t").alias("g"), x.alias("x"))


def completeness(expected: DataFrame, present: DataFrame, key: str = "subject", part: str = "contrast") -> DataFrame:
    """key, n_missing and status of the subjects that lack some expected part: 'missing all' or 'missing some'."""
    lost = expected.join(present.select(key, part).distinct(), [key, part], "left_anti").groupBy(key).agg(F.count("*").alias("n_missing"))
    every = expected.groupBy(key).agg(F.count("*").alias("n"))
    return lost.join(every, key).select(key, "n_missing", F.when(F.col("n_missing") == F.col("n"), "missing all").otherwise("missing some").alias("status"))


def resume(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti")


def match_trials(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Trials of two channels paired by rank of epoch, cut to the smaller number; ``matched`` tells if both had as many."""
    w = Window.partitionBy(*keys)

    def ranked(df: DataFrame, s: str) -> DataFrame:
        return df.select(*keys, F.row_number().over(w.orderBy("epoch")).alias("trial"), F.count("*").over(w).alias(f"n_{s}"), F.col("epoch").alias(f"epoch_{s}"))

    return ranked(a, "a").join(ranked(b, "b"), [*keys, "trial"]).withColumn("matched", F.col("n_a") == F.col("n_b"))


def paint_vertices(space: DataFrame, members: DataFrame, values: DataFrame) -> DataFrame:
    """A region's value for each vertex of ``space``; null in no region; where regions overlap the last by name wins."""
    top = members.join(values, "roi").groupBy("vertex").agg(F.max(F.struct("roi", "value")).alias("m")).select("vertex", F.col("m.value").alias("value"))
    return space.select("vertex").distinct().join(top, "vertex", "left")
