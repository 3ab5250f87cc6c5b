"""Filters, predicates and small projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The words of each contrast and class.
WORD_CLASSES = {
    "prodDiff": (("THEEP", "THIPE", "THEEN", "THOPE", "THUP"), ("FEEP", "FIPE", "FEEN", "FOPE", "FUP")),
    "percDiff": (("SARG", "SOOG", "SAFF", "SILP", "SEEB"), ("TARG", "TOOG", "TAFF", "TILP", "TEEB")),
}
FILLER = "MEEV"
#: Names that an error message lists at most.
LISTED = 1000
#: Rows up to which a caller's table is hinted to broadcast.
SMALL = 100_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """``df`` with a hint to broadcast if it has at most ``most`` rows, counted no further than that; else as it is, and the join
    shuffles or not by Spark's own measure. For narrow tables alone."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def good_trials(df: DataFrame, info: str = "good") -> DataFrame:
    """Rows whose trial information is true or not zero."""
    return df.where(F.col(info).cast("double") != 0)


def flatten_word_list(blocks: DataFrame, filler: str | None = FILLER) -> DataFrame:
    """Blocks with a ``words`` array to one row per word, numbered through in block order; fillers go."""
    rows = blocks.select("subject", "block", F.posexplode("words").alias("pos", "word"))
    rows = rows.where(F.col("word") != filler) if filler else rows
    return rows.withColumn("trial", F.row_number().over(Window.partitionBy("subject").orderBy("block", "pos")) - 1)


def word_classes(spark, classes: dict = WORD_CLASSES) -> DataFrame:
    return spark.createDataFrame([(k, w, y) for k, sides in classes.items() for y, words in enumerate(sides) for w in words], "contrast string, word string, y int")


def assign_class(epochs: DataFrame, classes: DataFrame, contrast: str) -> DataFrame:
    """Label rows by their word; words in no class of the contrast are dropped, an unknown contrast is an error."""
    known = classes.where(F.col("contrast") == contrast).select("word", F.col("y").alias("y"))
    if known.isEmpty():
        raise ValueError(f"unknown contrast {contrast}")
    return epochs.drop("y").join(small(known), "word")


def scale_units(df: DataFrame, x: str = "x", above: float = 1e-3, factor: float = 1e-6) -> DataFrame:
    """All values times ``factor`` if the largest magnitude exceeds ``above``."""
    top = df.agg(F.max(F.abs(x)).alias("top"))
    return df.join(F.broadcast(top)).withColumn(x, F.when(F.col("top") > above, F.col(x) * factor).otherwise(F.col(x))).drop("top")


def infer_rate(times: DataFrame, key: str = "subject", stored: float = 2048.0) -> DataFrame:
    """Rate from the mean step of t_ms; the stored rate is kept if it lies within 1 Hz of it."""
    step = times.withColumn("step", F.lead("t_ms").over(Window.partitionBy(key).orderBy("t_ms")) - F.col("t_ms"))
    rate = step.groupBy(key).agg((1000 / F.avg("step")).alias("measured"))
    return rate.withColumn("rate", F.when(F.abs(F.col("measured") - stored) > 1, F.col("measured")).otherwise(stored))


def crop_time(df: DataFrame, lo: float, hi: float, t: str = "t_s", keys: tuple[str, ...] = ("epoch", "roi")) -> DataFrame:
    """Samples with lo <= t <= hi, their index counted anew from 0."""
    kept = df.where(F.col(t).between(lo, hi))
    return kept.withColumn("t_idx", (F.dense_rank().over(Window.partitionBy(*keys).orderBy(t)) - 1).cast("int"))


def select_rois(df: DataFrame, names: list[str], roi: str = "roi") -> DataFrame:
    """Rows of the named regions, whatever their case; a name that no row has is an error listing those there are."""
    kept = df.where(F.lower(roi).isin([n.lower() for n in names]))
    found = {r[0] for r in kept.select(F.lower(roi)).distinct().collect()}
    missing = sorted({n for n in names if n.lower() not in found})
    if missing:
        have = [r[0] for r in df.select(roi).distinct().orderBy(roi).limit(LISTED).collect()]
        raise ValueError(f"no region {', '.join(missing)}; there are {', '.join(map(str, have))}{' and more' if len(have) == LISTED else ''}")
    return kept


def config_filter(df: DataFrame, classifiers: list[str] | None = None, sw_durs: list[int] | None = None, tuned: str = "any", combos: DataFrame | None = None) -> DataFrame:
    """Rows of the wanted configurations; explicit ``combos`` (classifier, sw_dur[, tuned]) override the rest."""
    if combos is not None:
        return df.join(small(combos), [c for c in combos.columns if c in df.columns], "left_semi")
    keep = F.lit(True)
    if classifiers:
        keep &= F.col("classifier").isin(classifiers)
    if sw_durs:
        keep &= F.col("sw_dur").isin(sw_durs)
    if tuned != "any":
        keep &= F.col("tuned") == (tuned == "only")
    return df.where(keep)


def window_mask(ms: Column, lo: float, hi: float) -> Column:
    """Closed interval."""
    return ms.between(lo, hi)


def baseline_or_first(df: DataFrame, keys: list[str], lo: float, hi: float, ms: str = "ms") -> DataFrame:
    """Rows of the baseline window, or of the first time alone where the window holds none."""
    w = Window.partitionBy(*keys)
    inside = window_mask(F.col(ms), lo, hi)
    rows = df.select("*", F.max(inside).over(w).alias("_any"), F.min(ms).over(w).alias("_first"))
    return rows.where(F.when(F.col("_any"), inside).otherwise(F.col(ms) == F.col("_first"))).drop("_any", "_first")


def noise_baseline(lo: Column, hi: Column, t0: Column, t1: Column) -> Column:
    """struct(lo, hi, clipped): the window moved into the epoch; if less than half of it lies inside it restarts at the
    nearer edge with its full width, else it is cut."""
    width, cut_lo, cut_hi = hi - lo, F.greatest(lo, t0), F.least(hi, t1)
    half = (cut_hi - cut_lo) < width / 2
    at_start = lo < t0
    new_lo = F.when(half, F.when(at_start, t0).otherwise(F.greatest(t0, t1 - width))).otherwise(cut_lo)
    new_hi = F.when(half, F.when(at_start, F.least(t1, t0 + width)).otherwise(t1)).otherwise(cut_hi)
    return F.struct(new_lo.alias("lo"), new_hi.alias("hi"), ((lo < t0) | (hi > t1)).alias("clipped"))


def explore_grid(spark, classifiers: list[str], sw_durs: list[int], tuned: tuple[bool, ...] = (False, True)) -> DataFrame:
    """Every (classifier, sw_dur, tuned); lda is never tuned."""
    return spark.createDataFrame([(c, s, t) for c in classifiers for s in sw_durs for t in tuned if not (t and c == "lda")], "classifier string, sw_dur int, tuned boolean")


def pairs_to_edges(df: DataFrame, forward: str = "fxy", backward: str = "fyx", out: str = "gc") -> DataFrame:
    """Two directed rows of each pair row: (i, j) with the forward value, (j, i) with the backward one."""
    rest = [c for c in df.columns if c not in ("pair_i", "pair_j", forward, backward)]
    return df.selectExpr(*[f"`{c}`" for c in rest], f"stack(2, pair_i, pair_j, {forward}, pair_j, pair_i, {backward}) AS (src, tgt, {out})")
