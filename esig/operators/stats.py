"""Statistical tests as aggregations and windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.scalar import normal_sf, t_critical, t_sf
from ..leaf import permutation
from .summary import mean_sem
from .windows import average_rank


def ttest(df: DataFrame, keys: list[str], value: str = "value", mu: Column | float = 0.0, tail: str = "greater") -> DataFrame:
    """keys, n, mean, sem, t, p of a one-sample test; null for fewer than two values or no spread."""
    mu = mu if isinstance(mu, Column) else F.lit(float(mu))
    out = df.groupBy(*keys).agg(*mean_sem(value), F.first(mu).alias("_mu"))
    t = F.when((F.col("n") > 1) & (F.col("sem") > 0), (F.col("mean") - F.col("_mu")) / F.col("sem"))
    out = out.withColumn("t", t)
    p = t_sf(F.col("t"), F.col("n") - 1) if tail == "greater" else 2 * t_sf(F.abs("t"), F.col("n") - 1)
    return out.withColumn("p", F.when(F.col("t").isNotNull(), p)).drop("_mu")


def signed_rank_tail(n: Column, w: Column) -> Column:
    """P(W >= w) of the signed-rank sum of n untied values under equal chances of either sign.

    Counts of subsets of 1..n by their sum grow by one rank at a time; the tail is taken from its symmetric end.
    """
    counts = F.aggregate(F.sequence(F.lit(1), n), F.array(F.lit(1.0)), lambda f, k: F.transform(F.sequence(F.lit(0), F.size(f) - 1 + k), lambda i: F.coalesce(F.get(f, i), F.lit(0.0)) + F.coalesce(F.get(f, i - k), F.lit(0.0))))
    top = (n * (n + 1) / 2 - w + 1).cast("int")
    return F.aggregate(F.slice(counts, F.lit(1), top), F.lit(0.0), lambda a, x: a + x) / F.pow(F.lit(2.0), n)


def wilcoxon_greater(df: DataFrame, keys: list[str], value: str = "value", mu: Column | float = 0.0, exact_to: int = 0) -> DataFrame:
    """keys, n, w, p of the signed-rank test by the normal approximation with tie correction; zeros are dropped.

    Groups of at most ``exact_to`` values without ties get the exact p.
    """
    d = df.select(*keys, (F.col(value) - mu).alias("d")).where("d <> 0").withColumn("a", F.abs("d"))
    ranked = d.select("*", average_rank("a", *keys).alias("r"), F.count("*").over(Window.partitionBy(*keys, "a")).alias("c"))
    out = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w"), F.sum(F.col("c") * F.col("c") - 1).alias("ties"))
    var = F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24 - F.col("ties") / 48
    z = F.try_divide(F.col("w") - F.col("n") * (F.col("n") + 1) / 4, F.sqrt(var))
    p = normal_sf(z)
    if exact_to:
        p = F.when((F.col("n") <= exact_to) & (F.col("ties") == 0), signed_rank_tail(F.col("n").cast("int"), F.col("w"))).otherwise(p)
    return out.select(*keys, "n", "w", p.alias("p"))


def bonferroni(df: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    return df.withColumn("p_bonf", F.least(F.col(p) * F.count(p).over(Window.partitionBy(*keys)), F.lit(1.0)))


def fdr_bh(df: DataFrame, keys: list[str], p: str = "p", tie: str = "ms") -> DataFrame:
    """Step-up adjusted p within keys; null p stays null and doesn't count."""
    w = Window.partitionBy(*keys)
    order = w.orderBy(F.col(p).asc_nulls_last(), tie)
    raw = F.col(p) * F.count(p).over(w) / F.row_number().over(order)
    rows = df.withColumn("_q", F.when(F.col(p).isNotNull(), raw))
    return rows.withColumn("p_fdr", F.when(F.col(p).isNotNull(), F.least(F.min("_q").over(order.rowsBetween(0, Window.unboundedFollowing)), F.lit(1.0)))).drop("_q")


def task_vs_baseline(df: DataFrame, keys: list[str], base: tuple[float, float], task: tuple[float, float], value: str = "value", t: str = "ms", alpha: float = 0.05, test: str = "t", exact_to: int = 0) -> DataFrame:
    """Every time of the task window against one scalar: the mean over baseline times of the mean over subjects.

    Times outside the task keep null tests; ``exact_to`` is that of the signed-rank test. Returns keys, t, mean, sem, n, baseline_mean, stat columns, p, sig.
    """
    per_time = df.groupBy(*keys, t).agg(*mean_sem(value))
    floor = per_time.where(F.col(t).between(*base)).groupBy(*keys).agg(F.avg("mean").alias("baseline_mean"))
    rows = per_time.join(floor, keys, "left")
    inside = F.col(t).between(*task)
    if test == "t":
        stat = F.when(inside & (F.col("n") > 1) & (F.col("sem") > 0), (F.col("mean") - F.col("baseline_mean")) / F.col("sem"))
        rows = rows.withColumn("t", stat).withColumn("p", F.when(F.col("t").isNotNull(), t_sf(F.col("t"), F.col("n") - 1)))
    else:
        near = df.join(floor, keys).where(inside).withColumn("_d", F.col(value) - F.col("baseline_mean"))
        rows = rows.join(wilcoxon_greater(near, [*keys, t], "_d", exact_to=exact_to).select(*keys, t, "p"), [*keys, t], "left")
    return rows.withColumn("sig", F.coalesce(F.col("p") < alpha, F.lit(False)))


#: Subjects up to which those of a time are one row.
FEW_SUBJECTS = 256
#: Signs that a task holds at once, and partial sums that it holds before it passes them on.
HELD_SIGNS, HELD_SUMS = 2_000_000, 4_000_000


def permuted_t(df: DataFrame, keys: list[str], permutations: int, value: str = "value", t: str = "ms", seed: int = 0, few: int = FEW_SUBJECTS) -> DataFrame:
    """keys, t, stats: the one-sample t of a time under each sign pattern, packed as bytes of doubles.

    Up to about ``few`` subjects, which are counted first, those of a time are one row; it is multiplied by the hashed sign
    patterns inside the task, so no row for a pattern is ever exchanged. More subjects are dealt over tasks
    (``_summed_t``). Null values count as missing.
    """
    subjects = df.agg(F.approx_count_distinct("subject")).first()[0]
    if subjects > few:
        return _summed_t(df, keys, permutations, value, t, seed, -(-subjects * permutations // HELD_SIGNS))
    packed = df.where(F.col(value).isNotNull()).groupBy(*keys, t).agg(F.sort_array(F.collect_list(F.struct(F.col("subject").cast("string").alias("s"), F.col(value).cast("double").alias("v")))).alias("p"))
    packed = packed.select(*keys, t, F.col("p.s").alias("_s"), F.col("p.v").alias("_v"))
    schema = StructType([*(packed.schema[c] for c in (*keys, t)), StructField("stats", BinaryType())])
    width = len(keys) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, np.ndarray] = {}
        for b in batches:
            stats = []
            for subjects, values in zip(b.column(width).to_pylist(), b.column(width + 1), strict=True):
                at = tuple(subjects)
                if at not in known:
                    known = {at: permutation.signs(subjects, permutations, seed)}  # neighbours mostly share their subjects
                stats.append(permutation.t_statistics(values.values.to_numpy(), known[at]).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(stats, pa.binary())], names=schema.names)

    return packed.mapInArrow(run, schema)


def _summed_t(df: DataFrame, keys: list[str], permutations: int, value: str, t: str, seed: int, tasks: int) -> DataFrame:
    """``permuted_t`` for any number of subjects: the values of a subject are one row, and a task makes the sign patterns of
    its own subjects once, a block at a time. Only the signed sums of each time are exchanged and added up. Subjects are dealt over ``tasks`` by
    number: their rows are small, but not their patterns."""
    rows = df.where(F.col(value).isNotNull())
    cell = F.struct(*[F.col(c) for c in (*keys, t)])
    names = [f"_k{n}" for n in range(len(keys) + 1)]
    dealt = rows.withColumn("_s", F.col("subject").cast("string")).repartition(tasks, "_s")
    packed = dealt.groupBy("_s").agg(F.collect_list(F.struct(cell.alias("c"), F.col(value).cast("double").alias("v"))).alias("_p"))
    packed = packed.select("_s", F.col("_p.c").alias("_c"), F.col("_p.v").alias("_v"))
    schema = StructType([*(StructField(n, rows.schema[c].dataType) for n, c in zip(names, (*keys, t), strict=True)), StructField("_n", LongType()), StructField("_ss", DoubleType()), StructField("_sums", BinaryType())])
    target = to_arrow_schema(schema)

    def tell(sums: dict) -> pa.RecordBatch:
        columns = [pa.array(list(c), f.type) for c, f in zip(zip(*sums, strict=True), target, strict=False)]
        n, ss, s = zip(*sums.values(), strict=True)
        return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(ss, pa.float64()), pa.array([x.tobytes() for x in s], pa.binary())], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        block = max(1, HELD_SIGNS // permutations)
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                b = whole.slice(at, block)
                flips = permutation.signs(b.column(0).to_pylist(), permutations, seed)
                owner = np.repeat(np.arange(b.num_rows), [len(v) for v in b.column(1)])
                cells = b.column(1).flatten()
                own = list(zip(*(cells.field(k).to_pylist() for k in range(len(names))), strict=True))
                x = b.column(2).flatten().to_numpy(zero_copy_only=False)
                groups: dict[tuple, list[int]] = {}
                for i, key in enumerate(own):
                    groups.setdefault(key, []).append(i)
                for key, i in groups.items():
                    v = x[i]
                    got = (len(i), float(v @ v), flips[:, owner[i]] @ v)
                    sums[key] = [p + q for p, q in zip(sums[key], got, strict=True)] if key in sums else list(got)
                if len(sums) * permutations > HELD_SUMS:
                    yield tell(sums)
                    sums = {}
        if sums:
            yield tell(sums)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = []
            for n, ss, parts in zip(b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist(), b.column(len(names) + 2), strict=True):
                s = np.zeros(permutations)
                for p in parts:
                    s += np.frombuffer(p.as_py())
                stats.append(permutation.t_of_sums(n, s, ss).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(stats, pa.binary())], schema=done)

    out = StructType([*(rows.schema[c] for c in (*keys, t)), StructField("stats", BinaryType())])
    final = StructType([*(StructField(n, f.dataType) for n, f in zip(names, out, strict=False)), StructField("stats", BinaryType())])
    done = to_arrow_schema(final)
    parts = packed.mapInArrow(run, schema).groupBy(*names).agg(F.sum("_n").alias("_n"), F.sum("_ss").alias("_ss"), F.collect_list("_sums").alias("_sums"))
    return parts.mapInArrow(total, final).toDF(*[f.name for f in out])


def _by_times(stats: DataFrame, keys: list[str], t: str, leaf, out: StructType, *more: str) -> DataFrame:
    """``leaf`` on the (times, patterns) matrix of each group, times in order, and what columns ``more`` hold for the group; a
    group's size is that of times and patterns."""

    def run(g: pa.Table) -> pa.Table:
        g = g.sort_by(t)
        rows = leaf(np.stack([np.frombuffer(b) for b in g["stats"].to_pylist()], axis=0), g[t].to_pylist(), *(g[c].to_pylist()[0] for c in more))
        head = [g[k].to_pylist()[0] for k in keys]
        types = g.schema
        cols = list(zip(*[(*head, *r) for r in rows], strict=True)) if rows else [[] for _ in out]
        kinds = [types.field(f.name).type if f.name in keys else types.field(t).type if f.name in (t, "start", "end") else pa.int32() if f.dataType == IntegerType() else pa.float64() for f in out]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=out.names)

    return stats.groupBy(*keys).applyInArrow(run, out)


def cluster_permutation(df: DataFrame, keys: list[str], threshold: float | None = None, permutations: int = 1024, value: str = "value", t: str = "ms", seed: int = 0) -> DataFrame:
    """keys, run, start, end, mass, p_cluster of the observed clusters of t over ``threshold``.

    p is the share of sign patterns, the observed one included, whose largest cluster mass reaches the cluster's. Without
    a threshold each group is cut at the upper 5 % point of Student's t for its own number of subjects.
    """
    stats = permuted_t(df, keys, permutations, value, t, seed)
    time = stats.schema[t].dataType
    out = StructType([*(stats.schema[k] for k in keys), StructField("run", IntegerType()), StructField("start", time), StructField("end", time), StructField("mass", DoubleType()), StructField("p_cluster", DoubleType())])

    def leaf(stat: np.ndarray, times: list, subjects: int | None = None) -> list[tuple]:
        found = permutation.cluster_test(stat, t_critical(subjects - 1) if threshold is None else threshold)
        return [(k + 1, times[a], times[b], mass, p) for k, (a, b, mass, p) in enumerate(found)]

    if threshold is not None:
        return _by_times(stats, keys, t, leaf, out)
    sizes = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.countDistinct("subject").cast("int").alias("subjects"))
    return _by_times(stats.join(sizes, keys), keys, t, leaf, out, "subjects")


def tfce(stats: DataFrame, keys: list[str], step: float = 0.2, t: str = "ms", stat: str = "stat") -> DataFrame:
    """keys, t, tfce: sum over heights h = step, 2 step, ... under the statistic of extent^0.5 * h^2 * step, where extent
    is the length of the run of times at or over h that holds the time."""
    out = StructType([*(stats.schema[k] for k in (*keys, t)), StructField("tfce", DoubleType())])

    def run(g: pa.Table) -> pa.Table:
        g = g.sort_by(t)
        x = np.nan_to_num(g[stat].to_numpy(zero_copy_only=False).astype(float), nan=0.0)
        return pa.table([*(g[k] for k in (*keys, t)), pa.array(permutation.tfce(x[:, None], step)[:, 0])], names=out.names)

    return stats.select(*keys, t, stat).groupBy(*keys).applyInArrow(run, out)


def tfce_permutation(df: DataFrame, keys: list[str], permutations: int = 256, step: float = 0.2, value: str = "value", t: str = "ms", seed: int = 0) -> DataFrame:
    """keys, t, tfce, p_tfce: the share of sign patterns whose largest score under the keys reaches the point's."""
    stats = permuted_t(df, keys, permutations, value, t, seed)
    out = StructType([*(stats.schema[k] for k in (*keys, t)), StructField("tfce", DoubleType()), StructField("p_tfce", DoubleType())])
    return _by_times(stats, keys, t, lambda stat, times: list(zip(times, *(x.tolist() for x in permutation.tfce_test(stat, step)), strict=True)), out)


def across_roi_bonferroni(df: DataFrame, p: str, roi: str = "roi") -> DataFrame:
    """p times the number of regions, at most 1."""
    n = df.agg(F.countDistinct(roi).alias("_n"))
    return df.join(F.broadcast(n)).withColumn(f"{p}_rois", F.least(F.col(p) * F.col("_n"), F.lit(1.0))).drop("_n")
