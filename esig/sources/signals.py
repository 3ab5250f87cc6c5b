"""Reading and writing signals, results and run tables."""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import spatial
from . import published

SIGNALS = "subject bigint, task string, contrast string, epoch bigint, y int, chan int, t_idx int, t_s double, x double, roi string"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the session names in ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that what is used twice is worked out once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_signals(spark: SparkSession, path: str, subject=None, task: str | None = None, contrast: str | None = None, rois: list[str] | None = None) -> DataFrame:
    """Signals of a partitioned table; every filter reaches the scan, regions as partitions."""
    return _filtered(spark.read.schema(SIGNALS).parquet(path), subject, task, contrast, rois)


def _filtered(df: DataFrame, subject, task: str | None, contrast: str | None, rois: list[str] | None) -> DataFrame:
    for name, v in (("subject", subject), ("task", task), ("contrast", contrast)):
        df = df.where(F.col(name) == v) if v is not None else df
    return df.where(F.col("roi").isin(rois)) if rois else df


def complete_for_rois(df: DataFrame, rois: list[str]) -> DataFrame:
    """Rows of the subjects that have all the regions; the others are skipped."""
    lost = df.select("subject").distinct().withColumn("roi", F.explode(F.array(*[F.lit(r) for r in rois]))).join(df.select("subject", "roi").distinct(), ["subject", "roi"], "left_anti")
    return df.where(F.col("roi").isin(rois)).join(lost.select("subject").distinct(), "subject", "left_anti")


def write_signals(df: DataFrame, path: str, overwrite: bool = False, keys: tuple[str, ...] = ("subject", "roi")) -> None:
    """Publish signals partitioned by region. Without ``overwrite`` keys that are there already are skipped; with it the
    partitions that come anew are replaced. Read them with ``published_signals``."""
    published.write(df, path, ["roi"], list(keys), replace=overwrite)


def published_signals(spark: SparkSession, path: str, subject=None, task: str | None = None, contrast: str | None = None, rois: list[str] | None = None) -> DataFrame:
    """``read_signals`` of a published table: the rows of its newest manifest."""
    return _filtered(published.read(spark, path, ["roi"]), subject, task, contrast, rois)


def write_reduced(signals: DataFrame, path: str, method: str = "pc", keys: tuple[str, ...] = ("subject", "roi")) -> DataFrame:
    """Keep the signals of each region reduced to one series, in a published cache partitioned by method and region;
    returns the cached rows of the method: subject, roi, epoch, t_idx, x.

    ``method`` is pc (first component), mean or maxpower. Subjects and regions that the cache holds under the method
    already are not reduced again.
    """
    spark, by = signals.sparkSession, ["method", "roi"]
    live = [x for x in published.state(spark, path)[1]["live"] if x[0] == method]
    if live:
        signals = signals.join(published.read(spark, path, by, live).select(*keys).distinct(), list(keys), "left_anti")
    one = spatial.first_pc(signals, keys) if method == "pc" else spatial.aggregate_variants(signals, keys).withColumn("x", F.col(method))
    published.write(one.select(*keys, "epoch", "t_idx", "x").withColumn("method", F.lit(method)), path, by, ["method", *keys])
    return published.read(spark, path, by).where(F.col("method") == method).select(*keys, "epoch", "t_idx", "x")


def find_cached(roots: list[DataFrame], keys: list[str]) -> DataFrame:
    """The first hit of each key over tables in order of preference, with its place as ``priority``."""
    rows = None
    for n, df in enumerate(roots):
        df = df.withColumn("priority", F.lit(n))
        rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
    first = F.min("priority").over(Window.partitionBy(*keys))
    return rows.withColumn("_f", first).where("priority = _f").drop("_f")


def write_results(df: DataFrame, path: str) -> None:
    """Decode results as CSV, a folder for each subject; spaces in names become underscores."""
    text = [F.replace(F.col(c), F.lit(" "), F.lit("_")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*text).repartition("subject").write.partitionBy("subject").mode("overwrite").csv(path, header=True)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def write_run(df: DataFrame, path: str, run: dict) -> str:
    """Publish a run's rows under the identity of its parameters (SHA-1 of their sorted text); returns it. Rows that the
    table has under this identity already are replaced."""
    run_id = hashlib.sha1(";".join(f"{k}={run[k]}" for k in sorted(run)).encode()).hexdigest()
    out = df.withColumns({k: F.lit(v) for k, v in run.items()}).withColumn("run_id", F.lit(run_id))
    published.write(out, path, ["run_id"], replace=True, facts={run_id: {k: str(v) for k, v in run.items()}})
    return run_id


def read_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return published.read(spark, path, ["run_id"]).where(F.col("run_id") == run_id)


def append_checkpoint(results: DataFrame, path: str, tasks: list[str]) -> DataFrame:
    """Add the results of the tasks that the checkpoint at ``path`` lacks, and return all it holds then. A task that is there
    isn't computed again, as its rows drop out before the work above them, and one that two runs finish counts once."""
    spark, by = results.sparkSession, ["part"]
    live = published.state(spark, path)[1]["live"]
    if live:
        results = results.join(published.read(spark, path, by, live).select(*tasks).distinct(), tasks, "left_anti")
    published.write(results.withColumn("part", F.lit("0")), path, by, tasks)
    return published.read(spark, path, by).drop("part")


def read_gc_group(df: DataFrame) -> DataFrame:
    """The group's rows if every subject has the same edges and windows; else reading them is an error."""
    shape = df.groupBy("subject").agg(F.sha1(F.array_join(F.array_sort(F.collect_set(F.concat_ws(">", "src", "tgt"))), ",")).alias("e"), F.countDistinct("ms").alias("w"))
    kinds = shape.agg(F.countDistinct("e", "w").alias("_k"))
    bad = F.when(F.col("_k") > 1, F.raise_error(F.lit("subjects differ in their edges or windows")).cast("boolean")).otherwise(F.lit(True))
    return df.join(F.broadcast(kinds)).where(bad).drop("_k")


def discover_runs(df: DataFrame, keys: list[str]) -> DataFrame:
    """The configurations that have data, with their numbers of subjects and rows."""
    return df.groupBy(*keys).agg(F.countDistinct("subject").alias("n_subjects"), F.count("*").alias("n_rows"))


def rename_column_dataset(spark: SparkSession, path: str, out: str, old: str, new: str, dry_run: bool = False) -> DataFrame:
    """Rewrite a CSV tree with a column renamed, each file by its own header; file, n_rows and status per file.

    Status is renamed, already (the file has the new name) or absent (it has neither; it isn't written). Files of either
    name and of any order of columns come out in one order, that of the smallest header. Idempotent. Lines are records.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"))
    heads = lines.groupBy("file").agg(F.min_by("value", "at").alias("head"), F.min("at").alias("first"), (F.count("*") - 1).alias("n_rows"))
    names = F.transform(F.split("head", ","), lambda c: F.trim(F.translate(c, '"', "")))
    status = F.when(F.array_contains(names, new), "already").when(F.array_contains(names, old), "renamed").otherwise("absent")
    heads = heads.withColumn("names", names).withColumn("status", status)
    kinds = sorted(tuple(r) for r in heads.where("status <> 'absent'").select("head", "names").distinct().collect())  # one row per layout
    if kinds and not dry_run:
        records = lines.join(heads.select("file", "head", "first"), "file").where("at <> first")
        parts = []
        for head, columns in kinds:
            columns = [new if c == old and new not in columns else c for c in columns]
            parsed = F.from_csv("value", F.lit(", ".join(f"`{c}` string" for c in columns)))
            parts.append(records.where(F.col("head") == head).select(parsed.alias("r")).select("r.*"))
        reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).write.mode("overwrite").csv(out, header=True)
    shown = F.when((F.col("status") == "renamed") & F.lit(dry_run), "would rename").otherwise(F.col("status"))
    return heads.select("file", "n_rows", shown.alias("status"))


def reshape_sweep_to_subject(df: DataFrame, classifier: str, sw_dur: int) -> DataFrame:
    """Sweep rows of one configuration in the per-subject result layout; further best_* columns come along."""
    best = [c for c in df.columns if c.startswith("best_")]
    out = df.where((F.col("classifier") == classifier) & (F.col("sw_dur") == sw_dur))
    return out.select("subject", F.replace("roi", F.lit(" "), F.lit("_")).alias("roi"), "ms", F.col("accuracy").alias("decode_acc"), *best).repartition("subject").sortWithinPartitions("subject", "roi", "ms")
