"""Queries of sources, sinks and streams: they write the given tables, read them back and return what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import signals as S
from ..sources import views as V
from ..streaming import incremental as Z
from ..streaming import upserts
from .queries_decode import VTX, vertices
from .registry import query, rounded


def stored(spark, d):
    path = S.scratch(spark, "signals")
    rows = V.events_signals(spark, d)
    rows = rows.select("subject", F.lit("overt").alias("task"), F.lit("prodDiff").alias("contrast"), "epoch", "y", F.lit(0).alias("chan"), "t_idx", (F.col("t_idx") / 10.0).alias("t_s"), "x", "roi")
    S.write_signals(rows, path)
    return path


@query("s1_read_signals", V.EVENTS_SIGNALS, "SELECT subject, roi, epoch, t_idx, x FROM sig WHERE subject = 3")
def s1(spark, d):
    return S.published_signals(spark, stored(spark, d), subject=3, task="overt").select("subject", "roi", "epoch", "t_idx", "x")


@query("s2_read_signals_pruned", V.EVENTS_SIGNALS, "SELECT subject, roi, epoch, t_idx, x FROM sig WHERE roi IN ('click', 'error') AND subject <> 4")
def s2(spark, d):
    rows = S.published_signals(spark, stored(spark, d), rois=["click", "error"])
    rows = rows.where("NOT (subject = 4 AND roi = 'error')")
    return S.complete_for_rois(rows, ["click", "error"]).select("subject", "roi", "epoch", "t_idx", "x")


@query("s3_write_signals", V.EVENTS_SIGNALS, "SELECT roi, count(*) AS n, round(sum(CASE WHEN roi = 'view' THEN x + 1 ELSE x END), 6) AS s FROM sig GROUP BY roi")
def s3(spark, d):
    path = stored(spark, d)
    again = S.published_signals(spark, path)
    S.write_signals(again.withColumn("x", F.col("x") * 0), path)  # all keys are there: nothing is added
    changed = V.events_signals(spark, d).where("roi = 'view'")
    changed = changed.select("subject", F.lit("overt").alias("task"), F.lit("prodDiff").alias("contrast"), "epoch", "y", F.lit(0).alias("chan"), "t_idx", (F.col("t_idx") / 10.0).alias("t_s"), (F.col("x") + 1).alias("x"), "roi")
    S.write_signals(changed, path, overwrite=True)  # only the partition of this region is replaced
    return rounded(S.published_signals(spark, path).groupBy("roi").agg(F.count("*").alias("n"), F.sum("x").alias("s")), "s")


@query("s4_find_cached", "SELECT o_custkey AS subject, min(CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END)::INTEGER AS priority FROM orders GROUP BY ALL")
def s4(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), "o_orderstatus")
    return S.find_cached([o.where(F.col("o_orderstatus") == s).select("subject").distinct() for s in "PFO"], ["subject"])


@query("s5_results_csv", V.ORDERS_RESULTS, "SELECT subject, roi, ms, value FROM res")
def s5(spark, d):
    path = S.scratch(spark, "results")
    S.write_results(V.orders_results(spark, d), path)
    return S.read_results(spark, path, "roi string, ms int, value double, subject string").select("subject", "roi", "ms", "value")


@query("s6_gc_runs", V.EVENTS_SIGNALS, "SELECT subject, roi AS src, 'all' AS tgt, t_idx AS ms, round(sum(x), 6) AS gc FROM sig GROUP BY ALL")
def s6(spark, d):
    e = V.events_signals(spark, d).groupBy("subject", F.col("roi").alias("src"), F.lit("all").alias("tgt"), F.col("t_idx").alias("ms")).agg(F.sum("x").alias("gc"))
    path = S.scratch(spark, "runs")
    for _ in range(2):  # the second time replaces the first
        run = S.write_run(e, path, {"order": 10, "win_ms": 40.0})
    return rounded(S.read_gc_group(S.read_run(spark, path, run)).select("subject", "src", "tgt", "ms", "gc"), "gc")


@query("s7_reduced_cache", VTX, "pw AS (SELECT subject, roi, vertex, round(var_pop(x), 9) AS p FROM vx GROUP BY ALL)", "tp AS (SELECT subject, roi, arg_min(vertex, (-p, vertex)) AS v FROM pw GROUP BY ALL)", "SELECT subject, roi, epoch, t_idx, x FROM vx JOIN tp USING (subject, roi) WHERE vertex = v")
def s7(spark, d):
    path, v = S.scratch(spark, "reduced"), vertices(spark, d)
    S.write_reduced(v.where("subject < 5"), path, "maxpower")
    return S.write_reduced(v, path, "maxpower")


@query("s8_discover_runs", V.LINEITEM_SWEEP, "SELECT classifier, sw_dur, count(DISTINCT subject) AS n_subjects, count(*) AS n_rows FROM swp GROUP BY ALL")
def s8(spark, d):
    return S.discover_runs(V.lineitem_sweep(spark, d), ["classifier", "sw_dur"])


@query("s9_rename_column_dataset", V.ORDERS_RESULTS, "SELECT roi, ms, value AS decode_acc, subject FROM res")
def s9(spark, d):
    path, out = S.scratch(spark, "old"), S.scratch(spark, "new")
    rows = V.orders_results(spark, d)  # a tree of three layouts: old name, new name, another order
    rows.where("ms % 3 = 0").write.csv(f"{path}/a", header=True)
    rows.where("ms % 3 = 1").withColumnRenamed("value", "decode_acc").write.csv(f"{path}/b", header=True)
    rows.where("ms % 3 = 2").select("value", "roi", "ms", "subject").write.csv(f"{path}/c", header=True)
    S.rename_column_dataset(spark, path, out, "value", "decode_acc").collect()
    return spark.read.csv(out, header=True).select("subject", "roi", F.col("ms").cast("int").alias("ms"), F.col("decode_acc").cast("double").alias("decode_acc"))


@query("s10_reshape_sweep", V.LINEITEM_SWEEP, "SELECT subject, 'ROI_1' AS roi, ms, accuracy AS decode_acc, best_c FROM swp WHERE classifier = 'N' AND sw_dur = 40")
def s10(spark, d):
    return S.reshape_sweep_to_subject(V.lineitem_sweep(spark, d).withColumn("roi", F.lit("ROI 1")), "N", 40)


@query("u3_append_checkpoint", "SELECT o_custkey AS subject, count(*) AS n FROM orders GROUP BY ALL")
def u3(spark, d):
    """Two runs over the same tasks: the second takes up only what the first left."""
    path = S.scratch(spark, "checkpoint")
    per = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(F.count("*").alias("n"))
    S.append_checkpoint(per.where("subject % 3 = 0"), path, ["subject"])
    return S.append_checkpoint(per, path, ["subject"])


def _stream(spark, d):
    """The events table as a stream of its file."""
    e = spark.read.parquet(f"{d}/events.parquet")
    path = S.scratch(spark, "stream")
    e.repartition(4).write.parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("z1_streaming_upsert", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL")
def z1(spark, d):
    out = S.scratch(spark, "upsert")
    rows = _stream(spark, d).select("user_id", "event_type", "event_id")
    keys = ["user_id", "event_type", "event_id"]
    upserts.streaming_upsert(rows, out, keys, S.scratch(spark, "state"), fanout=2).awaitTermination()
    return upserts.last_rows(spark, out, keys).groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))


@query("z2_sliding_event_mean", "SELECT ts::DATE AS d, event_type, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY ALL")
def z2(spark, d):
    out = S.scratch(spark, "windows")
    stream = _stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    means = Z.sliding_event_mean(stream, "1 day", "1 day", "60 days", ["event_type"])

    def save(batch, n):
        batch.write.mode("overwrite").parquet(f"{out}/v={n}")

    means.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", S.scratch(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return rounded(Z.latest_version(spark, out).select(F.col("start").cast("date").alias("d"), "event_type", "mean", "n"), "mean")


@query("z3_running_lag_products", V.EVENTS_SIGNALS, "SELECT a.subject, a.roi AS ci, b.roi AS cj, b.t_idx - a.t_idx AS lag, round(sum(a.x * b.x), 6) AS c, count(*) AS n FROM sig a JOIN sig b ON a.epoch = b.epoch AND b.t_idx BETWEEN a.t_idx AND a.t_idx + 2 GROUP BY ALL")
def z3(spark, d):
    one = V.events_signals(spark, d).groupBy("subject", "epoch", "roi").agg(F.array_sort(F.collect_list(F.struct("t_idx", "x"))).alias("s")).select("subject", "epoch", "roi", F.col("s.x").alias("x"))
    packed = one.groupBy("subject", "epoch").agg(F.array_sort(F.collect_list(F.struct("roi", "x"))).alias("c")).select("subject", F.col("c.roi").alias("chans"), F.col("c.x").alias("xs"))
    path, out = S.scratch(spark, "packed"), S.scratch(spark, "lags")
    packed.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(packed.schema).option("maxFilesPerTrigger", 1).parquet(path)

    def save(batch, n):
        batch.write.mode("overwrite").parquet(f"{out}/v={n}")

    Z.running_lag_products(stream, 2).writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", S.scratch(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return rounded(Z.latest_version(spark, out), "c")
