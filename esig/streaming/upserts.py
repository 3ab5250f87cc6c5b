"""A table of the last row per key, kept by a stream as a few sorted levels of runs.

A micro-batch writes its own rows as one run of level 0. When a level has ``FANOUT`` runs, they are merged into one of the
next level, in which each key has its last row. So a row is written once per level, and there are about log(batches) of
them, whatever the size of the table. Every change is one manifest, which also notes the last batch: one that is run again
after a failure is known and skipped, so a restart neither loses nor doubles rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import published

FANOUT = 4
#: Of a run: its level, and the last batch in it.
BY = ["_level", "_batch"]


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key that came last: from the latest batch, and of one batch the last in it."""
    rest = [c for c in rows.columns if c not in (*keys, "_seq")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest, "_seq"), "_seq").alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in (*rest, "_seq")])


def add_batch(batch: DataFrame, n: int, path: str, keys: list[str], fanout: int = FANOUT) -> None:
    """Publish the rows of batch ``n`` as a run and merge the levels that are full. Nothing if the batch is in already."""
    spark = batch.sparkSession
    if int(published.state(spark, path)[1]["facts"].get("batch", -1)) >= n:
        return
    seq = F.struct(F.lit(n).cast("long").alias("b"), F.monotonically_increasing_id().alias("i"))
    rows = _newest(batch.withColumn("_seq", seq), keys)
    published.write(rows.withColumns({"_level": F.lit(0), "_batch": F.lit(n)}), path, BY, replace=True, facts={"batch": n})
    level = 0
    while True:
        number, now = published.state(spark, path)
        full = [x for x in now["live"] if int(x[0]) == level]
        if len(full) < fanout:
            return
        merged = _newest(published.read(spark, path, BY, full).drop(*BY), keys)
        top = max(int(x[1]) for x in full)
        published.replace_runs(merged.withColumns({"_level": F.lit(level + 1), "_batch": F.lit(top)}), path, BY, full, number, now)
        level += 1


def streaming_upsert(stream: DataFrame, path: str, keys: list[str], checkpoint: str, fanout: int = FANOUT) -> StreamingQuery:
    """Keep the last row per key of ``stream`` at ``path``; ``last_rows`` reads it. One stream writes a table."""
    merge = lambda batch, n: add_batch(batch, n, path, keys, fanout)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The table: of every key the row of the newest run that has it."""
    return _newest(published.read(spark, path, BY).drop(*BY), keys).drop("_seq")
