"""Line dedup with levelled sorted runs of line hashes, in DataFrame functions only.

Documents come in batches of falling doc_id. Each batch reduces its lines to (key hash, documents, largest
doc_id), merge-anti-joins the runs so far, dropping keys that a run has already settled, and adds the rest as a
sorted run of level 0. Whenever a level holds ``fanout`` runs they are compacted into one of the next level; at the
end one run remains, which tells how many documents hold a key and the largest of them.

Because batches fall in doc_id, a key that reached the threshold in an earlier run already has its largest holder,
so leaving it out of later runs loses nothing.

Runs are tables bucketed and sorted by hash, one file for each bucket, so that merge joins and compactions read them in
order: only the new batch is exchanged and sorted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import BLANKS, hash128, lower_ascii, salted_join, scratch_dir, sieve, sift, stage_table

KEY = ["h1", "h2"]
BATCHES, FANOUT = 8, 3


@contextmanager
def bucket_order(spark: SparkSession) -> Iterator[None]:
    """Plans made inside take the order of bucketed files as given, at any number of buckets."""
    names = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row for each line whose key is long enough: doc_id, th (hash of the text), pos, h1, h2.

    th tells apart rows that share a doc_id.
    """
    text = F.coalesce("text", F.lit(""))
    lines = docs.select("doc_id", F.xxhash64(text).alias("th"), F.posexplode(F.split(lower_ascii(text), "\n")).alias("pos", "line"))
    key = F.btrim("line", F.lit(BLANKS))
    return lines.select("doc_id", "th", "pos", key.alias("key")).where(F.char_length("key") >= min_chars).select("doc_id", "th", "pos", *hash128(F.col("key")))


def _reduced(rows: DataFrame) -> DataFrame:
    """Runs or parts of runs merged: documents add up, the largest doc_id wins."""
    return rows.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("last_id").alias("last_id"))


class LineRuns:
    """The levelled runs; each is a table of its own in the shared scratch folder, bucketed and sorted by hash."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.tables: list[str] = []
        self.compactions = 0

    def add(self, lines: DataFrame) -> None:
        """Add one batch. Its documents must have no larger doc_id than those of the batches before."""
        per_doc = lines.groupBy(*KEY, "doc_id", "th").agg(F.lit(1).alias("n"))
        new = _reduced(per_doc.withColumn("last_id", F.col("doc_id")))
        if any(self.levels):  # reduced first: else the joins would move below, and a line that many documents hold with them
            new = stage_table(new, "line-batch")
        for run in (r for level in self.levels for r in level):
            new = new.join(run.where(F.col("n") >= self.min_docs).hint("merge"), KEY, "left_anti")
        self._push(0, new)

    def _push(self, level: int, rows: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(self._written(rows, level))
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self.compactions += 1
            self._push(level + 1, self._together(full))

    def _written(self, rows: DataFrame, level: int) -> DataFrame:
        name = f"line_run_{level}_{uuid.uuid4().hex}"
        with bucket_order(self.spark):
            rows.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{scratch_dir(self.spark)}/{name}").saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def _together(self, runs: list[DataFrame]) -> DataFrame:
        """Runs merged by full outer merge joins, bucket by bucket."""

        def pair(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.withColumnsRenamed({"n": "m", "last_id": "other"}).hint("merge")
            return a.join(b, KEY, "full").select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"), F.greatest("last_id", "other").alias("last_id"))

        return reduce(pair, runs)

    def merged(self) -> DataFrame:
        """All keys with their document counts and largest holders, as one run."""
        runs = [r for level in self.levels for r in level]
        return runs[0] if len(runs) == 1 else self._written(self._together(runs), len(self.levels))

    def forget(self) -> None:
        """Take the runs' names out of the catalog; their files stay."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = BATCHES, fanout: int = FANOUT, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop lines whose key at least ``min_docs`` documents hold, except in the largest doc_id that holds it.

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased; keys under
    ``min_chars`` code points are left alone. In the largest holder all its lines of that key stay. Returns
    doc_id, n_lines, n_dropped and kept_text, one row for each input row. Null and empty texts are one empty line.
    Rows that share a doc_id but not their text count as documents of their own; repeated equal rows count once
    and get equal results; null doc_ids rank below all others. Columns named in ``keep`` come along; no other is read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    batch = reduce(lambda c, x: c + (F.coalesce("doc_id", F.lit(-(1 << 63))) <= x).cast("int"), sorted(set(cuts or [])), F.lit(0))
    lines = stage_table(line_hashes(docs, min_chars).withColumn("batch", batch), "line-hashes", by="batch")
    runs = LineRuns(docs.sparkSession, min_docs, fanout)
    for k in range(len(set(cuts or [])) + 1):
        runs.add(lines.where(F.col("batch") == k))
    common = stage_table(runs.merged().where(F.col("n") >= min_docs).select(*KEY, "last_id"), "line-common")
    runs.forget()
    dropped = salted_join(lines, common, KEY, F.xxhash64("doc_id", "th")).where(~F.col("doc_id").eqNullSafe(F.col("last_id")))
    drops = stage_table(dropped.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.collect_set("pos").alias("gone")), "line-drops")
    text, along = F.coalesce("text", F.lit("")), [f"keep_{c}" for c in keep]
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("th"), *along)
    rows = sift(rows, F.xxhash64("doc_id", "th"), sieve(drops, F.xxhash64("d", "t")))  # texts that lose nothing don't move
    losing = rows.where("maybe").join(drops.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    rows = losing.select("doc_id", "text", "gone", *along).unionByName(rows.where("NOT maybe").withColumn("gone", F.lit(None).cast("array<int>")).select("doc_id", "text", "gone", *along))
    rows = rows.select("doc_id", "text", "gone", F.split("text", "\n").alias("lines"), *along)
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return rows.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"), *[F.col(f"keep_{c}").alias(c) for c in keep])


LINE_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
common AS (
  SELECT k, max(doc_id) AS last_id FROM lines WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.doc_id, l.pos, l.line, c.k IS NOT NULL AND l.doc_id <> c.last_id AS gone
  FROM lines l LEFT JOIN common c ON l.k = c.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
