"""The given star-schema tables as signals and results, with the same views as SQL.

events_signals: trials are users, channels event types, samples days; orders_results: subjects are nations, regions
market segments, time the order month; lineitem_sweep: subjects are suppliers, configurations flag and status, time
the ship month; embedding_epochs: trials are vectors, samples their positions; nation_membership: parcels of regions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import grid

#: Values are brought to multiples of 2^-16, so that their sums are the same in any order.
BITS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, epoch, y, roi, t_idx, x: one row for each user, event type and day from the first day on, zero where
    nothing happened.

    Sums are made per user as a map of their own days, so the zero-filled grid needs no join. Event types and the span
    of days, both small, are read from the table first.
    """
    e = table(spark, sf_dir, "events")
    span = e.agg(F.min(F.to_date("ts")).alias("lo"), F.datediff(F.max("ts"), F.min("ts")).alias("days"), F.array_sort(F.collect_set("event_type")).alias("types")).first()
    day = (F.datediff("ts", F.lit(span["lo"])) + 1).alias("d")
    sums = e.groupBy("user_id", "event_type", day).agg(grid(F.sum("value"), BITS).alias("s"))
    cells = sums.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "event_type", F.col("d").cast("string")), "s"))).alias("m"))
    rows = cells.select("user_id", "m", F.explode(F.array(*[F.lit(t) for t in span["types"] or []])).alias("roi"))
    rows = rows.select("user_id", "m", "roi", F.explode(F.sequence(F.lit(1), F.lit((span["days"] or 0) + 1))).alias("t_idx"))
    x = F.coalesce(F.element_at("m", F.concat_ws(":", "roi", F.col("t_idx").cast("string"))), F.lit(0.0))
    return rows.select((F.col("user_id") % 10).alias("subject"), F.col("user_id").alias("epoch"), (F.col("user_id") % 2).cast("int").alias("y"), "roi", "t_idx", x.alias("x"))


EVENTS_SIGNALS = """sig AS (
  SELECT u.user_id % 10 AS subject, u.user_id AS epoch, (u.user_id % 2)::INTEGER AS y, r.roi, d.t_idx::INTEGER AS t_idx, coalesce(s.s, 0)::DOUBLE AS x
  FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type AS roi FROM events WHERE event_type IS NOT NULL) r CROSS JOIN (SELECT unnest(range(1, (SELECT date_diff('day', min(ts)::DATE, max(ts)::DATE) FROM events) + 2)) AS t_idx) d
  LEFT JOIN (SELECT user_id, event_type, date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) + 1 AS d, round_even(sum(value) * 65536.0::DOUBLE, 0) / 65536.0::DOUBLE AS s FROM events GROUP BY ALL) s ON s.user_id = u.user_id AND s.event_type = r.roi AND s.d = d.t_idx)"""


def embedding_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, epoch, y and the packed series x (array of double)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") % 10).alias("subject"), F.col("vec_id").alias("epoch"), (F.col("label") >= 5).cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("x"))


def embedding_signals(spark: SparkSession, sf_dir: str, samples: int = 16) -> DataFrame:
    """The same, unpacked to (chan, t_idx, x): position = chan * samples + t_idx."""
    rows = embedding_epochs(spark, sf_dir).select("subject", "epoch", "y", F.posexplode("x").alias("p", "x"))
    return rows.select("subject", "epoch", "y", F.floor(F.col("p") / samples).cast("int").alias("chan"), (F.col("p") % samples).alias("t_idx"), "x")


EMBEDDING_SIGNALS = """emb AS (
  SELECT vec_id % 10 AS subject, vec_id AS epoch, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, (p // 16)::INTEGER AS chan, (p % 16)::INTEGER AS t_idx, v::DOUBLE AS x
  FROM (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(len(embedding))) AS p FROM embeddings))"""


def orders_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject (nation), roi (market segment), ms (months since 1995), value (mean price in thousands)."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    month = ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")).alias("ms")
    return rows.groupBy(F.col("n_name").alias("subject"), F.col("c_mktsegment").alias("roi"), month).agg(grid(F.avg("o_totalprice") / 1000, BITS).alias("value"))


ORDERS_RESULTS = """res AS (
  SELECT n_name AS subject, c_mktsegment AS roi, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate))::INTEGER AS ms, round_even(avg(o_totalprice) / 1000 * 65536.0::DOUBLE, 0) / 65536.0::DOUBLE AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


def lineitem_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject (supplier), classifier (return flag), sw_dur (by line status), ms (ship month), accuracy, best_c."""
    rows = table(spark, sf_dir, "lineitem")
    out = rows.groupBy(F.col("l_suppkey").alias("subject"), F.col("l_returnflag").alias("classifier"), F.when(F.col("l_linestatus") == "O", 40).otherwise(80).alias("sw_dur"), F.month("l_shipdate").alias("ms"))
    return out.agg(grid(F.avg("l_discount") * 10, BITS).alias("accuracy"), F.pow(F.lit(10.0), -(F.min("l_linenumber") % 4).cast("double")).alias("best_c"))


LINEITEM_SWEEP = """swp AS (
  SELECT l_suppkey AS subject, l_returnflag AS classifier, CASE WHEN l_linestatus = 'O' THEN 40 ELSE 80 END AS sw_dur, month(l_shipdate)::INTEGER AS ms, round_even(avg(l_discount) * 10 * 65536.0::DOUBLE, 0) / 65536.0::DOUBLE AS accuracy, pow(10.0::DOUBLE, -(min(l_linenumber) % 4)::DOUBLE) AS best_c
  FROM lineitem GROUP BY ALL)"""


def nation_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """roi (region), parcel (nation), vertex (nation key)."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("roi"), F.col("n_name").alias("parcel"), F.col("n_nationkey").cast("int").alias("vertex"))


NATION_MEMBERSHIP = """mem AS (SELECT r_name AS roi, n_name AS parcel, n_nationkey::INTEGER AS vertex FROM nation JOIN region ON n_regionkey = r_regionkey)"""
