"""Queries of filters, joins, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import align, select, sets
from ..sources import views as V
from .registry import query, rounded


@query("f1_good_trials", V.EVENTS_SIGNALS, "SELECT epoch, roi, t_idx, x FROM sig WHERE epoch % 7 <> 0")
def f1(spark, d):
    rows = V.events_signals(spark, d).withColumn("good", (F.col("epoch") % 7).cast("int"))
    return select.good_trials(rows).select("epoch", "roi", "t_idx", "x")


@query("f2_flatten_word_list", "SELECT subject, block, pos, word, (row_number() OVER (PARTITION BY subject ORDER BY block, pos) - 1)::INTEGER AS trial FROM (SELECT c_custkey % 10 AS subject, c_custkey AS block, unnest(ws) AS word, unnest(range(len(ws)))::INTEGER AS pos FROM (SELECT c_custkey, [upper(c_mktsegment), CASE WHEN c_custkey % 3 = 0 THEN 'MEEV' ELSE 'THOPE' END, 'FEEP'] AS ws FROM customer)) WHERE word <> 'MEEV'")
def f2(spark, d):
    c = V.table(spark, d, "customer")
    words = F.array(F.upper("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, "MEEV").otherwise("THOPE"), F.lit("FEEP"))
    return select.flatten_word_list(c.select((F.col("c_custkey") % 10).alias("subject"), F.col("c_custkey").alias("block"), words.alias("words")))


@query("f3_assign_class", "SELECT l_orderkey AS epoch, l_linenumber AS pos, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 1 END AS y FROM lineitem WHERE l_linenumber % 3 < 2")
def f3(spark, d):
    w = V.table(spark, d, "lineitem").withColumn("word", F.element_at(F.array(F.lit("THOPE"), F.lit("FUP"), F.lit("SARG")), F.col("l_linenumber") % 3 + 1))
    return select.assign_class(w.select(F.col("l_orderkey").alias("epoch"), F.col("l_linenumber").alias("pos"), "word"), select.word_classes(spark), "prodDiff").select("epoch", "pos", "y")


@query("f4_scale_units", V.EVENTS_SIGNALS, "SELECT epoch, roi, t_idx, CASE WHEN (SELECT max(abs(x)) FROM sig) > 1e-3 THEN x * 1e-6::DOUBLE ELSE x END AS x FROM sig")
def f4(spark, d):
    return select.scale_units(V.events_signals(spark, d)).select("epoch", "roi", "t_idx", "x")


@query("f5_infer_rate", "SELECT subject, round(1000 / avg(step), 9) AS measured, round(CASE WHEN abs(1000 / avg(step) - 2048) > 1 THEN 1000 / avg(step) ELSE 2048 END, 9) AS rate FROM (SELECT user_id % 10 AS subject, lead(event_id) OVER (PARTITION BY user_id % 10 ORDER BY event_id) * 0.0488::DOUBLE - event_id * 0.0488::DOUBLE AS step FROM events) GROUP BY subject")
def f5(spark, d):
    t = V.table(spark, d, "events").select((F.col("user_id") % 10).alias("subject"), (F.col("event_id") * 0.0488).alias("t_ms"))
    return rounded(select.infer_rate(t), places=9)


@query("f6_crop_time", V.EVENTS_SIGNALS, "SELECT epoch, roi, (dense_rank() OVER (PARTITION BY epoch, roi ORDER BY t_idx) - 1)::INTEGER AS t_idx, t_idx / 10.0::DOUBLE AS t_s, x FROM sig WHERE t_idx BETWEEN 5 AND 20")
def f6(spark, d):
    s = V.events_signals(spark, d).withColumn("t_s", F.col("t_idx") / 10.0)
    return select.crop_time(s, 0.5, 2.0).select("epoch", "roi", "t_idx", "t_s", "x")


@query("f7_select_rois", V.EVENTS_SIGNALS, "SELECT epoch, roi, t_idx, x FROM sig WHERE roi IN ('click', 'view')")
def f7(spark, d):
    return select.select_rois(V.events_signals(spark, d), ["CLICK", "View"]).select("epoch", "roi", "t_idx", "x")


@query("f8_config_filter", V.LINEITEM_SWEEP, "SELECT subject, classifier, sw_dur, ms, accuracy FROM swp WHERE (classifier = 'A' AND sw_dur = 80) OR (classifier = 'N' AND sw_dur = 40)")
def f8(spark, d):
    combos = spark.createDataFrame([("A:80",), ("N:40",)], "text string").select(scalar.parse_combo(F.col("text")).alias("c")).select("c.classifier", "c.sw_dur")
    return select.config_filter(V.lineitem_sweep(spark, d), combos=combos).select("subject", "classifier", "sw_dur", "ms", "accuracy")


@query("f9_window_mask", V.ORDERS_RESULTS, "SELECT subject, roi, ms, value FROM (SELECT *, min(ms) OVER w AS m, bool_or(ms BETWEEN 3 AND 4) OVER w AS a FROM res WINDOW w AS (PARTITION BY subject, roi)) WHERE CASE WHEN a THEN ms BETWEEN 3 AND 4 ELSE ms = m END")
def f9(spark, d):
    return select.baseline_or_first(V.orders_results(spark, d), ["subject", "roi"], 3, 4)


@query("f10_noise_baseline", "SELECT c_custkey AS subject, CASE WHEN NOT half THEN greatest(lo, t0) WHEN lo < t0 THEN t0 ELSE greatest(t0, t1 - w) END AS lo, CASE WHEN NOT half THEN least(hi, t1) WHEN lo < t0 THEN least(t1, t0 + w) ELSE t1 END AS hi, lo < t0 OR hi > t1 AS clipped FROM (SELECT *, hi - lo AS w, least(hi, t1) - greatest(lo, t0) < (hi - lo) / 2 AS half FROM (SELECT c_custkey, -0.5::DOUBLE AS lo, -0.25::DOUBLE AS hi, (c_custkey % 8) * -0.125::DOUBLE AS t0, 0.5::DOUBLE AS t1 FROM customer))")
def f10(spark, d):
    c = V.table(spark, d, "customer").select("c_custkey", ((F.col("c_custkey") % 8) * -0.125).alias("t0"))
    b = select.noise_baseline(F.lit(-0.5), F.lit(-0.25), F.col("t0"), F.lit(0.5))
    return c.select(F.col("c_custkey").alias("subject"), b.alias("b")).select("subject", "b.lo", "b.hi", "b.clipped")


@query("f11_explore_grid", V.LINEITEM_SWEEP, "SELECT classifier, sw_dur, tuned, count(*) AS n FROM (SELECT DISTINCT subject, classifier, sw_dur FROM swp) CROSS JOIN (SELECT unnest([true, false]) AS tuned) WHERE NOT (tuned AND classifier = 'lda') AND classifier IN ('A', 'N') AND sw_dur IN (40, 80) GROUP BY ALL")
def f11(spark, d):
    grid = select.explore_grid(spark, ["A", "N", "lda"], [40, 80])
    have = V.lineitem_sweep(spark, d).select("subject", "classifier", "sw_dur").distinct()
    return have.join(F.broadcast(grid), ["classifier", "sw_dur"]).groupBy("classifier", "sw_dur", "tuned").agg(F.count("*").alias("n"))


@query("f12_default_c", V.LINEITEM_SWEEP, "SELECT subject, classifier, sw_dur, ms, CASE WHEN best_c = 1 THEN CASE classifier WHEN 'A' THEN 0.01 WHEN 'N' THEN 0.1 ELSE 1 END ELSE best_c END::DOUBLE AS c FROM swp")
def f12(spark, d):
    name = F.when(F.col("classifier") == "A", "svm").when(F.col("classifier") == "N", "logistic").otherwise("lda")
    c = scalar.default_c(name, F.when(F.col("best_c") != 1, F.col("best_c")))
    return V.lineitem_sweep(spark, d).select("subject", "classifier", "sw_dur", "ms", c.alias("c"))


PAIRS = """prs AS (SELECT n.n_name AS pair_i, c.c_mktsegment AS pair_j, round(avg(c_acctbal), 4) AS fxy, round(max(c_acctbal), 4) AS fyx FROM customer c JOIN nation n ON c_nationkey = n_nationkey GROUP BY ALL)"""


def pairs(spark, d):
    c, n = V.table(spark, d, "customer"), V.table(spark, d, "nation")
    rows = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("pair_i"), F.col("c_mktsegment").alias("pair_j"))
    return rows.agg(F.round(F.avg("c_acctbal"), 4).alias("fxy"), F.round(F.max("c_acctbal"), 4).alias("fyx"))


@query("f13_pairs_to_edges", PAIRS, "SELECT pair_i AS src, pair_j AS tgt, fxy AS gc FROM prs UNION ALL SELECT pair_j, pair_i, fyx FROM prs")
def f13(spark, d):
    return select.pairs_to_edges(pairs(spark, d))


WANTED = "wan AS (SELECT r_name AS roi, n_name AS parcel FROM nation JOIN region ON (n_nationkey % 5 = r_regionkey OR n_regionkey = r_regionkey) UNION ALL SELECT 'AFRICA', 'NOWHERE')"


def wanted(spark, d):
    n, r = V.table(spark, d, "nation"), V.table(spark, d, "region")
    on = (F.col("n_nationkey") % 5 == F.col("r_regionkey")) | (F.col("n_regionkey") == F.col("r_regionkey"))
    return n.join(F.broadcast(r), on).select(F.col("r_name").alias("roi"), F.col("n_name").alias("parcel")).unionByName(spark.createDataFrame([("AFRICA", "NOWHERE")], "roi string, parcel string"))


def customers_as_vertices(spark, d):
    """parcel (nation), vertex (customer)"""
    c, n = V.table(spark, d, "customer"), V.table(spark, d, "nation")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("parcel"), F.col("c_custkey").alias("vertex"))


VERTICES = "vtx AS (SELECT n_name AS parcel, c_custkey AS vertex FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query("j1_merge_parcels", VERTICES, WANTED, "SELECT DISTINCT roi, vertex FROM vtx JOIN wan USING (parcel)")
def j1(spark, d):
    return align.merge_parcels(customers_as_vertices(spark, d), wanted(spark, d))


@query("j1_unknown_parcels", VERTICES, WANTED, "SELECT parcel, roi FROM wan WHERE parcel NOT IN (SELECT parcel FROM vtx)")
def j1b(spark, d):
    return align.unknown_parcels(customers_as_vertices(spark, d), wanted(spark, d))


@query("j2_minus_mask", VERTICES, "SELECT vertex, parcel FROM vtx WHERE vertex NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j2(spark, d):
    mask = V.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("vertex"))
    return align.minus_mask(customers_as_vertices(spark, d), mask)


@query("j3_in_source_space", VERTICES, "SELECT vertex, parcel FROM vtx WHERE vertex IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j3(spark, d):
    space = V.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("vertex"))
    return align.in_source_space(customers_as_vertices(spark, d), space)


@query("j4_all_pairs", "SELECT a.c_mktsegment AS pair_i, b.c_mktsegment AS pair_j FROM (SELECT DISTINCT c_mktsegment FROM customer) a, (SELECT DISTINCT c_mktsegment FROM customer) b WHERE a.c_mktsegment < b.c_mktsegment")
def j4(spark, d):
    return align.all_pairs(V.table(spark, d, "customer"), "c_mktsegment")


@query("j5_explicit_pairs", "SELECT DISTINCT a.n_name AS src, b.n_name AS tgt FROM nation a, nation b WHERE b.n_nationkey = (a.n_nationkey + 3) AND a.n_nationkey % 2 = 0")
def j5(spark, d):
    n = V.table(spark, d, "nation")
    texts = n.where("n_nationkey % 2 = 0").select(F.concat(F.lower("n_name"), F.lit(" -> Nation_"), (F.col("n_nationkey") + 3).cast("string")).alias("text"))
    return align.explicit_pairs(texts, n.select(F.col("n_name").alias("roi")))[0]


def _two_runs(spark, d):
    p = pairs(spark, d)
    one = p.select(F.col("pair_i").alias("src"), F.col("pair_j").alias("tgt"), "fxy", "fyx")
    flip = F.length("pair_i") % 2 == 0
    two = p.where("fxy > 0").select(F.when(flip, F.col("pair_j")).otherwise(F.col("pair_i")).alias("src"), F.when(flip, F.col("pair_i")).otherwise(F.col("pair_j")).alias("tgt"), (F.col("fxy") + 1).alias("fxy"), (F.col("fyx") + 2).alias("fyx"))
    return one, two


@query("j6_match_pairs", PAIRS, "SELECT pair_i AS src, pair_j AS tgt, fxy AS fxy_a, fyx AS fyx_a, CASE WHEN length(pair_i) % 2 = 0 THEN fyx + 2 ELSE fxy + 1 END AS fxy_b, CASE WHEN length(pair_i) % 2 = 0 THEN fxy + 1 ELSE fyx + 2 END AS fyx_b, length(pair_i) % 2 = 0 AS flip FROM prs WHERE fxy > 0")
def j6(spark, d):
    return align.match_pairs(*_two_runs(spark, d))


@query("j7_match_pairs_exact", PAIRS, "SELECT pair_i AS src, pair_j AS tgt, fxy AS fxy_a, fyx AS fyx_a, fxy + 1 AS fxy_b, fyx + 2 AS fyx_b, false AS flip FROM prs WHERE fxy > 0 AND length(pair_i) % 2 = 1")
def j7(spark, d):
    return align.match_pairs(*_two_runs(spark, d), exact=True)


@query("j8_common_subjects", "SELECT o_custkey AS subject FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def j8(spark, d):
    o = V.table(spark, d, "orders").withColumnRenamed("o_custkey", "subject")
    return align.common_subjects(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"))


TWO = "a AS (SELECT subject, roi, ms::DOUBLE AS t, value AS x FROM res WHERE ms % 2 = 0), b AS (SELECT subject, roi, ms + 0.25::DOUBLE AS t, value AS x FROM res WHERE ms > 10)"


def _two_series(spark, d):
    r = V.orders_results(spark, d)
    a = r.where("ms % 2 = 0").select("subject", "roi", F.col("ms").cast("double").alias("t"), F.col("value").alias("x"))
    return a, r.where("ms > 10").select("subject", "roi", (F.col("ms") + 0.25).alias("t"), F.col("value").alias("x"))


_SHIFT = "SELECT subject, roi, n - min_by(n, (abs(t - t0), t)) OVER (PARTITION BY subject, roi) AS i, t, x FROM (SELECT {0}.*, t0, row_number() OVER (PARTITION BY subject, roi ORDER BY t) AS n FROM {0} JOIN st USING (subject, roi))"


@query("j9_nearest_time_align", V.ORDERS_RESULTS, TWO, "st AS (SELECT subject, roi, greatest(ta, tb) AS t0 FROM (SELECT subject, roi, min(t) AS ta FROM a GROUP BY ALL) JOIN (SELECT subject, roi, min(t) AS tb FROM b GROUP BY ALL) USING (subject, roi))", f"sa AS ({_SHIFT.format('a')})", f"sb AS ({_SHIFT.format('b')})", "SELECT subject, roi, i::INTEGER AS i, sa.t AS t_a, sa.x AS x_a, sb.t AS t_b, sb.x AS x_b, max(abs(sa.t - sb.t)) OVER (PARTITION BY subject, roi) AS offset FROM sa JOIN sb USING (subject, roi, i) WHERE i >= 0")
def j9(spark, d):
    return align.nearest_time_align(*_two_series(spark, d), ["subject", "roi"])


@query("j10_interpolate", V.ORDERS_RESULTS, TWO, "lo AS (SELECT b.subject, b.roi, b.t AS g, max_by(a.t, a.t) AS t0, max_by(a.x, a.t) AS x0 FROM b LEFT JOIN a ON a.subject = b.subject AND a.roi = b.roi AND a.t <= b.t GROUP BY ALL)", "hi AS (SELECT b.subject, b.roi, b.t AS g, min_by(a.t, a.t) AS t1, min_by(a.x, a.t) AS x1 FROM b LEFT JOIN a ON a.subject = b.subject AND a.roi = b.roi AND a.t >= b.t GROUP BY ALL)", "SELECT subject, roi, g, round(CASE WHEN t0 = g THEN x0 ELSE x0 + (g - t0) / (t1 - t0) * (x1 - x0) END, 6) AS x FROM lo JOIN hi USING (subject, roi, g)")
def j10(spark, d):
    a, b = _two_series(spark, d)
    return rounded(align.interpolate(a, b.select("subject", "roi", F.col("t").alias("g")), ["subject", "roi"]), "x")


@query("j11_word_class_join", "SELECT o_orderkey AS epoch, o_orderpriority AS word, (o_orderpriority < '3')::INTEGER AS y FROM orders WHERE o_orderpriority NOT LIKE '5%'")
def j11(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("epoch"), F.col("o_orderpriority").alias("word"))
    classes = o.select("word").distinct().where("word NOT LIKE '5%'").select(F.lit("urgent").alias("contrast"), "word", (F.col("word") < "3").cast("int").alias("y"))
    return select.assign_class(o, classes, "urgent")


@query("j12_completeness", "SELECT subject, count(*) AS n_missing, CASE WHEN count(*) = 3 THEN 'missing all' ELSE 'missing some' END AS status FROM (SELECT c_custkey AS subject, c FROM customer CROSS JOIN (SELECT unnest(['F', 'O', 'P']) AS c)) e WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = subject AND o_orderstatus = c) GROUP BY subject")
def j12(spark, d):
    e = V.table(spark, d, "customer").select(F.col("c_custkey").alias("subject"), F.explode(F.array(*[F.lit(x) for x in "FOP"])).alias("contrast"))
    have = V.table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("contrast"))
    return align.completeness(e, have)


@query("j13_resume", "SELECT c_custkey AS subject FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j13(spark, d):
    tasks = V.table(spark, d, "customer").select(F.col("c_custkey").alias("subject"))
    return align.resume(tasks, V.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("subject")), ["subject"])


@query("j14_match_trials", "SELECT subject, trial::INTEGER AS trial, n_a, a.epoch AS epoch_a, n_b, b.epoch AS epoch_b, n_a = n_b AS matched FROM (SELECT user_id % 10 AS subject, event_id AS epoch, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS trial, count(*) OVER (PARTITION BY user_id % 10) AS n_a FROM events WHERE event_type = 'click') a JOIN (SELECT user_id % 10 AS subject, event_id AS epoch, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS trial, count(*) OVER (PARTITION BY user_id % 10) AS n_b FROM events WHERE event_type = 'view') b USING (subject, trial)")
def j14(spark, d):
    e = V.table(spark, d, "events").select((F.col("user_id") % 10).alias("subject"), F.col("event_id").alias("epoch"), "event_type")
    return align.match_trials(e.where("event_type = 'click'"), e.where("event_type = 'view'"), ["subject"])


@query("j15_paint_vertices", VERTICES, WANTED, "SELECT v.vertex, m.value FROM (SELECT DISTINCT vertex FROM vtx) v LEFT JOIN (SELECT vertex, max_by(length(roi) * 1.5::DOUBLE, roi) AS value FROM (SELECT DISTINCT roi, vertex FROM vtx JOIN wan USING (parcel)) WHERE roi <> 'ASIA' GROUP BY vertex) m USING (vertex)")
def j15(spark, d):
    p = customers_as_vertices(spark, d)
    members = align.merge_parcels(p, wanted(spark, d))
    values = V.table(spark, d, "region").where("r_name <> 'ASIA'").select(F.col("r_name").alias("roi"), (F.length("r_name") * 1.5).alias("value"))
    return align.paint_vertices(p, members, values)


@query("u1_union", V.ORDERS_RESULTS, "SELECT subject, roi, ms, value, NULL::VARCHAR AS tag FROM res WHERE ms < 20 UNION ALL SELECT subject, 'all', ms, value, 'b' FROM res WHERE ms >= 20")
def u1(spark, d):
    r = V.orders_results(spark, d)
    return sets.union_all(r.where("ms < 20"), r.where("ms >= 20").withColumn("roi", F.lit("all")).withColumn("tag", F.lit("b")))


@query("u2_upsert_last", V.LINEITEM_SWEEP, "SELECT subject, classifier, sw_dur, ms, CASE WHEN ms % 3 = 0 THEN accuracy + 1 ELSE accuracy END AS accuracy FROM swp")
def u2(spark, d):
    s = V.lineitem_sweep(spark, d).drop("best_c")
    return sets.upsert_last(s, s.where("ms % 3 = 0").withColumn("accuracy", F.col("accuracy") + 1), ["subject", "classifier", "sw_dur", "ms"])


@query("u4_intersection", "SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '2%'")
def u4(spark, d):
    o = V.table(spark, d, "orders")
    return sets.intersection(o.where("o_orderpriority LIKE '1%'"), o.where("o_orderpriority LIKE '2%'"), ["o_custkey"])


@query("u5_difference", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '2%'")
def u5(spark, d):
    o = V.table(spark, d, "orders")
    return sets.difference(o.where("o_orderpriority LIKE '1%'"), o.where("o_orderpriority LIKE '2%'"), ["o_custkey"])


@query("u6_distinct_configs", V.LINEITEM_SWEEP, "SELECT DISTINCT classifier, sw_dur FROM swp")
def u6(spark, d):
    return sets.distinct_configs(V.lineitem_sweep(spark, d))


@query("x1_ms_to_samples", "SELECT l_orderkey, l_linenumber, greatest(1, round_even(l_quantity / 1000 * 250, 0)::INTEGER) AS win FROM lineitem")
def x1(spark, d):
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalar.ms_to_samples("l_quantity", 250.0).alias("win"))


@query("x2_run_tag", "SELECT o_orderkey, concat_ws('_', 'order' || (o_orderkey % 30), 'win' || regexp_replace(regexp_replace(printf('%.6f', (o_orderkey % 100) / 4.0::DOUBLE), '0+$', ''), '\\.$', '') || 'ms', 'fs200', CASE WHEN o_orderstatus = 'F' THEN 'demean' END) AS tag FROM orders")
def x2(spark, d):
    o = V.table(spark, d, "orders")
    tag = scalar.run_tag(F.col("o_orderkey") % 30, (F.col("o_orderkey") % 100) / 4.0, F.lit(200), F.when(F.col("o_orderstatus") == "F", "demean").otherwise("none"))
    return o.select("o_orderkey", tag.alias("tag"))


@query("x3_set_tag", V.NATION_MEMBERSHIP, "SELECT roi, CASE WHEN length(t) <= 60 THEN t ELSE n || 'x' || substr(sha1(t), 1, 8) END AS tag FROM (SELECT roi, array_to_string(list_sort(list(lower(parcel))), '-') AS t, count(*) AS n FROM mem GROUP BY roi)")
def x3(spark, d):
    m = V.nation_membership(spark, d).groupBy("roi").agg(F.collect_list("parcel").alias("p"))
    return m.select("roi", scalar.set_tag(F.col("p")).alias("tag"))


@query("x4_display_name", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Bld' WHEN 'MACHINERY' THEN 'Mch' ELSE c_mktsegment END AS name FROM customer")
def x4(spark, d):
    return V.table(spark, d, "customer").select("c_custkey", scalar.display_name(F.col("c_mktsegment"), {"BUILDING": "Bld", "MACHINERY": "Mch"}).alias("name"))


@query("x5_sanitise", "SELECT item_id, replace(text, ' ', '_') AS name FROM benchmark")
def x5(spark, d):
    return V.table(spark, d, "benchmark").select("item_id", scalar.sanitise(F.col("text")).alias("name"))


@query("x6_subject_from_path", "SELECT c_custkey, split_part(c_name, '#', 1) AS subject FROM customer")
def x6(spark, d):
    return V.table(spark, d, "customer").select("c_custkey", scalar.subject_from_path(F.concat(F.lit("/a/b_c/"), F.replace("c_name", F.lit("#"), F.lit("_")))).alias("subject"))


@query("x7_parse_combo", V.LINEITEM_SWEEP, "SELECT DISTINCT classifier, sw_dur, ms % 2 = 0 AS tuned FROM swp")
def x7(spark, d):
    text = F.concat_ws(":", "classifier", F.col("sw_dur").cast("string"), F.when(F.col("ms") % 2 == 0, "tuned"))
    return V.lineitem_sweep(spark, d).select(scalar.parse_combo(text).alias("c")).select("c.*").distinct()


@query("x9_math", "SELECT l_orderkey, l_linenumber, round(ln(l_extendedprice) + exp(-l_discount) + sqrt(l_quantity) + sign(l_tax - 0.04) * greatest(l_tax, l_discount) - least(abs(l_tax - l_discount), 0.5), 6) AS v FROM lineitem")
def x9(spark, d):
    c = F.col
    v = F.log("l_extendedprice") + F.exp(-c("l_discount")) + F.sqrt("l_quantity") + F.signum(c("l_tax") - 0.04) * F.greatest("l_tax", "l_discount") - F.least(F.abs(c("l_tax") - c("l_discount")), F.lit(0.5))
    return rounded(V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v")), "v")


@query("x10_arrays", "SELECT vec_id, list_transform(embedding[1:4]::DOUBLE[], lambda x: x * 2) AS head, round(list_sum(embedding::DOUBLE[]) / len(embedding), 6) AS mean FROM embeddings")
def x10(spark, d):
    e = V.embedding_epochs(spark, d)
    return rounded(e.select(F.col("epoch").alias("vec_id"), F.transform(F.slice("x", 1, 4), lambda v: v * 2).alias("head"), (F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x")).alias("mean")), "mean")
