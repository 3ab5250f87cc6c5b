from pyspark.sql import functions as F

from esig.operators import align, condition, select


def hinted(df):
    return "ResolvedHint (strategy=broadcast)" in df._jdf.queryExecution().analyzed().toString()


def test_only_small_tables_are_hinted(spark):
    ids = spark.range(11)
    assert hinted(select.small(ids, 11)) and not hinted(select.small(ids, 10))
    assert hinted(select.small(ids.where("id < 0"), 0))


def test_same_rows_with_and_without_the_hint(spark, monkeypatch):
    parcels = spark.range(40).select(F.concat(F.lit("p"), F.col("id") % 7).alias("parcel"), F.col("id").alias("vertex"))
    wanted = spark.createDataFrame([("x", "p1"), ("x", "p2"), ("y", "p2"), ("y", "p9")], "roi string, parcel string")
    texts = spark.createDataFrame([("X:y",), ("y -> x",), ("x:q",), (None,)], "text string")
    sensors = spark.createDataFrame([(0, 0, t, c, float(t + i)) for t in range(3) for i, c in enumerate("ABC")], "subject int, epoch int, t_idx int, chan string, x double")
    members = spark.createDataFrame([("g", "a"), ("g", "B"), ("h", "c")], "roi string, sensor string")
    configs = spark.createDataFrame([("svm", 20, 1.0), ("lda", 20, 2.0), (None, 40, 3.0)], "classifier string, sw_dur int, acc double")
    combos = spark.createDataFrame([("svm", 20), (None, 40)], "classifier string, sw_dur int")
    words = spark.createDataFrame([("FEEP", 1), ("THUP", 2), ("none", 3)], "word string, epoch int")

    def every():
        pairs, unresolved = align.explicit_pairs(texts, wanted)
        frames = [align.merge_parcels(parcels, wanted), pairs, unresolved, condition.pseudo_channels(sensors, members)]
        frames += [select.config_filter(configs, combos=combos), select.assign_class(words, select.word_classes(spark), "prodDiff")]
        return [sorted(map(repr, f.collect())) for f in frames], [hinted(f) for f in frames]

    small, real = every(), select.small
    for module in (align, condition, select):
        monkeypatch.setattr(module, "small", lambda df: real(df, 0))
    large = every()
    assert small[0] == large[0] and all(len(r) for r in small[0])
    assert all(small[1]) and not any(large[1])
