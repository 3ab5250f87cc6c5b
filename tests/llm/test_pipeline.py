import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from esig.llm import mixing, near_dedup
from esig.llm.util import stage_table

TABLES = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    columns, out = docs.columns, {}
    for name, stage in pipeline.STAGES:
        out[name] = stage_table(stage(spark, docs, TABLES), f"test-{name}")
        if name != "bpe":
            assert out[name].columns == columns
            docs = out[name]
    text = lambda name: {r.doc_id: r.text for r in out[name].collect()}
    kept = text("quality")
    lined = brute.line_dedup(list(kept.items()))
    assert text("line_dedup") == {i: x[2] for i, x in lined.items()}
    assert out["line_dedup"].where(F.col("n_chars") != F.char_length("text")).count() == 0
    groups = brute.near_dups([(i, x[2]) for i, x in lined.items()])
    assert sorted(text("near_dedup")) == sorted(i for i, x in groups.items() if x[1] == i)
    assert out["bpe"].count() == out["mixing"].count()
    assert out["bpe"].where("NOT exact").count() == 0
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    clean = labels.where("quality = 1")
    lost = clean.join(out["quality"], "doc_id", "left_anti").count()
    assert lost <= 0.05 * clean.count()


def test_no_documents(spark, none):
    docs = none
    for name, stage in pipeline.STAGES:
        docs = stage_table(stage(spark, docs, TABLES), f"test-none-{name}")
        assert docs.count() == 0


def test_repeated_rows_leave_one(spark):
    one, two = ("alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight")
    rows = [(7, one)] * 30 + [(7, two)] * 3 + [(None, "red green blue white black brown grey pink")] * 5 + [(9, one), (None, one), (3, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in near_dedup.keep_one(docs).collect()]
    want = [(7, one), (7, two), rows[33], (3, ""), (4, None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_mix_of_equal_rows_takes_what_is_planned(spark):
    rows = [(1, "w x y z", "a")] * 400 + [(None, "w x y z", "b")] * 50 + [(i, "w x", "c") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    planned = {r.source: r.n for r in mixing.plan_mix(docs).groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    got = {r.source: r.n for r in mixing.mix(docs).groupBy("source").agg(F.count("*").alias("n")).collect()}
    targets = {r.source: r.target for r in mixing.plan_mix(docs).select("source", "target").distinct().collect()}
    assert got == planned
    assert all(got[s] == pytest.approx(targets[s] / (2 if s == "c" else 4), abs=1) for s in got)
