"""Tables by manifest: repeated, failing and competing writes; upserts by runs; CSV trees of mixed layouts."""

import os

import pytest
from pyspark.sql import functions as F

from esig.operators.summary import contrast_summary
from esig.sources import published as P
from esig.sources import signals as S
from esig.streaming import upserts


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/t"


def signals(spark, rows):
    return spark.createDataFrame(rows, "subject bigint, roi string, epoch bigint, t_idx int, x double")


def content(df):
    return sorted(tuple(r) for r in df.select("subject", "roi", "x").collect())


def test_a_run_written_twice_is_there_once(spark, path):
    df = spark.createDataFrame([(1, "a", "b", 5, 0.5), (2, "a", "b", 5, 0.7)], "subject int, src string, tgt string, ms int, gc double")
    one = S.write_run(df, path, {"order": 2})
    assert S.write_run(df.withColumn("gc", F.col("gc") + 1), path, {"order": 2}) == one
    other = S.write_run(df, path, {"order": 3})
    assert sorted(r.gc for r in S.read_run(spark, path, one).collect()) == [1.5, 1.7]
    assert S.read_run(spark, path, other).count() == 2 and P.state(spark, path)[1]["facts"][other] == {"order": "3"}


def test_signals_skip_or_replace(spark, path):
    S.write_signals(signals(spark, [(1, "a", 0, 0, 1.0), (1, "b", 0, 0, 2.0)]), path)
    S.write_signals(signals(spark, [(1, "a", 0, 0, 9.0), (2, "a", 0, 0, 3.0), (3, None, 0, 0, 4.0)]), path)
    assert content(S.published_signals(spark, path).na.fill("-")) == [(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0), (3, "-", 4.0)]
    S.write_signals(signals(spark, [(5, "a", 0, 0, 5.0)]), path, overwrite=True)
    assert content(S.published_signals(spark, path, rois=["a", "b"])) == [(1, "b", 2.0), (5, "a", 5.0)]
    assert P.sweep(spark, path, ["roi"], keep=1) == 2 and content(S.published_signals(spark, path, rois=["a", "b"])) == [(1, "b", 2.0), (5, "a", 5.0)]


def test_a_write_that_fails_halfway_changes_nothing(spark, path):
    S.write_signals(signals(spark, [(1, "a", 0, 0, 1.0)]), path)
    bad = signals(spark, [(k, "a", 0, 0, float(k)) for k in range(2, 50)]).withColumn("x", F.when(F.col("subject") == 49, F.raise_error(F.lit("no")).cast("double")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="no"):
        S.write_signals(bad, path)
    assert content(S.published_signals(spark, path)) == [(1, "a", 1.0)]


def test_of_two_writers_the_second_starts_again(spark, path, monkeypatch):
    """Another writer publishes between this one's reading and its publishing: nothing is lost or doubled."""
    S.write_signals(signals(spark, [(1, "a", 0, 0, 1.0)]), path)
    true, first = P.publish, [True]

    def late(*args):
        if first.pop() if first else False:
            S.write_signals(signals(spark, [(2, "a", 0, 0, 2.0)]), path)
        return true(*args)

    monkeypatch.setattr(P, "publish", late)
    S.write_signals(signals(spark, [(2, "a", 0, 0, 7.0), (3, "a", 0, 0, 3.0)]), path)
    assert content(S.published_signals(spark, path)) == [(1, "a", 1.0), (2, "a", 2.0), (3, "a", 3.0)]
    with pytest.raises(P.Lost):
        true(spark, path, 1, [], {})


def test_checkpoint_takes_up_what_is_left(spark, path):
    df = spark.createDataFrame([(k, k * 2) for k in range(6)], "task int, v int")
    assert S.append_checkpoint(df.where("task < 3"), path, ["task"]).count() == 3
    again = df.withColumn("v", F.when(F.col("task") < 3, F.raise_error(F.lit("computed again")).cast("int")).otherwise(F.col("v")))
    assert sorted(r.v for r in S.append_checkpoint(again, path, ["task"]).collect()) == [0, 2, 4, 6, 8, 10]


def size_of(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path[7:] + "/data") for f in names if f.endswith(".parquet")}


def test_upserts_write_in_proportion_to_the_batch(spark, path):
    """Sixteen batches; the last rows are right after each, replays change nothing, and rows are written once per level."""
    want, written = {}, 0
    for n in range(16):
        rows = [(k % 40, n * 100 + k) for k in range(n * 7, n * 7 + 30)] + [(n, -n), (n, -n - 1)]
        batch = spark.createDataFrame(rows, "k int, v int").coalesce(1)
        before = size_of(path)
        upserts.add_batch(batch, n, path, ["k"], fanout=4)
        written += sum(1 for f in size_of(path) if f not in before)
        want.update(rows)
        if n % 5 == 0:
            state = P.state(spark, path)
            upserts.add_batch(batch, n, path, ["k"], fanout=4)
            assert P.state(spark, path) == state
            assert {r.k: r.v for r in upserts.last_rows(spark, path, ["k"]).collect()} == want
    assert {r.k: r.v for r in upserts.last_rows(spark, path, ["k"]).collect()} == want
    assert [x[:2] for x in P.state(spark, path)[1]["live"]] == [["2", "15"]]


def test_rename_goes_by_each_file(spark, tmp_path):
    top = tmp_path / "tree"
    files = {"a/x.csv": "subject,old,ms\n1,0.5,10\n2,0.6,10\n", "b/y.csv": "subject,new,ms\n3,0.7,20\n", "b/z.csv": "ms,old,subject\n30,0.8,4\n", "c/w.csv": "subject,other\n5,6\n", "c/v.csv": 'ms,"old",subject\n'}
    for name, text in files.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(text)
    out = f"file://{tmp_path}/out"
    shown = lambda df: {r.file.rsplit("/", 1)[1]: (r.n_rows, r.status) for r in df.collect()}
    assert shown(S.rename_column_dataset(spark, f"file://{top}", out, "old", "new", dry_run=True))["x.csv"] == (2, "would rename")
    for _ in range(2):
        assert shown(S.rename_column_dataset(spark, f"file://{top}", out, "old", "new")) == {"x.csv": (2, "renamed"), "y.csv": (1, "already"), "z.csv": (1, "renamed"), "w.csv": (1, "absent"), "v.csv": (0, "renamed")}
    got = spark.read.csv(out, header=True)
    assert sorted((r.subject, r.new, r.ms) for r in got.collect()) == [("1", "0.5", "10"), ("2", "0.6", "10"), ("3", "0.7", "20"), ("4", "0.8", "30")]


def test_contrast_summary_without_spread(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", 2.0), ("c", 1.0), ("c", 1.0)], "roi string, diff double")
    got = {r.roi: (r.n, r.mean, r.n_positive, r.t, r.p) for r in contrast_summary(df, ["roi"]).collect()}
    assert got["a"][:4] == (2, 2.0, 2, 2.0) and got["a"][4] == pytest.approx(0.29516723) and got["b"][3:] == (None, None) and got["c"][3:] == (None, None)
