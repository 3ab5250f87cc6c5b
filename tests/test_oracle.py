"""Every registered query of the time-series operators against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from esig.catalog import ORACLE_SQL, QUERIES

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{TABLES}/{name}')")
    return con


def norm(v):
    return tuple(norm(x) for x in v) if isinstance(v, list | tuple) else repr(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, TABLES)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    want = duck.execute(ORACLE_SQL[name])
    at = {d[0]: i for i, d in enumerate(want.description)}
    assert sorted(at) == cols
    assert got == sorted(tuple(norm(r[at[c]]) for c in cols) for r in want.fetchall())


#: Compared with numpy in test_spatial_numpy.py, on the same tables.
NUMPY = {"r1_first_pc", "r2_top_pcs", "r3_mean_flip", "r4_epoch_summary", "r5_pca_flip", "r6_orthogonalise", "r7_regress_out", "r11_lcmv_weights", "r12_dspm_weights", "r13_rank_and_shared_fraction"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - NUMPY))
def test_runs(spark, name):
    assert QUERIES[name](spark, TABLES).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["roi", "run", "start", "end", "n", "peak_t", "least_p"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
