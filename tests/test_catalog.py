"""Every query of the audit against DuckDB."""

import os

import duckdb
import pytest

from plumbline.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_duckdb(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    want = sorted(map(repr, rel.select(*[f'"{c}"' for c in cols]).fetchall()))
    assert got == want


def test_summary_counts_the_findings_of_a_table(spark):
    severities = [r.severity for r in catalog.QUERIES["audit_findings"](spark, SF).collect()]
    got = catalog.QUERIES["audit_summary"](spark, SF).first()
    assert (got.n_critical, got.n_warning) == (severities.count("critical"), severities.count("warning"))


def test_both_kinds_and_whole_grids_run(spark):
    run = lambda name: catalog.QUERIES[name](spark, SF).collect()
    assert {r.kind for r in run("oof_calibrated_kinds")} == {"logreg", "hgb"}
    assert len(run("nested_kinds")) == len(run("nested_cv_full")) == 5
    assert len(run("grid_best")) == 1
