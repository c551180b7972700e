"""Every catalog query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from ablatrix import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(rows):
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted(repr([clean(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    want = con.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    got = catalog.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert plain(tuple(r) for r in got.select(*names).collect()) == plain(want.fetchall())


def test_reports_keep_their_preconditions(spark):
    """No report of a candidate that isn't stably green; sufficient sets only where the baseline stably fails."""
    rows = catalog.report_summary(spark, DATA).collect()
    rejected = {r.patch_id for r in catalog.rejected_patches(spark, DATA).collect()}
    assert rows and rejected and not rejected & {r.patch_id for r in rows}
    searched = [r for r in rows if r.contrast == "base-fail_candidate-pass"]
    assert len(searched) < len(rows) and any(r.sufficient_sets for r in searched)
    assert all((r.found_order, r.sufficient_sets, r.surplus) == (None, 0, 0) for r in rows if r not in searched)
