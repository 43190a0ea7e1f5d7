"""Every registered query against its DuckDB oracle at sf0.01 (the driver's
correctness gate), and the registry contract of __spark_entry__."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from scripts.check_oracle import duck, rows_key
from tests.conftest import SF_ORACLE

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_ORACLE)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert df.columns == ["total_instances", "resolved_instances", "unresolved_instances",
                          "error_instances", "empty_patch_instances", "resolve_rate"]


def test_oracles_name_registered_queries():
    assert set(ORACLES) <= set(QUERIES)
    # every query of the library itself has an SQL oracle
    assert {q for q in QUERIES if q.startswith("q_")} <= set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_ORACLE)
    cols, srows = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLES[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(cols) == sorted(dcols)
    assert len(srows) == len(drows)
    assert rows_key(cols, srows) == rows_key(dcols, drows)
