"""The Spark-side builders of the numbered views give the same rows as the
view SQL (which the oracle uses)."""

from __future__ import annotations

import pytest

from rewardlake.sources.fixtures import BUILDERS, VIEWS, fixture, view_sql
from rewardlake.sources.tables import register_tables
from tests.conftest import SF_ORACLE


@pytest.mark.parametrize("name", sorted(BUILDERS))
def test_builder_equals_view_sql(spark, name):
    built = fixture(spark, SF_ORACLE, name)
    register_tables(spark, SF_ORACLE, VIEWS[name][0])
    sql = spark.sql(view_sql(name))
    assert [(f.name, f.dataType) for f in built.schema.fields] == [(f.name, f.dataType) for f in sql.schema.fields]
    assert built.exceptAll(sql).count() == 0
    assert sql.exceptAll(built).count() == 0
