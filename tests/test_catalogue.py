"""Every registered query of the library against its SQL."""

from __future__ import annotations

import pytest
from oracle import same

from factlake.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, small, name):
    same(spark, small, catalogue.QUERIES[name], catalogue.ORACLES[name])


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_entry_renders_documents(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["app_id", "doc_type", "markdown"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
