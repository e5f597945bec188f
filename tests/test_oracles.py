"""Every query that has SQL gives the rows of that SQL."""

from __future__ import annotations

import pytest

from pressweave.plans import registry

from .compare import of_duckdb, of_spark

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_rows_of_sql(spark, name):
    columns, rows = of_spark(registry.QUERIES[name](spark, SF))
    want_columns, want = of_duckdb(registry.ORACLES[name], SF)
    assert columns == want_columns
    assert sum(rows.values()) == sum(want.values())
    assert not list((rows - want).items())[:3] and not list((want - rows).items())[:3]


#: Rows of the queries without SQL over the smallest tables; what the rows say is tested beside their operators.
ROWS = {"story_cycles": 200, "clusters_greedy": 200, "distinct_by_text": 200, "prompt_assembly": 2, "twin_merge": 23, "feed_interleave": 270, "actions_fold": 15}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs_without_sql(spark, name):
    assert registry.QUERIES[name](spark, SF).count() == ROWS[name]
