import pytest

import __spark_entry__ as entry
from loomgraph.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLES[name])


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5 and all(r["use_case"] and r["reachable_node_count"] > 1 for r in rows)


def test_registry_is_complete():
    assert set(entry.oracle_sql()) <= set(entry.queries())
