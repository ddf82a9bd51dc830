"""Every registered query runs; those with SQL give what DuckDB gives."""

import pytest

from orbweave.plans import catalog
from tests.duck import connect, differences

#: Queries of exceptions, which small tables may not hold.
EMPTY_IS_RIGHT = {"serializer_diff", "contract_violations", "dangling_refs", "missing_refs", "registry_violations", "unmapped", "unfinished_runs", "unmatched_dim", "reasoned_exclusion", "deref_index", "quarantine_rows", "write_once_conflicts"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert rows or name in EMPTY_IS_RIGHT
    if name not in catalog.ORACLES:
        return
    bad = differences(duck, catalog.ORACLES[name], df.columns, rows)
    assert not bad, bad[:3]
