"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import DATA, difference, oracle

from fieldproof.plans import catalog

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", list(catalog.entries()))
def test_query_matches_sql(spark, con, name):
    entry = catalog.entries()[name]
    df = entry.run(spark, SF)
    if entry.sql is None:
        assert df.count() > 0
    else:
        assert difference(df, con, entry.sql) is None


def test_inventory_is_covered():
    covered = {c.strip() for e in catalog.entries().values() for c in e.covers.split(",")}
    wanted = [("S", 8), ("P", 31), ("J", 17), ("A", 22), ("W", 6), ("O", 7), ("U", 3), ("I", 5)]
    missing = [f"{k}{i}" for k, n in wanted for i in range(1, n + 1) if f"{k}{i}" not in covered]
    assert missing == []
