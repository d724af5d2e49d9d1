"""Every registered query of the graph against its SQL, over whole tables."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from callweave.plans.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


class Collected:
    """A result that has been collected already."""

    def __init__(self, df):
        self.columns, self.rows = df.columns, df.collect()

    def collect(self):
        return self.rows


@pytest.fixture(scope="module")
def results(spark):
    """All queries, four at a time: their jobs are small."""

    def run(name):
        try:
            return Collected(QUERIES[name](spark, SF))
        except Exception as e:  # noqa: BLE001 - reported by the query's own test
            return e

    with ThreadPoolExecutor(4) as pool:
        return dict(zip(QUERIES, pool.map(run, QUERIES)))


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(results, con, name):
    if isinstance(results[name], Exception):
        raise results[name]
    assert compare(results[name], con, ORACLES[name]) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())
