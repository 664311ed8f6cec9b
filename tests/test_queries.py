"""Every registered query of the library runs and, where there is SQL, gives the rows that the SQL gives."""

import pytest

from tallyloom.plans import catalogue
from tests.conftest import DATA, same_rows


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    found = catalogue.QUERIES[name](spark, str(DATA / "sf0.001"))
    if name not in catalogue.ORACLES:
        assert found.count() > 0
        return
    want = duck.execute(catalogue.ORACLES[name]).df()
    same_rows(found, want)


def test_most_results_hold_rows(duck):
    empty = [n for n, sql in catalogue.ORACLES.items() if not len(duck.execute(sql).df())]
    assert len(empty) <= 3, empty
