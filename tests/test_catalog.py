import pytest

from tests.oracle import actual, expected
from tidewatch.plans import catalog


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, data, name, size):
    names, want = expected(catalog.ORACLES[name], f"{data}/{size}")
    cols, got = actual(catalog.QUERIES[name](spark, f"{data}/{size}"))
    assert cols == names
    assert got == want


def test_flagship_has_rows(spark, data):
    assert catalog.flagship(spark, f"{data}/sf0.001").count() > 0


def test_generators_repeat(spark, data):
    a, b = (catalog.labelled_series(spark, "").orderBy("service_id", "step").collect() for _ in range(2))
    assert a == b and len(a) == 2500
    assert catalog.service_registry(spark, "").count() == 100
