import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from flowgauge.plans import catalog  # noqa: E402
from tools.compare import connect, differences  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_a_counterpart():
    assert set(catalog.QUERIES) == set(catalog.ORACLES) and set(catalog.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert differences(spark, duck, entry.queries()[name], entry.oracle_sql()[name], SF) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
