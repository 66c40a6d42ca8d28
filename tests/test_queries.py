"""Each registered query against its SQL twin, and those without one for rows."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from compare import duck, rows

from gapweave.plans import core_queries, extra_queries, transfer_queries  # noqa: F401


@pytest.mark.parametrize("name", sorted(core_queries.ORACLE))
def test_equals_sql(spark, sf, name):
    got = core_queries.QUERIES[name](spark, sf).toPandas()
    want = duck(core_queries.ORACLE[name], sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(transfer_queries.ROWS_ONLY))
def test_estimators_give_values(spark, sf, name):
    if name == "m8_pair_predict":
        sf = "/root/testdata/sf0.01"  # sf0.001 has no pair of six common dates
    got = transfer_queries.ROWS_ONLY[name](spark, sf).toPandas()
    assert len(got) and got.pred.between(-1, 2).all()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())
