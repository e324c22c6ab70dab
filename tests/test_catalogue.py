import pytest
from oracle import DATA, connect, same

from rasterlake.plans.catalogue import QUERIES
from rasterlake.plans.catalogue_sql import ORACLE_SQL


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, str(DATA))
    if name in ORACLE_SQL:
        same(df, con, ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_flagship_values(spark):
    r = QUERIES["subband_energy"](spark, "/root/testdata/sf0.001").first()
    assert (r.images, r.cells) == (1, 192)
    assert (r.LL, r.HL, r.LH, r.HH) == pytest.approx((604722.41815, 116782.3465, 107442.9994, 110843.18095))


def test_pushdown(spark):
    plan = QUERIES["extract_channel"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "event_id" in plan and "props" not in plan
