import pytest

from lodestone.plans import catalog
from tests.oracle import connect, differs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert differs(got, con.execute(catalog.ORACLES[name]).fetchdf()) == ""


def test_turn_diff_accounts_for_every_turn(spark):
    got = catalog.QUERIES["turn_diff"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/conversations.parquet").count()
