import pytest
from oracle_check import compare, duck

import __spark_entry__ as contract
from registered.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    ours, theirs = compare(spark, con, name, SF_DIR)
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(QUERIES) - set(contract.oracle_sql()) == {"discovered_files"}


def test_discovered_files_are_the_tables(spark):
    import glob
    import os

    found = {row.path: row.length for row in contract.queries()["discovered_files"](spark, SF_DIR).collect()}
    assert found == {f"file:{path}": os.path.getsize(path) for path in glob.glob(f"{SF_DIR}/*.parquet")}


def test_entry_has_rows(spark):
    assert contract.entry(spark).columns == ["file_path", "extraction_method", "preview", "timestamp"]
    assert contract.entry(spark).count() > 0
