"""Queries against their SQL on tables that repeat the small ones with shifted keys, as larger tables do."""

import os

import duckdb
import pytest

from ledgerloom.plans.registry import ORACLE_SQL, QUERIES
from test_queries import DATA, printed

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Three pages for each address: one has the contents of its neighbour."""
    path = str(tmp_path_factory.mktemp("repeated"))
    duckdb.sql(f"copy (select a.page_id + r * 50 as page_id, a.url, b.html from range(3) t(r), '{DATA}/pages.parquet' a join '{DATA}/pages.parquet' b on b.page_id = (a.page_id + r // 2) % 50) to '{path}/pages.parquet'")
    return path


def equals_sql(spark, folder, name):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    expected, df = c.sql(ORACLE_SQL[name]), QUERIES[name](spark, folder)
    assert printed(df.select(*expected.columns).collect()) == printed(expected.fetchall())


def test_links_belong_to_their_page_not_to_its_address(spark, folder):
    equals_sql(spark, folder, "page_links")


def test_an_address_answers_with_all_its_pages(spark, folder):
    equals_sql(spark, folder, "site_crawl")
