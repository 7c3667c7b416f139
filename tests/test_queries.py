"""Each registered statement query against its SQL on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerloom.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def printed(rows):
    return sorted((tuple(None if v is None else repr(v) if isinstance(v, float) else str(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    expected = duck.sql(ORACLE_SQL[name])
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    assert printed(df.select(*columns).collect()) == printed([tuple(r[k] for k in at) for r in expected.fetchall()])


def test_entry_returns_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_documents_hold_all_lines_in_order(spark):
    from ledgerloom.plans.facts_queries import documents

    for row in documents(spark, DATA).limit(5).collect():
        assert [x.display_order for x in row.rows] == list(range(len(row.rows)))
        names = [x.canonical_name for x in row.rows]
        assert names.index("Signup") == 0 and row.rows[0].is_header and {"Total signup", "Total traffic", "error"} <= set(names)


def test_store_queries_see_every_event(spark, monkeypatch):
    from ledgerloom.plans import facts_queries as Q

    seen = {}
    for name in ("upsert", "reset_company"):
        monkeypatch.setattr(Q.O, name, lambda old, new, *a, f=getattr(Q.O, name), name=name: seen.update({name: (old, new)}) or f(old, new, *a))
    QUERIES["upsert_merged"](spark, DATA), QUERIES["reset_merged"](spark, DATA)
    events = sorted(r.event_id for r in spark.read.parquet(f"{DATA}/events.parquet").select("event_id").collect())
    for old, new in seen.values():
        had, came = ([r.seq for r in x.select("seq").collect()] for x in (old, new))
        assert had and came and sorted(had + came) == events
    places = QUERIES["ordered_rows"](spark, DATA)
    assert places.count() == QUERIES["consolidated_rows"](spark, DATA).count() and places.where("place > 5").limit(1).count()


def test_crawl_starts_from_all_customers(spark):
    got = QUERIES["full_crawl"](spark, DATA)
    assert got.where("depth = 0 and seed = url").count() == spark.read.parquet(f"{DATA}/customer.parquet").count()
