"""Contacts at the antipode of the station have no line of their own; the queries tell them as their SQL does."""

import pytest

import __spark_entry__ as entry
from skylog.plans import catalog
from tests.compare import connect, difference

#: The contact of 626545 is 13.5 km from the antipode of KN04ft, that of 334312 also from that of JN95wg; the others are not.
EVENTS = [626545, 334312, 626546, 334313, 3]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("antipodes"))
    rows = ", ".join(f"({i}L, timestamp_ntz '2024-01-{9 + n % 2 * 10:02d} 00:01:40', {500 + n}L, 'purchase')" for n, i in enumerate(EVENTS))
    spark.sql(f"SELECT *, 1.0D AS value, '' AS props FROM VALUES {rows} AS t(event_id, ts, user_id, event_type)").write.parquet(f"{sf}/events.parquet")
    return sf


def duck(sf):
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{sf}/events.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", ["insert_two_batches", "recalculate_table"])
def test_antipodes_are_told_as_in_the_sql(spark, folder, name):
    assert difference(entry.queries()[name](spark, folder), duck(folder), entry.oracle_sql()[name]) is None


def test_antipodes_have_no_line(spark, folder):
    lined = {r["dedup_key"] for r in catalog.QUERIES["qso_path"](spark, folder).select("dedup_key").collect()}
    rows = catalog.QUERIES["insert_two_batches"](spark, folder).where("lined").collect()
    assert lined and {r["dedup_key"] for r in rows} - lined == {r["dedup_key"] for r in rows if r["distance_km"] > 19_995.0} != set()
