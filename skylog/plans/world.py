"""A small country dimension of our own for demonstration queries (positions are rough)."""

from __future__ import annotations

from functools import cache

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.countries import Countries, countries

# name, cq, itu, continent, lat, lon, utc offset, primary prefix, other list only, code, DXCC name
ENTITIES = [
    ("Serbia", 15, 28, "EU", 44.0, 21.0, -1.0, "YU", False, 296, "Serbia"),
    ("Croatia", 15, 28, "EU", 45.2, 15.3, -1.0, "9A", False, 497, "Croatia"),
    ("Germany", 14, 28, "EU", 51.0, 10.0, -1.0, "DL", False, 230, "Germany"),
    ("United States", 5, 8, "NA", 37.5, -91.7, 5.0, "K", False, 291, "United States"),
    ("Canada", 5, 9, "NA", 44.4, -78.8, 5.0, "VE", False, 1, "Canada"),
    ("Hawaii", 31, 61, "OC", 21.1, -157.5, 10.0, "KH6", False, 110, "Hawaii"),
    ("Alaska", 1, 1, "NA", 61.4, -148.9, 8.0, "KL", False, 6, "Alaska"),
    ("Italy", 15, 28, "EU", 42.8, 12.6, -1.0, "I", False, 248, "Italy"),
    ("Sicily", 15, 28, "EU", 37.5, 14.0, -1.0, "IT9", True, 248, "Italy"),
    ("Australia", 30, 59, "OC", -23.7, 132.3, -10.0, "VK", False, 150, "Australia"),
    ("Austria", 15, 28, "EU", 47.3, 13.3, -1.0, "OE", False, 206, "Austria"),
    ("Scotland", 14, 27, "EU", 56.8, -4.2, 0.0, "GM", False, 279, "Scotland"),
    ("Montenegro", 15, 28, "EU", 42.5, 19.3, -1.0, "4O", False, 514, "Montenegro"),
    ("Bosnia-Herzegovina", 15, 28, "EU", 44.3, 17.6, -1.0, "E7", False, 501, "Bosnia-Herzegovina"),
    ("Asiatic Turkey", 20, 39, "AS", 39.2, 35.7, -3.0, "TA", False, 390, "Turkey"),
    ("European Turkey", 20, 39, "EU", 41.0, 29.0, -3.0, "TA1", True, 390, "Turkey"),
    ("Guantanamo Bay", 8, 11, "NA", 20.0, -75.0, 5.0, "KG4", False, 105, "Guantanamo Bay"),
]
# kind, key, primary prefix of the entity, zone overrides (cq, itu)
ENTRIES = [
    ("P", "YU", "YU", None, None),
    ("P", "YT", "YU", None, None),
    ("P", "9A", "9A", None, None),
    ("P", "DL", "DL", None, None),
    ("P", "K", "K", None, None),
    ("P", "W", "K", None, None),
    ("P", "W6", "K", 3, 6),
    ("P", "VE", "VE", None, None),
    ("P", "VE3", "VE", 4, 4),
    ("P", "KH6", "KH6", None, None),
    ("P", "KL7", "KL", None, None),
    ("P", "I", "I", None, None),
    ("P", "IT9", "IT9", None, None),
    ("P", "VK", "VK", None, None),
    ("P", "VK4", "VK", 30, 55),
    ("P", "VK6", "VK", 29, 58),
    ("P", "OE", "OE", None, None),
    ("P", "GM", "GM", None, None),
    ("P", "4O", "4O", None, None),
    ("P", "E7", "E7", None, None),
    ("P", "TA", "TA", None, None),
    ("P", "TA1", "TA1", None, None),
    ("P", "KG4", "KG4", None, None),
    ("E", "DL1DAX", "OE", None, None),
    ("E", "9A2CA/MM", "9A", None, None),
    ("E", "YT0BAP", "4O", None, None),
    ("E", "E71NA/QRP", "DL", None, None),
    ("E", "W6EA", "KH6", None, None),
]


def dimension_rows() -> list[tuple]:
    """One row per entry: kind, key, eid and the match columns."""
    by_prefix = {e[7]: e for e in ENTITIES}
    rows = []
    for i, (kind, key, prefix, cq, itu) in enumerate(ENTRIES):
        e = by_prefix[prefix]
        rows.append(
            (kind, key, i, prefix, e[0], e[9], e[10], e[3], cq or e[1], itu or e[2], e[4], e[5])
        )
    return rows


DIMENSION_COLUMNS = "kind key eid entity name dxcc dxcc_name continent cq_zone itu_zone lat lon".split()


@cache
def _built(spark: SparkSession) -> Countries:
    ids = {e[7]: i for i, e in enumerate(ENTITIES)}
    entities = spark.createDataFrame(
        [(i, *e) for i, e in enumerate(ENTITIES)],
        "entity_id int, name string, cq_zone int, itu_zone int, continent string, lat double, "
        "lon double, utc_offset double, primary_prefix string, wae_only boolean, dxcc int, "
        "dxcc_name string",
    )
    entries = spark.createDataFrame(
        [(k, key, ids[p], cq, itu, i) for i, (k, key, p, cq, itu) in enumerate(ENTRIES)],
        "kind string, key string, entity_id int, cq int, itu int, seq long",
    ).join(entities, "entity_id").select(
        "kind", "key", "entity_id", "seq",
        F.coalesce("cq", "cq_zone").alias("cq_zone"), F.coalesce("itu", "itu_zone").alias("itu_zone"),
        "continent", "lat", "lon", "utc_offset",
    )
    built = countries(entries, entities)
    # a fixed table of a few dozen rows: keep it as a literal relation instead of a job
    def literal(df):
        return spark.createDataFrame(df.toArrow(), df.schema)

    built.keys, built.payload = literal(built.keys), literal(built.payload)
    return built


def world(spark: SparkSession) -> Countries:
    return _built(spark)
