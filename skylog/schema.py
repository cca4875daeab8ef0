"""Table layouts. Times are TIMESTAMP_NTZ holding UTC, so no session time zone matters."""

from __future__ import annotations

# Columns of a contact row, in order.
QSO_COLUMNS = {
    "call": "string",
    "qso_datetime": "timestamp_ntz",
    "band": "string",
    "mode": "string",
    "submode": "string",
    "freq_mhz": "double",
    "rst_sent": "string",
    "rst_rcvd": "string",
    "gridsquare": "string",
    "my_gridsquare": "string",
    "dxcc": "int",
    "country": "string",
    "cont": "string",
    "cq_zone": "int",
    "itu_zone": "int",
    "distance_km": "double",
    "bearing_deg": "double",
    "loc_source": "string",
    "source": "string",
    "dedup_key": "string",
    "adif_extra": "string",
}
POINT_COLUMNS = {"lat": "double", "lon": "double", "my_lat": "double", "my_lon": "double"}
STORED_COLUMNS = {**QSO_COLUMNS, **POINT_COLUMNS}
PATH_COLUMNS = {
    "dedup_key": "string",
    "distance_km": "double",
    "bearing_deg": "double",
    "band": "string",
    "mode": "string",
    "parts": "array<array<struct<lat:double,lon:double>>>",
    "wkt": "string",
}
# A stored path that is the great circle of its contact keeps its ends only; its points and text are drawn when it is read.
ENDS = "line_ends"
KEPT_PATH_COLUMNS = {**PATH_COLUMNS, ENDS: "struct<lat1:double,lon1:double,lat2:double,lon2:double>"}
SCHEMA_VERSION = 2
# Mark in adif_extra: my_gridsquare came from the station, not from the log.
STATION_MARK = "APP_SKYLOG_STATION_GRID"


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())
