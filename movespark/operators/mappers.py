"""Built-in mappers for ship positions: column names, navigational status and vessel types."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What raw files call the standard columns.
COLUMNS = {
    "Time": ["BaseDateTime", "dt_pos_utc", "DATE TIME (UTC)", "Date time stamp", "POSITION_UTC_DATE", "Time", "MovementDateTime", "# Timestamp"],
    "X": ["X", "Longitude", "Lon", "Longitude (DDD.ddd)", "LONGITUDE", "LON", "longitude"],
    "Y": ["Y", "Latitude", "Lat", "Latitude (DD.ddd)", "LATITUDE", "LAT", "latitude"],
    "Draft": ["Draught", "Draft", "Max draught", "DRAUGHT", "draught"],
    "Name": ["Name", "VesselName", "Vessel_Name", "vessel_name", "NAME"],
    "MMSI": ["MMSI", "VESSEL_ID", "mmsi"],
    "IMO": ["IMO", "IMO number", "LRIMOShipNo", "imo"],
    "AISCode": ["AISTYPE", "VesselType", "vessel_type_code", "Type of ship", "AISCode", "ShipType", "ship_type"],
    "Coursing": ["COG", "Course", "Coursing", "COG (deg)", "COURSE", "cog", "CourseOverGround"],
    "Heading": ["Heading", "Hdng", "True heading", "HEADING", "heading"],
    "Speed": ["Speed", "SOG", "SOG (knts)", "SPEED", "SPEED_KNOTS", "sog", "SpeedOverGround"],
    "Turning Rate": ["ROT (deg/min)", "rot", "turning_rate", "rate_of_turn", "RateOfTurn"],
    "Length": ["LOA", "Length", "length"],
    "Width": ["Beam", "Width", "width"],
    "A": ["A", "DimensionA", "toBow", "ToBow"],
    "B": ["B", "DimensionB", "toStern", "ToStern"],
    "C": ["C", "DimensionC", "toPort", "ToPort"],
    "D": ["D", "DimensionD", "toStar", "ToStar", "ToStarboard"],
    "Status": ["NavStat", "Status", "nav_status_code", "Navigational status", "NAVSTAT", "nav_status", "NavStatus"],
    "MessageType": ["Msg Type", "Message Type", "Msg type"],
}
# Texts of the navigational status. Each code is also known by its number, 15 by 16 as well.
STATUS = {
    0: ["under way using engine"],
    1: ["at anchor"],
    2: ["not under command"],
    3: ["restricted manoeuverability", "restricted maneuverability", "restricted manoeuvrability"],
    4: ["contrained by her draught", "constrained by her draught"],
    5: ["moored"],
    6: ["aground"],
    7: ["engaged in fishing"],
    8: ["underway sailing", "under way sailing"],
    9: ["reserved for future amendment of navigational status for hsc", "reserved for future use (9)",
        "reserved for future amendment of navigational status for ships carrying dg, hs or mp, or imo hazard or pollutant category c (hsc)"],
    10: ["reserved for future amendment of navigational status for wig", "reserved for future use (10)",
         "reserved for future amendment of navigational status for ships carrying dg, hs or mp, or imo hazard or pollutant category a (wig)"],
    11: ["power-driven vessel towing astern"],
    12: ["power-driven vessel pushing ahead/towing alongside"],
    13: ["reserved for future use", "reserved for future use (13)", "(reserved for future use)"],
    14: ["ais-sart is active", "ais-sart (active); mob-ais; epirb-ais", "ais-sart (active)", "mob-ais", "epirb-ais", "eprib-ais"],
    15: ["not defined (default)", "not defined", "unknown", "undefined"],
}
# Vessel types of single codes, with their group.
TYPES = {
    0: ("Not available or no ship, default", "Unknown"),
    30: ("Fishing", "Fishing"), 31: ("Towing", "Tug/Tow"), 32: ("Towing: length exceeds 200m or breadth exceeds 25m", "Tug/Tow"),
    33: ("Dredging or underwater operations", "Other"), 34: ("Diving operations", "Other"), 35: ("Military operations", "Military"),
    36: ("Sailing", "Recreational"), 37: ("Pleasure Craft", "Recreational"), 38: ("Reserved", "Other"), 39: ("Reserved", "Other"),
    50: ("Pilot Vessel", "Other"), 51: ("Search and Rescue vessel", "SAR"), 52: ("Tug", "Tug/Tow"), 53: ("Port Tender", "Other"),
    54: ("Anti-pollution equipment", "Other"), 55: ("Law Enforcement", "Other"), 56: ("Spare - for assignment to local vessel", "Other"),
    57: ("Spare - for assignment to local vessel", "Other"), 58: ("Medical Transport", "Other"), 59: ("Ship according to RR Resolution No. 18", "Other"),
    1001: ("Commercial Fishing Vessel", "Fishing"), 1002: ("Fish Processing Vessel", "Fishing"), 1003: ("Freight Barge", "Cargo"),
    1004: ("Freight Ship", "Cargo"), 1005: ("Industrial Vessel", "Other"), 1006: ("Miscellaneous Vessel", "Other"),
    1007: ("Mobile Offshore Drilling Unit", "Other"), 1008: ("Non-vessel", "Other"), 1009: ("NON-VESSEL", "Other"),
    1010: ("Offshore Supply Vessel", "Other"), 1011: ("Oil Recovery", "Other"), 1012: ("Passenger (Inspected)", "Passenger"),
    1013: ("Passenger (Uninspected)", "Passenger"), 1014: ("Passenger Barge (Inspected)", "Passenger"),
    1015: ("Passenger Barge (Uninspected)", "Passenger"), 1016: ("Public Freight", "Cargo"), 1017: ("Public Tankship/Barge", "Tanker"),
    1018: ("Public Vessel, Unclassified", "Other"), 1019: ("Recreational", "Recreational"), 1020: ("Research Vessel", "Other"),
    1021: ("SAR Aircraft", "SAR"), 1022: ("School Ship", "Other"), 1023: ("Tank Barge", "Tanker"), 1024: ("Tank Ship", "Tanker"),
    1025: ("Towing Vessel", "Tug/Tow"),
}
# Ten codes each, from the tens digit on, and what the last digit says.
TENS = {2: ("Wing in ground (WIG)", "Other"), 4: ("High speed craft (HSC)", "Other"), 6: ("Passenger", "Passenger"), 7: ("Cargo", "Cargo"), 8: ("Tanker", "Tanker"), 9: ("Other Type", "Other")}
LAST = ["all ships of this type", "hazardous category A", "hazardous category B", "hazardous category C", "hazardous category D", *["reserved for future use"] * 4, "no additional information"]


def vessel_type(code: int) -> tuple[str, str] | None:
    """A vessel code's standard type and its group, by rule; None for codes that don't exist."""
    if code in TYPES:
        return TYPES[code]
    tens, last = divmod(code, 10)
    if tens in TENS:
        # the last code of wing-in-ground craft is reserved
        return f"{TENS[tens][0]}, {LAST[8 if code == 29 else last]}", TENS[tens][1]
    if 1 <= code < 20 or 200 <= code < 256:
        return "Reserved for future use", "Other"
    if 100 <= code < 200:
        return "Reserved for regional use", "Other"
    return ("No designation", "Other") if 256 <= code < 1000 else None


def vessel_types(spark: SparkSession) -> DataFrame:
    """Rows (code, typestandard, type), one for each vessel code."""
    rows = [(k, *found) for k in range(1026) if (found := vessel_type(k))]
    return spark.createDataFrame(rows, "code int, typestandard string, type string")


def with_vessel_types(df: DataFrame, column: str = "AISCode") -> DataFrame:
    """Adds typestandard and type by a column of codes, numbers or their text; unknown codes get null."""
    table = F.broadcast(vessel_types(df.sparkSession)).withColumnRenamed("code", "__code")
    return df.join(table, F.col(column).cast("string").try_cast("double") == F.col("__code"), "left").drop("__code")


def status_code(raw: Column) -> Column:
    """The navigational status of a raw value: its number, as text too, or one of its texts in any case; else null."""
    text = F.lower(F.trim(raw.cast("string")))
    names = F.create_map(*[F.lit(v) for code, texts in STATUS.items() for t in texts for v in (t, code)])
    number = text.try_cast("double")
    by_number = F.when((number >= 0) & (number <= 15) & (number == F.floor(number)), number.cast("int")).when(number == 16, 15)
    return F.coalesce(F.try_element_at(names, text), by_number)


def update(old: Mapping[Any, Any], new: Mapping[Any, Any]) -> dict[Any, Any]:
    """The old mapper with the new one's entries; images that are None, empty or not a number are left out."""
    return dict(old) | {k: v for k, v in new.items() if v is not None and v != "" and v == v}


def save(mapper: Mapping[str, Any], path: str) -> None:
    with open(path, "w") as f:
        json.dump(dict(mapper), f, indent=2)


def load(path: str) -> dict[str, Any]:
    with open(path) as f:
        return json.load(f)
