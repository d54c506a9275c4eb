"""Worked examples of dirty keys, the time contract and dimension fallbacks."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions.keys import UNKNOWN, clean_text, numeric_key
from tidemark.functions.timeutil import with_local_time
from tidemark.operators.contracts import agreement, failing_columns
from tidemark.plans.serving import CONTRACT_COLUMNS, serve

ZONES = [
    (0, "1", "EWR", "Newark Airport", "EWR"),
    (1, "7", "Queens", "Astoria", "Boro Zone"),
    (2, "74", "Manhattan", "East Harlem North", "Boro Zone"),
    (3, "75", "Manhattan", "East Harlem South", "Boro Zone"),
    (4, "82", "Queens", "Elmhurst", "Boro Zone"),
    (5, "132", "Queens", "JFK Airport", "Airports"),
    (6, "133", "Brooklyn", "Kensington", "Boro Zone"),
    (7, "262", "Manhattan", "Yorkville East", "Yellow Zone"),
    (8, "263", "Manhattan", "Yorkville West", "Yellow Zone"),
    (9, "264", "Unknown", "N/A", "N/A"),
    (10, "265", "N/A", "Outside of NYC", ""),
    (11, "74", "later delivery", "x", "x"),
]
CODES = [
    (0, "1", "standard_rate", "metered"),
    (1, "2", "jfk", "flat"),
    (2, "3", "newark", "flat"),
    (3, "4", "nassau_westchester", "metered"),
    (4, "5", "negotiated", "negotiated"),
    (5, "6", "group_ride", "metered"),
    (6, "99", "unknown_reported", "unspecified"),
]
U = UNKNOWN
BORO, YELLOW = "Boro Zone", "Yellow Zone"
# (pickup text, pickup zone, drop-off zone, code) → nine contract columns
REQUESTS = [
    (("2024-03-08T08:15:00", " 74.0 ", "132", " 2.0 "),
     ("Manhattan", BORO, "Queens", "Airports", "jfk", "flat", "8", "4", "wall")),
    (("2024-03-08T13:15:00Z", " 75.0 ", " 133.0 ", " 4.0 "),
     ("Manhattan", BORO, "Brooklyn", BORO, "nassau_westchester", "metered", "8", "4", "instant")),
    (("2024-11-03T01:20:00", "82", " 262.0 ", "1"),
     ("Queens", BORO, "Manhattan", YELLOW, "standard_rate", "metered", U, U, "ambiguous")),
    (("2024-11-03T01:20:00-04:00", "263.0", "1.0", "3"),
     ("Manhattan", YELLOW, "EWR", "EWR", "newark", "flat", "1", "6", "instant")),
    (("2024-03-10T02:20:00", " 7.000 ", "82", "5.0"),
     ("Queens", BORO, "Queens", BORO, "negotiated", "negotiated", U, U, "nonexistent")),
    (("2024-11-03T06:20:00Z", "1", "not-reported", "3"),
     ("EWR", "EWR", U, U, "newark", "flat", "1", "6", "instant")),
    ((None, "264", "265", None),
     ("Unknown", U, "Outside of NYC", "Outside of NYC", "unknown_reported", "unspecified", U, U, "missing")),
    (("soon", "999", None, "7"), (U, U, U, U, U, U, U, U, "invalid")),
    (("2024-02-30T10:00:00", "74.5", "inf", "x"), (U, U, U, U, U, U, U, U, "invalid")),
]


def served(spark):
    trips = spark.createDataFrame(
        [(i, *r) for i, (r, _) in enumerate(REQUESTS)],
        "n int, lpep_pickup_datetime string, PULocationID string, DOLocationID string, RatecodeID string",
    )
    zones = spark.createDataFrame(
        ZONES, "row_no int, LocationID string, Borough string, Zone string, service_zone string"
    )
    codes = spark.createDataFrame(CODES, "row_no int, code string, rate_class string, fare_basis string")
    return serve(trips, zones, codes).select("n", *CONTRACT_COLUMNS)


def test_requests(spark):
    got = {r[0]: tuple(r[1:]) for r in served(spark).collect()}
    assert got == {i: want for i, (_, want) in enumerate(REQUESTS)}


def test_agreement_counts_a_broken_column(spark):
    good = served(spark)
    bad = good.withColumn("fare_basis", F.lit(UNKNOWN))
    assert failing_columns(agreement(good, good, ["n"], CONTRACT_COLUMNS)).first()[0] == 0
    report = agreement(bad, good, ["n"], CONTRACT_COLUMNS)
    assert [r.column for r in report.filter(~F.col("ok")).collect()] == ["fare_basis"]
    short = good.filter("n > 0")
    assert failing_columns(agreement(short, good, ["n"], CONTRACT_COLUMNS)).first()[0] == 9


@pytest.mark.parametrize(
    "text,want",
    [
        (" 74.0 ", 74), ("not-reported", None), ("1.0d", None), ("inf", None), ("NaN", None),
        ("7.000", 7), ("74.5", None), ("", None), (None, None), ("1e2", 100), ("-3", -3),
        ("900719925474099301", 900719925474099301), ("0x10", None), (".", None),
    ],
)
def test_numeric_key(spark, text, want):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(numeric_key(F.col("t"))).first()[0] == want


def test_clean_text(spark):
    rows = spark.createDataFrame([(" a ",), ("",), (" N/A ",), (None,)], "t string")
    assert [r[0] for r in rows.select(clean_text(F.col("t"))).collect()] == ["a", None, None, None]


def test_time_forms(spark):
    texts = [
        ("2024-07-01", "0", "0", "wall"),
        ("2024-07-01 23:59", "23", "0", "wall"),
        ("2024-07-01T00:30:00.25+05:30", "15", "6", "instant"),
        ("2024-07-01T00:30:00+99:00", U, U, "invalid"),
        ("2024-07-01T25:00:00", U, U, "invalid"),
        ("2024-03-10T03:00:00", "3", "6", "wall"),
        ("2024-11-03T00:59:59", "0", "6", "wall"),
        ("2024-11-03T02:00:00", "2", "6", "wall"),
        ("2024-03-08X08:15:00", "8", "4", "wall"),
        ("20240308T081500", "8", "4", "wall"),
        ("2024-03-08T08", "8", "4", "wall"),
        ("2024-03-08T08:15:00+04", "23", "3", "instant"),
        ("2024-03-08T08:15:00.1234567", "8", "4", "wall"),
        ("2024-03-08T08:15:00,5", "8", "4", "wall"),
        ("2024-W10-5T08:15", "8", "4", "wall"),
        ("2024W10", "0", "0", "wall"),
        ("2024-W53-1", U, U, "invalid"),
        ("2020-W53-5T01:00", "1", "4", "wall"),
        ("2024-03-08T05:00:10+00:00:20", "23", "3", "instant"),
        ("\t2024-03-08T08:15\n", "8", "4", "wall"),
        ("2024-03-08T0815:00", U, U, "invalid"),
    ]
    frame = spark.createDataFrame([(t[0],) for t in texts], "t string")
    got = with_local_time(frame, "t").select("t", "local.*").collect()
    assert [tuple(r) for r in got] == texts


def test_zone_with_short_clock_change(spark):
    frame = spark.createDataFrame([("2024-04-07T01:45:00",), ("2024-04-07T02:15:00",)], "t string")
    got = with_local_time(frame, "t", zone="Australia/Lord_Howe").select("local.quality").collect()
    assert [r[0] for r in got] == ["ambiguous", "wall"]
