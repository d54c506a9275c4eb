"""Enrichment bindings: requests from ``orders`` and ``events``, dimensions from ``nation``."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.tables import spread_table, table
from tidemark.functions import keys
from tidemark.functions.timeutil import elapsed_minutes, with_local_time
from tidemark.operators import cohort, contracts, dims, encode
from tidemark.operators.requests import iso_seconds, serving_payload
from tidemark.plans import serving

ZONE_COLUMNS = ["row_no", "LocationID", "Borough", "Zone", "service_zone"]


def zones(spark, sf):
    """Nations as zones, some with blanks; every sixth is delivered again with other labels."""
    nations = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    n = F.col("n_nationkey")
    base = nations.select(
        n.alias("row_no"),
        F.concat(F.lit(" "), n.cast("string"), F.lit(".0 ")).alias("LocationID"),
        F.when(n % 5 == 1, "").when(n % 5 == 2, "N/A").when(n == 8, " ").otherwise(F.col("r_name")).alias("Borough"),
        F.when(n == 8, "N/A").otherwise(F.col("n_name")).alias("Zone"),
        F.when(n % 4 == 0, " ").otherwise(F.concat(F.lit("Service "), (n % 3).cast("string"))).alias("service_zone"),
    )
    again = base.filter(F.col("row_no") % 6 == 0).select(
        (F.col("row_no") + 100).alias("row_no"),
        "LocationID",
        F.lit("AGAIN").alias("Borough"),
        "Zone",
        F.lit("AGAIN").alias("service_zone"),
    )
    return base.unionByName(again)


ZONES_SQL = """
zone_base AS (
  SELECT n_nationkey AS row_no, n_nationkey AS zone_key,
         CASE WHEN n_nationkey % 5 = 1 THEN '' WHEN n_nationkey % 5 = 2 THEN 'N/A'
              WHEN n_nationkey = 8 THEN ' ' ELSE r_name END AS borough,
         CASE WHEN n_nationkey = 8 THEN 'N/A' ELSE n_name END AS zone,
         CASE WHEN n_nationkey % 4 = 0 THEN ' ' ELSE 'Service ' || (n_nationkey % 3) END AS service_zone
  FROM nation JOIN region ON n_regionkey = r_regionkey
),
zone_rows AS (
  SELECT * FROM zone_base
  UNION ALL SELECT row_no + 100, zone_key, 'AGAIN', zone, 'AGAIN' FROM zone_base WHERE row_no % 6 = 0
),
zone_clean AS (
  SELECT row_no, zone_key,
    coalesce(nullif(nullif(trim(borough), ''), 'N/A'), nullif(nullif(trim(zone), ''), 'N/A')) AS borough,
    coalesce(nullif(nullif(trim(service_zone), ''), 'N/A'), nullif(nullif(trim(zone), ''), 'N/A')) AS service_zone
  FROM zone_rows
),
zones AS (
  SELECT CAST(zone_key AS BIGINT) AS zone_key, borough, service_zone FROM (
    SELECT *, row_number() OVER (PARTITION BY zone_key ORDER BY row_no) AS n FROM zone_clean) WHERE n = 1
)
"""


def codes(spark, sf):
    """Order priorities as a codebook, with the row for an absent code."""
    priorities = table(spark, sf, "orders").select("o_orderpriority").distinct()
    listed = priorities.select(
        F.substring("o_orderpriority", 1, 1).alias("code"),
        F.lower(F.substring("o_orderpriority", 3, 20)).alias("rate_class"),
    )
    absent = listed.agg(
        F.max(F.lit("99")).alias("code"), F.max(F.lit("unknown_reported")).alias("rate_class")
    )
    rows = listed.unionByName(absent)
    return rows.select(
        F.col("code").cast("int").alias("row_no"),
        "code",
        "rate_class",
        F.concat(F.lit("basis "), "code").alias("fare_basis"),
    )


CODES_SQL = """
codes AS (
  SELECT DISTINCT CAST(o_orderpriority[1:1] AS BIGINT) AS code, lower(substr(o_orderpriority, 3, 20)) AS rate_class,
         'basis ' || o_orderpriority[1:1] AS fare_basis FROM orders
  UNION ALL SELECT 99, 'unknown_reported', 'basis 99'
)
"""

_DAYS = ["2024-03-08", "2024-03-10", "2024-11-03"]


def trips(spark, sf):
    """Orders as trips; keys beyond the last nation are unknown, some codes absent or bad."""
    o = F.col("o_orderkey")
    code = F.substring("o_orderpriority", 1, 1).cast("long")
    seconds = F.pmod(o * 7919, F.lit(86400)).cast("int")
    day = F.element_at(F.array(*[F.lit(d) for d in _DAYS]), F.pmod(o, F.lit(3)).cast("int") + 1)
    return spread_table(spark, sf, "orders").select(
        o.alias("trip_id"),
        (F.col("o_custkey") % 30).alias("PULocationID"),
        (F.col("o_custkey") % 27).alias("DOLocationID"),
        F.when(o % 11 == 0, F.lit(None)).when(o % 17 == 0, 7).otherwise(code).alias("RatecodeID"),
        (day.cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)).alias("lpep_pickup_datetime"),
    )


TRIPS_SQL = f"""
trips AS (
  SELECT o_orderkey AS trip_id, o_custkey % 30 AS pu, o_custkey % 27 AS dropoff,
         CASE WHEN o_orderkey % 11 = 0 THEN 99 WHEN o_orderkey % 17 = 0 THEN 7
              ELSE CAST(o_orderpriority[1:1] AS BIGINT) END AS code,
         CAST({_DAYS!r}[o_orderkey % 3 + 1] AS TIMESTAMP) + to_seconds((o_orderkey * 7919) % 86400) AS wall
  FROM orders
)
"""


def requests(spark, sf):
    messy = serving_payload(trips(spark, sf), "trip_id")
    bad = F.when(F.col("trip_id") % 13 == 0, "not-reported").otherwise(F.col("RatecodeID"))
    return messy.withColumn("RatecodeID", bad)


_WALL_QUALITY = """CASE
  WHEN wall >= TIMESTAMP '2024-03-10 02:00:00' AND wall < TIMESTAMP '2024-03-10 03:00:00' THEN 'nonexistent'
  WHEN wall >= TIMESTAMP '2024-11-03 01:00:00' AND wall < TIMESTAMP '2024-11-03 02:00:00' THEN 'ambiguous'
  ELSE 'wall' END"""
# Every third request is bare wall time; the others are instants, moved out of the gap first.
SERVED_SQL = f"""{ZONES_SQL}, {CODES_SQL}, {TRIPS_SQL},
timed AS (
  SELECT *, {_WALL_QUALITY} AS wall_quality,
         trip_id % 3 = 0 OR {_WALL_QUALITY} = 'ambiguous' AS bare FROM trips
),
served AS (
  SELECT trip_id,
    coalesce(p.borough, 'UNKNOWN') AS pu_borough, coalesce(p.service_zone, 'UNKNOWN') AS pu_service_zone,
    coalesce(d.borough, 'UNKNOWN') AS do_borough, coalesce(d.service_zone, 'UNKNOWN') AS do_service_zone,
    CASE WHEN trip_id % 13 = 0 THEN 'UNKNOWN' ELSE coalesce(c.rate_class, 'UNKNOWN') END AS rate_class,
    CASE WHEN trip_id % 13 = 0 THEN 'UNKNOWN' ELSE coalesce(c.fare_basis, 'UNKNOWN') END AS fare_basis,
    CASE WHEN bare THEN wall_quality ELSE 'instant' END AS time_quality,
    CASE WHEN bare AND wall_quality <> 'wall' THEN 'UNKNOWN'
         WHEN wall_quality = 'nonexistent' THEN '3' ELSE CAST(hour(wall) AS VARCHAR) END AS pickup_hour,
    CASE WHEN bare AND wall_quality <> 'wall' THEN 'UNKNOWN'
         ELSE CAST(isodow(wall) - 1 AS VARCHAR) END AS pickup_dayofweek
  FROM timed t LEFT JOIN zones p ON t.pu = p.zone_key LEFT JOIN zones d ON t.dropoff = d.zone_key
  LEFT JOIN codes c ON t.code = c.code
)
"""


def served(spark, sf):
    out = serving.serve(requests(spark, sf), zones(spark, sf), codes(spark, sf))
    return out.select("trip_id", *serving.CONTRACT_COLUMNS)


SERVED = f"WITH {SERVED_SQL} SELECT * FROM served"


def numeric_keys(spark, sf):
    messy = requests(spark, sf)
    return messy.select(
        "trip_id",
        keys.numeric_key(F.col("PULocationID")).alias("pu"),
        keys.numeric_key(F.col("DOLocationID")).alias("dropoff"),
        keys.numeric_key(F.col("RatecodeID")).alias("code"),
        keys.numeric_or_default(F.col("RatecodeID"), -1).alias("code_or_default"),
    )


NUMERIC_KEYS = f"""WITH {TRIPS_SQL}
SELECT trip_id, pu, dropoff,
  CASE WHEN trip_id % 13 = 0 OR trip_id % 11 = 0 THEN NULL ELSE code END AS code,
  CAST(CASE WHEN trip_id % 13 = 0 OR trip_id % 11 = 0 THEN -1 ELSE code END AS DOUBLE) AS code_or_default
FROM trips"""


def fractional_keys(spark, sf):
    """Quantities and discounts as text: only whole numbers are keys."""
    text = F.concat_ws("", F.lit(" "), F.col("l_discount").cast("string"), F.lit(" "))
    lines = table(spark, sf, "lineitem").withColumn("key", keys.numeric_key(text))
    return lines.groupBy("l_discount", "key").agg(F.count(F.lit(1)).alias("n"))


FRACTIONAL_KEYS = """SELECT l_discount,
CASE WHEN l_discount = floor(l_discount) THEN CAST(l_discount AS BIGINT) END AS key, count(*) AS n
FROM lineitem GROUP BY ALL"""


def clean_labels(spark, sf):
    rows = zones(spark, sf)
    return rows.select("row_no", *[keys.clean_text(F.col(c)).alias(c) for c in ("Borough", "Zone", "service_zone")])


CLEAN_LABELS = f"""WITH {ZONES_SQL}
SELECT row_no, nullif(nullif(trim(borough), ''), 'N/A') AS "Borough",
  nullif(nullif(trim(zone), ''), 'N/A') AS "Zone", nullif(nullif(trim(service_zone), ''), 'N/A') AS service_zone
FROM zone_rows"""


def zone_table(spark, sf):
    return dims.zone_attributes(zones(spark, sf))


ZONE_TABLE = f"WITH {ZONES_SQL} SELECT * FROM zones"


def time_texts(spark, sf):
    """Event times of day on three dates: bare, basic, by week, with offset, as UTC, broken or absent."""
    e = F.col("event_id")
    day = F.element_at(F.array(*[F.lit(d) for d in _DAYS]), F.pmod(e, F.lit(3)).cast("int") + 1)
    clock = F.date_format("ts", "HH:mm:ss")
    form = F.pmod(F.floor(e / 3), F.lit(10))
    date = day.cast("date")
    week = F.format_string("%04d-W%02d-%d", F.extract(F.lit("YEAROFWEEK"), date), F.weekofyear(date), F.weekday(date) + 1)
    text = (
        F.when(form == 0, F.concat(day, F.lit("T"), clock))
        .when(form == 1, F.concat(F.lit(" "), day, F.lit(" "), clock, F.lit(" ")))
        .when(form == 2, F.concat(day, F.lit("T"), clock, F.lit("Z")))
        .when(form == 3, F.concat(day, F.lit("T"), clock, F.lit("-04:00")))
        .when(form == 4, F.concat(day, F.lit("X"), clock))
        .when(form == 5, F.concat(day, F.lit("T"), F.date_format("ts", "HH:mm")))
        .when(form == 7, F.concat(day, F.lit("T"), clock, F.lit("+99:00")))
        .when(form == 8, F.concat(F.replace(day, F.lit("-")), F.lit("T"), F.date_format("ts", "HHmmss"), F.lit("-04")))
        .when(form == 9, F.concat(week, F.lit("T"), clock, F.lit(",1234567")))
    )
    return spread_table(spark, sf, "events").select("event_id", text.alias("text"))


def local_times(spark, sf):
    rows = with_local_time(time_texts(spark, sf), "text", "t")
    return rows.select("event_id", "t.hour", "t.weekday", "t.quality")


LOCAL_TIMES = f"""
WITH walls AS (
  SELECT event_id, (event_id // 3) % 10 AS form,
         CAST({_DAYS!r}[event_id % 3 + 1] AS TIMESTAMP) + (date_trunc('second', ts) - date_trunc('day', ts)) AS wall
  FROM events
),
judged AS (
  SELECT *, {_WALL_QUALITY} AS wall_quality,
    timezone('America/New_York', timezone('UTC', wall + CASE WHEN form IN (3, 8) THEN INTERVAL 4 HOUR ELSE INTERVAL 0 HOUR END)) AS moved
  FROM walls
)
SELECT event_id,
  CASE WHEN form IN (2, 3, 8) THEN CAST(hour(moved) AS VARCHAR)
       WHEN form IN (0, 1, 4, 5, 9) AND wall_quality = 'wall' THEN CAST(hour(wall) AS VARCHAR) ELSE 'UNKNOWN' END AS hour,
  CASE WHEN form IN (2, 3, 8) THEN CAST(isodow(moved) - 1 AS VARCHAR)
       WHEN form IN (0, 1, 4, 5, 9) AND wall_quality = 'wall' THEN CAST(isodow(wall) - 1 AS VARCHAR) ELSE 'UNKNOWN' END AS weekday,
  CASE WHEN form IN (2, 3, 8) THEN 'instant' WHEN form = 7 THEN 'invalid' WHEN form = 6 THEN 'missing'
       ELSE wall_quality END AS quality
FROM judged"""


def trip_durations(spark, sf):
    """Order to shipment as a trip of which the minutes are the whole days' count."""
    lines = table(spark, sf, "lineitem").join(
        table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    end = F.col("o_orderdate") + (F.col("l_shipdate") - F.col("o_orderdate")) / 1440
    rows = lines.select(
        "o_orderkey", F.col("o_orderdate").alias("start"), end.alias("end"),
        (F.col("l_quantity") - 10).alias("distance"),
    )
    kept = cohort.trip_filter(rows, "start", "end", "distance")
    minutes = F.round(elapsed_minutes(F.col("start"), F.col("end")), 3)
    return kept.groupBy(minutes.alias("minutes")).agg(F.count(F.lit(1)).alias("n"))


TRIP_DURATIONS = """
SELECT CAST(d AS DOUBLE) AS minutes, count(*) AS n FROM (
  SELECT date_diff('day', o_orderdate, l_shipdate) AS d
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 10)
WHERE d > 0 AND d <= 360 GROUP BY 1"""


def unknown_rates(spark, sf):
    out = contracts.unknown_rates(served(spark, sf), serving.CONTRACT_COLUMNS)
    return out.withColumn("unknown_rate", F.round("unknown_rate", 9))


UNKNOWN_RATES = f"""WITH {SERVED_SQL}
SELECT "column", round(avg(CASE WHEN v = 'UNKNOWN' THEN 1.0 ELSE 0.0 END), 9) AS unknown_rate
FROM (UNPIVOT served ON {", ".join(serving.CONTRACT_COLUMNS)} INTO NAME "column" VALUE v) GROUP BY 1"""


def payload_agreement(spark, sf):
    """Enrichment of the messy rendering against that of the clean trips, column by column."""
    z, c = zones(spark, sf), codes(spark, sf)
    clean = serving.serve(
        trips(spark, sf).withColumn(
            "lpep_pickup_datetime", iso_seconds(F.col("lpep_pickup_datetime"))
        ),
        z,
        c,
    )
    messy = served(spark, sf)
    report = contracts.agreement(messy, clean, ["trip_id"], serving.CONTRACT_COLUMNS)
    return report.select(
        "column", F.round("share", 9).alias("share"), F.round("unknown_delta", 9).alias("unknown_delta"), "ok"
    )


_CLEAN = f"""clean AS (
  SELECT t.trip_id, s.pu_borough, s.pu_service_zone, s.do_borough, s.do_service_zone,
    coalesce(c.rate_class, 'UNKNOWN') AS rate_class, coalesce(c.fare_basis, 'UNKNOWN') AS fare_basis,
    CASE WHEN wall_quality <> 'wall' THEN 'UNKNOWN' ELSE CAST(hour(wall) AS VARCHAR) END AS pickup_hour,
    CASE WHEN wall_quality <> 'wall' THEN 'UNKNOWN' ELSE CAST(isodow(wall) - 1 AS VARCHAR) END AS pickup_dayofweek,
    wall_quality AS time_quality
  FROM timed t JOIN served s ON t.trip_id = s.trip_id LEFT JOIN codes c ON t.code = c.code
)"""
PAYLOAD_AGREEMENT = f"""WITH {SERVED_SQL}, {_CLEAN}, compared AS (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", avg(CASE WHEN s.{c} = k.{c} THEN 1.0 ELSE 0.0 END) AS share,
    abs(avg(CASE WHEN s.{c} = 'UNKNOWN' THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN k.{c} = 'UNKNOWN' THEN 1.0 ELSE 0.0 END)) AS unknown_delta
    FROM served s JOIN clean k ON s.trip_id = k.trip_id"""
    for c in serving.CONTRACT_COLUMNS
) + """) SELECT "column", round(share, 9) AS share, round(unknown_delta, 9) AS unknown_delta,
share >= 0.9995 AND unknown_delta <= 0.0005 AS ok FROM compared"""


def failing_columns(spark, sf):
    return contracts.failing_columns(payload_agreement(spark, sf))


FAILING_COLUMNS = f"SELECT count(*) FILTER (NOT ok) AS failing_columns FROM ({PAYLOAD_AGREEMENT})"


def rendered_requests(spark, sf):
    return serving_payload(trips(spark, sf), "trip_id").select(
        "trip_id", "PULocationID", "DOLocationID", "RatecodeID", "lpep_pickup_datetime"
    )


_OFFSET = """CASE WHEN wall < TIMESTAMP '2024-03-10 03:00:00' THEN 5
              WHEN wall < TIMESTAMP '2024-11-03 02:00:00' THEN 4 ELSE 5 END"""


def _text_sql(column, offset):
    return f"""CASE WHEN (trip_id + {offset}) % 3 = 0 THEN CAST({column} AS VARCHAR)
                    ELSE ' ' || {column} || '.0 ' END"""


RENDERED_REQUESTS = f"""WITH {TRIPS_SQL},
shown AS (
  SELECT trip_id, pu, dropoff, CASE WHEN trip_id % 11 = 0 THEN NULL ELSE code END AS code,
         trip_id % 3 = 0 OR {_WALL_QUALITY} = 'ambiguous' AS bare, wall AS raw,
         CASE WHEN {_WALL_QUALITY} = 'nonexistent' THEN TIMESTAMP '2024-03-10 03:00:00' ELSE wall END AS wall
  FROM trips
)
SELECT trip_id, {_text_sql("pu", 0)} AS "PULocationID", {_text_sql("dropoff", 1)} AS "DOLocationID",
  {_text_sql("code", 2)} AS "RatecodeID",
  CASE WHEN bare THEN strftime(raw, '%Y-%m-%dT%H:%M:%S')
       WHEN trip_id % 2 = 0 THEN strftime(wall + to_hours({_OFFSET}), '%Y-%m-%dT%H:%M:%SZ')
       ELSE strftime(wall, '%Y-%m-%dT%H:%M:%S') || '-0' || {_OFFSET} || ':00' END AS lpep_pickup_datetime
FROM shown"""


def trip_design(spark, sf):
    rows = serving.serve(requests(spark, sf), zones(spark, sf), codes(spark, sf))
    rows = rows.withColumn("passenger_count", F.when(F.col("trip_id") % 4 != 0, (F.col("trip_id") % 6).cast("string")))
    rows = rows.withColumn("trip_distance", F.when(F.col("trip_id") % 5 != 0, F.lit("2.5")).otherwise("far"))
    return encode.trip_matrix(rows, ["trip_id"])


TRIP_DESIGN = f"""WITH {SERVED_SQL}
SELECT trip_id, pu_borough, pu_service_zone, do_borough, do_service_zone, rate_class, fare_basis, time_quality,
  coalesce(TRY_CAST(pickup_hour AS DOUBLE), -1.0) AS pickup_hour,
  coalesce(TRY_CAST(pickup_dayofweek AS DOUBLE), -1.0) AS pickup_dayofweek,
  CASE WHEN trip_id % 4 <> 0 THEN CAST(trip_id % 6 AS DOUBLE) ELSE 1.0 END AS passenger_count,
  CASE WHEN trip_id % 5 <> 0 THEN 2.5::DOUBLE ELSE 0.0::DOUBLE END AS trip_distance
FROM served"""


def borough_codes(spark, sf):
    """Codes learned on even trips, applied to all: a level unseen there is −1."""
    rows = served(spark, sf)
    train = rows.filter((F.col("trip_id") % 2 == 0) & (F.col("do_borough") != "AFRICA"))
    learned = encode.level_codes(train, "do_borough")
    return encode.ordinal_encode(rows, "do_borough", learned, "code").select("trip_id", "code")


BOROUGH_CODES = f"""WITH {SERVED_SQL},
levels AS (
  SELECT do_borough, CAST(row_number() OVER (ORDER BY do_borough) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT do_borough FROM served WHERE trip_id % 2 = 0 AND do_borough <> 'AFRICA')
)
SELECT trip_id, coalesce(code, -1) AS code FROM served LEFT JOIN levels USING (do_borough)"""

BOUND = {
    "serving_enrichment": (served, SERVED),
    "numeric_keys": (numeric_keys, NUMERIC_KEYS),
    "fractional_keys": (fractional_keys, FRACTIONAL_KEYS),
    "clean_labels": (clean_labels, CLEAN_LABELS),
    "zone_attributes": (zone_table, ZONE_TABLE),
    "local_time_contract": (local_times, LOCAL_TIMES),
    "trip_durations": (trip_durations, TRIP_DURATIONS),
    "unknown_rates": (unknown_rates, UNKNOWN_RATES),
    "payload_agreement": (payload_agreement, PAYLOAD_AGREEMENT),
    "failing_columns": (failing_columns, FAILING_COLUMNS),
    "rendered_requests": (rendered_requests, RENDERED_REQUESTS),
    "trip_design_matrix": (trip_design, TRIP_DESIGN),
    "ordinal_codes": (borough_codes, BOROUGH_CODES),
}
