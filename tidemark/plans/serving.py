"""Serving enrichment: one column plan for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeutil import with_local_time
from tidemark.operators import dims

CONTRACT_COLUMNS = [
    "pu_borough",
    "pu_service_zone",
    "do_borough",
    "do_service_zone",
    "rate_class",
    "fare_basis",
    "pickup_hour",
    "pickup_dayofweek",
    "time_quality",
]


def enrich(trips: DataFrame, zones: DataFrame, codes: DataFrame, order: str = "row_no") -> DataFrame:
    """Zone and rate attributes of trips; every miss is UNKNOWN, never dropped."""
    attributes = dims.zone_attributes(zones, order)
    out = dims.resolve_zone(trips, "PULocationID", attributes, "pu")
    out = dims.resolve_zone(out, "DOLocationID", attributes, "do")
    return dims.resolve_code(out, "RatecodeID", dims.code_attributes(codes, order))


def derive_time(
    trips: DataFrame, column: str = "lpep_pickup_datetime", zone: str = "America/New_York"
) -> DataFrame:
    return (
        with_local_time(trips, column, "_t", zone)
        .withColumns(
            {
                "pickup_hour": F.col("_t.hour"),
                "pickup_dayofweek": F.col("_t.weekday"),
                "time_quality": F.col("_t.quality"),
            }
        )
        .drop("_t")
    )


def serve(trips: DataFrame, zones: DataFrame, codes: DataFrame, order: str = "row_no") -> DataFrame:
    """Trips with the nine contract columns."""
    return derive_time(enrich(trips, zones, codes, order))
