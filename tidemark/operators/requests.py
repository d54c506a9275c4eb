"""Clean trips rendered as the messy requests a client sends, and features of clean trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeutil import wall_micros

KEY_COLUMNS = ("PULocationID", "DOLocationID", "RatecodeID")


def padded_float(value: Column) -> Column:
    number = value.cast("double")
    text = F.concat(F.lit(" "), F.format_string("%.1f", number), F.lit(" "))
    return F.when(number.isNotNull(), text)


def iso_seconds(wall: Column) -> Column:
    """ISO text of a wall time; the cast, unlike date_format, knows no session time zone."""
    return F.replace(F.substring(wall.cast("string"), 1, 19), F.lit(" "), F.lit("T"))


def _with_instant_texts(df: DataFrame, wall: str, zone: str) -> DataFrame:
    """Adds ``_as_local`` (with its offset) and ``_as_utc`` texts of a wall time.

    A wall time that a clock change skips moves to the first instant after the change. The
    steps are separate projections, so that each conversion runs once per row.
    """
    c = F.col
    local, utc = F.lit(zone), F.lit("UTC")
    minutes = F.floor((wall_micros(c("_valid")) - wall_micros(c("_instant"))) / F.lit(60000000))
    past_hour = F.make_dt_interval(mins=F.minute("_moved"), secs=F.second("_moved"))
    sign = F.when(c("_minutes") < 0, "-").otherwise("+")
    size = F.abs(c("_minutes"))
    offset = F.format_string("%02d:%02d", (size / 60).cast("int"), size % 60)
    return (
        df.withColumn("_as_if", F.convert_timezone(local, utc, c(wall)))
        .withColumn("_moved", F.convert_timezone(utc, local, c("_as_if")))
        .withColumn("_valid", F.when(c("_moved") == c(wall), c(wall)).otherwise(c("_moved") - past_hour))
        .withColumn(
            "_instant",
            F.when(c("_valid") == c(wall), c("_as_if")).otherwise(
                F.convert_timezone(local, utc, c("_valid"))
            ),
        )
        .withColumn("_minutes", minutes.cast("int"))
        .withColumn("_as_local", F.concat(iso_seconds(c("_valid")), sign, offset))
        .withColumn("_as_utc", F.concat(iso_seconds(c("_instant")), F.lit("Z")))
        .drop("_as_if", "_moved", "_valid", "_instant", "_minutes")
    )


def serving_payload(
    trips: DataFrame,
    index: str,
    pickup: str = "lpep_pickup_datetime",
    zone: str = "America/New_York",
    repeated: Column | None = None,
) -> DataFrame:
    """Keys as padded decimals and times in three ISO forms, chosen by row index mod 3.

    ``repeated`` marks wall times that occur twice; they have no single instant and stay bare.
    """
    out = trips
    for offset, column in enumerate(KEY_COLUMNS):
        plain = F.pmod(F.col(index) + offset, F.lit(3)) == 0
        text = F.when(plain, F.col(column).cast("string")).otherwise(padded_float(F.col(column)))
        out = out.withColumn(column, text)
    wall = F.col(pickup)
    if repeated is None:
        repeated = (F.month(wall) == 11) & (F.dayofmonth(wall) == 3) & (F.hour(wall) == 1)
    bare = (F.pmod(F.col(index), F.lit(3)) == 0) | repeated
    rendered = (
        F.when(bare, iso_seconds(wall))
        .when(F.pmod(F.col(index), F.lit(2)) == 0, F.col("_as_utc"))
        .otherwise(F.col("_as_local"))
    )
    out = _with_instant_texts(out, pickup, zone).withColumn(pickup, rendered)
    return out.drop("_as_local", "_as_utc")
