"""Wall-clock helpers on TIMESTAMP_NTZ; none depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import UNKNOWN, stripped

# Fixed value: the ISO 8601 forms: calendar or week date, extended or basic; any one character
# before the time; hours alone or with minutes, seconds and a fraction; an offset of the same forms.
ISO_PATTERN = (
    r"(?s)^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{8}|[0-9]{4}-W[0-9]{2}(?:-[0-9])?|[0-9]{4}W[0-9]{2}[0-9]?)"
    r"(?:.([0-9]{2}(?::[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?)?|[0-9]{4}(?:[0-9]{2}(?:[.,][0-9]+)?)?)"
    r"(Z|[+-][0-9]{2}(?:(?::[0-9]{2}){1,2}|[0-9]{2}(?:[0-9]{2})?)?)?)?\z"
)


def days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def wall_micros(ts: Column) -> Column:
    """Microseconds from 1970-01-01 on the wall clock."""
    day = F.unix_date(ts.cast("date")).cast("long")
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    fraction = (F.extract(F.lit("SECOND"), ts) * 1000000).cast("long")
    return (day * 86400 + seconds) * 1000000 + fraction


def wall_from_micros(micros: Column) -> Column:
    """The wall time of which ``wall_micros`` is the given number."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    day = F.lit(86400000000)
    seconds = (F.pmod(micros, day) / F.lit(1000000)).cast("decimal(18,6)")
    return epoch + F.make_dt_interval(days=F.floor(micros / day).cast("int"), secs=seconds)


def elapsed_minutes(start: Column, end: Column) -> Column:
    return (wall_micros(end) - wall_micros(start)) / F.lit(60000000.0)


def whole_days(earlier: Column, later: Column) -> Column:
    """Completed 24-hour days between two wall times, rounded down."""
    return F.floor((wall_micros(later) - wall_micros(earlier)) / F.lit(86400000000)).cast("long")


def day_bucket(ts: Column, width_days: int) -> Column:
    return F.floor(F.unix_date(ts.cast("date")) / F.lit(width_days)).cast("long")


def _iso_day(text: Column) -> Column:
    """Text yyyy-MM-dd of an ISO date in any form of the pattern; null where a week is not real."""
    plain = F.replace(text, F.lit("-"))
    calendar = F.concat_ws("-", F.substring(plain, 1, 4), F.substring(plain, 5, 2), F.substring(plain, 7, 2))
    number = lambda start, size: F.substring(plain, start, size).try_cast("int")
    week, day = number(6, 2), F.coalesce(number(8, 1), F.lit(1))
    # The first week is the one that holds 4 January.
    fourth = F.concat(F.substring(plain, 1, 4), F.lit("-01-04")).try_cast("date")
    monday = F.date_add(F.date_sub(fourth, F.weekday(fourth)), (week - 1) * 7)
    real = (F.weekofyear(monday) == week) & day.between(1, 7)
    by_week = F.when(real, F.date_add(monday, day - 1).cast("string"))
    return F.when(F.contains(text, F.lit("W")), by_week).otherwise(calendar)


def _iso_clock(text: Column) -> Column:
    """Text HH:mm:ss with at most six digits of a fraction; what is absent is zero."""
    plain = F.replace(F.replace(text, F.lit(":")), F.lit(","), F.lit("."))
    whole = F.rpad(F.substring(plain, 1, 6), 6, "0")
    parts = F.concat_ws(":", F.substring(whole, 1, 2), F.substring(whole, 3, 2), F.substring(whole, 5, 2))
    return F.concat(parts, F.substring(plain, 7, 7))


def with_local_time(
    df: DataFrame, column: str, name: str = "local", zone: str = "America/New_York"
) -> DataFrame:
    """Adds ``name``: struct(hour, weekday, quality) of ISO text in ``column``.

    Text with an offset is an instant and is moved to ``zone``; text without one is already
    wall time there. Wall times a clock change skips or repeats have no single instant, so
    hour and weekday stay UNKNOWN. Monday is 0.

    The steps are separate projections, so that each is evaluated once per row.
    """
    part = lambda i: F.regexp_extract(F.col("_text"), ISO_PATTERN, i)
    c = F.col
    local, utc = F.lit(zone), F.lit("UTC")
    parsed = df.withColumn("_text", stripped(c(column))).withColumns(
        {"_date": part(1), "_clock": part(2), "_offset": part(3)}
    )
    # A failing try_cast is costly, so only offsets with digits reach it.
    digits = F.when(F.length("_offset") > 1, F.rpad(F.replace(c("_offset"), F.lit(":")), 7, "0"))
    parsed = parsed.withColumns(
        {
            "_wall": F.when(c("_date") != "", F.concat(_iso_day(c("_date")), F.lit(" "), _iso_clock(c("_clock")))).try_cast(
                "timestamp_ntz"
            ),
            "_hours": F.substring(digits, 2, 2).try_cast("int"),
            "_minutes": F.substring(digits, 4, 2).try_cast("int"),
            "_seconds": F.substring(digits, 6, 2).try_cast("int"),
        }
    )
    sign = F.when(F.startswith("_offset", F.lit("-")), -1).otherwise(1)
    real = (c("_offset") == "") | (c("_offset") == "Z") | (
        (c("_hours") < 24) & (c("_minutes") < 60) & (c("_seconds") < 60)
    )
    shift = F.when(real, sign * (c("_hours") * 3600 + c("_minutes") * 60 + c("_seconds")))
    moved = c("_wall") - F.make_dt_interval(secs=F.coalesce(shift, F.lit(0)).cast("decimal(18,6)"))
    bare = c("_offset") == ""
    day_later = c("_as_utc") + days(1)
    parsed = (
        parsed.withColumn("_real", F.coalesce(real, F.lit(False)))
        .withColumn("_instant", F.when(~bare, F.convert_timezone(utc, local, moved)))
        .withColumn("_as_utc", F.when(bare, F.convert_timezone(local, utc, c("_wall"))))
        # Of a repeated wall time the earlier instant is taken. Read with the offset in force
        # a day later, the same wall time is the later instant, if there is one.
        .withColumn("_day_later", F.convert_timezone(utc, local, day_later))
        .withColumn("_second", c("_wall") - (c("_day_later") - day_later))
    )
    reads_back = lambda u: F.convert_timezone(utc, local, u) == c("_wall")
    repeats = (c("_second") != c("_as_utc")) & reads_back(c("_second"))
    quality = (
        F.when(c(column).isNull(), "missing")
        .when(c("_wall").isNull() | ~c("_real"), "invalid")
        .when(~bare, "instant")
        .when(~reads_back(c("_as_utc")), "nonexistent")
        .when(repeats, "ambiguous")
        .otherwise("wall")
    )
    judged = parsed.withColumn("_quality", quality).withColumn(
        "_local",
        F.when(c("_quality") == "instant", c("_instant")).when(c("_quality") == "wall", c("_wall")),
    )
    known = lambda v: F.coalesce(v.cast("string"), F.lit(UNKNOWN))
    contract = F.struct(
        known(F.hour("_local")).alias("hour"),
        known(F.weekday("_local")).alias("weekday"),
        c("_quality").alias("quality"),
    )
    spent = ["_text", "_date", "_clock", "_offset", "_wall", "_hours", "_minutes", "_seconds"]
    spent += ["_real", "_instant", "_as_utc", "_day_later", "_second"]
    spent += ["_quality", "_local"]
    return judged.withColumn(name, contract).drop(*spent)
