"""Cohort rules and row selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeutil import elapsed_minutes

RECORDED_SEX = ("Male", "Female")
LONGEST_TRIP_MINUTES = 360


def recorded_only(df: DataFrame, column: str = "gender", allowed: Sequence = RECORDED_SEX):
    return df.filter(F.col(column).isin(*allowed))


def observable_only(
    df: DataFrame, entity: str = "patient_nbr", event: str = "encounter_id"
) -> DataFrame:
    """Drops every entity's latest event, the outcome of which is not yet known.

    The latest id is a grouped maximum joined back: a window would put all events of a hot
    entity into one task, the aggregate combines first and the join can be split.
    """
    latest = df.groupBy(entity).agg(F.max(event).alias("_latest"))
    return df.join(latest, entity).filter(F.col(event) != F.col("_latest")).drop("_latest")


def select_cohort(
    df: DataFrame,
    sex: str = "gender",
    entity: str = "patient_nbr",
    event: str = "encounter_id",
    allowed: Sequence = RECORDED_SEX,
) -> DataFrame:
    """Sex rule first, then observability among the rows that are left."""
    return observable_only(recorded_only(df, sex, allowed), entity, event)


def trip_filter(df: DataFrame, start: str, end: str, distance: str) -> DataFrame:
    """Trips of positive distance that took more than nothing and at most six hours."""
    minutes = elapsed_minutes(F.col(start), F.col(end))
    return df.filter((minutes > 0) & (minutes <= LONGEST_TRIP_MINUTES) & (F.col(distance) > 0))


def routed_slice(df: DataFrame, column: str, held_back: Sequence, width: str) -> DataFrame:
    """Narrow routing keeps rows of classes that are not held back; full keeps every row."""
    if width not in ("narrow", "full"):
        raise ValueError(f"unknown width: {width}")
    return df.filter(~F.col(column).isin(*held_back)) if width == "narrow" else df


def features_only(df: DataFrame, label: str) -> DataFrame:
    return df.drop(label)


def alert_list(df: DataFrame, score: str, key: str, capacity: int) -> DataFrame:
    """The top of the ranked list, as far as the team's capacity reaches."""
    return df.orderBy(F.col(score).desc(), F.col(key)).limit(capacity)


def head_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(key).limit(n)
