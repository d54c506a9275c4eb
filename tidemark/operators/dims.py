"""Dimension lookups with explicit unknowns.

A dimension is small and deduplicated, so the planner broadcasts it by its measured size; a
larger one falls back to a shuffle join, where absent keys carry no match and never pile up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import UNKNOWN, clean_text, numeric_key

UNREPORTED_CODE = 99  # Fixed value: the codebook row for an absent code.


def first_wins(df: DataFrame, key: str, order: str, values: Sequence[str]) -> DataFrame:
    """First row of every key in the declared order; combined before the shuffle."""
    chosen = F.min_by(F.struct(*values), F.col(order))
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(chosen.alias("_row"))
        .select(key, *[F.col(f"_row.{v}").alias(v) for v in values])
    )


def zone_attributes(zones: DataFrame, order: str = "row_no") -> DataFrame:
    """``zone_key, borough, service_zone``; a blank field takes the row's zone label."""
    label = clean_text(F.col("Zone"))
    rows = zones.select(
        numeric_key(F.col("LocationID")).alias("zone_key"),
        F.coalesce(clean_text(F.col("Borough")), label).alias("borough"),
        F.coalesce(clean_text(F.col("service_zone")), label).alias("service_zone"),
        order,
    )
    return first_wins(rows, "zone_key", order, ["borough", "service_zone"])


def code_attributes(codes: DataFrame, order: str = "row_no") -> DataFrame:
    rows = codes.select(
        numeric_key(F.col("code")).alias("code_key"), "rate_class", "fare_basis", order
    )
    return first_wins(rows, "code_key", order, ["rate_class", "fare_basis"])


def _lookup(fact: DataFrame, key: Column, dim: DataFrame, dim_key: str, names: dict) -> DataFrame:
    """Left join on ``key``; every attribute that finds no value becomes UNKNOWN."""
    small = dim.select(
        F.col(dim_key).alias("_dim_key"), *[F.col(c).alias(f"_{n}") for c, n in names.items()]
    )
    joined = fact.withColumn("_fact_key", key).join(
        small, F.col("_fact_key") == F.col("_dim_key"), "left"
    )
    for name in names.values():
        joined = joined.withColumn(name, F.coalesce(F.col(f"_{name}"), F.lit(UNKNOWN)))
    return joined.drop("_fact_key", "_dim_key", *[f"_{n}" for n in names.values()])


def resolve_zone(fact: DataFrame, column: str, attributes: DataFrame, prefix: str) -> DataFrame:
    names = {"borough": f"{prefix}_borough", "service_zone": f"{prefix}_service_zone"}
    return _lookup(fact, numeric_key(F.col(column)), attributes, "zone_key", names)


def resolve_code(fact: DataFrame, column: str, attributes: DataFrame) -> DataFrame:
    """An absent code is looked up as 99; an unreadable or unlisted one is UNKNOWN."""
    absent = F.col(column).isNull()
    key = F.when(absent, F.lit(UNREPORTED_CODE).cast("long")).otherwise(numeric_key(F.col(column)))
    names = {"rate_class": "rate_class", "fare_basis": "fare_basis"}
    return _lookup(fact, key, attributes, "code_key", names)


def level_hash(level: Column) -> Column:
    return F.xxhash64(level)


def join_levels(df: DataFrame, column: str, levels: DataFrame) -> DataFrame:
    """Left join of rows to ``levels`` (``_level_hash``, ``_level`` and values), keys dropped.

    A null level matches nothing. Were rows dealt out by level alone, all rows without one
    would meet in one task: they are dealt out by a hash of the whole row.
    """
    parts = [F.col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    dealt = F.when(F.col(column).isNotNull(), level_hash(F.col(column))).otherwise(F.xxhash64(*parts))
    same = (F.col("_dealt") == F.col("_level_hash")) & (F.col(column) == F.col("_level"))
    return df.withColumn("_dealt", dealt).join(levels, same, "left").drop("_dealt", "_level_hash", "_level")


def rate_lookup(df: DataFrame, column: str, rates: DataFrame, prior: Column, name: str) -> DataFrame:
    """Level → rate; an unseen or null level takes the prior. ``rates``: level, rate."""
    level = F.col("level").cast(df.schema[column].dataType)
    small = rates.select(level_hash(level).alias("_level_hash"), level.alias("_level"), F.col("rate").alias("_rate"))
    return join_levels(df, column, small).withColumn(name, F.coalesce("_rate", prior)).drop("_rate")


def registry_join(rows: DataFrame, registry: DataFrame, key: str = "record_key") -> DataFrame:
    """Canonical identity by registry; a row the registry does not know is an error."""
    meta = registry.select(key, F.col("pmcid").alias("_id"), F.col("domain").alias("source"))
    joined = rows.drop("pmcid", "source").join(meta, key, "left")
    message = F.concat(F.lit("unregistered record_key: "), F.col(key).cast("string"))
    checked = F.when(F.col("_id").isNull(), F.raise_error(message)).otherwise(F.col("_id"))
    return joined.withColumn("pmcid", checked.cast("string")).drop("_id")


def anchor_hits(found: DataFrame, anchors: DataFrame, key: str, domain: str) -> DataFrame:
    """How many anchor ids of every domain were found."""
    hits = anchors.join(found.select(key).distinct(), key, "left_semi")
    return hits.groupBy(domain).agg(F.count(F.lit(1)).alias("hits"))
