"""Profiles and inspections: one pass, one small table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import clean_text
from tidemark.operators.ordering import exact_median


def corpus_profile(
    rows: DataFrame,
    file: str,
    position: str,
    identity: str,
    title: str,
    summary: str,
    group: Sequence[str] = (),
) -> DataFrame:
    """Per file: rows, distinct ids, first and last id, blanks, exact median summary length."""
    keys = [file, *group]
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    sized = rows.withColumn("_chars", F.length(summary))
    facts = sized.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(identity).alias("distinct_ids"),
        F.min_by(identity, position).alias("first_id"),
        F.max_by(identity, position).alias("last_id"),
        F.count_if(blank(title)).alias("missing_title"),
        F.count_if(blank(summary)).alias("missing_summary"),
    )
    median = exact_median(sized, keys, "_chars", "median_summary_chars")
    return facts.join(median, keys, "left")


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(column)


def top_counts(df: DataFrame, column: str, k: int) -> DataFrame:
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), column).limit(k)


def class_grid(df: DataFrame, area: str, label: str, classes: Sequence) -> DataFrame:
    """Area × class counts, 0 where a pair is absent."""
    return df.groupBy(area).pivot(label, list(classes)).count().na.fill(0)


def distinct_per_group(df: DataFrame, group: str, column: str, name: str) -> DataFrame:
    return df.groupBy(group).agg(F.count_distinct(column).alias(name))


def outcome_mix(df: DataFrame, outcome: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(outcome).cast("long")).alias("positives"),
        F.round(F.avg(F.col(outcome).cast("double")), 4).alias("rate"),
    )


def credit_share(tx: DataFrame) -> DataFrame:
    flag = F.col("is_credit")
    return tx.agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(flag).alias("n_credit"),
        F.round(F.avg(flag.cast("double")), 5).alias("credit_share"),
        F.min("InvoiceDate").alias("first_date"),
        F.max("InvoiceDate").alias("last_date"),
    )


def inspect(df: DataFrame, area: str, code: str) -> DataFrame:
    """Row count, sorted distinct areas and number of distinct codes."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.array_sort(F.collect_set(area)).alias("areas"),
        F.count_distinct(code).alias("n_codes"),
    )


def blank_share(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.avg(clean_text(F.col(column)).isNull().cast("double")).alias("blank_share"))
