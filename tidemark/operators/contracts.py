"""Contracts on frames, comparison of results and content digests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import UNKNOWN

AGREEMENT_BAR = 0.9995
UNKNOWN_DELTA = 0.0005
POPULATION_PENALTY = 4


class ContractError(ValueError):
    """A frame breaks a rule it was declared to keep."""


def non_empty(df: DataFrame) -> DataFrame:
    if not df.columns:
        raise ContractError("frame has no columns")
    if df.limit(1).count() == 0:
        raise ContractError("frame is empty")
    return df


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def assert_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    first = duplicate_keys(df, key).limit(1).collect()
    if first:
        raise ContractError(f"key {list(key)} repeats: {first[0]}")
    return df


def assert_columns(expected: Sequence[str], actual: Sequence[str]) -> None:
    """Ordered column equality between training and serving."""
    if list(expected) != list(actual):
        missing = [c for c in expected if c not in actual]
        extra = [c for c in actual if c not in expected]
        raise ContractError(f"columns differ: missing {missing}, unexpected {extra}, or order")


def assert_required(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ContractError(f"missing required columns: {missing}")
    return df


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row per rule with the number of rows that break it; one pass over the data.

    A rule is a condition every row has to meet; a null outcome breaks it.
    """
    broken = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()]
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *broken)
    return wide.unpivot("n_rows", list(rules), "rule", "violations")


def feature_rules() -> dict[str, Column]:
    """What every point-in-time feature row has to satisfy."""
    c = F.col
    idle = c("n_lines") == 0
    return {
        "counts_not_negative": (c("n_lines") >= 0) & (c("n_sku") >= 0) & (c("n_credit") >= 0),
        "skus_within_lines": c("n_sku") <= c("n_lines"),
        "credits_within_lines": c("n_credit") <= c("n_lines"),
        "recency_from_minus_one": c("days_since_last") >= -1,
        "idle_means_minus_one": idle == (c("days_since_last") == -1),
        "idle_means_no_spend": ~idle | (c("spend_cents") == 0),
        "key_present": c("customer_id").isNotNull() & c("as_of").isNotNull(),
    }


def binary_rule(label: str) -> dict[str, Column]:
    return {"label_is_binary": F.col(label).isin(0, 1)}


def prediction_report(scored: DataFrame, expected_rows: Column | int, column: str) -> DataFrame:
    """One row: length kept, nothing missing, everything numeric."""
    number = F.col(column).cast("string").try_cast("double")
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(number.isNull() | F.isnan(number)).alias("n_bad"),
    ).withColumn("ok", (F.col("n_rows") == expected_rows) & (F.col("n_bad") == 0))


def report_structure(
    folds: DataFrame, score: str, pooled: Column | float, scored: str
) -> DataFrame:
    """At least two folds, every fold positive, pooled score in (0, 1], something scored."""
    whole = F.lit(pooled) if isinstance(pooled, float) else pooled
    return folds.agg(
        (F.count(F.lit(1)) >= 2).alias("enough_folds"),
        F.bool_and(F.col(score) > 0).alias("folds_positive"),
        (F.sum(scored) > 0).alias("something_scored"),
    ).withColumn("score_in_range", (whole > 0) & (whole <= 1))


def agreement(got: DataFrame, want: DataFrame, key: Sequence[str], columns: Sequence[str]):
    """Per column: share of equal values, difference of UNKNOWN rates, and the verdict.

    Rows are matched by key; a row only one side has counts as a disagreement everywhere.
    """
    left = got.select(*key, *[F.col(c).cast("string").alias(f"_g_{c}") for c in columns])
    right = want.select(*key, *[F.col(c).cast("string").alias(f"_w_{c}") for c in columns])
    both = left.withColumn("_in_g", F.lit(True)).join(
        right.withColumn("_in_w", F.lit(True)), list(key), "full_outer"
    )
    present = F.col("_in_g").isNotNull() & F.col("_in_w").isNotNull()
    rows = F.count(F.lit(1))
    measures = []
    for c in columns:
        same = present & F.col(f"_g_{c}").eqNullSafe(F.col(f"_w_{c}"))
        unknown_g = F.count_if(F.col(f"_g_{c}") == UNKNOWN) / F.count("_in_g")
        unknown_w = F.count_if(F.col(f"_w_{c}") == UNKNOWN) / F.count("_in_w")
        measures.append(
            F.struct(
                F.lit(c).alias("column"),
                (F.count_if(same) / rows).alias("share"),
                F.abs(unknown_g - unknown_w).alias("unknown_delta"),
            )
        )
    wide = both.agg(F.array(*measures).alias("m"))
    return (
        wide.select(F.explode("m").alias("m"))
        .select("m.*")
        .withColumn(
            "ok", (F.col("share") >= AGREEMENT_BAR) & (F.col("unknown_delta") <= UNKNOWN_DELTA)
        )
    )


def failing_columns(report: DataFrame) -> DataFrame:
    return report.agg(F.count_if(~F.col("ok")).alias("failing_columns"))


def unknown_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of UNKNOWN per column."""
    wide = df.agg(*[F.avg((F.col(c) == UNKNOWN).cast("double")).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column", "unknown_rate")


def align(got: DataFrame, want: DataFrame, key: Sequence[str], columns: Sequence[str]):
    """Full outer alignment of two ordered lists; ``same`` is false where a side is missing."""
    left = got.select(*key, F.struct(*columns).alias("got"))
    right = want.select(*key, F.struct(*columns).alias("want"))
    both = left.join(right, list(key), "full_outer")
    return both.withColumn("same", F.col("got").eqNullSafe(F.col("want")))


def results_match(
    got: DataFrame,
    want: DataFrame,
    position: Sequence[str] = ("position",),
    tolerance: float = 1e-10,
) -> DataFrame:
    """One row: same length, same ids and sources in the same order, scores within tolerance."""
    columns = ["pmcid", "source", "score"]
    both = align(got, want, position, columns)
    named = (F.col("got.pmcid") == F.col("want.pmcid")) & (
        F.col("got.source") == F.col("want.source")
    )
    close = F.abs(F.col("got.score") - F.col("want.score")) <= tolerance
    ok = F.coalesce(named & close, F.lit(False))
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~ok).alias("mismatches"),
        F.coalesce(F.bool_and(ok), F.lit(True)).alias("match"),
    )


def panel_match(
    got: DataFrame,
    want: DataFrame,
    k: int,
    got_counts: DataFrame,
    want_counts: DataFrame,
    tolerance: float = 1e-10,
) -> DataFrame:
    """Length k, unique ids, same population per source, and equal results."""
    shape = got.agg(
        ((F.count(F.lit(1)) == k) & (F.count_distinct("pmcid") == k)).alias("shape_ok")
    )
    drift = align(got_counts, want_counts, ["source"], ["n"]).agg(
        F.coalesce(F.bool_and("same"), F.lit(True)).alias("ok")
    )
    results = results_match(got, want, tolerance=tolerance)
    return results.select(
        shape.scalar().alias("shape_ok"), drift.scalar().alias("counts_ok"), "match"
    ).withColumn("panel_ok", F.col("shape_ok") & F.col("counts_ok") & F.col("match"))


def result_shape(results: DataFrame, k: int, sources: Sequence[str]) -> DataFrame:
    assert_required(results, ["pmcid", "source", "score"])
    score = F.col("score").try_cast("double")
    return results.agg(
        (F.count(F.lit(1)) == k).alias("length_ok"),
        (F.count_distinct("pmcid") == k).alias("ids_unique"),
        (F.count_if(~F.coalesce(F.col("source").isin(*sources), F.lit(False))) == 0).alias(
            "sources_known"
        ),
        (F.count_if(score.isNull()) == 0).alias("scores_numeric"),
    )


def drift_count(
    got: DataFrame, want: DataFrame, got_counts: DataFrame, want_counts: DataFrame
) -> DataFrame:
    """Positions that differ, plus 4 for a different population and 4 for different counts."""
    misses = align(got, want, ["position"], ["pmcid"]).agg(F.count_if(~F.col("same")).alias("n"))
    size = lambda c: c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    counts = align(got_counts, want_counts, ["source"], ["n"]).agg(
        F.coalesce(F.bool_and("same"), F.lit(True)).alias("ok")
    )
    penalty = F.when(size(got_counts) != size(want_counts), POPULATION_PENALTY).otherwise(0)
    penalty += F.when(~counts.scalar(), POPULATION_PENALTY).otherwise(0)
    return misses.select((F.col("n") + penalty).alias("drift")).withColumn(
        "bucket", drift_bucket(F.col("drift"))
    )


def drift_bucket(drift: Column) -> Column:
    return (
        F.when(drift == 0, "0").when(drift <= 3, "1-3").when(drift <= 8, "4-8").otherwise("9+")
    )


def disjoint(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: how many keys both frames hold."""
    shared = left.select(*key).intersect(right.select(*key))
    return shared.agg(F.count(F.lit(1)).alias("shared")).withColumn(
        "disjoint", F.col("shared") == 0
    )


def set_difference(required: DataFrame, observed: DataFrame) -> DataFrame:
    """Members only one of two single-column sets has, with the side that has them."""
    left, right = required.distinct(), observed.distinct()
    missing = left.exceptAll(right).withColumn("side", F.lit("missing"))
    return missing.unionByName(right.exceptAll(left).withColumn("side", F.lit("unexpected")))


def row_text(columns: Sequence[str]) -> Column:
    """Tab-joined values; null and the empty text stay apart."""
    shown = [
        F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns
    ]
    return F.concat_ws("\t", *shown)


def table_digest(df: DataFrame, columns: Sequence[str], salt: str = "") -> DataFrame:
    """Salted content digest that ignores row order and partitioning, not multiplicity.

    Each row's sha256 is cut into eight 32-bit parts which are summed: partial sums combine
    on the map side, so no row is shuffled or sorted. The digest is the sha256 of salt, row
    count and the eight sums.
    """
    text = F.sha2(F.concat_ws("\n", F.lit(salt), row_text(columns)), 256)
    part = lambda i: F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10)
    sums = [F.coalesce(F.sum(part(i).cast("decimal(20,0)")), F.lit(0)) for i in range(8)]
    wide = df.select(text.alias("_h")).agg(F.count(F.lit(1)).alias("n_rows"), *[
        s.cast("string").alias(f"_s{i}") for i, s in enumerate(sums)
    ])
    whole = F.concat_ws(":", F.lit(salt), F.col("n_rows"), *[f"_s{i}" for i in range(8)])
    return wide.select("n_rows", F.sha2(whole, 256).alias("digest"))


def spec_fingerprint(spec: Mapping) -> str:
    """First 16 hex digits of the sha256 of the key-sorted JSON of a specification."""
    text = json.dumps(spec, sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def all_true(df: DataFrame, columns: Sequence[str]) -> bool:
    row = df.select(reduce(lambda a, b: a & b, [F.col(c) for c in columns])).first()
    return bool(row and row[0])
