"""Ranking, classification and regression metrics, all from pre-aggregated tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import exact_median, running_sums

# Recall bars of the graded classes, the skill floor and the progress bars.
RECALL_BARS = {3: 0.44, 6: 0.44}
MIN_BALANCED_ACCURACY = 0.27
PROGRESS_BARS = {3: 0.40, 6: 0.30}


def score_curve(
    df: DataFrame, label: str, score: str, group: Sequence[str] = (), partitions: int | None = None
) -> DataFrame:
    """Per distinct score, from the highest: positives and rows so far, and both totals."""
    y = F.col(label).cast("long")
    bins = df.groupBy(*group, score).agg(
        F.sum(y).alias("pos"), F.count(F.lit(1)).alias("rows")
    )
    return running_sums(
        bins,
        list(group),
        [F.col(score).desc()],
        {"pos_upto": F.col("pos"), "rows_upto": F.col("rows")},
        {"pos_upto": "pos_all", "rows_upto": "rows_all"},
        partitions,
    )


def precision_recall(
    df: DataFrame, label: str, score: str, group: Sequence[str] = ()
) -> DataFrame:
    """Precision and recall at each distinct threshold, ties grouped."""
    return score_curve(df, label, score, group).select(
        *group,
        score,
        (F.col("pos_upto") / F.col("rows_upto")).alias("precision"),
        F.when(F.col("pos_all") > 0, F.col("pos_upto") / F.col("pos_all")).alias("recall"),
    )


def ranking_metrics(
    df: DataFrame, label: str, score: str, group: Sequence[str] = (), partitions: int | None = None
) -> DataFrame:
    """Average precision over distinct thresholds, and ROC AUC with ties averaged.

    AUC is null where a group holds one class only; AP is 0 without positives.
    """
    curve = score_curve(df, label, score, group, partitions)
    neg = F.col("rows") - F.col("pos")
    above = F.col("pos_upto") - F.col("pos")
    step = F.col("pos") * F.col("pos_upto") / F.col("rows_upto")
    pairs = neg * (above + F.col("pos") / 2)
    return (
        curve.groupBy(*group)
        .agg(
            F.sum(step).alias("_ap"),
            F.sum(pairs).alias("_auc"),
            F.max("pos_all").alias("n_pos"),
            F.max("rows_all").alias("n"),
        )
        .select(
            *group,
            "n",
            "n_pos",
            F.when(F.col("n_pos") > 0, F.col("_ap") / F.col("n_pos"))
            .otherwise(0.0)
            .alias("average_precision"),
            F.when(
                (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n")),
                F.col("_auc") / (F.col("n_pos") * (F.col("n") - F.col("n_pos"))),
            ).alias("roc_auc"),
        )
    )


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    same = (F.col(label) == F.col(prediction)).cast("double")
    return df.agg(F.avg(same).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("truth"), F.col(prediction).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_recall(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Recall per class present in the truth; 0 where the class is never predicted."""
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    return (
        confusion(df, label, prediction)
        .groupBy("truth")
        .agg(F.sum("n").alias("support"), F.sum(hit).alias("hits"))
        .filter(F.col("truth").isNotNull())
        .withColumn("recall", F.col("hits") / F.col("support"))
    )


def balanced_accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    per_class = class_recall(df, label, prediction)
    return per_class.agg(
        F.avg("recall").alias("balanced_accuracy"),
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.sum("support").alias("n"),
        F.count(F.lit(1)).alias("classes"),
    )


def recall_bars(
    df: DataFrame,
    label: str,
    prediction: str,
    bars: Mapping = RECALL_BARS,
    progress: Mapping = PROGRESS_BARS,
    skill: float = MIN_BALANCED_ACCURACY,
) -> DataFrame:
    """One row: bars met per graded class, progress, the skill gate and the verdict.

    A graded class that the truth lacks has recall 0.
    """
    per_class = class_recall(df, label, prediction)

    def recall_of(c) -> Column:
        return F.coalesce(F.max(F.when(F.col("truth") == c, F.col("recall"))), F.lit(0.0))

    wide = per_class.agg(
        F.avg("recall").alias("balanced_accuracy"),
        *[recall_of(c).alias(f"recall_{c}") for c in bars],
    )
    meets = [(F.col(f"recall_{c}") >= bar) for c, bar in bars.items()]
    skilled = F.col("balanced_accuracy") >= skill
    verdict = skilled
    for m in meets:
        verdict = verdict & m
    return wide.select(
        F.round("balanced_accuracy", 4).alias("balanced_accuracy"),
        *[m.alias(f"meets_{c}") for m, c in zip(meets, bars)],
        *[(F.col(f"recall_{c}") >= bar).alias(f"progress_{c}") for c, bar in progress.items()],
        skilled.alias("skill_ok"),
        verdict.alias("meets_bars"),
    )


def regression_errors(
    df: DataFrame, label: str, prediction: str, group: Sequence[str] = ()
) -> DataFrame:
    """Mean and exact median absolute error."""
    errors = df.withColumn("_error", F.abs(F.col(label) - F.col(prediction)))
    mean = errors.groupBy(*group).agg(
        F.avg("_error").alias("mean_abs_error"), F.count("_error").alias("n")
    )
    median = exact_median(errors, group, "_error", "median_abs_error")
    if not group:
        return mean.withColumn("median_abs_error", median.select("median_abs_error").scalar())
    return mean.join(median, list(group))


def majority_share(df: DataFrame, label: str) -> DataFrame:
    """Share of the largest class: what a constant prediction scores."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg((F.max("n") / F.sum("n")).alias("majority_share"))


def class_shares(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all")).scalar()
    return counts.withColumn("share", F.col("n") / total).orderBy(label)


def fold_spread(scores: DataFrame, score: str, digits: int = 4) -> DataFrame:
    rounded = F.round(F.col(score), digits)
    return scores.agg(F.round(F.max(rounded) - F.min(rounded), digits).alias("spread"))


def run_statistics(
    runs: DataFrame,
    reward: str,
    group: Sequence[str] = (),
    solved_at: float = 0.99,
    z: float = 1.959963984540054,
) -> DataFrame:
    """Mean, population deviation, solve rate, pass@n and the Wilson 95 % interval."""
    n, k = F.col("runs"), F.col("solved")
    p = k / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    mid = p + z * z / (2 * n)
    scale = 1 + z * z / n
    stats = runs.groupBy(*group).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col(reward) >= solved_at).alias("solved"),
        F.round(F.avg(reward), 4).alias("mean_reward"),
        F.round(F.stddev_pop(reward), 4).alias("std_reward"),
    )
    return stats.select(
        *group,
        "runs",
        "mean_reward",
        "std_reward",
        F.round(p, 4).alias("solve_rate"),
        F.when(k > 0, 1.0).otherwise(0.0).alias("pass_at_n"),
        F.round((mid - half) / scale, 4).alias("wilson_low"),
        F.round((mid + half) / scale, 4).alias("wilson_high"),
    )


def estimate_gap(reported: float, reference: float, tolerance: float = 0.012) -> bool:
    """A published figure agrees with the recomputed one within the tolerance."""
    return math.isfinite(reported) and abs(reported - reference) <= tolerance


def within_gap(reported: Column, reference: Column, tolerance: float = 0.012) -> Column:
    """``estimate_gap`` of two columns; a missing or infinite figure does not agree."""
    ok = F.abs(reported - reference) <= tolerance
    return F.coalesce(ok & ~F.isnan(reported), F.lit(False))
