"""Ordered analysis of append-only action logs, by session."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ordering import running_sums
from tidemark.session import cut_lineage

CUT_EVERY = 6  # steps after which a long funnel stores its cursors


def funnel_progress(
    log: DataFrame, steps: Sequence[str], session: str, op: str, order: Sequence[str]
) -> DataFrame:
    """Steps reached per session in a greedy ordered subsequence match.

    For every step the earliest matching event after the previous step is a grouped minimum.
    Each round reads only its own step's events, and no session is ever gathered in one task.
    """
    at = F.struct(*order)
    hits: list[DataFrame] = []
    cursor: DataFrame | None = None
    for place, step in enumerate(steps, start=1):
        events = log.filter(F.col(op) == step).select(F.col(session).alias("_s"), at.alias("_at"))
        if cursor is not None:
            events = events.join(cursor, "_s").filter(F.col("_at") > F.col("_cursor"))
        cursor = events.groupBy("_s").agg(F.min("_at").alias("_cursor"))
        if place % CUT_EVERY == 0:
            cursor = cut_lineage(cursor)
        hits.append(cursor.select(F.col("_s").alias(session), F.lit(place).alias("_step")))
    furthest = reduce(DataFrame.unionByName, hits).groupBy(session).agg(F.max("_step").alias("_step"))
    return log.select(session).distinct().join(furthest, session, "left").select(
        session,
        F.coalesce("_step", F.lit(0)).alias("steps_reached"),
        (F.coalesce("_step", F.lit(0)) == len(steps)).alias("complete"),
    )


def event_after(
    log: DataFrame, session: str, order: Sequence[str], chain: Mapping[str, Column]
) -> DataFrame:
    """Chained events: the first match of each condition at or after the previous one.

    Adds one column per condition: the order value of its match, null when it never came.
    """
    at = F.struct(*order)
    out = log.select(session).distinct()
    cursor: DataFrame | None = None
    for name, condition in chain.items():
        events = log.filter(condition).select(F.col(session).alias("_s"), at.alias("_at"))
        if cursor is not None:
            events = events.join(cursor, "_s").filter(F.col("_at") >= F.col("_cursor"))
        cursor = events.groupBy("_s").agg(F.min("_at").alias("_cursor"))
        found = cursor.select(F.col("_s").alias(session), F.col("_cursor").alias(name))
        out = out.join(found, session, "left")
    return out


def flags(log: DataFrame, session: str, conditions: Mapping[str, Column]) -> DataFrame:
    """Per session and condition: did it ever hold."""
    return log.groupBy(session).agg(
        *[F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()]
    )


def depth_floors(
    log: DataFrame,
    session: str,
    accepted: Column,
    observation: Column,
    kind: Column,
    min_total: int,
    min_observations: int,
    min_kinds: int,
) -> DataFrame:
    seen = accepted & observation
    counts = log.groupBy(session).agg(
        F.count_if(accepted).alias("accepted"),
        F.count_if(seen).alias("observations"),
        F.count_distinct(F.when(seen, kind)).alias("observation_kinds"),
    )
    return counts.withColumn(
        "deep_enough",
        (F.col("accepted") >= min_total)
        & (F.col("observations") >= min_observations)
        & (F.col("observation_kinds") >= min_kinds),
    )


def prefix_sequence(
    log: DataFrame, session: str, op: str, order: Sequence[str], expected: Sequence[str]
) -> DataFrame:
    """Do a session's first events equal the expected list.

    ``row_number <= n`` lets the planner keep n rows per session before the shuffle.
    """
    n = len(expected)
    place = F.row_number().over(W.partitionBy(session).orderBy(*order))
    first = log.withColumn("_place", place).filter(F.col("_place") <= n)
    ops = F.transform(
        F.array_sort(F.collect_list(F.struct("_place", F.col(op).alias("_op")))), lambda x: x["_op"]
    )
    want = F.array(*[F.lit(e) for e in expected])
    return first.groupBy(session).agg(F.coalesce(ops == want, F.lit(False)).alias("matches"))


def sequence_continuity(log: DataFrame, session: str, seq: str) -> DataFrame:
    """Is ``seq`` exactly 1..n per session, without gaps and repeats."""
    return log.groupBy(session).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(seq).alias("_distinct"),
        F.min(seq).alias("_low"),
        F.max(seq).alias("_high"),
    ).select(
        session,
        "n",
        (
            (F.col("n") == F.col("_distinct"))
            & (F.col("_low") == 1)
            & (F.col("_high") == F.col("n"))
        ).alias("continuous"),
    )


def running_budget(
    log: DataFrame, session: str, order: Sequence[str], attempt: Column, limit: int
) -> DataFrame:
    """Attempts so far, what is left of the limit, and whether this row exceeds it."""
    used = running_sums(
        log,
        [session],
        [F.col(c) for c in order],
        {"attempts": F.when(attempt, 1).otherwise(0).cast("long")},
    )
    return used.withColumn("remaining", F.greatest(F.lit(limit) - F.col("attempts"), F.lit(0))).withColumn(
        "over_limit", attempt & (F.col("attempts") > limit)
    )


def best_so_far(log: DataFrame, run: str, quality: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the highest quality per run; the earliest of equals stays.

    Order columns are numeric or timestamps of which the negated position breaks ties.
    """
    rank = F.struct(*quality, *[(-F.col(c)).alias(f"_neg_{c}") for c in order])
    best = F.max_by(F.struct(*quality, *order), rank)
    return log.groupBy(run).agg(best.alias("_b")).select(run, "_b.*")


def latest_state(log: DataFrame, key: Sequence[str], value: Sequence[str], order: Sequence[str]):
    """Last value per key."""
    last = F.max_by(F.struct(*value), F.struct(*order))
    return log.groupBy(*key).agg(last.alias("_v")).select(*key, "_v.*")


def partial_score(parts: Sequence[tuple[Column, float]], cap: float = 1.0) -> Column:
    """Sum of the weights whose condition holds, at most ``cap``."""
    total = F.lit(0.0)
    for condition, weight in parts:
        total = total + F.when(condition, F.lit(float(weight))).otherwise(0.0)
    return F.least(F.lit(float(cap)), total)
