"""Counterfactual rewrites of cases, and whether a result survives them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.contracts import results_match
from tidemark.operators.ordering import ordered_positions

WITHHELD = "[outcome removed]"


def redact(cases: DataFrame, columns: Sequence[str], value: str = WITHHELD) -> DataFrame:
    """Outcome fields overwritten; searchable text stays."""
    return cases.withColumns({c: F.lit(value) for c in columns})


def project_identity(cases: DataFrame, every: str, display: str = "pmcid") -> DataFrame:
    """The display id moves to ``display_id`` or is replaced, by parity of ``every``."""
    number = F.format_string("ref%06d", F.col(every))
    shown = F.when(F.pmod(F.col(every), F.lit(2)) == 0, F.col(display)).otherwise(number)
    return cases.withColumn("display_id", shown).drop(display)


def phase_match(got: DataFrame, want: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """``source, match``: equal results inside each domain, whatever the interleaving."""

    def per_domain(rows: DataFrame) -> DataFrame:
        return ordered_positions(rows.drop("position"), ["source"], [F.col("score").desc(), F.col("pmcid")])

    left, right = per_domain(got), per_domain(want)
    both = left.join(
        right.select("source", "position", F.col("pmcid").alias("_id"), F.col("score").alias("_score")),
        ["source", "position"],
        "full_outer",
    )
    same = (F.col("pmcid") == F.col("_id")) & (F.abs(F.col("score") - F.col("_score")) <= tolerance)
    return both.groupBy("source").agg(F.bool_and(F.coalesce(same, F.lit(False))).alias("match"))


def invariance(base: DataFrame, changed: DataFrame) -> DataFrame:
    """A panel before and after a rewrite that must not matter."""
    return results_match(changed, base)


def panel_spread(panel: DataFrame, domains: Sequence[str]) -> DataFrame:
    """Largest less smallest number of cases per domain; balanced within one."""
    held = [F.count_if(F.col("source") == d) for d in domains]
    return panel.agg((F.greatest(*held) - F.least(*held)).alias("spread")).withColumn(
        "balanced", F.col("spread") <= 1
    )
