"""Point-in-time backtest: attribution, features, labels, temporal split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import pit
from tidemark.operators.attribution import credit_attribution
from tidemark.operators.ledger import with_credit_flag
from tidemark.operators.splits import temporal_split
from tidemark.session import written


def features(
    tx: DataFrame, probes: DataFrame, order: Sequence[str] | None = None, **windows: int
) -> DataFrame:
    """Trailing features of every probe from raw ledger lines; probes are read more than once."""
    return _features(tx, written(probes, "probes"), order, **windows)


def _features(tx: DataFrame, probes: DataFrame, order: Sequence[str] | None, **windows: int) -> DataFrame:
    # The matching sorts and carries only what features read.
    tx = with_credit_flag(tx)
    read = [*pit.READ, *(order if order is not None else [c for c in tx.columns if c == "line_no"])]
    lines = tx.select(*dict.fromkeys(read))
    return pit.pit_features(credit_attribution(lines, order), probes, **windows)


def training_frame(
    tx: DataFrame, stamps: DataFrame, order: Sequence[str] | None = None
) -> DataFrame:
    """Features and label of every active account at every stamp, joined by key.

    Matching, probes and labels each read the ledger: it is stored once, and so are the probes.
    """
    tx = written(tx, "ledger")
    probes = written(pit.probe_grid(tx, stamps), "probes")
    labels = pit.horizon_label(tx, probes)
    return _features(tx, probes, order).join(labels, pit.PROBE)


def report_sizes(frame: DataFrame, cutoff: str) -> DataFrame:
    """One row: probes, stamps, rows on each side of the cut, share of positives."""
    split = temporal_split(frame, "as_of", cutoff)
    return split.agg(
        F.count(F.lit(1)).alias("n_probes"),
        F.count_distinct("as_of").alias("n_stamps"),
        F.count_if(F.col("side") == "train").alias("n_train"),
        F.count_if(F.col("side") == "score").alias("n_score"),
        F.round(F.avg("label"), 6).alias("positive_rate"),
    )
