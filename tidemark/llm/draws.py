"""Bounded draws of labelled rows, the same on every run, for fitting small models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import few
from tidemark.session import written

SPACE = 1 << 30


def balanced_sample(labelled: DataFrame, key: str, label: str, rows: int) -> DataFrame:
    """About ``rows`` rows in all, classes as even as their sizes allow; never more than twice.

    A class keeps the rows whose hash lies under its share; the class counts, one row a class,
    are the only thing that leaves the aggregate. They are broadcast where they are few, so
    that the rows themselves are not shuffled. Null labels are left out.
    """
    known = labelled.filter(F.col(label).isNotNull())
    counts = known.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    classes = counts.count()
    share = F.least(F.lit(1.0), F.lit(rows / max(classes, 1)) / F.col("_n"))
    shares = few(counts.select(F.col(label).alias("_label"), (share * SPACE).cast("long").alias("_share")))
    drawn = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(SPACE))
    return (
        known.join(shares, F.col(label) == F.col("_label"))
        .filter(drawn < F.col("_share"))
        .drop("_label", "_share")
        .limit(2 * rows)
    )


def labelled_draw(docs: DataFrame, labels: DataFrame, key: str, label: str, rows: int) -> DataFrame:
    """``docs`` with ``label`` for a balanced draw of ``labels``: at most ``2 · rows`` rows.

    The draw is made among the labels alone; its keys, bounded as the draw is, are broadcast to
    the documents, of which only those rows move.
    """
    pairs = labels.select(key, label).filter(F.col(key).isNotNull()).distinct()
    drawn = balanced_sample(written(pairs, "labels"), key, label, rows)
    return docs.join(F.broadcast(written(drawn, "drawn")), key).limit(2 * rows)


def remainder(key: str, divisor: int):
    """crc32 of the key as text, modulo ``divisor``."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))
