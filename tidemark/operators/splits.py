"""Seeded folds, splits and thinning that do not depend on partitioning or row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import seeded_fold, seeded_hash
from tidemark.operators.ordering import few, hash_cut, nth_rows, ordered_positions
from tidemark.session import written


def kfold(df: DataFrame, key: str, k: int, seed: int, name: str = "fold") -> DataFrame:
    """Disjoint, exhaustive row folds 0..k−1 by hash of the key."""
    return df.withColumn(name, seeded_fold(seed, k, F.col(key)))


def inner_folds(
    df: DataFrame, key: str, k: int, seed: int, outer: str = "fold", name: str = "inner_fold"
) -> DataFrame:
    """Folds inside each outer training set: the outer fold salts the hash."""
    return df.withColumn(name, seeded_fold(seed, k, F.col(outer), F.col(key)))


def _side(df: DataFrame, flag: str) -> DataFrame:
    return df.withColumn("side", F.when(F.col(flag), "test").otherwise("train")).drop(flag)


def stratified_split(
    df: DataFrame, label: str, key: str, test_size: float, seed: int
) -> DataFrame:
    """``side`` with the same share of every class in the test part."""
    hashed = seeded_hash(seed, F.col(key))
    return _side(hash_cut(df, [label], hashed, F.col(key), test_size, "_cut_in"), "_cut_in")


def random_split(df: DataFrame, key: str, test_size: float, seed: int) -> DataFrame:
    """``side`` by a permutation cut that ignores time; a baseline, it leaks the future."""
    hashed = seeded_hash(seed, F.col(key))
    return _side(hash_cut(df, [], hashed, F.col(key), test_size, "_cut_in"), "_cut_in")


def group_split(df: DataFrame, group: str, test_size: float, seed: int) -> DataFrame:
    """``side`` with every group whole on one side; rows of few groups are not dealt out by group."""
    groups = df.select(group).distinct()
    hashed = seeded_hash(seed, F.col(group))
    sides = _side(hash_cut(groups, [], hashed, F.col(group), test_size, "_cut_in"), "_cut_in")
    return df.join(few(sides), group)


def temporal_split(df: DataFrame, column: str, cutoff: str) -> DataFrame:
    """``side``: everything fitted lies before the cutoff, everything scored at or after it."""
    at = F.lit(cutoff).cast("timestamp_ntz")
    return df.withColumn("side", F.when(F.col(column) < at, "train").otherwise("score"))


def positional_split(
    df: DataFrame, order: list[Column], fraction: float, partitions: int | None = None
) -> DataFrame:
    """``side``: the first share of rows in the declared order trains.

    Rows are read twice, for the bounds of the ranges and for the rows, so they are stored first.
    """
    placed = ordered_positions(written(df, "unplaced"), [], order, "_place", "_size", partitions)
    cut = F.floor(F.col("_size") * fraction)
    side = F.when(F.col("_place") <= cut, "train").otherwise("score")
    return placed.withColumn("side", side).drop("_place", "_size")


def rebalance_negatives(
    df: DataFrame, label: str, key: str, keep: float = 0.35, seed: int = 0
) -> DataFrame:
    """All positives and an exact, seeded share of the negatives."""
    hashed = seeded_hash(seed, F.col(key))
    marked = hash_cut(df, [label], hashed, F.col(key), keep, "_kept")
    return marked.filter((F.col(label) != 0) | F.col("_kept")).drop("_kept")


def seeded_pick(
    df: DataFrame, group: str, index: str, order: Sequence[str], seed: int
) -> DataFrame:
    """One row per group: the row at ``(seed + group index) mod group size`` in ascending order."""
    place = F.pmod(F.lit(seed) + F.col(index), F.col("_size")) + 1
    return nth_rows(df, [group], order, place)
