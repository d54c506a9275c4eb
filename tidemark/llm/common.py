"""Helpers of the corpus operators: task state, batch bounds and word patterns.

All operators take the columns they name and ignore every other column, so extra columns of
any name are harmless.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path

# Words of the contracts: runs without blank, tab, line feed, vertical tab, form feed, return.
WORD = "[^\\x20\\x09-\\x0D]+"

# Marks of identifiers: 16 bits for each, in bitmaps of 2^15 bits (4 KB), of which 4 MB are sent at most.
MARK_BITS = 16
MARK_BITMAPS = 1024


def bounded_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of few rows: a batch of long texts stays within a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def share(df: DataFrame, state: dict):
    """Send ``state``, of a size bounded by a vocabulary or a model, to every worker."""
    return df.sparkSession.sparkContext.broadcast(state)


def kept(state: dict, name: str, build):
    """A part built once per worker process; it lives as long as the shared state does."""
    value = state.get(name)
    if value is None:
        value = state[name] = build(state)
    return value


class Remembered(dict):
    """Results per key in two generations of ``limit`` keys: bounded, and frequent keys stay."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: computed once, survives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def marked(df: DataFrame, key: str, ids: DataFrame, name: str) -> DataFrame:
    """``df`` with a boolean ``name``: false where ``key`` is certainly not in the one column of ``ids``.

    True may be wrong (for 1 in 16, more only beyond 2 million identifiers), so an exact join must
    follow; it then shuffles few other rows. ``ids`` is a stored table with keys of the same type.
    """
    bitmaps = min(MARK_BITMAPS, 1 + ids.count() * MARK_BITS // 2**15)
    at, bits = fresh(df, "_bitmap"), fresh(df, "_bits")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bitmaps * 2**15))
    low = lambda c: place(c).bitwiseAND(F.lit(2**15 - 1))
    one = F.col(ids.columns[0])
    table = ids.filter(one.isNotNull()).groupBy(F.shiftright(place(one), 15).alias(at)).agg(
        F.bitmap_construct_agg(low(one)).alias(bits)
    )
    found = df.withColumn(at, F.shiftright(place(F.col(key)), 15)).join(F.broadcast(table), at, "left")
    byte = F.substring(F.col(bits), (F.shiftright(low(F.col(key)), 3) + 1).cast("int"), F.lit(1))
    bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("long"), low(F.col(key)).bitwiseAND(F.lit(7)).cast("int"))
    return found.withColumn(name, F.col(key).isNotNull() & F.coalesce(bit == 1, F.lit(False))).drop(at, bits)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    return name if name.lower() not in taken else f"{name}_{uuid.uuid4().hex}"


def empty_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
