"""Seeded, engine-independent hashes: the source of every fold, split and sample."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(seed: int | str, *keys: Column) -> Column:
    """A 32-bit value from md5 of ``seed:key[:key…]``; the same in any engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def seeded_fold(seed: int | str, folds: int, *keys: Column) -> Column:
    return F.pmod(seeded_hash(seed, *keys), F.lit(folds)).cast("int")


def seeded_folds(seed: int | str, folds: int, count: int, *keys: Column) -> Column:
    """Array of ``count`` independent fold numbers per row, four hex digits of md5 each."""
    per_hash = 8
    digests = [
        F.md5(F.concat_ws(":", F.lit(f"{seed}/{block}"), *[k.cast("string") for k in keys]))
        for block in range((count + per_hash - 1) // per_hash)
    ]
    text = F.concat(*digests)
    cut = lambda i: F.conv(F.substring(text, 4 * i + 1, 4), 16, 10).cast("int")
    return F.array(*[F.pmod(cut(i), F.lit(folds)).cast("int") for i in range(count)])
