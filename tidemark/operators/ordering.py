"""Positions and running sums over a group of any size.

A plain window puts a whole group into one task. Here rows are range-partitioned by
(group, order), so a large group spreads over many tasks; each task numbers or sums along its
own partition, and what the first group of a partition had before comes from a table with one
row a partition. Rows are exchanged once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import written

# Rows of a table that may be broadcast: one group and one value each.
FEW = 100_000

_AT = "_at"
_PIECE = "_piece"
# monotonically_increasing_id keeps the partition number above bit 33.
PARTITION_BITS = 33


def piece_of(at: Column) -> Column:
    return F.shiftright(at, PARTITION_BITS)


def lay_out(
    df: DataFrame, order: Sequence[Column], partitions: int | None = None, at: str = _AT
) -> DataFrame:
    """Range-partitioned and sorted rows with ``at``, a unique id that follows the order."""
    ranged = (
        df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    )
    return ranged.sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())


def _keys(df: DataFrame, group: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if group:
        return df, list(group)
    return df.withColumn("_g0", F.lit(0)), ["_g0"]


def _attach(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Left join on keys among which null equals null; keeps the left key columns."""
    right = right.withColumnsRenamed({n: f"_r_{n}" for n in names})
    same = reduce(
        lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names]
    )
    return left.join(right, same, "left").drop(*[f"_r_{n}" for n in names])


def few(df: DataFrame, limit: int = FEW) -> DataFrame:
    """A stored table, to be broadcast if it has ``limit`` rows at most and joined as it is if not."""
    df = written(df, "few")
    return F.broadcast(df) if df.count() <= limit else df


def _same(a, b) -> bool:
    return a == b or (a != a and b != b)


def group_starts(batch: pa.RecordBatch, names: Sequence[str], last: list | None) -> np.ndarray:
    """Which rows begin another group than the row before; ``last`` is that of the last batch."""
    n = batch.num_rows
    starts = np.zeros(n, dtype=bool)
    for name in names:
        codes = pc.dictionary_encode(batch.column(name), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        starts[1:] |= codes[1:] != codes[:-1]
    first = [batch.column(name)[0].as_py() for name in names]
    starts[0] = last is None or not all(map(_same, first, last))
    return starts


class _Sums:
    """Running sum per group of whole numbers; null until the first number."""

    def __init__(self) -> None:
        self.total, self.seen = 0, 0

    def run(self, values: pa.Array, starts: np.ndarray) -> pa.Array:
        known = values.is_valid().to_numpy(zero_copy_only=False)
        numbers = pc.fill_null(values, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        segment = np.cumsum(starts)
        out = []
        for part, carry in ((numbers, self.total), (known.astype(np.int64), self.seen)):
            upto = np.cumsum(part)
            # What had been added before the group began; the group of the last batch goes on.
            before = np.concatenate([[-carry], (upto - part)[starts]])[segment]
            out.append(upto - before)
        self.total, self.seen = int(out[0][-1]), int(out[1][-1])
        return pa.array(out[0], pa.int64(), mask=out[1] == 0)


class _Maxima:
    """Running maximum per group of numbers, dates or times; null until the first value."""

    def __init__(self) -> None:
        self.value = None

    def run(self, values: pa.Array, starts: np.ndarray) -> pa.Array:
        carry = pa.array([self.value], values.type)
        whole = pa.concat_arrays([carry, values])
        distinct = pc.unique(whole).drop_null()
        distinct = distinct.take(pc.sort_indices(distinct))
        rank = pc.index_in(whole, distinct)
        rank = pc.fill_null(pc.add(rank, 1), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        # The segment counts more than any rank, so a maximum never passes on to the next group.
        segment = np.concatenate([[0], np.cumsum(starts)])
        width = len(distinct) + 1
        best = np.maximum.accumulate(segment * width + rank)[1:] - segment[1:] * width
        found = distinct.take(pa.array(np.maximum(best - 1, 0), mask=best == 0))
        self.value = found[-1].as_py()
        return found


_KINDS = {"sum": (_Sums, F.sum), "max": (_Maxima, F.max)}


def _scanned(
    df: DataFrame,
    names: Sequence[str],
    order: Sequence[Column],
    values: dict[str, str],
    partitions: int | None,
    totals: dict[str, str],
) -> DataFrame:
    """Running ``values`` (column: kind) per group, from one range exchange of the rows.

    Each task runs along its sorted partition. Only a group that began in an earlier partition
    lacks something: the first of its partition. What it lacks, one row a partition, is added
    by partition number.
    """
    laid = lay_out(df, [*[F.col(n) for n in names], *order], partitions)
    into = {v: f"_in_{v}" for v in values}
    schema = T.StructType(list(laid.schema.fields))
    for v in values:
        schema = schema.add(into[v], laid.schema[v].dataType)
    schema = schema.add("_opens", T.BooleanType())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = {v: _KINDS[kind][0]() for v, kind in values.items()}
        last, opening = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = group_starts(batch, names, last)
            begun = starts.copy()
            begun[0] = begun[0] and last is not None
            opens = np.cumsum(begun) == 0 if opening else np.zeros(batch.num_rows, dtype=bool)
            opening = bool(opens[-1])
            last = [batch.column(name)[batch.num_rows - 1].as_py() for name in names]
            columns = [*batch.columns, *[runs[v].run(batch.column(v), starts) for v in values], pa.array(opens)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    rows = written(laid.mapInArrow(scan, schema), "scanned").withColumn(_PIECE, piece_of(F.col(_AT)))
    held = F.struct(*[F.col(n).alias(f"_k{i}") for i, n in enumerate(names)], *[F.col(c) for c in into.values()])
    ends = rows.groupBy(_PIECE).agg(F.max_by(held, _AT).alias("_e"), F.min_by(held, _AT).alias("_b"))
    keys = [f"_k{i}" for i in range(len(names))]
    gives = ends.select(_PIECE, F.lit(False).alias("_asks"), "_e.*")
    asks = ends.select(_PIECE, F.lit(True).alias("_asks"), "_b.*")
    earlier = W.partitionBy(*keys).orderBy(_PIECE).rangeBetween(W.unboundedPreceding, -1)
    given = lambda v: F.when(~F.col("_asks"), F.col(into[v]))
    events = gives.unionByName(asks)
    for v, kind in values.items():
        events = events.withColumn(f"_before_{v}", _KINDS[kind][1](given(v)).over(earlier))
    offsets = events.filter("_asks").select(_PIECE, *[f"_before_{v}" for v in values])
    # One row a partition.
    out = rows.join(F.broadcast(offsets.withColumnRenamed(_PIECE, "_offset_of")), F.col(_PIECE) == F.col("_offset_of"), "left")
    for v, kind in values.items():
        before = F.when(F.col("_opens"), F.col(f"_before_{v}"))
        if kind == "sum":
            whole = F.coalesce(F.col(into[v]) + before, F.col(into[v]), before)
        else:
            whole = F.greatest(F.col(into[v]), before)
        out = out.withColumn(v, whole)
    out = out.drop("_opens", "_offset_of", *into.values(), *[f"_before_{v}" for v in values])
    if totals:
        sums = rows.groupBy(*names).agg(*[_KINDS[values[v]][1](v).alias(t) for v, t in totals.items()])
        out = _attach(out, few(sums), names)
    return out.drop("_g0", _AT, _PIECE)


def ordered_positions(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    position: str = "position",
    size: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """1-based place of every row inside its group; optionally the group size as well.

    Without groups the places are those in the sorted partitions, counted by the engine itself.
    """
    if not group:
        rows = written(lay_out(df, order, partitions), "placed").withColumn(_PIECE, piece_of(F.col(_AT)))
        pieces = rows.groupBy(F.col(_PIECE).alias("_of")).agg(F.count(F.lit(1)).alias("_rows"))
        # One row a partition.
        whole = W.partitionBy(F.lit(0))
        earlier = whole.orderBy("_of").rowsBetween(W.unboundedPreceding, -1)
        pieces = pieces.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        pieces = pieces.withColumn("_whole", F.sum("_rows").over(whole)).drop("_rows")
        out = rows.join(F.broadcast(pieces), F.col(_PIECE) == F.col("_of"))
        inside = F.col(_AT).bitwiseAND((1 << PARTITION_BITS) - 1)
        out = out.withColumn(position, inside + 1 + F.col("_before"))
        out = out.withColumn(size, F.col("_whole")) if size else out
        return out.drop(_AT, _PIECE, "_of", "_before", "_whole")
    ones = {position: F.lit(1).cast("long")}
    return running_sums(df, group, order, ones, {position: size} if size else None, partitions)


def running_sums(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, Column],
    totals: dict[str, str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Inclusive running sums of whole numbers per group; ``totals`` names their group totals."""
    df, names = _keys(df, group)
    whole = {v: value.cast("long") for v, value in sums.items()}
    return _scanned(df.withColumns(whole), names, order, dict.fromkeys(sums, "sum"), partitions, totals or {})


def running_max(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    values: dict[str, Column],
    partitions: int | None = None,
) -> DataFrame:
    """Inclusive running maxima per group of numbers, dates or times; nulls are skipped."""
    df, names = _keys(df, group)
    return _scanned(df.withColumns(values), names, order, dict.fromkeys(values, "max"), partitions, {})


def exact_median(df: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """Median per group from a histogram of values, mean of the two middle ones when even."""
    rows = df.filter(F.col(value).isNotNull())
    counts = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sums(counts, group, [F.col(value)], {"_upto": F.col("_n")}, {"_upto": "_all"})
    low = F.floor((F.col("_all") + 1) / 2)
    high = F.floor(F.col("_all") / 2) + 1
    holds = lambda k: (F.col("_upto") - F.col("_n") < k) & (k <= F.col("_upto"))
    middle = ranked.filter(holds(low) | holds(high))
    pick = lambda k: F.max(F.when(holds(k), F.col(value)))
    return middle.groupBy(*group).agg(((pick(low) + pick(high)) / 2).alias(name))


def _ending(cells: DataFrame, names: Sequence[str], by: str, quota: str) -> DataFrame:
    """The cell in which each group's ``quota`` ends, with what is ``_left`` of it there."""
    upto = W.partitionBy(*names).orderBy(by).rowsBetween(W.unboundedPreceding, 0)
    placed = cells.withColumn("_upto", F.sum("_n").over(upto))
    left = F.col(quota) - (F.col("_upto") - F.col("_n"))
    return placed.filter((left > 0) & (F.col("_upto") >= F.col(quota))).select(*names, by, left.alias("_left"))


def hash_cut(
    df: DataFrame, group: Sequence[str], hashed: Column, tie: Column, fraction: float, flag: str
) -> DataFrame:
    """Mark exactly ``floor(fraction · n + 1/2)`` rows per group, those lowest by hash.

    ``hashed`` is a uniform 32-bit value and ``tie`` a unique column. The value at which the
    quota ends is read off grouped counts of its first 12, next 12 and last 8 bits, and of the
    ties at that value. After the first count only the rows of one cell in 4096 are looked at.
    The rows themselves are compared with one cut a group and never shuffled.
    """
    df, names = _keys(df, group)
    df = df.withColumn("_hash", hashed)
    bits = lambda shift, mask: F.shiftright("_hash", shift).bitwiseAND(mask)
    count = F.count(F.lit(1)).alias("_n")
    thin = df.select(*names, "_hash", tie.alias("_tie"))
    first = thin.groupBy(*names, F.shiftright("_hash", 20).alias("_cell")).agg(count)
    share = F.floor(F.sum("_n").over(W.partitionBy(*names)) * F.lit(fraction) + 0.5)
    ending = few(_ending(first.withColumn("_quota", share), names, "_cell", "_quota"))
    within = _attach(thin, ending, names).filter(F.shiftright("_hash", 20) == F.col("_cell")).drop("_cell")
    within = written(within, "cut-cells")
    for cell in (bits(8, 4095), bits(0, 255), F.col("_tie")):
        cells = within.groupBy(*names, "_left", cell.alias("_cell")).agg(count)
        ending = few(_ending(cells.withColumnRenamed("_left", "_quota"), names, "_cell", "_quota"))
        last = _attach(within.drop("_left"), ending, names).filter(cell == F.col("_cell"))
        within = last.drop("_cell")
    cuts = within.groupBy(*names).agg(F.max(F.struct("_hash", "_tie")).alias("_cut"))
    marked = _attach(df, few(cuts), names).withColumn(
        flag,
        F.coalesce(F.struct(F.col("_hash"), tie.alias("_tie")) <= F.col("_cut"), F.lit(False)),
    )
    return marked.drop("_g0", "_hash", "_cut")


def _as_number(value: Column, kind: T.DataType) -> Column:
    """A double that never decreases along the ascending order of ``value``, nulls first."""
    if isinstance(kind, T.StringType):
        head = F.rpad(F.hex(F.substring(F.encode(value, "UTF-8"), 1, 6)), 12, "0")
        number = F.conv(head, 16, 10).cast("double")
    elif isinstance(kind, T.TimestampType):
        number = F.unix_micros(value).cast("double")
    elif isinstance(kind, T.TimestampNTZType):
        number = F.unix_micros(value.cast("timestamp")).cast("double")
    elif isinstance(kind, T.DateType):
        number = F.unix_date(value).cast("double")
    else:
        number = value.cast("double")
        number = F.when(F.isnan(number), 1e300).otherwise(F.greatest(F.least(number, F.lit(1e299)), F.lit(-1e299)))
    return F.when(value.isNull(), F.lit(-1e300)).otherwise(number)


CELLS = 4096
# Rows a group may have in the last cell; they are put in order.
LAST_CELL = 10_000


def nth_rows(df: DataFrame, group: Sequence[str], order: Sequence[str], place: Column, size: str = "_size") -> DataFrame:
    """The row at 1-based ``place`` of each group in ascending ``order``; ``place`` may use ``size``.

    Each round counts a group's rows in ``CELLS`` cells between the lowest and highest value of
    the first order column that are still possible and keeps the cell that holds the place.
    Only the rows of the last cell are sorted. Columns in ``place`` are the same for a whole
    group.
    """
    df, names = _keys(df, group)
    rows = df.withColumn("_code", _as_number(F.col(order[0]), df.schema[order[0]].dataType))
    code, low, high = F.col("_code"), F.col("_low"), F.col("_high")
    ends = [F.min(code).alias("_low"), F.max(code).alias("_high")]
    counts = rows.groupBy(*names).agg(F.count(F.lit(1)).alias(size), *ends)
    # The place is that of any row of the group.
    placed = _attach(rows.drop(size), few(counts.select(*names, size)), names).withColumn("_place", place)
    wanted = placed.groupBy(*names).agg(F.max("_place").alias("_left"), F.max(size).alias("_n"))
    state = few(_attach(counts.drop(size), wanted, names))
    cell = F.when(high > low, F.least(F.lit(CELLS - 1), F.floor((code - low) / (high - low) * CELLS))).otherwise(0)
    possible = rows
    while not state.filter((F.col("_n") > LAST_CELL) & (high > low)).isEmpty():
        met = _attach(possible.select(*names, "_code"), state, names).filter(code.between(low, high))
        cells = met.groupBy(*names, F.col("_left").alias("_quota"), cell.alias("_cell"))
        cells = cells.agg(F.count(F.lit(1)).alias("_n"), *ends)
        upto = W.partitionBy(*names).orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)
        left = F.col("_quota") - (F.col("_upto") - F.col("_n"))
        ending = cells.withColumn("_upto", F.sum("_n").over(upto)).filter((left > 0) & (F.col("_upto") >= F.col("_quota")))
        state = few(ending.select(*names, left.alias("_left"), "_n", "_low", "_high"))
    last = _attach(rows, state.select(*names, "_left", "_low", "_high"), names).filter(code.between(low, high))
    found = ordered_positions(last, names, [F.col(c) for c in order], "_at_place").filter(F.col("_at_place") == F.col("_left"))
    return found.drop("_g0", "_code", "_low", "_high", "_left", "_at_place")
