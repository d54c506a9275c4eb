"""Credits matched to the orders they reverse, under remaining capacity.

Within (account, sku, unit price) every credit, in document order, reverses the latest
strictly earlier order line that still has enough quantity left, and uses that quantity up.
A credit no single line can hold stays unmatched.

Any match inside a contiguous piece of a key's history beats every match before the piece,
so pieces fold independently and only unmatched credits look further back. Candidates are
range-partitioned by (key, time): a large key spreads over many partitions, each of bounded
size. Credits left over in a key that spans partitions then visit earlier pieces in a tree:
neighbouring segments of pieces merge pairwise, in as many rounds as the number of pieces has
binary digits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ledger import with_credit_flag
from tidemark.operators.ordering import group_starts, lay_out, piece_of, running_max
from tidemark.functions.keys import price_cents
from tidemark.functions.timeutil import wall_from_micros, wall_micros
from tidemark.session import written

KEY = ["customer_id", "StockCode", "price_cents"]
_ORDER, _CREDIT, _MATCH = 0, 1, 2


class OpenLines:
    """Order lines of one key that still have quantity; finds the latest that fits."""

    width = 64

    def __init__(self) -> None:
        self.at: list[int] = []
        self.left: list[int] = []
        self.pos: list[int] = []
        self.peak: list[int] = []  # most quantity left in each run of ``width`` lines

    def add(self, at: int, quantity: int, pos: int) -> None:
        if len(self.at) % self.width == 0:
            self.peak.append(0)
        self.at.append(at)
        self.left.append(quantity)
        self.pos.append(pos)
        self.peak[-1] = max(self.peak[-1], quantity)

    def take(self, before: int, need: int) -> int | None:
        for run in range(len(self.peak) - 1, -1, -1):
            if self.peak[run] < need:
                continue
            start = run * self.width
            stop = min(start + self.width, len(self.at))
            for i in range(stop - 1, start - 1, -1):
                if self.left[i] >= need and self.at[i] < before:
                    self.left[i] -= need
                    self.peak[run] = max(self.left[start:stop])
                    return i
        return None


def _fold_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Match credits inside one sorted partition; emit them and the edge keys' open lines."""
    key, last, lines, begun, first_key, schema = None, None, OpenLines(), False, True, None

    def open_rows() -> pa.RecordBatch:
        kept = [i for i, left in enumerate(lines.left) if left > 0]
        known = {
            **{name: [part] * len(kept) for name, part in zip(KEY, key)},
            "_kind": [_ORDER] * len(kept),
            "_time": [lines.at[i] for i in kept],
            "_amount": [lines.left[i] for i in kept],
            "_at": [lines.pos[i] for i in kept],
        }
        columns = [
            pa.array(known[f.name], f.type) if f.name in known else pa.nulls(len(kept), f.type)
            for f in schema
        ]
        columns += [pa.nulls(len(kept), pa.int64())] * 2
        return pa.RecordBatch.from_arrays(columns, [*schema.names, "_match_at", "_match_time"])

    def key_of(batch: pa.RecordBatch, row: int) -> list:
        return [batch.column(n)[row].as_py() for n in KEY]

    for batch in batches:
        if not batch.num_rows:
            continue
        schema = batch.schema
        starts = group_starts(batch, KEY, last)
        key, last = key or key_of(batch, 0), key_of(batch, batch.num_rows - 1)
        kinds = batch.column("_kind").to_numpy(zero_copy_only=False)
        numbers = [batch.column(n).to_numpy(zero_copy_only=False).tolist() for n in ("_time", "_amount", "_at")]
        found_at: list[int | None] = []
        found_time: list[int | None] = []
        for begins, kind, time, amount, at in zip(starts.tolist(), kinds.tolist(), *numbers):
            if begins:
                if begun and first_key:
                    yield open_rows()
                    first_key = False
                begun, lines = True, OpenLines()
            if kind == _ORDER:
                lines.add(time, amount, at)
                continue
            hit = lines.take(time, amount)
            found_at.append(None if hit is None else lines.pos[hit])
            found_time.append(None if hit is None else lines.at[hit])
        credits = batch.filter(pa.array(kinds == _CREDIT))
        columns = [*credits.columns, pa.array(found_at, pa.int64()), pa.array(found_time, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, [*schema.names, "_match_at", "_match_time"])
    if begun:
        key = last
        yield open_rows()


_STATE = [*KEY, "_idx", "_kind", "_time", "_amount", "_at", "_match_at", "_match_time"]


def _merge_halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Left-over credits of each right half visit the open lines of its left half.

    A node's credits come first, in order, then its lines, latest piece first. A task holds the
    credits that are still without a line and the lines of one piece.
    """
    node, piece, credits, lines = None, None, [], OpenLines()
    out: list[tuple] = []

    def visit() -> None:
        """The piece just read: each waiting credit takes its turn, what is left stays open."""
        nonlocal credits, lines
        rest = []
        for credit in credits:
            time, need, at, idx = credit
            hit = lines.take(time, need)
            if hit is None:
                rest.append(credit)
            else:
                out.append((*node[:-1], idx, _MATCH, time, need, at, lines.pos[hit], lines.at[hit]))
        credits = rest
        for at, left, pos in zip(lines.at, lines.left, lines.pos):
            if left > 0:
                out.append((*node[:-1], piece, _ORDER, at, left, pos, None, None))
        lines = OpenLines()

    def leave() -> None:
        if node is not None:
            visit()
            out.extend((*node[:-1], idx, _CREDIT, time, need, at, None, None) for time, need, at, idx in credits)

    def emitted(schema: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array(values, f.type) for values, f in zip(zip(*out), schema)] if out else []
        out.clear()
        return pa.RecordBatch.from_arrays(columns, _STATE) if columns else schema.empty_table().to_batches()[0]

    schema = None
    for batch in batches:
        schema = pa.schema([batch.schema.field(n) for n in _STATE])
        column = [batch.column(n).to_pylist() for n in [*KEY, "_node", "_idx", "_kind", "_time", "_amount", "_at"]]
        for *now, idx, kind, time, amount, at in zip(*column):
            if now != node:
                leave()
                node, piece, credits, lines = now, None, [], OpenLines()
            if kind == _CREDIT:
                credits.append((time, amount, at, idx))
                continue
            if idx != piece:
                visit()
                piece = idx
            lines.add(time, amount, at)
        if out:
            yield emitted(schema)
    leave()
    if out:
        yield emitted(schema)


def _merge_round(state: DataFrame, level: int) -> DataFrame:
    """Pairs of segments of ``2^level`` pieces become one segment each."""
    side = F.shiftright("_idx", level).bitwiseAND(1)
    takes_part = ((F.col("_kind") == _ORDER) & (side == 0)) | ((F.col("_kind") == _CREDIT) & (side == 1))
    turn = F.when(F.col("_kind") == _ORDER, -F.col("_idx"))
    nodes = state.filter(takes_part).withColumn("_node", F.shiftright("_idx", level + 1))
    laid = nodes.repartition(*KEY, "_node").sortWithinPartitions(
        *KEY, "_node", F.col("_kind").desc(), turn, F.col("_at")
    )
    merged = laid.mapInArrow(_merge_halves, state.schema)
    return written(state.filter(~takes_part).unionByName(merged), "attribution")


def _match_across_pieces(folded: DataFrame) -> DataFrame | None:
    """Matches (``credit_at``, ``line_time``) of credits whose key began in an earlier piece.

    Pieces of a key merge pairwise, so their number is halved each round. A credit prefers its
    own half, which has been settled before, and a line meets the credits of its own half first:
    both orders are those of one pass over the whole key. None if no credit can match.
    """
    opened = folded.filter(F.col("_kind") == _ORDER).withColumn("_idx", piece_of(F.col("_at")))
    # Only the first and last key of a partition emit open lines, so this table has two rows a
    # partition at most and not more with more data.
    keys = opened.groupBy(*KEY).agg(F.min("_idx").alias("_first"), F.max("_amount").alias("_peak"))
    keys = F.broadcast(written(keys, "piece-keys"))
    waiting = (
        folded.filter((F.col("_kind") == _CREDIT) & F.col("_match_at").isNull())
        .withColumn("_idx", piece_of(F.col("_at")))
        .join(keys, KEY)
        .filter((F.col("_idx") > F.col("_first")) & (F.col("_amount") <= F.col("_peak")))
    )
    opened = opened.join(keys, KEY)
    within = lambda df: df.withColumn("_idx", (F.col("_idx") - F.col("_first")).cast("int")).select(_STATE)
    waiting = written(within(waiting), "waiting")
    last, smallest = waiting.agg(F.max("_idx"), F.min("_amount")).first()
    if last is None:
        return None
    # No line before the last waiting credit that could hold any of them is left out.
    usable = within(opened).filter((F.col("_idx") < last) & (F.col("_amount") >= smallest))
    state = waiting.unionByName(usable)
    for level in range(last.bit_length()):
        state = _merge_round(state, level)
    return state.filter(F.col("_kind") == _MATCH).select(
        F.col("_at").alias("credit_at"), F.col("_match_time").alias("line_time")
    )


def _source_order(tx: DataFrame, order: Sequence[str] | None) -> list[str]:
    if order is not None:
        return list(order)
    if "line_no" not in tx.columns:
        raise ValueError("declare line_no, or pass the columns that give the source order")
    return ["line_no"]


def credit_attribution(
    tx: DataFrame, order: Sequence[str] | None = None, partitions: int | None = None
) -> DataFrame:
    """``tx`` with ``eff_date``: own date for orders, the reversed order's date for credits.

    Orders never move: they bypass the matching. Unmatched credits get a null date.
    """
    order = _source_order(tx, order)
    tx = with_credit_flag(tx)
    columns = tx.columns
    cents = price_cents(F.col("Price"))
    own = tx.filter(~F.col("is_credit")).withColumn("eff_date", F.col("InvoiceDate"))

    credits = tx.filter(F.col("is_credit")).withColumn("price_cents", cents)
    complete = F.lit(True)
    for name in [*KEY, "InvoiceDate", "Quantity"]:
        complete = complete & F.col(name).isNotNull()
    matchable = complete & (F.col("Quantity") < 0)
    lost = (
        credits.filter(~matchable)
        .select(*columns)
        .withColumn("eff_date", F.lit(None).cast("timestamp_ntz"))
    )
    credits = credits.filter(matchable)

    def candidate(df: DataFrame, kind: int, payload: list[Column]) -> DataFrame:
        return df.select(
            *KEY,
            F.lit(kind).alias("_kind"),
            wall_micros(F.col("InvoiceDate")).alias("_time"),
            F.abs(F.col("Quantity")).cast("long").alias("_amount"),
            *[c for c in dict.fromkeys(order) if c not in KEY],
            *payload,
        )

    rest = [c for c in columns if c not in KEY and c not in order]
    types = tx.schema
    supply = (
        tx.filter(~F.col("is_credit") & (F.col("Quantity") > 0) & F.col("InvoiceDate").isNotNull())
        .withColumn("price_cents", cents)
        .join(credits.select(*KEY).distinct(), KEY, "left_semi")
    )
    pool = candidate(credits, _CREDIT, [F.col(c) for c in rest]).unionByName(
        candidate(supply, _ORDER, [F.lit(None).cast(types[c].dataType).alias(c) for c in rest])
    )
    by = [F.col(c) for c in [*KEY, "_time", *order, "_kind"]]
    # Stored, as laying out reads it twice: for the bounds of the ranges and for the rows.
    laid = lay_out(written(pool, "pool"), by, partitions)
    schema = T.StructType(
        [
            *[T.StructField(f.name, f.dataType, True) for f in laid.schema],
            T.StructField("_match_at", T.LongType()),
            T.StructField("_match_time", T.LongType()),
        ]
    )
    folded = written(laid.mapInArrow(_fold_piece, schema), "folded")
    late = _match_across_pieces(folded)
    matched = folded.filter(F.col("_kind") == _CREDIT)
    time = F.col("_match_time")
    if late is not None:
        matched = matched.join(late.withColumnRenamed("credit_at", "_at"), "_at", "left")
        time = F.coalesce(time, F.col("line_time"))
    eff = wall_from_micros(time)
    matched = matched.withColumn("eff_date", eff).select(*columns, "eff_date")
    return own.unionByName(matched).unionByName(lost)


def latest_earlier_order(tx: DataFrame, partitions: int | None = None) -> DataFrame:
    """As-of match without capacity: ``prior_order``, date of the key's latest earlier order.

    A running maximum over the key's time line, so no pair of rows is formed. Credits sort
    before orders of the same instant, which keeps the comparison strict.
    """
    tx = with_credit_flag(tx).withColumn("price_cents", price_cents(F.col("Price")))
    is_order = ~F.col("is_credit") & (F.col("Quantity") > 0)
    by = [F.col("InvoiceDate"), is_order]
    seen = {"prior_order": F.when(is_order, F.col("InvoiceDate"))}
    return running_max(tx, KEY, by, seen, partitions).filter(F.col("is_credit"))
