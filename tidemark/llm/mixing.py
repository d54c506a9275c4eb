"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Shares of the total go to the sources by weight. A source whose share exceeds ``epochs``
times its size is clamped there, and what it leaves is shared again by weight, until no
source is above its cap. Every row is then taken a whole number of times, and once more if
its seeded hash lies under the cut of its source and size class. The cuts come from one
histogram of hash prefixes by size class: rows are never sorted, ranked or gathered.

Size classes are cut from the largest down. What a class leaves over or takes too much, because
its rows are long, the next smaller one makes up, so a source ends within about half a row, or
a hash cell, of its smallest class from its target. Every class gives about the same share of
its rows, as long as the smaller ones can make up for it.

Nulls: a null source is a source of its own; a null size counts as 0. Sources of size 0 have
target 0 and their rows are taken no time. Repeated rows share their hash and are taken
alike. An empty table gives an empty result. Extra columns stay with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.hashing import seeded_hash
from tidemark.llm.common import WORD, empty_if_null, stored
from tidemark.operators.ordering import few, ordered_positions

# Hash bits that tell the cells of a histogram apart.
CELL_BITS = 12


def word_size(text: Column) -> Column:
    return F.regexp_count(empty_if_null(text), F.lit(WORD)).cast("long")


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1, 2, … repeating over the sources by code point, null last."""
    order = [F.col("source").asc_nulls_last()]
    placed = ordered_positions(sources, [], order, position="place")
    return placed.withColumn("weight", ((F.col("place") - 1) % cycle + 1).cast("long")).drop("place")


def water_fill(sources: DataFrame, epochs: int = 3) -> DataFrame:
    """Add ``target`` to rows of ``source``, ``source_size`` and ``weight``, one per source.

    The total of sizes is shared out whole. Each round is one aggregate of the sources, and
    only its few sums reach the driver; a round clamps one source at least or is the last.
    """
    filled = stored(
        sources.withColumn("cap", F.col("source_size") * epochs).withColumn("clamped", F.lit(False)),
        "sources",
    )
    total = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level: tuple[int, int] | None = None  # clamped under: cap * free < left * weight
    left, free, fixed = total, 0, -1
    while True:
        over = F.lit(False)
        if level is not None:
            over = F.col("cap").cast("decimal(38,0)") * F.lit(level[1]) < F.lit(level[0]).cast(
                "decimal(38,0)"
            ) * F.col("weight")
        filled = filled.withColumn("clamped", F.col("clamped") | over)
        sums = filled.agg(
            F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0)).alias("caps"),
            F.sum(F.when(F.col("clamped"), 0).otherwise(F.col("weight"))).alias("free"),
            F.count_if("clamped").alias("fixed"),
        ).first()
        if sums.fixed == fixed:
            break
        left, free, fixed = total - (sums.caps or 0), sums.free or 0, sums.fixed
        level = (left, free)
    share = F.lit(float(left)) * F.col("weight") / F.lit(float(max(free, 1)))
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(share)
    return filled.withColumn("target", target).drop("cap", "clamped")


def _class(size: Column) -> Column:
    """Sizes by their number of binary digits: rows of a class differ by less than a factor of two."""
    return F.length(F.bin(size))


def plan_of(rows: DataFrame, targets: DataFrame, seed: int | str) -> DataFrame:
    """Per source: size, target, whole repetitions, and up to which hash cell each class is taken once more.

    ``rows`` have ``key``, ``source`` and ``size``. They are read once, into at most 2^12 cells
    for each of 63 classes of a source, whatever their number. The classes of one source are
    then gone through in one row: each takes the prefix of its cells that comes nearest to its
    share and what larger classes have left over, within what smaller ones can still make up.
    """
    times = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    facts = targets.select(
        F.struct("source").alias("_source"), "source_size", "target", F.floor(times).cast("long").alias("_whole")
    )
    cells = (
        rows.filter("size > 0")
        .groupBy(F.struct("source").alias("_source"), _class(F.col("size")).alias("class"), _cell(F.col("key"), seed).alias("cell"))
        .agg(F.sum("size").alias("words"))
    )
    upto = F.sum("words").over(W.partitionBy("_source", "class").orderBy("cell").rowsBetween(W.unboundedPreceding, 0))
    classes = (
        cells.withColumn("upto", upto)
        .groupBy("_source", "class")
        .agg(F.sum("words").alias("words"), F.array_sort(F.collect_list(F.struct("cell", "upto"))).alias("cells"))
        .groupBy("_source")
        .agg(F.sort_array(F.collect_list(F.struct("class", "words", "cells")), asc=False).alias("classes"))
    )
    held = facts.join(classes, "_source", "left").withColumn("_part", F.col("target") - F.col("_whole") * F.col("source_size"))
    part, size = F.col("_part"), F.col("source_size")

    def take(state: Column, one: Column) -> Column:
        seen = state["seen"] + one["words"]
        want = part * seen / size - state["taken"]
        # What must be left to the smaller classes, and what they can hold.
        high = part - state["taken"]
        low = high - (size - seen)
        nothing = F.array(F.struct(F.lit(-1).alias("cell"), F.lit(0).cast("long").alias("upto")))
        best = F.array_min(
            F.transform(
                F.concat(nothing, one["cells"]),
                lambda c: F.struct(
                    F.greatest(low - c["upto"], c["upto"] - high, F.lit(0.0)).alias("beyond"),
                    F.abs(c["upto"] - want).alias("off"),
                    c["cell"].alias("cell"),
                    c["upto"].alias("upto"),
                ),
            )
        )
        cut = F.struct(one["class"].alias("class"), best["cell"].alias("cell"))
        return F.struct(
            (state["taken"] + best["upto"]).alias("taken"), seen.alias("seen"), F.array_append(state["cuts"], cut).alias("cuts")
        )

    none = F.expr("CAST(array() AS ARRAY<STRUCT<class: INT, cell: INT>>)")
    start = F.struct(F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("seen"), none.alias("cuts"))
    cuts = F.when(F.col("classes").isNotNull(), F.aggregate("classes", start, take)["cuts"])
    return few(held.select("_source", "source_size", "target", "_whole", F.coalesce(cuts, none).alias("_cuts")))


def drawn(key: Column, seed: int | str) -> Column:
    return seeded_hash(seed, F.coalesce(key.cast("string"), F.lit("")))


def _cell(key: Column, seed: int | str) -> Column:
    """The leading bits of a row's hash, which the histograms tell apart."""
    return F.shiftright(drawn(key, seed), 32 - CELL_BITS).cast("int")


def taken(rows: DataFrame, plan: DataFrame, seed: int | str) -> DataFrame:
    """``rows`` with ``source_size``, ``target`` and ``copies``; the plan has one row a source."""
    marked = rows.withColumns({"_source": F.struct("source"), "_class": _class(F.col("size")), "_cell": _cell(F.col("key"), seed)})
    marked = marked.join(plan, "_source", "left")
    extra = F.exists("_cuts", lambda c: (c["class"] == F.col("_class")) & (c["cell"] >= F.col("_cell")))
    copies = F.when(F.col("size") > 0, F.coalesce("_whole", F.lit(0)) + F.coalesce(extra, F.lit(False)).cast("long")).otherwise(0)
    return marked.withColumn("copies", copies.cast("long")).drop("_source", "_class", "_cell", "_whole", "_cuts")


def source_targets(rows: DataFrame, epochs: int = 3) -> DataFrame:
    sizes = rows.groupBy("source").agg(F.sum(F.coalesce("size", F.lit(0))).alias("source_size"))
    return water_fill(cyclic_weights(sizes), epochs)


def mixture(docs: DataFrame, epochs: int = 3, seed: int | str = 1) -> DataFrame:
    """The plan of a mix: ``key``, ``source``, ``size``, ``source_size``, ``target``, ``copies``."""
    rows = stored(
        docs.select(
            F.col("doc_id").alias("key"), "source", word_size(F.col("text")).alias("size")
        ),
        "sizes",
    )
    return taken(rows, plan_of(rows, source_targets(rows, epochs), seed), seed)


def mixed(docs: DataFrame, epochs: int = 3, seed: int | str = 1) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with their own columns."""
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"))
    sized = held.select(
        "row",
        F.col("row.doc_id").alias("key"),
        F.col("row.source").alias("source"),
        word_size(F.col("row.text")).alias("size"),
    )
    rows = stored(sized.select("key", "source", "size"), "sizes")
    plan = plan_of(rows, source_targets(rows, epochs), seed)
    often = taken(sized, plan, seed).filter("copies > 0")
    return often.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
