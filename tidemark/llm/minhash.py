"""Near duplicates by bottom-k sketches of word shingles.

One hash function orders all shingles; a text's sketch is its ``k`` smallest. Inverted lists of
retained values give candidate pairs, an estimate on the union sketch filters them, and the
texts' whole shingle sets confirm each link.

Texts of equal words are one class from the start, so copies never meet each other. Of a
sketch only the rarest values enter the lists: two texts whose sketches share SHARED of their
values always meet in one of them, while values that very many texts hold stay out. At k = 64
a pair of long texts at exactly 0.8 is estimated lower with a probability of 1.3e-4, whether or
not one contains the other (38 or fewer of 64 values shared); at 0.85 with one of 6e-7.

Members of a list are first compared with one pivot each; members that this joins need no
comparison with each other any more. What a list still holds of different components is then
compared in blocks of bounded size: sketches choose the members that have a likely partner, and
of these only the texts follow; whole sets confirm pairs inside the task, and only links that join
components leave it. So the pivots decide how much is compared, not what is found, and no list is
enumerated as rows.

Texts are shuffled for members of lists only: marks of bounded size leave most others where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import Remembered, bounded_batches, marked, stored
from tidemark.llm.components import components

SKETCH = 64
SHARED = 0.6
PIVOT_ROUNDS = 1
BLOCK = 512
WORD_HASHES = 300_000

SKETCHED = "digest binary, n_shingles long, sketch array<long>"


class Shingler:
    """Distinct shingle hashes of a text: words are ASCII-lowered runs of non-blank bytes."""

    def __init__(self, width: int):
        self.width = width
        self.word = Remembered(xxhash.xxh3_64_intdigest, WORD_HASHES)

    def words(self, text: str) -> list[bytes]:
        return text.encode().lower().split()

    def hashes(self, words: list[bytes]) -> np.ndarray:
        codes = np.fromiter(map(self.word.__getitem__, words), dtype=np.uint64, count=len(words))
        span = max(1, len(codes) - self.width + 1) if len(codes) else 0
        mixed = np.zeros(span, dtype=np.uint64)
        for i in range(min(self.width, len(codes))):
            mixed = (mixed ^ codes[i : i + span]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed * np.uint64(0xBF58476D1CE4E5B9))

    def shingles(self, text: str) -> set[tuple[bytes, ...]]:
        """The full set itself, for confirming links."""
        words = self.words(text)
        if len(words) < self.width:
            return {tuple(words)} if words else set()
        return set(zip(*[words[i:] for i in range(self.width)]))


def sketches(docs: DataFrame, text: Column, width: int, k: int = SKETCH) -> Column:
    """Struct of a digest of the word sequence, the size of the set and the sketch, sorted."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(SKETCHED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(width)
        for texts in batches:
            rows = []
            for value in texts:
                words = shingler.words(value or "")
                found = shingler.hashes(words)
                digest = xxhash.xxh3_128_digest(b" ".join(words))
                rows.append((digest, len(found), found[:k].view(np.int64).tolist()))
            yield pd.DataFrame(rows, columns=["digest", "n_shingles", "sketch"])

    return run(text)


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole shingle sets reach the similarity; one pair of texts at a time."""
    one = texts.select(F.col("rep").alias("a"), F.col("text").alias("_ta"))
    two = texts.select(F.col("rep").alias("b"), F.col("text").alias("_tb"))
    with_texts = pairs.select("a", "b").join(one, "a").join(two, "b")

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(width)
        for batch in batches:
            hit = []
            for left, right in zip(batch["_ta"], batch["_tb"]):
                x, y = shingler.shingles(left), shingler.shingles(right)
                both = len(x & y)
                hit.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[np.array(hit, dtype=bool), ["a", "b"]]

    kind = dict(pairs.dtypes)["a"]
    return with_texts.mapInPandas(confirm, f"a {kind}, b {kind}")


def _likely(pairs: DataFrame, reps: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs that sizes and the union sketch do not rule out."""
    one = reps.select(F.col("rep").alias("a"), F.col("sketch").alias("_sa"), F.col("n_shingles").alias("_na"))
    two = reps.select(F.col("rep").alias("b"), F.col("sketch").alias("_sb"), F.col("n_shingles").alias("_nb"))
    sized = pairs.join(one, "a").join(two, "b").filter(
        (F.least("_na", "_nb") * 100 >= F.greatest("_na", "_nb") * percent)
    )
    union = F.slice(F.array_sort(F.array_union("_sa", "_sb")), 1, k)
    shared = F.size(F.array_intersect(union, F.array_intersect("_sa", "_sb")))
    # Sketches of a whole union are exact; otherwise SHARED is far below the similarity asked.
    return sized.filter(shared >= F.size(union) * SHARED).select("a", "b")


def _lists(reps: DataFrame) -> DataFrame:
    """Inverted lists (value, rep) of the rarest values of every sketch, without lists of one."""
    entries = reps.select("rep", F.size("sketch").alias("_s"), F.explode("sketch").alias("value"))
    shared = entries.groupBy("value").agg(F.count(F.lit(1)).alias("_df")).filter("_df > 1")
    held = entries.join(shared, "value")
    # Values of one text only come first in its order and take up places without a list.
    rank = F.row_number().over(W.partitionBy("rep").orderBy("_df", "value"))
    count = F.count(F.lit(1)).over(W.partitionBy("rep"))
    room = F.col("_s") - F.ceil(F.col("_s") * SHARED) + 1 - (F.col("_s") - count)
    return held.withColumn("_room", room).withColumn("_rank", rank).filter("_rank <= _room").select(
        "value", "rep"
    )


def _still_open(lists: DataFrame) -> DataFrame:
    """Entries of lists that hold more than one component."""
    spans = lists.groupBy("value").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"))
    return lists.join(spans.filter("_lo != _hi").select("value"), "value", "left_semi")


class Joined:
    """Components that links found in a task have joined."""

    def __init__(self, parts: np.ndarray):
        _, self.of = np.unique(parts, return_inverse=True)
        self.up = list(range(int(self.of.max(initial=-1)) + 1))

    def root(self, row: int) -> int:
        at, up = int(self.of[row]), self.up
        while up[at] != at:
            up[at] = at = up[up[at]]
        return at


def _likely_in(key: tuple, block: pa.Table, percent: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (x, y) of a block pair that sizes and union sketches let through, by falling estimate.

    Only pairs of different components count. A pair that meets in several lists counts in the
    one of the smallest value.
    """
    value, one, two = (x.as_py() for x in key)
    own, rep, part, size = (block[c].to_numpy() for c in ("own", "rep", "component", "n_shingles"))
    left, right = np.flatnonzero(own == one), np.flatnonzero(own == two)
    a, b = size[left][:, None], size[right][None, :]
    fits = (np.minimum(a, b) * 100 >= np.maximum(a, b) * percent) & (part[left][:, None] != part[right][None, :])
    if one == two:
        fits &= rep[left][:, None] < rep[right][None, :]
    if not fits.any():
        return left[:0], right[:0]
    both = _common(*_flat(block["sketch"]), left, right)
    fits &= both >= SHARED * np.minimum(np.minimum(a, b), k)  # the union sketch is at least so long
    if fits.any():
        listed, owner = _flat(block["values"])
        before = listed < value
        fits &= _common(listed[before], owner[before], left, right) == 0
    i, j = np.nonzero(fits)
    order = np.argsort(-both[i, j] / np.minimum(k, np.maximum(size[left[i]], size[right[j]])), kind="stable")
    return left[i[order]], right[j[order]]


def _with_partner(percent: int, k: int):
    """Members of a block pair that have a likely partner in it."""

    def run(key: tuple, block: pa.Table) -> pa.Table:
        rows = np.unique(np.concatenate(_likely_in(key, block, percent, k)))
        return block.take(rows)

    return run


def _compared(width: int, percent: int, k: int):
    """Links of a block pair that join different components: no more than it has members.

    Likely pairs are gone through by falling estimate. What an earlier link of the block has
    joined needs none any more; every other one is compared by its whole sets.
    """

    def run(key: tuple, block: pa.Table) -> pa.Table:
        shingler = Shingler(width)
        rep, size, text = block["rep"].to_numpy(), block["n_shingles"].to_numpy(), block["text"]
        left, right = _likely_in(key, block, percent, k)
        joined, links = Joined(block["component"].to_numpy()), []
        full: dict[int, np.ndarray] = {}  # whole sets of those rows that are compared
        for x, y in zip(left.tolist(), right.tolist()):
            p, q = joined.root(x), joined.root(y)
            if p == q:
                continue
            for row in (x, y):
                if row not in full:
                    full[row] = shingler.hashes(shingler.words(text[row].as_py()))
            shared = len(np.intersect1d(full[x], full[y], assume_unique=True))
            if 100 * shared < percent * (size[x] + size[y] - shared):
                continue
            # Hashes of 64 bits found it; the sets themselves decide.
            s, t = shingler.shingles(text[x].as_py()), shingler.shingles(text[y].as_py())
            if 100 * len(s & t) >= percent * len(s | t):
                joined.up[p] = q
                links.append((x, y))
        ends = rep[np.array(links, dtype=np.int64).reshape(-1, 2)]
        kind = block.schema.field("rep").type
        return pa.table({"a": pa.array(ends.min(axis=1), kind), "b": pa.array(ends.max(axis=1), kind)})

    return run


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists and the row of each."""
    sizes = pc.list_value_length(lists).to_numpy()
    return pc.list_flatten(lists).to_numpy(), np.repeat(np.arange(len(sizes)), sizes)


def _common(flat: np.ndarray, owner: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many of the values in ``flat`` the rows of ``left`` and ``right`` share."""
    _, place, often = np.unique(flat, return_inverse=True, return_counts=True)
    # Only values held twice can be shared: they make a small table of who holds what.
    column = np.cumsum(often > 1) - 1
    twice = often[place] > 1
    holds = np.zeros((1 + max(left.max(), right.max()), int((often > 1).sum())), dtype=np.float32)
    holds[owner[twice], column[place[twice]]] = 1
    return holds[left] @ holds[right].T


def _block_links(
    entries: DataFrame, lists: DataFrame, texts: DataFrame, sketch: DataFrame, width: int, percent: int, k: int
) -> DataFrame:
    """Links between components in the open lists, from blocks of about BLOCK members a side."""
    sizes = entries.groupBy("value").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    cut = entries.join(sizes, "value").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int"))
    every = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    placed = every.select(
        "value", F.least("own", "_other").alias("one"), F.greatest("own", "_other").alias("two"), "own", "rep", "component"
    )
    # The lists of a member are as many as its sketch has values at most.
    of = lists.join(entries.select("rep").distinct(), "rep", "left_semi").groupBy("rep")
    member = of.agg(F.collect_list("value").alias("values")).join(sketch, "rep")
    kind = dict(entries.dtypes)["rep"]
    sides = placed.join(member, "rep")
    # Texts are many times as long as sketches: they follow once it is known whose are compared.
    likely = sides.groupBy("value", "one", "two").applyInArrow(_with_partner(percent, k), sides.schema)
    full = stored(likely, "likely-members").join(texts, "rep")
    return full.groupBy("value", "one", "two").applyInArrow(_compared(width, percent, k), f"a {kind}, b {kind}").distinct()


def links_to_components(docs: DataFrame, reps: DataFrame, width: int, percent: int, k: int) -> DataFrame:
    """``rep`` and ``component`` of every class that is linked with another."""
    lists = stored(_lists(reps).withColumn("component", F.col("rep")), "lists")
    needed = stored(lists.select("rep").distinct(), "listed")
    named = marked(docs.withColumnRenamed("doc_id", "rep"), "rep", needed, "_listed").filter("_listed")
    texts = named.join(reps.select("rep"), "rep").join(needed, "rep", "left_semi")
    texts = stored(texts.select("rep", "text"), "list-texts")
    sketch = marked(reps, "rep", needed, "_listed").filter("_listed").join(needed, "rep", "left_semi")
    sketch = stored(sketch.select("rep", "sketch", "n_shingles"), "list-sketches")
    edges = None
    turn, last = 0, False
    while not last:
        entries = stored(_still_open(lists), "open")
        if entries.isEmpty():
            break
        last = turn >= PIVOT_ROUNDS
        if not last:
            # The pivot of a list is drawn anew in every round, and for every list.
            draw = F.xxhash64(F.lit(turn), "value", "rep")
            pivots = entries.groupBy("value").agg(
                F.min_by(F.struct(F.col("rep").alias("p"), F.col("component").alias("pc")), draw).alias("_p")
            )
            pairs = entries.join(pivots, "value").filter("component != _p.pc").select(
                F.least("rep", "_p.p").alias("a"), F.greatest("rep", "_p.p").alias("b")
            ).distinct()
            turn += 1
            pairs = stored(_likely(pairs, sketch, percent, k), "likely")
            good = stored(_confirmed(pairs, texts, width, percent), "links")
        else:
            good = stored(_block_links(entries, lists, texts, sketch, width, percent, k), "block-links")
        if good.isEmpty():
            continue
        edges = good if edges is None else edges.union(good)
        label = components(edges)
        if not last:
            lists = lists.select("value", "rep").join(label, lists["rep"] == label["node"], "left").select(
                "value", "rep", F.coalesce("component", "rep").alias("component")
            )
            lists = stored(lists, "lists")
    if edges is None:
        return reps.select("rep", F.col("rep").alias("component")).limit(0)
    return label.select(F.col("node").alias("rep"), "component")


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, k: int = SKETCH
) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``.

    Nulls: a null or blank text has an empty set, links with nothing and is kept. Of rows with
    one doc_id the identifier must be unique where links are wanted; rows of a null doc_id are
    passed through, linked with nothing. Texts with fewer words than a shingle have their whole
    sequence as the only one. Equal texts are one class; an empty table gives an empty result.
    """
    sketched = stored(
        docs.select("doc_id", sketches(docs, F.col("text"), width, k).alias("s")).select("doc_id", "s.*"),
        "sketches",
    )
    linkable = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(
        linkable.groupBy("digest").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")
        ),
        "classes",
    )
    plain = docs.select("doc_id", "text")
    label = links_to_components(plain, classes.select("rep", "n_shingles", "sketch"), width, percent, k)
    of_class = classes.select("digest", "rep").join(label, "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("component_id")
    )
    lone = sketched.filter("NOT (n_shingles > 0 AND doc_id IS NOT NULL)")
    out = linkable.select("doc_id", "n_shingles", "digest").join(of_class, "digest").drop("digest")
    out = out.unionByName(lone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
