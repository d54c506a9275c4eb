"""Ranked lexical search: the best documents of every item, by accumulators term at a time.

Documents are counted once: per document its length and the occurrences of the items' terms.
Lengths and document frequencies over all documents give every term its weight. Then blocks of
documents are searched where they lie. Within a block an item's terms are visited rarest first;
each opens accumulators for the documents it meets, until the sum of what the remaining terms
could still add cannot reach the k-th best score known so far. From there on no accumulator is
opened and the remaining terms are added exactly to the documents that have one. A task hands the
k-th score of one block to the next, and only its own best rows leave it.

What is broadcast is bounded: items are searched in groups of about half ``TERMS_A_GROUP`` terms.
A task holds the postings of a block (``BLOCK`` of them, or those of one document) and k rows an
item.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, share, stored

# Item terms (counted once an item) that are broadcast and searched together.
TERMS_A_GROUP = 200_000
BLOCK = 1 << 20
# Bytes of a text that are split at a time.
PIECE = 1 << 20
UNIT = 1_000_000_000
# A task hands on at most k rows an item; they meet in this many parts before the last choice.
SALTS = 64
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}

# A term is a run of ASCII letters, digits and anything beyond ASCII; all else separates.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size; only A-Z are lower-cased."""
    data = text.encode("utf-8", "surrogatepass").translate(FOLD)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _item_terms(items: DataFrame, item: str) -> DataFrame:
    """Distinct ``_item``, ``term`` of the items' texts."""
    bounded_batches(items.sparkSession)

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({w.decode("utf-8", "surrogatepass") for ws in terms_of(t or "") for w in ws}) for t in texts])

    return items.select(F.col(item).alias("_item"), F.explode(found("text")).alias("term")).distinct()


def _counted(docs: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """``_key``, ``n`` (terms with repeats) and the ``ids`` and ``times`` of the listed terms."""
    kind = docs.schema[key].dataType.simpleString()
    shared = share(docs, {t.encode("utf-8", "surrogatepass"): i for i, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value.get
        for batch in batches:
            lengths, ids, times, ends = [], [], [], [0]
            for text in batch.column(1):
                n, seen = 0, Counter()
                for words in terms_of(text.as_py() or ""):
                    n += len(words)
                    seen.update(map(place, words))
                seen.pop(None, None)
                lengths.append(n)
                ids.extend(seen.keys())
                times.extend(seen.values())
                ends.append(len(ids))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
                ],
                names=["_key", "n", "ids", "times"],
            )

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(key).alias("_key"), "text").mapInArrow(run, f"_key {kind}, n long, ids array<int>, times array<long>")


def weight(documents: int, frequency: int) -> int:
    """``floor(1000 · ln((2N + 2) / (2 df + 1)))``."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


class Block:
    """Postings of some documents by term, with what each occurrence is worth."""

    def __init__(self, lengths, sizes, ids, times, totals: tuple[int, int], terms: int):
        documents, words = totals
        n = np.asarray(lengths, dtype=np.int64)
        m = 50 + (50 * n * documents) // max(words, 1)
        owner = np.repeat(np.arange(len(n)), sizes)
        order = np.argsort(ids, kind="stable")
        self.size = len(n)
        self.docs = owner[order]
        times = np.asarray(times, dtype=np.int64)[order]
        self.worth = (UNIT * times) // (1000 * times + 20 * m[self.docs])
        self.starts = np.searchsorted(np.asarray(ids)[order], np.arange(terms + 1))

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        here = slice(self.starts[term], self.starts[term + 1])
        return self.docs[here], self.worth[here]

    def best(self, terms: list[tuple[int, int]], least: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that may be among the best ``k``, their scores, and the accumulators opened.

        ``terms`` are (number, weight), rarest first. A document that scores less than ``least``
        may be left out; ties with it are kept.
        """
        lists = [(w, *self.of(t)) for t, w in terms]
        lists = [entry for entry in lists if len(entry[1]) and entry[0]]
        # What the terms from here on can add to a document at most.
        rest = np.cumsum([0] + [w * int(worth.max()) for w, _, worth in reversed(lists)])[::-1]
        score = np.zeros(self.size, dtype=np.int64)
        for at, (w, docs, worth) in enumerate(lists):
            if rest[at] < max(least, 1):
                break
            score[docs] += w * worth
            open_now = score[score > 0]
            if len(open_now) >= k:
                least = max(least, int(np.partition(open_now, len(open_now) - k)[len(open_now) - k]))
        else:
            at = len(lists)
        alive = np.flatnonzero(score > 0)
        opened = len(alive)
        for later in range(at, len(lists)):
            # Survivors are updated exactly; those that cannot reach the k-th score any more leave.
            alive = alive[score[alive] + rest[later] >= least]
            if not len(alive):
                break
            w, docs, worth = lists[later]
            listed = np.zeros(self.size, dtype=np.int64)
            listed[docs] = worth
            score[alive] += w * listed[alive]
        alive = alive[score[alive] >= max(least, 1)]
        return alive, score[alive], opened


def _top(score: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the best ``k``: by score, then by key, rows without a key last."""
    if keys.dtype != object:
        return np.lexsort((keys, -score))[:k]
    order = sorted(range(len(keys)), key=lambda i: (-score[i], keys[i] is None, "" if keys[i] is None else keys[i]))
    return np.array(order[:k], dtype=np.int64)


def _searched(counted: DataFrame, groups: dict, item_kind: str, totals: tuple[int, int], terms: int, k: int) -> DataFrame:
    """Best ``k`` rows of each task and item: ``_item``, ``_key``, ``score``."""
    kind = counted.schema["_key"].dataType.simpleString()
    key_type, item_type = ARROW[kind], ARROW[item_kind]
    shared = share(counted, groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        found = {}  # item: (keys, scores), at most k
        held, postings = [], 0

        def search() -> None:
            keys = [v for b in held for v in b.column(0).to_pylist()]
            plain = None not in keys and all(isinstance(v, int) for v in keys)
            keys = np.array(keys, dtype=np.int64 if plain else object)
            lists = [b.column(2) for b in held]
            sizes = np.concatenate([c.value_lengths().to_numpy() for c in lists])
            flat = lambda place: np.concatenate([b.column(place).flatten().to_numpy() for b in held])
            lengths = np.concatenate([b.column(1).to_numpy() for b in held])
            block = Block(lengths, sizes, flat(2), flat(3), totals, terms)
            for item, wanted in items.items():
                known = found.get(item)
                least = int(known[1][-1]) if known is not None and len(known[1]) >= k else 0
                docs, scores, _ = block.best(wanted, least, k)
                if not len(docs):
                    continue
                ids = keys[docs]
                if known is not None:
                    if known[0].dtype != ids.dtype:
                        ids = ids.astype(object)
                        known = (known[0].astype(object), known[1])
                    ids, scores = np.concatenate([known[0], ids]), np.concatenate([known[1], scores])
                chosen = _top(scores, ids, k)
                found[item] = (ids[chosen], scores[chosen])

        for batch in batches:
            held.append(batch)
            postings += len(batch.column(2).flatten()) + batch.num_rows
            if postings >= BLOCK:
                search()
                held, postings = [], 0
        if held:
            search()
        for item, (ids, scores) in found.items():
            columns = [pa.array([item] * len(ids), item_type), pa.array(ids.tolist(), key_type), pa.array(scores, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["_item", "_key", "score"])

    return counted.mapInArrow(run, f"_item {item_kind}, _key {kind}, score long")


def ranked(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", k: int = 50) -> DataFrame:
    """``item``, ``rank`` (from 1), ``key``, ``score`` of the best ``k`` documents of every item.

    Equal scores go by ascending key, null keys last; documents without a common term of weight
    have score 0 and are not listed. Null texts have no terms. An item is an item identifier: rows that share one are
    one query of all their terms. Repeated documents are ranked as rows of their own.
    Keys are integers or strings. Scores are whole numbers: ``weight`` times
    ``10^9 · tf div (1000 · tf + 20 · m)`` with ``m = 50 + (50 · n · N) div L``.
    """
    wanted = stored(_item_terms(items, item), "item-terms")
    item_kind, key_kind = (d.schema[c].dataType.simpleString() for d, c in ((items, item), (docs, key)))
    parts = -(-2 * wanted.count() // TERMS_A_GROUP)
    out = docs.sparkSession.createDataFrame([], f"_item {item_kind}, _key {key_kind}, score long")
    for part in range(parts):
        rows = wanted.filter(F.pmod(F.xxhash64("_item"), F.lit(parts)) == part).collect()
        terms = sorted({r.term for r in rows})
        number = {t: i for i, t in enumerate(terms)}
        counted = stored(_counted(docs, key, terms), "postings")
        documents, words = counted.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        found = counted.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("df"))
        weights = {r.id: weight(documents, r.df) for r in found.collect()}
        groups: dict = {}
        for r in rows:
            if number[r.term] in weights:
                groups.setdefault(r["_item"], []).append((number[r.term], weights[number[r.term]]))
        groups = {i: sorted(v, key=lambda e: (-e[1], e[0])) for i, v in groups.items()}
        out = out.unionByName(_searched(counted, groups, item_kind, (documents, words), len(terms), k))
    order = [F.col("score").desc(), F.col("_key").asc_nulls_last()]
    salted = W.partitionBy("_item", "salt").orderBy(*order)
    whole = W.partitionBy("_item").orderBy(*order)
    few = out.withColumn("salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)))
    few = few.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= k)
    few = few.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)
    return few.select(F.col("_item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("_key").alias(key), "score")
