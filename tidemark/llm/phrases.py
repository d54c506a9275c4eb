"""Phrases of two and three words that belong together, per language, by best-first growth.

A phrase scores the lowest ``a^2 / (l · r)`` of its cuts. Words are counted first; a pair's bound
is that of its rarer word, which never rules a pair out before the last, so all pairs of words
that are frequent enough are counted. They are the frontier. What grows from a pair of count
``b`` cannot score above ``b / f`` with the count ``f`` of its outer word: as the beginning of
three words that is the first, as their end the last.

Growth goes from the best bounds downwards. At each floor, the three-word phrases both of whose
pairs have bounds at or above it are counted, and those around pairs that score as much
themselves, as these may drop them. A language is settled when its last wanted survivor, ties
included, is at or above the floor, for everything not counted yet is below; else the floor
falls, finally to zero. The floors change which phrases are counted when, never the result.

Texts are read again for every floor; only counts are shuffled, summed in each task first. Phrases
of the ``KNOWN`` commonest words travel as one number, all others as text. What is broadcast has
a fixed size: those words, and a table of ``SLOTS`` hashed marks of pairs. A mark that two
pairs share lets more be counted than needed. A task holds the words of about ``CHARS``
characters, or of the longest stretch without a separator.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, empty_if_null, kept, share, stored

FLOORS = (50_000, 2_000, 0)
KNOWN_BITS = 20
KNOWN = 1 << KNOWN_BITS
SLOT_BITS = 23
CHUNK_BITS = 13
CHARS = 1 << 23
# Words that a task counts before it hands them on.
LOCAL = 1 << 20
SALTS = 64
FULL = 1_000_000
UNKNOWN = "und"
# Marks of a pair: frequent; scores at the floor; its phrase may, as a beginning, as an end.
FREQUENT, SCORES, BEGINS, ENDS = 1, 2, 4, 8

_LOWER = {b: b + 32 for b in range(65, 91)}
_BREAKS = {b: 10 for b in (*b".,;:!?", *range(10, 14))}
# A-Z in lower case, every separator a line feed, tabs blanks.
FOLD = bytes((_LOWER | _BREAKS | {9: 32}).get(b, b) for b in range(256))
BREAK = b"\n"


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Words of many texts of one language; a line feed stands where a piece ends."""
    held: dict[str, list[bytes]] = {}
    sizes: Counter = Counter()

    def words(data: bytes) -> list[bytes]:
        return data.replace(b"\n", b" \n ").split(b" ")

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = text.as_py().encode().translate(FOLD)
            while len(data) > CHARS:
                cut = data.find(BREAK, CHARS)
                if cut < 0:
                    break
                yield lang, words(data[:cut])
                data = data[cut:]
            held.setdefault(lang, []).append(data)
            sizes[lang] += len(data) + 1
            if sum(sizes.values()) >= 2 * CHARS or sizes[lang] >= CHARS:
                most = max(sizes, key=sizes.get)
                yield most, words(BREAK.join(held.pop(most)))
                del sizes[most]
    for lang, parts in held.items():
        yield lang, words(BREAK.join(parts))


def _texts(docs: DataFrame) -> DataFrame:
    """``lang`` (null: ``und``) and ``text`` (null: empty)."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), empty_if_null(F.col("text")).alias("text"))


def _word_counts(texts: DataFrame) -> DataFrame:
    """``lang``, ``word``, ``f`` over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, Counter] = {}

        def handed(lang: str) -> pa.RecordBatch:
            counted = totals.pop(lang)
            counted.pop(b"", None)
            counted.pop(BREAK, None)
            words = pa.array(list(counted.keys()), pa.binary()).cast(pa.string())
            columns = [pa.array([lang] * len(counted), pa.string()), words, pa.array(list(counted.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "word", "f"])

        for lang, words in _stretches(batches):
            totals.setdefault(lang, Counter()).update(words)
            if sum(map(len, totals.values())) > LOCAL:
                for held in list(totals):
                    yield handed(held)
        for held in list(totals):
            yield handed(held)

    rows = texts.mapInArrow(run, "lang string, word string, f long")
    return rows.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _slots(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Where the mark of a pair lies, from the hashes of its words."""
    mixed = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second + np.uint64(0x632BE59BD9B4E019))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode() + b"\0" + word)


class Lexicon:
    """The known words of all languages: their numbers and counts. One a worker."""

    def __init__(self, state: dict):
        self.of: dict[str, dict[bytes, int]] = {}
        self.names: list[tuple[str, bytes]] = []
        for lang, words in state["words"].items():
            found = words.split(BREAK)
            self.of[lang] = dict(zip(found, range(len(self.names), len(self.names) + len(found))))
            self.names += [(lang, w) for w in found]
        self.counts = state["counts"]

    def count(self, lang: str, word: bytes) -> int | None:
        found = self.of.get(lang, {}).get(word)
        return None if found is None else int(self.counts[found])


class Stretch:
    """Words of a stretch as codes, with what is known of each."""

    def __init__(self, lang: str, words: list[bytes], lexicon: Lexicon, all_known: bool):
        self.lang = lang
        # Codes: -2 nothing, -1 a break, else the place in the list of distinct words.
        place = {b"": -2, BREAK: -1}
        self.names = names = []
        for w in set(words):
            if w not in place:
                place[w] = len(names)
                names.append(w)
        codes = np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words))
        self.codes = codes[codes != -2]
        known = lexicon.of.get(lang, {})
        # The last entry stands for a break.
        self.ids = np.array([known.get(w, -1) for w in names] + [-1], dtype=np.int64)
        usable = (self.ids >= 0) | (not all_known)
        usable[-1] = False
        self.usable = usable

    def rows(self, keep: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
        """Counts of the phrases of ``width`` words that begin at the places in ``keep``."""
        parts = [self.codes[keep + i] for i in range(width)]
        ids = [self.ids[c] for c in parts]
        known = np.logical_and.reduce([i >= 0 for i in ids])
        key = np.zeros(int(known.sum()), dtype=np.int64)
        for i in ids:
            key = (key << KNOWN_BITS) | i[known]
        key, times = np.unique(key, return_counts=True)
        yield self.batch(pa.nulls(len(key), pa.string()), pa.array(key), pa.nulls(len(key), pa.string()), times)
        if not known.all():
            # Places of codes are below 2^21 or so: three of them fit one number as well.
            bits = max(1, len(self.names).bit_length())
            key = np.zeros(int((~known).sum()), dtype=object if bits * width > 62 else np.int64)
            for c in parts:
                key = (key << bits) | c[~known]
            key, times = np.unique(key, return_counts=True)
            mask = (1 << bits) - 1
            words = [[self.names[(k >> (bits * i)) & mask] for i in reversed(range(width))] for k in key.tolist()]
            phrases = pa.array([b" ".join(w) for w in words], pa.binary()).cast(pa.string())
            yield self.batch(pa.array([self.lang] * len(key), pa.string()), pa.nulls(len(key), pa.int64()), phrases, times)

    @staticmethod
    def batch(lang, key, phrase, times) -> pa.RecordBatch:
        columns = [lang, key, phrase, pa.array(times, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "key", "phrase", "a"])


def _pairs_in(stretch: Stretch, state: dict) -> np.ndarray:
    codes, usable = stretch.codes, stretch.usable
    return np.flatnonzero(usable[codes[:-1]] & usable[codes[1:]])


def _triples_in(stretch: Stretch, state: dict) -> np.ndarray:
    """Where three words begin whose pairs' marks allow them."""
    codes = stretch.codes
    of = np.array([_hash(stretch.lang, w) for w in stretch.names] + [0], dtype=np.uint64)
    marks = state["marks"][_slots(of[codes[:-1]], of[codes[1:]])]
    marks[(codes[:-1] < 0) | (codes[1:] < 0)] = 0
    one, two = marks[:-1], marks[1:]
    scores = ((one & SCORES > 0) & (two & FREQUENT > 0)) | ((one & FREQUENT > 0) & (two & SCORES > 0))
    return np.flatnonzero(scores | ((one & BEGINS > 0) & (two & ENDS > 0)))


def _phrase_counts(texts: DataFrame, state: dict, width: int) -> DataFrame:
    """``lang``, ``phrase``, ``a`` of the phrases of ``width`` words that occur ``least`` times.

    ``first`` and ``last`` are the counts of the outer words, null where the word is not known.
    """
    shared = share(texts, state)
    choose = _pairs_in if width == 2 else _triples_in

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = kept(shared.value, "lexicon", Lexicon)
        for lang, words in _stretches(batches):
            stretch = Stretch(lang, words, lexicon, shared.value["all_known"])
            if len(stretch.codes) >= width:
                yield from stretch.rows(choose(stretch, shared.value), width)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, mask = kept(shared.value, "lexicon", Lexicon), (1 << KNOWN_BITS) - 1
        names, counts = lexicon.names, lexicon.counts
        for batch in batches:
            langs, keys, phrases = (batch.column(i).to_pylist() for i in range(3))
            ends = []
            for row, key in enumerate(keys):
                if key is not None:
                    ids = [(key >> (KNOWN_BITS * i)) & mask for i in reversed(range(width))]
                    langs[row], phrases[row] = names[ids[0]][0], b" ".join([names[i][1] for i in ids]).decode()
                    ends.append((int(counts[ids[0]]), int(counts[ids[-1]])))
                else:
                    words = phrases[row].encode().split(b" ")
                    ends.append((lexicon.count(langs[row], words[0]), lexicon.count(langs[row], words[-1])))
            first, last = zip(*ends) if ends else ((), ())
            columns = [pa.array(langs, pa.string()), pa.array(phrases, pa.string()), batch.column(3)]
            columns += [pa.array(first, pa.int64()), pa.array(last, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "a", "first", "last"])

    rows = texts.mapInArrow(run, "lang string, key long, phrase string, a long")
    sums = rows.groupBy("lang", "key", "phrase").agg(F.sum("a").alias("a")).filter(F.col("a") >= state["least"])
    return sums.mapInArrow(named, "lang string, phrase string, a long, first long, last long")


def _with_counts(rows: DataFrame, width: int, rest: DataFrame | None) -> DataFrame:
    """``rows`` with the counts of outer words that are not known, from ``rest``.

    Of such a word no more phrases exist than it has occurrences, which are fewer than those of
    a known one: no key of the join is hot.
    """
    for name, at in (("first", 0), ("last", width - 1)) if rest is not None else ():
        counts = rest.select("lang", F.col("word").alias("_word"), F.col("f").alias(name))
        unknown = rows.filter(F.col(name).isNull()).drop(name).withColumn("_word", F.get(F.split("phrase", " "), F.lit(at)))
        rows = rows.filter(F.col(name).isNotNull()).unionByName(unknown.join(counts, ["lang", "_word"]).drop("_word"))
    return rows


def _score(a: str, left: str, right: str) -> Column:
    """``floor(10^6 · a^2 / (l · r))`` exactly, for counts below 10^15."""
    count = f"CAST({a} AS DECIMAL(15,0))"
    over = f"CAST({FULL} AS DECIMAL(7,0)) * ({count} * {count})"
    return F.expr(f"({over}) div (CAST({left} AS DECIMAL(18,0)) * CAST({right} AS DECIMAL(18,0)))")


def _known(words: DataFrame, least: int) -> tuple[int, int]:
    """From which count on words are known (``KNOWN`` at most), and the largest count below."""
    bucket = F.floor(4 * F.log2(F.col("f"))).alias("bucket")
    counts = words.filter(F.col("f") >= least).groupBy(bucket)
    rows = counts.agg(F.count(F.lit(1)).alias("words"), F.min("f").alias("low"), F.max("f").alias("high")).collect()
    seen, low = 0, math.inf
    for r in sorted(rows, key=lambda r: -r.bucket):
        seen += r.words
        if seen > KNOWN:
            return (low if low < math.inf else r.high + 1), r.high
        low = r.low
    return least, least - 1


def _best(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of every language, with ``rank``; chosen in parts first."""
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    parts = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    chosen = rows.withColumn("rank", F.row_number().over(parts)).filter(F.col("rank") <= limit)
    whole = W.partitionBy("lang").orderBy(*order)
    return chosen.withColumn("rank", F.row_number().over(whole).cast("long")).filter(F.col("rank") <= limit)


def _marks(pairs: DataFrame, floor: int) -> np.ndarray:
    """The marks of all pairs by slot, one byte each; the driver holds this table only."""
    bound = lambda outer: FULL * F.col("a") >= floor * F.col(outer)
    flags = F.lit(FREQUENT)
    for met, flag in ((F.col("score") >= floor, SCORES), (bound("l"), BEGINS), (bound("r"), ENDS)):
        flags = flags + F.when(met, flag).otherwise(0)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, phrases = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            words = [p.encode().split(b" ") for p in phrases]
            of = np.array([[_hash(v, w) for w in ws] for v, ws in zip(langs, words)], dtype=np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(_slots(of[:, 0], of[:, 1])), batch.column(2)], names=["slot", "flags"])

    def packed(chunk: pa.Table) -> pa.Table:
        held = np.zeros(1 << CHUNK_BITS, dtype=np.uint8)
        slot = chunk.column("slot").to_numpy()
        held[slot & ((1 << CHUNK_BITS) - 1)] = chunk.column("flags").to_numpy()
        return pa.table({"chunk": [int(slot[0]) >> CHUNK_BITS], "held": [held.tobytes()]})

    rows = pairs.select("lang", "phrase", flags.cast("int").alias("flags")).mapInArrow(slots, "slot long, flags int")
    rows = rows.groupBy("slot").agg(F.bit_or("flags").alias("flags"))
    # A chunk has as many slots as its bits allow, so no group grows with the data.
    chunks = rows.groupBy(F.shiftright("slot", CHUNK_BITS).alias("chunk")).applyInArrow(packed, "chunk long, held binary")
    marks = np.zeros(1 << SLOT_BITS, dtype=np.uint8)
    for chunk, held in chunks.collect():
        part = np.frombuffer(held, dtype=np.uint8)[: len(marks)]
        marks[chunk << CHUNK_BITS : (chunk << CHUNK_BITS) + len(part)] = part
    return marks


def _lexicon(words: DataFrame, known: int) -> dict:
    """The known words of each language in one text, and their counts in the same order.

    They are put together in the tasks, in parts of a few thousand words, so that the driver
    never holds a word by itself.
    """
    part = F.pmod(F.xxhash64("word"), F.lit(SALTS)).alias("part")
    found = F.sort_array(F.collect_list(F.struct("word", "f")))
    rows = words.filter(F.col("f") >= known).groupBy("lang", part).agg(found.alias("found"))
    rows = rows.select("lang", "part", F.array_join("found.word", "\n").alias("words"), F.col("found.f").alias("counts"))
    texts: dict[str, list[bytes]] = {}
    counts: dict[str, list[np.ndarray]] = {}
    for r in rows.sort("lang", "part").toLocalIterator():
        texts.setdefault(r.lang, []).append(r.words.encode())
        counts.setdefault(r.lang, []).append(np.array(r.counts, dtype=np.int64))
    flat = [c for parts in counts.values() for c in parts]
    return {
        "words": {lang: b"\n".join(parts) for lang, parts in texts.items()},
        "counts": np.concatenate(flat) if flat else np.zeros(0, np.int64),
    }


def _scored_triples(three: DataFrame, pairs: DataFrame) -> DataFrame:
    """Three-word phrases with ``l``, ``r`` and ``score`` of their lowest cut."""
    of = lambda i: F.array_join(F.slice(F.split("phrase", " "), i, 2), " ")
    rows = three.withColumns({"head": of(1), "tail": of(2)})
    for name in ("head", "tail"):
        inner = pairs.select("lang", F.col("phrase").alias(name), F.col("a").alias(f"f_{name}"))
        rows = rows.join(inner, ["lang", name])
    cuts = F.array(
        F.struct(_score("a", "first", "f_tail").alias("score"), F.lit(1).alias("k"), F.col("first").alias("l"), F.col("f_tail").alias("r")),
        F.struct(_score("a", "f_head", "last").alias("score"), F.lit(2).alias("k"), F.col("f_head").alias("l"), F.col("last").alias("r")),
    )
    return rows.withColumn("cut", F.array_min(cuts)).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "head", "tail")


def collocations(docs: DataFrame, top: int = 2000, least: int = 10, drop: int = 50) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: each language's best phrases.

    Words are runs without blank and tab between the separators ``.,;:!?`` and line ends, A-Z in
    lower case; null texts are empty, a null language is ``und``. ``a`` counts the phrase (at
    least ``least``), ``l`` and ``r`` the two parts of its lowest-scoring cut, ``n`` all words.
    A pair is left out where three words around it occur ``drop`` percent as often. Order:
    score, then ``a``, downwards, then the phrase by bytes. Equal rows all count. A language
    with fewer phrases returns them all; one without any returns no row.
    """
    texts = _texts(docs)
    words = stored(_word_counts(texts), "words")
    sums = stored(words.groupBy("lang").agg(F.sum("f").alias("n")), "word-sums")
    open_langs = sorted(r.lang for r in sums.select("lang").collect())
    known, cap = _known(words, least)
    state = {**_lexicon(words, known), "all_known": cap < least, "least": least}
    rest = None if cap < least else words.filter(F.col("f").between(least, cap))
    pairs = _with_counts(stored(_phrase_counts(texts, state, 2), "pair-counts"), 2, rest)
    pairs = pairs.withColumnsRenamed({"first": "l", "last": "r"}).withColumn("score", _score("a", "l", "r"))
    pairs = stored(pairs, "pairs")
    out = docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, score long")
    for floor in FLOORS:
        mine = F.col("lang").isin(open_langs)
        marks = _marks(pairs.filter(mine), floor)
        three = stored(_phrase_counts(texts.filter(mine), {**state, "marks": marks}, 3), "triples")
        three = stored(_scored_triples(_with_counts(three, 3, rest), pairs), "scored-triples")
        around = three.select("lang", F.explode(F.array_distinct(F.array("head", "tail"))).alias("phrase"), "a")
        around = around.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        two = pairs.filter(mine & (F.col("score") >= floor)).join(around, ["lang", "phrase"], "left")
        two = two.filter(~F.coalesce(100 * F.col("longer") >= drop * F.col("a"), F.lit(False)))
        names = ["lang", "phrase", "a", "l", "r", "score"]
        rows = two.select(names).unionByName(three.filter(F.col("score") >= floor).select(names))
        best = stored(_best(rows, top), "best")
        settled = {r.lang for r in best.filter(F.col("rank") == top).select("lang").collect()}
        out = out.unionByName(best.filter(F.col("lang").isin(sorted(settled)) if floor else F.lit(True)).select(out.columns))
        open_langs = [v for v in open_langs if v not in settled]
        if not open_langs:
            break
    return out.join(sums, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
