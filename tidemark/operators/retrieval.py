"""Case retrieval: two TF-IDF views per domain, rank fusion and a balanced panel.

Documents carry ``pmcid``, ``source`` (the domain), ``title`` and ``case_summary``. An index is
built once per corpus, stored as tables and shared; a request then touches only its own terms.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.textfold import (
    byte_total,
    edge_grams,
    eligible_text,
    normalize_text,
    strip_accents,
    word_terms,
    words_only,
)
from tidemark.operators.contracts import ContractError, spec_fingerprint, table_digest
from tidemark.operators.ordering import group_starts, ordered_positions
from tidemark.session import path_exists, remove_path, scratch_path, shared_folder, spread, written

RRF_OFFSET = 60
DOMAINS = ("cardiac", "systemic", "vascular")
SCORE_DIGITS = 12
_TERM = ["source", "view", "term"]
# Texts that are counted together in a task, by bytes and by rows.
BLOCK_TEXT = 4 << 20
BLOCK_ROWS = 1 << 15
GRAMS = (3, 4, 5)
# Shares of the terms of a domain, one merged by a task, for each of its blocks.
SHARES = 0.4


@dataclass(frozen=True)
class View:
    """How one view splits text and which terms it keeps."""

    name: str
    split: str
    min_df: int = 1
    max_df: float = 1.0
    max_features: int | None = None
    sublinear: bool = True


WORD_VIEW = View("word", "word_pairs", min_df=2, max_df=0.98)
CHAR_VIEW = View("char", "char_edges", min_df=2)
RELEASE_VIEWS = (WORD_VIEW, CHAR_VIEW)
# The deployed candidate: one vocabulary over everything, single words, raw counts.
GLOBAL_VIEWS = (View("word", "words", sublinear=False),)

_WORD_SPLITS = {"word_pairs": word_terms, "words": words_only}


@dataclass(frozen=True)
class Index:
    documents: DataFrame  # pmcid, source
    texts: DataFrame  # source, pmcid, texts, bytes: the folded texts, one row a document
    terms: DataFrame  # block, source, view, term, docs, tfs, total: one row a term and block, counted when read
    vocabulary: DataFrame  # source, view, term, df, idf
    norms: DataFrame  # source, view, pmcid, norm
    views: Sequence[View] = field(default=RELEASE_VIEWS)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _split_counts(text: DataFrame, view: View, keep: Sequence[str]) -> DataFrame:
    """``keep, term, tf`` of one view; a word is cut into n-grams once per ``keep``, not per occurrence."""
    count = F.count(F.lit(1)).alias("tf")
    if view.split in _WORD_SPLITS:
        found = text.select(*keep, F.explode(_WORD_SPLITS[view.split](F.col("text"))).alias("term"))
        return found.groupBy(*keep, "term").agg(count)
    words = text.select(*keep, F.explode(_words(F.col("text"))).alias("_word")).groupBy(*keep, "_word").agg(count)
    grams = words.select(*keep, "tf", F.explode(edge_grams(F.col("_word"), GRAMS)).alias("term"))
    return grams.groupBy(*keep, "term").agg(F.sum("tf").alias("tf"))


def term_counts(text: DataFrame, views: Sequence[View], keep: Sequence[str]) -> DataFrame:
    """``keep, view, term, tf`` from a ``text`` column that is already folded."""
    counted = [
        _split_counts(text, v, keep).select(*keep, F.lit(v.name).alias("view"), "term", "tf") for v in views
    ]
    return reduce(DataFrame.unionByName, counted)


_BLOCKS = (
    "block long, source string, view string, term string, docs array<int>, tfs array<int>, total long, "
    "ids array<string>"
)


def _text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in blocks of one source and bounded text, with their document numbers.

    Rows of one document are never parted.
    """
    held, size, last = [], [0, 0], None

    def whole():
        table = pa.concat_tables([pa.Table.from_batches([b]) for b, _ in held]).combine_chunks()
        return table, np.cumsum(np.concatenate([s for _, s in held])) - 1

    for batch in batches:
        if not batch.num_rows:
            continue
        source = last and last[:1]
        turns = group_starts(batch, ["source"], source)
        starts = group_starts(batch, ["source", "pmcid"], last)
        last = [batch.column(c)[batch.num_rows - 1].as_py() for c in ("source", "pmcid")]
        lengths = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
        at = 0
        for i in np.flatnonzero(starts):
            size[0] += int(lengths[at:i].sum())
            size[1] += int(i - at)
            held.append((batch.slice(at, i - at), starts[at:i]))
            at = i
            if size[1] and (turns[i] or size[0] >= BLOCK_TEXT or size[1] >= BLOCK_ROWS):
                yield whole()
                held, size = [], [0, 0]
        size[0] += int(lengths[at:].sum())
        size[1] += batch.num_rows - at
        held.append((batch.slice(at), starts[at:]))
    if size[1]:
        yield whole()


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes, distinct values and row numbers of the values of a list column."""
    coded = lists.flatten().dictionary_encode()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, np.repeat(np.arange(len(lists)), lengths)


# The pattern of a word for tasks, from the letters and digits that ``words_only`` knows.
_word_pattern: list[str] = []


def word_pattern(spark: SparkSession) -> str:
    """``words_only`` for single words in tasks: the same letters, whatever table of them Python has."""
    if not _word_pattern:
        letter = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        points = spark.range(0x110000).filter("id NOT BETWEEN 55296 AND 57343").filter(F.size(words_only(F.repeat(letter, 2))) > 0)
        held = np.sort(np.array(points.agg(F.collect_list("id")).first()[0]))
        ends = np.flatnonzero(np.diff(held) > 1)
        first, last = held[np.append(0, ends + 1)], held[np.append(ends, len(held) - 1)]
        _word_pattern.append("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first, last, strict=True)) + "]{2,}")
    return _word_pattern[0]


def _numbered(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key below ``size`` stands first, in order of keys, and the place of every key among them."""
    if size > max(1 << 21, 4 * len(key)):
        _, first, number = np.unique(key, return_index=True, return_inverse=True)
        return first, number
    first = np.full(size, -1, np.int32)
    first[key[::-1]] = np.arange(len(key) - 1, -1, -1, dtype=np.int32)
    held = np.flatnonzero(first >= 0)
    first, place = first[held], first
    place[held] = np.arange(len(held), dtype=np.int32)
    return first, place[key].astype(np.int64)


def _grams(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, object]]:
    """Per length: the numbers of the n-grams of the padded words, how many each word has, and their spelling.

    An n-gram is numbered by the pair of its (n-1)-gram and its last character.
    """
    text = "".join(f" {w} " for w in words.to_pylist())
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    begins = np.cumsum(sizes) - sizes
    first, letter = _numbered(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64), 0x110000)
    number, letters = letter, len(first)
    for n in range(2, max(GRAMS) + 1):
        if len(letter) < n:
            return
        first, number = _numbered(number[:-1] * letters + letter[n - 1 :], len(first) * letters)
        if n in GRAMS:
            counts = np.maximum(sizes - n + 1, 0)
            spell = lambda of, n=n, first=first: pa.array([text[i : i + n] for i in first[of.to_numpy()]], pa.string())
            yield number[_runs(begins, counts)], counts, spell


def _runs(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whole numbers from each begin on, as many as counted."""
    shift = np.repeat(begins - (np.cumsum(counts) - counts), counts)
    return np.arange(len(shift)) + shift


def _changes(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])[: len(sorted_values)])


def _view_terms(
    split: str, code: np.ndarray, words: pa.Array, row: np.ndarray, pattern: str, asked: pa.Array | None = None
) -> Iterator[tuple]:
    """Term numbers, text numbers, how often and how to spell numbers of terms, for every kind of term of a view.

    A text is read as the words between its blanks. Each is cut into terms once, and n-grams
    are laid out once for a word of a text, however often it stands there. ``asked`` keeps the
    n-grams and words that are listed, and pairs of words that stand in listed pairs.
    """
    known = lambda terms, among: pc.is_in(terms, among).to_numpy(zero_copy_only=False)
    if split == "char_edges":
        # An empty text and blanks next to each other leave an empty word.
        empty = words.index("").as_py()
        key, times = np.unique(row[code != empty] * len(words) + code[code != empty], return_counts=True)
        row, code = np.divmod(key, max(len(words), 1))
        for numbers, per_word, spell in _grams(words):
            if asked is not None and len(numbers):
                mine = known(spell(pa.array(np.arange(numbers.max() + 1))), asked)[numbers]
                upto, ends = np.append(0, np.cumsum(mine)), np.cumsum(per_word)
                numbers, per_word = numbers[mine], upto[ends] - upto[ends - per_word]
            counts = per_word[code]
            held = _runs((np.cumsum(per_word) - per_word)[code], counts)
            yield numbers[held], np.repeat(row, counts), np.repeat(times, counts), spell
        return
    find = re.compile(pattern).findall
    found = [find(w) for w in words.to_pylist()]
    per_word = np.array([len(f) for f in found], np.int64)
    coded = pa.array([w for f in found for w in f], pa.string()).dictionary_encode()
    words, counts = coded.dictionary, per_word[code]
    held = _runs((np.cumsum(per_word) - per_word)[code], counts)
    code, row = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[held], np.repeat(row, counts)
    mine = slice(None) if asked is None else known(words, asked)[code]
    yield code[mine], row[mine], None, words.take
    if split == "word_pairs":
        size = max(len(words), 1)
        # Texts of one document stay apart.
        near = row[1:] == row[:-1]
        if asked is not None:
            paired = known(words, pc.split_pattern(asked.filter(pc.match_substring(asked, " ")), " ").flatten())[code]
            near &= paired[1:] & paired[:-1]
        both = lambda pair: pc.binary_join_element_wise(
            words.take(pa.array(pair.to_numpy() // size)), words.take(pa.array(pair.to_numpy() % size)), " "
        )
        yield (code[:-1] * size + code[1:])[near], row[1:][near], None, both


def _tallied(term: np.ndarray, doc: np.ndarray, times: np.ndarray | None, n_docs: int) -> tuple[np.ndarray, ...]:
    """Distinct terms in order, where each begins, and its documents with their counts."""
    key = term * n_docs + doc
    if times is None:
        key.sort()
        at = _changes(key)
        tf, key = np.diff(np.append(at, len(key))), key[at]
    elif len(key):
        bits = int(times.max()).bit_length()
        if int(key.max()).bit_length() + bits < 63:
            key <<= bits
            key |= times
            key.sort()
            times = key & ((1 << bits) - 1)
            key >>= bits
        else:
            order = np.argsort(key, kind="stable")
            key, times = key[order], times[order]
        at = _changes(key)
        tf, key = np.add.reduceat(times, at), key[at]
    else:
        tf = key
    of_term, docs = np.divmod(key, n_docs)
    begins = _changes(of_term)
    return of_term[begins], begins, docs, tf


def _block_terms(
    texts: pa.Array, of_row: np.ndarray, splits: Sequence[tuple], pattern: str
) -> Iterator[tuple]:
    """``view, terms, begins, docs, tfs, spell`` for every kind of term of the texts of a block.

    ``splits``: names of views, how they split and, if not all, which terms they ask for.
    """
    code, words, row = _flat(pc.split_pattern(texts, " "))
    n_docs = int(of_row[-1]) + 1
    for view, split, *asked in splits:
        for term, at, times, spell in _view_terms(split, code, words, row, pattern, *asked):
            tallied = _tallied(term, of_row[at], times, n_docs)
            if len(tallied[0]):
                yield view, *tallied, spell


def term_blocks(text: DataFrame, views: Sequence[View]) -> DataFrame:
    """Terms of folded texts (source, pmcid, text), by blocks of neighbouring documents.

    Texts are dealt out by document and sorted, so only texts are shuffled, not their far more
    numerous terms. A row holds a term of a block: ``docs``, the numbers of the documents that
    have it, their counts ``tfs`` and the ``total`` of these. One row a block, without ``view``,
    holds the ``ids`` of its documents.
    """
    keep = ["source", "pmcid"]
    whole = F.coalesce("text", F.lit(""))
    dealt = by_document(text.select(*keep, whole.alias("text")), keep).sortWithinPartitions(*keep)
    splits, pattern = [(v.name, v.split) for v in views], word_pattern(text.sparkSession)
    schema = ["block", "source", "view", "term", "docs", "tfs", "total", "ids"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for place, (rows, of_row) in enumerate(_text_blocks(batches)):
            block, source = first + place, rows["source"][0].as_py()
            fixed = lambda n, view: [
                pa.array(np.full(n, block)), pa.array([source] * n, pa.string()), pa.array([view] * n, pa.string())
            ]
            ids = rows["pmcid"].take(pa.array(_changes(of_row))).to_pylist()
            none = [pa.nulls(1, t) for t in (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64())]
            yield pa.RecordBatch.from_arrays([*fixed(1, None), *none, pa.array([ids], pa.list_(pa.string()))], schema)
            for view, term, begins, docs, tf, spell in _block_terms(rows["text"].combine_chunks(), of_row, splits, pattern):
                ends = pa.array(np.append(begins, len(docs)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (docs, tf)]
                n, total = len(begins), np.add.reduceat(tf, begins)
                columns = [*fixed(n, view), spell(pa.array(term)), *lists, pa.array(total), pa.nulls(n, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, schema)

    return dealt.mapInArrow(count, _BLOCKS)


def by_document(documents: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One shuffle of the texts, so that the far more numerous terms are not shuffled."""
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return documents.repartition(parts, *keep)


def steady_sum(value: Column) -> Column:
    """Sum of doubles that does not depend on row order: the coarse parts add exactly."""
    grid = float(2**20)
    coarse = F.rint(value * grid) / grid
    return F.sum(coarse) + F.sum(value - coarse)


def _weight(view: Column, tf: Column, idf: Column, views: Sequence[View]) -> Column:
    damped = [v.name for v in views if v.sublinear]
    count = F.when(view.isin(*damped), 1 + F.log(tf)).otherwise(tf) if damped else tf
    return count * idf


def _limits(views: Sequence[View], name: str, attribute: str, default) -> Column:
    chosen = F.lit(default)
    for v in views:
        value = getattr(v, attribute)
        chosen = F.when(F.col(name) == v.name, F.lit(default if value is None else value)).otherwise(
            chosen
        )
    return chosen


def _shares(names: pa.Array, shares: int) -> np.ndarray:
    """The share each term falls into, by a hash of its bytes that is the same in every block."""
    ends = np.frombuffer(names.buffers()[1], np.int32)[names.offset : names.offset + len(names) + 1].astype(np.int64)
    data = np.frombuffer(names.buffers()[2] or b"", np.uint8)
    out = np.empty(len(names), np.int64)
    for at in range(0, len(names), 1 << 16):
        some = ends[at : at + (1 << 16) + 1]
        place = _runs(np.zeros(len(some) - 1, np.int64), np.diff(some))
        powers = np.multiply.accumulate(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
        hashed = np.add.reduceat(data[some[0] : some[-1]].astype(np.uint64) * powers[place], some[:-1] - some[0])
        hashed ^= hashed >> np.uint64(29)
        hashed *= np.uint64(0xBF58476D1CE4E5B9)
        hashed ^= hashed >> np.uint64(32)
        out[at : at + len(some) - 1] = hashed % np.uint64(shares)
    return out


def _packed(*arrays: np.ndarray) -> tuple[int, bytes]:
    plain = b"".join(a.tobytes() for a in arrays)
    return len(plain), pa.Codec("zstd").compress(plain, asbytes=True)


def _unpacked(size: int, packed: bytes) -> memoryview:
    return memoryview(pa.Codec("zstd").decompress(packed, size, asbytes=True))


def _block_documents(rows: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Ids, texts and document numbers of the texts of a block, in one order whenever it is read."""
    rows = rows.take(pc.sort_indices(rows, [("pmcid", "ascending")])).combine_chunks()
    lists = rows["texts"].combine_chunks()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return rows["pmcid"].combine_chunks(), lists.flatten(), np.repeat(np.arange(len(lists)), lengths)


def _view_tables(texts: pa.Array, of_row: np.ndarray, splits, pattern: str, shares: int) -> Iterator[tuple]:
    """Per view: its kinds of terms, all their spellings, their shares and the order by share."""
    found = groupby(_block_terms(texts, of_row, splits, pattern), lambda kind: kind[0])
    for view, kinds in found:
        kinds = list(kinds)
        names = pa.concat_arrays([spell(pa.array(term)).cast(pa.string()) for _, term, *_, spell in kinds])
        share = _shares(names, shares)
        # Short numbers are ordered without comparisons.
        yield view, kinds, names, share, np.argsort(share.astype(np.uint16) if shares < 1 << 16 else share, kind="stable")


def count_shares(blocks: DataFrame, views: Sequence[View]) -> DataFrame:
    """``source, part, view, share, n, size, packed``: the terms of a block that fall into a share, packed.

    A block has a row for each share of the terms of its domain, not one a term. It holds the
    spellings, in how many documents of the block and how often each occurs.
    """
    splits, pattern = [(v.name, v.split) for v in views], word_pattern(blocks.sparkSession)
    schema = pa.schema([
        ("source", pa.string()), ("part", pa.int32()), ("view", pa.string()), ("share", pa.int32()),
        ("n_docs", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("packed", pa.binary()),
    ])

    def count(rows: pa.Table) -> pa.Table:
        source, part, shares, n_docs = (rows[c][0].as_py() for c in ("source", "part", "shares", "n_docs"))
        _, texts, of_row = _block_documents(rows)
        out = []
        for view, kinds, names, share, order in _view_tables(texts, of_row, splits, pattern, shares):
            df = np.concatenate([np.diff(np.append(begins, len(docs))) for _, _, begins, docs, *_ in kinds])[order]
            total = np.concatenate([np.add.reduceat(tf, begins) for _, _, begins, _, tf, _ in kinds])[order]
            names, share = names.take(pa.array(order)), share[order]
            ends = np.frombuffer(names.buffers()[1], np.int32)[: len(names) + 1]
            data = np.frombuffer(names.buffers()[2], np.uint8)
            cuts = np.append(_changes(share), len(share))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                held = _packed(df[a:b], total[a:b], np.diff(ends[a : b + 1]), data[ends[a] : ends[b]])
                out.append((source, part, view, int(share[a]), n_docs, int(b - a), *held))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)] if out else [pa.nulls(0, t) for t in schema.types], schema=schema)

    made = "source string, part int, view string, share int, n_docs long, n long, size long, packed binary"
    return blocks.groupBy("source", "part").applyInArrow(count, made)


def merge_shares(counted: DataFrame, views: Sequence[View]) -> DataFrame:
    """The terms of every share within the limits of document frequency, and for each block theirs.

    Rows with a ``term`` are the vocabulary: ``source, view, term, df, corpus_tf, n_docs``. The
    others have, for a block and a share, the frequencies of its terms in their order, packed; 0
    stands for a term outside the limits.
    """
    limits = {v.name: (v.min_df, v.max_df) for v in views}
    schema = pa.schema([
        ("source", pa.string()), ("view", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("corpus_tf", pa.int64()),
        ("n_docs", pa.int64()), ("part", pa.int32()), ("share", pa.int32()), ("size", pa.int64()), ("packed", pa.binary()),
    ])

    def merge(rows: pa.Table) -> pa.Table:
        source, view, share, n_docs = (rows[c][0].as_py() for c in ("source", "view", "share", "n_docs"))
        parts, sizes = rows["part"].to_pylist(), rows["n"].to_pylist()
        names, dfs, totals = [], [], []
        for n, size, packed in zip(sizes, rows["size"].to_pylist(), rows["packed"], strict=True):
            held = _unpacked(size, packed.as_buffer())
            dfs.append(np.frombuffer(held, np.int64, n))
            totals.append(np.frombuffer(held, np.int64, n, 8 * n))
            ends = np.append(0, np.cumsum(np.frombuffer(held, np.int32, n, 16 * n))).astype(np.int32)
            names.append(pa.StringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(held[20 * n :])))
        coded = pa.concat_arrays(names).dictionary_encode()
        code, terms = coded.indices.to_numpy(), coded.dictionary
        # Sums of whole numbers, exact in doubles.
        df, total = (np.bincount(code, np.concatenate(v), len(terms)).astype(np.int64) for v in (dfs, totals))
        least, most = limits[view]
        kept = (df >= least) & (df <= most * n_docs)
        at = np.flatnonzero(kept)
        of_blocks = np.split(np.where(kept, df, 0)[code], np.cumsum(sizes)[:-1])
        back = [_packed(held) for held in of_blocks]
        n, m = len(at), len(back)
        columns = {
            "source": [source] * (n + m), "view": [view] * (n + m),
            "term": pa.concat_arrays([terms.take(pa.array(at)), pa.nulls(m, pa.string())]),
            "df": pa.concat_arrays([pa.array(df[at]), pa.nulls(m, pa.int64())]),
            "corpus_tf": pa.concat_arrays([pa.array(total[at]), pa.nulls(m, pa.int64())]),
            "n_docs": np.full(n + m, n_docs), "part": [None] * n + parts, "share": [share] * (n + m),
            "size": [None] * n + [size for size, _ in back], "packed": [None] * n + [held for _, held in back],
        }
        return pa.table(columns, schema=schema)

    made = (
        "source string, view string, term string, df long, corpus_tf long, n_docs long, part int, share int, "
        "size long, packed binary"
    )
    return counted.groupBy("source", "view", "share").applyInArrow(merge, made)


def _damped(tf: np.ndarray, view: View) -> np.ndarray:
    return 1 + np.log(tf) if view.sublinear else tf.astype(float)


def _steady_sums(value: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """``steady_sum`` of an array by number."""
    coarse = np.rint(value * 2**20) / 2**20
    return np.bincount(of, coarse, n) + np.bincount(of, value - coarse, n)


def block_norms(blocks: DataFrame, found: DataFrame, views: Sequence[View]) -> DataFrame:
    """``source, view, pmcid, norm``: a block counts its texts again and weighs each term by its frequency.

    ``found`` has the frequencies of the terms of each block, so neither terms nor their
    documents are dealt out. A document without a term of the vocabulary has no norm.
    """
    splits, pattern = [(v.name, v.split) for v in views], word_pattern(blocks.sparkSession)
    named = {v.name: v for v in views}
    schema = pa.schema([("source", pa.string()), ("view", pa.string()), ("pmcid", pa.string()), ("norm", pa.float64())])

    def weigh(rows: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and found.num_rows:
            source, shares, n_docs = (rows[c][0].as_py() for c in ("source", "shares", "n_docs"))
            ids, texts, of_row = _block_documents(rows)
            for view, kinds, _, share, order in _view_tables(texts, of_row, splits, pattern, shares):
                of_view = found.filter(pc.equal(found["view"], view)).sort_by("share")
                held = [np.frombuffer(_unpacked(s.as_py(), p.as_buffer()), np.int64) for s, p in zip(of_view["size"], of_view["packed"])]
                df = np.empty(len(order), np.int64)
                if sum(map(len, held)) != len(order) or of_view["share"].to_pylist() != np.unique(share).tolist():
                    raise ContractError(f"a block of {source!r} has other terms than when they were counted")
                df[order] = np.concatenate(held)
                idf = np.where(df > 0, np.log((1 + n_docs) / (1 + df)) + 1, 0)
                squares, at = np.zeros(len(ids)), 0
                for _, term, begins, docs, tf, _ in kinds:
                    weight = _damped(tf, named[view]) * np.repeat(idf[at : at + len(term)], np.diff(np.append(begins, len(docs))))
                    squares += _steady_sums(weight * weight, docs, len(ids))
                    at += len(term)
                at = np.flatnonzero(squares > 0)
                out.append(pa.table([[source] * len(at), [view] * len(at), ids.take(pa.array(at)), np.sqrt(squares[at])], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    keys = ["source", "part"]
    both = blocks.groupBy(*keys).cogroup(found.groupBy(*keys))
    return both.applyInArrow(weigh, "source string, view string, pmcid string, norm double").filter("pmcid IS NOT NULL")


def _capped(vocabulary: DataFrame, views: Sequence[View]) -> DataFrame | None:
    """The vocabulary without terms past the cap of their domain and view; None where no cap is reached."""
    cap = _limits(views, "view", "max_features", 2**62)
    crowded = (
        vocabulary.groupBy("source", "view")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > cap)
        .select("source", "view")
    )
    if crowded.limit(1).count() == 0:
        return None
    over = vocabulary.join(crowded, ["source", "view"], "left_semi")
    ranked = ordered_positions(
        over, ["source", "view"], [F.col("corpus_tf").desc(), F.col("term")], "_place"
    )
    kept = ranked.filter(F.col("_place") <= cap).drop("_place")
    return vocabulary.join(crowded, ["source", "view"], "left_anti").unionByName(kept)


def _capped_norms(blocks: DataFrame, vocabulary: DataFrame, views: Sequence[View]) -> DataFrame:
    """``source, view, pmcid, norm`` where a cap took terms out: the terms of the blocks meet what is left."""
    weight = _weight(F.col("view"), F.col("tf"), F.col("idf"), views)
    terms = blocks.filter("view IS NOT NULL").drop("ids")
    lengths = (
        _postings(terms.join(vocabulary.select(*_TERM, "idf"), _TERM[::-1]), "view", "idf")
        .groupBy("block", "doc", "view")
        .agg(F.sqrt(steady_sum(weight * weight)).alias("norm"))
    )
    ids = blocks.filter("view IS NULL").select("block", "source", F.posexplode("ids").alias("doc", "pmcid"))
    return lengths.join(ids.filter("pmcid IS NOT NULL"), ["block", "doc"]).select("source", "view", "pmcid", "norm")


def _postings(rows: DataFrame, *keep: str) -> DataFrame:
    """``block, doc, tf`` and the columns ``keep``: a row for every document of the rows of terms."""
    held = rows.select("block", "tfs", *keep, F.posexplode("docs").alias("_i", "doc"))
    return held.select("block", "doc", F.col("tfs")[F.col("_i")].alias("tf"), *keep)


def _named(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("source").cast("string").alias("source"),
        F.col("pmcid").cast("string").alias("pmcid"),
        "title",
        "case_summary",
    )


def build_index(
    documents: DataFrame,
    views: Sequence[View] = RELEASE_VIEWS,
    extra: DataFrame | None = None,
    path: str | None = None,
) -> Index:
    """Fit every domain on its own documents only, in tables below ``path``. ``extra`` rows
    (source, text) join the fit without being searchable, as the global baseline does with its
    query."""
    spark = documents.sparkSession
    path = path or scratch_path(spark, "index")
    named = _named(documents)
    # Apart, as the folded text is read several times by the next step.
    eligible = spread(named).select("source", "pmcid", eligible_text(F.col("title"), F.col("case_summary")).alias("text"))
    fitted = eligible.withColumn("text", strip_accents(F.col("text")))
    sizes = named.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    if extra is not None:
        other = extra.select(
            F.col("source").cast("string").alias("source"),
            F.lit(None).cast("string").alias("pmcid"),
            strip_accents(normalize_text(F.col("text"))).alias("text"),
        )
        fitted = fitted.unionByName(other)
        more = extra.groupBy(F.col("source").cast("string").alias("source")).count()
        sizes = sizes.join(more, "source", "left").select(
            "source", (F.col("n_docs") + F.coalesce("count", F.lit(0))).alias("n_docs")
        )
    ids = named.select("source", "pmcid")
    if extra is not None:
        ids = ids.unionByName(other.select("source", "pmcid"))
    store_texts(fitted, ids, f"{path}/texts")
    texts = spark.read.parquet(f"{path}/texts")
    # A block of a domain holds about BLOCK_TEXT bytes and at most some BLOCK_ROWS documents.
    held = texts.groupBy("source").agg(F.sum("bytes").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    parts = F.ceil(F.greatest(F.col("_bytes") / BLOCK_TEXT, F.col("_rows") / BLOCK_ROWS, F.lit(1.0)))
    parted = sizes.join(held, "source").select(
        "source", "n_docs", parts.cast("int").alias("parts"), F.ceil(parts * SHARES).cast("int").alias("shares")
    )
    part = F.pmod(F.xxhash64("source", "pmcid"), F.col("parts")).cast("int")
    keys = ["source", "part"]
    sized = texts.drop("bytes").join(written(parted, "sizes"), "source").withColumn("part", part).drop("parts")
    blocks = by_document(sized, keys)
    merge_shares(count_shares(blocks, views), views).write.option("compression", "zstd").parquet(f"{path}/counted")
    merged = spark.read.parquet(f"{path}/counted")
    capped = _capped(_vocabulary(merged), views)
    if capped is None:
        norms = block_norms(blocks, merged.filter("term IS NULL"), views)
    else:
        capped.write.parquet(f"{path}/vocabulary")
        flat = texts.select("source", "pmcid", F.explode("texts").alias("text"))
        norms = _capped_norms(written(term_blocks(flat, views), "terms"), spark.read.parquet(f"{path}/vocabulary"), views)
    norms.write.parquet(f"{path}/norms")
    named.select("pmcid", "source").write.parquet(f"{path}/documents")
    return read_index(spark, path, views)


def store_texts(text: DataFrame, ids: DataFrame, path: str) -> None:
    """``source, pmcid, texts, bytes`` of every document, written to ``path``.

    Texts stay where they are; only where ids (source, pmcid) occur twice are they brought together.
    """
    repeated = ids.groupBy("source", "pmcid").count().filter("count > 1")
    whole = F.coalesce("text", F.lit(""))
    if repeated.limit(1).count():
        documents = text.groupBy("source", "pmcid").agg(F.sort_array(F.collect_list(whole)).alias("texts"))
    else:
        documents = text.select("source", "pmcid", F.array(whole).alias("texts"))
    size = F.aggregate("texts", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t))
    documents.withColumn("bytes", size).write.option("compression", "zstd").parquet(path)


def _vocabulary(merged: DataFrame) -> DataFrame:
    """The rows with a term and their smoothed idf."""
    idf = F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1
    return merged.filter("term IS NOT NULL").select(*_TERM, "df", "corpus_tf", "n_docs", idf.alias("idf"))


def read_index(spark: SparkSession, path: str, views: Sequence[View] = RELEASE_VIEWS) -> Index:
    """The index whose tables lie below ``path``; a capped vocabulary replaces the counted one."""
    read = spark.read.parquet
    capped = path_exists(spark, f"{path}/vocabulary")
    vocabulary = read(f"{path}/vocabulary") if capped else _vocabulary(read(f"{path}/counted"))
    texts = read(f"{path}/texts")
    flat = texts.select("source", "pmcid", F.explode("texts").alias("text"))
    terms = term_blocks(flat, views).filter("view IS NOT NULL").drop("ids")
    return Index(read(f"{path}/documents"), texts, terms, vocabulary, read(f"{path}/norms"), views)


def _receipt(index: Index) -> DataFrame:
    """``table, n_rows, digest`` of what a request reads; sums of row hashes, as tables are large."""
    parts = []
    for name in ("documents", "texts", "vocabulary", "norms"):
        rows = getattr(index, name)
        hashed = rows.select(F.xxhash64(*sorted(rows.columns)).alias("_h"))
        sums = [F.bit_xor("_h"), F.sum(F.shiftright("_h", 32)), F.sum(F.col("_h").bitwiseAND(0xFFFFFFFF))]
        digest = F.concat_ws(":", *[F.coalesce(v, F.lit(0)).cast("string") for v in sums])
        counted = hashed.agg(F.count(F.lit(1)).alias("n_rows"), digest.alias("digest"))
        parts.append(counted.select(F.lit(name).alias("table"), "n_rows", "digest"))
    return reduce(DataFrame.unionByName, parts)


def index_place(documents: DataFrame, views: Sequence[View] = RELEASE_VIEWS, extra: DataFrame | None = None) -> str:
    """Where the index of this corpus lies: a path named by the digest of its rows and settings."""
    settings = spec_fingerprint({"views": [asdict(v) for v in views]})
    parts = [table_digest(_named(documents), ["source", "pmcid", "title", "case_summary"], settings).first().digest]
    if extra is not None:
        parts.append(table_digest(extra, ["source", "text"], settings).first().digest)
    name = spec_fingerprint({"parts": parts})
    return f"{shared_folder(documents.sparkSession)}/indexes/{name}"


# Indexes that this process has compared with their receipts.
_verified: set[str] = set()


def shared_index(
    documents: DataFrame, views: Sequence[View] = RELEASE_VIEWS, extra: DataFrame | None = None
) -> Index:
    """The stored index of a corpus, built by the first request that needs it.

    It is found by the digest of the corpus, so changed documents get another. The receipt is
    written last and names the folder: a build that was cut short is not found. A process
    compares the tables with the receipt once, and builds again what has been changed since.
    """
    spark = documents.sparkSession
    place = index_place(documents, views, extra)
    kinds = "folder string, receipt array<struct<table: string, n_rows: bigint, digest: string>>"
    lines = lambda index: sorted(tuple(r) for r in _receipt(index).collect())
    if path_exists(spark, f"{place}/receipt"):
        [known] = spark.read.schema(kinds).json(f"{place}/receipt").collect()
        index = read_index(spark, f"{place}/{known.folder}", views)
        if place in _verified or lines(index) == sorted(tuple(r) for r in known.receipt):
            _verified.add(place)
            return index
    folder = uuid.uuid4().hex
    index = build_index(documents, views, extra, f"{place}/{folder}")
    row = spark.createDataFrame([(folder, lines(index))], kinds)
    row.coalesce(1).write.mode("overwrite").json(f"{place}/receipt")
    _verified.add(place)
    return index


def remove_index(
    documents: DataFrame, views: Sequence[View] = RELEASE_VIEWS, extra: DataFrame | None = None
) -> bool:
    """Remove the stored index of a corpus; was there one?"""
    place = index_place(documents, views, extra)
    _verified.discard(place)
    return remove_path(documents.sparkSession, place)


def query_weights(index: Index, facets: DataFrame) -> DataFrame:
    """``source, view, term, idf, weight`` of the request, unit length per domain and view.

    ``facets``: source, text, one row per domain. Terms outside the vocabulary drop out.
    """
    asked = facets.select(
        F.col("source").cast("string").alias("source"),
        strip_accents(normalize_text(F.col("text"))).alias("text"),
    )
    # Stored, so that the planner knows they are few and leaves the vocabulary where it is.
    counts = written(term_counts(asked, index.views, ["source"]), "asked")
    raw = _weight(F.col("view"), F.col("tf"), F.col("idf"), index.views)
    known = counts.join(index.vocabulary.select(*_TERM, "idf"), _TERM).withColumn("_w", raw)
    lengths = known.groupBy("source", "view").agg(
        F.sqrt(steady_sum(F.col("_w") * F.col("_w"))).alias("_length")
    )
    return known.join(lengths, ["source", "view"]).select(
        *_TERM, "idf", (F.col("_w") / F.col("_length")).alias("weight")
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents in pieces of bounded text."""
    for batch in batches:
        size = np.cumsum(batch.column("bytes").to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(size[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + BLOCK_TEXT, "right")))
            yield batch.slice(at, min(to - at, BLOCK_ROWS))
            at += min(to - at, BLOCK_ROWS)


def term_dots(texts: DataFrame, asked: Sequence[tuple], views: Sequence[View]) -> DataFrame:
    """``source, view, pmcid, dot`` of the documents that share a term with the request.

    ``asked`` has rows (source, view, term, idf, weight). Texts are counted where they lie; of
    their terms only those of the request are kept, and only the dots leave a task.
    """
    pattern = word_pattern(texts.sparkSession)
    sources = {name: i for i, name in enumerate(sorted({r[0] for r in asked}))}
    tables = []
    for view in views:
        mine = [r for r in asked if r[1] == view.name]
        terms = sorted({r[2] for r in mine})
        place = {t: i for i, t in enumerate(terms)}
        key = np.array([sources[r[0]] * len(terms) + place[r[2]] for r in mine], np.int64)
        order = np.argsort(key)
        tables.append((view, terms, key[order], *(np.array([r[c] for r in mine], float)[order] for c in (3, 4))))
    schema = pa.schema([("source", pa.string()), ("view", pa.string()), ("pmcid", pa.string()), ("dot", pa.float64())])

    def dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [(view, pa.array(terms, pa.string()), *rest) for view, terms, *rest in tables if terms]
        for rows in _pieces(batches):
            lists, source = rows.column("texts"), rows.column("source")
            domain = np.array([sources.get(s, -1) for s in source.to_pylist()], np.int64)
            of_row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            n = len(lists)
            sums = {view.name: (np.zeros(n), np.zeros(n, bool)) for view, *_ in wanted}
            splits = [(view.name, view.split, terms) for view, terms, *_ in wanted]
            by_name = {view.name: (view, *rest) for view, *rest in wanted}
            for name, term, begins, docs, tf, spell in _block_terms(lists.flatten(), of_row, splits, pattern):
                (total, hit), (view, terms, keys, idf, weight) = sums[name], by_name[name]
                place = pc.fill_null(pc.index_in(spell(pa.array(term)), terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                place = np.repeat(place, np.diff(np.append(begins, len(docs))))
                some = np.flatnonzero((place >= 0) & (domain[docs] >= 0))
                key = domain[docs[some]] * len(terms) + place[some]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                same = keys[at] == key
                some, at = some[same], at[same]
                total += _steady_sums(_damped(tf[some], view) * idf[at] * weight[at], docs[some], n)
                hit[docs[some]] = True
            for name, (total, hit) in sums.items():
                held = pa.array(np.flatnonzero(hit))
                columns = [source.take(held), pa.array([name] * len(held), pa.string()), rows.column("pmcid").take(held), pa.array(total[hit])]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    searched = texts.filter("source IS NOT NULL AND pmcid IS NOT NULL")
    return searched.mapInArrow(dots, "source string, view string, pmcid string, dot double")


def cosine_scores(index: Index, facets: DataFrame) -> DataFrame:
    """``source, view, pmcid, score`` of every document; 0 without a common term.

    The request's terms are few whatever the corpus size; they travel to the texts, and a row
    with the dot of each document and view meets the norms.
    """
    asked = [tuple(r) for r in query_weights(index, facets).select(*_TERM, "idf", "weight").collect()]
    hits = term_dots(index.texts, asked, index.views).join(index.norms, ["source", "view", "pmcid"]).select(
        "source", "view", "pmcid", (F.col("dot") / F.col("norm")).alias("score")
    )
    names = F.array(*[F.lit(v.name) for v in index.views])
    every = index.documents.select("source", "pmcid", F.explode(names).alias("view"))
    return every.join(hits, ["source", "view", "pmcid"], "left").withColumn(
        "score", F.round(F.coalesce("score", F.lit(0.0)), SCORE_DIGITS)
    )


def rank_positions(scores: DataFrame, group: Sequence[str], name: str = "rank") -> DataFrame:
    """1-based rank by score, highest first, ties by id in text order."""
    return ordered_positions(scores, group, [F.col("score").desc(), F.col("pmcid")], name)


def rrf(*ranks: Column, offset: int = RRF_OFFSET) -> Column:
    """Reciprocal rank fusion value."""
    total = F.lit(0.0)
    for r in ranks:
        total = total + F.lit(1.0) / (F.lit(offset) + r)
    return total


def fused_ranks(index: Index, facets: DataFrame) -> DataFrame:
    """``source, pmcid, score, rank``: fusion of the views' ranks, ranked within the domain."""
    ranked = rank_positions(cosine_scores(index, facets), ["source", "view"], "_r")
    fused = ranked.groupBy("source", "pmcid").agg(
        *[F.max(F.when(F.col("view") == v.name, F.col("_r"))).alias(f"_{v.name}") for v in index.views]
    )
    value = rrf(*[F.col(f"_{v.name}") for v in index.views])
    scored = fused.select("source", "pmcid", value.alias("score"))
    return rank_positions(scored, ["source"])


def _ranks_of(scores: DataFrame, chosen: DataFrame) -> DataFrame:
    """``source, view, pmcid, rank`` of the chosen documents, without sorting the others.

    Every row counts how many of the chosen keys are not behind it; summed up by that number,
    the rows ahead of each chosen one are known. ``chosen`` has few rows a domain and view.
    """
    key = F.struct((-F.col("score")).alias("below"), F.col("pmcid"))
    keys = scores.join(F.broadcast(chosen), ["source", "pmcid"], "left_semi").groupBy("source", "view").agg(
        F.array_sort(F.collect_list(key)).alias("keys")
    )
    keys = written(keys, "chosen-keys")
    ahead = scores.join(F.broadcast(keys), ["source", "view"]).filter(key < F.element_at("keys", -1))
    counts = ahead.groupBy("source", "view", F.size(F.filter("keys", lambda k: k <= key)).alias("place")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # Row counts by place, next to the keys: the rank of key j is one more than all at most j.
    listed = keys.join(
        counts.groupBy("source", "view").agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("counts")),
        ["source", "view"],
        "left",
    )
    placed = listed.select("source", "view", "counts", F.posexplode("keys").alias("place", "key"))
    here = F.coalesce(F.try_element_at("counts", F.col("place")), F.lit(0))
    upto = F.sum(here).over(W.partitionBy("source", "view").orderBy("place"))
    return placed.select("source", "view", F.col("key.pmcid").alias("pmcid"), (upto + 1).alias("rank"))


def best_fused(index: Index, facets: DataFrame, k: int, depth: int | None = None) -> DataFrame:
    """``source, pmcid, score, rank`` of the best ``k`` of every domain by fused rank.

    The best of each view are candidates; the ranks they miss in other views are counted. Every
    other document is behind the last of them in all views, which bounds its fusion value. Where
    the k-th candidate does not exceed the bound, more than the first ``depth`` are taken.
    """
    scores = written(cosine_scores(index, facets), "scores")
    sizes = {r.source: r["count"] for r in index.documents.groupBy("source").count().collect()}
    depth = depth or 4 * k
    while True:
        best = [
            scores.filter((F.col("source").eqNullSafe(source)) & (F.col("view") == v.name))
            .orderBy(F.col("score").desc(), "pmcid")
            .limit(depth)
            .select("source", "pmcid")
            for source in sizes
            for v in index.views
        ]
        if not best:
            return fused_ranks(index, facets)
        chosen = written(reduce(DataFrame.unionByName, best).distinct(), "candidates")
        ranks = _ranks_of(scores, chosen).groupBy("source", "pmcid").agg(
            *[F.max(F.when(F.col("view") == v.name, F.col("rank"))).alias(f"_{v.name}") for v in index.views]
        )
        fused = ranks.select("source", "pmcid", rrf(*[F.col(f"_{v.name}") for v in index.views]).alias("score"))
        order = W.partitionBy("source").orderBy(F.col("score").desc(), "pmcid")
        fused = fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        fused = written(fused, "fused")
        last = {r.source: r.score for r in fused.filter(F.col("rank") == k).collect()}
        bound = sum(1.0 / (RRF_OFFSET + depth + 1) for _ in index.views)
        if all(size <= depth or last.get(source, 0.0) > bound for source, size in sizes.items()):
            return fused
        depth *= 4


def release_cycle(requests: DataFrame, domains: Sequence[str] = DOMAINS) -> DataFrame:
    """``query_id, top_k, source, cycle_pos``: the domain order of a request's panel.

    The phase is the byte total of the normalised id; odd sizes run forward from it and even
    sizes backward, over the domains in alphabetical order.
    """
    base = sorted(domains)
    m = len(base)
    phased = requests.withColumn("_phase", F.pmod(byte_total(normalize_text(F.col("query_id"))), F.lit(m)))
    places = F.posexplode(F.array(*[F.lit(d) for d in base])).alias("_i", "source")
    forward = F.pmod(F.col("_i") - F.col("_phase"), F.lit(m))
    backward = F.pmod(F.col("_phase") - F.col("_i"), F.lit(m))
    turn = F.when(F.pmod(F.col("top_k"), F.lit(2)) == 1, forward).otherwise(backward)
    return phased.select("*", places).select(
        "query_id", "top_k", "source", turn.cast("int").alias("cycle_pos")
    )


def balanced_panel(ranked: DataFrame, cycle: DataFrame, k: int) -> DataFrame:
    """Round robin over the domains by rank; a domain that runs out is passed over.

    ``k`` below 1 or above the number of rows is an error.
    """
    if k < 1:
        raise ContractError("a panel needs at least one place")
    # One row per domain: the cycle is bounded by the list of domains.
    turns = F.broadcast(cycle.select("source", "cycle_pos"))
    first = ranked.join(turns, "source").orderBy("rank", "cycle_pos").limit(k)
    place = F.row_number().over(W.orderBy("rank", "cycle_pos"))
    panel = first.select(
        place.alias("position"), "pmcid", "source", F.round("score", SCORE_DIGITS).alias("score")
    )
    # An aggregate has its row also over an empty ranking, where the panel has none to fail on.
    message = F.lit("fewer ranked rows than places of the panel")
    size = first.agg(F.count(F.lit(1)).alias("_size"))
    whole = size.select(F.when(F.col("_size") < k, F.raise_error(message)).alias("_short"))
    checked = panel.join(F.broadcast(whole), F.lit(True), "right").filter("_short IS NULL")
    return checked.select(F.col("position").cast("int").alias("position"), "pmcid", "source", "score")


def retrieve(
    documents: DataFrame,
    query_id: str,
    facets: DataFrame,
    top_k: int = 12,
    domains: Sequence[str] = DOMAINS,
    index: Index | None = None,
) -> DataFrame:
    """The panel of a request: ``position, pmcid, source, score``."""
    known = documents.filter(F.col("source").isin(*domains)) if index is None else None
    index = index or shared_index(known)
    spark = documents.sparkSession
    request = spark.createDataFrame([(query_id, top_k)], "query_id string, top_k int")
    return balanced_panel(best_fused(index, facets, top_k), release_cycle(request, domains), top_k)


def domain_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def global_baseline(documents: DataFrame, facets: DataFrame, top_k: int = 12) -> DataFrame:
    """The deployed candidate, kept for drift counts: one vocabulary that includes the query."""
    everything = F.lit("all")
    query = facets.agg(
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("source", "text"))), lambda x: x["text"])).alias("text")
    ).withColumn("source", everything)
    flat = documents.withColumn("source", everything)
    index = shared_index(flat, GLOBAL_VIEWS, extra=query)
    scores = cosine_scores(index, query).select("pmcid", "score")
    best = scores.orderBy(F.col("score").desc(), "pmcid").limit(top_k)
    place = F.row_number().over(W.orderBy(F.col("score").desc(), F.col("pmcid")))
    home = documents.select(F.col("pmcid").cast("string").alias("pmcid"), "source")
    return best.withColumn("position", place).join(home, "pmcid").select(
        "position", "pmcid", "source", "score"
    )


def vocabulary_receipt(index: Index, facets: DataFrame) -> DataFrame:
    """Per domain and view: dictionary size and how many request terms are in it."""
    sizes = index.vocabulary.groupBy("source", "view").agg(F.count(F.lit(1)).alias("terms"))
    asked = query_weights(index, facets).groupBy("source", "view").agg(
        F.count(F.lit(1)).alias("request_terms")
    )
    return sizes.join(asked, ["source", "view"], "left").na.fill(0, ["request_terms"])


def anchor_positions(index: Index, facets: DataFrame, anchors: DataFrame) -> DataFrame:
    """Rank of every anchor case (source, pmcid) in each view."""
    ranked = rank_positions(cosine_scores(index, facets), ["source", "view"])
    return ranked.join(anchors.select("source", "pmcid"), ["source", "pmcid"], "left_semi").select(
        "source", "view", "pmcid", "rank"
    )


def facet_statistics(requests: DataFrame) -> DataFrame:
    """``query_id, facet, n_chars`` from a map column of facets."""
    return requests.select("query_id", F.explode("facets").alias("facet", "_text")).select(
        "query_id", "facet", F.length("_text").alias("n_chars")
    )


def sample_prefixes(documents: DataFrame, position: str, length: int = 150) -> DataFrame:
    """First record of every domain with a prefix of its summary."""
    row = F.struct("pmcid", "title", F.substring("case_summary", 1, length).alias("summary_prefix"))
    first = documents.groupBy("source").agg(F.min_by(row, position).alias("_r"))
    return first.select("source", "_r.*")
