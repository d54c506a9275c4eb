"""Token counts of byte-level BPE vocabularies, without producing identifiers.

A word's bytes form a linked list. A heap holds every adjacent pair that has a rank; the
lowest rank, leftmost first, is merged until none is left. The count is the number of bytes
minus the number of merges. Counts of words are remembered per worker, up to a bound.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Remembered, bounded_batches, kept, share

WORDS_KEPT = 300_000
# Above this many characters a text is walked match by match instead of listing its words.
LONG_TEXT = 1 << 20
UNEVEN = -(1 << 40)

# Fixed value: the public split pattern of this family of vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself, or the next free one from 256."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return {b: chr(b if b in visible else next(spare)) for b in range(256)}


def load_merges(path: str) -> dict:
    """Ranks of a byte-level vocabulary file as plain values; size bounded by the vocabulary."""
    with open(path, encoding="utf-8") as file:
        parsed = json.load(file)
    vocabulary = parsed["model"]["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in parsed["model"]["merges"]]
    letters = byte_letters()
    return {
        "bytes": [vocabulary[letters[b]] for b in range(256)],
        "pairs": [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs],
        "specials": [t["content"] for t in parsed["added_tokens"]],
    }


class PairMerger:
    """Counts what remains of a byte string after all merges."""

    def __init__(self, tables: dict):
        self.first = tables["bytes"]
        self.width = 1 + max(max(p) for p in tables["pairs"])
        self.rank = {a * self.width + b: r for r, (a, b, _) in enumerate(tables["pairs"])}
        self.made = [c for _, _, c in tables["pairs"]]

    def count(self, word: bytes) -> int:
        n, width, rank, made = len(word), self.width, self.rank, self.made
        symbols = [self.first[b] for b in word]
        if n < 2:
            return n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # An entry is rank * n + place: the lowest rank first, then the leftmost.
        found = [rank.get(a * width + b) for a, b in pairwise(symbols)]
        heap = [r * n + i for i, r in enumerate(found) if r is not None]
        heapify(heap)
        merges = 0
        while heap:
            r, i = divmod(heappop(heap), n)
            j = after[i]
            if symbols[i] < 0 or j >= n or rank.get(symbols[i] * width + symbols[j]) != r:
                continue  # one of the two has been merged meanwhile
            new = symbols[i] = made[r]
            symbols[j] = -1
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                s = rank.get(new * width + symbols[k])
                if s is not None:
                    heappush(heap, s * n + i)
            h = before[i]
            if h >= 0:
                s = rank.get(symbols[h] * width + new)
                if s is not None:
                    heappush(heap, s * n + h)
        return n - merges


class TextCounter:
    """Counts of whole texts; those of words and of blank-separated chunks are remembered."""

    def __init__(self, tables: dict):
        merger = PairMerger(tables)
        split = self.split = regex.compile(SPLIT)
        words = self.words = Remembered(lambda w: merger.count(w.encode()), WORDS_KEPT)

        def chunk(text: str) -> int:
            # White space beside a blank belongs to one run with it: then chunks do not stand alone.
            if text in ("", " ") or text[1:2].isspace() or text[-1].isspace():
                return UNEVEN
            return sum(map(words.__getitem__, split.findall(text)))

        self.chunks = Remembered(chunk, WORDS_KEPT)
        marks = sorted(tables["specials"], key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, marks))) if marks else None

    def plain(self, text: str) -> int:
        if not text:
            return 0
        if len(text) >= LONG_TEXT:
            return sum(self.words[m.group()] for m in self.split.finditer(text))
        first, *rest = text.split(" ")
        of = self.chunks
        total = of[first] + sum([of[" " + c] for c in rest])
        return total if total >= 0 else sum(map(self.words.__getitem__, self.split.findall(text)))

    def count(self, text: str) -> int:
        if self.specials is None:
            return self.plain(text)
        parts = self.specials.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


def token_counts(df: DataFrame, text: Column, path: str) -> Column:
    """The number of tokens of ``text`` under the vocabulary file at ``path``.

    Null and empty texts have none. A special token's string inside a text is one token, as
    the library treats it by default; none is added. Repeated rows are counted alike. Code
    points that the installed Unicode tables do not know yet split like symbols.
    """
    bounded_batches(df.sparkSession)
    shared = share(df, load_merges(path))

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = kept(shared.value, "counter", TextCounter)
        for texts in batches:
            yield pd.Series([counter.count(t) if t else 0 for t in texts], dtype="int64")

    return counted(text)
