"""Text normalisation. Unicode folding has no built-in, so non-ASCII rows visit Python in
Arrow batches; ASCII rows are passed as null and cost nothing there."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NON_ASCII = r"[^\x00-\x7F]"
# What counts as white space once compatibility forms are folded.
_SPACE = r"[\s\x0B\x1C-\x1F\x85\x{1680}\x{2028}\x{2029}]+"


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def _without_marks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    class Kept(dict):
        """Code point → itself, or None for a combining mark; filled as letters turn up."""

        def __missing__(self, point: int) -> int | None:
            self[point] = None if unicodedata.combining(chr(point)) else point
            return self[point]

    kept = Kept()
    for text in batches:
        yield text.map(
            lambda t: unicodedata.normalize("NFKD", t).translate(kept), na_action="ignore"
        )


def _where_non_ascii(text: Column, fold) -> Column:
    return F.coalesce(fold(F.when(text.rlike(_NON_ASCII), text)), text)


def normalize_text(text: Column) -> Column:
    """NFKC, lower case, white space collapsed to one blank, trimmed."""
    folded = F.lower(_where_non_ascii(text.cast("string"), _nfkc))
    return F.trim(F.regexp_replace(folded, _SPACE, " "))


def strip_accents(text: Column) -> Column:
    return _where_non_ascii(text, _without_marks)


def eligible_text(title: Column, summary: Column) -> Column:
    """What may be searched before the outcome is known: title and summary, nothing else."""
    blank = F.lit("")
    return normalize_text(F.concat_ws("\n", F.coalesce(title, blank), F.coalesce(summary, blank)))


def word_terms(text: Column) -> Column:
    """Words of two or more letters, digits or underscores, and pairs of neighbours."""
    words = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))

    def with_pairs(w: Column) -> Column:
        left = F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0)))
        right = F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0)))
        return F.concat(w, F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(" "), b)))

    return with_pairs(words)


def words_only(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))


def edge_grams(word: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Character n-grams of one word padded with a blank on both sides."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    length = F.length(padded)
    runs = [
        F.when(
            length >= n,
            F.transform(F.sequence(F.lit(1), length - (n - 1)), lambda i: F.substring(padded, i, n)),
        ).otherwise(F.array().cast("array<string>"))
        for n in sizes
    ]
    return F.concat(*runs)


def char_terms(text: Column) -> Column:
    words = F.filter(F.split(text, " "), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: edge_grams(w)))


def byte_total(text: Column) -> Column:
    """Sum of the UTF-8 bytes of a text."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    values = F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("long"))
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)
