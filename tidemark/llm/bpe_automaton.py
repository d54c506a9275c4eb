"""BPE encoding and decoding by a deterministic automaton over tokens.

The automaton starts with one state in which every letter loops. Each merge ``u v -> w`` is
a gadget: arcs ``u`` are led to a copy of their target without the arc ``v``, and wherever an
arc ``u`` leaves, an arc ``w`` is added to where ``v`` would have led. All arcs with one label
share their target, so a gadget adds one state. A state is therefore a label and a time: its
history is the splits of that label back to the label's birth, then those of the label's right
part, and so on. Storing when each split happened is enough to tell which arcs leave a state.
Every word has exactly one path from the start, and its labels are the word's tokens.

Encoding walks a word once: the token that ends the path of a prefix is the one suffix whose
arc leaves the state reached before it. Transitions are table look-ups, filled on first use.
Decoding emits the labels of the arcs that identifiers name; it knows nothing of the text.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Remembered, bounded_batches, kept, share
from tidemark.llm.token_counts import byte_letters

WORDS_KEPT = 150_000
TRANSITIONS_KEPT = 500_000
LONG_TEXT = 1 << 20
LONG_WORD = 64

# The split pattern of this family of vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def load_tables(path: str) -> dict:
    """Labels and merges of a vocabulary file; size bounded by the vocabulary."""
    with open(path, encoding="utf-8") as file:
        parsed = json.load(file)
    model = parsed["model"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return {
        "vocab": model["vocab"],
        "merges": [tuple(m) for m in merges],
        "end": model["end_of_word_suffix"] or "",
        "specials": {t["content"]: t["id"] for t in parsed["added_tokens"]},
    }


class Automaton:
    """Arcs and splits after all merges; ``allows`` tells whether an arc follows another."""

    def __init__(self, letters: list[str], merges: list[tuple[str, str]]):
        self.label: list[str] = list(letters)
        self.size: list[int] = [1] * len(letters)
        self.made: list[int] = [-1] * len(letters)
        self.left: list[int] = [-1] * len(letters)
        self.right: list[int] = [-1] * len(letters)
        self.split: dict[tuple[int, int], int] = {}
        arc_of = {label: i for i, label in enumerate(letters)}
        for time, (a, b) in enumerate(merges):
            u, v = arc_of.get(a), arc_of.get(b)
            if u is not None and v is not None and self.allows(u, v):
                arc_of.setdefault(a + b, self.gadget(time, u, v))

    def gadget(self, time: int, u: int, v: int) -> int:
        """Split the target of ``u``, which loses ``v``; add the arc of both."""
        self.split[u, v] = 2 * time
        self.label.append(self.label[u] + self.label[v])
        self.size.append(self.size[u] + self.size[v])
        self.made.append(2 * time + 1)
        self.left.append(u)
        self.right.append(v)
        return len(self.label) - 1

    def allows(self, before: int, arc: int) -> bool:
        """Whether ``arc`` leaves the target of ``before``, from the newest split backwards."""
        made, split = self.made, self.split
        until = float("inf")
        while True:
            lost = split.get((before, arc))
            if lost is not None and lost < until:
                return False
            if made[arc] < 0 and made[before] < 0:
                return True
            if made[arc] > made[before]:
                until, arc = min(until, made[arc]), self.left[arc]
            else:
                until, before = min(until, made[before] - 1), self.right[before]


class Encoder:
    """Words to arcs by the automaton; arcs to identifiers and labels."""

    def __init__(self, tables: dict):
        end, vocab = tables["end"], tables["vocab"]
        self.byte_letter = byte_letters()
        letters = list(self.byte_letter.values())
        alphabet = [*letters, *[c + end for c in letters]] if end else letters
        auto = self.automaton = Automaton(alphabet, tables["merges"])
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for arc, label in enumerate(auto.label):
            ends = not end or label.endswith(end)
            if ends:
                self.final.setdefault(label[: auto.size[arc]], arc)
            if not end or not ends:
                self.inner.setdefault(label, arc)
        self.longest = max(auto.size)
        self.identifier = [vocab[x].to_bytes(4, "little") for x in auto.label]
        width, allows = len(auto.label), auto.allows
        self.width = width
        self.prefixes = Remembered(self.prefix_arc, WORDS_KEPT)
        self.step = Remembered(lambda k: allows(k // width, k % width), TRANSITIONS_KEPT)

    def find(self, text: str, arcs_of: dict[str, int], last) -> int:
        """The arc that ends the path of ``text``: the one suffix that its prefix allows."""
        width, step = self.width, self.step
        for start in range(max(0, len(text) - self.longest), len(text)):
            arc = arcs_of.get(text[start:])
            if arc is not None and (start == 0 or step[last(text[:start]) * width + arc]):
                return arc
        raise ValueError("a letter has no arc")

    def prefix_arc(self, prefix: str) -> int:
        return self.find(prefix, self.inner, self.prefixes.__getitem__)

    def arcs(self, word: str) -> list[int]:
        """The labels of the only path that spells ``word``, in letters of bytes."""
        if len(word) > LONG_WORD:
            return self.long_arcs(word)
        size, prefixes = self.automaton.size, self.prefixes
        path = [self.find(word, self.final, prefixes.__getitem__)] if word else []
        n = len(word) - (size[path[0]] if word else 0)
        while n > 0:
            path.append(prefixes[word[:n]])
            n -= size[path[-1]]
        return path[::-1]

    def long_arcs(self, word: str) -> list[int]:
        """The same from left to right, without a look-up per prefix: linear in the word."""
        n, width, step, longest = len(word), self.width, self.step, self.longest
        ending = array("i", [-1]) * (n + 1)
        for i in range(1, n + 1):
            arcs_of = self.final if i == n else self.inner
            for start in range(max(0, i - longest), i):
                arc = arcs_of.get(word[start:i])
                if arc is not None and (start == 0 or step[ending[start] * width + arc]):
                    ending[i] = arc
                    break
        path, size = [], self.automaton.size
        while n > 0:
            path.append(ending[n])
            n -= size[ending[n]]
        return path[::-1]


class TextCoder:
    """Whole texts to tokens and back, with the vocabulary's normalisation and split."""

    def __init__(self, tables: dict):
        encoder = self.encoder = Encoder(tables)
        letter = encoder.byte_letter

        def coded(word: str) -> bytes:
            arcs = encoder.arcs("".join([letter[b] for b in word.encode()]))
            return b"".join([encoder.identifier[a] for a in arcs])

        words = self.words = Remembered(coded, WORDS_KEPT)
        split = self.split = regex.compile(SPLIT)

        def joined(chunk: str) -> bytes:
            return b"".join([words[w] for w in split.findall(chunk)])

        self.chunks = Remembered(joined, WORDS_KEPT)
        self.special = tables["specials"]
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        # What each identifier's arc emits; one that is not in the vocabulary emits nothing.
        ids = [*tables["vocab"].values(), *self.special.values()]
        self.emitted = [None] * (max(ids) + 1)
        for label, i in [*tables["vocab"].items(), *self.special.items()]:
            self.emitted[i] = label

    def normal(self, text: str) -> str:
        # Letters are lowered one by one, so a capital sigma has one form wherever it stands.
        # White space needs no folding: the split drops it whatever its form.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pieces(self, text: str) -> Iterator[bytes]:
        """Identifiers of a text in order, four bytes each, in parts of bounded length."""
        of = self.chunks.__getitem__
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.special:
                yield self.special[part].to_bytes(4, "little")
                continue
            normal = self.normal(part)
            if len(normal) < LONG_TEXT:
                yield b"".join(map(of, normal.split(" ")))
                continue
            held = []
            for match in self.split.finditer(normal):
                held.append(self.words[match.group()])
                if len(held) == LONG_TEXT:
                    yield b"".join(held)
                    held = []
            yield b"".join(held)

    def decode(self, ids) -> str:
        """The text of a path of identifiers: the labels of its arcs, one blank between them."""
        emitted, top = self.emitted, len(self.emitted)
        labels = [emitted[i] if 0 <= i < top else None for i in ids]
        return " ".join([x for x in labels if x is not None])

    def encode(self, text: str) -> np.ndarray:
        """Identifiers of a whole text."""
        return np.frombuffer(b"".join(self.pieces(text)), dtype="<u4").astype(np.int32)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Token count and the digests of identifiers and decoded text, piece by piece."""
        count, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
        for piece in self.pieces(text):
            if piece:
                found = np.frombuffer(piece, dtype="<u4").tolist()
                ids.update(piece)
                decoded.update(((" " if count else "") + self.decode(found)).encode())
                count += len(found)
        return count, ids.hexdigest(), decoded.hexdigest()


def coder(tables: dict) -> TextCoder:
    return TextCoder(tables)


def encoded(df: DataFrame, text: Column, path: str) -> Column:
    """Struct of ``ids`` (array of int) and ``decoded`` (string) of every whole text.

    Null and empty texts give an empty list and an empty string. Special tokens are recognised
    inside texts and never added. Repeated rows give repeated results.
    """
    bounded_batches(df.sparkSession)
    shared = share(df, load_tables(path))

    @F.pandas_udf("ids array<int>, decoded string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = kept(shared.value, "coder", coder)
        for texts in batches:
            ids = [of.encode(t or "") for t in texts]
            yield pd.DataFrame({"ids": ids, "decoded": [of.decode(i.tolist()) for i in ids]})

    return run(text)


def decoded(df: DataFrame, ids: Column, path: str) -> Column:
    """The text of every list of identifiers; null and empty lists give an empty text."""
    shared = share(df, load_tables(path))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = kept(shared.value, "coder", coder)
        for lists in batches:
            yield pd.Series(["" if found is None else of.decode([int(i) for i in found]) for found in lists], dtype=object)

    return run(ids)


def token_digests(df: DataFrame, text: Column, path: str) -> Column:
    """Struct of ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, as ``encoded`` would give.

    For texts whose token lists need not leave the task; memory stays that of one text.
    """
    bounded_batches(df.sparkSession)
    shared = share(df, load_tables(path))

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = kept(shared.value, "coder", coder)
        for texts in batches:
            rows = [of.digest(t or "") for t in texts]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)
