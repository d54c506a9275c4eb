"""Toxicity by subword bags: embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (and itself), hashed to a fixed number of vectors;
a span of words is the mean of its words' vectors, and a softmax layer reads it. Vectors and
layer are trained together in numpy. As a text may be long and only a few of its words
toxic, training looks at each text through its highest span: the span of a toxic text is an
example of one class, that of a clean text of the other. A logistic layer, fitted on texts
that the vectors have not seen, turns the highest short span, the highest long span and the
mean of the whole text into a probability. Misspelt words share n-grams with known ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, kept, share
from tidemark.llm.draws import labelled_draw

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
SHORTEST_GRAM, LONGEST_GRAM = 3, 6
SIZE = 8
SPANS = (12, 48)
SAMPLE_ROWS = 5_000  # labelled texts that a model is fitted on, at most twice as many
LONGEST_WORD = 4096
STEPS = 40
RATE = 0.12
PARTS = 3  # of the labels, for the calibration
WORDS_KEPT = 600_000
HASHED_WORDS = 10_000
GROUP_WORDS = 50_000
EDGES = ".,;:!?\"'()[]{}<>|*&%$#@~`=+-_/\\«»“”„’‘…¡¿"


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of three to six bytes and of each whole word; the word of each."""
    parts = [f"<{w.strip(EDGES) or w}>".encode() for w in words]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    ends = np.cumsum(sizes)
    letters = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    total, owner = len(letters), np.repeat(np.arange(len(words)), sizes)
    room = np.repeat(ends, sizes) - np.arange(total)
    powers = np.cumprod(np.concatenate(([1], np.full(int(sizes.max()), 1_000_003))).astype(np.uint64))
    inside = np.arange(total) - np.repeat(ends - sizes, sizes)
    hashes = [np.add.reduceat(letters * powers[inside], ends - sizes)]
    owners = [np.arange(len(words))]
    rolling = np.zeros(total, dtype=np.uint64)
    for n in range(1, LONGEST_GRAM + 1):
        rolling = rolling[: total - n + 1] * np.uint64(1_000_003) + letters[n - 1 :]
        if n >= SHORTEST_GRAM:
            fits = room[: len(rolling)] >= n
            hashes.append(rolling[fits] ^ np.uint64(n << 56))
            owners.append(owner[: len(rolling)][fits])
    mixed = np.concatenate(hashes) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32), np.concatenate(owners)


def words_of(text: str) -> list[str]:
    """Words in lower case; one beyond ``LONGEST_WORD`` counts as several, each hashed by itself."""
    words = text.lower().split()
    if len(text) <= LONGEST_WORD or max(map(len, words), default=0) <= LONGEST_WORD:
        return words
    return [w[at : at + LONGEST_WORD] for w in words for at in range(0, len(w), LONGEST_WORD)]


def highest(values: np.ndarray, span: int) -> tuple[float, int]:
    """The largest mean over ``span`` neighbouring values, and where it begins."""
    n = len(values)
    if n <= span:
        return float(values.sum()) / max(n, 3), 0
    sums = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    means = (sums[span:] - sums[:-span]) / span
    at = int(means.argmax())
    return float(means[at]), at


def features(values: np.ndarray) -> list[float]:
    return [highest(values, s)[0] for s in SPANS] + [float(values.mean())]


class Bags:
    """The n-grams of a fitted vocabulary, flat, with where each word begins.

    Texts are split one at a time and n-grams hashed for a few words at a time, so that beside
    the flat arrays only the vocabulary's own strings are held.
    """

    def __init__(self, texts: Iterable[str]):
        index: dict[str, int] = {}
        self.docs = [
            np.array([index.setdefault(w, len(index)) for w in words_of(t)], dtype=np.int32) for t in texts
        ]
        words = list(index)
        flat, size = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), HASHED_WORDS):
            piece = words[at : at + HASHED_WORDS]
            found, owner = grams(piece)
            flat.append(found[np.argsort(owner, kind="stable")])
            size.append(np.bincount(owner, minlength=len(piece)))
        self.flat, self.size = np.concatenate(flat), np.concatenate(size)
        self.start = np.cumsum(self.size) - self.size

    def scores(self, bucket_scores: np.ndarray) -> np.ndarray:
        """Mean bucket score of every word."""
        out = np.zeros(len(self.size), dtype=bucket_scores.dtype)
        for at in range(0, len(self.size), HASHED_WORDS):
            starts = self.start[at : at + HASHED_WORDS]
            end = starts[-1] + self.size[at + len(starts) - 1]
            held = bucket_scores[self.flat[starts[0] : end]]
            out[at : at + len(starts)] = np.add.reduceat(held, starts - starts[0])
        return out / self.size

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat n-grams of the chosen words, and the place in ``words`` of each."""
        sizes = self.size[words]
        owner = np.repeat(np.arange(len(words)), sizes)
        offset = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.flat[np.repeat(self.start[words], sizes) + offset], owner


def _adam(value, slope, memory, step, rate):
    m, v = memory
    m += 0.1 * (slope - m)
    v += 0.001 * (slope * slope - v)
    value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def fit_vectors(texts: list[str], target: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """What each bucket adds to a word's score: vectors and layer trained together, multiplied out."""
    bags = Bags(texts)
    vectors = random.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
    layer = random.normal(0, 0.5, (SIZE, 2)).astype(np.float32)
    memory = [(np.zeros_like(p), np.zeros_like(p)) for p in (vectors, layer)]
    for step in range(1, STEPS + 1):
        word_scores = bags.scores(vectors @ (layer[:, 1] - layer[:, 0]))
        spans, owner, truth = [], [], []
        for doc, label in zip(bags.docs, target):
            width = SPANS[step % 2]
            picks = [highest(word_scores[doc], width)[1]]
            picks += [int(random.integers(0, max(1, len(doc) - width + 1)))] if not label or step < 10 else []
            for at in picks:
                spans.append(doc[at : at + width])
                owner.append(len(truth))
                truth.append(label)
        sizes = np.array([len(s) for s in spans])
        words, place = np.unique(np.concatenate(spans), return_inverse=True)
        flat, of_word = bags.of(words)
        word_vectors = np.zeros((len(words), SIZE), dtype=np.float32)
        for d in range(SIZE):
            word_vectors[:, d] = np.bincount(of_word, vectors[flat, d], len(words)) / bags.size[words]
        of_span = np.repeat(np.arange(len(spans)), sizes)
        means = np.stack([np.bincount(of_span, word_vectors[place, d], len(spans)) / sizes for d in range(SIZE)], 1)
        logits = means @ layer
        logits -= logits.max(1, keepdims=True)
        odds = np.exp(logits)
        odds /= odds.sum(1, keepdims=True)
        slope = odds.copy()
        truth = np.array(truth)
        slope[np.arange(len(truth)), truth] -= 1
        weight = np.where(truth == 1, 0.5 / max((truth == 1).sum(), 1), 0.5 / max((truth == 0).sum(), 1))
        slope *= weight[:, None]
        layer_slope = means.T @ slope + 1e-4 * layer
        span_slope = (slope @ layer.T) / sizes[:, None]
        vector_slope = np.zeros_like(vectors)
        for d in range(SIZE):
            per_word = np.bincount(place, span_slope[of_span, d], len(words)) / bags.size[words]
            vector_slope[:, d] = np.bincount(flat, per_word[of_word], BUCKETS)
        vector_slope += 2e-6 * vectors
        _adam(vectors, vector_slope, memory[0], step, RATE)
        _adam(layer, layer_slope, memory[1], step, RATE)
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float64)


def text_features(texts: list[str], bucket: np.ndarray) -> np.ndarray:
    bags = Bags(texts)
    word_scores = bags.scores(bucket)
    return np.array([features(word_scores[d]) for d in bags.docs])


def fit(texts: list[str], labels: list[int], seed: int = 7) -> dict:
    """Vectors, layer and calibration from labelled texts; plain arrays of a fixed size.

    Every label serves both: vectors are trained ``PARTS`` times, each time without one part of
    the labels, and the logistic layer is fitted on features that come from vectors which have
    not seen the text. The means of the vectors' scores are kept.
    """
    random = np.random.default_rng(seed)
    usable = np.array([i for i, t in enumerate(texts) if t and not t.isspace()], dtype=int)
    y = np.array(labels, dtype=int)
    model = {"bucket": np.zeros(BUCKETS), "weights": [0.0] * len(features(np.zeros(1))), "bias": -2.0}
    if len(usable) < 20 or min((y[usable] == v).sum() for v in (0, 1)) < PARTS:
        return model
    usable = random.permutation(usable)
    # Parts with the same share of toxic texts.
    part = np.zeros(len(usable), dtype=int)
    for v in (0, 1):
        part[y[usable] == v] = np.arange((y[usable] == v).sum()) % PARTS
    x, truth, buckets = [], [], []
    for held in range(PARTS):
        train, rest = usable[part != held], usable[part == held]
        bucket = fit_vectors([texts[i] for i in train], y[train], random)
        buckets.append(bucket)
        x.append(text_features([texts[i] for i in rest], bucket))
        truth.append(y[rest])
    x = np.concatenate(x)
    scale = np.abs(x).mean(0) + 1e-9
    weights, bias = logistic(x / scale, np.concatenate(truth))
    return {"bucket": np.mean(buckets, 0), "weights": (weights / scale).tolist(), "bias": float(bias)}


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-2) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps."""
    design = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(design.shape[1])
    keep = np.diag([decay] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (p - y) + keep @ beta
        curve = (design * (p * (1 - p))[:, None]).T @ design + keep
        move = np.linalg.solve(curve + 1e-9 * np.eye(len(beta)), slope)
        beta -= move * min(1.0, 4.0 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-8:
            break
    return beta[:-1], beta[-1]


class Scorer:
    """Scores of texts; those of words are remembered, up to a bound, and made many at once."""

    def __init__(self, model: dict):
        self.bucket = model["bucket"]
        self.weights, self.bias = np.array(model["weights"]), model["bias"]
        self.known: dict[str, float] = {}

    def learn(self, words: list[str]) -> None:
        new = list(set(words) - self.known.keys())
        if not new:
            return
        if len(self.known) + len(new) > WORDS_KEPT:
            self.known = {}
            new = list(set(words))
        flat, owner = grams(new)
        sums = np.bincount(owner, self.bucket[flat], len(new)) / np.bincount(owner, minlength=len(new))
        self.known.update(zip(new, sums.tolist()))

    def score_words(self, words: list[str]) -> float:
        line = self.bias
        if words:
            values = np.fromiter(map(self.known.__getitem__, words), dtype=np.float64, count=len(words))
            line += float(np.dot(self.weights, features(values)))
        return float(1 / (1 + np.exp(-np.clip(line, -30, 30))))

    def scores(self, texts: list[str]) -> list[float]:
        """Texts in groups of bounded length, so that new words are hashed together."""
        out: list[float] = []
        group: list[list[str]] = []
        held = 0
        for i, text in enumerate(texts):
            group.append(words_of(text))
            held += len(group[-1])
            if held >= GROUP_WORDS or i == len(texts) - 1:
                self.learn([w for words in group for w in words])
                out += [self.score_words(words) for words in group]
                group, held = [], 0
        return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    """Fit on a bounded, class-balanced draw of ``labels`` (``doc_id``, ``toxic``: 0 or 1).

    Labels are drawn first and then meet the texts of ``docs``. Null texts count as empty, null
    labels and identifiers are left out, repeated labels count once. Without labels of both
    kinds the model gives every text the same low score.
    """
    sample = labelled_draw(docs.select("doc_id", "text"), labels, "doc_id", "toxic", rows).toPandas()
    sample = sample.sort_values(["doc_id", "toxic", "text"], na_position="first")
    return fit([t or "" for t in sample["text"]], [int(v) for v in sample["toxic"]])


def toxicity_score(df: DataFrame, text: Column, model: dict) -> Column:
    """Probability from 0 to 1 for every whole text; null and empty texts get the prior's."""
    bounded_batches(df.sparkSession)
    shared = share(df, model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = kept(shared.value, "scorer", Scorer)
        for texts in batches:
            yield pd.Series(scorer.scores([t or "" for t in texts]), dtype="float64")

    return run(text)
