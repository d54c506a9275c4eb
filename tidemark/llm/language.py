"""Language of texts by a bidirectional gated recurrent network over bytes.

Bytes enter as learned rows; one gated recurrent layer reads a chunk forwards, another one
backwards, and a softmax labels every position. The network is trained in numpy by back-
propagation through time on chunks of a bounded sample. A text is cut into chunks without
overlap, every byte of the whole text is labelled, and the probabilities of the positions
that belong to letters are averaged into those of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, kept, share
from tidemark.llm.draws import balanced_sample

UNITS = 8
CHUNK = 48  # bytes the network reads at once, in both directions
SAMPLE_ROWS = 2_000  # texts that the network is trained on, at most twice as many
CHUNKS_A_TEXT = 8
STEPS = 500
BATCH = 192
LANES = 2_048  # chunks that are read side by side
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")


def letter_bytes() -> np.ndarray:
    """Bytes that carry letters: ASCII letters and all bytes of longer characters."""
    return np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)], dtype=np.float32)


class Direction:
    """One gated layer; arrays are units first, chunks last. Halved gates make tanh a sigmoid."""

    def __init__(self, table: np.ndarray, recurrent: np.ndarray, bias: np.ndarray):
        self.table, self.recurrent, self.bias = table, recurrent, bias

    @staticmethod
    def fresh(random: np.random.Generator) -> Direction:
        draw = lambda *shape: random.normal(0, 0.3, shape).astype(np.float32)
        return Direction(draw(3 * UNITS, 256), draw(3 * UNITS, UNITS), np.zeros((3 * UNITS, 1), np.float32))

    def run(self, steps: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States (time, units, chunks) for bytes (time, chunks)."""
        width, u = steps.shape[1], UNITS
        state = np.zeros((u, width), dtype=np.float32)
        out = np.empty((len(steps), u, width), dtype=np.float32)
        table = self.table.copy()
        table[: 2 * u] += self.bias[: 2 * u]
        for t, column in enumerate(steps):
            given = table.take(column, axis=1)
            fed = self.recurrent @ state
            gates = given[: 2 * u]
            gates += fed[: 2 * u]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            late, reset = gates[:u], gates[u:]
            raw = fed[2 * u :] + self.bias[2 * u :]
            new = given[2 * u :]
            new += reset * raw
            np.tanh(new, out=new)
            if trace is not None:
                trace.append((column, state, late, reset, raw, new))
            state = new + late * (state - new)
            out[t] = state
        return out

    def slopes(self, trace: list, above: np.ndarray) -> list[np.ndarray]:
        """Gradients of table, recurrent weights and bias, backwards through time."""
        u = UNITS
        d_table, d_rec, d_bias = (np.zeros_like(p) for p in (self.table, self.recurrent, self.bias))
        back = np.zeros_like(above[0])
        for t in range(len(trace) - 1, -1, -1):
            column, state, late, reset, raw, new = trace[t]
            d = above[t] + back
            d_new = d * (1 - late) * (1 - new * new)
            d_late = d * (state - new) * late * (1 - late) * 2
            d_reset = d_new * raw * reset * (1 - reset) * 2
            d_raw = d_new * reset
            into = np.concatenate((d_late, d_reset, d_new))
            fed = np.concatenate((d_late, d_reset, d_raw))
            d_bias += fed.sum(1, keepdims=True)
            d_rec += fed @ state.T
            for row in range(3 * u):
                d_table[row] += np.bincount(column, into[row], 256)
            back = d * late + self.recurrent.T @ fed
        return [d_table, d_rec, d_bias]


class Network:
    def __init__(self, forward: Direction, backward: Direction, output: np.ndarray, offset: np.ndarray):
        self.forward, self.backward, self.output, self.offset = forward, backward, output, offset

    def logits(self, steps: np.ndarray, traces: tuple[list, list] | None = None):
        one = self.forward.run(steps, traces and traces[0])
        two = self.backward.run(steps[::-1], traces and traces[1])[::-1]
        return self.output[:, :UNITS] @ one + self.output[:, UNITS:] @ two + self.offset, one, two


def softmax(x: np.ndarray, axis: int) -> np.ndarray:
    x = np.exp(x - x.max(axis, keepdims=True))
    x /= x.sum(axis, keepdims=True)
    return x


def train(texts: list[bytes], labels: list[int], classes: int, seed: int = 11) -> Network:
    random = np.random.default_rng(seed)
    net = Network(
        Direction.fresh(random),
        Direction.fresh(random),
        random.normal(0, 0.3, (classes, 2 * UNITS)).astype(np.float32),
        np.zeros((classes, 1), np.float32),
    )
    rows, truth = [], []
    for text, label in zip(texts, labels):
        for _ in range(CHUNKS_A_TEXT):
            at = int(random.integers(0, max(1, len(text) - CHUNK + 1)))
            rows.append(np.frombuffer(text[at : at + CHUNK].ljust(CHUNK), dtype=np.uint8))
            truth.append(label)
    chunks, truth = np.array(rows), np.array(truth)
    letters = letter_bytes()
    parts = [net.forward.table, net.forward.recurrent, net.forward.bias, net.backward.table]
    parts += [net.backward.recurrent, net.backward.bias, net.output, net.offset]
    memory = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
    for step in range(1, STEPS + 1):
        pick = random.integers(0, len(chunks), BATCH)
        steps = np.ascontiguousarray(chunks[pick].T)
        traces: tuple[list, list] = ([], [])
        logits, one, two = net.logits(steps, traces)
        slope = softmax(logits, 1)
        slope[:, truth[pick], np.arange(BATCH)] -= 1
        slope *= letters[steps][:, None, :] / (CHUNK * BATCH)
        d_output = np.concatenate([np.einsum("tcb,tub->cu", slope, s) for s in (one, two)], axis=1)
        d_one = transposed(net.output[:, :UNITS]) @ slope
        d_two = transposed(net.output[:, UNITS:]) @ slope
        grads = net.forward.slopes(traces[0], d_one) + net.backward.slopes(traces[1], d_two[::-1])
        grads += [d_output, slope.sum((0, 2))[:, None]]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * min(1.0, step / 20) * (1 - 0.9 * step / STEPS)
        for value, grad, (m, v) in zip(parts, grads, memory):
            grad = grad * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (grad - m)
            v += 0.005 * (grad * grad - v)
            value -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.995**step)) + 1e-7)).astype(np.float32)
    return net


def transposed(matrix: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(matrix.T)


def packed(net: Network, languages: list[str]) -> dict:
    pieces = {"output": net.output, "offset": net.offset, "languages": languages}
    for name, side in (("f", net.forward), ("b", net.backward)):
        pieces |= {f"{name}t": side.table, f"{name}r": side.recurrent, f"{name}b": side.bias}
    return pieces


class Labeller:
    """Language probabilities of texts; chunks of many texts are read side by side."""

    def __init__(self, model: dict):
        side = lambda n: Direction(model[f"{n}t"], model[f"{n}r"], model[f"{n}b"])
        self.net = Network(side("f"), side("b"), model["output"], model["offset"])
        self.languages = model["languages"]
        self.letters = letter_bytes()

    def position_sums(self, chunks: np.ndarray) -> np.ndarray:
        """Per chunk the sum over its letters of the position probabilities, and their number."""
        steps = np.ascontiguousarray(chunks.T)
        logits, _, _ = self.net.logits(steps)
        odds = softmax(logits, 1)
        weight = self.letters[steps]
        sums = np.einsum("tcb,tb->bc", odds, weight)
        return np.concatenate([sums, weight.sum(0)[:, None]], axis=1)

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """Per text the class probabilities; rows of zeros where no letter is."""
        totals = np.zeros((len(texts), len(self.languages) + 1))
        if not self.languages:
            return np.zeros((len(texts), 0))
        held: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        count = 0

        def flush() -> None:
            nonlocal held, owners, count
            if count:
                rows, owner = np.concatenate(held), np.concatenate(owners)
                for at in range(0, len(rows), LANES):
                    sums = self.position_sums(rows[at : at + LANES])
                    np.add.at(totals, owner[at : at + LANES], sums)
            held, owners, count = [], [], 0

        for i, text in enumerate(texts):
            data = text.encode()
            for at in range(0, len(data), LANES * CHUNK):
                piece = data[at : at + LANES * CHUNK]
                size = -(-len(piece) // CHUNK)
                held.append(np.frombuffer(piece.ljust(size * CHUNK), dtype=np.uint8).reshape(size, CHUNK))
                owners.append(np.full(size, i))
                count += size
                if count >= LANES:
                    flush()
        flush()
        return totals[:, :-1] / np.maximum(totals[:, -1:], 1e-9)

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [bool(t) and LETTER.search(t) is not None for t in texts]
        odds = self.probabilities([t if k else "" for t, k in zip(texts, known)])
        names, scores = [], []
        for row, k in zip(odds, known):
            best = int(row.argmax()) if k and len(row) else -1
            names.append(self.languages[best] if best >= 0 else UNDETERMINED)
            scores.append(min(1.0, max(0.0, float(row[best]))) if best >= 0 else 0.0)
        return names, scores


def fit_language(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    """Train on a bounded, balanced sample of ``doc_id``, ``text``, ``lang``.

    Rows with a null language or text are left out. Without any labelled row every text is
    undetermined.
    """
    usable = labelled.select("doc_id", "text", "lang").filter("text IS NOT NULL")
    sample = balanced_sample(usable, "doc_id", "lang", rows).toPandas()
    sample = sample[sample["text"].str.len() > 0].sort_values(["doc_id", "lang", "text"])
    languages = sorted(set(sample["lang"]))
    if not languages:
        empty = np.zeros((3 * UNITS, 1), np.float32)
        side = lambda: Direction(np.zeros((3 * UNITS, 256), np.float32), np.zeros((3 * UNITS, UNITS), np.float32), empty)
        return packed(Network(side(), side(), np.zeros((0, 2 * UNITS), np.float32), np.zeros((0, 1), np.float32)), [])
    place = {name: i for i, name in enumerate(languages)}
    net = train([t.encode() for t in sample["text"]], [place[v] for v in sample["lang"]], len(languages))
    return packed(net, languages)


def language(df: DataFrame, text: Column, model: dict) -> Column:
    """Struct of ``lang_pred`` and ``score`` of every whole text.

    Null texts and texts without a letter are ``und`` with score 0. Texts of mixed languages
    get the one with the largest share, and that share as score.
    """
    bounded_batches(df.sparkSession)
    shared = share(df, model)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = kept(shared.value, "labeller", Labeller)
        for texts in batches:
            names, scores = labeller.label([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return run(text)
