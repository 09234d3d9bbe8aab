"""Document quality by counts with fixed limits and a linear model of hashed n-grams.

The model is a logistic regression over hashed words, word pairs and character
4-grams. Its value is a mean of weights per n-gram, so a text of any length is
scored a stretch at a time. It is trained on a bounded sample of the labelled
rows; a second part of the sample calibrates its value to a probability.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.quality_trees import held_out, sample, triples, word_hashes  # noqa: F401
from almanac.llm.rows import per_slice, text_bytes, word_chunks

FEW_WORDS, REPEATED_PERCENT = 50, 50
KEEP = 0.5
SLOTS = 1 << 17  # of the words and pairs, and again of the character n-grams
# Labelled rows that the model is trained on and calibrated with, at most.
TRAIN_ROWS = 4_000
EPOCHS, BATCH, STEP, SCALE, L2 = 12, 100, 0.5, 30.0, 1e-4
_PAIR, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint32(0x9E3779B1)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_BLANK = np.array([9, 10, 11, 12, 13, 32])


def counts(data: bytes | None) -> tuple[int, int, int, int, int]:
    """Words, their characters, symbols, repeated lines, and words in three-word windows found twice or more."""
    data = data or b""
    bytes_of = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    # Every character has one byte that is no continuation byte.
    characters = int(bytes_of.sum() - bytes_of[0x80:0xC0].sum() - bytes_of[_BLANK].sum())
    hashes = [np.fromiter(map(hash, words), np.int64, len(words)) for words in word_chunks(data)]
    hashes = np.concatenate(hashes) if hashes else np.empty(0, np.int64)
    windows = triples(hashes)
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[which] > 1)
    covered = np.zeros(len(hashes), bool)
    for shift in range(3):
        covered[again + shift] = True
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    return len(hashes), characters, int(bytes_of[_SYMBOLS].sum()), len(lines) - len(set(lines)), int(covered.sum())


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    """The fixed limits: fewer than 50 words, or more than half of them repeated."""
    return n_words < FEW_WORDS or 100 * n_repeat_words > REPEATED_PERCENT * n_words


def slots(data: bytes | None, size: int = 1 << 20):
    """Slots of words and pairs, and of character 4-grams (over UTF-8 bytes), a stretch of the text at a time."""
    data = data or b""
    before = None
    for words in word_chunks(data, size):
        single = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
        joined = single if before is None else np.append(before, single)
        pairs = (joined[:-1] * _PAIR + joined[1:]) >> np.uint64(20)
        before = single[-1:] if len(single) else before
        yield "words", (np.append(single, pairs) % np.uint64(SLOTS)).astype(np.int64)
    for at in range(0, max(len(data) - 3, 0), size):
        a = np.frombuffer(data[at : at + size + 3], np.uint8)
        two = a[:-1].astype(np.uint16) | (a[1:].astype(np.uint16) << 8)
        four = two[:-2].astype(np.uint32) | (two[2:].astype(np.uint32) << 16)
        yield "characters", ((four * _ODD) >> np.uint32(32 - 17)).astype(np.int64) + SLOTS


@dataclass
class Linear:
    """Weights per slot, and the line that turns a value into log-odds."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def value(self, data: bytes | None) -> float:
        total, number = {"words": 0.0, "characters": 0.0}, {"words": 0, "characters": 0}
        for kind, places in slots(data):
            total[kind] += float(self.weights[places].sum(dtype=np.float64))
            number[kind] += len(places)
        return self.bias + SCALE * sum(total[k] / number[k] for k in total if number[k])

    def probability(self, data: bytes | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.value(data) + self.offset, -30, 30))))


def features(data: bytes | None) -> tuple[bytes, bytes]:
    """Distinct slots and their shares of the text's n-grams of that kind, packed."""
    places, shares = [np.empty(0, np.int64)], [np.empty(0)]
    for which in ("words", "characters"):
        own = [p for kind, p in slots(data) if kind == which]
        total = sum(map(len, own))
        if total:
            found, times = np.unique(np.concatenate(own), return_counts=True)
            places.append(found)
            shares.append(SCALE * times / total)
    return np.concatenate(places).astype("<i4").tobytes(), np.concatenate(shares).astype("<f4").tobytes()


def calibrated(values: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the values, by Newton steps; targets are smoothed as the sample is small."""
    positive, negative = y.sum(), len(y) - y.sum()
    target = np.where(y > 0.5, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x = np.stack([values, np.ones_like(values)], axis=1)
    line = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        curve = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        line = line - np.clip(np.linalg.solve(curve, x.T @ (p - target) + 1e-3 * (line - [1.0, 0.0])), -2, 2)
    return float(line[0]), float(line[1])


def fit(rows: list[tuple[bytes, bytes]], y: np.ndarray) -> Linear:
    """Adaptive gradient steps over small batches; the last fifth of the rows calibrates.

    Without rows, or with one label only, the probability is one smoothed constant.
    """
    weights, seen = np.zeros(2 * SLOTS), np.full(2 * SLOTS, 1e-6)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(rate / (1 - rate)))
    cut = len(y) - len(y) // 5
    if len(np.unique(y[:cut])) < 2 or len(np.unique(y[cut:])) < 2:
        return Linear(weights.astype(np.float32), bias, 1.0, 0.0)
    places = [np.frombuffer(p, "<i4") for p, _ in rows]
    shares = [np.frombuffer(s, "<f4").astype(np.float64) for _, s in rows]
    order = np.random.default_rng(1)
    for _ in range(EPOCHS):
        shuffled = order.permutation(cut)
        for at in range(0, cut, BATCH):
            own = shuffled[at : at + BATCH]
            errors = []
            for i in own:
                p = 1 / (1 + np.exp(-np.clip(bias + weights[places[i]] @ shares[i], -30, 30)))
                errors.append(p - y[i])
            touched = np.concatenate([places[i] for i in own])
            push = np.bincount(touched, np.concatenate([e * shares[i] for e, i in zip(errors, own)]), 2 * SLOTS) / len(own)
            push += L2 * weights
            seen += push**2
            weights -= STEP * push / np.sqrt(seen) * 0.1
            bias -= STEP * 0.1 * float(np.mean(errors))
    values = np.array([bias + weights[p] @ s for p, s in zip(places[cut:], shares[cut:])])
    slope, offset = calibrated(values, y[cut:])
    return Linear(weights.astype(np.float32), bias, slope, offset)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> Linear:
    """The model of a bounded sample of labelled rows; the held-out third of the ids is left for measuring it.

    Of several texts with one id the one of the smallest features is learnt from, so every run gives the same model.
    """
    chosen = F.broadcast(sample(labels, id_column, label, rows))
    texts = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).join(chosen, "id")

    def compute(part: dict[str, list]) -> dict[str, list]:
        both = [features(t) for t in part["_text"]]
        return {"id": part["id"], "label": part["label"], "places": [p for p, _ in both], "shares": [s for _, s in both]}

    found = per_slice(text_bytes(texts, "id", "label"), compute, "id long, label int, places binary, shares binary")
    found = found.groupBy("id").agg(F.min(F.struct("places", "shares", "label")).alias("row")).select("id", "row.*")
    found = found.orderBy(F.xxhash64("id"), "id").toPandas()
    return fit(list(zip(found["places"].map(bytes), found["shares"].map(bytes))), found["label"].to_numpy(np.float64))


def judged(docs: DataFrame, model: Linear, id_column: str = "doc_id", text: str = "text", keep: float = KEEP) -> DataFrame:
    """One row per document: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability``.

    A null text has no words. Repeated rows are judged alike, each by its own
    text. A document that fails the fixed limits is not kept, whatever the model
    says; else it is kept if its probability reaches ``keep``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def compute(part: dict[str, list]) -> dict[str, list]:
        found = [counts(t) for t in part["_text"]]
        failed = [base_failed(c[0], c[4]) for c in found]
        probability = [shared.value.probability(t) for t in part["_text"]]
        columns = {name: [c[i] for c in found] for i, name in enumerate(names)}
        kept = [not f and p >= keep for f, p in zip(failed, probability)]
        return {"id": part["id"], **columns, "base_failed": failed, "kept": kept, "probability": probability}

    rows = text_bytes(docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")), "id")
    schema = "id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, probability double"
    return per_slice(rows, compute, schema).withColumnRenamed("id", id_column)
