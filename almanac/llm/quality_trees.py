"""Document quality by histogram gradient-boosted trees over statistics of the text.

The statistics are cheap to compute where the text is; the trees are learnt from
the statistics of a bounded sample of labelled rows, flattened into arrays (a
complete binary tree per row) and traversed for whole batches with numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.rows import per_slice, small_batches, text_bytes, word_chunks

# The statistics, in order.
STATISTICS = [
    "log_bytes", "log_words", "word_length", "upper_share", "lower_share", "digit_share", "high_share", "blank_share",
    "comma_stop_share", "shout_share", "sign_share", "other_share", "distinct_words", "repeated_triples", "log_lines",
    "repeated_lines", "line_words", "capital_words", "signed_words", "long_words", "one_letter_words",
]

TREES, DEPTH, BINS, RATE, L2 = 80, 4, 64, 0.15, 1.0
# The sample that trees are learnt from: the labelled rows of the smallest hashes of their id, at most so many.
TRAIN_ROWS = 20_000

_UPPER, _LOWER, _DIGIT = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)
_BLANK = np.array([9, 10, 11, 12, 13, 32])
_STOP, _SHOUT, _SIGN = np.frombuffer(b".,;:'\"-()", np.uint8), np.frombuffer(b"!?", np.uint8), np.frombuffer(b"#*$%&|<>@^~=_+/\\{}[]`", np.uint8)
_SIGNS = set(b"#*$%&|<>!")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(data: bytes) -> tuple[np.ndarray, dict[str, int]]:
    """A hash of each word, equal for equal words of this text, and counts over the words."""
    hashes, counts = [], dict.fromkeys(("capital", "signed", "long", "single"), 0)
    for words in word_chunks(data):
        hashes.append(np.fromiter(map(hash, words), np.int64, len(words)))
        counts["capital"] += sum(w.isupper() for w in words)
        counts["signed"] += sum(w[-1] in _SIGNS for w in words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts["long"] += int((sizes > 20).sum())
        counts["single"] += int((sizes == 1).sum())
    return (np.concatenate(hashes) if hashes else np.empty(0, np.int64)), counts


def triples(hashes: np.ndarray) -> np.ndarray:
    """A hash of each window of three words."""
    h = hashes.view(np.uint64)
    return (h[:-2] * _A ^ h[1:-1]) * _B ^ h[2:] if len(h) > 2 else h[:0]


def statistics(data: bytes | None) -> list[float]:
    """The statistics of one whole text; a null text counts as an empty one."""
    data = data or b""
    n = max(len(data), 1)
    bytes_of = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = lambda which: bytes_of[which].sum() / n
    hashes, counts = word_hashes(data)
    words = max(len(hashes), 1)
    windows = triples(hashes)
    lines = data.split(b"\n")
    shares = [share(x) for x in (_UPPER, _LOWER, _DIGIT, slice(128, 256), _BLANK, _STOP, _SHOUT, _SIGN)]
    return [
        np.log1p(len(data)), np.log1p(len(hashes)), (n - bytes_of[_BLANK].sum()) / words, *shares, 1 - sum(shares),
        len(np.unique(hashes)) / words, 1 - len(np.unique(windows)) / max(len(windows), 1), np.log1p(len(lines)),
        1 - len(set(lines)) / len(lines), words / len(lines), counts["capital"] / words, counts["signed"] / words,
        counts["long"] / words, counts["single"] / words,
    ]


@dataclass
class Trees:
    """Flat arrays: ``feature`` and ``threshold`` hold a complete tree per row, ``leaf`` its values."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the label 1 for each row of statistics."""
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))
        node = np.zeros((len(x), len(trees)), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        total = self.base + self.leaf[trees, node - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Boost trees on log loss; splits are sought among at most ``BINS`` bins of each statistic.

    Without rows, or with one label only, the score is one smoothed constant.
    """
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    nodes, wide = 2**DEPTH - 1, x.shape[1]
    if len(np.unique(y)) < 2:
        return Trees(base, np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes + 1)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(wide)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    feature, threshold, leaf = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes + 1))
    total = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, hessian = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            place = node - first
            best = np.zeros(width)
            for j in range(wide):
                key = place * BINS + binned[:, j]
                g = np.bincount(key, gradient, width * BINS).reshape(width, BINS).cumsum(axis=1)
                h = np.bincount(key, hessian, width * BINS).reshape(width, BINS).cumsum(axis=1)
                right, heavy = g[:, -1:] - g, h[:, -1:] - h
                gain = g**2 / (h + L2) + right**2 / (heavy + L2) - g[:, -1:] ** 2 / (h[:, -1:] + L2)
                gain[(h < 1) | (heavy < 1)] = 0
                gain = gain[:, : len(edges[j])]
                if not gain.shape[1]:
                    continue
                cut = gain.argmax(axis=1)
                better = np.flatnonzero(gain[np.arange(width), cut] > best + 1e-9)
                best[better] = gain[better, cut[better]]
                feature[t, first + better], threshold[t, first + better] = j, edges[j][cut[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        place = node - nodes
        g, h = np.bincount(place, gradient, nodes + 1), np.bincount(place, hessian, nodes + 1)
        leaf[t] = RATE * g / (h + L2)
        total += leaf[t, place]
    return Trees(base, feature, threshold, leaf)


def held_out(id_column: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(labels: DataFrame, id_column: str, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids outside the held-out third, those of the smallest hashes: ``id, label``.

    Of several labels of one id the smallest counts; null ids and labels are left out.
    """
    usable = labels.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    usable = usable.where(~held_out(F.col("id"))).groupBy("id").agg(F.min("label").alias("label"))
    return usable.orderBy(F.xxhash64("id"), "id").limit(rows)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """Trees from the labelled sample. The sample is bounded by ``rows``, so it is broadcast and its statistics fit the driver."""
    chosen = F.broadcast(sample(labels, id_column, label, rows))
    texts = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).join(chosen, "id")
    # A repeated id counts once, whichever row comes first in the order of its statistics.
    measured = per_slice(
        text_bytes(texts, "id", "label"),
        lambda part: {"id": part["id"], "label": part["label"], "x": [statistics(t) for t in part["_text"]]},
        "id long, label int, x array<double>",
    )
    found = measured.groupBy("id").agg(F.min("label").alias("label"), F.min("x").alias("x")).orderBy("id").toPandas()
    x = np.array(found["x"].tolist(), np.float64).reshape(-1, len(STATISTICS))
    return fit(x, found["label"].to_numpy(np.float64))


def score(docs: DataFrame, model: Trees, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``score``, one row per document; whole texts, null as empty."""
    trees = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep]

    def compute(part: dict[str, list]) -> dict[str, list]:
        x = np.array([statistics(t) for t in part["_text"]]).reshape(-1, len(STATISTICS))
        return {**{c: part[c] for c in keep}, "score": trees.value.score(x).tolist()}

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["score double"])
    return per_slice(text_bytes(docs, *keep, text=text), compute, schema)


def classified(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per document: ``id_column, held_out, score, predicted``.

    Every row of ``docs`` is returned, repeated ones as often as they occur, with
    the score of its own text. A null id counts as not held out. Without usable
    labels every score is 0.5. Other columns are ignored.
    """
    scored = score(docs, train(docs, labels, id_column, text, label), id_column, text=text)
    return scored.select(id_column, held_out(F.col(id_column)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows that the classifier accepts, all columns kept; a row is judged by its own text, so nothing is shuffled."""
    trees = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text=text))
    place = docs.columns.index(text)

    def keep(batches):
        for batch in batches:
            texts = batch.column(place).cast(pa.binary())
            x = np.array([statistics(texts[i].as_py()) for i in range(batch.num_rows)]).reshape(-1, len(STATISTICS))
            yield batch.filter(pa.array(trees.value.score(x) >= 0.5))

    return small_batches(docs).mapInArrow(keep, docs.schema)
