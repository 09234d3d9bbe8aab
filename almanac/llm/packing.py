"""Packing of tokenised documents into sequences of a fixed length, by the sum-of-squares rule.

An open bin with gap g is one of N(g) such bins. Each piece goes where the sum of
N(g)^2 over all gaps becomes smallest: into a bin of some gap, or into a new one.
The rule keeps no gap common, so later pieces of many lengths find a bin they fill.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.llm.rows import per_slice
from almanac.session import stored

LIMIT = 4096
END_ID = 1
# Pieces that one task packs together; how many such lots there are follows from the input.
LOT = 20_000
# A task keeps the ids of the short words of late, between one and two times so many: about 200 bytes each.
CACHED_WORDS, _CACHED_LENGTH = 500_000, 40
_LETTERS = re.compile(r"([A-Za-z]+)([!#$%&*,.:;?]*)")
_caches: dict[str, tuple] = {}


def _encoder(path: str):
    if path not in _caches:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _caches[path] = (Tokenizer.from_file(path), {}, {})
    return _caches[path]


def _encode(words: list[str], tokenizer, known: dict[str, bytes]) -> None:
    """Add the ids of new words. ASCII letters with a tail of signs are the letters' ids and the tail's."""
    whole = []
    for word in words:
        parts = _LETTERS.fullmatch(word) if len(word) <= _CACHED_LENGTH else None
        if parts:
            base, tail = parts[1].lower(), parts[2]
            for part in (base, tail):
                if part not in known:
                    known[part] = np.array([t.id for t in tokenizer.model.tokenize(part)], "<u4").tobytes()
            known[word] = known[base] + known[tail]
        else:
            whole.append(word)
    encoded = tokenizer.encode_batch_fast(whole, add_special_tokens=False)
    known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(whole, encoded))


def token_ids(text: str | None, path: str, cached: int = CACHED_WORDS) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers, without special tokens; none for null.

    For tokenizers that lower the case, drop white space and end a token where
    letters end: a text's ids are then those of its stretches between spaces,
    which are looked up where they occurred before.
    """
    tokenizer, known, older = _encoder(path)
    words = (text or "").replace("\n", " ").split(" ")
    new = [w for w in set(words) if w not in known]
    if new and older:
        known.update((w, older[w]) for w in new if w in older)
        new = [w for w in new if w not in known]
    if new:
        _encode(new, tokenizer, known)
    ids = b"".join(map(known.__getitem__, words))
    for w in new:
        if len(w) > _CACHED_LENGTH:
            known.pop(w, None)
    if len(known) > cached:
        _caches[path] = (tokenizer, {}, known)
    return ids


def pieces(
    docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = END_ID, id_column: str = "doc_id", text: str = "text", cached: int = CACHED_WORDS
) -> DataFrame:
    """``id_column, piece, start, length, ids_crc32``: each document's ids and the end id, cut only beyond ``limit``.

    A null or empty text gives one piece that holds the end id. Repeated rows
    are packed as often as they occur. Other columns are ignored. ``cached`` words
    are remembered by a task: fewer save memory, more save time.
    """
    closing = np.array([end_id], "<u4").tobytes()

    def compute(part: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        for key, value in zip(part["id"], part["text"]):
            ids = token_ids(value, path, cached) + closing
            for number, at in enumerate(range(0, len(ids), 4 * limit)):
                own = ids[at : at + 4 * limit]
                for column, x in zip(out.values(), (key, number, at // 4, len(own) // 4, zlib.crc32(own))):
                    column.append(x)
        return out

    def forget() -> None:
        if path in _caches:
            _caches[path] = (_caches[path][0], {}, {})

    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    return per_slice(rows, compute, "id long, piece int, start long, length long, ids_crc32 long", forget).withColumnRenamed("id", id_column)


def sum_of_squares(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; longer pieces first, equal ones in the order given."""
    counts = np.zeros(limit + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(limit + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        have, become = counts[size:limit], counts[: limit - size]
        gap = limit
        if size < limit:
            # Moving a bin from gap g to g - size changes the sum by 2 (N(g - size) - N(g)) + 2; a full bin no longer counts.
            change = 2 * (become - have) + 2
            change[0] = 1 - 2 * have[0]
            change[have == 0] = np.iinfo(np.int64).max
            best = int(change.argmin())
            if have[best] and change[best] <= 2 * counts[limit - size] + 1:
                gap = size + best
        if gap == limit:
            number, made = made, made + 1
        else:
            number = open_bins[gap].pop()
            counts[gap] -= 1
        bins[i], offsets[i] = number, limit - gap
        if gap > size:
            open_bins[gap - size].append(number)
            counts[gap - size] += 1
    return bins, offsets


def pack(cut: DataFrame, limit: int = LIMIT, lot: int = LOT, id_column: str = "doc_id") -> DataFrame:
    """Every row of ``pieces`` with its ``sequence_id`` and ``offset``.

    Rows are spread by a hash over lots of about ``lot`` pieces, whatever their
    ids are, and one task packs a lot; a lot ends with one or two sequences that
    are not full. Sequences of different lots have different numbers.
    """
    cut = stored(cut.withColumnRenamed(id_column, "id"), "pieces")
    lots = max(1, -(-cut.count() // lot))
    spread = F.pmod(F.xxhash64("id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(lots))

    def place(frame):
        frame = frame.sort_values(["id", "piece", "start", "length", "ids_crc32"], kind="stable")
        bins, offsets = sum_of_squares(frame["length"].to_numpy(), limit)
        return frame.assign(sequence_id=frame["lot"].to_numpy() * (1 << 32) + bins, offset=offsets).drop(columns="lot")

    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    packed = cut.withColumn("lot", spread.cast("long")).groupBy("lot").applyInPandas(place, schema)
    return packed.withColumnRenamed("id", id_column)
