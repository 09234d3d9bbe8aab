"""Benchmark passages in documents, found by q-gram counts in diagonal bands.

A stretch of a benchmark item (a probe) of m bytes that occurs with at most e edits
shares at least m + 1 - q (e + 1) q-grams with its place in the document, all on
diagonals (place in the document minus place in the item) at most e apart. So the
shared q-grams are counted per item and band of diagonals; bands overlap by half,
so that one of them holds the whole match. In bands that reach the bound they are
counted per probe, and probes that reach it are verified by an alignment within
the band. Probes start every ``STRIDE`` bytes, so that an excerpt of
``PROBE + STRIDE - 1`` bytes holds one, wherever it is from.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.rows import per_slice, small_batches, text_bytes

Q = 8
PROBE, STRIDE, SHORTEST = 96, 8, 40
# Items below this are also searched as a whole.
WHOLE = 144
EDITS = 0.08
BAND = 32
# Benchmark bytes that are searched in one pass over the documents, and sent to every worker.
BLOCK_BYTES = 4 << 20
_STRETCH, _OVERLAP, _POSTINGS = 1 << 22, 1 << 10, 1 << 22
_SAME = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz     ")
_BITS = 22
_BLANKS = re.compile(b"  +")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def normalized(data: bytes | None) -> bytes:
    """Lower-case ASCII letters, and one blank for each run of white space."""
    return _BLANKS.sub(b" ", (data or b"").translate(_SAME))


def _original(data: bytes) -> np.ndarray:
    """Where each byte of the normalised text stands in the text."""
    blank = np.frombuffer(data.translate(_SAME), np.uint8) == 32
    return np.flatnonzero(~(blank & np.append(False, blank[:-1])))


def _codes(data: bytes) -> np.ndarray:
    """The 8 bytes from each place on, as one number."""
    a = np.frombuffer(data, np.uint8)
    pairs = a[:-1].astype(np.uint16) | (a[1:].astype(np.uint16) << 8)
    fours = pairs[:-2].astype(np.uint32) | (pairs[2:].astype(np.uint32) << 16)
    return fours[:-4].astype(np.uint64) | (fours[4:].astype(np.uint64) << 32)


@dataclass
class Index:
    """q-grams of the probes of one block of the benchmark."""

    items: list  # item of each probe
    probes: list[bytes]
    starts: np.ndarray  # of each probe, its place in the item
    sizes: np.ndarray
    edits: np.ndarray
    least: np.ndarray  # q-grams that a match of a probe shares at least
    bounds: np.ndarray  # first probe of each text
    enough: np.ndarray  # of each text, the smallest bound of its probes
    longest: int
    grams: np.ndarray  # sorted, distinct
    first: np.ndarray  # of each q-gram, its first posting
    text_of: np.ndarray
    place_of: np.ndarray
    seen: np.ndarray  # small table that rules most q-grams out


def index(items: list[tuple[int, bytes]]) -> Index:
    """Probes: a short item as a whole, and overlapping stretches up to the end of one that is longer than a stretch."""
    texts = [(item, text) for item, text in ((item, normalized(data).strip(b" ")) for item, data in items) if len(text) >= SHORTEST]
    owners, probes, starts, bounds = [], [], [], [0]
    for item, text in texts:
        own = [(start, PROBE) for start in sorted({*range(0, len(text) - PROBE, STRIDE), len(text) - PROBE})] if len(text) > PROBE else []
        if len(text) < WHOLE:
            own.append((0, len(text)))
        for start, size in own:
            owners.append(item)
            probes.append(text[start : start + size])
            starts.append(start)
        bounds.append(len(probes))
    sizes = np.array([len(p) for p in probes], np.int64)
    edits = (sizes * EDITS).astype(np.int64)
    least = sizes + 1 - Q * (edits + 1)
    enough = np.array([least[a:b].min() for a, b in zip(bounds, bounds[1:])], np.int64)
    lengths = np.array([len(t) - Q + 1 for _, t in texts], np.int64)
    codes = np.concatenate([_codes(t) for _, t in texts]) if texts else np.empty(0, np.uint64)
    text_of = np.repeat(np.arange(len(texts)), lengths)
    place_of = np.concatenate([np.arange(n) for n in lengths]) if texts else np.empty(0, np.int64)
    order = np.argsort(codes, kind="stable")
    grams, first = np.unique(codes[order], return_index=True)
    seen = np.zeros(1 << _BITS, bool)
    seen[(grams * _ODD) >> np.uint64(64 - _BITS)] = True
    longest = max((len(t) for _, t in texts), default=0)
    return Index(
        owners, probes, np.array(starts, np.int64), sizes, edits, least, np.array(bounds), enough, longest, grams, np.append(first, len(codes)), text_of[order], place_of[order], seen
    )


def edit_distance(probe: bytes, region: bytes, limit: int) -> tuple[int, int] | None:
    """Fewest edits that turn the probe into a part of the region, and where that part ends; None above the limit."""
    at = region.find(probe)
    if at >= 0:
        return 0, at + len(probe)
    b = np.frombuffer(region, np.uint8)
    steps = np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64)
    for i, byte in enumerate(probe, 1):
        new = np.minimum(np.append(i, row[:-1] + (b != byte)), row + 1)
        # A run of insertions: the smallest earlier value plus the distance to it.
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > limit:
            return None
    end = int(row.argmin())
    return (int(row[end]), end) if row[end] <= limit else None


def matches(data: bytes, found: Index, one: bool = False) -> dict[tuple[int, int], tuple[int, int, int]]:
    """Of one normalised text: (probe, end) -> edits, start, end of each verified region, or of the first one found."""
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    offset = -(-found.longest // BAND) * BAND
    todo = [(at, min(_STRETCH, len(data) - at)) for at in range(0, len(data), _STRETCH)]
    while todo:
        origin, size = todo.pop()
        stretch = data[origin : origin + size + _OVERLAP]
        if len(stretch) < Q or not len(found.grams):
            continue
        codes = _codes(stretch)
        places = np.flatnonzero(found.seen[(codes * _ODD) >> np.uint64(64 - _BITS)])
        codes = codes[places]
        at = np.minimum(np.searchsorted(found.grams, codes), len(found.grams) - 1)
        hit = found.grams[at] == codes
        places, at = places[hit], at[hit]
        lengths = found.first[at + 1] - found.first[at]
        total = int(lengths.sum())
        if total > _POSTINGS and size > 1:  # monotonous text: a piece at a time
            todo += [(origin, size // 2), (origin + size // 2, size - size // 2)]
            continue
        if not total:
            continue
        posting = np.repeat(found.first[at] - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(total)
        text, inner = found.text_of[posting], found.place_of[posting]
        diagonal = np.repeat(places, lengths) - inner + offset
        for shift in (0, BAND // 2):
            keys, which, counts = np.unique(text * (1 << 32) + (diagonal + shift) // BAND, return_inverse=True, return_counts=True)
            chosen = np.flatnonzero(counts >= found.enough[keys >> 32])
            if not len(chosen):
                continue
            kept = np.zeros(len(keys), bool)
            kept[chosen] = True
            hits = np.flatnonzero(kept[which])
            hits = hits[np.lexsort((inner[hits], which[hits]))]
            ends = np.cumsum(counts[chosen])
            for key, end, count in zip(keys[chosen].tolist(), ends.tolist(), counts[chosen].tolist()):
                own, low = inner[hits[end - count : end]], (key & 0xFFFFFFFF) * BAND - shift - offset
                a, b = found.bounds[key >> 32], found.bounds[(key >> 32) + 1]
                starts, sizes = found.starts[a:b], found.sizes[a:b]
                shared = np.searchsorted(own, starts + sizes - Q, "right") - np.searchsorted(own, starts)
                for p in (a + np.flatnonzero(shared >= found.least[a:b])).tolist():
                    limit, first = int(found.edits[p]), low + int(found.starts[p])
                    start = max(0, first - limit)
                    region = stretch[start : max(0, first + BAND + len(found.probes[p]) + limit)]
                    verified = edit_distance(found.probes[p], region, limit)
                    if verified:
                        edits, stop = verified[0], origin + start + verified[1]
                        out[p, stop] = (edits, max(0, stop - len(found.probes[p])), stop)
                        if one:
                            return out
    return out


def _characters(data: bytes, place: int) -> int:
    return len(data[:place].decode("utf-8", "ignore"))


def _indexes(benchmark: DataFrame, item_id: str, item_text: str):
    """A broadcast index for each block of the benchmark; a block is at most about ``BLOCK_BYTES`` of text."""
    listed = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).cast("binary").alias("data")).where("data IS NOT NULL").distinct()
    size = listed.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    for block in range(blocks):
        own = listed.where(F.pmod(F.xxhash64("item", "data"), F.lit(blocks)) == block).orderBy("item", "data").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(index([(r["item"], bytes(r["data"])) for r in own]))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per document and benchmark item found in it: ``doc_id, item_id, n_probes, n_found, edits, start, length``.

    ``n_probes`` is how many probes the item has, ``n_found`` how many of them
    occur; ``edits`` is the smallest number of edits, ``start`` and ``length`` span
    the matches in characters. An item of fewer than 40 bytes is no evidence
    and is never reported, nor are null or empty texts. Repeated items count
    once, repeated documents as often as they occur. Other columns are ignored.
    The benchmark is searched in blocks of bounded size, each with one pass over
    the documents.
    """
    rows = text_bytes(docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")), "doc_id")
    schema = "doc_id long, item_id long, n_probes int, n_found int, edits int, start long, length long"

    def search(part: dict[str, list], shared) -> dict[str, list]:
        found: Index = shared.value
        out: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
        sizes = Counter(found.items)
        for key, data in zip(part["doc_id"], part["_text"]):
            by_item: dict = {}
            for (p, _), match in matches(normalized(data), found).items():
                by_item.setdefault(found.items[p], []).append((p, match))
            for item, own in sorted(by_item.items(), key=lambda x: (x[0] is None, x[0])):
                start, stop = min(m[1] for _, m in own), max(m[2] for _, m in own)
                place = _original(data)
                start, stop = int(place[start]), int(place[stop - 1]) + 1
                begin = _characters(data, start)
                row = (key, item, sizes[item], len({p for p, _ in own}), min(m[0] for _, m in own), begin, _characters(data, stop) - begin)
                for column, x in zip(out.values(), row):
                    column.append(x)
        return out

    parts = [per_slice(rows, partial(search, shared=shared), schema) for shared in _indexes(benchmark, item_id, item_text)]
    return reduce(DataFrame.union, parts)


def clean_of(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without any benchmark passage, all columns kept; each row is judged by its own text, so nothing is shuffled."""
    kept = docs
    for shared in _indexes(benchmark, item_id, item_text):

        def drop(batches, shared=shared):
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
                clean = [not matches(normalized(texts[i].as_py()), shared.value, one=True) for i in range(batch.num_rows)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        kept = small_batches(kept).mapInArrow(drop, docs.schema)
    return kept
