"""Near-duplicate passages by compact windows.

The tokens of a text are its shingles of five words. Under one hash function the
Cartesian tree over the token hashes divides all subsequences of ``LEAST`` tokens
or more by where their smallest hash stands: the window (first, least, last) of a
node holds every subsequence around it in which no hash is smaller, and all of
these share one min-hash. Windows of two documents with equal min-hashes collide;
where windows of enough functions collide on intersecting stretches of the same
two documents, the stretches are candidates, and their tokens are compared.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from almanac.llm.anchors import sliding_minimum
from almanac.llm.repeats import _NO_ID, _batch, _copies, _hashed, _prepared, covered
from almanac.llm.rows import SLICE, per_slice, sliced, small_batches
from almanac.operators.joins import many_to_one
from almanac.session import new_path, remove, stored

WIDTH, LEAST = 5, 46  # 46 shingles are 50 words
SIMILARITY = 0.8
FUNCTIONS, ENOUGH = 4, 2
# Windows with one min-hash: up to FEW all pairs, beyond that with the smallest document of each class, in shares of about CROWD.
FEW, CROWD = 4, 256
# Stretches without a link that are held at once, about.
BLOCK = 4096
# Added to the function of a collision that is a candidate by itself.
ALONE = 8
# Stands for the function in the key of two intersecting windows.
BOTH = 7
GAP = 2 * WIDTH
# Beyond the last token of any text.
WHOLE = 1 << 30
# Texts of about so many tokens are handled in one go, and of about so many bytes are split into words.
TOGETHER, PIECE = 1 << 15, 1 << 17
# Stretches with about so many bytes of words meet in one go, so many pairs and places at a time.
TOGETHER_BYTES, PAIRS, CELLS = 1 << 21, 1 << 12, 1 << 21
# Words of up to so many letters are hashed all at once.
LETTERS = 32
_PLACE = 24
_WORD, _SPACE = re.compile(rb"[^\x20\x09-\x0d]+"), re.compile(rb"[\x20\x09-\x0d]")
_MULTIPLY = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _letters() -> np.ndarray:
    """What a letter adds to the CRC of a word, by the letters behind it; capitals count as small letters."""
    table = [[zlib.crc32(bytes([b]).lower() + bytes(k)) ^ zlib.crc32(bytes(k + 1)) for b in range(256)] for k in range(LETTERS)]
    return np.array(table, np.uint32)


# The CRC of a word is that of as many zeros with the sum (exclusive or) of what its letters add.
_ADDED, _ZEROS = _letters(), np.array([zlib.crc32(bytes(n)) for n in range(LETTERS + 1)], np.uint32)


def _pieces(data: bytes) -> Iterator[bytes]:
    """The text in stretches of about ``PIECE`` bytes that end at white space."""
    start = 0
    while len(data) - start > 2 * PIECE:
        gap = _SPACE.search(data, start + PIECE)
        end = gap.start() if gap else len(data)
        yield data[start:end]
        start = end
    yield data[start:] if start else data


def _hashed_pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """As in ``hashed_words``, all in one go."""
    data = b" ".join([b"", *texts, b""])
    raw = np.frombuffer(data, np.uint8)
    space = (raw - np.uint8(9) < 5) | (raw == 32)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    sizes = ends - starts
    lengths = np.minimum(sizes, LETTERS).astype(np.uint8)
    # The longest words come first, so that those with a letter left are the first ones.
    order = np.argsort(~lengths, kind="stable")
    last, left = ends[order] - 1, len(order)
    found = _ZEROS[lengths[order]]
    for k, n in enumerate(np.bincount(lengths, minlength=LETTERS + 1)[:LETTERS].tolist()):
        left -= n
        if not left:
            break
        found[:left] ^= _ADDED[k].take(raw.take(last[:left], mode="clip"), mode="clip")
        last[:left] -= 1
    words = np.empty_like(found)
    words[order] = found
    for i in np.flatnonzero(sizes > LETTERS).tolist():
        words[i] = zlib.crc32(data[starts[i] : ends[i]].lower())
    stops = (np.fromiter(map(len, texts), np.int64, len(texts)) + 1).cumsum()
    return words, np.diff(np.searchsorted(starts, stops), prepend=0)


def hashed_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of 32 bits (CRC) of each lower-cased word of some texts in a row, and how many words each text has."""
    words, counts = [np.empty(0, np.uint32)], np.zeros(len(texts), np.int64)
    held, owners, size = [], [], 0
    for i, piece in chain(((i, piece) for i, data in enumerate(texts) for piece in _pieces(data or b"")), [(None, b"")]):
        if held and (i is None or size + len(piece) > 2 * PIECE):
            found, n = _hashed_pieces(held)
            words.append(found)
            np.add.at(counts, owners, n)
            held, owners, size = [], [], 0
        if i is not None:
            held.append(piece)
            owners.append(i)
            size += len(piece)
    return np.concatenate(words), counts


def word_hashes(data: bytes | None) -> np.ndarray:
    """A hash of 32 bits of each lower-cased word."""
    return hashed_words([data])[0]


def shingled(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A hash of each ``width`` words in a row, from the hashes of the words; fewer words give none."""
    w = words.astype(np.uint64)
    n = len(w) - width + 1
    if n <= 0:
        return w[:0]
    total = w[:n].copy()
    for i in range(1, width):
        total *= _MULTIPLY[0]
        total += w[i : i + n]
    total ^= total >> np.uint64(32)
    total *= _MIX
    return total


def shingled_texts(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``shingled`` of some texts in a row with so many words each, and how many shingles each has."""
    found = shingled(words)
    whole, ends = np.ones(len(found), bool), counts.cumsum()
    for k in range(1, WIDTH):
        # The last ones run into the next text.
        over = ends[counts >= k] - k
        whole[over[over < len(found)]] = False
    return found[whole], np.maximum(counts - WIDTH + 1, 0)


def tokens(data: bytes | None, width: int = WIDTH) -> np.ndarray:
    """A hash of each shingle of the lower-cased words; fewer words give none."""
    return shingled(word_hashes(data), width)


def _ranks(shingles: np.ndarray, function: int, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes under one function, and the same with the place in the last bits, so that no two nearby ones are equal."""
    mixed = shingles + _MULTIPLY[function]
    mixed *= _MULTIPLY[function]
    mixed ^= mixed >> np.uint64(31)
    mixed *= _MIX
    place = np.arange(len(shingles)) if place is None else place
    ranks = mixed & ~np.uint64((1 << _PLACE) - 1)
    ranks |= place.astype(np.uint64, copy=False) & np.uint64((1 << _PLACE) - 1)
    return mixed, ranks


def compact_windows(smallest: np.ndarray, least: int = LEAST, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, first and last token of the nodes of ``least`` tokens or more of the Cartesian tree, from the smallest ranks of ``least`` in a row.

    A node is so wide exactly if its token is the smallest of some ``least`` in a
    row, so the distinct sliding minima are these nodes, in order. A subsequence
    of ``least`` tokens reaches no further than ``least`` from its smallest one; up to
    there, the node's window runs from the first to the last stretch that the
    token is the smallest of. ``at`` tells where each stretch starts in its text, if
    there are several texts in a row; one with a stretch has one that starts at 0.
    """
    at = np.arange(len(smallest)) if at is None else at
    new = at == 0
    new[1:] |= smallest[1:] != smallest[:-1]
    starts = np.flatnonzero(new)
    first = at[starts]
    # Places are counted modulo 2^24 in the ranks; the start of the first stretch tells the rest.
    low = (smallest[starts] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    place = first + (low - first) % (1 << _PLACE)
    last = at[np.append(starts[1:], len(smallest))[: len(starts)] - 1] + least - 1
    return place, first, last


def _windows(docs: np.ndarray, shingles: np.ndarray, sizes: np.ndarray, least: int, whole: bool = True) -> Iterator[dict[str, np.ndarray]]:
    """The windows of some texts of ``least`` tokens or more, function by function, computed on all of them in a row; unless ``whole``, only ``h`` and ``doc``."""
    base = sizes.cumsum() - sizes
    place = np.arange(len(shingles)) - np.repeat(base, sizes)
    inside = (place <= np.repeat(sizes - least, sizes))[: len(place) - least + 1]
    at = place[: len(inside)][inside]
    last_bits = place.astype(np.uint64)
    mixed, ranks = zip(*(_ranks(shingles, f, last_bits) for f in range(FUNCTIONS)))
    half = (least + 1) // 2
    halves = [sliding_minimum(r, half) for r in ranks]
    smallest = [np.minimum(r[: len(inside)], r[least - half :])[inside] for r in halves]
    for f in range(FUNCTIONS):
        c, first, last = compact_windows(smallest[f], least, at)
        own = (first == 0).cumsum() - 1
        h = ((mixed[f][base[own] + c] & ~np.uint64(7)) | np.uint64(f)).view(np.int64)
        # A run of equal min-hashes (one word over and over) is one window, since all its subsequences share the min-hash.
        new = first == 0
        new[1:] |= h[1:] != h[:-1]
        if not whole:
            yield {"h": h[new], "doc": docs[own[new]]}
            continue
        end = np.append(new[1:], True)
        run, h, own, c, first, last = ~end[new], h[new], own[new], c[new], first[new], last[end]
        # Alike windows are told by what stands before or after the place: a passage of ``least`` tokens holds the half of ``least``
        # on one side at least, so all that have it agree there. Alike runs are told by what they are made of.
        inner, sides = np.minimum(c, last - least + 1), []
        for start in (c - half + 1, c):
            start = np.clip(np.where(run, inner, start), 0, sizes[own] - half)
            sides.append((halves[(f + 1) % FUNCTIONS][base[own] + start] >> np.uint64(33)).astype(np.int64))
        reach = (last - c) * least + c - first
        yield {"h": h, "doc": docs[own], "c": c, "reach": reach, "sides": sides[0] << 32 | sides[1], "base": base[own]}


def _both(a: dict[str, np.ndarray], b: dict[str, np.ndarray], least: int) -> dict[str, np.ndarray]:
    """Windows of two functions that intersect in ``least`` tokens, one of them in a group of more than ``FEW``, as rows under one key of both min-hashes.

    Two documents with equal keys are just those whose windows of two functions
    collide on intersecting stretches. ``sides`` holds the first and last token of
    both windows, ``spot`` the larger group and the place of one, ``reach`` that of the other.
    """
    ends = [(w["base"] + w["c"] - w["reach"] % least, w["base"] + w["c"] + w["reach"] // least) for w in (a, b)]
    # Windows of a function come in order of both ends, and those of different texts lie apart.
    low = np.searchsorted(ends[1][1], ends[0][0] + least - 1, "left")
    count = np.maximum(np.searchsorted(ends[1][0], ends[0][1] - least + 1, "right") - low, 0)
    i = np.repeat(np.arange(len(low)), count)
    j = np.arange(len(i)) - np.repeat(count.cumsum() - count, count) + np.repeat(low, count)
    n = np.maximum(a["n"][i], b["n"][j])
    i, j, n = i[n > FEW], j[n > FEW], n[n > FEW]
    base = a["base"][i]
    first, last = np.minimum(ends[0][0][i], ends[1][0][j]) - base, np.maximum(ends[0][1][i], ends[1][1][j]) - base
    key = (a["h"][i].view(np.uint64) * _MULTIPLY[0] + b["h"][j].view(np.uint64)) * _MULTIPLY[1]
    key = ((key ^ (key >> np.uint64(32))) * _MIX) | np.uint64(BOTH)
    return {"h": key.view(np.int64), "sides": first << 32 | last, "doc": a["doc"][i], "spot": n << 32 | a["c"][i], "reach": b["c"][j]}


def _together(part: dict[str, list], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers and ids of the texts of ``least`` tokens or more, their tokens in a row and how many each has, about ``TOGETHER`` tokens at a time."""
    words, counts = hashed_words(part["bytes"])
    ids, starts = np.array(part["doc"], np.int64), np.append(0, counts.cumsum())
    turns = np.append(0, np.maximum(counts - WIDTH + 1, 0).cumsum() // TOGETHER)
    for group in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(turns[1:])) + 1):
        if len(group):
            shingles, sizes = shingled_texts(words[starts[group[0]] : starts[group[-1] + 1]], counts[group])
            long = sizes >= least
            if long.any():
                yield group[long], ids[group[long]], shingles if long.all() else shingles[np.repeat(long, sizes)], sizes[long]


def _window_rows(texts: DataFrame, least: int) -> DataFrame:
    """``h, doc``: min-hash (its last bits name the function) and document of every window."""

    def compute(part: dict[str, list]) -> dict[str, list]:
        found: dict[str, list] = {name: [np.empty(0, np.int64)] for name in ("h", "doc")}
        for _, docs, shingles, sizes in _together(part, least):
            for rows in _windows(docs, shingles, sizes, least, whole=False):
                for name, column in found.items():
                    column.append(rows[name])
        return {name: np.concatenate(column) for name, column in found.items()}

    return per_slice(texts.select("doc", "bytes"), compute, "h long, doc long")


def _wanted_windows(holding: DataFrame, least: int) -> DataFrame:
    """``h, sides, doc, spot, reach`` of the windows whose min-hash is among the ``wanted`` ones of the text: min-hash (its last bits name the
    function), the min-hashes of the next function before and after the place, by which alike surroundings are told, document, number of
    windows with that min-hash and place, and how far the window goes to both sides. With them come the rows of ``_both``."""

    def compute(part: dict[str, list]) -> dict[str, list]:
        found: dict[str, list] = {name: [np.empty(0, np.int64)] for name in ("h", "sides", "doc", "spot", "reach")}
        wanted, bounds = part["wanted"].flatten(), np.append(0, part["wanted"].value_lengths().to_numpy().cumsum())
        all_h, all_n = (wanted.field(k).to_numpy() for k in range(2))
        for texts, docs, shingles, sizes in _together(part, least):
            # A min-hash that one text wants is repeated, so every text here that has it wants it.
            some = slice(bounds[texts[0]], bounds[texts[-1] + 1])
            h, first = np.unique(all_h[some], return_index=True)
            n = all_n[some][first].astype(np.int64)
            functions = []
            for rows in _windows(docs, shingles, sizes, least):
                at = np.minimum(np.searchsorted(h, rows["h"]), len(h) - 1)
                rows["n"], kept = n[at], h[at] == rows["h"]
                rows["spot"] = rows["n"] << 32 | rows["c"]
                functions.append({name: column[kept] for name, column in rows.items()})
            for rows in functions + [_both(a, b, least) for a, b in combinations(functions, 2)]:
                for name, column in found.items():
                    column.append(rows[name])
        return {name: np.concatenate(column) for name, column in found.items()}

    return per_slice(holding, compute, "h long, sides long, doc long, spot long, reach long", arrow=("wanted",))


_PAIRS = pa.schema([("y", pa.int64()), ("x", pa.int64()), ("f", pa.int32()), ("cy", pa.int32()), ("ry", pa.int64()), ("cx", pa.int32()), ("rx", pa.int64())])
_PAIRS_DDL = "y long, x long, f int, cy int, ry long, cx int, rx long"


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, str], above: int = 0) -> Iterator[dict[str, np.ndarray]]:
    """The windows of groups of more than ``above`` as columns, without the rows of ``_both``; ``group`` numbers the keys, none of which is divided."""
    held: list[dict[str, np.ndarray]] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            rows = {name: batch.column(name).to_numpy() for name in batch.schema.names}
            kept = ((rows["h"] & 7) != BOTH) & (rows["n"] > above)
            held.append({name: column[kept] for name, column in rows.items()})
        rows = {name: np.concatenate([part[name] for part in held]) for name in held[0]} if held else {"h": np.empty(0)}
        if not len(rows["h"]):
            continue
        new = np.append(False, np.logical_or.reduce([rows[k][1:] != rows[k][:-1] for k in keys]))
        rows["group"] = new.cumsum()
        end = len(new) if batch is None else int(np.searchsorted(rows["group"], rows["group"][-1]))
        if end:
            yield {name: column[:end] for name, column in rows.items()}
        held = [{name: column[end:] for name, column in rows.items() if name != "group"}]


def _classes(rows: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The classes of the windows of a group: all, and those with the same surroundings before or after the place. By class: name, rows in order of it, which are its first."""
    names = [np.full(len(rows["h"]), -1)]
    if "sides" in rows:
        names += [2 * (rows["sides"] >> 32), 2 * (rows["sides"] & 0xFFFFFFFF) + 1]
    for name in names:
        order = np.lexsort((name, rows["group"]))
        first = np.append(True, (np.diff(rows["group"][order]) > 0) | (np.diff(name[order]) != 0))[: len(order)]
        yield name, order, first


_PASSAGES = "y long, start_word int, n_words int, x long, source_start int, source_words int, similarity double"


def _shared_both(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of ``_both`` whose key is there again, and all of crowded ones, in the columns of passages; without a similarity.

    Rows come sorted by key. ``y`` is the document, ``x`` the key, then follow the
    first and last token of the windows and their places.
    """
    names = ("h", "sides", "doc", "n", "c", "reach")
    # The last row of a batch waits for the first of the next; a row of another key ends the table.
    waiting: dict[str, np.ndarray] = {name: np.empty(0, np.int64) for name in names}
    before = None
    for batch in chain(batches, [None]):
        rows = waiting
        if batch is not None:
            kept = (batch.column("h").to_numpy() & 7) == BOTH
            rows = {name: np.concatenate([waiting[name], batch.column(name).to_numpy()[kept]]) for name in names}
        if not len(rows["h"]):
            continue
        h, n = rows["h"], rows["n"]
        again = np.append(h[1:] == h[:-1], False)
        again[1:] |= h[1:] == h[:-1]
        again[0] |= h[0] == before
        size = len(h) - (batch is not None)
        part = {name: column[:size][(again | (n > CROWD))[:size]] for name, column in rows.items()}
        waiting = {name: column[size:] for name, column in rows.items()}
        before = h[size - 1] if size else before
        columns = [part["doc"], part["sides"] >> 32, part["sides"] & 0xFFFFFFFF, part["h"], part["c"], part["reach"]]
        arrays = [pa.array(c, pa.int64()).cast(f.type) for c, f in zip(columns, schema)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(part["h"]), pa.float64())], schema=schema)


def _collide(batches: Iterator[pa.RecordBatch], keys: tuple[str, str] = ("h", "salt")) -> Iterator[pa.RecordBatch]:
    """Colliding windows of different documents: all pairs of a few.

    In larger groups, which come sorted by document, each is paired with the
    smallest document of each of its classes and with the one before it there, and
    one such collision makes a candidate.
    """
    for rows in _whole_groups(batches, keys):
        doc, few = rows["doc"], rows["n"] <= FEW
        pairs, step = [], 1
        # Rows of a group stand in a row.
        while len(some := np.flatnonzero(few[step:] & (rows["group"][step:] == rows["group"][:-step]))):
            pairs.append((some, some + step))
            step += 1
        crowded = np.flatnonzero(~few)
        large = {name: column[crowded] for name, column in rows.items()}
        for _, order, first in _classes(large):
            # Of a document the first row in a class stands for it, the one of the document before is its partner.
            starts = np.flatnonzero(first | np.append(True, np.diff(large["doc"][order]) != 0)[: len(order)])
            later = starts[~first[starts]]
            pairs.append((crowded[order[starts[np.searchsorted(starts, later) - 1]]], crowded[order[later]]))
            pairs.append((crowded[order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]], crowded[order]))
        a, b = (np.concatenate(side) for side in zip(*pairs))
        kept = doc[a] != doc[b]
        a, b = np.divmod(np.unique(a[kept] * len(doc) + b[kept]), len(doc))
        columns = [doc[b], doc[a], (rows["h"][b] & 7) + np.where(few[b], 0, ALONE), rows["c"][b], rows["reach"][b], rows["c"][a], rows["reach"][a]]
        yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()).cast(field.type) for column, field in zip(columns, _PAIRS)], schema=_PAIRS)


def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of crowded min-hashes, without the rows of ``_both``."""
    for batch in batches:
        yield batch.filter(pa.array(((batch.column("h").to_numpy() & 7) != BOTH) & (batch.column("n").to_numpy() > CROWD)))


def _leaders(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Of each share of a crowded min-hash the smallest document's window, in all and of each class."""
    for rows in _whole_groups(batches, ("h", "salt"), CROWD):
        for name, order, first in _classes(rows):
            some = order[first]
            yield pa.RecordBatch.from_arrays([pa.array((rows | {"near": name})[f.name][some], f.type) for f in schema], schema=schema)


def _boxes(cy: np.ndarray, ry: np.ndarray, cx: np.ndarray, rx: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """First and last tokens of both windows of collisions, from their places and reaches."""
    return cy - ry % least, cy + ry // least, cx - rx % least, cx + rx // least


def joined(boxes: list[tuple[int, int, int, int, int]], least: int = LEAST, enough: int = ENOUGH) -> list[tuple[int, int, int, int]]:
    """Stretches (y first, y last, x first, x last) on which windows of enough functions collide.

    ``boxes`` holds both windows, first to last token, and the function of the collisions
    of two documents. Rectangles that intersect in ``least`` tokens of both documents
    support each other; supported ones, and those that need no support (their
    function is ``ALONE`` or more), are joined where they overlap.
    """
    boxes = sorted(set(boxes))
    support: list[set[int]] = [{b[4] % ALONE} for b in boxes]
    for i, (y0, y1, x0, x1, f) in enumerate(boxes):
        for j in range(i + 1, len(boxes)):
            b = boxes[j]
            if b[0] > y1 - least + 1:
                break
            if min(y1, b[1]) - b[0] + 1 >= least and min(x1, b[3]) - max(x0, b[2]) + 1 >= least:
                support[i].add(b[4] % ALONE)
                support[j].add(f % ALONE)
    found: list[list[int]] = []
    for (y0, y1, x0, x1, f), functions in zip(boxes, support):
        if len(functions) < enough and f < ALONE:
            continue
        for own in reversed(found[-8:]):
            if y0 <= own[1] and x0 <= own[3] and x1 >= own[2]:
                own[1], own[2], own[3] = max(own[1], y1), min(own[2], x0), max(own[3], x1)
                break
        else:
            found.append([y0, y1, x0, x1])
    return [tuple(x) for x in found]


def _densest(held: np.ndarray, least: int) -> tuple[int, int]:
    """First and last place of the stretch of ``least`` places of which most are held."""
    width = min(least, len(held))
    total = np.append(0, held.cumsum())
    first = int((total[width:] - total[:-width]).argmax())
    return first, first + width - 1


def verified(y: np.ndarray, x: np.ndarray, least: int = LEAST, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """Passages (y first, y last, x first, x last, Jaccard similarity) of two token sequences.

    A run of tokens that x has on about one diagonal is a passage if the sets of
    tokens of both sides reach the similarity. In a looser run those stretches
    are passages of which every ``least`` tokens reach it; the smallest is given.
    """
    if not len(x):
        return []
    values, first_at, times = np.unique(x, return_index=True, return_counts=True)
    at = np.minimum(np.searchsorted(values, y), len(values) - 1)
    place = np.where(values[at] == y, first_at[at], -1)
    hits = np.flatnonzero(place >= 0)
    if len(hits) < least * similarity:
        return []
    if (times[at[hits]] == 1).all():
        return _runs(y, x, hits, place, least, similarity)
    # Tokens that x holds several times are placed from the front. For those that no passage holds then, from the back and on every diagonal.
    found = _runs(y, x, hits, _placed(y, x, hits), least, similarity)
    # A token that no ``least`` in a row with enough hits hold is in no passage of that length.
    left = _dense(place >= 0, least, least * similarity)
    for first, last, *_ in found:
        left[first : last + 1] = False
    for place in _other_places(y, x, hits, least * similarity) if left.any() else ():
        if not (left & _dense(place >= 0, least, least * similarity)).any():
            continue
        for passage in _runs(y, x, np.flatnonzero(place >= 0), place, least, similarity, left):
            if left[passage[0] : passage[1] + 1].any():
                found.append(passage)
                left[passage[0] : passage[1] + 1] = False
        if not left.any():
            break
    return found


def _between(held: np.ndarray, sizes: np.ndarray, span: int) -> np.ndarray:
    """Which places of some rows of so many each lie between two held ones, at least ``span`` apart, if ``SIMILARITY`` of those from one to the other are held."""
    n = len(held)
    if n <= span:
        return np.zeros(n, bool)
    # What is gained above the similarity. Each row stands below all before it, so no row meets another.
    gained = held.cumsum() - SIMILARITY * np.arange(n) - np.repeat(np.arange(len(sizes)) * (n + 1.0), sizes)
    low = np.minimum.accumulate(np.where(held, gained, np.inf))
    high = np.maximum.accumulate(np.where(held, gained, -np.inf)[::-1])[::-1]
    total = np.append(0, (high[span:] >= low[:-span] + (SIMILARITY - 1 - 1e-3)).cumsum())
    places = np.arange(n)
    return total[np.minimum(places + 1, n - span)] > total[np.maximum(places - span, 0)]


def _repeating(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of some rows of so many tokens each hold a token twice (or two with 40 equal bits)."""
    keys = np.repeat(np.arange(len(sizes), dtype=np.uint64) << np.uint64(40), sizes) | (tokens >> np.uint64(24))
    keys.sort()
    found = np.zeros(len(sizes), bool)
    found[(keys[1:][keys[1:] == keys[:-1]] >> np.uint64(40)).astype(np.int64)] = True
    return found


def _buckets(tokens: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers by which tokens of a group are told apart, mostly, and how many there are; equal tokens of a group have one."""
    bits = max(10, int(len(tokens)).bit_length() + 2)
    return (((tokens ^ (groups.astype(np.uint64) * _MULTIPLY[2])) * _MULTIPLY[0]) >> np.uint64(64 - bits)).astype(np.int64), 1 << bits


def _span(least: int, looser: bool = False) -> int:
    """So far apart at least are the first and last shared token of a passage of y; in x (``looser``) they may stand closer."""
    return int(np.ceil((SIMILARITY if looser else 2 * SIMILARITY / (1 + SIMILARITY)) * least)) - 1


def _may_hold(tokens: np.ndarray, sizes: np.ndarray, sources: list[np.ndarray], least: int) -> np.ndarray:
    """Which of some rows of so many tokens each may have a passage of their source: some stretch is shared to the similarity, wherever its tokens stand there."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    others = np.array([len(x) for x in sources], np.int64)
    at, n = _buckets(np.concatenate([tokens, *sources]), np.append(row, np.repeat(np.arange(len(sizes)), others)))
    there = np.zeros(n, bool)
    there[at[len(tokens) :]] = True
    held = there[at[: len(tokens)]]
    found = np.bincount(row, held, len(sizes)) >= least * SIMILARITY
    # Of tokens that repeat only the number counts.
    near = np.bincount(row, _between(held, sizes, _span(least)), len(sizes)) > 0
    return found & (near | _repeating(tokens, sizes))


def _verified_rows(tokens: np.ndarray, sizes: np.ndarray, sources: list[np.ndarray], least: int) -> Iterator[tuple[int, int, int, int, int, float]]:
    """``verified`` for rows of so many tokens each and a source: number of the row and its passages."""
    kept = _may_hold(tokens, sizes, sources, least)
    rows, own, sizes = np.flatnonzero(kept).tolist(), tokens[np.repeat(kept, sizes)], sizes[kept]
    if not rows:
        return
    others = np.array([len(sources[i]) for i in rows], np.int64)
    source, row = np.concatenate([sources[i] for i in rows]), np.repeat(np.arange(len(rows)), sizes)
    odd = _repeating(own, sizes) | _repeating(source, others)
    # Tokens of a row and its source meet by number and token.
    keyed = lambda n, t: np.repeat(np.arange(len(n), dtype=np.uint64) << np.uint64(44), n) | (t >> np.uint64(20))
    keys = keyed(others, source)
    order = np.argsort(keys)
    at = order[np.minimum(np.searchsorted(keys[order], keyed(sizes, own)), len(order) - 1)]
    place = at - (others.cumsum() - others)[row]
    there = np.where((source[at] == own) & (place >= 0) & (place < others[row]) & ~odd[row], place, -1)
    for i, *passage in zip(*(column.tolist() for column in aligned(there, sizes, least))):
        yield rows[i], *passage
    ends = sizes.cumsum()
    for i in np.flatnonzero(odd).tolist():
        for passage in verified(own[ends[i] - sizes[i] : ends[i]], sources[rows[i]], least):
            yield rows[i], *passage


def _dense(held: np.ndarray, least: int, enough: float) -> np.ndarray:
    """Which of the held places lie in ``least`` in a row of which enough are held."""
    total = np.append(0, held.cumsum())
    edges = np.zeros(len(held) + 1, np.int64)
    first = np.flatnonzero(total[least:] - total[:-least] >= enough)
    edges[first] += 1
    edges[first + least] -= 1
    return held & (edges.cumsum()[:-1] > 0)


def _other_places(y: np.ndarray, x: np.ndarray, hits: np.ndarray, enough: float) -> Iterator[np.ndarray]:
    """Places in x of the tokens of y as seen from the back, then next to each diagonal that has ``enough`` of them nearby."""
    back = np.full(len(y), -1)
    back[hits] = len(x) - 1 - _placed(y[::-1], x[::-1], len(y) - 1 - hits[::-1])[len(y) - 1 - hits]
    yield back
    order = np.argsort(x, kind="stable")
    low, high = (np.searchsorted(x[order], y[hits], side) for side in ("left", "right"))
    step, total = GAP // 2, (high - low).cumsum()
    near = np.zeros((len(x) + len(y)) // step + 3, np.int64)
    at = 0
    while at < len(hits):
        # About a million places at a time.
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 20), "right")))
        count = high[at:to] - low[at:to]
        k = np.arange(count.sum()) - np.repeat(count.cumsum() - count, count) + np.repeat(low[at:to], count)
        near += np.bincount((order[k] - np.repeat(hits[at:to], count) + len(y)) // step + 1, minlength=len(near))
        at = to
    near[1:-1] += near[:-2] + near[2:]
    # Places in order of token and place; those of a token stand from low to high.
    width = len(x) + len(y)
    rank = np.searchsorted(x[order], x[order]) * 2 * width + order
    for band in np.flatnonzero(near[1:-1] >= enough).tolist():
        wanted = hits + band * step + step // 2 - len(y)
        k = np.searchsorted(rank, low * 2 * width + np.clip(wanted, 0, width))
        after, before = order[np.minimum(k, high - 1)], order[np.maximum(k - 1, low)]
        own = np.where(np.abs(after - wanted) <= np.abs(before - wanted), after, before)
        place = np.full(len(y), -1)
        kept = np.abs(own - wanted) <= GAP
        place[hits[kept]] = own[kept]
        if kept.sum() >= enough:
            yield place


def _placed(y: np.ndarray, x: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Places in x of the tokens of y: of several the one nearest to the diagonal of the token before."""
    order = np.argsort(x, kind="stable")
    low, high = (np.searchsorted(x[order], y[hits], side).tolist() for side in ("left", "right"))
    places, place = order.tolist(), np.full(len(y), -1)
    before, own = None, 0
    for i, a, b in zip(hits.tolist(), low, high):
        if before is None or b - a == 1:
            own = places[a]
        else:
            expected = own + i - before
            k = bisect_left(places, expected, a, b)
            own = places[k] if k == a or (k < b and places[k] - expected <= expected - places[k - 1]) else places[k - 1]
        place[i], before = own, i
    return place


def _runs(y: np.ndarray, x: np.ndarray, hits: np.ndarray, place: np.ndarray, least: int, similarity: float, wanted: np.ndarray | None = None) -> list[tuple[int, int, int, int, float]]:
    """The passages among runs of ``hits``, tokens of y whose ``place`` in x stays on about one diagonal; only runs with ``wanted`` tokens, if given."""
    ends = np.append(np.flatnonzero((np.diff(hits) > GAP + 1) | (np.abs(np.diff(place[hits]) - np.diff(hits)) > GAP)), len(hits) - 1)
    starts = np.append(0, ends[:-1] + 1)
    long = np.flatnonzero(hits[ends] - hits[starts] + 1 >= least)
    found = []
    for run in (hits[a : b + 1] for a, b in zip(starts[long].tolist(), ends[long].tolist())):
        first, last = int(run[0]), int(run[-1])
        if wanted is not None and not wanted[first : last + 1].any():
            continue
        x_first, x_last = low, high = int(place[run].min()), int(place[run].max())
        if x_last - x_first + 1 < least * similarity:
            # Few tokens over and over: the side of x is the stretch that holds most of them.
            x_first, x_last = _densest(np.isin(x, y[run]), least)
        a, b = set(y[first : last + 1].tolist()), set(x[x_first : x_last + 1].tolist())
        shared = len(a & b) / len(a | b)
        if shared >= similarity:
            found.append((first, last, x_first, x_last, shared))
            continue
        # The whole run is too loose; its dense stretches may do.
        held = np.zeros(last - first + 2, np.int64)
        held[run - first + 1] = 1
        total = held.cumsum()
        dense = np.flatnonzero(total[least:] - total[:-least] >= 2 * similarity / (1 + similarity) * least) + first
        passage: list = []
        before = None
        own = place[first : last + 1]
        for lo, x_lo, x_hi, shared in _similarities(y[first : last + 1], x[low : high + 1], np.where(own < 0, -1, own - low), dense - first, least):
            lo, x_lo, x_hi = lo + first, x_lo + low, x_hi + low
            if passage and (lo > passage[1] or lo > before + 1):
                found.append(tuple(passage))
                passage = []
            before = lo
            if shared < similarity:
                continue
            if passage:
                passage = [passage[0], lo + least - 1, min(passage[2], x_lo), max(passage[3], x_hi), min(passage[4], shared)]
            else:
                passage = [lo, lo + least - 1, x_lo, x_hi, shared]
        found += [tuple(passage)] if passage else []
    return found


def _before(tokens: np.ndarray) -> np.ndarray:
    """Where each token stood before; -1 for the first time."""
    order = np.argsort(tokens, kind="stable")
    again = np.flatnonzero(tokens[order[1:]] == tokens[order[:-1]]) + 1
    found = np.full(len(tokens), -1)
    found[order[again]] = order[again - 1]
    return found


def _similarities(y: np.ndarray, x: np.ndarray, place: np.ndarray, starts: np.ndarray, least: int) -> Iterator[tuple[int, int, int, float]]:
    """For each stretch of ``least`` tokens of y its start, the first and last place of its tokens in x, and the similarity to what stands there.

    A token counts where it stands first. One of y is shared if x has it between these places.
    """
    y_before, x_before, order, width = _before(y), _before(x), np.argsort(x, kind="stable"), len(x) + 1
    # Places in order of token and place; those of a token stand from low to high.
    ranked = np.searchsorted(x[order], x[order]) * width + order
    at = np.minimum(np.searchsorted(x[order], y), len(x) - 1)
    token = np.where(x[order][at] == y, at * width, -1)
    windows = lambda values, part: np.lib.stride_tricks.sliding_window_view(values, least)[part]
    for part in np.split(starts, range(SLICE, len(starts), SLICE)) if len(starts) else ():
        own = windows(place, part)
        high, low = own.max(axis=1), np.where(own < 0, len(x), own).min(axis=1)
        first, held = windows(y_before, part) < part[:, None], windows(token, part)
        i, j = np.nonzero(first & (held >= 0))
        k = np.minimum(np.searchsorted(ranked, held[i, j] + low[i]), len(x) - 1)
        inside = (ranked[k] >= held[i, j] + low[i]) & (ranked[k] <= held[i, j] + high[i])
        shared, total = np.bincount(i, inside, len(part)), first.sum(axis=1)
        span = low[:, None] + np.arange((high - low).max() + 1)
        total += ((span <= high[:, None]) & (x_before[np.minimum(span, len(x) - 1)] < low[:, None])).sum(axis=1)
        yield from zip(part.tolist(), low.tolist(), high.tolist(), (shared / (total - shared)).tolist())


def aligned(there: np.ndarray, sizes: np.ndarray, least: int, similarity: float = SIMILARITY, wanted: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """What ``verified`` tells of pairs of texts without repeated tokens, for all at once: number of the pair, then the columns of a passage.

    ``there`` holds the place in x of each token of y, or -1, pair by pair, for as
    many tokens of y as ``sizes`` tells. If some tokens of y are ``wanted``, only runs with one of these are told.
    """
    hits = np.flatnonzero(there >= 0)
    if not len(hits):
        return tuple(np.empty(0, np.int64) for _ in range(6))
    pair = np.repeat(np.arange(len(sizes)), sizes)[hits]
    spot, to = hits - (sizes.cumsum() - sizes)[pair], there[hits]
    starts = np.flatnonzero(np.append(True, (np.diff(pair) > 0) | (np.diff(spot) > GAP + 1) | (np.abs(np.diff(to) - np.diff(spot)) > GAP)))
    stops = np.append(starts[1:], len(hits)) - 1
    n, first, last = stops - starts + 1, spot[starts], spot[stops]
    x_first, x_last = np.minimum.reduceat(to, starts), np.maximum.reduceat(to, starts)
    shared = n / (last - first + x_last - x_first + 2 - n)
    long = last - first + 1 >= least
    if wanted is not None:
        total = np.append(0, wanted.cumsum())
        long &= total[hits[stops] + 1] > total[hits[starts]]
    tight = long & (shared >= similarity)
    whole = [column[tight] for column in (pair[starts], first, last, x_first, x_last, shared)]
    # In a looser run those stretches are passages of which every ``least`` tokens reach the similarity.
    enough = 2 * similarity / (1 + similarity) * least
    loose = np.flatnonzero(long & ~tight & (n >= enough))
    found: list[tuple] = []
    if len(loose):
        size = (last - first)[loose] + 1
        row = np.repeat(np.arange(len(loose)), size)
        step = np.arange(len(row)) - np.repeat(size.cumsum() - size, size)
        to = there[step + hits[starts[loose]][row]].astype(np.int64)
        held = np.append(0, (to >= 0).cumsum())
        held = held[least:] - held[:-least]
        low, high = sliding_minimum(np.where(to < 0, WHOLE, to), least), -sliding_minimum(-to, least)
        dense = np.flatnonzero((step + least <= size[row])[: len(held)] & (held >= enough))
        values = held[dense] / (least + high[dense] - low[dense] + 1 - held[dense])
        # Runs of which no stretch reaches it, or none with a wanted token, are left out.
        at = hits[starts[loose]][row[dense]] + step[dense]
        reaching = (values >= similarity) & (True if wanted is None else total[at + least] > total[at])
        reaching = (np.bincount(row[dense], reaching, len(loose)) > 0)[row[dense]]
        dense, values = dense[reaching], values[reaching]
        passage: list = []
        before = (-1, -1)
        for i, lo, x_lo, x_hi, value in zip(row[dense].tolist(), (step[dense] + first[loose][row[dense]]).tolist(), low[dense].tolist(), high[dense].tolist(), values.tolist()):
            if passage and (i != before[0] or lo > passage[2] or lo > before[1] + 1):
                found.append(tuple(passage))
                passage = []
            before = (i, lo)
            if value < similarity:
                continue
            if passage:
                passage = [passage[0], passage[1], lo + least - 1, min(passage[3], x_lo), max(passage[4], x_hi), min(passage[5], value)]
            else:
                passage = [int(pair[starts[loose[i]]]), lo, lo + least - 1, x_lo, x_hi, value]
        found += [tuple(passage)] if passage else []
    return tuple(np.append(a, np.array(b, a.dtype)) for a, b in zip(whole, zip(*found))) if found else tuple(whole)


def _shares(n: Column) -> Column:
    """The share of a crowded min-hash that a document is dealt to."""
    return F.when(n > CROWD, F.pmod(F.xxhash64("doc"), F.floor(n / CROWD) + 1)).otherwise(0).cast("int")


def _candidates(pairs: DataFrame, least: int) -> DataFrame:
    """``doc, asked``: per later document the sources and the stretches to be compared, of collisions of windows."""
    collisions = pairs.groupBy("y", "x").agg(F.collect_list(F.struct("f", "cy", "ry", "cx", "rx")).alias("rows"))
    collisions = collisions.where((F.size("rows") >= ENOUGH) | F.exists("rows", lambda r: r["f"] >= ALONE))

    def intersect(part: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"y": [], "x": [], "boxes": []}
        counts, rows = part["rows"].value_lengths().to_numpy(), part["rows"].flatten()
        f, *reaches = (rows.field(k).to_numpy() for k in range(5))
        box = _boxes(*reaches, least)
        for y, x, end, n in zip(part["y"], part["x"], counts.cumsum().tolist(), counts.tolist()):
            if n == 1:
                # One that needs no support.
                found = [[int(side[end - 1]) for side in box]]
            else:
                found = [list(b) for b in joined([*zip(*(side[end - n : end].tolist() for side in (*box, f)))], least)]
            if found:
                for column, value in zip(out.values(), (y, x, found)):
                    column.append(value)
        return out

    boxes = per_slice(collisions, intersect, "y long, x long, boxes array<array<int>>", arrow=("rows",))
    return boxes.groupBy("y").agg(F.collect_list(F.struct("x", "boxes")).alias("asked")).withColumnRenamed("y", "doc")


def _compared(by_later: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """Passages in the candidates of ``_candidates``."""
    schema = to_arrow_schema(StructType.fromDDL(_PASSAGES))

    def quote(part: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"x": [], "y": [], "box": [], "own": []}
        words, counts = hashed_words(part["bytes"])
        whole = words.tobytes()
        for doc, asked, end, n in zip(part["doc"], part["asked"], counts.cumsum().tolist(), counts.tolist()):
            for other in asked:
                for box in other["boxes"]:
                    # Hashes of words are half as long as those of the shingles that follow from them.
                    own = whole[4 * (end - n + box[0]) : 4 * (end - n + min(n, box[1] + WIDTH))]
                    for column, value in zip(out.values(), (other["x"], doc, box, own)):
                        column.append(value)
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come in order of their source; of a source with several texts each is kept once.
        known: tuple = (None, {})
        for part in sliced(batches, ("bytes",)):
            own, sizes = shingled_texts(*_joined(part["own"]))
            new = [i for i, key in enumerate(zip(part["doc"], part["part"])) if (i == 0 or key != (part["doc"][i - 1], part["part"][i - 1])) and not (known[0] == key[0] and key[1] in known[1])]
            words, counts = hashed_words([part["bytes"][i].as_py() for i in new])
            told = dict(zip(new, np.split(words, counts.cumsum()[:-1])))
            sources = []
            for i, (doc, number, box) in enumerate(zip(part["doc"], part["part"], part["box"])):
                if known[0] != doc:
                    known = (doc, {})
                if number not in known[1]:
                    known[1][number] = shingled(told[i] if i in told else word_hashes(part["bytes"][i].as_py()))
                sources.append(known[1][number][max(0, box[2]) : box[3] + 1])
            out = []
            for i, first, last, x_first, x_last, shared in _verified_rows(own, sizes, sources, least):
                box = part["box"][i]
                out.append((part["y"][i], box[0] + first, last - first + WIDTH, part["doc"][i], max(0, box[2]) + x_first, x_last - x_first + WIDTH, shared))
            yield _batch(out, schema)

    # A source that very many documents quote is one row of the looked-up side, and adaptive execution can split its quotes.
    asking = many_to_one(by_later, texts, ["doc"], "inner")
    quoted = per_slice(asking.select("id", "doc", "part", "bytes", "asked"), quote, "x long, y long, box array<int>, own binary")
    against = many_to_one(quoted.withColumnRenamed("x", "doc"), texts, ["doc"], "inner").select("id", "doc", "part", "bytes", "y", "box", "own")
    return small_batches(against).mapInArrow(compare, _PASSAGES)


def _unlinked(found: DataFrame, both: DataFrame) -> DataFrame:
    """``doc, held``: per document its rows of ``both`` under the keys that a stretch with uncovered tokens has, with the passages in it and the shares of the key.

    Groups of more than ``FEW`` windows were compared with few partners before. A
    pair of windows whose whole stretch lies in passages has its link; every other
    one is open, and meets all smaller documents with the same two min-hashes.
    """
    stop = F.col("start_word") + F.col("n_words") - WIDTH
    by_place = Window.partitionBy("y").orderBy("start_word")
    spans = found.select("y", "start_word", stop.alias("stop")).distinct()
    spans = spans.withColumn("until", F.max("stop").over(by_place.rowsBetween(Window.unboundedPreceding, -1)))
    # Passages between whose words none is left are one.
    apart = F.when(F.col("start_word") <= F.col("until") + WIDTH, 0).otherwise(1)
    spans = spans.withColumn("run", F.sum(apart).over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("y", "run").agg(F.min("start_word").alias("first"), F.max("stop").alias("last"))
    covered_ones = spans.groupBy(F.col("y").alias("doc")).agg(F.collect_list(F.struct("first", "last")).alias("covered"))
    inside = F.exists("covered", lambda s: (s["first"] <= F.col("first")) & (F.col("last") <= s["last"]))
    near = F.filter("covered", lambda s: (s["first"] <= F.col("last")) & (F.col("first") <= s["last"]))
    told = many_to_one(both.select("doc", "key", "first", "last").distinct(), covered_ones, ["doc"])
    told = told.withColumns({"open": F.col("covered").isNull() | ~inside, "covered": F.when(~inside, near)})
    by_key = Window.partitionBy("key")
    told = told.withColumns({"least": F.min("doc").over(by_key), "most": F.max(F.when(F.col("open"), F.col("doc"))).over(by_key), "n": F.count_if("open").over(by_key)})
    told = told.withColumns({"open": F.col("open") & (F.col("doc") > F.col("least")), "shares": F.floor(F.col("n") / BLOCK).cast("int") + 1})
    asked = told.where("open OR doc < most")
    return asked.groupBy("doc").agg(F.collect_list(F.struct("key", "first", "last", "open", "shares", "covered")).alias("held"))


_STRETCH = "key long, salt int, closed boolean, doc long, words binary, free binary"


def _stretches(part: dict[str, list]) -> dict[str, list]:
    """Hashes of the words of the stretches of ``_unlinked``, and which tokens no passage covers. A stretch goes to all shares of its key; it is open in one."""
    out: dict[str, list] = {c.split()[0]: [] for c in _STRETCH.split(", ")}
    words, counts = hashed_words(part["bytes"])
    whole, starts, sizes = words.tobytes(), (counts.cumsum() - counts).tolist(), counts.tolist()
    numbers, rows = np.repeat(np.arange(len(counts)), part["held"].value_lengths().to_numpy()).tolist(), part["held"].flatten()
    columns = [rows.field(name).to_pylist() for name in ("key", "first", "last", "open", "shares")]
    spans = rows.field("covered")
    for i, key, first, last, is_open, shares, at in zip(numbers, *columns, range(len(rows))):
        doc = part["doc"][i]
        own, free = whole[4 * (starts[i] + first) : 4 * (starts[i] + min(sizes[i], last + WIDTH))], b""
        if is_open:
            free = bytearray(b"\1") * (last - first + 1)
            for s in spans[at].as_py() or ():
                a, b = max(0, s["first"] - first), min(last, s["last"]) - first + 1
                free[a:b] = bytes(max(0, b - a))
        for salt in range(shares):
            closed = not is_open or zlib.crc32(b"%d" % doc) % shares != salt
            for column, value in zip(out.values(), (key, salt, closed, doc, own, None if closed else bytes(free))):
                column.append(value)
    return out


def _joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words of some rows in a row, and how many each has."""
    return np.frombuffer(b"".join(words), np.uint32), np.fromiter(map(len, words), np.int64, len(words)) // 4


class _Open:
    """Open stretches of some keys (``group``, ascending), and which of their tokens no passage covers (the free ones).

    A stretch that meets another one is linked if both have a free token and a passage
    of both holds a free one; all tokens of the passage are covered then. So it has
    at most as many links here as free tokens, and is closed when none is left.
    """

    def __init__(self, group: np.ndarray, doc: np.ndarray, words: list[bytes], free: list[bytes], least: int):
        tokens, sizes = shingled_texts(*_joined(words))
        long, self.least = sizes >= least, least
        self.group, self.doc, self.sizes, self.tokens = group[long], doc[long], sizes[long], tokens[np.repeat(long, sizes)]
        self.free = np.frombuffer(b"".join(f[:n] for f, n in zip(free, sizes.tolist()) if n >= least), bool).copy()

    def meet(self, group: np.ndarray, doc: np.ndarray, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """Links with these stretches of smaller documents, which come in order of their key: both documents."""
        tokens, sizes = shingled_texts(*_joined(words))
        if not len(tokens) or not self.free.any():
            return
        asks, source = self.sifted(group, doc, tokens, sizes)
        if not asks.any():
            return
        # What is left: the asking stretches, and those they may be linked to.
        ends = self.sizes.cumsum()
        own = {"group": self.group[asks], "doc": self.doc[asks], "size": self.sizes[asks], "start": (ends - self.sizes)[asks]}
        left = np.repeat(asks, self.sizes)
        own["repeats"] = _repeating(self.tokens[left], own["size"])
        other = {"group": group[source], "doc": doc[source], "size": sizes[source]}
        tokens = tokens[np.repeat(source, sizes)]
        other["repeats"] = _repeating(tokens, other["size"])
        # Tokens of the asking ones are numbered within their key, and each other stretch has a row of as many places.
        keyed = lambda rows, t: np.repeat(rows["group"].astype(np.uint64) << np.uint64(44), rows["size"]) | (t >> np.uint64(20))
        values, number = np.unique(keyed(own, self.tokens[left]), return_inverse=True)
        first = lambda rows: np.searchsorted(values, rows["group"].astype(np.uint64) << np.uint64(44))
        numbers = np.zeros(len(self.tokens), np.int32)
        numbers[left] = number - np.repeat(first(own), own["size"])
        keys = keyed(other, tokens)
        at = np.minimum(np.searchsorted(values, keys), len(values) - 1)
        known = values[at] == keys
        row = np.repeat(np.arange(len(other["size"])), other["size"])
        place = (np.arange(len(tokens)) - np.repeat(other["size"].cumsum() - other["size"], other["size"]))[known]
        cell, row = (at - first(other)[row])[known], row[known]
        # Of stretches that have the same of these tokens at the same distances, only one with a smaller document than all before it tells more.
        begin = np.full(len(other["size"]), len(tokens))
        np.minimum.at(begin, row, place)
        print_of = (cell.astype(np.uint64) * _MULTIPLY[0] + (place - begin[row]).astype(np.uint64)) * _MULTIPLY[1]
        print_of = (print_of ^ (print_of >> np.uint64(31))) * _MIX
        total = np.append(np.uint64(0), print_of.cumsum(dtype=np.uint64))
        ends = np.searchsorted(row, np.arange(len(other["size"]) + 1))
        looks: dict[tuple[int, int], int] = {}
        news = np.ones(len(other["size"]), bool)
        for i, look in enumerate(zip(other["group"].tolist(), (total[ends[1:]] - total[ends[:-1]]).tolist())):
            if not other["repeats"][i]:
                news[i] = other["doc"][i] < looks.get(look, WHOLE << 33)
                if news[i]:
                    looks[look] = other["doc"][i]
        low, high = np.searchsorted(own["group"], other["group"], "left"), np.searchsorted(own["group"], other["group"], "right")
        other["start"], width = other["size"].cumsum() - other["size"], np.searchsorted(values, (other["group"] + 1).astype(np.uint64) << np.uint64(44)) - first(other)
        # Some rows of places at a time, and some pairs at a time.
        turns = (width.cumsum() + (high - low).cumsum() * self.least) // CELLS
        for some in np.split(np.arange(len(turns)), np.flatnonzero(np.diff(turns)) + 1):
            base = width[some].cumsum() - width[some]
            places = np.full(int(width[some].sum()), -1, np.int32)
            inside = slice(*np.searchsorted(row, [some[0], some[-1] + 1]))
            places[base[row[inside] - some[0]] + cell[inside]] = place[inside]
            # Too few different tokens for a passage, however often they are repeated.
            different = np.append(0, (places >= 0).cumsum())[np.append(base, len(places))]
            count = np.where((np.diff(different) >= self.least * SIMILARITY - 1) & news[some], (high - low)[some], 0)
            y = np.arange(count.sum()) - np.repeat(count.cumsum() - count, count) + np.repeat(low[some], count)
            x = np.repeat(some, count)
            kept = own["doc"][y] > other["doc"][x]
            y, x = y[kept], x[kept]
            for turn in range(0, len(y), PAIRS):
                pairs = slice(turn, turn + PAIRS)
                yield from self.compared(y[pairs], x[pairs], own, other, numbers, places, base - base[0], some[0], tokens)

    def sifted(self, group: np.ndarray, doc: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which open stretches may have a link, and which of the others one may lead to.

        A passage of an open stretch holds tokens of a smaller document, to the similarity
        of what lies between the first and the last; and a stretch that is linked to
        holds so many of a larger one. Whether one document has all these is not told here.
        """
        ids = np.unique(np.append(self.doc, doc), return_inverse=True)[1].astype(np.int32) + 1
        own_row, row = np.repeat(np.arange(len(self.sizes)), self.sizes), np.repeat(np.arange(len(sizes)), sizes)
        at, n = _buckets(np.append(self.tokens, tokens), np.append(self.group[own_row], group[row]))
        own_at, at = at[: len(own_row)], at[len(own_row) :]
        own_id, ids = ids[: len(self.doc)][own_row], ids[len(self.doc) :][row]
        # Of several values written to one place the last one stays.
        order, own_order = np.argsort(-ids, kind="stable"), np.argsort(own_id, kind="stable")
        own_repeats, repeats = _repeating(self.tokens, self.sizes), _repeating(tokens, sizes)
        needed, source = self.least * SIMILARITY - 1, np.ones(len(sizes), bool)
        for _ in range(2):
            table = np.full(n, np.iinfo(np.int32).max, np.int32)
            some = order[source[row[order]]]
            table[at[some]] = ids[some]
            shared = table[own_at] < own_id
            asks = np.bincount(own_row, shared, len(self.sizes)) >= needed
            near = np.zeros(len(own_row), bool)
            near[asks[own_row]] = _between(shared[asks[own_row]], self.sizes[asks], _span(self.least))
            self.near = shared & (near | own_repeats[own_row])
            asks &= np.bincount(own_row, self.free & self.near, len(self.sizes)) > 0
            table = np.zeros(n, np.int32)
            some = own_order[asks[own_row[own_order]]]
            table[own_at[some]] = own_id[some]
            shared = table[at] > ids
            source &= np.bincount(row, shared, len(sizes)) >= needed
            near = _between(shared[source[row]], sizes[source], _span(self.least, looser=True))
            source[source] = (np.bincount(np.repeat(np.arange(source.sum()), sizes[source]), near, source.sum()) > 0) | repeats[source]
        return asks, source

    def compared(self, y: np.ndarray, x: np.ndarray, own: dict, other: dict, numbers: np.ndarray, places: np.ndarray, base: np.ndarray, origin: int, tokens: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links among pairs of an asking stretch and another one: as ``verified`` tells, but for all pairs without repeated tokens at once."""
        open_now = np.add.reduceat(np.append(self.free, False), own["start"]) if len(own["start"]) else np.empty(0)
        kept = open_now[y] > 0
        y, x = y[kept], x[kept]
        for part in (False, True):
            # First the number of shared tokens, then the places for the pairs that have enough.
            size = own["size"][y]
            ends = size.cumsum()
            place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
            mine = place + np.repeat(own["start"][y], size)
            there = places[numbers[mine] + np.repeat(base[x - origin], size)]
            if not part:
                pair = np.repeat(np.arange(len(y)), size)
                held = there >= 0
                held_asking = held & self.free[mine] & self.near[mine]
                kept = (np.bincount(pair, held, len(y)) >= self.least * SIMILARITY - 1) & (np.bincount(pair, held_asking, len(y)) > 0)
                # If only the other one repeats tokens, those of a passage still stand close in this one.
                odd = kept & other["repeats"][x] & ~own["repeats"][y]
                of_odd = odd[pair]
                held_asking[of_odd] &= _between(held[of_odd], size[odd], _span(self.least))
                kept &= ~odd | (np.bincount(pair, held_asking, len(y)) > 0)
                y, x = y[kept], x[kept]
        if not len(y):
            return
        plain = ~(own["repeats"][y] | other["repeats"][x])
        found = aligned(np.where(np.repeat(plain, size), there, -1), size, self.least, wanted=self.free[mine])
        free, begins = np.append(0, self.free[mine].cumsum()), (ends - size)[found[0]]
        some = np.flatnonzero(free[begins + found[2] + 1] > free[begins + found[1]])
        covers: dict[int, list[tuple[int, int]]] = {}
        for i, first, last in zip(*(column[some].tolist() for column in found[:3])):
            covers.setdefault(i, []).append((first, last))
        for i in sorted({*covers, *np.flatnonzero(~plain).tolist()}):
            a, b = own["start"][y[i]], own["start"][y[i]] + own["size"][y[i]]
            free, held = self.free[a:b], there[ends[i] - len(self.free[a:b]) : ends[i]] >= 0
            if not (free & held & self.near[a:b]).any():
                continue
            if not plain[i]:
                start = other["start"][x[i]]
                covers[i] = [(p[0], p[1]) for p in verified(self.tokens[a:b], tokens[start : start + other["size"][x[i]]], self.least)]
            if any(free[p : q + 1].any() for p, q in covers[i]):
                for p, q in covers[i]:
                    free[p : q + 1] = False
                yield int(own["doc"][y[i]]), int(other["doc"][x[i]])


_LINKS = pa.schema([("y", pa.int64()), ("x", pa.int64())])


def _meet(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Links among the stretches of a key. Rows come sorted by key and share, open ones first; the others pass by, of equal ones the first.

    Many keys meet in one go. Of a key that has more rows than that the open ones stay, and the others pass by some at a time.
    """
    held: list[pa.RecordBatch] = []
    staying: tuple = (None, None)
    for batch in chain(batches, [None]):
        held += [] if batch is None else [batch]
        if not sum(b.num_rows for b in held) or batch is not None and sum(b.column("words").nbytes for b in held) < TOGETHER_BYTES:
            continue
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held = [rows]
        key, salt, closed, doc = (rows.column(name).to_numpy(zero_copy_only=False) for name in ("key", "salt", "closed", "doc"))
        group = np.append(0, ((key[1:] != key[:-1]) | (salt[1:] != salt[:-1])).cumsum())
        end = len(key) if batch is None or group[-1] == 0 else int(np.searchsorted(group, group[-1]))
        if batch is not None and end == len(key) and not closed[-1]:
            continue  # more of these open ones may follow
        words, last = rows.column("words").slice(0, end).to_pylist(), (key[end - 1], salt[end - 1])
        opened = np.flatnonzero(~closed[:end])
        others = np.array([i for i in np.flatnonzero(closed[:end]).tolist() if not (i and closed[i - 1] and group[i] == group[i - 1] and words[i] == words[i - 1])], np.int64)
        out: list[tuple] = []
        if staying[0] == (key[0], salt[0]):
            own = others[group[others] == 0]
            out += staying[1].meet(group[own], doc[own], [words[i] for i in own.tolist()])
            others = others[group[others] > 0]
        if len(opened):
            opened = opened[np.lexsort((doc[opened], group[opened]))]
            current = _Open(group[opened], doc[opened], [words[i] for i in opened.tolist()], rows.column("free").take(pa.array(opened)).to_pylist(), least)
            others = np.append(opened, others)
            others = others[np.argsort(group[others], kind="stable")]
            out += current.meet(group[others], doc[others], [words[i] for i in others.tolist()])
            if end == len(key) and group[-1] == 0:
                staying = (last, current)
        if staying[0] != last:
            staying = (None, None)
        held = [rows.slice(end)]
        yield _batch(out, _LINKS)


def _met(rest: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """``doc, asked`` as in ``_candidates``, for the stretches of ``_unlinked``. Linked documents are compared as a whole."""
    asking = many_to_one(rest, texts, ["doc"], "inner").select("doc", "bytes", "held")
    ordered = per_slice(asking, _stretches, _STRETCH, arrow=("held",)).repartition("key", "salt").sortWithinPartitions("key", "salt", "closed", "words", "doc")
    links = ordered.mapInArrow(lambda b: _meet(b, least), "y long, x long").distinct()
    whole = F.array(F.array(F.lit(0), F.lit(WHOLE), F.lit(0), F.lit(WHOLE)))
    return links.groupBy(F.col("y").alias("doc")).agg(F.collect_list(F.struct("x", whole.alias("boxes"))).alias("asked"))


def near_passages(docs: DataFrame, least: int = LEAST, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, start_word, n_words, source_id, source_start, source_words, similarity``: passages that repeat one of a smaller id.

    A passage is 50 words or more whose sets of five-word shingles have a
    similarity of 0.8 or more. A text that equals one with a smaller id is one
    passage of that id. Up to ``FEW`` windows with one min-hash are compared in all
    pairs. A larger group is first searched in linearly many pairs: its classes are
    the whole and the windows alike in another min-hash before, or after, the place.
    Each window is compared with the smallest document of each of its classes and
    with the one before it there, and one collision is enough. A crowded group is
    dealt out by document; the smallest documents of the shares are compared in that
    way again. Stretches that passages do not cover as a whole then meet all smaller
    documents that collide with them under two functions, and a document that has a
    passage with uncovered tokens of one is compared as a whole. So a link of a place
    stands for others there, also if their texts differ; not all pairs are listed.
    Texts of fewer than 50 words, empty and null texts have no passage. Equal
    rows count as one document; different texts with one id are searched as one
    document each, passages being those of either. Rows without an id come
    last, and have no passage among themselves. Other columns are ignored.
    """
    texts = _prepared(docs, id_column, text)
    # Rows without an id are neither a source nor searched, so they have no windows here.
    named = texts.where(F.col("doc") != _NO_ID)
    # Only min-hash and document travel to tell which windows are repeated; the rest of these few is told where their text is.
    path = new_path(docs.sparkSession, "hashes")
    hashes = stored(_window_rows(named, least), path=path)
    counted = hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = stored(counted.select("h", F.least("n", F.lit(2**31 - 1)).cast("int").alias("n")), "windows")
    copies = stored(_copies(_hashed(texts)), "copies")
    holders = hashes.join(repeated, "h").join(copies.select("doc"), "doc", "left_anti")
    wanted = stored(holders.groupBy("doc").agg(F.collect_set(F.struct("h", "n")).alias("wanted")), "wanted")
    remove(docs.sparkSession, path)
    # Texts are the looked-up side of this join and of the two below, with the same columns, so that one exchange serves all three.
    holding = many_to_one(wanted, texts, ["doc"], "inner").select("id", "doc", "part", "bytes", "wanted")
    windows = _wanted_windows(holding, least)
    # Number and place travel as one, and the share is told again where the rows arrive.
    packed = windows.repartition("h", _shares(F.shiftright("spot", 32)))
    whole = packed.select("h", "sides", "doc", F.shiftright("spot", 32).cast("int").alias("n"), F.col("spot").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("c"), "reach")
    sort = lambda rows: rows.withColumn("salt", _shares(F.col("n"))).sortWithinPartitions("h", "salt", "doc", "c")
    ordered = sort(whole)
    schema = pa.schema([("h", pa.int64()), ("n", pa.int32()), ("near", pa.int64()), ("doc", pa.int64()), ("c", pa.int32()), ("reach", pa.int64())])
    leaders = sort(whole.mapInArrow(_crowded, whole.schema)).mapInArrow(lambda b: _leaders(b, schema), "h long, n int, near long, doc long, c int, reach long")
    alike = leaders.repartition("h", "near").sortWithinPartitions("h", "near", "doc", "c")
    tops = alike.mapInArrow(lambda b: _collide(b, ("h", "near")), _PAIRS_DDL)
    pairs = ordered.mapInArrow(_collide, _PAIRS_DDL).union(tops)
    # Windows of two functions that intersect come out of the same exchange.
    passages = to_arrow_schema(StructType.fromDDL(_PASSAGES))
    both = ordered.mapInArrow(lambda b: _shared_both(b, passages), _PASSAGES)
    linked = stored(_compared(_candidates(pairs, least), texts, least).distinct().union(both), "passages")
    found = linked.where(F.col("similarity").isNotNull())
    named_places = dict(y="doc", x="key", start_word="first", n_words="last", source_start="c", source_words="other")
    rest = stored(_unlinked(found, linked.where(F.col("similarity").isNull()).drop("similarity").withColumnsRenamed(named_places)), "unlinked")
    # Few documents have such windows, so few texts travel again.
    met = stored(_met(rest, texts.join(rest.select("doc"), "doc", "left_semi"), least), "met")
    left = met.select("doc").union(met.select(F.explode("asked.x"))).distinct()
    found = found.union(_compared(met, texts.join(left, "doc", "left_semi"), least))
    zero, whole = F.lit(0), F.col("words").cast("int")
    same = copies.where(F.col("words") >= least + WIDTH - 1).select("doc", zero, whole, "first", zero, whole, F.lit(1.0))
    result_rows = found.union(same).where(F.col("y") != _NO_ID).distinct()
    return result_rows.select(F.col("y").alias(id_column), "start_word", "n_words", F.col("x").alias("source_id"), "source_start", "source_words", "similarity")


def cut_words(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans (first word, number); everything else keeps its bytes."""
    if text is None or not spans:
        return text
    data = text.encode()
    at = [m.span() for m in _WORD.finditer(data)]
    cuts = covered(len(data), [(at[first][0], at[min(first + n, len(at)) - 1][1]) for first, n in spans if first < len(at)])
    ends = [0, *(x for run in cuts for x in run), len(data)]
    return b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2])).decode()


def without_passages(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """The documents with every passage cut that repeats one of a smaller id, all columns kept.

    A document of which no word is left is dropped; documents without such a
    passage stay as they are. A column ``length`` is set to the new length.
    """
    found = near_passages(docs, id_column=id_column, text=text)
    spans = found.groupBy(F.col(id_column).alias("key")).agg(F.collect_list(F.struct("start_word", "n_words")).alias("spans"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut_words(t, [] if s is None else [(r["start_word"], r["n_words"]) for r in s]) for t, s in zip(texts, spans)], dtype=object)

    # A row travels as one column, so that no name of its columns can clash.
    rows = docs.select(F.col(id_column).alias("key"), F.struct(*docs.columns).alias("row"))
    joined = small_batches(rows.join(spans, "key", "left")).withColumn("cut", cut(F.col("row")[text], F.col("spans")))
    kept = joined.where(F.col("spans").isNull() | F.col("cut").rlike(r"[^\x20\x09-\x0D]"))
    changed = {text: F.col("cut")}
    if length in docs.columns:
        own = docs.schema[length].dataType
        changed[length] = F.when(F.col("spans").isNull(), F.col("row")[length]).otherwise(F.length("cut").cast(own))
    return kept.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
