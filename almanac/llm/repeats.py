"""Repeated stretches of bytes, found with common-prefix interval trees over anchored suffixes.

Every window of the least length has an anchor that depends on its bytes alone, so
equal windows have equal anchors. Only suffixes that start at an anchor are
sorted, and only those whose anchor occurs more than once in the documents. What
stands after the anchor orders the suffixes of one anchor; a stack scan of the
common prefixes of neighbours gives the tree of prefix intervals. Inside an
interval the bytes before the anchor are compared the same way, from the anchor
backwards: where they differ the interval is left-diverse, and each set of
occurrences that extends equally far to both sides is a maximal repeat group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.anchors import K, anchors
from almanac.llm.rows import SLICE, per_slice, word_count
from almanac.operators.joins import many_to_one
from almanac.session import stored

LEAST = 100
# Suffixes of one anchor that one group holds, about; more of them are dealt out and compared window by window.
CROWD = 256
_NO_ID = (1 << 63) - 1
_ANY = -1


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by bisection."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle
    return low


def intervals(keys: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """Prefix intervals of sorted keys by a stack scan: common length, first, last (of two keys or more)."""
    stack = [(0, 0)]
    for i in range(1, len(keys) + 1):
        common = common_prefix(keys[i - 1], keys[i]) if i < len(keys) else -1
        first = i - 1
        while stack and stack[-1][0] > common:
            length, first = stack.pop()
            if i - 1 > first:
                yield length, first, i - 1
        if common >= 0 and (not stack or stack[-1][0] < common):
            stack.append((common, first))


def groups(snippets: list[tuple[bytes, bytes]], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats among (reversed left, right) contexts of one anchor: extent left, extent right, members.

    The extents do not count the anchor's own bytes; with them the repeat has the
    least length or more.
    """
    need = least - K
    order = sorted(range(len(snippets)), key=lambda i: snippets[i][1])
    rights = [snippets[i][1] for i in order]
    for right, first, last in intervals(rights):
        inside = sorted(order[first : last + 1], key=lambda i: snippets[i][0])
        lefts = [snippets[i][0] for i in inside]
        if not any(len(x) + right >= need for x in lefts):
            continue
        for left, a, b in intervals(lefts):
            if left + right < need:
                continue
            members = inside[a : b + 1]
            # A set that agrees further to the right belongs to an inner interval.
            if common_prefix(min(snippets[i][1] for i in members), max(snippets[i][1] for i in members)) == right:
                yield left, right, members


def _prepared(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """``id, doc, part, bytes``: rows without an id come last; ``part`` tells texts with one id apart."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    part = F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    return rows.select("id", F.coalesce("id", F.lit(_NO_ID)).alias("doc"), part.alias("part"), F.col("text").cast("binary").alias("bytes"))


def _anchor_rows(texts: DataFrame, least: int) -> DataFrame:
    """``h, doc, i``: the i-th anchor of a document."""

    def compute(part: dict[str, list]) -> dict[str, list]:
        found = [anchors(t, least)[0] for t in part["bytes"]]
        sizes = [len(x) for x in found]
        empty = [np.empty(0, np.int64)]
        return {"h": np.concatenate(found or empty), "doc": np.repeat(np.array(part["doc"], np.int64), sizes), "i": np.concatenate([np.arange(n) for n in sizes] or empty)}

    return per_slice(texts.select("doc", "bytes"), compute, "h long, doc long, i int")


def _hashed(texts: DataFrame) -> DataFrame:
    """``doc, sha, words`` of every text, stored."""

    def compute(part: dict[str, list]) -> dict[str, list]:
        return {"doc": part["doc"], "sha": [hashlib.sha256(t).digest() for t in part["bytes"]], "words": [word_count(t) for t in part["bytes"]]}

    return stored(per_slice(texts.select("doc", "bytes"), compute, "doc long, sha binary, words long"), "texts")


def _copies(hashed: DataFrame) -> DataFrame:
    """Ids all of whose rows are copies of a text with a smaller id, that id, and the words of the text."""
    first = hashed.groupBy("sha").agg(F.min("doc").alias("first"))
    named = many_to_one(hashed, first, ["sha"], "inner").groupBy("doc").agg(F.min("first").alias("first"), F.max("first").alias("last"), F.max("words").alias("words"))
    return named.where("last < doc").select("doc", "first", "words")


def _snippet_rows(joined: DataFrame, least: int) -> DataFrame:
    """The repeated anchors of each document with the bytes of their windows on both sides."""

    def compute(part: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
        for doc, own, data, repeated in zip(part["doc"], part["part"], part["bytes"], part["repeated"]):
            h, place, first, last = (x.tolist() for x in anchors(data, least))
            for i, n in {r["i"]: r["n"] for r in repeated}.items():
                if i >= len(h):
                    continue  # of another text with this id
                key, p = h[i], place[i]
                left, right = data[first[i] : p][::-1], data[p + K : last[i] + least]
                # Shares are dealt by document: copies of one snippet need not meet, their windows do.
                salt = xxhash.xxh32_intdigest(doc.to_bytes(8, "little", signed=True)) % (1 + n // CROWD) if n > CROWD else 0
                for column, value in zip(out.values(), (key, salt, n > CROWD, doc, own, p, left, right)):
                    column.append(value)
        return out

    schema = "h long, salt int, crowded boolean, doc long, part int, place long, left binary, right binary"
    return per_slice(joined, compute, schema)


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[dict]]:
    """Rows with equal keys, of sorted batches; a group may run over several."""
    rows, current = [], None
    for batch in batches:
        for start in range(0, batch.num_rows, 16 * SLICE):
            for row in batch.slice(start, 16 * SLICE).to_pylist():
                key = tuple(row[k] for k in keys)
                if key != current and rows:
                    yield rows
                    rows = []
                current = key
                rows.append(row)
    if rows:
        yield rows


_SPANS = pa.schema([("key", pa.binary()), ("doc", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def _search(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """One span for each occurrence that repeats an earlier one. All spans of an occurrence hold its anchor, so they join to one.

    Of crowded anchors also the first of each window of this share of them, under
    a key of 16 bytes; spans have a key of 8 bytes, their document.
    """
    out: list[tuple] = []
    for rows in _grouped(batches, ("h", "salt")):
        seen: dict[tuple[bytes, bytes], list[tuple]] = {}
        for r in rows:
            seen.setdefault((r["left"], r["right"]), []).append((r["doc"], r["part"], r["place"]))
        snippets = list(seen)
        extent: dict[tuple, tuple[int, int]] = {}

        def later(own: list[tuple], left: int, right: int) -> None:
            earliest = min(own)
            for occurrence in own:
                if occurrence != earliest:
                    known = extent.get(occurrence, (0, 0))
                    extent[occurrence] = (max(left, known[0]), max(right, known[1]))

        for left, right in snippets:
            if len(seen[left, right]) > 1:
                later(seen[left, right], len(left), len(right))
        if rows[0]["crowded"]:
            windows: set[bytes] = set()
            name = rows[0]["h"].to_bytes(8, "little", signed=True)
            for left, right in sorted(snippets, key=lambda s: min(seen[s])):
                first = min(seen[left, right])
                for offset in range(least - K - len(right), len(left) + 1):
                    digest = xxhash.xxh3_128_digest(name + bytes([offset]) + left[:offset] + right[: least - K - offset])
                    if digest in windows:
                        known = extent.get(first, (0, 0))
                        extent[first] = (max(offset, known[0]), max(least - K - offset, known[1]))
                    else:
                        windows.add(digest)
                        out.append((digest, first[0], first[1], first[2] - offset, first[2] - offset + least))
        elif len(snippets) > 1:
            for left, right, members in groups(snippets, least):
                later([o for i in members for o in seen[snippets[i]]], left, right)
        for (doc, part, place), (left, right) in extent.items():
            out.append((doc.to_bytes(8, "little", signed=True), doc, part, place - left, place + K + right))
        if len(out) > 20_000:
            yield _batch(out, _SPANS)
            out = []
    yield _batch(out, _SPANS)


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of a document joined where they touch; of the windows under one key all but the earliest. Rows come sorted, so none are kept."""
    schema = pa.schema(list(_SPANS)[1:])
    earliest: tuple = (None,)
    span: list = []
    for batch in batches:
        out = []
        for key, doc, part, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
            if len(key) == 16:
                if key != earliest[0]:
                    earliest = (key, doc, part, start)
                elif (key, doc, part, start) != earliest:
                    out.append((doc, part, start, stop))
            elif span and span[0] == doc and span[1] == part and start <= span[3]:
                span[3] = max(span[3], stop)
            else:
                if span:
                    out.append(tuple(span))
                span = [doc, part, start, stop]
        yield _batch(out, schema)
    yield _batch([tuple(span)] if span else [], schema)


def covered(size: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the spans cover."""
    runs: list[list[int]] = []
    for start, stop in sorted(spans):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], stop)
        else:
            runs.append([start, stop])
    return [(a, min(b, size)) for a, b in runs]


def without_repeats(docs: DataFrame, least: int = LEAST, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes).

    Each byte that lies in a stretch of ``least`` bytes that also starts earlier (in
    a smaller id, or in the same document) is removed. Null and empty texts have
    no bytes. Equal rows count as one document; different texts with one id
    are ordered by a hash of the text; rows without an id come last. Anchors are
    compared by 64-bit hashes of their 32 bytes, what stands around them byte by
    byte. Other columns are ignored.
    """
    texts = _prepared(docs, id_column, text)
    repeated = _anchor_rows(texts, least).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = stored(repeated.select("h", F.least("n", F.lit(2**31 - 1)).cast("int").alias("n")), "anchors")
    copies = stored(_copies(_hashed(texts)).select("doc"), "copies")
    own = _anchor_rows(texts, least).join(repeated, "h").join(copies, "doc", "left_anti")
    per_document = own.groupBy("doc").agg(F.collect_list(F.struct("i", "n")).alias("repeated"))
    # Both joins read the same columns of the texts, so that one exchange serves both.
    dealt = texts.repartition("doc")
    joined = dealt.join(per_document, "doc").select("id", "doc", "part", "bytes", "repeated")
    dealt_out = _snippet_rows(joined, least).repartition("h", "salt").sortWithinPartitions("h", "salt", "doc", "part", "place")
    found = dealt_out.mapInArrow(lambda b: _search(b, least), "key binary, doc long, part int, start long, stop long")
    spans = found.repartition("key").sortWithinPartitions("key", "doc", "part", "start").mapInArrow(_resolve, "doc long, part int, start long, stop long")
    whole = copies.select("doc", F.lit(_ANY).alias("part"), F.lit(0).cast("long").alias("start"), F.lit(_NO_ID).alias("stop"))
    gathered = spans.union(whole).groupBy("doc").agg(F.collect_list(F.struct("part", "start", "stop")).alias("spans"))

    def cut(part: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"id": part["id"], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for own, data, spans in zip(part["part"], part["bytes"], part["spans"]):
            mine = [(s["start"], s["stop"]) for s in spans or () if s["part"] == own or s["part"] == _ANY and len(data) >= least]
            runs = covered(len(data), mine)
            ends = [0, *(x for run in runs for x in run), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2]))
            for column, value in zip(list(out.values())[1:], (len(data), len(data) - len(kept), len(runs), kept)):
                column.append(value)
        return out

    final = dealt.join(gathered, "doc", "left").select("id", "doc", "part", "bytes", "spans")
    return per_slice(final, cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", id_column)

