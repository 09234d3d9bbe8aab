"""Vectors as short codes: every part is replaced by the number of its nearest codebook entry.

Distances are compared after an integer Walsh-Hadamard transform. For parts of d
numbers, padded with zeros to a power of two D, the transform H keeps distances up
to a factor: |Hx - He|^2 = D |x - e|^2. Its rows are taken in sequency order (by
the number of sign changes), so that the first differences hold most of the
distance of smooth parts. Squares are added row by row; an entry whose sum
exceeds the whole distance of some entry is out. Everything is integer: no
rounding, and ties go to the lower number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.rows import small_batches
from almanac.llm.vectors import finite, largest, matrix
from almanac.operators.joins import many_to_one
from almanac.session import stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
# Vectors compared at a time; with 64 entries the table of sums stays in a core's cache.
ROWS = 1024
_WORD = 32


def sequency_order(size: int) -> np.ndarray:
    """Rows of the Hadamard matrix of a power of two, fewest sign changes first."""
    signs = np.ones((1, 1), dtype=np.int8)
    while len(signs) < size:
        signs = np.block([[signs, signs], [signs, -signs]])
    return np.argsort((np.diff(signs, axis=1) != 0).sum(1), kind="stable")


def walsh(numbers: np.ndarray) -> np.ndarray:
    """Transform of the last axis, padded to a power of two, in sequency order."""
    width = numbers.shape[-1]
    size = 1 << max(0, width - 1).bit_length()
    out = np.zeros((*numbers.shape[:-1], size), dtype=numbers.dtype)
    out[..., :width] = numbers
    half = 1
    while half < size:
        pairs = out.reshape(*numbers.shape[:-1], size // (2 * half), 2, half)
        a, b = pairs[..., 0, :], pairs[..., 1, :]
        out = np.stack([a + b, a - b], axis=-2).reshape(out.shape)
        half *= 2
    return out[..., sequency_order(size)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For transformed parts: number of the nearest transformed entry, and the scaled squared distance."""
    everyone = np.arange(len(parts))
    sums = (parts[:, :1] - entries[:, 0]) ** 2
    guess = sums.argmin(1)
    bound = ((parts - entries[guess]) ** 2).sum(1)
    row, entry = np.nonzero(sums <= bound[:, None])
    sums = sums[row, entry]
    for j in range(1, parts.shape[1]):
        sums = sums + (parts[row, j] - entries[entry, j]) ** 2
        left = sums <= bound[row]
        row, entry, sums = row[left], entry[left], sums[left]
    best = np.minimum.reduceat(sums, np.searchsorted(row, everyone))
    hit = np.flatnonzero(sums == best[row])
    return entry[hit[np.searchsorted(row[hit], everyone)]], best


class Codebooks:
    """``numbers[part, entry, place]``: integer entries, with the transform that searches them."""

    def __init__(self, numbers: np.ndarray):
        self.numbers = numbers
        self.transformed = walsh(numbers)

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per vector and part: entry, squared distance."""
        parts, entries, width = self.numbers.shape
        size = self.transformed.shape[-1]
        code, error = np.zeros((len(vectors), parts), np.int64), np.zeros((len(vectors), parts), object)
        for start in range(0, len(vectors), ROWS):
            cut = vectors[start : start + ROWS].reshape(-1, parts, width)
            # A transformed number is at most size times as large, and size squares of differences are added.
            wide = (2 * size * largest(cut, self.numbers)) ** 2 * size >= 1 << 63
            left, right = walsh(cut.astype(object) if wide else cut), self.transformed.astype(object if wide else np.int64)
            for p in range(parts):
                code[start : start + ROWS, p], found = nearest(left[:, p], right[p])
                error[start : start + ROWS, p] = found // size
        return code, error

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.numbers.ravel()).encode()).hexdigest()


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """A number as digits of 32 bits, the last one signed, so that sums of any size add up in 64 bits."""
    at = 0
    while not -(1 << _WORD) <= value < 1 << _WORD:
        yield at, value & ((1 << _WORD) - 1)
        value, at = value >> _WORD, at + 1
    yield at, value


def _sums(kept: DataFrame, books: Codebooks, scale: int) -> DataFrame:
    """``part, entry, place, limb, value``: sums of the parts of each entry; place -1 counts them.

    A task holds one number per component of the codebooks, whatever its rows are.
    """
    parts, entries, width = books.numbers.shape
    schema = "part int, entry int, place int, limb int, value long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                vectors = matrix(batch.column("vector").slice(start, ROWS), scale, parts * width)
                code, _ = books.assign(vectors)
                cut = vectors.reshape(-1, parts, width)
                own = np.zeros(sums.shape, object if largest(cut) >= 1 << 50 else np.int64)
                for p in range(parts):
                    np.add.at(own[p], code[:, p], cut[:, p])
                    counts[p] += np.bincount(code[:, p], minlength=entries)
                sums += own.astype(object)
        rows = [
            (p, e, place, limb, digit)
            for p, e in zip(*(x.tolist() for x in np.nonzero(counts)))
            for place, value in enumerate([int(counts[p, e]), *map(int, sums[p, e])], -1)
            for limb, digit in _limbs(value)
        ]
        columns = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 4 + [pa.int64()])], names=["part", "entry", "place", "limb", "value"])

    partial = small_batches(kept.select("vector")).mapInArrow(run, schema)
    return partial.groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value"))


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of ``finite`` vectors: the parts of the first ids, moved ``rounds`` times to the floor of their mean.

    All vectors take part in every round. Only codebooks and their sums come to
    the driver: ``parts * entries`` entries, however many rows there are.
    """
    longest = kept.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return None
    width = -(-longest // parts)
    first = kept.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    start = matrix(pa.array([r.vector for r in first], pa.list_(pa.float64())), scale, parts * width)
    books = Codebooks(start.reshape(-1, parts, width).transpose(1, 0, 2))
    for _ in range(rounds):
        moved = books.numbers.astype(object)
        totals: dict[tuple[int, int, int], int] = {}
        for r in _sums(kept, books, scale).collect():
            key = (r.part, r.entry, r.place)
            totals[key] = totals.get(key, 0) + (r.value << (_WORD * r.limb))
        for (p, e, place), value in totals.items():
            if place >= 0:
                moved[p, e, place] = value // totals[p, e, -1]
        books = Codebooks(moved if largest(moved) >= 1 << 62 else moved.astype(np.int64))
    return books


def compressed(
    df: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """One row per usable vector: ``id_column, code, error, label_error, codebooks_sha256``.

    Rows whose vector is null or holds null or non-finite numbers are left out.
    Vectors are as long as the longest one, to a multiple of ``parts``: shorter
    ones end in zeros, an empty one is all zeros. Codebooks start with the first
    ``entries`` (at most 256) ids; null ids come last, repeated ids in the order of
    their vectors, and there are fewer entries where there are fewer rows. Repeated
    rows count and are coded one by one. Numbers may be of any finite size; sums
    of errors beyond 64 bits are returned as the largest long. An empty table
    gives no rows. Other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part")
    kept = finite(df, id_column, vector, F.col(label).isNull().alias("null_label"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label_text"))
    books = fit(kept, parts, entries, rounds, scale)
    names = ["id", "null_label", "label_text", "code", "error"]
    longest = parts * books.numbers.shape[2] if books else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = books.assign(matrix(batch.column("vector"), scale, longest))
            sums = [min(int(x), (1 << 63) - 1) for x in error.sum(1)]
            codes = [row.tobytes().hex() for row in code.astype(np.uint8)]
            own = [batch.column(c) for c in names[:3]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(codes, pa.string()), pa.array(sums, pa.int64())], names=names)

    kind = kept.schema["id"].dataType.simpleString()
    coded = stored(small_batches(kept).mapInArrow(run, f"id {kind}, null_label boolean, label_text string, code string, error long"), "vector-codes")
    keys = ["null_label", "label_text"]
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)"))
    labels = coded.groupBy(*keys).agg(total.cast("long").alias("label_error"))
    joined = many_to_one(coded, labels, keys, "inner")
    return joined.select(F.col("id").alias(id_column), "code", "error", "label_error", F.lit(books.digest() if books else "").alias("codebooks_sha256"))


def compressed_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same rows as SQL, every part against every entry; for vectors of one length."""
    books = f"""book0 AS (SELECT part, n AS entry, v FROM cut JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM kept) USING (vec_id)
             WHERE n < {entries})"""
    near = lambda i: f"""near{i} AS MATERIALIZED (SELECT vec_id, label, part, v, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
             SELECT c.vec_id, c.label, c.part, c.v, b.entry, list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
             FROM cut c JOIN book{i} b USING (part)) GROUP BY vec_id, label, part, v)"""  # noqa: E731
    moved = lambda i: f"""mean{i} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY k) AS v FROM (
             SELECT part, entry, k, sum(x)::BIGINT AS s, count(*)::BIGINT AS n
             FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS k FROM near{i}) GROUP BY part, entry, k) GROUP BY part, entry),
         book{i + 1} AS (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN mean{i} m USING (part, entry))"""  # noqa: E731
    steps = ",\n".join(f"{near(i)},\n{moved(i)}" for i in range(rounds))
    return f"""
    WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
                  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    cut AS MATERIALIZED (SELECT vec_id, label, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) t(part)),
    {books},
    {steps},
    {near(rounds)},
    coded AS (SELECT vec_id, label, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id, label),
    final AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS h FROM book{rounds})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM coded, final
    """
