"""SimHash near-duplicates, searched with a pivot distance table.

Distances to reference fingerprints bound the distance of two fingerprints from
below: d(x, y) >= |d(x, r) - d(y, r)| for every reference r. Spread references say
little about 64-bit codes, which all lie about 32 bits apart. So the references
are a base, the base with one small block of bits flipped (one per block), and
some spread ones. For the reference with flipped block B,
d(x, r_B) - d(x, base) depends on the bits of x in B only, and two fingerprints at
distance 2 or less disagree in these differences for at most two blocks. With the
blocks dealt into G groups, at least G - 2 groups agree in every coordinate: those
coordinates are the join keys, and no pair within the radius is missed.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.graph import components
from almanac.llm.rows import per_slice, text_bytes, word_chunks
from almanac.operators.joins import many_to_one, semi_filter
from almanac.session import stored

RADIUS = 2
BITS = 64
BLOCK = 2
GROUPS = 6
SPREAD = 8
# A cell of at most so many fingerprints is searched by pairs, a larger one by shared neighbours.
CELL = 16
_MASK = (1 << 64) - 1


def fingerprint(data: bytes | None, width: int = 3, seed: int = 42) -> int:
    """64-bit fingerprint as a signed number; a text without words, or null, has 0."""
    counts, total, carried = np.zeros(BITS, dtype=np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for chunk in word_chunks((data or b"").lower()):
        words = carried + chunk
        shingles = [b" ".join(s) for s in zip(*[words[i:] for i in range(width)])]
        carried = words[-(width - 1) :] if width > 1 else []
        hashes = np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(shingles))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(shingles)
    if not total and carried:
        return int(np.array(digest(b" ".join(carried), seed), np.uint64).view(np.int64))
    bits = np.packbits(2 * counts > total, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """``id_column, fp`` for every row. Other columns are ignored."""

    def compute(part: dict[str, list]) -> dict[str, list]:
        return {"id": part["id"], "fp": [fingerprint(t, width, seed) for t in part["_text"]]}

    rows = text_bytes(docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")), "id")
    return per_slice(rows, compute, "id long, fp long").withColumnRenamed("id", id_column)


def references() -> tuple[int, list[int], list[int]]:
    """Base, the base with each block flipped, and the spread references, as signed numbers."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    spread = [xxhash.xxh64_intdigest(bytes([i]), 0) for i in range(SPREAD + 1)]
    base = spread[0]
    flipped = [base ^ ((((1 << BLOCK) - 1) << i) & _MASK) for i in range(0, BITS, BLOCK)]
    return signed(base), [signed(r) for r in flipped], [signed(r) for r in spread[1:]]


def _distance(fp: Column, reference: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(reference).cast("long")))


def pivot_table(codes: DataFrame) -> DataFrame:
    """``fp, g0.., d0..``: per group its coordinates as one number, and the distances to the spread references."""
    base, flipped, spread = references()
    fp = F.col("fp")
    parts: list[list[int]] = [[] for _ in range(GROUPS)]
    for i, reference in enumerate(flipped):
        parts[i % GROUPS].append(reference)
    columns = [_distance(fp, base).alias("_base")]
    columns += [_distance(fp, r).cast("byte").alias(f"d{i}") for i, r in enumerate(spread)]
    table = codes.select("fp", *columns)
    # d(x, r_B) - d(x, base) runs from -BLOCK to BLOCK in steps of two.
    coordinate = lambda r: ((_distance(fp, r) - F.col("_base") + F.lit(BLOCK)) / 2).cast("long")
    packed = [reduce(lambda a, b: a * (BLOCK + 1) + b, [coordinate(r) for r in part]) for part in parts]
    return table.select("fp", *[c.alias(f"g{i}") for i, c in enumerate(packed)], *[f"d{i}" for i in range(SPREAD)])


def links(codes: DataFrame) -> DataFrame:
    """``u, v``: links that join all distinct fingerprints ``fp`` within the radius.

    Small cells give every pair within the radius. A crowded cell (a group of
    thousands of near copies) gives a linear number of links instead: two
    fingerprints are within two bits exactly if one is the other's neighbour or
    both have a common neighbour one bit away, so each is tied to the smallest
    fingerprint around each of its 65 neighbours. The components are the same.
    """
    table = pivot_table(codes)
    size = (BLOCK + 1) ** (-(-(BITS // BLOCK) // GROUPS))
    kept = list(combinations(range(GROUPS), GROUPS - RADIUS))
    keys = [F.struct(F.lit(i).alias("k"), reduce(lambda a, b: a * size + b, [F.col(f"g{j}") for j in c]).alias("cell")) for i, c in enumerate(kept)]
    distances = [f"d{i}" for i in range(SPREAD)]
    cells = table.select("fp", *distances, F.explode(F.array(*keys)).alias("_key")).select("fp", "_key.k", "_key.cell", *distances)
    sizes = cells.groupBy("k", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(many_to_one(cells, sizes, ["k", "cell"], "inner"), "cells")
    few = shared.where(F.col("n") <= CELL)
    a, b = few.alias("a"), few.alias("b")
    bound = reduce(F.greatest, [F.abs(F.col(f"a.{d}") - F.col(f"b.{d}")) for d in distances])
    same = (F.col("a.k") == F.col("b.k")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp"))
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS
    pairs = a.join(b, same & (bound <= RADIUS) & near).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    crowded = shared.where(F.col("n") > CELL).select("fp").distinct()
    around = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(x - (1 << 64) if x >> 63 else x).cast("long")) for x in (1 << i for i in range(BITS))]
    spots = crowded.select("fp", F.explode(F.array(*around)).alias("spot"))
    lowest = spots.groupBy("spot").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    tied = many_to_one(spots, lowest, ["spot"], "inner").where("fp <> low").select(F.col("fp").alias("u"), F.col("low").alias("v"))
    return pairs.union(tied).distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: ``id_column, fp, component_id``, the smallest id reachable over links.

    Texts without words, and null texts, have fingerprint 0 and link to each
    other. Repeated rows are returned as often as they occur. A null id never
    names a component while another id is in it. An empty table gives no rows.
    """
    coded = stored(fingerprints(docs, id_column, text, width, seed), "fingerprints")
    first = coded.groupBy("fp").agg(F.min(id_column).alias("first"))
    roots = components(links(first.select("fp")))
    rooted = first.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "roots")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = many_to_one(rooted, smallest, ["root"], "inner").select("fp", "component_id")
    return many_to_one(coded, named, ["fp"], "inner").select(id_column, "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    """A fingerprint as 16 lower-case digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_per_group(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """The rows of the smallest id of each near-duplicate group, all columns kept.

    Rows with the same id count once. Rows without an id cannot be named by a
    group: of these, one row of each distinct text is kept.
    """
    groups = near_duplicates(docs, id_column, text, width)
    keep = groups.where(F.col(id_column) == F.col("component_id")).select(F.col(id_column).alias("key")).distinct()
    # A row travels as one column, so that no name of its columns can clash.
    rows = docs.select(F.col(id_column).alias("key"), F.col(text).alias("text"), F.struct(*docs.columns).alias("row"))
    named = semi_filter(rows, keep, ["key"]).dropDuplicates(["key"])
    nameless = rows.where("key IS NULL").dropDuplicates(["text"])
    return named.union(nameless).select("row.*")
