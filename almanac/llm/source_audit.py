"""How far the vocabularies of sources differ within a language.

The counts of terms (columns) by source (rows) are a sparse matrix. It is cut into
tiles of a bounded number of rows and columns, and each tile is held as a K x K
quadtree (K = 2): sorted Morton codes of the quadrants that hold anything, level by
level, down to leaves of 8 x 8 cells. Two sources are compared by walking both
trees jointly: a quadrant that is all zero on both sides has one price per pair,
its width times the difference of the shares of a count of zero; only where a side
holds something are leaves compared cell by cell.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.rows import SLICE, small_batches, word_chunks
from almanac.operators.joins import many_to_one
from almanac.session import stored

LEAST_DOCS = 30
SMOOTHING = 5
UNIT = 1_000_000_000
TOP = 50
ROWS, COLUMNS, LEAF = 128, 1 << 13, 8
# Distinct terms that a task counts before it hands its counts on, and leaf pairs compared at a time.
HELD, AT_ONCE = 1 << 18, 512
# A term is letters: everything from 0x80 on and ASCII letters, which become lower case.
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def term_counts(docs: DataFrame, group: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term; the term '' stands for the group itself.

    A task adds up documents of a group before they are shuffled, whatever share of the rows the group has.
    """
    kinds = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def emit(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, name), (uses, docs_of) in held.items():
            words = pa.array(uses.keys(), pa.binary()).cast(pa.string())
            same = lambda value: pa.array([value]).take(pa.array(np.zeros(len(words), np.int64)))
            numbers = [pa.array(uses.values(), pa.int64()), pa.array([docs_of[w] for w in uses], pa.int64())]
            yield pa.RecordBatch.from_arrays([same(lang), same(name), words, *numbers], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                for lang, name, data in zip(*(part.column(i).to_pylist() for i in range(3))):
                    uses, docs_of = held.setdefault((lang, name), (Counter(), Counter()))
                    seen: set[bytes] = {b""}
                    uses[b""] += 0
                    for words in word_chunks(data.translate(_LOWER)):
                        uses.update(words)
                        seen.update(words)
                    docs_of.update(seen)
                if sum(len(uses) for uses, _ in held.values()) > HELD:
                    yield from emit(held)
                    held = {}
        yield from emit(held)

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(blank(group).alias("lang"), blank(source).alias("source"), blank(text).cast("binary").alias("text"))
    partial = small_batches(rows).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + 5) / (total + 5 * kept)); products may exceed 64 bits."""
    above = (count + SMOOTHING).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    below = F.greatest(total + SMOOTHING * kept, F.lit(1)).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", above, below)


def morton(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Bits of row and column in turns: a quadrant is a range of codes."""
    rows, columns = rows.astype(np.int64), columns.astype(np.int64)
    code = np.zeros(len(rows), dtype=np.int64)
    for bit in range(31):
        code |= ((rows >> bit) & 1) << (2 * bit + 1) | ((columns >> bit) & 1) << (2 * bit)
    return code


class Quadtree:
    """Sparse rows of shares; ``zero[row]`` is the share of a count of zero."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, shares: np.ndarray, zero: np.ndarray, width: int):
        self.zero, self.width, self.rows = zero, width, len(zero)
        span = max(self.rows, width, 1)
        self.depth = max(0, -(-span // LEAF) - 1).bit_length()
        leaves = morton(rows // LEAF, columns // LEAF)
        self.levels = [np.unique(leaves >> (2 * level)) for level in range(self.depth + 1)]
        padded = np.zeros(-(-self.rows // LEAF) * LEAF, dtype=np.int64)
        padded[: self.rows] = zero
        self.blank = padded.reshape(-1, LEAF)
        # Cells without a count have the row's share of zero.
        of_row = np.zeros(len(self.levels[0]), dtype=np.int64)
        at = np.searchsorted(self.levels[0], leaves)
        of_row[at] = rows // LEAF
        self.cells = np.repeat(self.blank[of_row][:, :, None], LEAF, axis=2) if len(at) else np.zeros((0, LEAF, LEAF), np.int64)
        self.cells[at, rows % LEAF, columns % LEAF] = shares

    def find(self, level: int, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether quadrants hold anything, and their place among those that do."""
        code, known = morton(rows, columns), self.levels[level]
        at = np.searchsorted(known, code)
        inside = at < len(known)
        inside[inside] = known[at[inside]] == code[inside]
        return inside, at

    def leaves(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Dense cells of leaves, also of those without a count."""
        inside, at = self.find(0, rows, columns)
        out = np.repeat(self.blank[rows][:, :, None], LEAF, axis=2)
        out[inside] = self.cells[at[inside]]
        return out


def differences(a: Quadtree, b: Quadtree) -> np.ndarray:
    """Sum over all columns of |share - share| for each row of ``a`` and of ``b``; with a tree itself only rows a < b count."""
    same, depth = a is b, max(a.depth, b.depth)
    tall = [-(-t.rows // LEAF) for t in (a, b)]
    leaf_sums = np.zeros((*tall, LEAF, LEAF), dtype=np.int64)
    zeros = np.zeros((tall[0] * LEAF, tall[1] * LEAF), dtype=np.int64)
    ra = rb = c = np.zeros(1, dtype=np.int64)
    for level in range(depth, -1, -1):
        side = LEAF << level
        inside = (ra * side < a.rows) & (rb * side < b.rows) & (c * side < a.width)
        if same:
            inside &= ra <= rb
        ra, rb, c = ra[inside], rb[inside], c[inside]
        held = (a.find(level, ra, c)[0] if level <= a.depth else np.ones(len(c), bool)) | (b.find(level, rb, c)[0] if level <= b.depth else np.ones(len(c), bool))
        # All-zero quadrants: widths are added per pair of row ranges, and priced at the end.
        blank = np.zeros((-(-a.rows // side), -(-b.rows // side)), dtype=np.int64)
        np.add.at(blank, (ra[~held], rb[~held]), np.minimum(a.width - c[~held] * side, side))
        ra, rb, c = ra[held], rb[held], c[held]
        if not level:  # columns that only pad a leaf were compared as zeros: take them off again
            np.add.at(blank, (ra, rb), np.minimum(a.width - c * side, side) - side)
        zeros += np.repeat(np.repeat(blank, side, 0), side, 1)[: zeros.shape[0], : zeros.shape[1]]
        if level:
            quarter = np.arange(8)
            ra, rb, c = ((2 * x[:, None] + ((quarter >> bit) & 1)).ravel() for x, bit in ((ra, 2), (rb, 1), (c, 0)))
    for start in range(0, len(c), AT_ONCE):
        own = slice(start, start + AT_ONCE)
        left, right = a.leaves(ra[own], c[own]), b.leaves(rb[own], c[own])
        np.add.at(leaf_sums, (ra[own], rb[own]), np.abs(left[:, :, None, :] - right[:, None, :, :]).sum(-1))
    sums = leaf_sums.transpose(0, 2, 1, 3).reshape(zeros.shape)[: a.rows, : b.rows]
    return sums + zeros[: a.rows, : b.rows] * np.abs(a.zero[:, None] - b.zero[None, :])


def _tile(table: pa.Table, top: int) -> pa.Table:
    """Rows of one tile, or of two in the same columns, to sums of pairs and, for one, its leading terms."""
    data = {c: table[c].to_numpy() for c in ("side", "place", "col", "p", "width")}
    names, lang = table["name"], table["lang"][0].as_py()
    width = int(data["width"].max())
    trees, sources = [], []
    for side in (0, 1):
        head = np.flatnonzero((data["side"] == side) & (data["col"] < 0))
        head = head[np.argsort(data["place"][head])]
        body = (data["side"] == side) & (data["col"] >= 0) & (data["place"] >= 0)
        trees.append(Quadtree(data["place"][body], data["col"][body], data["p"][body], data["p"][head], width))
        sources.append(names.take(pa.array(head)).combine_chunks())
    single = table["x"][0].as_py() == table["y"][0].as_py()
    a, b = trees[0], trees[0] if single else trees[1]
    sums = differences(a, b)
    g, h = np.nonzero(np.triu(np.ones(sums.shape, bool), 1)) if single else (x.ravel() for x in np.indices(sums.shape))
    left, right = sources[0].take(pa.array(g)), sources[0 if single else 1].take(pa.array(h))
    value = sums[g, h]
    out = [(left, right, value, "pair"), (right, left, value, "pair")]
    if single:
        # The language is one more row; its shares are compared with those in the leaves of each source.
        head = np.flatnonzero(data["place"] < 0)
        head = head[np.argsort(data["col"][head])]
        terms, shares = names.take(pa.array(head)).combine_chunks(), data["p"][head]
        order = np.empty(len(head), dtype=np.int64)
        order[sorted(range(len(head)), key=terms.cast(pa.binary()).to_pylist().__getitem__)] = np.arange(len(head))
        body = np.flatnonzero((data["col"] >= 0) & (data["place"] >= 0))
        row, col = data["place"][body], data["col"][body]
        over = data["p"][body] - shares[col]
        row, col, over = row[over > 0], col[over > 0], over[over > 0]
        best = np.lexsort((order[col], -over, row))
        best = best[np.arange(len(best)) - np.searchsorted(row[best], row[best]) < top]
        out.append((sources[0].take(pa.array(row[best])), terms.take(pa.array(col[best])), over[best], "term"))
    return pa.concat_tables(
        pa.table({"lang": pa.array([lang] * len(v), pa.string()), "source": s, "part": pa.array([kind] * len(v), pa.string()), "item": i, "value": pa.array(v, pa.int64())})
        for s, i, v, kind in out
    )


def audit(
    docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, group: str = "lang", source: str = "source", text: str = "text", rows: int = ROWS, columns: int = COLUMNS
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every source of every language.

    Part ``pair`` has each other source of the language by the difference of their
    term shares, part ``term`` the ``top`` terms of which the source has a larger
    share than the language. Terms in fewer than ``least_docs`` documents of the
    language do not count. Null texts, languages and sources read as ''; a source
    without terms has the shares of zero counts; in a language without terms all
    differences are 0; a language's only source has no pair. Repeated rows count as
    often as they occur, texts may be of any length, ties go to the item first in
    UTF-8 order. An empty table gives no rows. Other columns are ignored.

    Terms and sources are dealt to tiles by hash, at most about ``columns`` terms and
    ``rows`` sources each, so a tile is bounded whatever a language's or a source's
    share of the rows is. Every pair of row blocks of a language is compared once
    per column block; only sums travel on.
    """
    counts = stored(term_counts(docs, group, source, text), "term-counts")
    uses = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = stored(uses.where(F.col("docs") >= least_docs), "terms")
    totals = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("total"))
    known = counts.where("term = ''").select("lang", "source")
    heights = known.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    blocks = lambda n, size: F.greatest(F.ceil(n / size), F.lit(1)).cast("int")
    languages = heights.join(totals, "lang", "left").select(
        "lang", F.coalesce("kept", F.lit(0)).alias("kept"), "total", blocks(F.col("sources"), rows).alias("tall"), blocks(F.coalesce("kept", F.lit(0)), columns).alias("wide")
    )
    languages = stored(languages, "languages")
    hashed = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    place = lambda block, *order: (F.row_number().over(Window.partitionBy("lang", block).orderBy(*order)) - 1).cast("int")
    # Frequent terms and large sources come first in their tile, so that zeros lie together.
    columned = many_to_one(terms, languages, ["lang"], "inner").withColumn("c", hashed("term", "wide"))
    columned = columned.withColumn("col", place("c", F.col("docs").desc(), F.col("term")))
    columned = stored(columned.select("lang", "term", "c", "col", "tall", _share(F.col("n"), F.col("total"), F.col("kept")).alias("q")), "columns")
    cells = stored(counts.where("term <> ''").select("lang", "source", "term", "n").join(columned.select("lang", "term", "c", "col"), ["lang", "term"]).drop("term"), "cells")
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("kinds"))
    placed = many_to_one(known.join(sizes, ["lang", "source"], "left").fillna(0, ["size", "kinds"]), languages, ["lang"], "inner").withColumn("r", hashed("source", "tall"))
    placed = stored(placed.withColumn("place", place("r", F.col("kinds").desc(), F.col("source"))).drop("kinds"), "sources")
    range_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    widths = columned.groupBy("lang", "c").agg(F.count(F.lit(1)).cast("int").alias("width"))
    heads = placed.select("lang", "source", "size", "kept", "r", "place", "tall", range_of("wide").alias("c")).join(widths, ["lang", "c"], "left")
    heads = heads.select(
        "lang", "c", "r", "tall", "place", F.lit(-1).alias("col"), _share(F.lit(0), F.col("size"), F.col("kept")).alias("p"), F.coalesce("width", F.lit(0)).alias("width"),
        F.col("source").alias("name"),
    )
    body = many_to_one(cells, placed.select("lang", "source", "size", "kept", "r", "place", "tall"), ["lang", "source"], "inner")
    body = body.select(
        "lang", "c", "r", "tall", "place", "col", _share(F.col("n"), F.col("size"), F.col("kept")).alias("p"), F.lit(0).alias("width"), F.lit(None).cast("string").alias("name")
    )
    # A row block meets every block of its language: as the first side with later ones and itself, as the second with earlier ones.
    dealt = heads.unionByName(body).select("*", range_of("tall").alias("other"))
    side = F.when(F.col("r") <= F.col("other"), 0).otherwise(1)
    dealt = dealt.select("lang", "c", F.least("r", "other").alias("x"), F.greatest("r", "other").alias("y"), side.alias("side"), "place", "col", "p", "width", "name")
    own = columned.select("lang", "c", range_of("tall").alias("x"), F.lit(0).alias("side"), F.lit(-1).alias("place"), "col", F.col("q").alias("p"), F.lit(0).alias("width"), F.col("term").alias("name"))
    tiles = dealt.unionByName(own.withColumn("y", F.col("x"))).groupBy("lang", "c", "x", "y")
    found = stored(tiles.applyInArrow(lambda table: _tile(table, top), "lang string, source string, part string, item string, value long"), "differences")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    leading = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(leading)


def audit_sql(least_docs: int = LEAST_DOCS, top: int = TOP) -> str:
    """The same rows as SQL, every pair of sources over every term."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    share = lambda n, total: f"1 + ({UNIT}::HUGEINT * ({n} + {SMOOTHING})) // ({total} + {SMOOTHING} * v)"
    return f"""
    WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({lower}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    grps AS (SELECT DISTINCT lang, source FROM docs),
    terms AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM docs) GROUP BY lang, term HAVING count(*) >= {least_docs}),
    cells AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM docs) SEMI JOIN terms USING (lang, term) GROUP BY ALL),
    vocabulary AS (SELECT lang, count(*) AS v FROM terms GROUP BY lang),
    whole AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM cells GROUP BY lang, term),
    sizes AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM grps LEFT JOIN cells USING (lang, source) GROUP BY lang, source),
    shares AS (SELECT s.lang, s.source, t.term, coalesce(c.n, 0) AS n, {share("coalesce(c.n, 0)", "s.total")} AS p
               FROM sizes s JOIN terms t USING (lang) JOIN vocabulary USING (lang) LEFT JOIN cells c USING (lang, source, term)),
    pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    allpairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
                 FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
    ahead AS (SELECT s.lang, s.source, 'term' AS part, s.term AS item, (s.p - ({share("w.n", "w.total")}))::BIGINT AS value
                FROM shares s JOIN whole w USING (lang, term) JOIN vocabulary USING (lang) WHERE s.n > 0 AND s.p > {share("w.n", "w.total")})
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
    FROM (SELECT * FROM allpairs UNION ALL SELECT * FROM ahead) QUALIFY part = 'pair' OR rank <= {top}
    """
