"""Exact search for the largest inner products, dimension by dimension.

A dimension is a term: its postings are the candidates with a number other than
zero there. Query rows, taken as sparse, scatter their weight times the postings
into dense arrays of scores, one array per query; when all terms are done, a
partition of the array selects the best. Queries and candidates meet in a grid of
cells: each cell holds a bounded share of the queries and of the candidates, and
gives the best of its candidates for each of its queries, which are then merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.vectors import finite, largest, matrix

SCALE = 1024
K = 10
EVERY = 100
# At most about so many queries and candidates meet in a cell, and at least so many candidates.
CELL_QUERIES, CELL_CANDIDATES, LEAST_CANDIDATES = 1 << 14, 1 << 16, 1 << 12
# Queries and candidates whose scores are held at a time: 1 MB of scores.
_QUERIES, _CANDIDATES = 64, 4096
_LONGEST = (1 << 63) - 1


def _accumulate(queries: np.ndarray, postings: list[tuple[np.ndarray | None, np.ndarray]], size: int) -> np.ndarray:
    """Scores of every query and candidate: weights times postings, added term by term."""
    scores = np.zeros((len(queries), size), dtype=queries.dtype)
    product = np.empty_like(scores)
    for j, (places, weights) in enumerate(postings):
        asking = np.flatnonzero(queries[:, j])
        if not len(asking) or not len(weights):
            continue
        if places is None and 2 * len(asking) >= len(queries):
            np.multiply(queries[:, j, None], weights, out=product)
            scores += product
        else:
            places = np.arange(size) if places is None else places
            scores[np.ix_(asking, places)] += queries[asking, j, None] * weights
    return scores


def _postings(candidates: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """Per term the candidates that hold it and their weights; a term of most candidates is a full column, without places."""
    found = []
    for j in range(candidates.shape[1]):
        column = np.ascontiguousarray(candidates[:, j])
        places = np.flatnonzero(column)
        found.append((None, column) if 2 * len(places) >= len(column) > 0 else (places, column[places]))
    return found


def best(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, named: np.ndarray, candidates: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query places, candidate places and scores of the ``k`` best candidates of each query.

    Candidates are in the order that settles ties. ``named`` marks those with an
    id; a query never finds its own id. Scores beyond 64 bits are cut to the range.
    """
    bound = largest(queries) * largest(candidates) * max(1, queries.shape[1])
    kind = np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 62 else object
    queries, candidates = queries.astype(kind), candidates.astype(kind)
    least = -(1 << 31) if kind is np.int32 else -_LONGEST - 1
    n = int(named.sum())  # candidates without an id are the last ones
    chosen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    blocks = [(a, _postings(candidates[a : a + _CANDIDATES]), len(candidates[a : a + _CANDIDATES])) for a in range(0, len(candidates), _CANDIDATES)]
    for first in range(0, len(queries), _QUERIES):
        part, own_ids = queries[first : first + _QUERIES], query_ids[first : first + _QUERIES]
        lo, hi = np.searchsorted(ids[:n], own_ids, "left"), np.searchsorted(ids[:n], own_ids, "right")
        own = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for start, postings, size in blocks:
            scores = _accumulate(part, postings, size)
            if kind is object:
                scores = np.clip(scores, -_LONGEST, _LONGEST).astype(np.int64)
            for q in np.flatnonzero((lo < start + size) & (hi > start) & (lo < hi)):
                scores[q, max(0, lo[q] - start) : hi[q] - start] = least
            edge = np.full(len(part), least) if size <= k else np.partition(scores, size - k, axis=1)[:, size - k]
            q, c = np.nonzero((scores >= edge[:, None]) & (scores > least))
            found = tuple(np.concatenate(x) for x in zip(own, (q, c + start, scores[q, c].astype(np.int64))))
            # Stable: earlier blocks hold earlier candidates, and within a block they are in order.
            order = np.lexsort((found[1], -found[2], found[0]))
            q = found[0][order]
            order = order[np.arange(len(q)) - np.searchsorted(q, q) < k]
            own = tuple(x[order] for x in found)
        chosen.append((own[0] + first, own[1], own[2]))
    return tuple(np.concatenate(x) for x in zip(*chosen)) if chosen else tuple(np.zeros(0, np.int64) for _ in range(3))


def search(
    df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = K, scale: int = SCALE
) -> DataFrame:
    """``query_id, rank, id_column, score``: for ids divisible by ``every`` the ``k`` largest inner products over all rows.

    Numbers become floor(scale * x). Rows whose vector is null or holds null or
    non-finite numbers take no part. Shorter vectors, also empty ones, count as
    ending in zeros. A row with the query's id is the query's own and is not
    found. Ties go to the smaller id; rows without an id are candidates, last in
    ties, never queries. Repeated candidates are found each; a repeated query row is
    one query, different vectors of one id are queries apart with ranks of their
    own. Scores beyond 64 bits count as the nearest long. An empty table, or one
    without queries, gives no rows. Other columns are ignored.

    Rows are dealt to cells by their place in the input, so no id, repeated or not,
    can crowd one. A candidate travels once for each share of the queries.
    """
    kept = finite(df, id_column, vector).withColumn("id", F.col("id").cast("long"))
    sizes = df.agg(F.count(F.lit(1)), F.count(F.when(F.col(id_column) % every == 0, 1))).first()
    slots = 2 * df.sparkSession.sparkContext.defaultParallelism
    across = -(-sizes[1] // CELL_QUERIES) or 1
    down = max(-(-sizes[0] // CELL_CANDIDATES), min(slots, -(-sizes[0] // LEAST_CANDIDATES)), 1)
    number = lambda n: F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = kept.where(F.col("id") % every == 0).dropDuplicates(["id", "vector"])
    asked = asked.select("id", "vector", F.pmod(F.xxhash64("id", "vector"), F.lit(across)).cast("int").alias("x"), spread(down).alias("y"))
    rows = kept.select("id", "vector", number(down).alias("y")).select("*", spread(across).alias("x"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        width = max(int(np.diff(c.combine_chunks().offsets.to_numpy()).max(initial=0)) if len(c) else 0 for c in (left["vector"], right["vector"]))
        right = right.sort_by([("id", "ascending")])  # null ids are put last
        named = right["id"].is_valid().to_numpy()
        ids = right["id"].fill_null(0).to_numpy()
        # Queries of one id lie together, so few blocks of candidates hold their own rows.
        left = left.sort_by([("id", "ascending")])
        queries, candidates = matrix(left["vector"], scale, width), matrix(right["vector"], scale, width)
        q, c, score = best(left["id"].to_numpy(), queries, ids, named, candidates, k)
        found = [left["id"].take(pa.array(q)), left["mark"].take(pa.array(q)), right["id"].take(pa.array(c)), pa.array(score, pa.int64())]
        return pa.table(found, names=["query_id", "mark", "id", "score"])

    asked = asked.withColumn("mark", F.xxhash64("vector"))
    cells = asked.groupBy("x", "y").cogroup(rows.groupBy("x", "y")).applyInArrow(cell, "query_id long, mark long, id long, score long")
    order = Window.partitionBy("query_id", "mark").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_column), "score")


def search_sql(every: int = EVERY, k: int = K, scale: int = SCALE) -> str:
    """The same rows as SQL, every query against every row; for ids that occur once."""
    return f"""
    WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
                  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
               FROM kept q JOIN kept c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= {k}
    """
