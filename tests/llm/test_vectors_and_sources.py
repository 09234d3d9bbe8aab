"""Vector codes, exact search and the source audit against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.llm import source_audit, topk_search, vector_codes
from almanac.llm.vectors import exact, finite

NAN, INF = float("nan"), float("inf")
LONGEST = (1 << 63) - 1


def scaled(vector, scale):
    return [math.floor(Fraction(x) * scale) for x in vector]


def usable(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


@pytest.fixture
def vectors(spark):
    def build(rows):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
        return df.withColumns({c: F.lit("clash") for c in ["id", "vector", "code", "error", "x", "y", "mark", "part", "score", "rank", "null_label"]})

    return build


def odd_vectors(rng, n, width=8, wide=False):
    rows = [(i, [rng.randrange(-3, 4) / 256 + rng.choice([0, 1e-4]) for _ in range(width)], rng.choice([1, 2, None])) for i in range(n)]
    rows += [(n + i, rows[i][1], 1) for i in range(10)]  # copies
    rows += [rows[0], rows[0], (None, [0.25] * width, None), (None, [0.5] * width, 3)]
    rows += [(100, None, 1), (200, [NAN] * width, 1), (300, [INF] + [0.0] * (width - 1), 1), (400, [None] + [0.0] * (width - 1), 2), (-100, [-INF] * width, 1)]
    rows += [(500, [], 1), (600, [1.0], None), (-5, [0.5] * (width - 1), 2)]
    if wide:
        rows += [(700, [1e30, -1e30] * (width // 2), 2), (800, [1e300] + [0.0] * (width - 1), 2)]
    return rows


def brute_codes(rows, parts, entries, rounds, scale=256):
    kept = [(i, scaled(v, scale), lab) for i, v, lab in rows if usable(v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), lab) for i, v, lab in kept]
    by_id = sorted(((i is None, i or 0, [x for x in v]), v) for (i, v, _) in kept)
    first = [v for _, v in by_id][:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in first] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), n) for n, e in enumerate(books[p]))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v, _ in kept:
            for p in range(parts):
                members[p, near(v, p)[1]].append(cut(v, p))
        for (p, n), own in members.items():
            books[p][n] = [sum(c) // len(own) for c in zip(*own)]
    found = [(i, lab, [near(v, p) for p in range(parts)]) for i, v, lab in kept]
    totals = Counter()
    for _, lab, hits in found:
        totals[lab] += min(sum(d for d, _ in hits), LONGEST)
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return Counter(
        (i, "".join(f"{n:02x}" for _, n in hits), min(sum(d for d, _ in hits), LONGEST), min(totals[lab], LONGEST), digest) for i, lab, hits in found
    )


@pytest.mark.parametrize("parts, wide", [(4, False), (3, False), (4, True)])
def test_codes_equal_brute_force(vectors, parts, wide):
    rows = odd_vectors(random.Random(7), 60, wide=wide)
    found = vector_codes.compressed(vectors(rows).repartition(5), parts=parts, entries=12).collect()
    assert Counter(tuple(r) for r in found) == brute_codes(rows, parts, 12, 2)


def test_codes_of_few_and_no_rows(vectors):
    rows = [(3, [0.5, -0.25], 1), (1, [0.125, 0.75], None)]
    assert Counter(tuple(r) for r in vector_codes.compressed(vectors(rows)).collect()) == brute_codes(rows, 16, 64, 2)
    assert vector_codes.compressed(vectors([(1, None, 1)])).collect() == []
    assert vector_codes.compressed(vectors([])).collect() == []


@pytest.mark.parametrize("width", [1, 2, 3, 4, 5, 8, 13])
def test_transform_keeps_distances_and_elimination_is_exact(width):
    rng = np.random.default_rng(width)
    parts, entries = rng.integers(-4, 5, (200, width)), rng.integers(-4, 5, (17, width))
    entries[9] = entries[2]
    left, right = vector_codes.walsh(parts), vector_codes.walsh(entries)
    size = left.shape[1]
    plain = ((parts[:, None] - entries) ** 2).sum(-1)
    assert (((left[:, None] - right) ** 2).sum(-1) == size * plain).all()
    entry, best = vector_codes.nearest(left, right)
    assert (entry == plain.argmin(1)).all() and (best == size * plain.min(1)).all()


def test_sequency_counts_sign_changes():
    changes = [int((np.diff(np.sign(row)) != 0).sum()) for row in vector_codes.walsh(np.eye(16, dtype=np.int64)).T]
    assert changes == list(range(16))


def test_floor_is_exact_for_any_size():
    values = [0.1, -0.1, -1e-300, 2.0**53 + 2, -(2.0**60), 1e200, -1.7e308]
    assert [int(x) for x in exact(np.array(values), 1024)] == scaled(values, 1024)


def brute_search(rows, every, k, scale=1024):
    kept = [(i, scaled(v, scale)) for i, v, _ in rows if usable(v)]
    queries = {(i, tuple(v)) for i, v, _ in rows if usable(v) and i is not None and i % every == 0}
    out = Counter()
    for qid, raw in queries:
        q = scaled(raw, scale)
        scores = [(max(-LONGEST, min(LONGEST, sum(a * b for a, b in zip(q, v)))), i) for i, v in kept if i != qid]
        scores.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out.update((qid, rank, i, s) for rank, (s, i) in enumerate(scores[:k], 1))
    return out


@pytest.mark.parametrize("wide", [False, True])
def test_search_equals_brute_force_over_many_cells(vectors, monkeypatch, wide):
    monkeypatch.setattr(topk_search, "CELL_QUERIES", 7)
    monkeypatch.setattr(topk_search, "CELL_CANDIDATES", 30)
    rows = odd_vectors(random.Random(3), 120, wide=wide)
    rows += [(20, [0.5] * 8, 1), (20, [-0.5] * 8, 1), (40, [0.0] * 8, 1)]  # different vectors of one id
    found = topk_search.search(vectors(rows).repartition(4), every=10, k=5).collect()
    assert Counter(tuple(r) for r in found) == brute_search(rows, 10, 5)


def test_search_without_queries_or_candidates(vectors):
    assert topk_search.search(vectors([])).collect() == []
    assert topk_search.search(vectors([(1, [1.0], 1)])).collect() == []
    assert topk_search.search(vectors([(100, [1.0], 1)])).collect() == []
    assert [tuple(r) for r in topk_search.search(vectors([(100, [1.0], 1), (7, [], 1)])).collect()] == [(100, 1, 7, 0)]


def test_best_in_small_blocks(monkeypatch):
    monkeypatch.setattr(topk_search, "_CANDIDATES", 16)
    monkeypatch.setattr(topk_search, "_QUERIES", 3)
    rng = np.random.default_rng(1)
    candidates = rng.integers(-2, 3, (100, 6)) * (rng.random((100, 6)) < 0.5)
    ids = np.sort(rng.integers(0, 80, 100))
    queries, query_ids = candidates[::9], ids[::9]
    q, c, s = topk_search.best(query_ids, queries, ids, np.ones(100, bool), candidates, 4)
    for n in range(len(queries)):
        want = sorted((-int(queries[n] @ candidates[j]), j) for j in range(100) if ids[j] != query_ids[n])[:4]
        assert [(-int(b), int(a)) for a, b in zip(c[q == n], s[q == n])] == want


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_audit(rows, least, top):
    counts, docs, groups = defaultdict(Counter), Counter(), set()
    for lang, source, text in rows:
        words = TERM.findall((text or "").translate(LOWER))
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(words)
        docs.update((lang or "", w) for w in set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        terms = sorted(w for (own, w), n in docs.items() if own == lang and n >= least)
        sources = sorted(s for own, s in groups if own == lang)

        def shares(n):
            total = sum(n[t] for t in terms)
            return {t: 1 + 10**9 * (n[t] + 5) // (total + 5 * len(terms)) for t in terms}

        own = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted(((sum(abs(own[s][t] - own[o][t]) for t in terms), o) for o in sources if o != s), key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, s, "pair", o, v, r) for r, (v, o) in enumerate(pairs, 1)}
            leads = [(own[s][t] - whole[t], t) for t in terms if counts[lang, s][t] > 0 and own[s][t] > whole[t]]
            leads = sorted(leads, key=lambda x: (-x[0], x[1].encode()))[:top]
            out |= {(lang, s, "term", t, v, r) for r, (v, t) in enumerate(leads, 1)}
    return out


def audited(spark, texts, **how):
    df = spark.createDataFrame(texts, "lang string, source string, text string").repartition(3)
    df = df.withColumns({c: F.lit("clash") for c in ["term", "n", "docs", "c", "r", "x", "place", "name", "item", "rank"]})
    found = [tuple(r) for r in source_audit.audit(df, **how).collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("tile", [(2, 4), (128, 1 << 13)])
def test_audit_equals_brute_force(spark, tile):
    rng = random.Random(11)
    rows = []
    for lang, n in (("en", 7), ("de", 3), (None, 2), ("solo", 1)):
        for s in range(n):
            pool = rng.sample(range(60), 25)
            texts = [" ".join(f"{chr(97 + w % 26) * (1 + w // 26)}é" for w in rng.choices(pool, k=rng.randrange(1, 40))) for _ in range(6)]
            rows += [(lang, f"s{s}" if s else None, t) for t in texts]
    rows += [("en", "empty", None), ("en", "empty", ""), ("en", "junk", "1 2 3 ... \n\t"), ("rare", "a", "only once"), ("rare", "b", "never twice")]
    rows += [("en", "UPPER", "Word WORD wÖrd WÖRD Émile émile"), ("en", "Ω", "Ω ß x y z " * 3000)] * 3
    rows += [rows[0]] * 4
    assert audited(spark, rows, least_docs=3, top=6, rows=tile[0], columns=tile[1]) == brute_audit(rows, 3, 6)


def test_audit_of_nothing(spark):
    assert audited(spark, []) == set()
    assert audited(spark, [(None, None, None)]) == set()
    assert audited(spark, [("a", "x", "one"), ("a", "y", None)]) == {("a", "x", "pair", "y", 0, 1), ("a", "y", "pair", "x", 0, 1)}


@pytest.mark.parametrize("height, width, density", [(1, 1, 1.0), (3, 30, 0.2), (20, 100, 0.05), (17, 9, 0.9), (40, 257, 0.01), (5, 0, 0.0), (0, 3, 0.0)])
def test_joint_walk_of_quadtrees(height, width, density):
    rng = np.random.default_rng(height * 1000 + width)

    def tree(rows):
        held = rng.random((rows, width)) < density
        zero = rng.integers(1, 50, rows)
        dense = np.where(held, rng.integers(1, 1000, (rows, width)), zero[:, None])
        at = np.nonzero(held)
        return source_audit.Quadtree(at[0], at[1], dense[at], zero, width), dense

    (a, x), (b, y) = tree(height), tree(height // 2 + 1)
    assert (source_audit.differences(a, b) == np.abs(x[:, None] - y[None]).sum(-1)).all()
    upper = np.triu(np.ones((height, height), bool), 1)
    assert (source_audit.differences(a, a)[upper] == np.abs(x[:, None] - x[None]).sum(-1)[upper]).all()


def test_large_counts_have_exact_shares(spark):
    rows = [(10**13, 3 * 10**14, 10**6), (0, 0, 0), (7, 8, 3)]
    df = spark.createDataFrame(rows, "n long, total long, kept long").select("n", "total", "kept", source_audit._share(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    for n, total, kept, p in df.collect():
        assert p == 1 + 10**9 * (n + 5) // max(1, total + 5 * kept)


def test_unusable_vectors_are_left_out(vectors):
    rows = [(1, [1.0, None], 1), (2, [NAN], 1), (3, [-INF], 1), (4, None, 1), (5, [], 1), (None, [2.0], 1)]
    assert sorted(str(r.id) for r in finite(vectors(rows), "vec_id", "embedding").collect()) == ["5", "None"]
