"""Near and exact repeats against brute force."""

from __future__ import annotations

import random
import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from almanac.llm import anchors, graph, passages, repeats, rows, simhash
from tests.llm.conftest import words


def plain_fingerprint(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, near):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in combinations(nodes, 2):
        if near(a, b):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (0, 1), (-5, -9)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {-5: -9, -9: -9}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("cell", [16, 1])
def test_simhash_equals_brute_force(make, corpus, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)  # 1: every shared cell goes the way of crowded ones
    ids = list(range(1, len(corpus) + 1))
    docs = make(list(zip(ids, corpus)) + [(2, corpus[1]), (None, corpus[0])])
    got = simhash.near_duplicates(docs).collect()
    prints = [plain_fingerprint(t) for t in corpus]
    roots = plain_components(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 2)
    smallest = {}
    for i, f in zip(ids, prints):
        smallest[roots[f]] = min(smallest.get(roots[f], i), i)
    assert len(got) == len(corpus) + 2
    for r in got:
        f = prints[r.doc_id - 1] if r.doc_id else prints[0]
        assert r.fp & (1 << 64) - 1 == f and r.component_id == smallest[roots[f]]


def test_links_find_all_pairs_within_two_bits(spark):
    rng = random.Random(1)
    codes = {rng.getrandbits(64) for _ in range(60)}
    for c in list(codes)[:30]:
        codes |= {c ^ 1 << rng.randrange(64), c ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64), c ^ 7 << rng.randrange(60)}
    signed = {c: c - (1 << 64) if c >> 63 else c for c in codes}
    table = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    found = {r.node: r.root for r in graph.components(simhash.links(table)).collect()}
    want = plain_components(sorted(signed.values()), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert {n: found.get(n, n) for n in want} == want


def test_one_of_each_group_stays(make):
    docs = make([(3, "a b c d e"), (1, "a b c d e"), (2, "f g h i j k"), (2, "f g h i j k"), (None, None), (None, None)])
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2]
    assert simhash.one_per_group(docs.limit(0)).count() == 0


def test_long_texts_in_stretches():
    text = words(random.Random(3), 5000).encode()
    assert [w for c in rows.word_chunks(text, 100) for w in c] == text.split()
    assert simhash.fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text.decode())


def plain_repeats(texts, least):
    """Per text: covered bytes, each judged against all that starts earlier."""
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        mask = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if b[i : i + least] in seen:
                mask[i : i + least] = b"\1" * least
            seen.add(b[i : i + least])
        out.append((b, mask))
    return out


@pytest.mark.parametrize("crowd", [256, 2])
def test_repeats_equal_brute_force(make, corpus, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    texts = [*corpus, "ab" * 300, "ab" * 200 + corpus[0], "=" * 150, "=" * 99, corpus[0] + corpus[0]]
    got = {r.doc_id: r for r in repeats.without_repeats(make(texts + [(0, texts[0])])).collect()}
    for i, (data, mask) in enumerate(plain_repeats(texts, 100)):
        kept = bytes(x for x, m in zip(data, mask) if not m)
        spans = sum(1 for k, m in enumerate(mask) if m and not (k and mask[k - 1]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(data), sum(mask), spans, kept), texts[i]


def test_repeats_of_rows_without_id_and_of_no_rows(make, corpus):
    docs = make([(None, corpus[0]), (9, corpus[0])])
    got = {r.doc_id: r.n_removed for r in repeats.without_repeats(docs).collect()}
    assert got == {9: 0, None: len(corpus[0].encode())}
    assert repeats.without_repeats(docs.limit(0)).count() == 0


def test_maximal_groups_of_one_anchor():
    snippets = [(b"ab" * 20, b"c" * 60), (b"ab" * 20 + b"x", b"c" * 60 + b"d"), (b"ab" * 10 + b"y", b"c" * 60 + b"e"), (b"z", b"q")]
    found = {(left, right, tuple(sorted(m))) for left, right, m in repeats.groups(snippets, 100)}
    assert (40, 60, (0, 1)) in found and (20, 60, (0, 1, 2)) in found
    assert all(left + right >= 68 for left, right, _ in found)


def test_anchors_cover_every_window(monkeypatch):
    monkeypatch.setattr(anchors, "_STRETCH", 128)
    data = words(random.Random(2), 300).encode()
    h, place, first, last = anchors.anchors(data, 100)
    assert [w for a, b in zip(first, last) for w in range(a, b + 1)] == list(range(len(data) - 99))
    assert all(a >= b - 68 and b <= p <= a + 68 for p, a, b in zip(place, first, last))


def tree_windows(ranks):
    """Windows of all nodes of the Cartesian tree, by the definition."""
    out = []
    for i, r in enumerate(ranks):
        a = b = i
        while a and ranks[a - 1] > r:
            a -= 1
        while b + 1 < len(ranks) and ranks[b + 1] > r:
            b += 1
        out.append((i, a, b))
    return out


def test_wide_tree_nodes_are_the_sliding_minima():
    least, shingles = 8, np.random.default_rng(0).integers(0, 1 << 62, 200).astype(np.uint64)
    _, ranks = passages._ranks(shingles, 1)
    found = list(zip(*(x.tolist() for x in passages.compact_windows(passages.sliding_minimum(ranks, least), least))))
    wide = [(c, max(a, c - least + 1), min(b, c + least - 1)) for c, a, b in tree_windows(ranks.tolist()) if b - a + 1 >= least]
    assert found == wide


@pytest.mark.parametrize("few", [4, 1])
def test_passages_hold_planted_ones_and_leave_others(make, corpus, monkeypatch, few):
    monkeypatch.setattr(passages, "FEW", few)
    found = passages.near_passages(make(corpus)).collect()
    shingles = [set(zip(*[(t or "").lower().split()[k:] for k in range(5)])) for t in corpus]
    late = {b for a, b in combinations(range(len(corpus)), 2) if len(shingles[b]) >= 46 and shingles[a] & shingles[b] and len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b]) >= 0.8}
    assert late | set(range(42, 53)) <= {r.doc_id for r in found}
    for r in found:
        y, x = (corpus[i].lower().split() for i in (r.doc_id, r.source_id))
        y, x = y[r.start_word : r.start_word + r.n_words], x[r.source_start : r.source_start + r.source_words]
        a, b = set(zip(*[y[k:] for k in range(5)])), set(zip(*[x[k:] for k in range(5)]))
        assert r.source_id < r.doc_id and r.n_words >= 50 and len(a & b) / len(a | b) >= 0.75 and r.similarity >= 0.8
    assert passages.near_passages(make(corpus).limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [256, 2])
def test_short_passage_in_a_thousand_documents(make, monkeypatch, crowd):
    monkeypatch.setattr(passages, "CROWD", crowd)
    rng = random.Random(12)
    passage = words(rng, 50)
    corpus = [f"{words(rng, 60)} {passage} {words(rng, 60)}" for _ in range(1000)]
    found = {r.doc_id for r in passages.near_passages(make(corpus)).collect() if r.start_word <= 60 and r.start_word + r.n_words >= 110}
    assert found == set(range(1, 1000))


@pytest.mark.parametrize("few", [4, 1])
def test_monotonous_passages(make, monkeypatch, few):
    monkeypatch.setattr(passages, "FEW", few)
    rng = random.Random(9)
    texts = [f"{words(rng, 20 + 7 * i)} {' '.join(['the'] * (55 + 60 * (i % 3)))} {words(rng, 40)}" for i in range(9)]
    two = [f"{words(rng, 30)} {'to ' * 30}{'be ' * 30}{words(rng, 31 + i)}" for i in range(2)]
    line = words(rng, 18)
    lines = [f"{words(rng, 25 + i)} {' '.join([line] * 4)} {words(rng, 40)}" for i in range(3)]
    only_once = [f"{words(rng, 40)} {'the ' * 6}{words(rng, 40)}"]
    corpus = texts + two + lines + only_once
    masks = {}
    for r in passages.near_passages(make(corpus)).collect():
        assert r.source_id < r.doc_id and r.source_words >= 41
        masks.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    seen = set()
    for i, t in enumerate(corpus):
        grams = list(zip(*[t.split()[k:] for k in range(50)]))
        repeated = {p for j, g in enumerate(grams) if g in seen for p in range(j, j + 50)}
        seen |= set(grams)
        assert repeated <= masks.get(i, set()) and (repeated or i not in masks), i


def test_tokens_held_several_times_are_tried_on_every_diagonal():
    rng = np.random.default_rng(4)
    a, b, c, junk = (rng.integers(0, 1 << 60, n).astype(np.uint64) for n in (20, 20, 20, 200))
    # The front is led astray by a first copy of a, the back by a last copy of c.
    x = np.concatenate([a, junk[:60], a, b, c, junk[60:120], c])
    y = np.concatenate([a, b, c])
    assert passages.verified(y, x) == [(0, 59, 80, 139, 1.0)]
    # A passage that is found does not hide another one.
    other = rng.integers(0, 1 << 60, 60).astype(np.uint64)
    found = passages.verified(np.concatenate([other, junk[120:180], y]), np.concatenate([x, junk[:60], other]))
    assert {(f[0], f[1]) for f in found} == {(0, 59), (120, 179)}


def decoyed(rng):
    """Texts, and pairs of texts with one passage, parts of which many others hold."""
    corpus, late = [], []
    for _ in range(25):
        passage = words(rng, 60, 100_000).split()

        def decoy():
            first = rng.randrange(0, 31)
            own = words(rng, 60, 100_000).split()
            return " ".join([*own[:first], *passage[first : first + 30], *own[first + 30 :], *words(rng, 20, 100_000).split()])

        corpus += [decoy() for _ in range(15)] + [f"{words(rng, 30, 100_000)} {' '.join(passage)}"] + [decoy() for _ in range(15)]
        late.append((len(corpus), len(corpus) - 16))
        corpus.append(f"{' '.join(passage)} {words(rng, 30, 100_000)}")
    return corpus, late


def test_no_partner_is_lost_in_groups_of_decoys(make):
    corpus, late = decoyed(random.Random(21))
    found = {(r.doc_id, r.source_id) for r in passages.near_passages(make(corpus)).collect() if r.n_words >= 60}
    assert set(late) <= found


def test_passages_among_decoys_are_cut(make):
    corpus, late = decoyed(random.Random(21))
    kept = {r.doc_id: r.text for r in passages.without_passages(make(corpus)).collect()}
    assert not [y for y, _ in late if " ".join(corpus[y].split()[:60]) in kept[y]]


def test_words_beside_a_linked_passage_are_found_and_cut(make):
    rng = random.Random(31)
    unique = lambda n: words(rng, n, 100_000)
    corpus, late = [], []
    for _ in range(6):
        passage, tail = unique(60), unique(5)
        corpus += [f"{unique(30)} {passage} {unique(30)}" for _ in range(12)]
        # Only this one has the tail too, behind a part of the passage that all have.
        corpus.append(f"{unique(60)} {' '.join(passage.split()[-45:])} {tail} {unique(30)}")
        corpus += [f"{unique(30)} {passage} {unique(30)}" for _ in range(12)]
        late.append((len(corpus), tail))
        corpus.append(f"{unique(20)} {passage} {tail} {unique(20)}")
    docs = make(corpus)
    spans = {}
    for r in passages.near_passages(docs).collect():
        spans.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    assert not [y for y, _ in late if not set(range(20, 85)) <= spans.get(y, set())]
    kept = {r.doc_id: r.text for r in passages.without_passages(docs).collect()}
    assert not [y for y, tail in late if set(tail.split()) & set(kept[y].split())]


def edited(rng, n):
    """Stretches of texts that are one with a few words changed, as rows of one key."""
    base = rng.integers(0, 1 << 32, 100).astype(np.uint32)
    rows = []
    for doc in range(n):
        own = base.copy()
        own[rng.integers(0, 100, 4)] = rng.integers(0, 1 << 32, 4)
        rows.append({"key": 1, "salt": 0, "closed": doc % 4 == 0, "doc": doc, "words": own.tobytes(), "free": None if doc % 4 == 0 else np.ones(96, bool).tobytes()})
    return sorted(rows, key=lambda r: (r["closed"], r["words"], r["doc"]))


def test_links_of_near_copies_grow_with_their_number_and_cover_what_all_pairs_do():
    counts = []
    for n in (60, 240):
        rows = edited(np.random.default_rng(6), n)
        batches = pa.Table.from_pylist(rows, pa.schema([(c.split()[0], t) for c, t in zip(passages._STRETCH.split(", "), (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()))])).to_batches(50)
        links = {(y, x) for b in passages._meet(iter(batches), 46) for y, x in zip(*(c.to_pylist() for c in b.columns))}
        counts.append(len(links))
        tokens = {r["doc"]: passages.shingled(np.frombuffer(r["words"], np.uint32)) for r in rows}
        cover = lambda y, xs: {p for x in xs for a, b, *_ in passages.verified(tokens[y], tokens[x]) for p in range(a, b + 1) if tokens[y][p] in tokens[x]}
        for r in (r for r in rows if not r["closed"]):
            y = r["doc"]
            assert cover(y, range(y)) <= {p for x in (x for z, x in links if z == y) for a, b, *_ in passages.verified(tokens[y], tokens[x]) for p in range(a, b + 1)}
    assert counts[1] < 8 * counts[0]


def test_words_of_many_texts_are_hashed_at_once(monkeypatch):
    monkeypatch.setattr(passages, "PIECE", 40)
    rng = random.Random(8)
    texts = ["".join(rng.choice("aBc \t\x0b\x1c\u00e4\u00a0" + "x" * k) for _ in range(rng.randrange(200))).encode() for k in (0, 3, 90) for _ in range(60)]
    hashes, counts = passages.hashed_words([*texts, None, b""])
    split = [t.lower().split() for t in texts]
    assert counts.tolist() == [len(w) for w in split] + [0, 0]
    assert hashes.tolist() == [zlib.crc32(w) for own in split for w in own]
    shingles, sizes = passages.shingled_texts(hashes, counts)
    own = [passages.shingled(passages.word_hashes(t)) for t in texts]
    assert sizes.tolist() == [len(x) for x in own] + [0, 0] and (shingles == np.concatenate(own)).all()
    assert [rows.word_count(t, 7) for t in texts] == [len(w) for w in split]


def test_rows_verified_at_once_equal_single_ones():
    rng = np.random.default_rng(12)
    tokens, sources = [], []
    for i in range(300):
        x = rng.integers(0, 1 << 60, 150).astype(np.uint64)
        y = np.concatenate([rng.integers(0, 1 << 60, 20).astype(np.uint64), x[20 : 20 + rng.integers(30, 120)]])
        changed = rng.integers(0, len(y), rng.integers(0, 30))
        y[changed] = rng.integers(0, 1 << 60, len(changed))
        if i % 3 == 0:
            y[5:9], x[100:104] = y[0], x[0]
        tokens.append(y)
        sources.append(x)
    found = sorted(passages._verified_rows(np.concatenate(tokens), np.array([len(t) for t in tokens]), sources, 46))
    assert found == sorted((i, *p) for i, (y, x) in enumerate(zip(tokens, sources)) for p in passages.verified(y, x))
    assert len({r[0] for r in found}) > 50


def test_stretches_of_many_keys_meet_in_few_calls(monkeypatch):
    calls = []
    monkeypatch.setattr(passages, "shingled", lambda w, f=passages.shingled: calls.append(1) or f(w))
    found = [r | {"key": key} for key in range(200) for r in edited(np.random.default_rng(key), 6)]
    batches = pa.Table.from_pylist(found, pa.schema([(c.split()[0], t) for c, t in zip(passages._STRETCH.split(", "), (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()))])).to_batches(50)
    links = {(y, x) for b in passages._meet(iter(batches), 46) for y, x in zip(*(c.to_pylist() for c in b.columns))}
    # One call for each stretch before.
    assert links and len(calls) < 20


def test_cut_passages(make, corpus):
    docs = make(corpus)
    kept = {r.doc_id: r.text for r in passages.without_passages(docs).collect()}
    assert all(kept[i] == corpus[i] for i in range(30))
    passage = " ".join(corpus[41].split()[30:100])
    assert passage in kept[41] and all(passage not in kept[i] for i in range(42, 53))
    assert passages.cut_words("a  b\nc d", [(1, 2)]) == "a   d" and passages.cut_words(None, []) is None
