"""Quality, url and license operators, and benchmark passages."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from almanac.llm import decontaminate, license_scan, quality_rules, quality_trees, url_rules
from tests.llm.conftest import EDGES, words


@pytest.fixture
def labelled(make, spark):
    rng = random.Random(8)
    texts, labels = [], []
    for i in range(240):
        good = i % 3 > 0
        text = words(rng, rng.randrange(60, 200))
        texts.append(text if good else " ".join(w + rng.choice(["###", "%%%"]) for w in text.split()))
        labels.append((i, int(good)))
    marks = spark.createDataFrame(labels + [(5, 1), (None, 1), (7, None)], "doc_id long, quality int")
    return make(texts + [(1000 + i, t) for i, t in enumerate(EDGES)] + [(None, None), (3, texts[3])]), marks, dict(labels)


def test_trees_on_held_out_rows(labelled):
    docs, marks, truth = labelled
    got = quality_trees.classified(docs, marks).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert not next(r for r in got if r.doc_id is None).held_out
    # Held-out labels do not matter.
    flipped = marks.withColumn("quality", F.when(quality_trees.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(str, quality_trees.classified(docs, flipped).collect())) == sorted(map(str, got))
    kept = quality_trees.accepted(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)


def test_trees_without_labels_or_rows(labelled):
    docs, marks, _ = labelled
    assert {r.score for r in quality_trees.classified(docs, marks.limit(0)).collect()} == {0.5}
    assert quality_trees.classified(docs.limit(0), marks).count() == 0


def plain_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    times = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines, seen, repeated = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered)


def test_rules_and_model(labelled, corpus, make):
    docs, marks, truth = labelled
    model = quality_rules.train(docs, marks)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = quality_rules.judged(make(corpus), model).collect()
    for r in got:
        want = plain_counts(corpus[r.doc_id])
        assert tuple(r[n] for n in names) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed and r.probability >= 0.5)
    judged = {r.doc_id: r for r in quality_rules.judged(docs, model).collect()}
    assert sum((judged[i].probability >= 0.5) == bool(q) for i, q in truth.items()) / len(truth) > 0.95
    none = quality_rules.train(docs, marks.limit(0))
    assert {r.probability for r in quality_rules.judged(docs, none).collect()} == {0.5}
    assert quality_rules.judged(docs.limit(0), model).count() == 0


def against_sql(got: pd.DataFrame, sql: str, **tables):
    connection = duckdb.connect()
    for name, frame in tables.items():
        connection.register(name, frame)
    want = connection.execute(sql).df()
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    norm = lambda f: sorted(map(str, f[order].astype(object).where(f[order].notna(), None).values.tolist()))
    clean = lambda rows: [re.sub(r"(\d+)\.0\b", r"\1", r) for r in rows]
    assert clean(norm(got)) == clean(norm(want))


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/1", "http://example.net", "https://a.example.net/en", "http://x.org/fr/1?q#f",
    "http://org/fr/", "http://forg/fr/", "http://example.com/de/", "http://m.example.com/de/9#x", "http://cheap-pills.example.com/en/1",
    "http://www.SPAM-FARM.example.org/fr/2", "http://spam-farm.example.org/en/2", "http://a.com/cart/checkout", "x://y://z/p", "http://h?x/en/", "http://ok.example.com/en/1",
]


def test_url_verdicts(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(3, URLS[4]), (None, URLS[4])], "page_id long, url string").withColumns({"host": F.lit("a"), "rule": F.lit(1), "_low": F.lit(2), "html": F.lit("")})
    got = url_rules.verdicts(pages).toPandas()
    against_sql(got, url_rules.verdicts_sql(), pages=pages.toPandas())
    by = {URLS[int(i)]: r for i, r in zip(got.page_id.fillna(0), got.to_dict("records"))}
    assert by["https://a.example.net/en"]["rule"] == "net/" and by["http://www.SPAM-FARM.example.org/fr/2"]["verdict"] == "allow"
    assert by["http://spam-farm.example.org/en/2"]["verdict"] == "block" and by["http://ok.example.com/en/1"]["verdict"] == "allow"
    assert url_rules.verdicts(pages.limit(0)).count() == 0


def test_url_rules_are_indexed_by_their_rarest_token(spark):
    pages = spark.createDataFrame([(i, "http://casino-x.com/win") for i in range(3)] + [(9, "http://bonus.com")], "page_id long, url string")
    rules = [url_rules.PatternRule("a", ("casino", "bonus"), "x"), url_rules.PatternRule("b", ("casino",), "y")]
    assert url_rules.rarest(pages, rules) == {"bonus": [0], "casino": [1]}


def test_url_rules_match_with_letters_put_before_and_after(spark):
    texts = ["cheap-pills.", "online-pharmacy", "casino-win.", "casino-bonus", "free-bets.", "sports-bets", "ads-track.", "click-tracker", "spam-farm.", "link-farm", "adult-x.", "adult-videos", "keygen-download", "download/keygen"]
    ends = [("", ""), ("x", ""), ("", "s"), ("back", "er"), ("a.", "com"), ("7", "7")]
    urls = [f"http://{a}{t}{b}.com/{u}" for t in texts for a, b in ends for u in ("", f"{a}{t}{b}")] + [f"http://a.com/{t}" for t in texts] + [f"http://a.com{a}/cart/checkout{b}" for a, b in ends]
    # Tokens of the spam hosts are made common, so that other tokens of the rules are the rarest.
    for common in ([], ["http://spam-farm.com/farm"] * 300, ["http://link.com/link"] * 300):
        pages = spark.createDataFrame(list(enumerate(urls + common)), "page_id long, url string")
        got = url_rules.verdicts(pages).toPandas()
        against_sql(got, url_rules.verdicts_sql(), pages=pages.toPandas())
        # Rules name whole words: letters or digits on either side make another word.
        by = dict(zip(urls, got.sort_values("page_id").patterns))
        assert by["http://link-farm.com/"] == "links" and by["http://a.com/cart/checkout"] == "cart" and by["http://a.com/online-pharmacy"] == ""
        assert by["http://backlink-farmer.com/"] == "" and by["http://7casino-bonus7.com/"] == "" and by["http://a.casino-bonuscom.com/"] == ""
    assert "" not in url_rules.rarest(pages, url_rules.PATTERN_RULES)


def test_license_scan(make):
    texts = [
        *EDGES, "The MIT License, the mit-license and MIT\nLICENSE.", "Released under the MIT License.", "GNU General Public License", "Apache  license apache LICENSE",
        "all rights\nreserved", "All rights, reserved!", "licensed under the apache license version 2", "licensed under the apache license", "Licensed under CC BY-NC 4.0.", "x" * 70000 + " mit license",
    ]
    docs = make(texts)
    got = license_scan.scan(docs)
    against_sql(got.toPandas(), license_scan.scan_sql(), documents=docs.select("doc_id", "text").toPandas())
    rows = {texts[r.doc_id]: r for r in got.collect()}
    assert rows[texts[9]].n_base == 3 and rows["licensed under the apache license version 2"].labels == "apache"
    assert rows["all rights\nreserved"].labels == "" and rows["All rights, reserved!"].labels == "reserved"
    assert license_scan.scan(docs.limit(0)).count() == 0 and license_scan.scan(make([(1, "mit license"), (1, "mit license")])).count() == 2


def test_license_join_equals_counting_every_template():
    rng = random.Random(4)
    pool = [f"t{i}".encode() for i in range(30)]
    templates = [(str(i), frozenset(rng.sample(pool, rng.randrange(1, 9)))) for i in range(40)]
    join = license_scan.Join(templates, {w: rng.randrange(50) for w in pool})
    for _ in range(300):
        line = [rng.choice(pool) for _ in range(rng.randrange(0, 25))]
        want = {(i, len(t & set(line)) / len(t)) for i, (_, t) in enumerate(templates) if len(t & set(line)) >= license_scan.needed(t)}
        assert set(join.line(line)) == want


def edit(text: str, rng: random.Random, n: int) -> str:
    for _ in range(n):
        at = rng.randrange(5, len(text) - 5)
        text = rng.choice([text[:at] + "q" + text[at + 1 :], text[:at] + text[at + 1 :], text[:at] + "z" + text[at:]])
    return text


def test_benchmark_passages(make, spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, words(rng, rng.randrange(14, 60))) for i in range(12)]
    bench = spark.createDataFrame(items + [(3, items[3][1]), (90, None), (91, ""), (92, "too short")], "item_id long, text string")
    clean = [words(rng, 200) for _ in range(20)]
    leaks = [f"{words(rng, 20)} {t.upper() if i % 2 else t} {words(rng, 20)}" for i, t in items]
    edited = [f"{words(rng, 20)} {edit(t, rng, 3)} {words(rng, 20)}" for _, t in items[:6]]
    docs = make(clean + [(100 + i, t) for i, t in enumerate(leaks)] + [(200 + i, t) for i, t in enumerate(edited)] + [(300 + i, t) for i, t in enumerate(EDGES)] + [(None, leaks[0])])
    for block in (decontaminate.BLOCK_BYTES, 600):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, bench).collect()}
        want = {(100 + i, i) for i in range(12)} | {(200 + i, i) for i in range(6)} | {(None, 0)}
        assert set(got) == want
        assert all(r.edits == 0 and leaks[r.doc_id - 100][r.start : r.start + r.length].lower() == items[r.item_id][1] for k, r in got.items() if k[0] and k[0] < 200)
        kept = decontaminate.clean_of(docs, bench)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(20)) | set(range(300, 300 + len(EDGES)))
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_excerpts_from_any_place_and_wrapped_ones_are_found(make, spark):
    rng = random.Random(16)
    item = words(rng, 60)[:300].strip()
    middle = words(rng, 40)[:130].strip()
    bench = spark.createDataFrame([(1, item), (2, middle)], "item_id long, text string")
    places = range(0, len(item) - 115)
    docs = [f"{words(rng, 9)}| {item[at : at + 115]} |{words(rng, 9)}" for at in places] + [f"é {words(rng, 9)} {middle[12:120]} {words(rng, 9)}", "é  x\n" + item.replace(" ", " \n    ") + "  y"]
    got = {r.doc_id: r for r in decontaminate.contaminated(make(docs), bench).collect()}
    assert set(got) == set(range(len(docs)))
    last = got[len(docs) - 1]
    assert docs[-1][last.start : last.start + last.length] == item.replace(" ", " \n    ") and last.edits == 0
    assert decontaminate.clean_of(make(docs), bench).count() == 0


def test_edit_distance_and_monotonous_text(monkeypatch):
    assert decontaminate.edit_distance(b"abcdef", b"xxabcdefyy", 0) == (0, 8)
    assert decontaminate.edit_distance(b"abcdef", b"xxabXdefyy", 1) == (1, 8)
    assert decontaminate.edit_distance(b"abcdef", b"zzzzzzzzzz", 3) is None
    monkeypatch.setattr(decontaminate, "_POSTINGS", 1000)
    found = decontaminate.index([(1, b"a" * 60)])
    assert decontaminate.matches(b"b" * 500 + b"a" * 80 + b"b" * 5000, found) and not decontaminate.matches(b"b" * 5000, found)
