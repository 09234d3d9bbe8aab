"""Main text of pages, packing, and the pipeline."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from almanac.llm import decontaminate, html_template, packing, quality_trees
from almanac.llm.queries import ORACLE, QUERIES
from tests.llm.conftest import EDGES, words

PATH = public_tokenizers.path("word_bpe_49k.json")
ARTICLE = """<!doctype html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header>Site</header>
<nav><ul><li><a href="/a>b">menu</a></ul></nav><div class="ad">Buy</div><!-- x --><article><header><h1>A &amp; B&nbsp;C</h1></header><p><b>One<br>
two</b> three<p>Fo<i>ur</i> <span class="ad">buy</span>five<form>f<input></form><ul><li>i<li>j</ul><aside>no</aside></article>
<div id="comments"><p>nice</div><footer>foot</footer></body></html>"""


def text_of(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "text", "tokens", "page")})
    return {r.page_id: r.text for r in html_template.main_text(df).collect()}


def test_article(spark):
    pages = [(1, "http://a.com/1", ARTICLE), (2, None, ARTICLE), (3, "http://a.com/2", None), (4, "x", ""), (5, "x", "just text"), (6, "http://a.com/1", "<article><h1>cut</h1><p>of &am"), (7, "x", "<article><p>a</p><p <b"), (7, "x", "<article><p>a</p><p <b")]
    got = text_of(spark, pages)
    assert got[1] == got[2] == "A & B C\n\nOne two three\n\nFour five\n\ni\n\nj"
    assert (got[3], got[4], got[5], got[6], got[7]) == ("", "", "just text", "cut\n\nof &am", "a")
    assert html_template.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_text_of_a_host_is_left_out(spark):
    page = "<html><body><div><p>Welcome to our site</p><p>{}</p><p>{}</p><p>Find us in town</p></div></body></html>"
    rng = random.Random(2)
    own = [(words(rng, 12), words(rng, 9)) for _ in range(6)]
    pages = [(i, f"http://h.com/{i}", page.format(*t)) for i, t in enumerate(own)]
    got = text_of(spark, pages + [(10, "http://one.com/", page.format(*own[0]))] + [(20 + i, "http://copies.com", page.format(*own[0])) for i in range(4)])
    assert all(got[i] == "\n\n".join(t) for i, t in enumerate(own))
    # Too few pages, or copies of one page, are no template.
    assert got[10].startswith("Welcome") and got[20].startswith("Welcome")


def test_names_inside_an_article_are_not_taken_by_single_words(spark):
    page = """<body><div id="sidebar">side</div><article><h2 id="how-to-subscribe">How to subscribe</h2><section id="related-work"><h2 class="search-title">Related work</h2><p>Others {0}</p></section>
<div id="search-algorithms"><p>Algorithms {0}</p></div><section id="search">Search {0}</section><div class="skip-lists">Lists {0}</div><div class="notice-text">Read our terms</div>
<div class="related-posts"><p>more {0}</p></div><div class="ad">buy</div><div id="comments">nice {0}</div></article></body>"""
    rng = random.Random(3)
    own = [words(rng, 5) for _ in range(4)]
    got = text_of(spark, [(i, f"http://h.com/{i}", page.format(w)) for i, w in enumerate(own)] + [(9, "http://one.com", page.format("x"))])
    want = "How to subscribe\n\nRelated work\n\nOthers {0}\n\nAlgorithms {0}\n\nSearch {0}\n\nLists {0}"
    # The title is on every page of the host, in an element that the list names in part.
    assert all(got[i] == want.replace("Related work\n\n", "").format(w) for i, w in enumerate(own))
    assert got[9] == want.format("x") + "\n\nRead our terms"


def test_deep_and_long_pages_are_parsed():
    assert len(html_template.parse("<div>" * 3000 + "x" + "<p>y" * 2000).blocks) == 2001
    assert html_template.parse("<a href='" + "b" * 100000).blocks == []


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_tokenizers(tokenizer, corpus):
    odd = ["don't DON'T it's,x''s", "a<|endoftext|>b <|startoftext|>", "x\u00a0y\u2003z\r\n\t q", "e\u0301 E\u0301 \u0301x", "Straße İstanbul ΣΑΣ", "1234,567!!! ...?", "naïve,co-op;x:y", "日本 語", "\U0001f600 ok!", "a" * 300 + ", B" * 3]
    for t in [*corpus, *odd]:
        want = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(packing.token_ids(t, PATH), "<u4").tolist() == want, t
        assert np.frombuffer(packing.token_ids(t, PATH), "<u4").tolist() == want


def test_packing_is_a_round_trip(make, tokenizer, corpus, monkeypatch):
    monkeypatch.setattr(packing, "LOT", 20)
    docs = make(corpus + [(1, corpus[1]), (None, None), (77777, words(random.Random(1), 3000))])
    got = packing.pack(packing.pieces(docs, PATH, limit=512), limit=512, lot=20).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for key, own in got[got.doc_id.notna() & (got.doc_id != 1)].groupby("doc_id"):
        own = own.sort_values("piece")
        ids = np.array([*tokenizer.encode(texts[int(key)] or "", add_special_tokens=False).ids, 1], "<u4")
        assert own["piece"].tolist() == list(range(-(-len(ids) // 512))) and own["length"].sum() == len(ids)
        for r in own.itertuples():
            assert r.start == 512 * r.piece and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert (got.doc_id == 1).sum() == 2 * (got[got.doc_id == 1].piece.max() + 1) and got.doc_id.isna().sum() == 1
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 512
    assert packing.pack(packing.pieces(docs.limit(0), PATH)).count() == 0


def plain_sum_of_squares(lengths, limit):
    """Every choice tried, with the sum of squares counted anew."""
    gaps, bins = [], []
    square = lambda g: sum(n * n for n in np.bincount([x for x in g if x], minlength=1).tolist())
    for size in sorted(lengths, reverse=True):
        options = [(square([*gaps[:i], g - size, *gaps[i + 1 :]]), g, i) for i, g in enumerate(gaps) if g >= size]
        fresh = square([*gaps, limit - size])
        if options and min(options)[0] <= fresh:
            i = min(options)[2]
            gaps[i] -= size
        else:
            i = len(gaps)
            gaps.append(limit - size)
        bins.append(i)
    return sorted(gaps)


def test_sum_of_squares_takes_the_best_place():
    rng = random.Random(9)
    for limit in (7, 20):
        lengths = [rng.randrange(1, limit + 1) for _ in range(60)]
        bins, offsets = packing.sum_of_squares(np.array(lengths), limit)
        used = np.bincount(bins, lengths)
        assert sorted((limit - used).astype(int).tolist()) == plain_sum_of_squares(lengths, limit)


def test_few_sequences():
    lengths = np.random.default_rng(3).integers(1, 2000, 4000)
    bins, _ = packing.sum_of_squares(lengths)
    assert bins.max() + 1 <= 1.005 * -(-lengths.sum() // 4096) + 1


def test_pipeline_stages_do_what_they_say(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], small).cache())
    assert all(t.columns == docs.columns for t in tables[:-1])
    accepted = {r.doc_id for r in quality_trees.classified(docs, spark.read.parquet(f"{small}/labels.parquet")).collect() if r.predicted}
    assert {r.doc_id for r in tables[1].collect()} == accepted
    texts = [r.text for r in tables[2].collect()]
    assert len(set(texts)) == len(texts) and tables[2].select("doc_id").distinct().count() == tables[2].count()
    assert decontaminate.contaminated(tables[4], bench).count() == 0
    assert {r.doc_id for r in tables[5].select("doc_id").collect()} == {r.doc_id for r in tables[4].collect()}
    want = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in tables[5].collect())
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, small).collect()) == want
    for t in tables[1:]:
        t.unpersist()


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_empty_and_odd_tables(spark, small, make, stage):
    function = corpus_pipeline.STAGES[stage][1]
    odd = make([*EDGES, (None, None), (1, ""), (1, "")])
    assert function(spark, odd.limit(0), small).count() == 0
    out = function(spark, odd, small)
    rows, before = [r.asDict() for r in out.collect()], [r.asDict() for r in odd.collect()]
    if stage == 4:
        # Every row is packed from its start, and its pieces follow each other.
        assert sum(r["start"] == 0 for r in rows) == len(before) and {r["doc_id"] for r in rows} == {r["doc_id"] for r in before}
        return
    assert out.columns == odd.columns and all(r in before for r in rows)
    texts = [r["text"] for r in rows]
    if stage == 1:
        # One of each group: nothing twice, and no group lost.
        blank = lambda t: not (t or "").strip(" \t\n\r\v\f")
        assert sorted(t for t in texts if not blank(t)) == sorted({r["text"] for r in before if not blank(r["text"])})
        assert sum(map(blank, texts)) >= 1
    if stage in (2, 3):
        # None of these holds a repeated passage or one of the benchmark.
        assert len(rows) == len(before)


def test_pipeline_leaves_its_last_stage_only(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "new_path", lambda _, name: str(tmp_path / name))
    assert corpus_pipeline.run(spark, small).count() > 0
    assert [f.name for f in tmp_path.iterdir() if not f.name.startswith(".")] == ["pipeline-best_fit_packing"]


def test_registered_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)


def test_most_tokens_in_a_common_order():
    assert html_template.common_order([1, 2, 3, 4, 5], [1, 4, 2, 3, 5]) == [1, 2, 3, 5]
    assert html_template.common_order([1, 2], []) == [] and html_template.common_order([3, 1], [1, 3]) in ([1], [3])


def deduced(spark, sources):
    """The text tokens of the template of one host, as texts."""
    df = spark.createDataFrame([(i, "a.org", s) for i, s in enumerate(sources)], "page long, host string, html string")
    known = {html_template.token_hash(t): t[2] for s in sources for t in html_template.parse(s).tokens if t[0] == "text"}
    return sorted(known[t] for r in html_template.templates(df).collect() for t in r.text_tokens)


def test_template_tokens_keep_one_order(spark):
    page = "<body><h1>Top</h1><h5>Motto</h5>{}<h2>Low</h2></body>"
    first, second = "<h3>Moves</h3><p>own {0}</p>", "<p>own {0}</p>"
    assert deduced(spark, [page.format(first.format(i)) for i in range(5)]) == ["Low", "Motto", "Moves", "Top"]
    # On the last page the text, with its element, stands above the heading.
    odd = "<body><h3>Moves</h3><h1>Top</h1><h5>Motto</h5>" + second.format(4) + "<h2>Low</h2></body>"
    assert deduced(spark, [page.format(first.format(i)) for i in range(4)] + [odd]) == ["Low", "Motto", "Top"]


def test_template_classes_nest(spark):
    rows = lambda n: "<li>Buy</li>" * n
    page = "<body><h1>Top</h1><ul>{}</ul><h2>Low</h2><ol>{}</ol><h4>End</h4></body>"
    # Rows occur differently often, but always in one gap; then they are in it on some pages only.
    assert "Buy" in deduced(spark, [page.format(rows(n), "") for n in (1, 2, 3, 4)])
    far = "<body><h1>Top</h1>{}<h2>Low</h2>{}<h4>End</h4></body>"
    assert deduced(spark, [far.format(rows(n), "") for n in (1, 2, 3)] + [far.format("", rows(2))]) == ["End", "Low", "Top"]
