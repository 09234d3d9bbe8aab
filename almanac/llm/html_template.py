"""Main text of web pages by deduction of the template that a host's pages share.

A page is a sequence of tokens: tags and blocks of text, told apart by their path
of open elements. Over the pages of a host each token has an occurrence vector
(how often it occurs on each page). Tokens with the same vector form an
equivalence class. Tokens that don't keep one order on all pages leave it; a class
is valid if it lies in one gap between the tokens of each valid class with fewer occurrences. Text that
belongs to a valid class is template; what stands in the gaps are the slots.
Slots whose path is a menu, header, footer, advert, form or the like are left
out; if the template has an article element, only slots inside it are the text.
Inside an article an element is left out if its class or role as a whole says so;
one that says so in part only, if its text is template too.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.rows import per_slice
from almanac.operators.joins import many_to_one
from almanac.session import stored

# Pages that share a template, at least; with fewer, nothing is deduced.
SUPPORT = 3
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|textarea|title|svg|iframe|xmp)\b[^>]*(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+(?=>|\Z)|[^>]*)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DEEP = 8  # nearest open elements that tell tokens apart
# Elements without an end tag, and elements inside a line of text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var".split()
)
# Elements, and words of class, id and role, that are not main text.
_LEFT_OUT = frozenset("nav footer aside form head menu button select option dialog object canvas audio video".split())
_LEFT_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar comment comments reply replies respond disqus "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended breadcrumb breadcrumbs menu nav navbar navigation footer masthead pagination pager search widget toolbar skip".split()
)
# Words that may stand beside these in a name that is left out as a whole, and the names of readers' comments.
_HOLDER_WORDS = frozenset("box boxes container wrapper wrap block area inner outer bar button buttons icons links list items posts panel slot unit".split())
_REPLY_WORDS = frozenset("comment comments reply replies respond disqus".split())
# Headings and sections have ids made from their text; those of other containers name them.
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NAMED_BY_ID = frozenset("div ul ol dl table".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = frozenset("ul ol table dl div article section main body blockquote".split())
_SHUTS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


@dataclass
class _Open:
    tag: str
    mark: str
    out: int  # 2: left out, 1: left out if its text is template
    inside: bool


@dataclass
class Page:
    """Tokens in order: (kind, path, value). Blocks: (token, text, left out as in ``_Open``, inside an article)."""

    tokens: list[tuple[str, str, str]] = field(default_factory=list)
    blocks: list[tuple[int, str, int, bool]] = field(default_factory=list)


def _marks(attributes: str) -> tuple[str, list[set[str]], list[set[str]], bool]:
    """Class and role as text, the words of each class and role, those of each id, and whether the element is hidden."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), value.strip("\"'"))
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", found.get("style", ""), re.I))
    names = lambda *keys: [
        {w.lower() for w in _WORD.findall(n)} for k in keys for n in found.get(k, "").split() if not n.lower().startswith(("has-", "with-", "no-"))
    ]
    return ".".join(filter(None, (found.get("class"), found.get("role")))), names("class", "role"), names("id"), hidden


def _whole(names: list[set[str]], listed: frozenset = _LEFT_OUT_WORDS) -> bool:
    """Whether a name has one of the listed words, and besides only such that are left out or say nothing."""
    return any(n & listed and all(w in _LEFT_OUT_WORDS or w in _HOLDER_WORDS or w.isdigit() for w in n) for n in names)


def _left_out(tag: str, classes: list[set[str]], ids: list[set[str]], inside: bool) -> int:
    """2 if an element is left out, 1 if it is where its text is template, else 0. An id counts only as a whole, and never on headings and sections."""
    if tag in _LEFT_OUT or tag in _NAMED_BY_ID and _whole(ids, _REPLY_WORDS if inside else _LEFT_OUT_WORDS):
        return 2
    if not any(n & _LEFT_OUT_WORDS for n in classes):
        return 0
    return 2 if not inside or tag not in _HEADINGS and _whole(classes) else 1


class _Parser:
    def __init__(self):
        self.page, self.stack, self.line, self.muted = Page(), [], [], []

    def path(self) -> str:
        return "/".join(o.mark for o in self.stack[-_DEEP:])

    def flush(self) -> None:
        """End the block of text at hand."""
        block = " ".join(html.unescape("".join(self.line)).split())
        self.line.clear()
        self.muted.clear()
        if block:
            top = self.stack[-1] if self.stack else _Open("", "", 0, False)
            self.page.tokens.append(("text", self.path(), block))
            self.page.blocks.append((len(self.page.tokens) - 1, block, top.out, top.inside))

    def close(self, count: int) -> None:
        self.flush()
        for _ in range(count):
            self.page.tokens.append(("end", self.path(), self.stack.pop().tag))

    def depth(self, tags) -> int:
        """How many elements end with the nearest open one of these tags; 0 without one."""
        return next((i for i, o in enumerate(reversed(self.stack), 1) if o.tag in tags), 0)

    def end(self, tag: str) -> None:
        if tag in _INLINE:
            if tag in self.muted:
                self.muted.remove(tag)
            return
        depth = self.depth({tag})
        if depth:
            self.close(depth)
        else:
            self.flush()

    def start(self, tag: str, attributes: str) -> None:
        mark, classes, ids, hidden = _marks(attributes) if attributes.strip(" /") else ("", [], [], False)
        left_out = 2 if hidden else _left_out(tag, classes, ids, bool(self.stack) and self.stack[-1].inside)
        if tag == "br":
            self.line.append("\n")
        if tag in _INLINE:
            if left_out == 2 or self.muted and tag in self.muted:
                self.muted.append(tag)
            return
        if tag in _VOID:
            return self.flush() if tag == "hr" else None
        self.flush()
        depth = max(self.depth(_CLOSES[tag]) if tag in _CLOSES else 0, self.depth({"p"}) if tag in _SHUTS_P else 0)
        if depth and not _HOLDS.intersection(o.tag for o in self.stack[-depth:]):
            self.close(depth)
        if attributes.endswith("/") and tag not in _SHUTS_P:
            return None
        top = self.stack[-1] if self.stack else _Open("", "", 0, False)
        inside = top.inside or tag in ("article", "main") or tag in ("div", "section") and any("main" in n for n in classes + ids)
        if tag == "header" and not inside:
            left_out = 2  # a header inside an article is its own
        if tag in ("html", "body", "article", "main"):
            replies = any(n & {"comment", "comments", "reply", "replies"} for n in classes) or _whole(ids, _REPLY_WORDS)
            left_out = 2 if hidden or replies else 0
        self.page.tokens.append(("start", self.path(), tag + "." + mark if mark else tag))
        self.stack.append(_Open(tag, tag + "." + mark if mark else tag, max(left_out, top.out), inside))
        return None


def parse(source: str | None) -> Page:
    """Tokens and blocks of one page; a broken or cut page gives what it has."""
    parser, text, at = _Parser(), source or "", 0
    for match in _TOKEN.finditer(text):
        if match.start() > at and not parser.muted:
            parser.line.append(text[at : match.start()])
        at = match.end()
        if match[3] and match[2]:
            parser.end(match[3].lower())
        elif match[3]:
            parser.start(match[3].lower(), match[4] or "")
        # Comments, declarations and elements whose content is no text leave nothing.
    if at < len(text) and not parser.muted:
        parser.line.append(text[at:])
    parser.flush()
    return parser.page


def token_hash(token: tuple[str, str, str]) -> int:
    value = xxhash.xxh64_intdigest("\t".join(token).encode("utf-8", "replace"))
    return value - (1 << 64) if value >> 63 else value


def sequences(pages: DataFrame) -> DataFrame:
    """``host, page, tokens, counts`` of ``pages(page, host, html)``: the tokens of each page in order, and how often each occurs."""

    def compute(part: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"host": part["host"], "page": part["page"], "tokens": [], "counts": []}
        for source in part["html"]:
            tokens = [(token_hash(t), t[0] == "text") for t in parse(source).tokens]
            out["tokens"].append([t for t, _ in tokens])
            out["counts"].append([{"token": t, "is_text": text, "n": n} for (t, text), n in Counter(tokens).items()])
        return out

    columns = "host string, page long, tokens array<long>, counts array<struct<token: long, is_text: boolean, n: int>>"
    return per_slice(pages.select("page", "host", "html"), compute, columns)


def common_order(a: list[int], b: list[int]) -> list[int]:
    """Most tokens that stand in the same order in both, each token being in a sequence once."""
    place = {t: i for i, t in enumerate(b)}
    ends: list[int] = []  # per length the least place at which a rising sequence ends
    last: list[tuple[int, int, int]] = []
    for t in a:
        if t in place:
            k = bisect_left(ends, place[t])
            ends[k : k + 1] = [place[t]]
            last.append((k, place[t], t))
    out: list[int] = []
    before = len(b)
    for k, at, t in reversed(last):
        if k == len(ends) - 1 - len(out) and at < before:
            out.append(t)
            before = at
    return out[::-1]


def rounds(tokens: list[int], members: set[int]) -> list[list[tuple[int, int]]]:
    """The (place, token) of a class, as many for each round as the class has tokens."""
    found: list[list[tuple[int, int]]] = [[]]
    for at, t in enumerate(tokens):
        if t in members:
            if len(found[-1]) == len(members):
                found.append([])
            found[-1].append((at, t))
    return found


def _disorder(part: dict[str, list]) -> dict[str, list]:
    """Per host and class the tokens that don't keep, on some page of the slice, the order in which they stand on the host's reference page."""
    held: dict[tuple, set[int]] = {}
    for host, reference, tokens, classes in zip(part["host"], part["reference"], part["tokens"], part["classes"]):
        for c in classes:
            members = set(c["members"])
            # A token that comes again before all others have come does not keep the order.
            orders = [[t for t, n in Counter(t for _, t in own).items() if n == 1] for own in rounds(reference, members)[:1] + rounds(tokens, members)]
            kept = set(orders[0]).intersection(*(common_order(orders[0], o) for o in orders[1:]))
            held.setdefault((host, c["class"]), set()).update(members - kept)
    rows = [(host, name, t) for (host, name), own in held.items() for t in own]
    return {"host": [r[0] for r in rows], "class": [r[1] for r in rows], "token": [r[2] for r in rows]}


def _gaps(part: dict[str, list]) -> dict[str, list]:
    """Per host and pair of classes the least and the largest gap of the outer one that holds a round of the inner one; -1 if more than one does."""
    held: dict[tuple, list[int]] = {}
    for host, tokens, classes in zip(part["host"], part["tokens"], part["classes"]):
        found = [[[at for at, _ in own] for own in rounds(tokens, set(c["members"]))] for c in classes]
        for j, outer in enumerate(found):
            places, size = [at for own in outer for at in own], len(classes[j]["members"])
            for i in range(j + 1, len(found)):
                for own in found[i]:
                    first, last = bisect_left(places, own[0]), bisect_left(places, own[-1])
                    gap = first % size if first == last else -1
                    low, high = held.get((host, i, j), (gap, gap))
                    held[host, i, j] = [min(low, gap), max(high, gap)]
    return {
        "host": [k[0] for k in held], "inner": [k[1] for k in held], "outer": [k[2] for k in held],
        "low": [v[0] for v in held.values()], "high": [v[1] for v in held.values()],
    }


def _valid(part: dict[str, list]) -> dict[str, list]:
    """The text tokens of the classes that nest in all valid ones before them."""
    out: dict[str, list] = {"host": part["host"], "text_tokens": [], "n_classes": []}
    for classes, gaps in zip(part["classes"], part["gaps"]):
        wrong = {(g["inner"], g["outer"]) for g in gaps or () if g["low"] < 0 or g["low"] < g["high"]}
        valid: list[int] = []
        for i in range(len(classes)):
            valid += [i] if not any((i, j) in wrong for j in valid) else []
        out["text_tokens"].append([t for i in valid for t in classes[i]["members"] if t in set(classes[i]["texts"])])
        out["n_classes"].append(len(valid))
    return out


def templates(pages: DataFrame) -> DataFrame:
    """``host, text_tokens, n_classes``: per host the text tokens (hashes) that belong to its template.

    The vector of a token is kept as its number of pages and a sum of hashes of
    (page, count), which combine map-side, so a host may have any number of
    pages. Only tokens on every page of a host are gathered: at most as many as
    its shortest page has. Of a class those tokens stay that keep the order of one page of
    the host on every page, in each of its rounds; it counts if it holds tags still. Classes are taken by
    their number of occurrences: each round of a class must lie in one gap between the
    tokens of a class before it, the same gap on every page, or the class is no template.
    """
    known = stored(sequences(pages), "sequences")
    counted = known.select("host", "page", F.explode("counts").alias("c")).select("host", "page", "c.*")
    size = known.groupBy("host", "page").agg(F.count(F.lit(1)).alias("rows")).groupBy("host")
    size = size.agg(F.count(F.lit(1)).alias("pages"), F.sum("rows").alias("rows")).where(f"pages >= {SUPPORT}")
    vectors = counted.groupBy("host", "token", "is_text").agg(
        F.count(F.lit(1)).alias("held"), F.sum("n").alias("total"), F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).alias("vector"),
    )
    shared = vectors.join(size, "host").where("held = rows")
    classes = shared.groupBy("host", "total", F.xxhash64("vector").alias("class")).agg(
        F.sort_array(F.collect_list("token")).alias("members"), F.sort_array(F.collect_list(F.when(F.col("is_text"), F.col("token")))).alias("texts")
    )
    classes = stored(classes.where("size(texts) < size(members)"), "classes")
    pages_of = known.select("host", "tokens")

    def by_host(table: DataFrame) -> DataFrame:
        own = F.sort_array(F.collect_list(F.struct("total", -F.size("members"), "class", "members", "texts")))
        return table.groupBy("host").agg(own.alias("classes"))

    reference = known.groupBy("host").agg(F.min_by("tokens", "page").alias("reference"))
    moved = per_slice(many_to_one(pages_of, by_host(classes).join(reference, "host"), ["host"], "inner"), _disorder, "host string, class long, token long")
    moved = moved.groupBy("host", "class").agg(F.collect_set("token").alias("moved"))
    stay = F.array_except("members", F.coalesce("moved", F.array().cast("array<long>")))
    kept = classes.join(moved, ["host", "class"], "left").withColumn("members", stay).drop("moved")
    nested = stored(by_host(kept.where(F.size(F.array_except("members", "texts")) > 0)), "ordered")
    gaps = per_slice(many_to_one(pages_of, nested, ["host"], "inner"), _gaps, "host string, inner int, outer int, low int, high int")
    gaps = gaps.groupBy("host", "inner", "outer").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    gaps = gaps.groupBy("host").agg(F.collect_list(F.struct("inner", "outer", "low", "high")).alias("gaps"))
    return per_slice(nested.join(gaps, "host", "left"), _valid, "host string, text_tokens array<long>, n_classes int")


def host_of(url: Column) -> Column:
    """Host of an absolute URL; empty without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_blocks``.

    Blocks are joined by two line ends; white space inside a block is one space.
    A page without an article element gives every slot that is not left out. Text
    inside an article is taken for template only in elements whose class or role
    names something left out, since copies of a page on one host would share it. A null page gives an empty text; pages cut in the middle
    give what they have; repeated rows are extracted alike. A host with fewer
    than three pages, or no host, has no template. Other columns are ignored.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    # Copies of one page on a host are no support.
    voting = rows.where("host <> '' AND html IS NOT NULL").select("host", "html", F.xxhash64("html").alias("page"))
    known = stored(templates(voting).where(F.size("text_tokens") > 0).select("host", "text_tokens"), "templates")

    def extract(part: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"page_id": part["page_id"], "url": part["url"], "text": [], "n_blocks": []}
        for text, tokens in zip(part["html"], part["tokens"]):
            page, template = parse(text), set(tokens or ())
            known = lambda n: bool(template) and token_hash(page.tokens[n]) in template
            inside = [b for n, b, left_out, in_article in page.blocks if in_article and (not left_out or left_out == 1 and not known(n))]
            if not inside:
                slots = [b for n, b, left_out, _ in page.blocks if not left_out and not known(n)]
                inside = slots
            out["text"].append("\n\n".join(inside))
            out["n_blocks"].append(len(inside))
        return out

    joined = many_to_one(rows, known, ["host"]).select("page_id", "url", "html", F.col("text_tokens").alias("tokens"))
    found = per_slice(joined, extract, "page_id long, url string, text string, n_blocks int")
    return found.withColumnsRenamed({"page_id": page_id, "url": url})
