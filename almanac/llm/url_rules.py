"""URL verdicts: host and path rules, and pattern rules indexed by their rarest literal token.

A pattern rule names literal tokens that every URL it matches contains. Of these
the one that fewest pages have is its key; the tokens of a URL fetch the rules
whose key they are, and only those run their regular expression. Patterns of
the given rules delimit their tokens on both sides, so all of them have a key; a
caller's rule without tokens is tried on every URL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str


@dataclass(frozen=True)
class PatternRule:
    """``tokens`` are runs of letters and digits (lower case) that stand alone in every matching URL: the pattern has a sign or an end of
    the URL on both sides of them. Without any, the rule is tried on every URL."""

    name: str
    tokens: tuple[str, ...]
    pattern: str


# The rules by host and path.
HOST_RULES = (
    HostRule("block", "net", "/"),
    HostRule("allow", "example.net", "/en/"),
    HostRule("block", "example.com", "/de/"),
    HostRule("allow", "org", "/fr/"),
)

# What stands before and after a token in a pattern: a sign that no token holds, or an end of the URL.
_START, _END = "(^|[^a-z0-9])", "([^a-z0-9]|$)"
# The same inside the host.
_HOST = "://([^/?#]*[^a-z0-9/?#])?"

# Patterns see the lower-cased URL: hosts that sell, bet, track or show adult matter, and pages without an article.
PATTERN_RULES = (
    PatternRule("pills", ("cheap", "pills"), r"://([^/?#]*[.])?cheap-pills[.]"),
    PatternRule("pharmacy", ("online", "pharmacy"), f"{_HOST}online-pharmacy{_END}"),
    PatternRule("casino", ("casino", "win"), r"://([^/?#]*[.])?casino-win[.]"),
    PatternRule("casino_bonus", ("casino", "bonus"), f"{_START}casino-bonus{_END}"),
    PatternRule("bets", ("free", "bets"), r"://([^/?#]*[.])?free-bets[.]"),
    PatternRule("sports_bets", ("sports", "bets"), f"{_START}sports-bets{_END}"),
    PatternRule("ads", ("ads", "track"), r"://([^/?#]*[.])?ads-track[.]"),
    PatternRule("click", ("click", "tracker"), f"{_HOST}click-tracker{_END}"),
    PatternRule("spam", ("spam", "farm"), r"://([^/?#]*[.])?spam-farm[.]"),
    PatternRule("links", ("link", "farm"), f"{_HOST}link-farm{_END}"),
    PatternRule("adult", ("adult", "x"), r"://([^/?#]*[.])?adult-x[.]"),
    PatternRule("adult_video", ("adult", "videos"), f"{_START}adult-videos{_END}"),
    PatternRule("keygen", ("keygen", "download"), f"{_START}keygen[^a-z0-9](.*[^a-z0-9])?download{_END}"),
    PatternRule("download", ("keygen", "download"), f"{_START}download[^a-z0-9](.*[^a-z0-9])?keygen{_END}"),
    PatternRule("cart", ("cart", "checkout"), f"/cart/checkout{_END}"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_rule(host: Column, path: Column, rules: Sequence[HostRule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null. A rule fits its host and all hosts under it."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.host + r.path), r.host + r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.host + rule.path)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def tokens(url: Column) -> Column:
    """Distinct runs of ASCII letters and digits of the lower-cased URL."""
    return F.array_distinct(F.regexp_extract_all(url, F.lit("([a-z0-9]+)"), F.lit(1)))


def rarest(pages: DataFrame, rules: Sequence[PatternRule], url: str = "url") -> dict[str, list[int]]:
    """Key token -> numbers of its rules; those of rules without a token are under "". The counts are over all pages; the result is bounded by the rules."""
    wanted = sorted({t for r in rules for t in r.tokens})
    lowered = F.translate(F.coalesce(F.col(url), F.lit("")), _UPPER, _LOWER)
    held = pages.select(F.array_intersect(tokens(lowered), F.array(*[F.lit(t) for t in wanted]).cast("array<string>")).alias("t"))
    counts = {r["t"]: r["n"] for r in held.select(F.explode("t").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    keys: dict[str, list[int]] = {}
    for number, rule in enumerate(rules):
        keys.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(number)
    return keys


def verdicts(
    pages: DataFrame,
    host_rules: Sequence[HostRule] = HOST_RULES,
    pattern_rules: Sequence[PatternRule] = PATTERN_RULES,
    page_id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, patterns``.

    ``patterns`` names the pattern rules that match, comma-joined. The verdict is
    that of the longest host rule; without one, a matching pattern blocks and
    everything else is allowed, null URLs too. Each row is judged by itself, so
    repeated rows agree and no URL, however frequent, gathers in one task. Other
    columns, pages' texts among them, are not read. The rules are a parameter and
    travel in the plan; they are meant to be thousands at most.
    """
    rows = pages.select(F.col(page_id), F.col(url).alias("_url"))
    host, path = parts(F.col("_url"))
    text, verdict = host_rule(F.col("host"), F.col("path"), host_rules)
    keys = rarest(rows, pattern_rules, "_url")
    index = F.create_map(*[x for token, own in sorted(keys.items()) for x in (F.lit(token), F.array(*[F.lit(i) for i in own]))])
    patterns = F.array(*[F.lit(r.pattern) for r in pattern_rules])
    names = F.array(*[F.lit(r.name) for r in pattern_rules])
    lowered = F.translate(F.coalesce(F.col("_url"), F.lit("")), _UPPER, _LOWER)
    # No token is empty; the rules under "" are fetched by every URL.
    asked = F.array_append(tokens(F.col("_low")), F.lit(""))
    fetched = F.flatten(F.filter(F.transform(asked, lambda t: F.try_element_at(index, t)), lambda x: x.isNotNull()))
    matched = F.filter(F.array_sort(F.array_distinct(fetched)), lambda i: F.rlike(F.col("_low"), F.get(patterns, i)))
    rows = rows.select(page_id, host.alias("host"), path.alias("path"), lowered.alias("_low")).withColumn("_matched", matched)
    method = F.when(F.size("_matched") > 0, F.lit("block")).otherwise(F.lit("allow"))
    named = F.array_join(F.transform("_matched", lambda i: F.get(names, i)), ",")
    return rows.select(page_id, "host", "path", text.alias("rule"), F.coalesce(verdict, method).alias("verdict"), named.alias("patterns"))


def verdicts_sql(host_rules: Sequence[HostRule] = HOST_RULES, pattern_rules: Sequence[PatternRule] = PATTERN_RULES) -> str:
    """The same rows as SQL, every pattern tried on every URL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    longest = sorted(host_rules, key=lambda r: (len(r.host + r.path), r.host + r.path), reverse=True)
    fits = [f"(host = {quoted(r.host)} OR ends_with(host, {quoted('.' + r.host)})) AND starts_with(path, {quoted(r.path)})" for r in longest]
    rule = " ".join(f"WHEN {f} THEN {quoted(r.host + r.path)}" for f, r in zip(fits, longest))
    verdict = " ".join(f"WHEN {f} THEN {quoted(r.verdict)}" for f, r in zip(fits, longest))
    hits = ", ".join(f"CASE WHEN regexp_matches(low, {quoted(r.pattern)}) THEN {quoted(r.name)} END" for r in pattern_rules)
    lower = f"translate({{}}, '{_UPPER}', '{_LOWER}')"
    return f"""
    WITH cut AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    named AS (
        SELECT page_id, {lower.format("url")} AS low, {lower.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
        FROM cut),
    hit AS (SELECT *, list_filter([{hits}], lambda x: x IS NOT NULL) AS hits FROM named)
    SELECT page_id, host, path, CASE {rule} END AS rule,
           CASE {verdict} WHEN len(hits) > 0 THEN 'block' ELSE 'allow' END AS verdict,
           coalesce(array_to_string(hits, ','), '') AS patterns
    FROM hit
    """
