"""License statements in documents: phrases at word positions, and an exact set-similarity join of lines with templates.

The join asks for lines that hold at least a share of a template's distinct words.
Words are ordered by the number of lines that have them, over all documents. A
line that reaches the share has one of the rarest words of the template (prefix
filter), enough distinct words (length filter), and enough words left after the
first common one in that order (positional filter); the rest is counted.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.rows import per_slice, text_bytes

SHARE = 0.8
# Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Statements by which texts name their license, with the labels they give.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("reserved", "All rights reserved."),
)
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz\n"
# A-Z to a-z, signs to blanks; letters beyond ASCII stay.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or bytes([b]) in _KEPT else 32 for b in range(256))


def lines_of(data: bytes | None) -> list[list[bytes]]:
    """The words of each line of a whole text, lower-cased."""
    return [line.split() for line in (data or b"").translate(_WORDS).split(b"\n")]


def places(words: Sequence[bytes], phrases: Sequence[tuple[Sequence[bytes], str]]) -> list[tuple[int, int, str]]:
    """First word, last word and label of every place where a phrase stands; a last word common to phrases is looked for once."""
    found, endings = [], {phrase[-1] for phrase, _ in phrases}
    for ending in sorted(endings):
        at = -1
        while True:
            try:
                at = words.index(ending, at + 1)
            except ValueError:
                break
            for phrase, label in phrases:
                start = at - len(phrase) + 1
                if phrase[-1] == ending and start >= 0 and list(words[start : at + 1]) == list(phrase):
                    found.append((start, at, label))
    return found


def needed(template: frozenset | set, share: float = SHARE) -> int:
    """Distinct words of the template that a line must have."""
    return max(1, math.ceil(round(share * len(template), 9)))


def line_counts(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> dict[bytes, int]:
    """Of each word of the templates, the number of lines of all documents that have it."""

    def compute(part: dict[str, list]) -> dict[str, list]:
        counts: dict[bytes, int] = {}
        for data in part["_text"]:
            for words in lines_of(data):
                for word in vocabulary.intersection(words):
                    counts[word] = counts.get(word, 0) + 1
        return {"word": list(counts), "n": list(counts.values())}

    counted = per_slice(text_bytes(docs, text=text), compute, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


class Join:
    """Templates in the global order of words, indexed by their prefixes."""

    def __init__(self, templates: Sequence[tuple[str, frozenset]], counts: Mapping[bytes, int], share: float = SHARE):
        order = sorted({w for _, t in templates for w in t}, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.templates = [(label, sorted(words, key=self.rank.get), needed(words, share)) for label, words in templates]
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for number, (_, words, least) in enumerate(self.templates):
            for place, word in enumerate(words[: len(words) - least + 1]):
                self.prefix.setdefault(word, []).append((number, place))
        self.keys = frozenset(self.prefix)

    def line(self, words: list[bytes]) -> list[tuple[int, float]]:
        """Templates that the line holds to the share, and how much of each."""
        if self.keys.isdisjoint(words):
            return []
        distinct = set(words)
        own = sorted(distinct.intersection(self.rank), key=self.rank.get)
        tried, found = set(), []
        for at, word in enumerate(own):
            for number, place in self.prefix.get(word, ()):
                if number in tried:
                    continue
                tried.add(number)
                _, template, least = self.templates[number]
                # Length, then position: the first common word leaves at most so many more.
                if len(distinct) < least or 1 + min(len(template) - place - 1, len(own) - at - 1) < least:
                    continue
                common = sum(w in distinct for w in template)
                if common >= least:
                    found.append((number, common / len(template)))
        return found


def scan(
    docs: DataFrame,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    share: float = SHARE,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_lines``.

    ``n_lines`` counts the lines that reach the share of some template, ``score`` is
    the largest share among them, 0 without one. Null and empty texts give zeros,
    null positions and empty labels. Repeated rows are scanned alike. Lines may
    be of any length. Other columns are ignored. Templates and phrases are
    parameters and travel to the tasks, as do the counts of their words.
    """
    sets = [(label, frozenset(w for words in lines_of(t.encode()) for w in words)) for label, t in templates]
    sets = [(label, words) for label, words in sets if words]
    join = Join(sets, line_counts(docs, {w for _, words in sets for w in words}, text), share)
    asked = [(tuple(p.encode().split()), label) for p, label in phrases]
    endings = {p[-1] for p, _ in asked}

    def compute(part: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
        for key, data in zip(part["id"], part["_text"]):
            lines = lines_of(data)
            hits = [hit for words in lines for hit in [join.line(words)] if hit]
            base = []
            if any(e in (data or b"").lower() for e in endings):
                base = places([w for words in lines for w in words], asked)
            own = {label for _, _, label in base}
            every = own | {join.templates[n][0] for hit in hits for n, _ in hit}
            row = (
                key, sum(map(len, lines)), len(base), min((b[0] for b in base), default=None), max((b[0] for b in base), default=None),
                ",".join(sorted(own)), ",".join(sorted(every)), max((s for hit in hits for _, s in hit), default=0.0), len(hits),
            )
            for column, value in zip(out.values(), row):
                column.append(value)
        return out

    schema = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_lines long"
    rows = text_bytes(docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")), "id")
    return per_slice(rows, compute, schema).withColumnRenamed("id", id_column)


def scan_sql(phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, share: float = SHARE) -> str:
    """The same rows as SQL, every line against every template."""
    array = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    sets = [(label, sorted({w.decode() for words in lines_of(t.encode()) for w in words})) for label, t in templates]
    shares = [(label, f"(len(list_intersect(l, {array(t)})) / {len(t)})", needed(set(t), share) / len(t)) for label, t in sets]
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hit = lambda value, least: f"CASE WHEN {value} >= {least} - 1e-9 THEN {value} END"
    best = ", ".join(hit(value, least) for _, value, least in shares)
    labels = ", ".join(f"CASE WHEN {value} >= {least} - 1e-9 THEN '{label}' END" for label, value, least in shares)
    starts = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(p.split()) - 1}] = {array(p.split())})) - 1 AS place FROM words"
        for p, label in phrases
    )
    return f"""
    WITH words AS (SELECT doc_id, regexp_extract_all({lower}, '{word}') AS w FROM documents),
    base AS (SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, list(DISTINCT label) AS own
             FROM ({starts}) GROUP BY doc_id),
    cut AS (SELECT doc_id, unnest(string_split({lower}, chr(10))) AS line FROM documents),
    lines AS (SELECT doc_id, list_distinct(regexp_extract_all(line, '{word}')) AS l FROM cut),
    judged AS (SELECT doc_id, list_max(list_filter([{best}], lambda x: x IS NOT NULL)) AS s, list_filter([{labels}], lambda x: x IS NOT NULL) AS labels FROM lines),
    found AS (SELECT doc_id, max(s) AS s, count(s) AS n, flatten(list(labels)) AS labels FROM judged GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(b.n, 0) AS n_base, b.a AS first_word, b.b AS last_word, coalesce(b.labels, '') AS base_labels,
           coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.own, []), coalesce(f.labels, [])))), ','), '') AS labels,
           coalesce(f.s, 0.0)::DOUBLE AS score, coalesce(f.n, 0) AS n_lines
    FROM words LEFT JOIN base b USING (doc_id) LEFT JOIN found f USING (doc_id)
    """
