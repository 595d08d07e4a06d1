"""License scan: phrases, and an exact set-similarity join of text blocks with license templates.

Blocks are overlapping windows of 128 words over the words of the whole text, so that a notice of up to 64 words
lies in one block whole, however its lines are wrapped. A block meets a template when it contains THRESHOLD of the
template's distinct words or more (all of them where these are under SHORT) and the word that tells it from its like. Of the templates that
a block meets, those whose words all belong to another one give way to it. The join is exact and indexed on the templates:

- global order: words by their number of blocks over all documents, rarest first (one counting pass;
  only words of templates can matter, so the counts are a fixed few rows);
- prefix filter: of a template with n words that needs a, a block must hold one of its n - a + 1 rarest;
- length filter: the block must hold a template words at least;
- positional filter: words still to come on either side bound the overlap that can be reached;
- survivors are verified by intersection.

Scale: two passes over the texts without an exchange of texts; templates are fixed constants.

Defined cases: null text is empty; no words: no labels and score 0; rows of the same identifier are scanned each; very
long texts are scanned whole, one at a time; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, rowwise, slices, texts

THRESHOLD = 0.8
SHORT = 10
BLOCK = 128

# Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Labels, public license notices, and the word of a notice that must be there.
TEMPLATES = [
    ("mit", "released under the MIT license", "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "granted"),
    ("apache-2", "licensed under the Apache license version 2.0", "apache"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache org licenses license 2.0", "apache"),
    ("gpl-3", "this work is licensed under the GNU general public license version 3", "gnu"),
    ("gpl", "is free software you can redistribute it and or modify it under the terms of the GNU general public license as published by the free software foundation", "gnu"),
    ("lgpl", "is free software you can redistribute it and or modify it under the terms of the GNU lesser general public license as published by the free software foundation", "lesser"),
    ("mpl-2", "this source code form is subject to the terms of the Mozilla public license v 2.0", "mozilla"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution"),
    ("cc-by-nc", "licensed under CC BY NC 4.0", "nc"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4.0 international license", "noncommercial"),
    ("cc-by", "licensed under a creative commons attribution 4.0 international license", "attribution"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4.0 international license", "sharealike"),
]

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


def words(text: bytes) -> list[bytes]:
    return WORDS(text.lower())


def blocks(all_words: list[bytes]):
    for at in range(0, max(1, len(all_words) - BLOCK // 2), BLOCK // 2):
        yield all_words[at : at + BLOCK]


class Templates:
    """The inverted index over the templates' prefixes, in the global order of words."""

    def __init__(self, counts: dict[bytes, int], templates=TEMPLATES, threshold: float = THRESHOLD):
        sets = [(label, set(words(t.encode()))) for label, t, _ in templates]
        self.rank = {w: k for k, w in enumerate(sorted(set().union(*(s for _, s in sets)), key=lambda w: (counts.get(w, 0), w)))}
        self.sets = [(label, sorted(map(self.rank.__getitem__, s))) for label, s in sets]
        self.need = [len(s) if len(s) < SHORT else math.ceil(threshold * len(s) - 1e-9) for _, s in self.sets]
        self.telling = [self.rank[t.encode()] for _, _, t in templates]
        self.above = [{k for k, (_, o) in enumerate(sets) if s < o} for _, s in sets]  # templates with all its words and more
        self.index: dict[int, list[tuple[int, int]]] = {}
        for t, (_, ranks) in enumerate(self.sets):
            for place, r in enumerate(ranks[: len(ranks) - self.need[t] + 1]):
                self.index.setdefault(r, []).append((t, place))
        self.starters = frozenset(w for w, r in self.rank.items() if r in self.index)

    def matches(self, block: list[bytes]) -> list[tuple[str, float]]:
        """(label, containment) of every template that the block meets and that gives way to none."""
        there = set(block)
        if self.starters.isdisjoint(there):
            return []
        ranks = sorted(self.rank[w] for w in there if w in self.rank)
        overlap: Counter[int] = Counter()
        out_of_reach = set()
        for j, r in enumerate(ranks):
            for t, place in self.index.get(r, ()):
                size = len(self.sets[t][1])
                if len(ranks) < self.need[t] or overlap[t] + 1 + min(size - place - 1, len(ranks) - j - 1) < self.need[t]:
                    out_of_reach.add(t)
                else:
                    overlap[t] += 1
        own = set(ranks)
        found = {}
        for t in overlap.keys() - out_of_reach:
            shared = len(own.intersection(self.sets[t][1]))
            if shared >= self.need[t] and self.telling[t] in own:
                found[t] = shared / len(self.sets[t][1])
        return [(self.sets[t][0], c) for t, c in found.items() if self.above[t].isdisjoint(found)]


PARTS = [(phrase.encode().split(), label) for phrase, label in PHRASES.items()]


def places(all_words: list[bytes]) -> list[tuple[int, str]]:
    """(start, label) of every phrase."""
    found = []
    for phrase, label in PARTS:
        rare = 2 if phrase[0] == b"under" else 0  # looked for by a rare word
        at = -1
        try:
            while True:
                at = all_words.index(phrase[rare], at + 1)
                if at >= rare and all_words[at - rare : at - rare + len(phrase)] == phrase:
                    found.append((at - rare, label))
        except ValueError:
            pass
    return found


def block_counts(df: DataFrame, id_col: str, text_col: str, vocabulary: frozenset) -> dict[bytes, int]:
    """Blocks that hold each word of the templates, over all documents."""
    schema = pa.schema([("w", pa.string()), ("n", pa.int64())])

    def run(batches):
        n: Counter[bytes] = Counter()
        for batch in batches:
            for piece in slices(batch, 8 << 20):
                for body in piece.column(1).to_pylist():
                    for block in blocks(words(body)):
                        n.update(vocabulary.intersection(block))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n]), pa.array(list(n.values()))], schema=schema)

    rows = texts(df, id_col, text_col).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {r["w"].encode(): r["n"] for r in rows}


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document with its base places, labels and best containment."""
    vocabulary = frozenset(w for _, t, _ in templates for w in words(t.encode()))
    index = Templates(block_counts(df, id_col, text_col, vocabulary), templates, threshold)

    def kernel(ids, bodies):
        for i, body in zip(ids, bodies, strict=True):
            flat = words(body)
            base = places(flat)
            found = [m for b in blocks(flat) for m in index.matches(b)]
            labels = {label for _, label in base}
            starts = [at for at, _ in base]
            yield (
                i, len(flat), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
                ",".join(sorted(labels | {label for label, _ in found})), max([float(bool(base)), *(s for _, s in found)]),
            )

    return texts(df, id_col, text_col).mapInArrow(
        rowwise(kernel, SCHEMA, 4 << 20), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


_listed = lambda text: "[" + ", ".join(f"'{w.decode()}'" for w in dict.fromkeys(words(text.encode()))) + "]"
SQL = rf"""
WITH t AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{label}', {_listed(text)}, '{telling}')" for k, (label, text, telling) in enumerate(TEMPLATES))}) AS x(k, label, tw, telling)),
ph AS (SELECT * FROM (VALUES {", ".join(f"('{label}', {_listed(phrase)})" for phrase, label in PHRASES.items())}) AS x(label, pw)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
base AS (SELECT r, label, s FROM (SELECT r, ws, unnest(range(len(ws))) AS s FROM d), ph WHERE ws[s + 1:s + len(pw)] = pw),
b AS (SELECT r, count(*) AS n, min(s) AS lo, max(s) AS hi, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM base GROUP BY r),
blocks AS (SELECT r, o, list_distinct(ws[o + 1:o + {BLOCK}]) AS bw FROM (SELECT r, ws, unnest(range(0, greatest(1, len(ws) - {BLOCK // 2}), {BLOCK // 2})) AS o FROM d)),
met AS (SELECT r, o, k, label, tw, len(list_intersect(bw, tw)) AS c FROM blocks, t WHERE list_contains(bw, telling)
        AND len(list_intersect(bw, tw)) >= CASE WHEN len(tw) < {SHORT} THEN len(tw) ELSE ceil({THRESHOLD} * len(tw) - 1e-9) END),
top AS (SELECT m.r, m.label, m.c / len(m.tw)::DOUBLE AS score FROM met m
        WHERE NOT EXISTS (SELECT 1 FROM met o WHERE o.r = m.r AND o.o = m.o AND o.k <> m.k AND len(o.tw) > len(m.tw) AND list_has_all(o.tw, m.tw))),
every AS (SELECT r, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM (SELECT r, label FROM top UNION ALL SELECT r, label FROM base) GROUP BY r),
best AS (SELECT r, max(score) AS score FROM top GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(b.labels, '') AS base_labels,
       coalesce(every.labels, '') AS labels, CASE WHEN b.n IS NULL THEN coalesce(score, 0) ELSE 1 END::DOUBLE AS score
FROM d LEFT JOIN b ON d.r = b.r LEFT JOIN every ON d.r = every.r LEFT JOIN best ON d.r = best.r
"""
