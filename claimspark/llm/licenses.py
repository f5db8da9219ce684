"""License scan: exact set-similarity join of text blocks with license templates.

Tokens are ordered from rare to frequent by their document counts over the whole table. A template that must be contained
to a share t needs at least `need = ceil(t * size)` of its tokens in a block, so one of its `size - need + 1` rarest is
there (prefix filter); a block with fewer than `need` template tokens is out (length filter), and so is one whose
remaining tokens behind the match can't reach `need` (positional filter). What is left is verified in full. The template
side is a fixed dictionary and travels with the tasks; texts are scanned in place and never shuffled.

A template's window has as many words as the template, repeated ones counted, and as many more as the threshold lets it miss. It is contained in a text if
any run of words of that length, wherever it begins, holds enough of its tokens, in any order; words scattered over more of the text are no license. Blocks are two windows long and
begin a window apart, so each run stands in one block whole; templates of one window length share blocks. Templates with words in order (`phrases`) are joined at
containment 1 and then located exactly.

Defined cases: null text is empty (no words); words of a text are counted from 0; repeated rows get equal results; with an
empty table the order of tokens is alphabetical; other columns are carried through, and an added column whose name is taken has an
underscore more. Texts are read twice: for the counts by which tokens are ordered, and to be scanned.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, free, ready_for_arrow, with_arrow

#: Lower case for A-Z; all that no word has becomes a space.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Phrases of the base rule and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short forms and openings of public license texts, and their labels.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "gnu lesser general public license as published by the free software foundation": "lgpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved no part of this publication may be reproduced without prior written permission": "all-rights-reserved",
}


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


class Template(NamedTuple):
    label: str
    tokens: frozenset
    need: int
    phrase: list[bytes] | None
    window: int


Templates = dict[str, str] | list[tuple[str, str]]


def build(templates: Templates, phrases: dict[str, str], threshold: float) -> list[Template]:
    """Templates are (text, label); texts with equal words may have several labels."""
    out = [Template(label, frozenset(s := words(text.encode())), len(set(s)), s, len(s)) for text, label in phrases.items()]
    for text, label in templates.items() if isinstance(templates, dict) else templates:
        tokens = frozenset(s := words(text.encode()))
        need = math.ceil(round(threshold * len(tokens), 9))
        out.append(Template(label, tokens, need, None, len(s) + len(tokens) - need))
    return out


def document_counts(docs: DataFrame, vocabulary: frozenset, text: str = "text") -> dict[bytes, int]:
    """In how many texts each token of the vocabulary stands; counts of a batch are added up before the shuffle."""

    def rows_of(batches):
        for b in batches:
            seen = Counter(w for t in arrow_column(b, text) for w in vocabulary.intersection(words(t)))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])

    ready_for_arrow(docs.sparkSession)
    return {bytes(r["w"]): r["n"] for r in docs.select(text).mapInArrow(rows_of, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()}  # at most one row a template token


class Class(NamedTuple):
    """Templates of one window length."""

    window: int
    tokens: frozenset  # ranks
    prefixes: dict[int, list[tuple[int, int]]]  # token rank -> (template, position in its order)


class Index(NamedTuple):
    templates: list[Template]
    rank: dict[bytes, int]
    ranks: list[frozenset]  # of each template
    classes: list[Class]
    rare: dict[int, list[int]]  # token rank -> classes in which it is in a prefix


def index(templates: list[Template], counts: dict[bytes, int]) -> Index:
    order = sorted({w for t in templates for w in t.tokens}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    ranks, classes, rare = [frozenset(rank[w] for w in t.tokens) for t in templates], [], {}
    for window in sorted({t.window for t in templates}):
        own = [i for i, t in enumerate(templates) if t.window == window]
        prefixes: dict[int, list[tuple[int, int]]] = {}
        for i in own:
            for p, r in enumerate(sorted(ranks[i])[: len(ranks[i]) - templates[i].need + 1]):
                prefixes.setdefault(r, []).append((i, p))
        for r in prefixes:
            rare.setdefault(r, []).append(len(classes))
        classes.append(Class(window, frozenset().union(*(ranks[i] for i in own)), prefixes))
    return Index(templates, rank, ranks, classes, rare)


def candidates(block: list[int], ix: Index, c: Class) -> list[int]:
    """Templates that a block, given as its sorted distinct token ranks, may contain: prefix, length and positional filters."""
    out, tried = [], set()
    for q, r in enumerate(block):
        for i, p in c.prefixes.get(r, ()):
            need = ix.templates[i].need
            if i in tried or len(block) < need or min(len(ix.ranks[i]) - p, len(block) - q) < need:  # no earlier token of it matched
                continue
            tried.add(i)
            out.append(i)
    return out


def densest(found: list[tuple[int, int]], wanted: frozenset, window: int) -> tuple[int, int]:
    """(most distinct tokens `wanted` in any run of `window` words, where the first such run begins). found: (place, token) by place."""
    own, there, best, first = [x for x in found if x[1] in wanted], Counter(), (0, 0), 0
    for place, r in own:
        there[r] += 1
        while own[first][0] <= place - window:
            if there[own[first][1]] == 1:
                del there[own[first][1]]
            else:
                there[own[first][1]] -= 1
            first += 1
        if len(there) > best[0]:
            best = (len(there), own[first][0])
    return best


def scan(text: bytes, ix: Index) -> tuple[int, list[tuple[str, int, int, float, bool]]]:
    """Number of words, and matches (label, first word, words, containment, whether a phrase): of each block the densest window of a template."""
    w = words(text)
    hits = [(i, r) for i, r in enumerate(map(ix.rank.get, w)) if r is not None]  # only template tokens matter
    out: dict[tuple, tuple] = {}
    for k in sorted({c for _, r in hits for c in ix.rare.get(r, ())}):
        c, blocks = ix.classes[k], {}
        for i, r in hits:
            if r in c.tokens:
                for b in {i // c.window, max(0, i // c.window - 1)}:  # the block that starts at its window, and the one before
                    blocks.setdefault(b, []).append((i, r))
        for b, found in blocks.items():
            block = {r for _, r in found}
            if block.isdisjoint(c.prefixes):
                continue
            for i in candidates(sorted(block), ix, c):
                t = ix.templates[i]
                if t.phrase is None:
                    n, at = densest(found, ix.ranks[i], c.window)
                    if n >= t.need:
                        out[i, at] = (t.label, at, min(len(w) - at, c.window), n / len(t.tokens), False)
                else:
                    n = len(t.phrase)
                    for at in range(b * n, min(len(w), (b + 2) * n) - n + 1):
                        if w[at : at + n] == t.phrase:
                            out[i, at] = (t.label, at, n, 1.0, True)
    return len(w), sorted(out.values(), key=lambda m: (m[1], not m[4], m[0]))


def templates_of(table: DataFrame, most: int = 20_000) -> list[tuple[str, str]]:
    """Templates from a table (label, text) of whole license texts or parts of them. They travel with the tasks, so more than `most` are an error."""
    rows = table.select("text", "label").dropna().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} license templates")
    return sorted({(r["text"], r["label"]) for r in rows if words(r["text"].encode())})


def license_scan(docs: DataFrame, templates: Templates | DataFrame = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = 0.9, text: str = "text") -> DataFrame:
    """docs without their text, with n_words and matches: array of (label, start, words, containment, phrase)."""
    templates = templates_of(templates) if isinstance(templates, DataFrame) else templates
    built = build(templates, phrases, threshold)
    ix = index(built, document_counts(docs, frozenset(w for t in built for w in t.tokens), text))
    keep = [c for c in docs.columns if c != text]

    count, matches = free("n_words", keep), free("matches", keep)

    def rows_of(b: pa.RecordBatch) -> dict[str, list]:
        found = [scan(t, ix) for t in arrow_column(b, text)]
        return {count: [n for n, _ in found], matches: [[dict(zip(("label", "start", "words", "containment", "phrase"), m, strict=True)) for m in ms] for _, ms in found]}

    return with_arrow(docs, keep, f"`{count}` bigint, `{matches}` array<struct<label:string,start:bigint,words:bigint,containment:double,phrase:boolean>>", rows_of)
