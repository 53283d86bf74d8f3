"""License scans: an exact set-similarity join of text blocks with license templates.

Templates are a fixed, bounded table. Their tokens are ordered by how many documents of the whole
corpus hold them, rarest first. A block B contains a template T when |B and T| >= alpha with
alpha = ceil(threshold * |T|). Any such pair shares a token inside the first |T| - alpha + 1 tokens
of T and inside the first |B| - alpha + 1 of B (prefix filter), B has at least alpha tokens (length
filter), and what is left behind the shared position still reaches alpha (positional filter).
Survivors are verified on full sets, so the join is exact. What is shared must include the words that
name T's license (NAMES): 'released under the license' is no MIT notice. Blocks are all windows of the whole text's
words, over line ends, of at most SPREAD times the template's words. A text whose own set does not
contain T has no such window; in the others only windows that hold one of T's prefix tokens are read.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, map_texts
from .license_texts import WHOLE

# The base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Template label and text (short notices in common use; whole texts stand beside this module).
NOTICES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "This library is free software licensed under the GNU Lesser General Public License"),
    ("agpl", "This program is licensed under the GNU Affero General Public License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("all-rights-reserved", "Copyright. All rights reserved. No part of this publication may be reproduced without permission"),
)
TEMPLATES = (*NOTICES, *WHOLE)
#: Words that tell one license from another. A block must hold those of every entry that its template holds.
NAMES = ("mit license", "apache", "mozilla", "general", "lesser", "affero", "cc by", "nc", "sa", "creative commons attribution")
THRESHOLD = 0.8
SPREAD = 1.5  # words of a block for each word of the template: room for inserted words, not for a whole text

#: Bytes of words lower-cased; all other ASCII becomes a blank. Bytes from 0x80 belong to words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_WORDS).split()


class TemplateIndex:
    """Inverted index over the prefixes of the templates, in global frequency order."""

    def __init__(self, templates, frequency: dict[bytes, int], threshold: float, names: tuple[str, ...] = ()):
        self.sets = [frozenset(words(t.encode())) for _, t in templates]
        self.labels = [label for label, _ in templates]
        self.width = [math.ceil(SPREAD * len(words(t.encode()))) for _, t in templates]
        entries = [frozenset(words(n.encode())) for n in names]
        self.names = [frozenset().union(*(e for e in entries if e <= s)) for s in self.sets]
        vocabulary = frozenset().union(*self.sets) if self.sets else frozenset()
        self.rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
        self.vocabulary = vocabulary
        self.alpha = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.index: dict[bytes, list[tuple[int, int]]] = {}
        self.rare: list[list[bytes]] = []
        for t, s in enumerate(self.sets):
            ordered = sorted(s, key=self.rank.__getitem__)
            self.rare.append(ordered[: len(s) - self.alpha[t] + 1])
            for i, w in enumerate(self.rare[t]):
                self.index.setdefault(w, []).append((t, i))
        self.prefix = frozenset(self.index)

    def contained(self, block: list[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of every template that the block contains."""
        have = self.vocabulary.intersection(block)
        if have.isdisjoint(self.prefix):
            return []
        ordered, n = sorted(have, key=self.rank.__getitem__), len(have)
        found: set[int] = set()
        for j, w in enumerate(ordered):
            for t, i in self.index.get(w, ()):
                a = self.alpha[t]
                if t not in found and n >= a and j <= n - a and 1 + min(len(self.sets[t]) - i - 1, n - j - 1) >= a:
                    found.add(t)
        out = []
        for t in sorted(found):
            shared = len(self.sets[t] & have)
            if shared >= self.alpha[t]:
                out.append((t, shared / len(self.sets[t])))
        return out

    def blocks(self, ws: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, first word, last word, containment) of the blocks of a text, without overlap in a template.

        Of overlapping windows of one template the fullest counts, the first of equals.
        """
        held = self.contained(ws)
        if not held:
            return []
        places: dict[bytes, list[int]] = {}
        for i, w in enumerate(ws):
            if w in self.vocabulary:
                places.setdefault(w, []).append(i)
        out = []
        for t, _ in held:
            if not self.names[t].issubset(places):
                continue
            wide = self.width[t]
            near: list[list[int]] = []  # [first, last] words of the stretches around prefix tokens
            for p in sorted(p for w in self.rare[t] for p in places.get(w, ())):
                if near and p - wide < near[-1][1]:
                    near[-1][1] = p + wide - 1
                else:
                    near.append([p - wide + 1, p + wide - 1])
            at = sorted((p, w) for w in self.sets[t] for p in places.get(w, ()))
            for first, last in near:
                part = at[bisect_left(at, (first,)) : bisect_left(at, (last + 1,))]
                if len(part) >= self.alpha[t]:
                    out += [(t, a, b, n / len(self.sets[t])) for a, b, n in self._fullest(part, t)]
        return out

    def _fullest(self, part: list[tuple[int, bytes]], t: int) -> Iterator[tuple[int, int, int]]:
        """(first word, last word, shared tokens) from a template's token places in order."""
        alpha, wide, names = self.alpha[t], self.width[t], self.names[t]
        k = 0
        best: tuple[int, int, int] | None = None
        last: dict[bytes, int] = {}  # last place of every token inside the window, oldest first
        while k < len(part) or best:
            if best and (k == len(part) or part[k][0] - wide >= best[1]):
                yield best
                # go on behind the block
                k, best = bisect_left(part, (best[1] + 1,)), None
                last.clear()
                continue
            p, w = part[k]
            k += 1
            last.pop(w, None)
            last[w] = p
            while (old := next(iter(last))) and last[old] <= p - wide:
                del last[old]
            n = len(last)
            if n >= alpha and names <= last.keys() and (best is None or (n > best[2] and next(iter(last.values())) <= best[1])):
                best = (next(iter(last.values())), p, n)


def fullest(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float, bool]]:
    """The blocks in order of their first word, each with whether no fuller one overlaps it."""
    found = sorted(found, key=lambda x: (x[1], x[2], x[0]))
    widest = max((b - a for _, a, b, _ in found), default=0)
    starts = [a for _, a, _, _ in found]
    out = []
    for t, a, b, c in found:
        close = found[bisect_left(starts, a - widest) : bisect_left(starts, b + 1)]
        out.append((t, a, b, c, all(x[3] <= c or x[2] < a for x in close)))
    return out


def phrase_places(ws: list[bytes], phrases) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand consecutively."""
    out: list[tuple[int, str]] = []
    have = set(ws)
    for phrase, label in phrases:
        p = words(phrase.encode())
        if not p or not have.issuperset(p):
            continue
        at = -1
        while True:
            try:
                at = ws.index(p[0], at + 1)
            except ValueError:
                break
            if ws[at : at + len(p)] == p:
                out.append((at, label))
    return sorted(out)


def token_frequency(docs: DataFrame, templates=TEMPLATES, text: str = "text") -> dict[bytes, int]:
    """Documents that hold each template token, over the whole table (at most one row per token)."""
    vocabulary = frozenset(w for _, t in templates for w in words(t.encode()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for raw in b.column(0).to_pylist():
                if raw:
                    seen.update(vocabulary.intersection(words(raw)))
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    rows = docs.select(F.col(text).cast("binary").alias("b")).mapInArrow(count, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["token"]): r["n"] for r in rows}


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD, names=NAMES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, places (word, label) and matches (template, label, first and last word,
    containment, best) per document; best marks a match that no fuller one overlaps: it names the license.

    A null text is an empty text: no words, places or matches. Repeated rows each give a row, an empty table
    none; a null id is carried and no other column is read. Every window is compared with every template through the index; nothing is capped.
    """
    index = TemplateIndex(templates, token_frequency(docs, templates, text), threshold, names)

    def scan(texts: list[bytes | None]) -> list[list]:
        n_words, places, matches = [], [], []
        for raw in texts:
            ws = words(raw or b"")
            n_words.append(len(ws))
            places.append([{"word": i, "label": x} for i, x in phrase_places(ws, phrases)])
            got = fullest(index.blocks(ws))
            matches.append([{"template": t, "label": index.labels[t], "first": a, "last": b, "containment": c, "best": best} for t, a, b, c, best in got])
        return [n_words, places, matches]

    fields = "n_words bigint, places array<struct<word:bigint,label:string>>, matches array<struct<template:int,label:string,first:bigint,last:bigint,containment:double,best:boolean>>"
    return map_texts(docs, {"doc_id": F.col(doc_id)}, fields, scan, text)


def digest(scanned: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    base, method = F.col("places.label"), F.filter("matches", lambda m: m["best"])["label"]
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, method)).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("matches.containment"), F.lit(0.0))).alias("score"),
        F.size("matches").cast("long").alias("n_blocks"),
    )


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return digest(license_scan(load(spark, sf_dir, "documents")))
