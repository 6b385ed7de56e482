"""Licence scans with a positional rare-token index.

The index maps each word of the templates to its postings (template, position). A
file's licence words are looked up from the highest inverse document frequency
down: of each template the rarest words are its anchors, and an anchor at word
``p`` with posting position ``q`` says that the template would start at ``p - q``.
Postings that agree on a start are intersected; a start that enough anchors share
is a candidate, and the template's mandatory phrases must then stand in the file in
their order, within ``SLACK`` words of where the start puts them. Starts of a template
that lie in a notice found before them are the same notice. Document frequencies are
counted over all documents.

Base phrases are templates of two or three words whose only anchor is their rarest
word and which are mandatory as a whole, so every place of theirs is found.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlquilt.llm.common import arrow_schema, columns_batch, table, text_key

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Phrases that a scan reports in full, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label: (opening words of the licence's notice, phrases that must stand in it).
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        ["permission is hereby granted free of charge", "to deal in the software without restriction"],
    ),
    "apache": (
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        ["except in compliance with the license", "www apache org licenses"],
    ),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        ["redistribute it and or modify it under the terms", "as published by the free software foundation"],
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ["redistribution and use in source and binary forms", "the following conditions are met"],
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ["for any purpose with or without fee is hereby granted"],
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        ["subject to the terms of the mozilla public license"],
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
        ["free and unencumbered software released into the public domain"],
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        ["in no event will the authors be held liable"],
    ),
    "boost": (
        "distributed under the boost software license version 1 0 see accompanying file license 1 0 txt or copy at http www boost org license 1 0 txt",
        ["boost software license version 1 0"],
    ),
    "lgpl": ("gnu lesser general public license", ["lesser general public license"]),
    "agpl": ("gnu affero general public license", ["affero general public license"]),
    "epl": ("eclipse public license", ["eclipse public license"]),
    "bsd-name": ("bsd license", ["bsd license"]),
    "cc": ("licensed under a creative commons attribution", ["licensed under a creative commons"]),
}
#: Labels that are another template's under a further name.
SAME = {"bsd-name": "bsd"}

#: Rarest words of a template that serve as its anchors, and how many must agree on a start.
ANCHORS = 6
AGREE = 2
#: Words by which a mandatory phrase of a notice may stand elsewhere; none for base phrases.
SLACK = 8

SCHEMA = "doc_id long, text_hash long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<string>"


def words(text: str | None) -> list[bytes]:
    """The words of a text: runs of ASCII digits and letters, lower-cased, and of all other characters."""
    return WORD.findall((text or "").encode("utf-8", "replace").lower())


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    phrases: tuple[tuple[int, tuple[bytes, ...]], ...]
    base: bool


def templates() -> list[Template]:
    def find(whole: list[bytes], part: list[bytes]) -> int:
        return next(i for i in range(len(whole)) if whole[i : i + len(part)] == part)

    out = [Template(label, tuple(w := words(phrase)), ((0, tuple(w)),), True) for phrase, label in BASE.items()]
    for label, (text, phrases) in TEMPLATES.items():
        w = words(text)
        out.append(Template(SAME.get(label, label), tuple(w), tuple(sorted((find(w, p := words(x)), tuple(p)) for x in phrases)), False))
    return out


class Index:
    """Postings of the templates' words, with the anchors that the frequencies give."""

    def __init__(self, found: list[Template], frequency: dict[bytes, int], documents: int):
        self.templates = found
        idf = {w: math.log((1 + documents) / (1 + frequency.get(w, 0))) + 1 for t in found for w in t.words}
        self.weight = [[idf[w] for w in t.words] for t in found]
        self.total = [sum(x) for x in self.weight]
        self.need = []
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for k, t in enumerate(found):
            rarest = sorted(set(t.words), key=lambda w: (-idf[w], w))
            anchors = rarest[:1] if t.base else rarest[:ANCHORS]
            self.need.append(min(AGREE, len(anchors)))
            for w in anchors:
                self.postings.setdefault(w, []).extend((k, q) for q, x in enumerate(t.words) if x == w)
        self.order = sorted(self.postings, key=lambda w: (-idf[w], w))

    def scan(self, text: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, share of its weight that stands there) of each verified occurrence."""
        places: dict[bytes, list[int]] = {}
        postings = self.postings
        for p, w in enumerate(text):
            if w in postings:
                places.setdefault(w, []).append(p)
        if not places:
            return []
        starts: Counter[tuple[int, int]] = Counter()
        for w in self.order:  # rarest first
            for p in places.get(w, ()):
                for k, q in postings[w]:
                    starts[k, p - q] += 1
        found: dict[int, list[tuple[float, int]]] = {}
        for (k, start), n in starts.items():
            if n >= self.need[k] and self.verified(text, self.templates[k], start):
                t = self.templates[k]
                there = sum(x for i, (w, x) in enumerate(zip(t.words, self.weight[k], strict=True)) if 0 <= start + i < len(text) and text[start + i] == w)
                found.setdefault(k, []).append((there / self.total[k], start))
        out = []
        for k, hits in found.items():
            size = 1 if self.templates[k].base else len(self.templates[k].words)
            last = None
            for share, start in sorted(hits, key=lambda x: (x[1], -x[0])):
                if last is not None and start < last[1] + size:
                    if share > last[2]:
                        out[-1] = last = (k, last[1], share)
                    continue
                out.append(last := (k, start, share))
        return out

    @staticmethod
    def verified(text: list[bytes], t: Template, start: int) -> bool:
        """Whether the mandatory phrases stand in their order, each near its place."""
        at = 0
        for place, phrase in t.phrases:
            slack = 0 if t.base else SLACK
            at = next((p for p in range(max(at, start + place - slack), start + place + slack + 1) if text[p : p + len(phrase)] == list(phrase)), None)
            if at is None:
                return False
            at += len(phrase)
        return True


def frequencies(docs: DataFrame, found: list[Template]) -> tuple[dict[bytes, int], int]:
    """In how many documents each word of the templates stands, and the number of
    documents. To the driver comes one row for each such word."""
    vocabulary = {w for t in found for w in t.words}
    schema = arrow_schema("word binary, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        for batch in batches:
            for i in range(batch.num_rows):
                n.update(vocabulary.intersection(words(batch.column(0)[i].as_py())))
                n[b""] += 1
        yield columns_batch(list(n.items()), schema)

    rows = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {bytes(r["word"]): r["n"] for r in rows}
    return n, n.pop(b"", 0)


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_words, n_base, first_word, last_word,
    base_labels, labels, score and spans (``label:first word:words`` of every verified
    occurrence, base phrases too).

    A null text counts as empty: no words, no labels, score 0. Rows that share a
    doc_id, or have none, are each scanned for themselves. Whole texts are read,
    whatever their length; an empty table gives no rows, further columns are not
    read. ``score`` is the largest share of a template's weight that stands at a
    verified start: 1 for a whole phrase or notice."""
    found = templates()
    n, documents = frequencies(docs, found)
    index = Index(found, n, documents)
    schema = arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                text = words(batch.column(1)[i].as_py())
                hits = sorted((start, k, share) for k, start, share in index.scan(text))
                base = [(start, index.templates[k].label) for start, k, _ in hits if index.templates[k].base]
                rows.append((
                    batch.column(0)[i].as_py(), batch.column(2)[i].as_py(), len(text), len(base), base[0][0] if base else None, base[-1][0] if base else None,
                    ",".join(sorted({x for _, x in base})), ",".join(sorted({index.templates[k].label for _, k, _ in hits})), max((x for *_, x in hits), default=0.0),
                    [f"{index.templates[k].label}:{start}:{len(index.templates[k].words)}" for start, k, _ in hits],
                ))
            yield columns_batch(rows, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("key")).mapInArrow(run, SCHEMA)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("text_hash", "spans")
