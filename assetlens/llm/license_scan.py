"""License scans: an exact set-similarity join of text blocks and templates.

A block is a window of words of the text, across line feeds, or of one line.
A block holds a template when it
has at least THRESHOLD per cent of the template's distinct words.  Tokens are
ordered by their global block frequency, rarest first, and three exact
filters leave few pairs to count:

- prefix: with overlap ``need``, the first ``size - need + 1`` tokens of both
  sides (in the global order) share a token;
- length: a block with fewer than ``need`` template tokens cannot hold it;
- position: a first common token at places i and j leaves at most
  ``min(size_t - i, size_b - j)`` common tokens.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, text_batches

#: Base phrases and their labels: places where the words stand consecutively.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

#: License templates: (label, text).
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "CC BY-NC"),
    ("cc-by-sa", "CC BY-SA"),
    ("cc0", "To the extent possible under law the author has waived all copyright and related rights to this work"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "All rights reserved"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

#: Per cent of a template's distinct words that a block must hold.
THRESHOLD = 80
#: Words of a block, and the step from block to block: every run of
#: STEP words of a text lies in one block.
BLOCK, STEP = 64, 32

#: A-Z to a-z; every other ASCII byte but 0-9 and a-z parts words.
_KEEP = set((UPPER + LOWER + "0123456789").encode())
WORD_TABLE = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _KEEP or b >= 0x80 or b == 0x0A else 0x20
                   for b in range(256))

MATCHES = "array<struct<label:string,line:long,word:long,overlap:long,containment:double>>"
SCHEMA = f"doc_id long, n_words long, places array<struct<label:string,word:long>>, matches {MATCHES}"


def normalised(text: str | None) -> bytes:
    """Words parted by spaces, lines by line feeds."""
    return text.encode("utf-8").translate(WORD_TABLE) if text else b""


def blocks_of(data: bytes) -> Iterator[tuple[int, int, list[bytes]]]:
    """(line of the first word, first word within the text, words) of each
    block: windows of the whole text, so that a template may wrap, and those
    windows of a line that no window of the text holds."""
    words = data.split()
    ends, last = [], 0
    for line in data.split(b"\n"):
        last += len(line.split())
        ends.append(last)
    for at in range(0, max(len(words) - BLOCK, 0) + STEP, STEP) if words else ():
        yield bisect_right(ends, at), at, words[at:at + BLOCK]
    start = 0
    for number, end in enumerate(ends):
        if end - start > STEP:
            for at in range(start, max(end - BLOCK, start) + STEP, STEP):
                if at % STEP and min(at + BLOCK, end) > at // STEP * STEP + BLOCK:
                    yield number, at, words[at:min(at + BLOCK, end)]
        start = end


def template_words(templates) -> list[tuple[str, frozenset[bytes]]]:
    return [(label, frozenset(normalised(text).split())) for label, text in templates]


def block_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """Blocks that hold each word of the templates, over all documents.  The
    result has one entry per template word."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for _, texts in text_batches(batches):
            for text in texts:
                data = normalised(text)
                if vocabulary.isdisjoint(data.split()):
                    continue
                for _, _, words in blocks_of(data):
                    seen.update(vocabulary.intersection(words))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()),
                                          "n": pa.array(list(seen.values()), pa.int64())})

    counted = docs.select("doc_id", "text").mapInArrow(count, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


class TemplateIndex:
    """Prefix index of the templates in the global token order."""

    def __init__(self, templates, frequencies: dict[bytes, int], threshold: int):
        sets = template_words(templates)
        vocabulary = sorted(frozenset().union(*(words for _, words in sets)) if sets else (),
                            key=lambda w: (frequencies.get(w, 0), w))
        self.rank = {w: k for k, w in enumerate(vocabulary)}
        self.templates = []
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for label, words in sets:
            ordered = sorted(words, key=self.rank.__getitem__)
            need = -(-threshold * len(ordered) // 100)
            for place, word in enumerate(ordered[:len(ordered) - need + 1] if ordered else []):
                self.prefix.setdefault(word, []).append((len(self.templates), place))
            self.templates.append((label, words, need))

    def links(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(template, overlap) of every template that the block holds."""
        tokens = sorted(self.rank.keys() & set(words), key=self.rank.__getitem__)
        size, met = len(tokens), set()
        for j, token in enumerate(tokens):
            for t, i in self.prefix.get(token, ()):
                _, template, need = self.templates[t]
                if t in met or size < need or j > size - need:
                    continue
                met.add(t)
                if min(len(template) - i, size - j) < need:
                    continue
                overlap = len(template.intersection(tokens))
                if overlap >= need:
                    yield t, overlap


def phrase_places(words: list[bytes], phrases) -> list[tuple[int, str]]:
    """(first word, label) of each place of a phrase, overlapping ones too."""
    joined = b" " + b" ".join(words) + b" "
    places = []
    for phrase, label in phrases:
        needle = b" " + b" ".join(normalised(phrase).split()) + b" "
        at = joined.find(needle)
        while at >= 0:
            places.append((joined.count(b" ", 0, at + 1) - 1, label))
            at = joined.find(needle, at + 1)
    return sorted(places)


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, places
    (label, word) of base phrases, matches (label, line, word, overlap,
    containment) of blocks and templates.

    Null and empty texts have no words and no findings; a block that holds
    several templates lists each, so there are no ties; repeated rows are
    repeated; a very long text is cut into blocks by the task that reads it;
    an empty table gives no rows; further columns are not read.  Only the
    fixed templates travel to the tasks.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vocabulary = frozenset().union(*(words for _, words in template_words(templates))) if templates else frozenset()
    index = TemplateIndex(templates, block_frequencies(docs, vocabulary), threshold)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_batches(batches):
            out = {"doc_id": ids, "n_words": [], "places": [], "matches": []}
            for text in texts:
                data = normalised(text)
                words = data.split()
                out["n_words"].append(len(words))
                out["places"].append([{"label": label, "word": at} for at, label in phrase_places(words, phrases)])
                found = []
                if not index.prefix.keys().isdisjoint(words):
                    for line, start, block in blocks_of(data):
                        if index.prefix.keys().isdisjoint(block):
                            continue
                        for t, overlap in index.links(block):
                            label, template, _ = index.templates[t]
                            found.append({"label": label, "line": line, "word": start, "overlap": overlap,
                                          "containment": overlap / len(template)})
                out["matches"].append(found)
            yield pa.RecordBatch.from_pydict(out, schema=ARROW)

    return docs.mapInArrow(scan, SCHEMA)


ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()),
    ("places", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
    ("matches", pa.list_(pa.struct([("label", pa.string()), ("line", pa.int64()), ("word", pa.int64()),
                                    ("overlap", pa.int64()), ("containment", pa.float64())]))),
])


def license_summary(scanned: DataFrame) -> DataFrame:
    """Per document: counts, first and last place, labels and score (the best
    containment; a base phrase counts 1)."""
    def joined(*labels):
        return F.array_join(F.array_sort(F.array_distinct(F.concat(*labels))), ",")
    base = F.col("places.label")
    none = F.size("places") == 0
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.when(none, None).otherwise(F.array_min("places.word")).alias("first_word"),
        F.when(none, None).otherwise(F.array_max("places.word")).alias("last_word"),
        joined(base).alias("base_labels"), joined(base, F.col("matches.label")).alias("labels"),
        F.greatest(F.when(none, F.lit(0.0)).otherwise(F.lit(1.0)),
                   F.coalesce(F.array_max("matches.containment"), F.lit(0.0))).alias("score"))
