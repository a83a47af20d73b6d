"""License scans: text blocks that hold a license template, by an exact set-similarity join.

A template is a label with a text; its set are its distinct words. A text falls into
blocks: for templates of up to h words (h: a power of two) block k has words k * h to
k * h + 2 * h, so each stretch of h words lies whole in a block. A block meets a
template if at least ``percent`` of the template's words stand in it. All such
(block, template) pairs are found:

* tokens are ordered by their number in all documents, rare ones first; every task
  counts template words only, so the counts are one row for each task and template word;
* prefix filter: a block that meets a template of n words, m of them needed, holds
  one of the n - m + 1 rarest, so only blocks around those words are looked at;
* length filter: such a block has at least m different template words;
* positional filter: a common token at place i of the template and j of the block
  leaves room for the rest, or the pair is dropped; what is left is counted in full.

Phrases are templates whose words must follow each other: needing all of them, their prefix is the
one rarest word, whose places are then compared word for word.

Templates and phrases are broadcast with their index; more than MOST words of them
raise a ValueError. Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased; blocks and places count words
from 0 and end before ``hi``. Texts are read in pieces, so a long one takes four bytes a word. Null and empty
texts have no words; templates without words or label are ignored, repeated ones count once. Rows are scanned one by one (repeated
ones give repeated results, a null doc_id stays null), other columns are ignored, an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices, utf8

PERCENT, MOST, PIECE = 85, 1_000_000, 1 << 20

# The phrases of the contract.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

# Names and notices as the licenses' own texts word them.
TEMPLATES = [
    ("agpl", "GNU Affero General Public License"),
    ("apache-2", "Apache 2.0 license"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS"),
    ("artistic-2", "Artistic License 2.0"),
    ("boost-1", "Boost Software License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "the BSD license"),
    ("cc-by", "Creative Commons Attribution license"),
    ("cc-by-nc", "Creative Commons Attribution NonCommercial"),
    ("cc-by-nd", "Creative Commons Attribution NoDerivatives"),
    ("cc-by-sa", "Creative Commons Attribution ShareAlike"),
    ("cc0", "Creative Commons CC0"),
    ("epl", "Eclipse Public License"),
    ("gfdl", "GNU Free Documentation License"),
    ("gpl", "GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "GNU Lesser General Public License"),
    ("mit", "the MIT license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mpl", "Mozilla Public License"),
    ("ofl", "SIL Open Font License"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
]

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def words(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def needed(size: int, percent: int) -> int:
    """Words of a template of ``size`` words that a block must hold."""
    return max(1, -(-size * percent // 100))


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    need: int

    @property
    def span(self) -> int:
        return 1 << (len(self.words) - 1).bit_length()


def templates(rows, percent: int) -> list[Template]:
    """Templates of (label, text) rows, each once."""
    cut = dict.fromkeys((label, tuple(words((text or "").encode()))) for label, text in rows if label is not None)
    return [Template(label, w, needed(len(set(w)), percent)) for label, w in cut if w]


class LicenseIndex:
    """Templates and phrases by the words of their prefixes; ``order`` has all their words, rarest first."""

    def __init__(self, parts: list[Template], phrases: list[Template], order: list[bytes]):
        self.parts, self.phrases = parts, phrases
        self.rank = {w: i for i, w in enumerate(order)}
        self.sets = [sorted(self.rank[w] for w in set(t.words)) for t in parts]
        self.index: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for t, (part, ranks) in enumerate(zip(parts, self.sets, strict=True)):
            for i, r in enumerate(ranks[: len(ranks) - part.need + 1]):
                self.index[part.span][r].append((t, i))
        self.index = {h: dict(found) for h, found in self.index.items()}
        self.starts = {h: np.isin(np.arange(len(order) + 1), list(found)) for h, found in self.index.items()}
        self.sequences = [np.array([self.rank[w] for w in p.words], np.int32) for p in phrases]

    def ranks(self, text: bytes) -> np.ndarray:
        """Ranks of the words of a text, -1 for words of no template."""
        out, at, get = [], 0, self.rank.get
        while at < len(text):
            end = _BREAK.search(text, at + PIECE)
            piece = text[at : end.start() if end else len(text)]
            out.append(np.array([get(w, -1) for w in words(piece)], np.int32))
            at += len(piece)
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def places(self, ranks: np.ndarray) -> list[tuple[str, int, int]]:
        """(label, lo, hi) of every place where a phrase's words follow each other."""
        out = []
        for phrase, wanted in zip(self.phrases, self.sequences, strict=True):
            at = int(wanted.argmin())
            lo = np.flatnonzero(ranks == wanted[at]) - at
            lo = lo[(lo >= 0) & (lo + len(wanted) <= len(ranks))]
            for i, r in enumerate(wanted):
                lo = lo[ranks[lo + i] == r]
            out += [(phrase.label, int(p), int(p) + len(wanted)) for p in lo]
        return out

    def blocks(self, ranks: np.ndarray) -> list[tuple[str, int, int, int, int]]:
        """(label, lo, hi, common words, words of the template) of every block and template that meet."""
        out = []
        for h, index in self.index.items():
            at = np.flatnonzero(self.starts[h][ranks])
            if not len(at):
                continue
            for k in np.unique(np.concatenate([at // h, at[at >= h] // h - 1])).tolist():
                held = np.unique(ranks[k * h : (k + 2) * h])
                out += self._met(held[held >= 0].tolist(), index, k * h, min((k + 2) * h, len(ranks)))
        return out

    def _met(self, held: list[int], index: dict, lo: int, hi: int):
        seen: dict[int, int] = {}
        for j, r in enumerate(held):
            for t, i in index.get(r, ()):
                room = min(len(self.sets[t]) - i, len(held) - j)
                if len(held) < self.parts[t].need or seen.get(t, 0) + room < self.parts[t].need:
                    seen[t] = -len(held)  # no room is left: later tokens cannot make up for it
                else:
                    seen[t] = seen.get(t, 0) + 1
        own = set(held)
        for t, count in seen.items():
            common = len(own.intersection(self.sets[t])) if count > 0 else 0
            if common >= self.parts[t].need:
                yield self.parts[t].label, lo, hi, common, len(self.sets[t])


def word_counts(docs: DataFrame, vocabulary: list[bytes]) -> dict[bytes, int]:
    """How often each word of ``vocabulary`` stands in all texts."""
    index = LicenseIndex([], [], vocabulary)

    def run(batches):
        counts = np.zeros(len(vocabulary) + 1, np.int64)
        for batch in slices(batches):
            for text in utf8(batch):
                counts += np.bincount(index.ranks(text) + 1, minlength=len(counts))
        at = np.flatnonzero(counts[1:])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[1:][at], pa.int64())], names=["word", "n"])

    found = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {vocabulary[r["word"]]: r["n"] for r in found}  # at most MOST rows


def build_index(docs: DataFrame, parts=None, phrases=None, percent: int = PERCENT) -> LicenseIndex:
    """The index of templates and phrases, rows of (label, text), ordered by how often ``docs`` has their words."""
    parts, phrases = templates(TEMPLATES if parts is None else parts, percent), templates(PHRASES if phrases is None else phrases, 100)
    total = sum(len(t.words) for t in parts + phrases)
    if total > MOST:
        raise ValueError(f"templates of {total} words; {MOST} may be broadcast")
    vocabulary = sorted({w for t in parts + phrases for w in t.words})
    counts = word_counts(docs, vocabulary)
    return LicenseIndex(parts, phrases, sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))


BLOCK = "struct<label: string, lo: bigint, hi: bigint, common: bigint, size: bigint>"
PLACE = "struct<label: string, lo: bigint, hi: bigint>"


def scan(docs: DataFrame, parts=None, phrases=None, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, places (of phrases) and blocks (that meet a template) of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(build_index(docs, parts, phrases, percent))
    place = pa.list_(pa.struct([("label", pa.string()), ("lo", pa.int64()), ("hi", pa.int64())]))
    block = pa.list_(pa.struct([("label", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("common", pa.int64()), ("size", pa.int64())]))

    def run(batches):
        index = shared.value
        for batch in slices(batches):
            ranks = [index.ranks(t) for t in utf8(batch)]
            places = [[dict(zip(("label", "lo", "hi"), p, strict=True)) for p in index.places(r)] for r in ranks]
            blocks = [[dict(zip(("label", "lo", "hi", "common", "size"), b, strict=True)) for b in index.blocks(r)] for r in ranks]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, ranks), pa.int64()), pa.array(places, place), pa.array(blocks, block)],
                names=["doc_id", "n_words", "places", "blocks"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_words long, places array<{PLACE}>, blocks array<{BLOCK}>")


def license_labels(docs: DataFrame, parts=None, phrases=None, percent: int = PERCENT) -> DataFrame:
    """The scan with its digests: n_base, first_word, last_word of the places, labels, and score, the greatest part of a template in a block (1 for a phrase)."""
    found = scan(docs, parts, phrases, percent)
    starts, own, met = F.col("places.lo"), F.col("places.label"), F.col("blocks.label")
    parts_held = F.transform("blocks", lambda b: b["common"] / b["size"])

    def text(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        text(own).alias("base_labels"),
        text(F.concat(own, met)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(parts_held), F.lit(0.0))).alias("score"),
    )


def _values(rows) -> str:
    return ", ".join("({}, '{}', '{}')".format(i, label, " ".join(w.decode() for w in words(text.encode()))) for i, (label, text) in enumerate(rows))


SQL = rf"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), phrases AS (SELECT label, string_split(words, ' ') AS p FROM (VALUES {_values(PHRASES)}) AS v(i, label, words)),
places AS (
    SELECT doc_id, label, i - 1 AS lo FROM d, phrases, unnest(range(1, len(w) - len(p) + 2)) AS r(i) WHERE len(w) >= len(p) AND w[i : i + len(p) - 1] = p
), t AS (
    SELECT i AS t, label, words, len(string_split(words, ' ')) AS n, list_unique(string_split(words, ' ')) AS size FROM (VALUES {_values(TEMPLATES)}) AS v(i, label, words)
), tw AS (
    SELECT DISTINCT t, label, size, (size * {PERCENT} + 99) // 100 AS need, CAST(pow(2, ceil(log2(n))) AS BIGINT) AS h, unnest(string_split(words, ' ')) AS word FROM t
), dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
met AS (
    SELECT doc_id, t, label, size, i // h - b AS k, count(DISTINCT word) AS common
    FROM dw JOIN tw USING (word), (VALUES (0), (1)) AS v(b) WHERE i // h >= b GROUP BY doc_id, t, label, size, i // h - b, need HAVING count(DISTINCT word) >= need
), base AS (
    SELECT doc_id, count(*) AS n_base, min(lo) AS first_word, max(lo) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id
), named AS (
    SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(held) AS score
    FROM (SELECT doc_id, label, 1.0::DOUBLE AS held FROM places UNION ALL SELECT doc_id, label, common / size FROM met) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN named USING (doc_id)
"""
