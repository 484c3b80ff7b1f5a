"""License scans as an exact set-similarity join of text blocks with templates.

A template is the word set of a license notice; a text block is one line of a
document, or a window of words over several lines: as many as the template has,
over ``threshold``, so that wrapped notices match as well. A block matches if it
holds at least ``threshold`` of a template's words. The join is exact: tokens are put in one global order, rarest first by
document frequency over all documents, and a block is a candidate for a
template only if

* prefix: it holds one of the template's ``|T| - t + 1`` rarest tokens, where
  ``t = ceil(threshold * |T|)`` is the overlap needed;
* length: it holds at least ``t`` tokens that occur in templates at all;
* position: behind the first common token enough tokens remain on both sides
  to reach ``t``.

Candidates are verified by intersection. The templates are a fixed list, so
they travel with the code, and documents are scanned without a shuffle.

Besides the join, phrases are found where their words stand consecutively.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terramosaic.llm.common import utf8
from terramosaic.llm.words import words

#: Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: License notices as word sequences, and their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at apache org", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-3"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
)
THRESHOLD = 0.8


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes], text_col: str = "text") -> dict[bytes, int]:
    """Documents that hold each vocabulary word; each task sends at most one row a word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = dict.fromkeys(vocabulary, 0)
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                for word in vocabulary.intersection(words(raw[a:b].tobytes())):
                    totals[word] += 1
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(totals), pa.binary()), "n": pa.array(list(totals.values()), pa.int64())})

    found = docs.select(text_col).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in found}


class TemplateIndex:
    """Prefix index over the templates in one global token order."""

    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float, frequency: dict[bytes, int]):
        sets = [frozenset(t.encode().split()) for t, _ in templates]
        order = sorted(frozenset().union(*sets), key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.labels = [label for _, label in templates]
        self.tokens = [sorted(self.rank[w] for w in s) for s in sets]
        self.need = [ceil(threshold * len(t) - 1e-9) for t in self.tokens]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, (tokens, need) in enumerate(zip(self.tokens, self.need, strict=True)):
            for position, token in enumerate(tokens[: len(tokens) - need + 1]):
                self.prefix.setdefault(token, []).append((k, position))
        #: Words that a window over several lines may have.
        self.span = [ceil(len(t.split()) / threshold - 1e-9) for t, _ in templates]
        self.rare = frozenset(w for w, r in self.rank.items() if r in self.prefix)

    def matches(self, block: list[bytes]) -> dict[int, float]:
        """Template -> containment, for the templates that the block matches."""
        present = set(block)
        if not present & self.rare:
            return {}
        own = sorted(self.rank[w] for w in present & self.rank.keys())
        tried, out, own_set = set(), {}, set(own)
        for at, token in enumerate(own):
            for k, position in self.prefix.get(token, ()):
                if k in tried:
                    continue
                tried.add(k)  # the first common token, since both sides are in the same order
                tokens, need = self.tokens[k], self.need[k]
                if len(own) < need or 1 + min(len(tokens) - position, len(own) - at) - 1 < need:
                    continue
                overlap = len(own_set.intersection(tokens))
                if overlap >= need:
                    out[k] = overlap / len(tokens)
        return out

    def wrapped(self, lines: list[list[bytes]]) -> list[tuple[int, int, float]]:
        """(line, template, containment) of the best window of each run of matching windows over two lines or more.

        A window can only match a template that the whole text matches, so the
        filters are applied to the text first.
        """
        spots = [(number, word) for number, line in enumerate(lines) for word in line]
        out = []
        for k in sorted(self.matches([w for _, w in spots])):
            tokens, need, span = frozenset(self.tokens[k]), self.need[k], self.span[k]
            hits = [(at, number, r) for at, (number, w) in enumerate(spots) if (r := self.rank.get(w)) in tokens]
            held: dict[int, int] = {}
            first, best, reach = 0, None, -1
            for at, number, token in hits:
                held[token] = held.get(token, 0) + 1
                while hits[first][0] <= at - span:
                    gone = hits[first][2]
                    held[gone] -= 1
                    if not held[gone]:
                        del held[gone]
                    first += 1
                start, line, _ = hits[first]
                if len(held) < need or line == number:
                    continue
                if best and start > reach:
                    out.append(best)
                    best = None
                reach = at
                if not best or len(held) / len(tokens) > best[2]:
                    best = (line, k, len(held) / len(tokens))
            if best:
                out.append(best)
        return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each input row, over its whole text.

    Columns: id, n_words, n_base, first_word, last_word (null without a base
    place), base_labels, labels, score (1 with a base place, otherwise the best
    containment that reached the threshold, otherwise 0), blocks (number of the first
    line, label, containment). Null or empty text has no words and no labels; repeated
    rows and null ids are kept as they are; other columns are not read. If a
    block and a template share no prefix token the block cannot match, so
    nothing is lost by skipping it.
    """
    phrases = PHRASES if phrases is None else phrases
    vocabulary = frozenset(w for t, _ in templates for w in t.encode().split())
    index = TemplateIndex(templates, threshold, document_frequencies(docs, vocabulary, text_col))
    wanted = [(b" " + p.encode() + b" ", p.count(" ") + 1, label) for p, label in phrases.items()]
    id_type = docs.schema[id_col].dataType.simpleString()

    def places(canonical: bytes) -> list[tuple[int, str]]:
        found = []
        for phrase, _, label in wanted:
            at = canonical.find(phrase)
            while at >= 0:
                found.append((canonical.count(b" ", 0, at), label))
                at = canonical.find(phrase, at + 1)
        return found

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            rows = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                text = raw[a:b].tobytes()
                own = words(text)
                base = places(b" " + b" ".join(own) + b" ")
                blocks = []
                if not index.rare.isdisjoint(own):
                    lines = [words(line) for line in text.split(b"\n")]
                    found = [(number, k, share) for number, line in enumerate(lines) for k, share in sorted(index.matches(line).items())]
                    if len(lines) > 1:
                        found = sorted({*found, *index.wrapped(lines)})
                    blocks = [(number, index.labels[k], share) for number, k, share in found]
                base_labels = {label for _, label in base}
                labels = base_labels | {label for _, label, _ in blocks}
                starts = [at for at, _ in base]
                score = 1.0 if base else max((share for _, _, share in blocks), default=0.0)
                rows.append((len(own), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, [{"line": n, "label": label, "containment": share} for n, label, share in blocks]))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), BLOCKS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])

    schema = f"`{id_col}` {id_type}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, blocks array<struct<line:int,label:string,containment:double>>"
    return docs.select(id_col, text_col).mapInArrow(scan, schema)


BLOCKS = pa.list_(pa.struct([("line", pa.int32()), ("label", pa.string()), ("containment", pa.float64())]))
