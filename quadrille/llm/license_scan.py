"""License scans: an exact set-similarity join of text blocks with license templates.

Words are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after lower-casing A-Z. Fixed phrases are found wherever
their words stand consecutively. Beyond them, a block is any run of at most 3/2 times a template's words, and it
meets the template if it holds ceil(0.8 * size) of its distinct words. Words are ordered by their frequency in all
documents (the templates' words are counted over the whole corpus first; rare ones come first). By the prefix
filter a block that qualifies holds one of a template's first size - need + 1 words; the length filter leaves out
texts with fewer words than needed; by the positional filter the words are looked for in their order around such a
place, and it is given up once those found and those still to come are fewer than needed. Each remaining place is
counted exactly, and overlapping blocks make one match.

Null and empty texts have no words and no matches. Repeated rows are judged alike; extra columns are ignored; an empty
table gives no rows. Words of one frequency are ordered by their hash, matches with one start by label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.shared import arrow_map, doc_ranges, string_buffer, text_slices
from quadrille.llm.words import ALNUM, PIECE, U, word_hashes, words_by_text

#: The phrases of the query contract and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Templates and their labels: customary license notices.
TEMPLATES = [
    ("licensed under the apache license version 2", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("this work is licensed under the gnu general public license version", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
]

MATCHES = "array<struct<label:string,first:long,last:long,score:double>>"


def _hash(words: list[str]) -> np.ndarray:
    return word_hashes(np.frombuffer((" ".join(words) + " ").encode(), np.uint8), ALNUM)[0]


def _split(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


class Template:
    def __init__(self, text: str, label: str, threshold: float, rank: dict[int, int]):
        seq = _hash(_split(text)).tolist()
        self.label, self.words = label, sorted(set(seq), key=lambda h: (rank.get(h, 0), h))
        self.size = len(self.words)
        self.need = int(-(-threshold * self.size // 1))
        self.prefix, self.block = self.words[: self.size - self.need + 1], -(-3 * len(seq) // 2)
        self.place = {h: i for i, h in enumerate(self.words)}
        self.order = np.array(self.words, U)

    def reachable(self, region: np.ndarray) -> bool:
        """Positional filter: in the words' order, no more of them may lack in the region than a match can do without."""
        lacking = 0
        for i in range(0, self.size, 8):  # a few places at a time, the rarest first
            lacking += int((~np.isin(self.order[i : i + 8], region)).sum())
            if self.size - lacking < self.need:
                return False
        return True

    def blocks(self, h: np.ndarray, hits: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """First word, last word and containment of each match; hits: places of prefix words, rising."""
        n, done = len(h), 0
        if n < self.need:
            return
        groups = np.split(hits, np.flatnonzero(np.diff(hits) > 2 * self.block) + 1)
        for g in groups:
            lo, hi = max(done, int(g[0]) - self.block + 1), min(n, int(g[-1]) + self.block)
            if not self.reachable(h[lo:hi]):
                continue
            at = [(p, self.place[x]) for p, x in zip(range(lo, hi), h[lo:hi].tolist(), strict=True) if x in self.place]
            count, left, have, best = [0] * self.size, 0, 0, None
            for right in range(len(at)):
                count[at[right][1]] += 1
                have += count[at[right][1]] == 1
                while at[right][0] - at[left][0] >= self.block:
                    count[at[left][1]] -= 1
                    have -= count[at[left][1]] == 0
                    left += 1
                if have >= self.need:
                    first, last = at[left][0], at[right][0]
                    if best and first <= best[1]:
                        best = (best[0], last, max(best[2], have))
                    else:
                        if best:
                            yield best[0], best[1], best[2] / self.size
                        best = (first, last, have)
            if best:
                yield best[0], best[1], best[2] / self.size
                done = best[1] + 1


def corpus_counts(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[int, int]:
    """How often each word of the templates stands in all texts: one number a word, summed in each task first."""
    words = np.unique(_hash(_split(" ".join(t for t, _ in templates))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words), np.int64)
        for b in batches:
            data, off = string_buffer(b.column(1))
            for i, j in doc_ranges(off, PIECE):
                h, _ = words_by_text(data, off, i, j, ALNUM)
                at = np.minimum(np.searchsorted(words, h), len(words) - 1)
                total += np.bincount(at[words[at] == h], minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(words))), pa.array(total)], ["word", "n"])

    rows = text_slices(docs).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row a template word
    return {int(words[r["word"]]): int(r["n"]) for r in rows}


def scan_licenses(docs: DataFrame, phrases: list[tuple[str, str]] | None = None, templates: list[tuple[str, str]] | None = None, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_words, phrases array<struct<label, word>>, matches array<struct<label, first, last, score>>)."""
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    ranks = corpus_counts(docs, templates) if templates else {}

    def make():
        fixed = [(_hash(p.split()), label) for p, label in phrases]
        shapes = [Template(t, label, threshold, ranks) for t, label in templates]
        watch = np.unique(np.array([*(int(f[0]) for f, _ in fixed), *(x for s in shapes for x in s.prefix)], U))

        def step(b):
            data, off = string_buffer(b.column(1))
            n_words, places, matches = [], [], []
            for i, j in doc_ranges(off, PIECE):
                h, bounds = words_by_text(data, off, i, j, ALNUM)
                at = np.minimum(np.searchsorted(watch, h), len(watch) - 1)
                seen = np.flatnonzero(watch[at] == h) if len(watch) else np.zeros(0, np.int64)
                cuts = np.searchsorted(seen, bounds)
                n_words += np.diff(bounds).tolist()
                for d in range(j - i):
                    base, blocks = [], []
                    if cuts[d] < cuts[d + 1]:
                        own, hits = h[bounds[d] : bounds[d + 1]], seen[cuts[d] : cuts[d + 1]] - bounds[d]
                        first = own[hits]
                        for f, label in fixed:
                            for p in hits[first == f[0]].tolist():
                                if np.array_equal(own[p : p + len(f)], f):
                                    base.append({"label": label, "word": p})
                        for s in shapes:
                            near = hits[np.isin(first, np.array(s.prefix, U))]
                            if len(near):
                                blocks += [{"label": s.label, "first": x, "last": y, "score": z} for x, y, z in s.blocks(own, near)]
                    places.append(sorted(base, key=lambda r: (r["word"], r["label"])))
                    matches.append(sorted(blocks, key=lambda r: (r["first"], r["label"])))
            place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
            match = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(places, place), pa.array(matches, match)], ["doc_id", "n_words", "phrases", "matches"])

        return step

    return arrow_map(text_slices(docs), make, f"doc_id long, n_words long, phrases array<struct<label:string,word:long>>, matches {MATCHES}")


def license_report(docs: DataFrame) -> DataFrame:
    found = scan_licenses(docs)
    base, own, word = F.col("phrases.label"), F.col("matches.label"), F.col("phrases.word")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    sure = F.when(F.size("phrases") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("matches.score"), F.lit(0.0)))
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(word).alias("first_word"),
        F.array_max(word).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        sure.alias("score"),
    )
