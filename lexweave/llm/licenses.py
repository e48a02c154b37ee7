"""License scans by an exact set-similarity join of text blocks with templates.

A block matches a template when it holds at least a share ``containment`` of the
template's distinct words.  Templates are few and given.  Blocks are all lines of
all documents and, since notices are often wrapped, all runs of words over line
breaks that are a quarter longer than the template.  The template's words are put in one
global order, rarest in the corpus first; a block that matches must hold one of
the first ``size - needed + 1`` of them (prefix filter), must have ``needed``
distinct words at all (length filter), and from the first prefix word it holds
enough words must follow in both (positional filter).  What passes is counted
exactly, so every matching block is found.

Besides, the places of fixed phrases are reported, which are the base labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import ALNUM, hashes, joined, released, texts, word_counts, words
from .storage import prepare

#: Phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Notices by which licenses name themselves, and their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under the creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under the creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
)

CONTAINMENT = 0.9  #: short notices differ in one word, which has to be there


def _hash(word: str) -> int:
    raw = np.frombuffer(word.encode() + b" ", np.uint8)
    return int(hashes(raw, np.array([0]), np.array([len(raw) - 1]))[0])


def _words_of(text: str) -> list[str]:
    raw, _ = joined([text.encode()], lower=True)
    return [raw[a:b].tobytes().decode() for a, b in zip(*words(raw, ALNUM), strict=True)]


@dataclass(frozen=True)
class Scanner:
    """Phrases, templates, and the corpus frequency of every template word."""

    phrases: tuple[tuple[str, str], ...]
    templates: tuple[tuple[str, str], ...]
    containment: float
    frequency: dict[int, int]

    @cached_property
    def plan(self) -> dict:
        ordered = []
        for text, label in self.templates:
            mine = sorted({_hash(w) for w in _words_of(text)}, key=lambda h: (self.frequency.get(h, 0), h))
            needed = max(1, ceil(self.containment * len(mine) - 1e-9))
            n_words = len(_words_of(text))
            ordered.append((np.array(mine, np.uint64), needed, label, n_words + n_words // 4))
        vocabulary = np.unique(np.concatenate([t for t, *_ in ordered])) if ordered else np.empty(0, np.uint64)
        prefix = np.zeros(len(vocabulary), bool)
        places = []
        for mine, needed, label, span in ordered:
            prefix[np.searchsorted(vocabulary, mine[: len(mine) - needed + 1])] = True
            places.append((np.searchsorted(vocabulary, mine).tolist(), needed, label, span))
        by_prefix: dict[int, list[int]] = {}
        for t, (mine, needed, *_) in enumerate(places):
            for word in mine[: len(mine) - needed + 1]:
                by_prefix.setdefault(word, []).append(t)
        phrases = [(np.array([_hash(w) for w in _words_of(p)], np.uint64), label) for p, label in self.phrases]
        return {"vocabulary": vocabulary, "prefix": prefix, "templates": places, "by_prefix": by_prefix, "phrases": phrases}

    def matches(self, n_distinct: int, held: set[int]) -> dict[str, float]:
        """Labels of the templates that a block matches, each with its best containment.

        ``held`` has the numbers of the template words in the block, and
        ``n_distinct`` counts all its distinct words.
        """
        plan, found = self.plan, {}
        near = {t for word in held for t in plan["by_prefix"].get(word, ())}
        for t in near:
            mine, needed, label, _ = plan["templates"][t]
            if n_distinct < needed:  # length filter
                continue
            shared = 0
            for place, word in enumerate(mine):
                if shared + len(mine) - place < needed:  # positional filter: too few words are left
                    break
                shared += word in held
            if shared >= needed:
                found[label] = max(found.get(label, 0.0), shared / len(mine))
        return found

    def over_breaks(self, at: int, place: np.ndarray, line: np.ndarray) -> dict[str, float]:
        """Labels of the templates that runs of words around a prefix word match, where they go over line breaks.

        ``place`` has the number of each word of the text in the vocabulary, or -1,
        and ``line`` its line.
        """
        plan, found = self.plan, {}
        for t in plan["by_prefix"].get(int(place[at]), ()):
            mine, needed, label, span = plan["templates"][t]
            lo, hi = max(0, at - span + 1), min(len(place), at + span)
            if line[lo] == line[hi - 1]:  # its line has been compared whole
                continue
            wanted, near = set(mine), place[lo:hi].tolist()
            if len(wanted.intersection(near)) < needed:  # length filter
                continue
            held: dict[int, int] = {}
            most = 0
            for i, word in enumerate(near):
                if word in wanted:
                    held[word] = held.get(word, 0) + 1
                if i >= span and (gone := near[i - span]) in wanted:
                    held[gone] -= 1
                    if not held[gone]:
                        del held[gone]
                most = max(most, len(held))
            if most >= needed:
                found[label] = max(found.get(label, 0.0), most / len(mine))
        return found


def _scan(scanner: Scanner, part: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int, str]]], list[dict[str, float]]]:
    """Per text: number of words; phrase places (first, last word, label); template labels with containment."""
    plan = scanner.plan
    buf, bounds = joined(part, lower=True)
    starts, ends = words(buf, ALNUM)
    h, first = hashes(buf, starts, ends), word_counts(starts, bounds)
    spans: list[list[tuple[int, int, str]]] = [[] for _ in part]
    labels: list[dict[str, float]] = [{} for _ in part]
    text_of = lambda i: np.searchsorted(first, i, "right") - 1
    for phrase, label in plan["phrases"]:
        m = len(phrase)
        if len(h) < m:
            continue
        at = np.flatnonzero(h[: len(h) - m + 1] == phrase[0])
        for j in range(1, m):
            at = at[h[at + j] == phrase[j]]
        for i in at.tolist():
            t = int(text_of(i))
            if i + m <= first[t + 1]:
                spans[t].append((i - int(first[t]), i + m - 1 - int(first[t]), label))
    vocabulary = plan["vocabulary"]
    if len(vocabulary) and len(h):
        place = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        known = vocabulary[place] == h
        seeds = np.flatnonzero(known & plan["prefix"][place])
        if len(seeds):
            # Blocks: a line break or the end of a text opens a new one.
            breaks = np.union1d(np.flatnonzero(buf == 10), bounds[1:] - 1)
            block_of = np.searchsorted(breaks, starts)
            for block in np.unique(block_of[seeds]).tolist():
                lo, hi = np.searchsorted(block_of, [block, block + 1])
                held = set(place[lo:hi][known[lo:hi]].tolist())
                found = scanner.matches(len(np.unique(h[lo:hi])), held)
                mine = labels[int(text_of(lo))]
                for label, share in found.items():
                    mine[label] = max(mine.get(label, 0.0), share)
            number = np.where(known, place, -1)
            for i in seeds.tolist():
                t = int(text_of(i))
                lo, hi = int(first[t]), int(first[t + 1])
                for label, share in scanner.over_breaks(i - lo, number[lo:hi], block_of[lo:hi]).items():
                    labels[t][label] = max(labels[t].get(label, 0.0), share)
    return np.diff(first), spans, labels


def template_frequencies(df: DataFrame, text: str, templates: tuple[tuple[str, str], ...]) -> dict[int, int]:
    """How often each template word occurs in the whole corpus: a bounded table, as templates are."""
    vocabulary = np.array(sorted({_hash(w) for t, _ in templates for w in _words_of(t)}), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, part in texts(batch.column(0)):
                buf, _ = joined(part, lower=True)
                h = hashes(buf, *words(buf, ALNUM))
                place = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                total += np.bincount(place[vocabulary[place] == h], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocabulary))), pa.array(total)], ["word", "n"])

    if not len(vocabulary):
        return {}
    counts = df.select(text).mapInArrow(released(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {int(vocabulary[r["word"]]): r["n"] for r in counts}


def scan(
    df: DataFrame, key: str, text: str, phrases: tuple[tuple[str, str], ...] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT
) -> DataFrame:
    """License evidence of every whole text.

    (key, n_words, spans array<struct<first, last, label>> of the phrases in order
    of place, matches array<struct<label, containment>> of the templates, best per
    label).  Words count from 0.  Null and empty texts have no words and no
    evidence; repeated rows are scanned each; an empty table gives no rows; other
    columns are left out.
    """
    prepare(df.sparkSession)
    share = df.sparkSession.sparkContext.broadcast(Scanner(phrases, templates, containment, template_frequencies(df, text, templates)))
    kind = df.schema[key].dataType.simpleString()
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string())]))
    match = pa.list_(pa.struct([("label", pa.string()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = share.value
        for batch in batches:
            for first, part in texts(batch.column(1)):
                n, spans, labels = _scan(scanner, part)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(part)),
                        pa.array(n, pa.int64()),
                        pa.array([[{"first": a, "last": b, "label": x} for a, b, x in sorted(s)] for s in spans], span),
                        pa.array([[{"label": x, "containment": c} for x, c in sorted(m.items())] for m in labels], match),
                    ],
                    ["key", "n_words", "spans", "matches"],
                )

    schema = f"key {kind}, n_words long, spans array<struct<first:long,last:long,label:string>>, matches array<struct<label:string,containment:double>>"
    return df.select(key, text).mapInArrow(released(run), schema).withColumnRenamed("key", key)


def summary(scanned: DataFrame, key: str) -> DataFrame:
    """Digest columns of ``scan``: places, base labels, all labels, and the best evidence as a score.

    A phrase counts as evidence 1; a template as its containment; none as 0.
    """
    names = lambda c: F.transform(F.col(c), lambda x: x["label"])
    base = F.array_sort(F.array_distinct(names("spans")))
    both = F.array_sort(F.array_distinct(F.concat(names("spans"), names("matches"))))
    best = F.coalesce(F.array_max(F.transform("matches", lambda x: x["containment"])), F.lit(0.0))
    return scanned.select(
        F.col(key),
        "n_words",
        F.size("spans").cast("long").alias("n_base"),
        F.array_min(F.transform("spans", lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform("spans", lambda x: x["first"])).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.when(F.size("spans") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
