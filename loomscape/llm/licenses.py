"""License scans: phrases, and an exact set-similarity join of templates with text blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscape.llm.decontamination import shingle_counts
from loomscape.llm.words import ALNUM, word_blocks, windows

THRESHOLD = 0.8

# Phrases whose words in a row name a licence, and the label of each.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices as their licences word them, and the label of each.
TEMPLATES = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation": "gpl",
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "you may not use this file except in compliance with the License. You may obtain a copy of the License at": "apache-2.0",
    "Released under the MIT License.": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by-4.0",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0",
    "All rights reserved.": "all-rights-reserved",
}


@dataclass
class Template:
    label: str
    tokens: list[int]  # distinct, from the rarest
    need: int  # tokens that a block must share
    prefix: int  # of which any block that shares so many holds one
    length: int  # words, repeated ones too


def hashed_words(text: str) -> np.ndarray:
    return np.concatenate([b.hashes for b in word_blocks(pa.array([text]), ALNUM)])


def order_templates(docs: DataFrame, templates: dict[str, str], threshold: float) -> list[Template]:
    """Templates with their tokens by frequency over all documents."""
    words = {text: hashed_words(text) for text in templates}
    sets = {text: np.unique(own) for text, own in words.items()}
    sets = {text: own for text, own in sets.items() if len(own)}
    if not sets:
        return []
    every = np.unique(np.concatenate(list(sets.values())))
    one = windows(every, 1)
    counts = shingle_counts(docs, {1: np.sort(one)})
    often = {w: counts.get((1, int(h)), 0) for w, h in zip(every.tolist(), one.view(np.int64).tolist(), strict=True)}
    out = []
    for text, own in sets.items():
        need = max(1, int(np.ceil(threshold * len(own) - 1e-9)))
        out.append(Template(templates[text], sorted(own.tolist(), key=lambda w: (often[w], w)), need, len(own) - need + 1, len(words[text])))
    return out


def _windowed(h: np.ndarray, text_at: np.ndarray, at: np.ndarray, tokens: np.ndarray, length: int) -> dict[int, int]:
    """By text: the most distinct tokens that a run of length consecutive words holds; only
    runs that hold one of the words at at are looked at."""
    out: dict[int, int] = {}
    if not len(at):
        return out
    text = np.searchsorted(text_at, at, side="right") - 1
    lo, hi = np.maximum(at - (length - 1), text_at[text]), np.minimum(at + length, text_at[text + 1])
    # stretches of words around those; overlapping ones of a text are one
    new = np.ones(len(at), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (lo[1:] > hi[:-1])
    first = np.flatnonzero(new)
    for i, a, z in zip(text[first].tolist(), lo[first].tolist(), hi[np.append(first[1:], len(at)) - 1].tolist(), strict=True):
        which = np.searchsorted(tokens, h[a:z])
        hit = np.flatnonzero(tokens[np.minimum(which, len(tokens) - 1)] == h[a:z])
        held: dict[int, int] = {}  # of the words in the run that ends here
        start = 0
        places, which = hit.tolist(), which[hit].tolist()
        for p, w in zip(places, which, strict=True):
            held[w] = held.get(w, 0) + 1
            while places[start] <= p - length:
                gone = which[start]
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
                start += 1
            out[i] = max(out.get(i, 0), len(held))
    return out


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels and score to docs (text).

    Words are lower-case runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] of whole texts; null and
    wordless texts have none. Base places are where a phrase's words stand in a row,
    overlapping ones included. Blocks are lines, and all runs of as many consecutive words
    as the template has, wherever lines end; a template's label is given where a block holds at least threshold of its distinct words, and score is the highest
    share of a template that a block holds where that is so, else 0. Columns of those
    names are replaced.

    Tokens are ordered by their frequency over all documents. A block that shares
    enough tokens with a template holds one of the template's rarest (its prefix); only
    those lines, and the runs around such words, are looked at, and only where their own number of words (length) and
    the tokens from that one on (position) can still suffice. Shares are then counted
    on full sets.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string").alias("text")
    ordered = order_templates(docs.select(text), templates, threshold)
    spoken = [(hashed_words(p), label) for p, label in phrases.items()]
    shared = spark.sparkContext.broadcast((ordered, [(h, label) for h, label in spoken if len(h)]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered, spoken = shared.value
        prefixes: dict[int, list[tuple[int, int]]] = {}  # token: templates and its place in each
        for t, template in enumerate(ordered):
            for place in range(template.prefix):
                prefixes.setdefault(template.tokens[place], []).append((t, place))
        rare = np.array(sorted(prefixes), dtype=np.uint64)
        sets = [frozenset(t.tokens) for t in ordered]
        own_tokens = [(np.array(sorted(t.tokens), dtype=np.uint64), np.array(t.tokens[: t.prefix], dtype=np.uint64)) for t in ordered]
        for batch in batches:
            n = batch.num_rows
            n_words, n_base = np.zeros(n, np.int64), np.zeros(n, np.int64)
            first: list[int | None] = [None] * n
            last: list[int | None] = [None] * n
            base: list[set] = [set() for _ in range(n)]
            more: list[set] = [set() for _ in range(n)]
            score = np.zeros(n)
            for b in word_blocks(batch.column("text").cast(pa.string()), ALNUM):
                h, k = b.hashes, len(b.at) - 1
                n_words[b.first : b.first + k] = np.diff(b.at)
                for words, label in spoken:
                    m = len(words)
                    place = np.flatnonzero(h[: max(0, len(h) - m + 1)] == words[0])
                    for j in range(1, m):
                        place = place[h[place + j] == words[j]]
                    own = np.searchsorted(b.at, place, side="right") - 1
                    ok = place + m <= b.at[own + 1]
                    for p, i in zip((place - b.at[own])[ok].tolist(), own[ok].tolist(), strict=True):
                        row = b.first + i
                        n_base[row] += 1
                        first[row] = p if first[row] is None else min(p, first[row])
                        last[row] = p if last[row] is None else max(p, last[row])
                        base[row].add(label)
                if not len(rare) or not len(h):
                    continue
                place = np.flatnonzero(rare[np.minimum(np.searchsorted(rare, h), len(rare) - 1)] == h)
                if not len(place):
                    continue
                breaks = np.flatnonzero(b.data == 10)
                line = np.searchsorted(breaks, b.starts)  # of each word; texts end lines too
                text_of = np.searchsorted(b.at, place, side="right") - 1
                for i, ln in sorted(set(zip(text_of.tolist(), line[place].tolist(), strict=True))):
                    lo = max(int(b.at[i]), int(np.searchsorted(line, ln)))
                    hi = min(int(b.at[i + 1]), int(np.searchsorted(line, ln, side="right")))
                    block = set(h[lo:hi].tolist())
                    best: dict[int, int] = {}  # template: place of the rarest of its tokens
                    for w in block.intersection(prefixes):
                        for t, at in prefixes[w]:
                            best[t] = min(at, best.get(t, at))
                    for t, at in best.items():
                        template = ordered[t]
                        if len(block) < template.need or len(template.tokens) - at < template.need:
                            continue
                        both = len(sets[t] & block)
                        if both >= template.need:
                            more[b.first + i].add(template.label)
                            score[b.first + i] = max(score[b.first + i], both / len(template.tokens))
                rare_words = h[place]
                for template, (tokens, prefix) in zip(ordered, own_tokens, strict=True):
                    at = place[np.isin(rare_words, prefix)]
                    for i, best in _windowed(h, b.at, at, tokens, template.length).items():
                        if best >= template.need:
                            more[b.first + i].add(template.label)
                            score[b.first + i] = max(score[b.first + i], best / len(tokens))
            out = dict(zip(batch.schema.names, batch.columns, strict=True))
            out |= {
                "n_words": pa.array(n_words),
                "n_base": pa.array(n_base),
                "first_word": pa.array(first, pa.int64()),
                "last_word": pa.array(last, pa.int64()),
                "base_labels": pa.array([",".join(sorted(x)) for x in base], pa.string()),
                "labels": pa.array([",".join(sorted(x | y)) for x, y in zip(base, more, strict=True)], pa.string()),
                "score": pa.array(score),
            }
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    kinds = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double"}
    rest = docs.drop(*kinds).withColumn("text", text)
    schema = ", ".join([*(f"`{n}` {t}" for n, t in rest.dtypes), *(f"{n} {t}" for n, t in kinds.items())])
    return rest.mapInArrow(scan, schema)
