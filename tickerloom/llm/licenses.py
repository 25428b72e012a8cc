"""Licence families of documents, by a trained paragraph classifier.

A paragraph is a line of text, cut into pieces of ``PIECE`` words that overlap by half where it is
longer. Features are its word 1- to 3-grams, hashed; a multinomial logistic regression over families and
an unknown class, trained in numpy on licence notices, their variations and paragraphs of the corpus itself,
gives probabilities that a temperature calibrates on paragraphs kept aside. A family is accepted if its
probability reaches ``SURE`` and if the paragraph shares enough word pairs with one of the family's
templates; all else is unknown.

Weights are kept sparse by an L1 penalty, and pieces that meet fewer than two n-grams with a weight for a
family are unknown at once. Whole texts are read, as numpy arrays over a megabyte of a batch. Corpus paragraphs for
training come from at most ``SAMPLE`` documents (a documented bound, drawn by hash of the id).

Defined cases: a null or blank text has no paragraph and no licence (family and probability null, counts
0); several families give the one with the most accepted paragraphs, ties by probability, then by name; rows
that repeat an id get a row each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import batched_texts, text_of

# Public licence notices, from the licences' own texts.
NOTICES: dict[str, tuple[str, ...]] = {
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "BSD": (
        "This project is licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "MPL": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0": (
        "Released under CC0 1.0 Universal, dedicated to the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "Proprietary": (
        "All rights reserved.",
        "This document is confidential and proprietary; no part of it may be reproduced without prior written permission.",
    ),
}

PIECE, GRAMS, BUCKET_BITS = 24, 3, 15
SAMPLE, PER_FAMILY = 400, 400
STEPS, RATE, SPARSE = 150, 4.0, 1e-4
SURE, LIKE = 0.6, 0.6
UNKNOWN = 0
FAMILIES = ("unknown", *NOTICES)

_WORD = regex.compile(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def pieces(text: str | None) -> Iterator[list[str]]:
    """Words of each paragraph, longer ones in overlapping pieces."""
    for line in (text or "").split("\n"):
        words = words_of(line)
        if not words:
            continue
        for i in range(0, max(1, len(words) - PIECE // 2), PIECE // 2):
            yield words[i:i + PIECE]


class Numbers:
    """Words as numbers, kept up to a bound."""

    def __init__(self, bound: int = 300_000):
        self.seen: dict[str, int] = {}
        self.bound = bound

    def of(self, words: Sequence[str]) -> np.ndarray:
        import xxhash

        if len(self.seen) > self.bound:
            self.seen.clear()
        out, seen = [], self.seen
        for w in words:
            n = seen.get(w)
            if n is None:
                n = seen[w] = xxhash.xxh32_intdigest(w)
            out.append(n)
        return np.array(out, dtype=np.uint64)


def buckets(numbers: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """For each gram size the bucket of the gram that begins at each word, -1 where it would leave its piece."""
    out, h = [], numbers.copy()
    for k in range(GRAMS):
        if k:
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + numbers[k:]
        b = (((h + np.uint64(k)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        b = np.concatenate([b, np.full(len(numbers) - len(b), -1)])
        if k:
            b[:-k] = np.where(owner[k:] == owner[:-k], b[:-k], -1)
        out.append(b)
    return out


def _variations(rng: np.random.Generator, notice: str, filler: list[str], n: int) -> list[list[str]]:
    """The notice with words missing or misspelt, cut short, or beside other text."""
    words, out = words_of(notice), [words_of(notice)]
    for _ in range(n - 1):
        w = [x for x in words if rng.random() > rng.choice([0.0, 0.05, 0.15])] or words
        if filler and rng.random() < 0.4:
            extra = [filler[i] for i in rng.integers(0, len(filler), rng.integers(1, PIECE // 2))]
            w = extra + w if rng.random() < 0.5 else w + extra
        i = int(rng.integers(0, max(1, len(w) - PIECE + 1)))
        out.append(w[i:i + PIECE])
    return out


def pairs(words: Sequence[str]) -> set[tuple[str, ...]]:
    return set(zip(words, words[1:])) or {tuple(words)}


TEMPLATES = {f: [pairs(words_of(n)) for n in ns] for f, ns in NOTICES.items()}


def likeness(family: str, words: Sequence[str]) -> float:
    """Largest share of a template's word pairs, or of the paragraph's where that is shorter, that both hold."""
    own = pairs(words)
    return max(len(own & t) / min(len(own), len(t)) if min(len(own), len(t)) > 1 else float(own == t) for t in TEMPLATES[family])


def fit(corpus: Sequence[str], seed: int = 2) -> dict:
    """Train on the notices and on corpus texts (as unknown, less paragraphs that match a template)."""
    rng = np.random.default_rng(seed)
    plain = [w for t in corpus for w in pieces(t) if not any(likeness(f, w) >= LIKE and len(w) > 2 for f in NOTICES)]
    filler = [w for p in plain for w in p][:50_000] or ["lorem", "ipsum", "dolor"]
    rows: list[list[str]] = []
    y: list[int] = []
    for i, (_, notices) in enumerate(NOTICES.items(), 1):
        for n in notices:
            got = _variations(rng, n, filler, PER_FAMILY // len(notices))
            rows += got
            y += [i] * len(got)
    licence_words = [w for ns in NOTICES.values() for n in ns for w in words_of(n)]
    order = rng.permutation(len(plain))[:6 * PER_FAMILY]
    rows += [plain[i] for i in order]
    # unknown too: licence words in no licence's order, alone or in other text
    for _ in range(2 * PER_FAMILY):
        some = [licence_words[i] for i in rng.integers(0, len(licence_words), rng.integers(1, 6))]
        other = [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, PIECE - 6))]
        rows.append([(some + other)[i] for i in rng.permutation(len(some) + len(other))])
    label = np.array(y + [UNKNOWN] * (len(rows) - len(y)))
    numbers = Numbers()
    size = np.array([len(r) for r in rows])
    owner = np.repeat(np.arange(len(rows)), size)
    grams = buckets(numbers.of([w for r in rows for w in r]), owner)
    row = np.concatenate([owner[b >= 0] for b in grams])
    col = np.concatenate([b[b >= 0] for b in grams])
    used, col = np.unique(col, return_inverse=True)
    keep = rng.random(len(rows)) < 0.85
    k = len(FAMILIES)
    total = np.bincount(row, minlength=len(rows))
    value = 1 / np.sqrt(total[row])

    def logits(w: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(row, value * w[col, j], minlength=len(rows)) for j in range(k)], axis=1) + b

    target = np.eye(k)[label]
    # accelerated proximal gradient steps: weights that the data do not push stay at zero
    weights, bias = np.zeros((len(used), k)), np.zeros(k)
    w, b, pace = weights, bias, 1.0
    for _ in range(STEPS):
        z = logits(w, b)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - target) * keep[:, None] / keep.sum()
        grad = np.stack([np.bincount(col, value * g[row, j], minlength=len(used)) for j in range(k)], axis=1)
        new = w - RATE * grad
        new -= np.clip(new, -RATE * SPARSE, RATE * SPARSE)
        new_bias = b - RATE * g.sum(axis=0)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        w, b = new + (pace - 1) / faster * (new - weights), new_bias + (pace - 1) / faster * (new_bias - bias)
        weights, bias, pace = new, new_bias, faster
    z = logits(weights, bias)[~keep]
    losses = {}
    for t in np.geomspace(0.1, 4, 30):
        e = z / t
        losses[t] = np.mean(np.log(np.exp(e - e.max(axis=1, keepdims=True)).sum(axis=1)) + e.max(axis=1) - e[np.arange(len(e)), label[~keep]])
    table = np.zeros((1 << BUCKET_BITS, k), dtype=np.float32)
    table[used] = weights
    return {"w": table, "b": bias, "t": min(losses, key=losses.get), "hint": (table[:, 1:] > 0).any(axis=1)}


def classified(model: dict, texts: Sequence[str | None], numbers: Numbers) -> tuple[np.ndarray, list[tuple[int, str, float, float]]]:
    """Pieces of each text, and (text, family, probability, likeness) of the accepted ones."""
    rows, text = [], []
    for i, t in enumerate(texts):
        for p in pieces(t):
            rows.append(p)
            text.append(i)
    count = np.bincount(np.array(text, dtype=np.int64), minlength=len(texts))
    if not rows:
        return count, []
    size = np.array(list(map(len, rows)))
    owner = np.repeat(np.arange(len(rows)), size)
    grams = buckets(numbers.of([w for r in rows for w in r]), owner)
    # pieces that meet at least two grams of families
    hints = np.zeros(len(rows))
    for b in grams:
        hints += np.bincount(owner, (b >= 0) & model["hint"][b], minlength=len(rows))
    maybe = hints >= 2
    total = sum(np.bincount(owner[b >= 0], minlength=len(rows)) for b in grams)
    z = np.zeros((len(rows), len(FAMILIES)))
    for b in grams:
        some = np.flatnonzero((b >= 0) & maybe[owner])
        w = model["w"][b[some]]
        for j in range(z.shape[1]):
            z[:, j] += np.bincount(owner[some], w[:, j], minlength=len(rows))
    z = (z / np.sqrt(np.maximum(total, 1))[:, None] + model["b"]) / model["t"]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    out = []
    for i in np.flatnonzero(maybe & (best != UNKNOWN) & (p.max(axis=1) >= SURE)).tolist():
        family = FAMILIES[best[i]]
        like = likeness(family, rows[i])
        if like >= LIKE:
            out.append((text[i], family, float(p[i, best[i]]), like))
    return count, out


SCHEMA = "doc_id long, family string, probability double, likeness double, licence_pieces long, pieces long"


def license_report(docs: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """One row per document: its licence family, or null."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    n = docs.count()
    few = F.crc32(F.concat(F.lit("licence:"), F.col("doc_id").cast("string")).cast("binary")) < int(min(1.0, rows / max(n, 1)) * 2**32)
    model = fit(sorted(r["text"] for r in docs.filter(few).select("text").collect()))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = Numbers()
        for frame in frames:
            texts, ids = frame["text"].tolist(), frame["doc_id"].astype("Int64")
            for a, b in batched_texts(texts):
                count, found = classified(shared.value, texts[a:b], numbers)
                by: dict[int, dict[str, list]] = {}
                for i, family, p, like in found:
                    by.setdefault(i, {}).setdefault(family, []).append((p, like))
                out = []
                for i in range(b - a):
                    hits = by.get(i, {})
                    if hits:
                        top = min(hits, key=lambda f: (-len(hits[f]), -max(hits[f])[0], f))
                        out.append((top, *max(hits[top]), sum(map(len, hits.values())), int(count[i])))
                    else:
                        out.append((None, None, None, 0, int(count[i])))
                yield pd.DataFrame(out, columns=["family", "probability", "likeness", "licence_pieces", "pieces"]).assign(doc_id=ids[a:b].array)

    return docs.mapInPandas(scan, SCHEMA)
