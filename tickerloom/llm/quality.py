"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words (the last one shorter). Each passage is described
by shares of byte classes and by how its words repeat, and encoded as h = tanh(W x + b). Gated attention
a = softmax(w (tanh(V h) * sigmoid(U h))) weighs a document's passages, and the label is read from the
weighted sum of their codes. Encoder, attention and read-out learn together from document labels.

All passages of whole texts are scored, as numpy arrays over a megabyte of a batch. The model is
a few kilobytes, fitted on at most ``SAMPLE`` labelled documents (a documented bound) outside the
held-out third. The sample may hold the labels in other shares than all labels do; the log odds are
shifted back, so a score means the same whatever the number of labels. Defined cases: null and blank texts score 0; without labels of both kinds the others get the
smoothed base rate; rows that repeat an id are scored each for itself; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tickerloom.llm.common import batched_texts, clean_names, concatenated, held_out, labelled_sample, word_bounds
from tickerloom.llm.learn import Adam, base_rate, prior_shift, runs, sigmoid, starts_of

PASSAGE, SAMPLE, CODE, GATE = 64, 4000, 16, 8
THRESHOLD = 0.5
EPOCHS, BATCH = 40, 64

#: Byte classes: upper, lower, digit, blank, line end, sentence marks, quotes, brackets, each of the signs below, other signs, non-ASCII.
SIGNS = b"|!*%$#&@<>=/\\_"
KINDS = 9 + len(SIGNS)
CLASS = np.full(256, 7, dtype=np.int64)
CLASS[65:91], CLASS[97:123], CLASS[48:58], CLASS[32], CLASS[9:14] = 0, 1, 2, 3, 4
CLASS[list(b".,;:?-")], CLASS[list(b"\"'`()[]{}")], CLASS[128:] = 5, 6, 8
CLASS[list(SIGNS)] = 9 + np.arange(len(SIGNS))
FEATURES = KINDS + 7


def passages(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Text of each passage, and its features."""
    buf, offsets = concatenated(texts)
    start, end = word_bounds(buf)
    count = np.diff(np.searchsorted(start, offsets))
    text, words = runs(count, PASSAGE)
    n = len(text)
    if not n:
        return text, np.empty((0, FEATURES))
    first = starts_of(words)
    size = end - start
    owner = np.repeat(np.arange(n), words)
    # bytes: from a passage's first word to just before the next passage, or to the text's end
    opens = start[first]
    closes = np.append(opens[1:], 0)
    last = np.append(text[1:] != text[:-1], True)
    closes[last] = offsets[text[last] + 1]
    edge = np.zeros(len(buf) + 1, dtype=np.int64)
    edge[opens] = 1
    inside = np.cumsum(edge[:-1]) - 1
    # what lies before a text's first word belongs to no passage
    np.subtract.at(edge, closes, 1)
    begun = np.cumsum(edge[:-1]) > 0
    kinds = np.bincount(inside[begun] * KINDS + CLASS[buf[begun]], minlength=n * KINDS).reshape(n, KINDS)
    length = np.maximum(closes - opens, 1)[:, None]
    # words as numbers: sum over bytes times powers of an odd base
    longest = int(size.max())
    powers = np.full(longest + 1, 0x9E3779B97F4A7C15, dtype=np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    place = np.arange(len(buf))
    place[start[0]:] -= np.repeat(start, np.diff(np.append(start, len(buf))))
    value = (buf.astype(np.uint64) + np.uint64(1)) * powers[np.clip(place, 0, longest)]
    value[(CLASS[buf] == 3) | (CLASS[buf] == 4)] = 0
    word = np.add.reduceat(value, start)
    same = np.append(False, word[1:] == word[:-1])
    same[first] = False
    key = (word ^ (word >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    key = (key & np.uint64(0xFFFFFFFF)) | (owner.astype(np.uint64) << np.uint64(32))
    key.sort()
    new = np.append(True, key[1:] != key[:-1])
    distinct = np.bincount((key[new] >> np.uint64(32)).astype(np.int64), minlength=n)
    mean = np.add.reduceat(size, first) / words
    spread = np.sqrt(np.maximum(np.add.reduceat(size * size, first) / words - mean * mean, 0))
    ends = CLASS[buf[end - 1]]
    extra = np.stack([
        distinct / words,
        np.add.reduceat(same.astype(np.int64), first) / words,
        np.minimum(mean, 40) / 10,
        np.minimum(spread, 40) / 10,
        np.add.reduceat((size == 1).astype(np.int64), first) / words,
        np.add.reduceat((ends >= 9).astype(np.int64), first) / words,
        np.log2(words) / 6,
    ], axis=1)
    return text, np.concatenate([kinds / length * 4, extra], axis=1)


class Attention:
    """Encoder, gated attention and read-out, with their gradients."""

    def __init__(self, features: int, seed: int = 8):
        rng = np.random.default_rng(seed)
        shape = {"W": (features, CODE), "b": (CODE,), "V": (CODE, GATE), "U": (CODE, GATE), "w": (GATE,), "c": (CODE,), "d": (1,)}
        self.p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or k in "wc" else np.zeros(s) for k, s in shape.items()}

    def forward(self, x: np.ndarray, first: np.ndarray, owner: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, {}
        f["h"] = np.tanh(x @ p["W"] + p["b"])
        f["t"], f["s"] = np.tanh(f["h"] @ p["V"]), sigmoid(f["h"] @ p["U"])
        e = (f["t"] * f["s"]) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, first)[owner])
        f["a"] = e / np.add.reduceat(e, first)[owner]
        f["z"] = np.add.reduceat(f["a"][:, None] * f["h"], first, axis=0)
        f["logit"] = f["z"] @ p["c"] + p["d"]
        return f

    def gradients(self, x, first, owner, y) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, first, owner)
        g_logit = (sigmoid(f["logit"]) - y) / len(y)
        g_z = g_logit[:, None] * p["c"]
        g_a = (g_z[owner] * f["h"]).sum(axis=1)
        g_e = f["a"] * (g_a - np.add.reduceat(f["a"] * g_a, first)[owner])
        g_gate = g_e[:, None] * p["w"]
        g_t, g_s = g_gate * f["s"] * (1 - f["t"] ** 2), g_gate * f["t"] * f["s"] * (1 - f["s"])
        g_h = f["a"][:, None] * g_z[owner] + g_t @ p["V"].T + g_s @ p["U"].T
        g_x = g_h * (1 - f["h"] ** 2)
        return {"W": x.T @ g_x, "b": g_x.sum(axis=0), "V": f["h"].T @ g_t, "U": f["h"].T @ g_s,
                "w": (f["t"] * f["s"]).T @ g_e, "c": f["z"].T @ g_logit, "d": g_logit.sum(keepdims=True)}


def fit(sample: Sequence[tuple[str, int]], taken: tuple[float, float] = (1.0, 1.0), seed: int = 8) -> dict:
    """Train on (text, label) rows, which are the shares ``taken`` of all rows of label 0 and 1."""
    y = np.array([label for _, label in sample], dtype=np.float64)
    base = base_rate(y, taken)
    texts, lots = [t for t, _ in sample], []
    for a, b in batched_texts(texts):
        text, x = passages(texts[a:b])
        lots.append((text + a, x))
    owner = np.concatenate([o for o, _ in lots]) if lots else np.empty(0, np.int64)
    docs = np.unique(owner)
    if not 0 < y[docs].sum() < len(docs):
        return {"params": None, "base": base}
    x = np.concatenate([x for _, x in lots])
    mean, std = x.mean(axis=0), x.std(axis=0) + 0.05
    x = np.clip((x - mean) / std, -8, 8)
    size = np.bincount(owner, minlength=len(y))
    start = np.concatenate(([0], np.cumsum(size)))
    rng, net = np.random.default_rng(seed), Attention(x.shape[1], seed)
    adam = Adam(net.p, 0.01, decay=1e-3)
    for _ in range(max(EPOCHS, 400 * BATCH // len(docs))):
        order = rng.permutation(docs)
        for i in range(0, len(order), BATCH):
            lot = order[i:i + BATCH]
            rows = np.concatenate([np.arange(start[d], start[d + 1]) for d in lot])
            adam.step(net.gradients(x[rows], starts_of(size[lot]), np.repeat(np.arange(len(lot)), size[lot]), y[lot]))
    net.p["d"] = net.p["d"] + prior_shift(taken)
    return {"params": net.p, "mean": mean, "std": std, "base": base}


def score(model: dict, texts: Sequence[str | None]) -> np.ndarray:
    if model["params"] is None:
        return np.array([model["base"] if (t or "").split() else 0.0 for t in texts])
    out = np.zeros(len(texts))
    net = Attention(len(model["mean"]))
    net.p = model["params"]
    for a, b in batched_texts(texts):
        text, x = passages(texts[a:b])
        if len(text):
            first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(text))))
            x = np.clip((x - model["mean"]) / model["std"], -8, 8)
            out[a + text[first]] = sigmoid(net.forward(x, first, owner)["logit"])
    return out


def scored(docs: DataFrame, model: dict, out: str = "score") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def apply(texts: pd.Series) -> pd.Series:
        return pd.Series(score(shared.value, texts.tolist()))

    return docs.withColumn(out, apply("text"))


def trained(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> dict:
    return fit(*labelled_sample(docs, labels, "quality", rows, "quality:"))


def quality_report(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    docs = clean_names(docs.select("doc_id", "text"), ["score", "held_out", "predicted"])
    out = scored(docs, trained(docs, labels, rows))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """``docs`` that score ``THRESHOLD`` or more."""
    names = docs.columns
    mark = "_quality_score"
    return scored(docs, trained(docs, labels, rows), mark).filter(F.col(mark) >= THRESHOLD).select(*names)
