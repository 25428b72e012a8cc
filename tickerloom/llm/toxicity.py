"""Toxicity from bags of subwords, averaged into a linear softmax.

A word is the mean of the embeddings of its byte 3- to 6-grams (hashed, with its boundaries), a window of
``WINDOW`` places is the mean of its words (a place is empty in a text of fewer words, and where a word repeats
the one before). Windows begin at every word, so what counts is nearness, not the number of words before. A linear softmax over the window gives the odds of the label. Embeddings and softmax are trained together in numpy. Labels belong to documents, so
training goes in rounds: first all windows of a toxic document count as toxic, then those that the
model finds most toxic, against clean documents' worst and random windows. A document's odds are
those of its worst window, turned into a probability on documents kept out of the fit.

The model is linear in the embeddings: to score, each hashed n-gram has one number, a table of half a
megabyte that is broadcast. Whole texts are scored, a megabyte of a batch at a time.

Fitted on at most ``SAMPLE`` labelled documents (a documented bound), outside the held-out third.
The calibration is shifted by the share taken of either label to the shares among all labels.
Defined cases: null and blank texts score 0; without labels of both kinds all others get the smoothed
base rate; rows that repeat an id are scored each for itself; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tickerloom.llm.common import batched_texts, clean_names, concatenated, held_out, labelled_sample, word_bounds
from tickerloom.llm.learn import base_rate, platt, prior_shift, sigmoid, starts_of

BUCKET_BITS, GRAMS, DIM = 17, (3, 4, 5, 6), 8
WINDOW, SAMPLE, BATCH, ROUNDS = 4, 4000, 256, 4
STEPS = 120  # of the optimiser in a round, at least
THRESHOLD = 0.7


def prepared(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with one kind of white space and one before the first word; word bounds; words of each text."""
    buf, offsets = concatenated([(t or "").lower() for t in texts])
    start, end = word_bounds(buf)
    count = np.diff(np.searchsorted(start, offsets))
    buf = np.concatenate(([32], np.where((buf >= 9) & (buf <= 13), 32, buf), [32] * max(GRAMS))).astype(np.uint32)
    return buf, start + 1, end + 1, count


def buckets(buf: np.ndarray):
    """For each gram size, the bucket of the gram that begins at each byte."""
    n, h = len(buf), buf.copy()
    for k in range(1, max(GRAMS)):
        h = h[:n - k] * np.uint32(0x01000193) + buf[k:]
        if k + 1 in GRAMS:
            yield k + 1, ((h ^ np.uint32(k * 0x5BD1E995 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)


def word_scores(table: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mean of the table over each word's grams."""
    total, grams = np.zeros(len(start)), np.zeros(len(start))
    for n, b in buckets(buf):
        run = np.concatenate(([0.0], np.cumsum(table[b], dtype=np.float64)))
        stop = np.maximum(end + 2 - n, start - 1)  # grams begin from the space before to where they end with the space after
        total += run[stop] - run[start - 1]
        grams += stop - start + 1
    return total / np.maximum(grams, 1)


def window_scores(table: np.ndarray, bias: float, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Text and odds of every window: one begins at each word that has ``WINDOW - 1`` after it; a shorter text is one."""
    buf, start, end, count = prepared(texts)
    n = np.where(count >= WINDOW, count - WINDOW + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(count)), n)
    if not len(text):
        return text, np.empty(0)
    score = word_scores(table, buf, start, end)
    # the word before once more; scores come from running sums and are equal but for rounding
    again = np.append(False, (np.abs(np.diff(score)) < 1e-6) & (np.diff(end - start) == 0))
    once = np.concatenate((np.where(again, 0.0, score), np.zeros(WINDOW)))
    first = np.arange(len(text)) + np.repeat(starts_of(count) - starts_of(n), n)
    stop = np.repeat(np.cumsum(count), n)
    total = score[first]  # a window's first word has none before it
    for k in range(1, WINDOW):
        total = total + np.where(first + k < stop, once[first + k], 0.0)
    return text, total / WINDOW + bias


def worst(table: np.ndarray, bias: float, texts: Sequence[str | None]) -> np.ndarray:
    """Odds of each text's worst window; NaN without words."""
    out = np.full(len(texts), np.nan)
    for a, b in batched_texts(texts):
        text, odds = window_scores(table, bias, texts[a:b])
        if len(text):
            first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            out[a + text[first]] = np.maximum.reduceat(odds, first)
    return out


class Bag:
    """The trainable model."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.01, (1 << BUCKET_BITS, DIM)).astype(np.float32)
        self.u = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
        self.b = np.zeros(2, np.float32)
        self.sum_e = np.full((1 << BUCKET_BITS, 1), 1e-4, np.float32)  # squared gradients so far, by bucket; a few sightings count little
        self.sum_u = np.full(self.u.shape, 1e-8, np.float32)

    def table(self) -> tuple[np.ndarray, float]:
        return self.e @ (self.u[:, 1] - self.u[:, 0]), float(self.b[1] - self.b[0])

    def fit(self, windows: Sequence[str], y: np.ndarray, rate: float) -> None:
        """One pass over windows in the order given."""
        for a in range(0, len(windows), BATCH):
            buf, start, end, count = prepared(windows[a:a + BATCH])
            text, label = np.repeat(np.arange(len(count)), count), y[a:a + BATCH]
            ids, weight, owner = [], [], []
            per_word = np.zeros(len(start))
            spans = []
            for n, b in buckets(buf):
                stop = np.maximum(end + 2 - n, start - 1)
                k = stop - start + 1
                per_word += k
                spans.append((b, start - 1, k))
            share = 1 / (np.maximum(per_word, 1) * WINDOW)
            for b, first, k in spans:
                at = np.repeat(first - starts_of(k), k) + np.arange(k.sum())
                ids.append(b[at])
                weight.append(np.repeat(share, k))
                owner.append(np.repeat(text, k))
            ids, weight, owner = map(np.concatenate, (ids, weight, owner))
            weight = weight.astype(np.float32)
            m = len(count)
            z = np.stack([np.bincount(owner, weight * self.e[ids, d], minlength=m) for d in range(DIM)], axis=1).astype(np.float32)
            logits = z @ self.u + self.b
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(m), label] -= 1
            gu, gz = z.T @ p / m, p @ self.u.T
            self.sum_u += gu * gu
            self.u -= 0.2 * rate * gu / np.sqrt(self.sum_u)
            self.b -= 0.1 * rate * p.mean(axis=0)
            slots, back = np.unique(ids, return_inverse=True)
            ge = np.stack([np.bincount(back, weight * gz[owner, d], minlength=len(slots)) for d in range(DIM)], axis=1).astype(np.float32)
            self.sum_e[slots] += (ge * ge).mean(axis=1, keepdims=True)
            self.e[slots] -= rate * ge / np.sqrt(self.sum_e[slots])


def _window(words: Sequence[str], at: int) -> str:
    lot = words[at:at + WINDOW]
    return " ".join(w for w, before in zip(lot, [None, *lot]) if w != before)


def _worst_apart(order: Sequence[int], most: int) -> list[int]:
    """The first ``most`` of windows in an order that share no word."""
    out: list[int] = []
    for i in order:
        if all(abs(i - j) >= WINDOW for j in out):
            out.append(i)
            if len(out) == most:
                break
    return out


def fit(sample: Sequence[tuple[str, int]], taken: tuple[float, float] = (1.0, 1.0), seed: int = 5) -> dict:
    """Train on (text, label) rows, which are the shares ``taken`` of all rows of label 0 and 1; returns table, bias and the calibration."""
    y = np.array([label for _, label in sample], dtype=np.int64)
    base = base_rate(y, taken)
    usable = [i for i in range(len(y)) if sample[i][0].split()]
    if min(sum(y[i] == 1 for i in usable), sum(y[i] == 0 for i in usable)) < 2:
        return {"table": None, "base": base}
    rng = np.random.default_rng(seed)
    rng.shuffle(usable)
    aside = own = usable
    if len(usable) >= 1000:
        aside, own = usable[::5], [i for k, i in enumerate(usable) if k % 5]
    # words by the rule of prepared()
    words = {i: [w.decode("utf-8", "surrogatepass") for w in sample[i][0].lower().encode("utf-8", "surrogatepass").split()] for i in own}
    model = Bag(seed)
    for turn in range(ROUNDS):
        chosen: list[tuple[str, int]] = []
        table, bias = model.table()
        for label in (1, 0):
            part = [i for i in own if y[i] == label]
            texts = [sample[i][0] for i in part]
            odds = np.concatenate([window_scores(table, bias, texts[a:b])[1] for a, b in batched_texts(texts)])
            size = np.array([max(len(words[i]) - WINDOW + 1, 1) for i in part])
            for i, w, s in zip(part, starts_of(size), size):
                order = np.argsort(-odds[w:w + s])
                if turn == 0:
                    take = rng.permutation(np.arange(rng.integers(min(WINDOW, s)), s, WINDOW))[:16]
                elif label:
                    take = _worst_apart(order, min(4, max(1, len(words[i]) // (4 * WINDOW))))
                else:
                    take = np.unique([*_worst_apart(order, 2), *rng.choice(order, 2)])
                chosen += [(_window(words[i], j), label) for j in take]
        # either label as often as the other
        labels = np.array([c[1] for c in chosen])
        less = int(labels.mean() < 0.5)
        extra = rng.choice(np.flatnonzero(labels == less), max(0, len(labels) - 2 * (labels == less).sum()))
        order = rng.permutation(np.concatenate([np.arange(len(chosen)), extra]))
        for _ in range(max(2, STEPS * BATCH // len(order))):
            model.fit([chosen[j][0] for j in order], labels[order], rate=0.3)
    table, bias = model.table()
    a, b = platt(worst(table, bias, [sample[i][0] for i in aside]), y[aside])
    return {"table": table.astype(np.float32), "bias": bias, "a": max(a, 1e-3), "b": b + prior_shift(taken), "base": base}


def score(model: dict, texts: Sequence[str | None]) -> np.ndarray:
    if model["table"] is None:
        return np.array([model["base"] if (t or "").strip() else 0.0 for t in texts])
    odds = worst(model["table"], model["bias"], texts)
    return np.where(np.isnan(odds), 0.0, sigmoid(model["a"] * np.nan_to_num(odds) + model["b"]))


def scored(docs: DataFrame, model: dict, out: str = "score") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def apply(texts: pd.Series) -> pd.Series:
        return pd.Series(score(shared.value, texts.tolist()))

    return docs.withColumn(out, apply("text"))


def trained(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> dict:
    return fit(*labelled_sample(docs, labels, "toxic", rows, "toxic:"))


def toxicity_report(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    docs = clean_names(docs.select("doc_id", "text"), ["score", "held_out", "predicted"])
    out = scored(docs, trained(docs, labels, rows))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
