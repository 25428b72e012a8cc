"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes (16-bit state, so it knows the last 16 bytes). A chunk may begin at
a word whose preceding bytes hash below a bound, unless one of the two words before does so as well;
a cut thus depends on nearby text alone, and an insertion moves chunks without changing them. Chunks
are at least three words, seven on average. That rule is silent where words repeat, as their hashes are
low in a row or never; there, a second one cuts where one run of a word meets the next, in runs, and before
the least of the hashes of ``NEAR`` words on either side, some words apart, so equal stretches of repeated words give equal chunks wherever they begin. Chunks are compared by a 64-bit digest of their bytes
without the white space at the end.

The document with the smallest id keeps a digest; in every later document its chunk is a copy.
Copies that follow each other form a run where an earlier document holds both side by side, and runs of ``MIN_WORDS`` words or more are spans to
remove. So a passage of over fifty words that stands in two documents is found through the chunks that
lie wholly in it, and words that documents share by chance stay. What a document repeats within
itself stays as well.

Digests are counted with map-side combining, so a passage in a third of all documents is one row a
task. Finding the copies is a join on the digest; a digest of more than a ``HOT``-th of the rows that will match, of which
there are fewer than ``HOT``, is dealt over ``SALTS`` salts on both sides of the join, the others once. Pairs of neighbours
have digests of their own, counted and joined likewise, for chunks that more than one document holds. Runs are found
per document, over its copies only. The chunks that more than one document holds and the counts are written
to the shared folder, so texts are cut twice.

Defined cases: a null text is an empty one; documents without an id come after all others and keep
nothing from each other; rows that repeat an id are one document, whose texts are told apart by a hash;
a document whose text loses its last word leaves the corpus in ``deduplicated``. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tickerloom.llm.common import WORD, batched_texts, concatenated, word_bounds, written

MIN_WORDS = 20
#: Share of words that may begin a chunk, before those too close to another are taken out.
BOUND = (1 << 16) // 3
#: Words on either side that the second rule looks at, how many of them all repeat one of the NEAR before, and words between its cuts.
NEAR, REPEATS, APART = 6, 9, 4
#: A digest is hot from this share of the joined rows on, 1 / HOT, and is spread over as many salts.
HOT, SALTS = 1000, 64
GEAR = np.random.default_rng(16).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear(buf: np.ndarray) -> np.ndarray:
    """h(i) = 2 h(i-1) + GEAR[byte i] mod 2^16: sums over 1, 2, 4, 8 and 16 bytes, each doubled from the last."""
    h = GEAR[buf]
    for k in (1, 2, 4, 8):
        longer = h.copy()
        longer[k:] += h[:-k] << np.uint16(k)
        h = longer
    return h


def _word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: sum over bytes times powers of an odd base, mixed."""
    longest = int((end - start).max())
    powers = np.full(longest + 1, 0x9E3779B97F4A7C15, dtype=np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    place = np.arange(len(buf))
    place[start[0]:] -= np.repeat(start, np.diff(np.append(start, len(buf))))
    value = (buf.astype(np.uint64) + np.uint64(1)) * powers[np.clip(place, 0, longest)]
    value[(buf == 32) | ((buf >= 9) & (buf <= 13))] = 0
    h = np.add.reduceat(value, start)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _among_repeats(word: np.ndarray, begins: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Words before which the second rule cuts: no cut of the first one and no text's border within NEAR words."""
    n, none = len(word), np.empty(0, np.int64)
    wide = 2 * NEAR + 1
    if n < wide:
        return none
    again = np.zeros(n, dtype=bool)
    for k in range(1, NEAR + 1):
        again[k:] |= (word[k:] == word[:-k]) & (text[k:] == text[:-k])

    def around(x: np.ndarray) -> np.ndarray:  # how many of the words within NEAR, for words from NEAR on
        run = np.concatenate(([0], np.cumsum(x)))
        return run[wide:] - run[:-wide]

    quiet = (around(begins) == 0) & (around(again) >= REPEATS) & (text[wide - 1:] == text[:1 - wide])
    if not quiet.any():
        return none
    key = word.copy()
    for k in range(1, NEAR):
        key[:-k] += np.where(text[k:] == text[:-k], word[k:] * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & (2**64 - 1)), np.uint64(0))
    at = np.flatnonzero(quiet) + NEAR
    least = key[at]
    for k in range(-NEAR, NEAR + 1):
        np.minimum(least, key[at + k], out=least)
    before, after = word[at - 1], word[at]
    alike = (word[at - 2] == before) & (word[at - 3] == before) & (word[at + 1] == after) & (word[at + 2] == after)
    # between two runs of one word; and where the hash is least, or within a run
    border, other = at[alike & (before != after)], at[(key[at] == least) | (alike & (before == after))]
    following = np.append(border, n + APART)[np.searchsorted(border, other)]
    other = other[following - other >= APART]
    chosen, last, fixed = [], -APART, set(border.tolist())
    for i in np.union1d(border, other).tolist():
        if i in fixed or i - last >= APART:
            chosen.append(i)
            last = i
    return np.array(chosen, dtype=np.int64)


def cut(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Chunks of a batch: text number, first byte, byte after the last word, byte where the next begins, words; the bytes and where texts begin."""
    buf, offsets = concatenated(texts)
    start, end = word_bounds(buf)
    if not len(start):
        none = np.empty(0, np.int64)
        return none, none, none, none, none, buf, offsets
    h = gear(buf)
    first = np.zeros(len(start), dtype=bool)
    first[np.searchsorted(start, offsets[:-1][np.diff(np.searchsorted(start, offsets)) > 0])] = True
    # where the hash reaches back into another text, there is no cut
    into = start - offsets[np.searchsorted(offsets, start, side="right") - 1]
    low = (h[np.maximum(start - 1, 0)] < BOUND) & (into >= 16) & ~first
    close = np.zeros_like(low)
    close[1:] |= low[:-1]
    close[2:] |= low[:-2] & ~first[1:-1]
    begins = first | (low & ~close)
    begins[_among_repeats(_word_hashes(buf, start, end), begins, np.searchsorted(offsets, start, side="right"))] = True
    at = np.flatnonzero(begins)
    words = np.diff(np.append(at, len(start)))
    text = np.searchsorted(offsets, start[at], side="right") - 1
    last = end[at + words - 1]
    following = np.append(start[at[1:]], 0)
    same = np.append(text[1:] == text[:-1], False)
    following = np.where(same, following, offsets[text + 1] - 1)
    return text, start[at], last, following, words, buf, offsets


def chunk_rows(docs: DataFrame) -> DataFrame:
    """doc_id, row (tells apart rows that repeat an id), digest, pair (digest of the chunk before and this one, null at a text's begin), at and stop (byte range), words, of every chunk."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = xxhash.xxh3_64_intdigest
        for frame in frames:
            texts, ids, row = frame["text"].tolist(), frame["doc_id"].astype("Int64"), frame["row"].to_numpy()
            for a, b in batched_texts(texts):
                text, first, last, stop, words, buf, offsets = cut(texts[a:b])
                raw = buf.tobytes()
                digest = np.array([of(raw[i:j]) for i, j in zip(first.tolist(), last.tolist())], dtype=np.uint64).view(np.int64)
                own = digest.view(np.uint64)
                pair = (np.append(np.uint64(0), own[:-1]) * np.uint64(0x9E3779B97F4A7C15) + own) * np.uint64(0xBF58476D1CE4E5B9)
                pair = pd.array((pair ^ (pair >> np.uint64(31))).view(np.int64), dtype="Int64")
                pair[np.append(True, text[1:] != text[:-1])[:len(text)]] = pd.NA
                base = offsets[text]
                yield pd.DataFrame({"doc_id": ids[a:b].take(text).array, "row": row[a:b][text], "digest": digest, "pair": pair,
                                    "at": first - base, "stop": stop - base, "words": words})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    return rows.mapInPandas(run, "doc_id long, row long, digest long, pair long, at long, stop long, words long")


def _held_by_several(rows: DataFrame, key: str, kept: str) -> DataFrame:
    """``key``, the smallest id that holds it, and its rows, of keys that more than one id holds; written."""
    rank = F.coalesce("doc_id", F.lit(2**63 - 1))
    found = rows.groupBy(key).agg(F.min(rank).alias(kept), F.max(rank).alias("_last"), F.count(F.lit(1)).alias("_n"))
    return written(found.filter(F.col(kept) < F.col("_last")).drop("_last"), "chunks")[0]


def _joined(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """``rows`` with the columns of ``keys`` (one row a key, its rows in ``_n``), no task being given a hot key or all nulls."""
    total = keys.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot = F.col("_n") > total / HOT
    # fewer than HOT keys can have more than a HOT-th of all rows each
    names = keys.filter(hot).select(key, F.lit(True).alias("_hot"))
    salt = F.pmod(F.xxhash64("doc_id", "row", "at"), F.lit(SALTS))
    dealt = rows.join(F.broadcast(names), key, "left")
    dealt = dealt.withColumn("_salt", F.when(F.col("_hot") | F.col(key).isNull(), salt).otherwise(F.lit(0).cast("long"))).drop("_hot")
    salts = F.when(hot, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return dealt.join(keys.withColumn("_salt", F.explode(salts)).drop("_n"), [key, "_salt"], how).drop("_salt")


def spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, row, at, stop (byte range), words, chunks and kept_doc_id of every run of copies."""
    chunks = chunk_rows(docs)
    rank = F.coalesce("doc_id", F.lit(2**63 - 1))
    repeated, _ = written(_joined(chunks, _held_by_several(chunks, "digest", "kept"), "digest", "inner").drop("digest"), "chunks")
    pairs = _held_by_several(repeated.filter("pair IS NOT NULL"), "pair", "_pair_kept")
    copies = _joined(repeated.filter(rank > F.col("kept")), pairs, "pair", "left")
    copies = copies.withColumn("_held", F.coalesce(rank > F.col("_pair_kept"), F.lit(False))).drop("pair", "_pair_kept")
    order = Window.partitionBy("doc_id", "row").orderBy("at")
    copies = copies.filter("words > 0").withColumn("_again", F.lag("at").over(order).eqNullSafe(F.col("at"))).filter("NOT _again")
    copies = copies.withColumn("_joined", (F.lag("stop").over(order).eqNullSafe(F.col("at")) & F.col("_held")).cast("int"))
    copies = copies.withColumn("_run", F.sum(1 - F.col("_joined")).over(order))
    runs = copies.groupBy("doc_id", "row", "_run").agg(
        F.min("at").alias("at"), F.max("stop").alias("stop"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("chunks"),
        # that of the longest chunk: short ones may stand in any document
        (-F.max(F.struct("words", (-F.col("kept")).alias("k")))["k"]).alias("kept_doc_id"))
    return runs.filter(F.col("words") >= min_words).drop("_run")


@F.pandas_udf(StringType())
def _without(texts: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.Series:
    """Texts less the byte ranges, which come in order."""
    out = []
    for text, a, b in zip(texts, begins, ends):
        raw, keep, at = text.encode("utf-8", "surrogatepass"), [], 0
        for i, j in zip(a, b):
            keep.append(raw[at:i])
            at = j
        out.append((b"".join(keep) + raw[at:]).decode("utf-8", "surrogatepass"))
    return pd.Series(out, dtype=object)


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated passages taken out of their texts."""
    names = docs.columns
    # a document's list of spans is bounded by its text
    cuts = spans(docs, min_words).groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("at", "stop"))).alias("_cuts"))
    cuts, _ = written(cuts.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "_cuts"), "chunks")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_row"))
    with_cuts = docs.join(cuts, same, "left")
    untouched = with_cuts.filter("_cuts IS NULL").select(*names)
    touched = with_cuts.filter("_cuts IS NOT NULL").withColumn("text", _without("text", "_cuts.at", "_cuts.stop")).select(*names)
    return untouched.unionByName(touched.filter(F.regexp_like("text", F.lit(WORD))))


def repeat_report(docs: DataFrame) -> DataFrame:
    """One row per span to remove: its document, character range, words, and the document that keeps the passage."""
    found = spans(docs)
    return found.select("doc_id", F.col("at").alias("start_byte"), F.col("stop").alias("end_byte"),
                        F.col("words").alias("n_words"), F.col("chunks").alias("n_chunks"), "kept_doc_id")
