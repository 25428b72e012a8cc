"""MinHash fingerprints over word shingles, and near-duplicates by bands of their signatures.

Texts become word hashes, shingles of five words (ASCII letters lower-cased; fewer words: all of
them) and ``PERMS`` universal hashes (a x + b over 64 bits, of which the minimum's middle 16 bits
are kept), all as numpy arrays over a batch of texts. The share of equal places estimates the
Jaccard similarity of two shingle sets.

Near-duplicates: bands of the signature are joined in Spark; in a bucket, pairs whose signatures
come near the threshold are verified by the exact Jaccard similarity of their shingle sets.
Equal signatures with equal shingle sets collapse first, a bucket emits only a spanning forest of
its links, and a bucket of more than ``LIST`` members is cut into pairs of blocks.

Defined cases: a null text is an empty one; a text without words has the fingerprint of no shingles
(all ones), which is like its equals (1) and unlike all others (0); a document that is alone is its own
next one; null ids come first; rows that repeat an id are documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import batched_texts, concatenated, word_bounds, written
from tickerloom.llm.components import connected

SHINGLE, PERMS, BANDS = 5, 128, 32
THRESHOLD, MARGIN = 0.8, 0.15
LIST = 1024
_RNG = np.random.default_rng(20240607)
MULTIPLIERS = _RNG.integers(0, 2**63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _RNG.integers(0, 2**63, PERMS, dtype=np.uint64)
PLACE = _RNG.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
EMPTY = 0xFFFF


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(texts: Sequence[str | None], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles, repeats included, and where each text's begin and end."""
    buf, offsets = concatenated(texts, lower=True)
    start, end = word_bounds(buf)
    bounds = np.searchsorted(start, offsets)  # words of each text
    count = np.diff(bounds)
    if not len(start):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    # word hash: sum of byte times a power of the base, by its place in the word
    longest = int((end - start).max())
    powers = np.empty(longest + 1, np.uint64)
    powers[0] = 1
    powers[1:] = BASE & (2**64 - 1)
    np.multiply.accumulate(powers, out=powers)
    place = np.arange(len(buf))
    length = np.diff(np.append(start, len(buf)))
    place[start[0]:] -= np.repeat(start, length)
    place[:start[0]] = longest
    np.minimum(place, longest, out=place)
    value = (buf.astype(np.uint64) + np.uint64(1)) * powers[place]
    value[(buf == 32) | ((buf >= 9) & (buf <= 13))] = 0
    word = _mixed(np.add.reduceat(value, start))
    # shingles: windows of words that stay inside one text; a short text is one window
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    first = np.concatenate(([0], np.cumsum(n)))
    at = np.arange(first[-1]) - np.repeat(first[:-1] - bounds[:-1], n)
    stop = np.repeat(bounds[1:], n)
    h = word[at] * PLACE[0]
    for k in range(1, width):
        inside = at + k < stop
        h += np.where(inside, word[np.minimum(at + k, len(word) - 1)] * PLACE[k], np.uint64(0))
    return _mixed(h), first


def signatures(hashes: np.ndarray, first: np.ndarray, chunk: int = 1 << 15) -> np.ndarray:
    """(texts, PERMS) of uint16."""
    out = np.full((len(first) - 1, PERMS), EMPTY, dtype=np.uint16)
    some = np.flatnonzero(np.diff(first))
    i = 0
    work = np.empty(0, np.uint64)
    while i < len(some):
        # texts whose shingles stay in the cache together; a long text alone
        j = max(i + 1, int(np.searchsorted(first[some], first[some[i]] + chunk)))
        lot = some[i:j]
        a, b = first[lot[0]], first[lot[-1] + 1]
        x, cuts = hashes[a:b], first[lot] - a
        work = work if len(work) >= len(x) else np.empty(len(x), np.uint64)
        w = work[:len(x)]
        for k in range(PERMS):
            np.multiply(x, MULTIPLIERS[k], out=w)
            np.add(w, ADDENDS[k], out=w)
            out[lot, k] = (np.minimum.reduceat(w, cuts) >> np.uint64(32)).astype(np.uint16)
        i = j
    return out


def fingerprints(texts: Sequence[str | None]) -> np.ndarray:
    return signatures(*shingle_hashes(texts))


def edited(text: str, following: str) -> str:
    """The last half of a text's characters replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _rows(ids: list, texts: list[str], prints: np.ndarray) -> pd.DataFrame:
    """Finished rows of all documents but the last, each beside its follower."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    other = np.concatenate([fingerprints(changed[a:b]) for a, b in batched_texts(changed)]) if changed else prints[:0]
    own = prints[:-1]
    return pd.DataFrame({
        "kind": 0, "part": 0, "doc_id": ids[:-1], "n_chars": [len(t) for t in texts[:-1]],
        "sha": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in changed],
        "print": [p.tobytes() for p in own], "edited_print": [p.tobytes() for p in other],
        "near_edited": (own == other).mean(axis=1), "near_next": (own == prints[1:]).mean(axis=1), "text": None})


SCHEMA = ("kind int, part long, doc_id long, n_chars long, sha binary, print binary, edited_print binary, "
          "near_edited double, near_next double, text string")
ROW, LAST, FIRST = 0, 1, 2


def _in_order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One range of documents: finished rows, and its first and last document for the neighbouring ranges."""
    part = TaskContext.get().partitionId()
    ids, texts, prints = [], [], np.empty((0, PERMS), np.uint16)
    first = None

    def edge(kind: int, doc_id, text: str) -> pd.DataFrame:
        return pd.DataFrame([{"kind": kind, "part": part, "doc_id": doc_id, "n_chars": len(text), "sha": None, "print": None,
                              "edited_print": None, "near_edited": None, "near_next": None, "text": text}]).astype({"doc_id": "Int64"})

    for frame in frames:
        all_texts, all_ids = [t or "" for t in frame["text"]], [None if pd.isna(i) else int(i) for i in frame["doc_id"]]
        for a, b in batched_texts(all_texts):
            ids, texts = ids + all_ids[a:b], texts + all_texts[a:b]
            prints = np.concatenate([prints, fingerprints(all_texts[a:b])])
            if first is None:
                first = edge(FIRST, ids[0], texts[0])
            if len(ids) > 1:
                yield _rows(ids, texts, prints).astype({"doc_id": "Int64"})
            ids, texts, prints = ids[-1:], texts[-1:], prints[-1:]
    if first is not None:
        yield first
        yield edge(LAST, ids[0], texts[0])


def _across(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of documents whose follower lies in another range."""
    for frame in frames:
        out = [_rows([None if pd.isna(i) else int(i), None], [a, b], fingerprints([a, b]))
               for i, a, b in zip(frame["doc_id"], frame["text"], frame["following"])]
        if out:
            yield pd.concat(out, ignore_index=True).astype({"doc_id": "Int64"})


def edited_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, in document order.

    Texts are shuffled once, into ranges of ids; a range needs of others only the first document of
    the next one, which is joined by the ranges' numbers.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id")
    rows = rows.sortWithinPartitions("doc_id", F.xxhash64("text")).mapInPandas(_in_order, SCHEMA)
    rows, _ = written(rows, "minhash")
    firsts = rows.filter(F.col("kind") == FIRST).select("part", F.col("text").alias("following"))
    parts = rows.filter(F.col("kind") == FIRST).select("part")  # one row a range
    w = Window.orderBy("part")
    after = parts.select(F.col("part").alias("_part"), F.lead("part").over(w).alias("_next"), F.min("part").over(Window.partitionBy()).alias("_least"))
    after = after.select("_part", F.coalesce("_next", "_least").alias("_next"))
    ends = (rows.filter(F.col("kind") == LAST).select("part", "doc_id", "text")
            .join(after, F.col("part") == F.col("_part")).drop("part")
            .join(firsts, F.col("_next") == F.col("part")).select("doc_id", "text", "following"))
    whole = rows.filter(F.col("kind") == ROW).unionByName(ends.mapInPandas(_across, SCHEMA))
    return whole.select("doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), F.lower(F.hex("print")).alias("fingerprint"),
                        F.lower(F.hex("edited_print")).alias("edited_fingerprint"), "near_edited", "near_next")


# near-duplicates ---------------------------------------------------------------------------------


def _sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts, ids = frame["text"].tolist(), frame["doc_id"].tolist()
        for a, b in batched_texts(texts):
            hashes, first = shingle_hashes(texts[a:b])
            sig = signatures(hashes, first)
            yield pd.DataFrame({
                "doc_id": ids[a:b], "print": [s.tobytes() for s in sig],
                "shingles": [np.unique(hashes[i:j]).tobytes() for i, j in zip(first, first[1:])]}).astype({"doc_id": "Int64"})


def jaccard(a: bytes, b: bytes) -> float:
    """Similarity of two sorted shingle sets; two empty ones are equal."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def _bucket_links(threshold: float):
    def search(nodes: list[int], prints: np.ndarray, sets: list[bytes]) -> Iterator[tuple[int, int]]:
        rest = np.arange(len(nodes))
        while len(rest) > 1:
            front, rest = [int(rest[0])], rest[1:]
            while front and len(rest):
                i = front.pop()
                near = (prints[rest] == prints[i]).mean(axis=1) >= threshold - MARGIN
                hit = np.array([ok and jaccard(sets[i], sets[j]) >= threshold for ok, j in zip(near, rest)], dtype=bool)
                yield from ((nodes[i], nodes[j]) for j in rest[hit])
                front += rest[hit].tolist()
                rest = rest[~hit]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for frame in frames:
            out: list[tuple] = []
            for key, node, sig, shingles in zip(frame["list"], frame["node"], frame["print"], frame["shingles"]):
                if key != now:
                    out += search([h[0] for h in held], np.array([np.frombuffer(h[1], np.uint16) for h in held]), [h[2] for h in held]) if len(held) > 1 else []
                    now, held = key, []
                held.append((node, sig, shingles))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        if len(held) > 1:
            yield pd.DataFrame(list(search([h[0] for h in held], np.array([np.frombuffer(h[1], np.uint16) for h in held]), [h[2] for h in held])), columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, limit: int = LIST) -> DataFrame:
    """(doc_id, class_id): class_id is the smallest id reachable by links of ``threshold`` or more."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_sets, "doc_id long, print binary, shingles binary")
    rows, _ = written(rows, "minhash-sets")
    rows = rows.withColumn("node", F.xxhash64("print", "shingles"))
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    held = rows.select("node", "print", "shingles").dropDuplicates(["node"])
    width = 2 * PERMS // BANDS
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("print", 1 + i * width, width)) for i in range(BANDS)])
    entries = held.select("node", F.explode(keys).alias("key"))
    # buckets of one are of no use; long ones are cut into blocks, each pair of blocks a list of its own
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    entries = entries.join(sizes, "key")
    blocks = F.ceil(F.col("_n") / limit).cast("int")
    entries = entries.withColumn("_own", F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int"))
    entries = entries.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    entries = entries.select("node", F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("list"))
    lists = entries.join(held, "node").repartition("list").sortWithinPartitions("list")
    roots = connected(lists.select("list", "node", "print", "shingles").mapInPandas(_bucket_links(threshold), "a long, b long"))
    named = nodes.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    named = named.select("node", "least", F.coalesce("root", "node").alias("root"))
    classes = named.groupBy("root").agg(F.min("least").alias("class_id"))
    return rows.select("doc_id", "node").join(named.join(classes, "root").select("node", "class_id"), "node").select("doc_id", "class_id")
