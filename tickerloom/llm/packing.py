"""Harmonic packing of documents into sequences of a fixed capacity.

Piece lengths fall into reciprocal-capacity classes: class n holds pieces of capacity // n ids, and a
bin of it takes a fixed number of them, capacity // length. A document is cut to such lengths, the
longest that fits first, so a piece fills its place and a bin of any class is full but for less
than one piece. Every task fills its own bins and talks to no other; what its classes hold open at
the end is laid end to end into full sequences, and the last ids go into sequences of power-of-two
lengths, which need no padding.

A task holds fewer than ``capacity`` open pieces and its classes' open bins, whatever it reads.
Nothing is shuffled.

Defined cases: a null or empty text is the end id alone; repeated rows are packed as rows of their
own (``row`` tells them apart); a null id is kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import batched_texts
from tickerloom.llm.tokens import CACHE_WORDS, encoder

CAPACITY, END_ID = 2048, 1
SCHEMA = "doc_id long, row long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of n ids: each is capacity // k for the smallest k that fits."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        k = -(-capacity // n)
        while capacity // k > n:
            k += 1
        out.append(capacity // k)
        n -= out[-1]
    return out


def packed(
    docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, cache_words: int = CACHE_WORDS
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and its ids (little-endian uint32)."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary, cache_words).encode
        part = TaskContext.get().partitionId()
        end = end_id.to_bytes(4, "little")
        bins = rows = 0
        open_bins: dict[int, list[tuple]] = defaultdict(list)
        out: list[tuple] = []

        def put(pieces: list[tuple]) -> None:
            nonlocal bins
            at = 0
            for doc_id, row, start, total, ids in pieces:
                out.append((doc_id, row, start, len(ids) // 4, total, (part << 33) + bins, at, ids))
                at += len(ids) // 4
            bins += 1

        def taken() -> pd.DataFrame:
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            out.clear()
            return frame.astype({"doc_id": "Int64"})

        for frame in frames:
            texts, doc_ids = frame["text"].tolist(), frame["doc_id"].tolist()
            for a, b in batched_texts(texts):
                for doc_id, ids in zip(doc_ids[a:b], encode(texts[a:b])):
                    ids += end
                    doc_id, total, start = None if pd.isna(doc_id) else int(doc_id), len(ids) // 4, 0
                    for n in cut_lengths(total, capacity):
                        piece = (doc_id, (part << 33) + rows, start, total, ids[4 * start:4 * (start + n)])
                        start += n
                        open_bins[n].append(piece)
                        if len(open_bins[n]) == capacity // n:
                            put(open_bins.pop(n))
                    rows += 1
                yield taken()
        # what is open: end to end, cut at the capacity
        held, room = [], capacity
        for doc_id, row, start, total, ids in (p for n in sorted(open_bins, reverse=True) for p in open_bins[n]):
            while ids:
                head, ids = ids[:4 * room], ids[4 * room:]
                held.append((doc_id, row, start, total, head))
                start, room = start + len(head) // 4, room - len(head) // 4
                if not room:
                    put(held)
                    held, room = [], capacity
        # the last ids: sequences of power-of-two lengths
        left, size = capacity - room, 1
        while left >= 2 * size:
            size *= 2
        while left:
            room, bin_ = size, []
            while room:
                doc_id, row, start, total, ids = held.pop(0)
                head, ids = ids[:4 * room], ids[4 * room:]
                bin_.append((doc_id, row, start, total, head))
                room -= len(head) // 4
                if ids:
                    held.insert(0, (doc_id, row, start + len(head) // 4, total, ids))
            put(bin_)
            left -= size
            while size > left > 0:
                size //= 2
        yield taken()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(pack, SCHEMA)


def pack_report(docs: DataFrame, **options) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return packed(docs, **options).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
