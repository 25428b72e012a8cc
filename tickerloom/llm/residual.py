"""Hierarchical residual packing: documents into as few sequences of a fixed capacity as they take.

A document's ids are one piece, or pieces of the capacity and a last shorter one. The pieces (without
their ids) are dealt to partitions by hash, so that each holds a fair mix of lengths, and a partition
packs its own by best fit, longest first. Its full and nearly full bins are final. Of the rest only
what another partition can use goes on, as items: in a best-fit packing any two bins together exceed the
capacity, so at most one bin is filled to half or less, and only such a bin can ever be laid into
another one. It goes on with the ``FAN`` emptiest of the others, into which it or its like may fit; all other bins
are final. Then ``FAN`` neighbours of the tree merge at a time, by the same best fit over bins, and pass
on the same few. A node receives at most ``FAN`` bins of half or less, so the ``FAN`` emptiest of each child
are all the room it can need: nothing that would fit is passed by, however many pieces there are.

A task holds ``BATCH`` pieces of some 60 bytes, or FAN × (FAN + 1) bins. A partition of more pieces
packs batch after batch and carries the same few bins on. Bins that merge keep a list of their parts, so
that only the pieces of bins that went on are joined with their places in the end.

Defined cases: a null or empty text is the end id alone; repeated rows are packed as rows of their
own (``row`` tells them apart); a null id is kept; an empty table gives no rows; other input columns
are ignored. Texts are encoded in slices of a million characters, so a long one needs little beside itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import written
from tickerloom.llm.wordends import CACHE_UNITS, unit_encoder

CAPACITY, END_ID = 4096, 1
VOCABULARY = "word_bpe_49k.json"
FAN = 16
BATCH = 400_000

PIECE = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECE + ", bin long, offset long, open boolean"
#: A bin on its way up: its place in the tree, its load, and the first bins it is made of with their offsets.
NODE = "node long, load long, parts array<struct<bin: long, shift: long>>, done boolean"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def vocabulary_file(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None,
    with_ids: bool = False, cache_units: int = CACHE_UNITS,
) -> DataFrame:
    """One row per piece of at most ``capacity`` ids, with its checksum and, if asked for, its ids (little-endian uint32)."""
    schema = PIECE + ", ids binary" if with_ids else PIECE
    names = _names(schema)

    def cut(stretches: Iterable[bytes]) -> Iterator[bytes]:
        held, size = b"", 4 * capacity
        for part in stretches:
            held += part
            whole = len(held) // size * size
            for at in range(0, whole, size):
                yield held[at:at + size]
            held = held[whole:]
        if held:
            yield held

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = unit_encoder(vocabulary_file(vocabulary), cache_units)
        part, end = TaskContext.get().partitionId(), end_id.to_bytes(4, "little")
        row, rows, chars = part << 33, [], 0

        def taken() -> pd.DataFrame:
            frame = pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "piece": "int32"})
            rows.clear()
            return frame

        for frame in frames:
            for doc_id, text in zip(frame["doc_id"].tolist(), frame["text"].tolist()):
                doc_id, start = None if pd.isna(doc_id) else int(doc_id), 0
                stretches = (s for source in (encoder.slices(text), (end,)) for s in source)
                for i, ids in enumerate(cut(stretches)):
                    rows.append((doc_id, row, i, start, len(ids) // 4, zlib.crc32(ids), *([ids] if with_ids else [])))
                    start += len(ids) // 4
                    if with_ids and len(rows) >= 1000:
                        yield taken()
                row, chars = row + 1, chars + len(text or "")
                if len(rows) >= 20_000:
                    yield taken()
        yield taken()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)


def best_fit(lengths: Iterable[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length, taken in the given order, and the bins' loads.

    Every length goes to the fullest bin with room for it; bins are kept by free space, with a bit per space in use.
    """
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, bins, offsets, loads = 0, [], [], []
    for n in lengths:
        fits = used >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                used ^= 1 << free
        else:
            free, b = capacity, len(loads)
            loads.append(0)
        bins.append(b)
        offsets.append(capacity - free)
        loads[b] += n
        if free > n:
            by_free[free - n].append(b)
            used |= 1 << (free - n)
    return bins, offsets, loads


def going_on(loads: np.ndarray, capacity: int, fan: int = FAN) -> np.ndarray:
    """Positions of the bins that may still merge elsewhere: those of half or less, and the emptiest others."""
    small = np.flatnonzero(loads <= capacity // 2)
    large = np.flatnonzero((loads > capacity // 2) & (loads < capacity))
    return np.concatenate([small, large[np.argsort(loads[large], kind="stable")[:fan]]])


def merge(rows: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit over bins (load, parts): those that fit are laid end to end."""
    rows = sorted(rows, key=lambda r: (-r[0], r[1]))
    bins, offsets, loads = best_fit([r[0] for r in rows], capacity)
    merged: list[tuple[int, list]] = [(n, []) for n in loads]
    for (_, parts), b, at in zip(rows, bins, offsets):
        merged[b][1].extend((p, at + shift) for p, shift in parts)
    return merged


def _local(capacity: int, fan: int, batch: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, bins = TaskContext.get().partitionId(), 0
        held: list[pd.DataFrame] = []

        def pack() -> pd.DataFrame:
            nonlocal bins
            rows = pd.concat(held, ignore_index=True)
            held.clear()
            # a fixed order, so that a repeated task packs alike
            rows = rows.iloc[np.lexsort((rows["piece"], rows["row"], -rows["length"]))]
            bin_, offset, loads = best_fit(rows["length"].tolist(), capacity)
            loads = np.asarray(loads, np.int64)
            on = np.zeros(len(loads), bool)
            on[going_on(loads, capacity, fan)] = True
            bin_ = np.asarray(bin_, np.int64)
            rows = rows.assign(bin=(part << 33) + bins + bin_, offset=np.asarray(offset, np.int64), open=on[bin_])
            bins += len(loads)
            return rows

        size = 0
        for frame in frames:
            held.append(frame)
            size += len(frame)
            if size >= batch:
                yield pack()
                size = 0
        if size:
            yield pack()

    return run


def _node(capacity: int, fan: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        node = int(rows["node"].iloc[0])
        items = [(int(n), [(int(p["bin"]), int(p["shift"])) for p in parts]) for n, parts in zip(rows["load"], rows["parts"])]
        merged = merge(items, capacity)
        on = set(going_on(np.asarray([n for n, _ in merged], np.int64), capacity, fan).tolist())
        return pd.DataFrame({
            "node": np.full(len(merged), node, np.int64), "load": [n for n, _ in merged],
            "parts": pd.Series([[{"bin": p, "shift": s} for p, s in parts] for _, parts in merged], dtype=object),
            "done": [i not in on for i in range(len(merged))]})

    return run


def placed(pieces: DataFrame, capacity: int = CAPACITY, fan: int = FAN, batch: int = BATCH) -> DataFrame:
    """The pieces with the sequence and the offset where they lie."""
    dealt = pieces.select(*_names(PIECE)).repartition("row", "piece")
    packed, _ = written(dealt.mapInPandas(_local(capacity, fan, batch), PLACED), "residual-packed")
    loose = packed.filter("open")
    # batches of a partition are neighbours of the first node as well
    up = loose.groupBy("bin").agg(F.sum("length").alias("load")).select(
        F.shiftright("bin", 33).alias("node"), "load", F.array(F.struct("bin", F.lit(0).cast("long").alias("shift"))).alias("parts"))
    final, nodes = [], loose.select(F.max(F.shiftright("bin", 33))).first()[0]
    while nodes is not None:
        level = up.withColumn("node", F.floor(F.col("node") / fan)).groupBy("node").applyInPandas(_node(capacity, fan), NODE)
        level, _ = written(level, "residual-level")
        nodes //= fan
        final.append(level if not nodes else level.filter("done"))
        up = level.filter("NOT done").drop("done")
        if not nodes:
            break
    done = packed.filter("NOT open").select(*_names(PIECE), F.col("bin").alias("sequence_id"), "offset")
    if not final:
        return done
    places = reduce(DataFrame.unionByName, final).select(F.col("parts")[0]["bin"].alias("sequence_id"), F.explode("parts").alias("p"))
    places = places.select("sequence_id", F.col("p.bin").alias("bin"), F.col("p.shift").alias("shift"))
    moved = loose.join(places, "bin").withColumn("offset", F.col("offset") + F.col("shift"))
    return done.unionByName(moved.select(*done.columns))


def pack_report(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """Every piece with its checksum and its place."""
    return placed(pieces(docs, capacity, **options), capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "row")


def sequences(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """One row per sequence: its length and its ids (little-endian uint32), documents end to end."""
    cut, _ = written(pieces(docs, capacity, with_ids=True, **options), "residual-pieces")
    filled = placed(cut, capacity).select("row", "piece", "sequence_id", "offset").join(cut, ["row", "piece"])
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate("p", F.lit(b""), lambda a, v: F.concat(a, v["ids"]))
    return filled.groupBy("sequence_id").agg(ordered.alias("p"), F.sum("length").alias("length")).select(
        "sequence_id", "length", joined.alias("ids"))
