"""SimHash near-duplicates through an inverted index on byte positions.

Fingerprints of 64 bits are eight bytes at eight positions. Three differing bits touch three bytes
at most, so a linked pair shares at least five positional bytes. Whichever five they are, three of
them lie in the first or in the last four positions: eight triples of positions (four in each half)
find every linked pair. The index is therefore keyed by a triple of positional bytes, 2^24 values a
triple; inside a posting list the shared positional bytes of a pair are tallied, pairs below five
are dropped, and the rest is verified by the number of differing bits.

Equal fingerprints collapse before the index. A posting list emits only a spanning forest of its
links. A list of more than ``LIST`` fingerprints is cut into blocks whose pairs of blocks are
compared by separate tasks, so no list is gathered whole and none is cut short.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; a text of
fewer than three words has one shingle, all its words; rows that repeat an id get a row each; a null
id never names a component, and a component without any id is null. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tickerloom.llm.common import written
from tickerloom.llm.components import connected

SHINGLE, SEED = 3, 42
BITS, SHARED = 3, 5
LIST = 4096
TRIPLES = tuple((half + i, half + j, half + k) for half in (0, 4) for i in range(4) for j in range(i + 1, 4) for k in range(j + 1, 4))


def simhash(text: str | None, width: int = SHINGLE) -> int:
    """The fingerprint of one text as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1:]
    of = xxhash.xxh64_intdigest
    votes = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 1 << 16):
        spans = zip(starts[k:min(n, k + (1 << 16))].tolist(), last[k:k + (1 << 16)].tolist())
        h = np.array([of(joined[i:j], SEED) for i, j in spans], dtype=np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.int64)[0])


@F.pandas_udf(LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in texts], dtype="int64")


def as_hex(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(0xFF))


def postings(fps: DataFrame) -> DataFrame:
    """(key, fp): a fingerprint under each of its eight positional triples."""
    keys = []
    for n, places in enumerate(TRIPLES):
        key = F.lit(n).cast("long")
        for p in places:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(F.col("fp"), p))
        keys.append(key)
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _linked(x: np.ndarray) -> np.ndarray:
    """Tally the positional bytes two fingerprints share, keep those with enough, verify the bits."""
    t = x | (x >> np.uint64(4))
    t |= t >> np.uint64(2)
    t |= t >> np.uint64(1)
    other = np.bitwise_count(t & np.uint64(0x0101010101010101))
    return (other <= 8 - SHARED) & (np.bitwise_count(x) <= BITS)


def _forest(fp: np.ndarray, block: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among distinct fingerprints, grown breadth first."""
    rest = fp
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            head, front = front[:block], front[block:]
            hit = _linked(head[:, None] ^ rest[None, :])
            found = hit.any(axis=0)
            if found.any():
                yield head[hit[:, found].argmax(axis=0)], rest[found]
                front, rest = np.concatenate([front, rest[found]]), rest[~found]


def _links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links inside posting lists; rows come sorted by list, a list may span several frames."""
    held_g, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)

    def search(g: np.ndarray, fp: np.ndarray) -> Iterator[pd.DataFrame]:
        cut = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        size = np.diff(np.concatenate((cut, [len(g)])))
        per_row = np.repeat(size, size)
        few = (per_row > 1) & (per_row <= 16)
        f, gg = fp[few], g[few]
        for d in range(1, 16):
            if len(f) <= d:
                break
            hit = np.flatnonzero((gg[d:] == gg[:-d]) & _linked(f[d:] ^ f[:-d]))
            if len(hit):
                yield pd.DataFrame({"a": f[hit].view(np.int64), "b": f[hit + d].view(np.int64)})
        for s, n in zip(cut[size > 16], size[size > 16]):
            for a, b in _forest(np.unique(fp[s:s + n])):
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    for frame in frames:
        g = np.concatenate([held_g, frame["list"].to_numpy(np.int64)])
        fp = np.concatenate([held_f, frame["fp"].to_numpy(np.int64).view(np.uint64)])
        if not len(g):
            continue
        earlier = np.flatnonzero(g != g[-1])
        whole = int(earlier[-1]) + 1 if len(earlier) else 0
        held_g, held_f = g[whole:].copy(), fp[whole:].copy()
        if whole:
            yield from search(g[:whole], fp[:whole])
    if len(held_g):
        yield from search(held_g, held_f)


def links(fps: DataFrame, limit: int = LIST) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints (column fp) within ``BITS`` bits."""
    rows = postings(fps)
    long_lists = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    rows = rows.join(long_lists, "key", "left")
    blocks = F.ceil(F.coalesce("_n", F.lit(1)) / limit).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks.cast("long")).cast("int")
    rows = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    pair = F.struct("key", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"))
    rows = rows.select(F.xxhash64(pair).alias("list"), "fp")  # two lists that meet in one hash are searched together: harmless
    return rows.repartition("list").sortWithinPartitions("list", "fp").mapInPandas(_links, "a long, b long")


def grouped(docs: DataFrame, *keys: Column) -> DataFrame:
    """(doc_id, fp, root, component_id) of every row of ``docs``, and further ``keys`` of it; ``root`` names the component."""
    prints, _ = written(docs.select("doc_id", fingerprint("text").alias("fp"), *keys), "simhash")
    fps = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected(links(fps.select("fp")))
    named = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(named.join(smallest, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    return grouped(docs).select("doc_id", as_hex("fp").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` less all but one row of each group: that with the smallest id stays, rows without an id last.

    Rows that repeat an id with other texts are documents of their own groups. Among rows of the smallest id
    of one group the order of fingerprint and of a hash of the row decides, so reruns keep the same one;
    rows that are equal in every column are one.
    """
    plain = [c for c, t in docs.dtypes if "map<" not in t]  # maps have no hash
    marks = [F.xxhash64(F.lit(i), *plain).alias(f"_h{i}") for i in (1, 2)]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "fp", "_h1", "_h2"))
    stay = grouped(docs, *marks).groupBy("root").agg(first.alias("s")).select("s._h1", "s._h2")
    kept = docs.withColumns({f"_h{i}": m for i, m in zip((1, 2), marks)}).join(stay, ["_h1", "_h2"], "left_semi")
    return kept.dropDuplicates(["_h1", "_h2"]).select(*docs.columns)
