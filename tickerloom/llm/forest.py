"""Nearest neighbours by a forest of random-projection trees, a shared priority queue and exact reranking.

A tree halves a node's vectors by their projection on a random direction, between the means of two handfuls
drawn from the node, at the median. Directions and medians come from a bounded, documented sample of
``SAMPLE`` vectors; all vectors then go to their leaf in every tree. A query walks all trees at once: one priority queue holds the
branches not taken, keyed by the sum of the squared distances to the thresholds on the wrong side of which they
lie, and the nearest leaf of any tree is opened next until a number of leaves is open. That number is measured: queries of the sample
are held against brute force over the sample, and as many leaves are opened as reach ``RECALL`` there. Its
candidates are all vectors of these leaves; their inner products with the query are computed in double
precision on the original vectors, and nothing else is scored for a result. ``BAR`` vectors of the sample are known
with their leaves; the k-th best of those that lie in a query's open leaves, which are candidates of its own, is a bar
below which none of its candidates can be among its nearest found, so a leaf returns little.

Leaves hold ``LEAF`` vectors up to some two million different vectors (``MOST_LEVELS``) and grow from there. How much of the
table a query must read for a recall depends on the vectors: those that fill their space evenly in 64
dimensions need half of it, those near a surface of few dimensions less than a tenth (which a test holds).

Equal vectors collapse to one entry with its smallest ids, as many as a result can hold, so copies
of one vector cannot fill a leaf. A leaf is stored in parts of at most about ``PART`` vectors, and a
task meets a part with the queries that opened its leaf; it returns each query's best ones only.
Directions and thresholds are the only things broadcast, and both have fixed bounds.

Defined cases: vectors that are null, empty, zero, of another dimension than most of the sample, or hold null
or non-finite components take no part, nor do rows without an id; rows that repeat an id count once, as one of
them (the smallest vector by its components); fewer candidates than k give fewer rows; no vectors give none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import written

TREES, SAMPLE, LEAF = 4, 32_768, 256
MOST_LEVELS = 13
PICKED = 4
RECALL, MEASURED, BAR = 0.95, 128, 8192
PART = 2048
SALTS = 32


class Forest:
    """Directions (trees, nodes, dimension) and thresholds (trees, nodes), nodes in heap order."""

    def __init__(self, sample: np.ndarray, levels: int, trees: int = TREES, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.levels, self.dimension = levels, sample.shape[1]
        nodes = (1 << levels) - 1
        self.directions = np.zeros((trees, nodes, sample.shape[1]), dtype=np.float32)
        self.cuts = np.zeros((trees, nodes))
        for t in range(trees):
            members = [np.arange(len(sample))]
            for i in range(nodes):
                own = members[i]
                if len(own) > 1:
                    # the projection runs between the means of two random handfuls of the node's vectors
                    a, b = rng.choice(own, min(PICKED, len(own) // 2)), rng.choice(own, min(PICKED, len(own) // 2))
                    line = sample[a].mean(axis=0) - sample[b].mean(axis=0)
                else:
                    line = rng.normal(size=sample.shape[1])
                if not line.any():
                    line = rng.normal(size=sample.shape[1])
                self.directions[t, i] = line / np.linalg.norm(line)
                x = sample[own] @ self.directions[t, i]
                self.cuts[t, i] = np.median(x) if len(own) else 0.0
                right = x >= self.cuts[t, i]
                members += [own[~right], own[right]]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """(vectors, trees): the leaf each vector falls to, numbered across trees."""
        out = np.empty((len(x), len(self.cuts)), dtype=np.int64)
        for t in range(len(self.cuts)):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.levels):
                side = np.einsum("ij,ij->i", x, self.directions[t, node]) >= self.cuts[t, node]
                node = 2 * node + 1 + side
            out[:, t] = node - ((1 << self.levels) - 1) + (t << self.levels)
        return out

    def search(self, queries: np.ndarray, leaves: int) -> Iterator[list[int]]:
        """For each query the leaves to open, nearest first, over all trees."""
        nodes = (1 << self.levels) - 1
        for i in range(0, len(queries), 256):
            gaps = np.einsum("tnd,qd->qtn", self.directions, queries[i:i + 256], optimize=True) - self.cuts
            for gap in gaps:
                gap = [g.tolist() for g in gap]
                queue = [(0.0, t, 0) for t in range(len(gap))]
                found: list[int] = []
                while queue and len(found) < leaves:
                    far, t, node = heapq.heappop(queue)
                    own = gap[t]
                    while node < nodes:
                        g = own[node]
                        near = 2 * node + 2 if g >= 0 else 2 * node + 1
                        heapq.heappush(queue, (far + g * g, t, 4 * node + 3 - near))
                        node = near
                    found.append(node - nodes + (t << self.levels))
                yield found

    def enough(self, sample: np.ndarray, k: int, recall: float = RECALL) -> int:
        """Leaves to open so that queries of the sample find that share of their k nearest in the sample."""
        asked = sample[:MEASURED]
        score = asked @ sample.T
        score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
        k = min(k, len(sample) - 1)
        every = len(self.cuts) << self.levels
        if k < 1:
            return every
        true = np.argpartition(-score, k - 1, axis=1)[:, :k]
        leaf = self.leaf(sample)
        opened = []
        for i, order in enumerate(self.search(asked, every)):
            turn = np.empty(every, dtype=np.int64)
            turn[order] = np.arange(every)
            opened.append(turn[leaf[true[i]]].min(axis=1) + 1)
        return int(np.quantile(np.concatenate(opened), recall, method="higher"))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows that take part, one per id."""
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    v = F.col("embedding") if kind in ("float", "double") else F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def distinct(rows: DataFrame, k: int) -> DataFrame:
    """(entry, v, ids): each different vector once, with its k + 1 smallest ids.

    The smallest ids are taken per salt first, so a vector of a third of all rows is no hot key.
    """
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))
    rank = F.row_number().over(Window.partitionBy("v", salt).orderBy("vec_id"))
    few = rows.withColumn("_rank", rank).filter(F.col("_rank") <= k + 1)
    ids = F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1)
    return few.groupBy("v").agg(ids.alias("ids")).select(F.col("ids")[0].alias("entry"), "v", "ids")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64)


class Index:
    """What tasks get: the forest, how many leaves to open, and the vectors the bars come from, with their leaves."""

    def __init__(self, sample: pd.DataFrame, n: int, k: int, trees: int, leaves: int | None):
        width = sample["v"].map(len).mode()[0]
        sample = sample[sample["v"].map(len) == width].sort_values("entry")
        x = _matrix(sample["v"])
        x = x[np.random.default_rng(1).permutation(len(x))]
        levels = int(np.clip(np.ceil(np.log2(max(n / LEAF, 1))), 0, MOST_LEVELS))
        self.forest = Forest(x, levels, trees)
        self.leaves = leaves or self.forest.enough(x, k)
        self.dimension = int(width)
        self.bar = x[:BAR]
        self.bar_leaf = self.forest.leaf(self.bar)

    def ask(self, queries: np.ndarray, k: int) -> Iterator[tuple[list[int], float]]:
        """For each query the leaves it opens and its bar."""
        for q, found in zip(queries, self.forest.search(queries, self.leaves)):
            is_open = np.zeros(len(self.forest.cuts) << self.forest.levels, dtype=bool)
            is_open[found] = True
            score = self.bar[is_open[self.bar_leaf].any(axis=1)] @ q
            if len(score) <= k:
                yield found, -np.inf
                continue
            # one more than k: the query may itself be among them
            bar = np.partition(score, -(k + 1))[-(k + 1)]
            yield found, bar - 1e-9 * abs(bar)


def fitted(entries: DataFrame, k: int, trees: int = TREES, leaves: int | None = None) -> Index | None:
    n = entries.count()
    if not n:
        return None
    # entries by hash of their ids: at most about ``SAMPLE``
    share = min(1.0, SAMPLE / n)
    rows = entries.filter(F.crc32(F.col("entry").cast("string").cast("binary")) < int(share * 2**32)).toPandas()
    return Index(rows if len(rows) else entries.limit(1).toPandas(), n, k, trees, leaves)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, leaves: int | None = None, trees: int = TREES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of all other vectors, for ids divisible by ``every``."""
    spark = vectors.sparkSession
    rows, _ = written(usable(vectors), "vectors")
    entries, _ = written(distinct(rows, k), "vectors")
    index = fitted(entries, k, trees, leaves)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(index)
    kind = rows.schema["v"].dataType.simpleString()

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[f["v"].map(len) == shared.value.dimension]
            if len(f):
                leaf = shared.value.forest.leaf(_matrix(f["v"]))
                yield f.loc[f.index.repeat(leaf.shape[1])].assign(leaf=leaf.ravel())

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The leaves each query opens, and its bar."""
        own = shared.value
        for f in frames:
            f = f[f["v"].map(len) == own.dimension]
            if not len(f):
                continue
            for (_, r), (found, bar) in zip(f.iterrows(), own.ask(_matrix(f["v"]), k)):
                yield pd.DataFrame({"query_id": r["vec_id"], "leaf": found, "bar": bar, "v": [r["v"]] * len(found)})

    def _spread(score: np.ndarray, bar: np.ndarray, owner: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> pd.DataFrame:
        """At most the k + 1 best (query, id) pairs of each query that reach its bar."""
        if score.shape[1] > k + 1:
            bar = np.maximum(bar, np.partition(score, -(k + 1), axis=1)[:, -(k + 1)])
        row, col = np.nonzero((score >= bar[:, None])[:, owner])
        value, vec = score[row, owner[col]], ids[col]
        other = vec != queries[row]
        row, vec, value = row[other], vec[other], value[other]
        order = np.lexsort((vec, -value, row))
        row, vec, value = row[order], vec[order], value[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        return pd.DataFrame({"query_id": queries[row[keep]], "vec_id": vec[keep], "score": value[keep]})

    def rerank(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        asked, have = frame[frame["query_id"].notna()], frame[frame["entry"].notna()]
        if not len(asked) or not len(have):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        x, ids = _matrix(have["v"]), [np.asarray(i, dtype=np.int64) for i in have["ids"]]
        owner, flat = np.repeat(np.arange(len(ids)), list(map(len, ids))), np.concatenate(ids)
        queries, bar = asked["query_id"].to_numpy().astype(np.int64), asked["bar"].to_numpy()
        q = _matrix(asked["v"])
        lots = [_spread(q[i:i + 256] @ x.T, bar[i:i + 256], owner, flat, queries[i:i + 256]) for i in range(0, len(q), 256)]
        return pd.concat(lots, ignore_index=True)

    placed, _ = written(entries.mapInPandas(place, f"entry long, v {kind}, ids array<long>, leaf long"), "vectors")
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / PART).cast("long").alias("parts"))
    stored = placed.join(sizes, "leaf").withColumn("part", F.pmod(F.xxhash64("entry"), F.col("parts")))
    stored = stored.select("leaf", "part", F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("double").alias("bar"), "entry", "v", "ids")
    queries = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    wanted = queries.mapInPandas(ask, f"query_id long, leaf long, bar double, v {kind}").join(sizes, "leaf")
    wanted = wanted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    wanted = wanted.select("leaf", "part", "query_id", "bar", F.lit(None).cast("long").alias("entry"), "v", F.lit(None).cast("array<long>").alias("ids"))
    result = "query_id long, vec_id long, score double"
    found = stored.unionByName(wanted).groupBy("leaf", "part").applyInPandas(rerank, result)
    # the same candidate comes from several trees
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
