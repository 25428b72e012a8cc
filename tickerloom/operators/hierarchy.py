"""Agglomerative clustering of return vectors and hierarchical risk parity.

The distance of two assets is sqrt((1 - correlation) / 2), half the Euclidean distance of their
standardised return vectors. No table of pairs is formed. Dates of at most ``ALONE`` blocks are a task each, which holds the
date's vectors (264 MB for 524,288 of 63 returns) and makes the tree without their matrix (``plans/linkage``), orders the
leaves and halves them; its vectors travel once and only weights leave.

On larger dates no task holds the universe: assets are dealt into blocks of about ``BLOCK`` vectors, a task measures one pair of blocks, and only each
cluster's nearest neighbour is kept. Clusters that are each other's nearest merge in one round; all four linkages are
reducible, so no later merge can come between two such clusters, and the tree is the sequential one.
What is left of a date, at most ``FINISH`` clusters, is merged in one task.
A tree of at most ``WHOLE`` blocks takes no rounds: a task holds the matrix of one.

Single linkage takes no rounds: its merges are the edges of a minimum spanning tree. Equal vectors are joined to the first
of them by name, at height 0. The others meet once, a pair of blocks of about ``SPAN`` vectors at a time, each pair
of blocks keeps the tree of its own distances, and trees are merged ``FAN`` at a time: an edge that no tree
of a part keeps is in no tree of the whole. A task holds two blocks and their matrix, or ``FAN`` trees of at most N edges.

The members of a cluster lie in one block while they fit; those of a larger one are spread by ticker, and its
distances are put together from the parts. Per rebalance date one task takes the N - 1 merges (names and
heights) and returns the order of leaves; bisection then needs only vector sums of contiguous leaves.

Ties go to the pair of names that sorts first. Assets that don't vary have no correlation and get no row.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from tickerloom.operators.construction import dot
from tickerloom.plans.linkage import apart, closest, merges
from tickerloom.plans.scale import settled

LINKAGES = ("single", "complete", "average", "ward")
BLOCK, FINISH = 1024, 64
#: Blocks of a date that one task merges, holding their matrix (512 MB); more go by rounds.
WHOLE = 8
#: Blocks of a date that one task takes from vectors to weights; more go by blocks, rounds and levels of halves.
ALONE = 512
#: Vectors of a block when spanning trees are made (a pair of blocks is a matrix of 128 MB, held both ways), and trees merged in one task.
SPAN, FAN = 4096, 16
_REDUCE = {"single": np.minimum, "complete": np.maximum, "average": np.add, "ward": np.add}
_TOTAL = {"single": F.min, "complete": F.max, "average": F.sum, "ward": F.sum}
_PAIRS = "rebalance_date date, a string, b string, value double, n_a bigint, n_b bigint, whole boolean"
_MERGES = "rebalance_date date, a string, b string, height double, step bigint"


def varying(windows: DataFrame, lookback: int) -> DataFrame:
    """Windows with their ``variance``, without assets that don't vary."""
    return windows.withColumn("variance", dot(F.col("x"), F.col("x")) / lookback).filter(F.col("variance") > 1e-18)


def _strings(values) -> pd.Series:
    return pd.Series(list(values), dtype=object)


def _no_pairs() -> pd.DataFrame:
    return pd.DataFrame({c.split()[0]: _strings([]) for c in _PAIRS.split(", ")})


def _pair_task(linkage: str, every: bool, block: int):
    """Nearest cluster of each cluster between two blocks; pairs of a cluster that is spread over blocks (or all) in parts."""

    def side(rows: pd.DataFrame):
        rows = rows.sort_values("cluster", kind="stable")
        names, first = np.unique(rows["cluster"].to_numpy(dtype=str), return_index=True)
        return np.stack(rows["z"].to_numpy()), names, first, rows["n"].to_numpy()[first]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        p, q = pdf[pdf["block"] == i], pdf[pdf["block"] == j]
        if not len(p) or not len(q):
            return _no_pairs()
        zp, a, first_a, n_a = side(p)
        zq, b, first_b, n_b = (zp, a, first_a, n_a) if i == j else side(q)
        g = zp @ zq.T
        if linkage == "ward":  # rows are centroids
            apart = (zp * zp).sum(axis=1)[:, None] + (zq * zq).sum(axis=1)[None, :] - 2 * g
            v = np.maximum(apart, 0) / 2 * np.outer(n_a, n_b) / np.add.outer(n_a, n_b)
        else:
            reduce = _REDUCE[linkage].reduceat
            v = reduce(reduce(np.sqrt(np.maximum((1 - g) / 2, 0)), first_a, axis=0), first_b, axis=1)
        same = a[:, None] == b[None, :]
        split = np.full(same.shape, every)
        if linkage != "ward":
            split |= (n_a > block)[:, None] | (n_b > block)[None, :]
        out = []

        def add(rows, cols, whole):
            if len(rows):
                out.append((a[rows], b[cols], v[rows, cols], n_a[rows], n_b[cols], whole))

        parts = split & ~same & ((a[:, None] < b[None, :]) if i == j else True)
        add(*np.nonzero(parts), False)
        if linkage == "average":
            v = v / np.outer(n_a, n_b)
        v = np.where(same | split, np.inf, v)
        if i == j:
            v = np.minimum(v, v.T)
        near = v.argmin(axis=1)
        rows = np.flatnonzero(np.isfinite(v[np.arange(len(a)), near]))
        add(rows, near[rows], True)
        if i != j:
            near = v.argmin(axis=0)
            cols = np.flatnonzero(np.isfinite(v[near, np.arange(len(b))]))
            if len(cols):
                out.append((b[cols], a[near[cols]], v[near[cols], cols], n_b[cols], n_a[near[cols]], True))
        return pd.concat([pd.DataFrame({
            "rebalance_date": _strings([pdf["rebalance_date"].iloc[0]] * len(x)), "a": _strings(x), "b": _strings(y), "value": val.astype(float),
            "n_a": na.astype(np.int64), "n_b": nb.astype(np.int64), "whole": np.full(len(x), w)}) for x, y, val, na, nb, w in out]
        ) if out else _no_pairs()

    return run


def _distances(members: DataFrame, linkage: str, blocks: int, every: bool, block: int) -> DataFrame:
    """Candidates (a, b, value) for nearest neighbours, or all pairs a < b of clusters."""
    own = F.when(F.col("n") > block, F.col("ticker")).otherwise(F.col("cluster")) if linkage != "ward" else F.col("cluster")
    dealt = members.withColumn("block", F.pmod(F.xxhash64(own), F.lit(blocks)))
    dealt = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumns({"i": F.least("block", "_with"), "j": F.greatest("block", "_with")})
    found = dealt.select("rebalance_date", "i", "j", "block", "cluster", "n", "z").groupBy("rebalance_date", "i", "j").applyInPandas(
        _pair_task(linkage, every, block), _PAIRS)
    low, high = F.least("a", "b"), F.greatest("a", "b")
    parts = found.filter("NOT whole").groupBy("rebalance_date", low.alias("a"), high.alias("b")).agg(
        _TOTAL[linkage]("value").alias("value"), F.max(F.col("n_a") * F.col("n_b")).alias("_n"),
        F.max(F.when(F.col("a") < F.col("b"), F.col("n_a")).otherwise(F.col("n_b"))).alias("n_a"),
        F.max(F.when(F.col("a") < F.col("b"), F.col("n_b")).otherwise(F.col("n_a"))).alias("n_b"))
    if linkage == "average":
        parts = parts.withColumn("value", F.col("value") / F.col("_n"))
    if every:
        return parts.drop("_n")
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    parts = parts.select("rebalance_date", "value", both.alias("_p")).select("rebalance_date", "_p.a", "_p.b", "value")
    return found.filter("whole").select("rebalance_date", "a", "b", "value").unionByName(parts)


def _finish(linkage: str, step: int):
    """Merge the last clusters of a date by the update of their distances."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {c: i for i, c in enumerate(names)}
        n = len(names)
        d, size = np.full((n, n), np.inf), np.ones(n)
        for a, b, v, na, nb in zip(pdf["a"], pdf["b"], pdf["value"], pdf["n_a"], pdf["n_b"]):
            d[at[a], at[b]] = d[at[b], at[a]] = v
            size[at[a]], size[at[b]] = na, nb
        rows = []
        for k in range(n - 1):
            i, j = divmod(int(np.argmin(d)), n)
            i, j = min(i, j), max(i, j)
            height, di, dj = d[i, j], d[i].copy(), d[j].copy()
            rows.append((pdf["rebalance_date"].iloc[0], names[i], names[j], float(height), step + k))
            with np.errstate(invalid="ignore"):
                if linkage == "single":
                    new = np.minimum(di, dj)
                elif linkage == "complete":
                    new = np.maximum(di, dj)
                elif linkage == "average":
                    new = (size[i] * di + size[j] * dj) / (size[i] + size[j])
                else:
                    new = ((size[i] + size) * di + (size[j] + size) * dj - size * height) / (size[i] + size[j] + size)
            new[[i, j]] = np.inf
            new[~np.isfinite(new)] = np.inf
            d[i], d[:, i], d[j], d[:, j] = new, new, np.inf, np.inf
            size[i] += size[j]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _MERGES.split(", ")])

    return run


def _whole(linkage: str):
    """All merges of a date that fits a task: always the closest pair, the first by name among equals."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ticker", kind="stable")
        names, z = pdf["ticker"].to_numpy(), np.stack(pdf["z"].to_numpy())
        n = len(names)
        a, b, heights = closest(apart(z, linkage), np.ones(n), linkage)
        return pd.DataFrame({"rebalance_date": _strings([pdf["rebalance_date"].iloc[0]] * (n - 1)), "a": _strings(names[a]), "b": _strings(names[b]),
                             "height": heights, "step": np.arange(n - 1)})

    return run


def _spanning_pair(d: np.ndarray, rank: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree of distances between two sides, or within one that is both: (ends, ends, distances).

    ``rank`` numbers rows and then columns by name, and names the ends; equal distances go by the lower end, then the higher one.
    """
    n, m = d.shape
    back = np.ascontiguousarray(d.T) if across else d
    total, shift = (n + m, n) if across else (n, 0)
    low, near, left = np.full(total, np.inf), np.full(total, total), np.ones(total, bool)
    a, b, heights = np.zeros(total - 1, int), np.zeros(total - 1, int), np.zeros(total - 1)
    at = 0
    for k in range(total - 1):
        left[at], low[at] = False, np.inf
        row, part = (d[at], slice(shift, None)) if at < n else (back[at - n], slice(0, n))
        to, by = low[part], near[part]
        closer = ((row < to) | ((row == to) & (rank[at] < by))) & left[part]
        np.copyto(to, row, where=closer)
        np.copyto(by, rank[at], where=closer)
        at = int(low.argmin())
        ties = np.flatnonzero(low == low[at])
        if len(ties) > 1:
            r = rank[ties]
            at = int(ties[np.lexsort((np.maximum(r, near[ties]), np.minimum(r, near[ties])))[0]])
        a[k], b[k], heights[k] = rank[at], near[at], low[at]
    return a, b, heights


_EDGES = "rebalance_date date, part int, a string, b string, height double"


def _edges(like: pa.Table, part: int, a, b, heights) -> pa.Table:
    day = like.column("rebalance_date").combine_chunks()
    return pa.table({
        "rebalance_date": day.take(pa.array(np.zeros(len(heights), np.int64))), "part": pa.array(np.full(len(heights), part, np.int32)),
        "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "height": pa.array(heights, pa.float64())})


def _block_tree(blocks: int):
    """The spanning tree of a pair of blocks' distances, or of those within one block."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        names, block = table.column("ticker").to_numpy().astype(str), table.column("block").to_numpy()
        z = table.column("z").chunk(0).flatten().to_numpy().reshape(len(names), -1)
        n = int((block == i).sum())
        if n == 0 or (n == len(names)) != (i == j) or len(names) == 1:
            return _edges(table, 0, [], [], [])
        order = np.lexsort((names, block != i))
        names, z = names[order], z[order]
        by_name = np.argsort(names)
        rank = np.empty(len(names), int)
        rank[by_name] = np.arange(len(names))
        rows, columns = z[:n], z[n:] if i != j else z
        d = rows @ columns.T
        np.subtract(1, d, out=d)
        d /= 2
        np.maximum(d, 0, out=d)
        np.sqrt(d, out=d)
        if i == j:
            d = np.minimum(d, d.T)
        a, b, heights = _spanning_pair(d, rank, i != j)
        return _edges(table, i * blocks + j, names[by_name[a]], names[by_name[b]], heights)

    return run


def _forest(fan: int):
    """The spanning forest of several trees' edges."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        a, b, heights = table.column("a").to_numpy(), table.column("b").to_numpy(), table.column("height").to_numpy()
        names, ends = np.unique(np.concatenate([a, b]).astype(str), return_inverse=True)
        low, high = np.sort(ends.reshape(2, -1), axis=0)
        up, kept = list(range(len(names))), []
        order = np.lexsort((high, low, heights))
        for e, u, v in zip(order.tolist(), low[order].tolist(), high[order].tolist()):
            while up[u] != u:
                up[u] = up[up[u]]
                u = up[u]
            while up[v] != v:
                up[v] = up[up[v]]
                v = up[v]
            if u != v:
                up[max(u, v)] = min(u, v)
                kept.append(e)
        part = table.column("part")[0].as_py() // fan
        return _edges(table, part, names[low[kept]], names[high[kept]], heights[kept])

    return run


def _spanning_tree(members: DataFrame, longest: int, span: int) -> DataFrame:
    """Merges of single linkage over distinct vectors of any number: every pair of blocks is measured once."""
    blocks = -(-longest // span)
    dealt = members.select("rebalance_date", "ticker", "z", F.pmod(F.xxhash64("ticker"), F.lit(blocks)).cast("int").alias("block"))
    dealt = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumns({"i": F.least("block", "_with"), "j": F.greatest("block", "_with")}).drop("_with")
    # a partition for each few pairs of blocks: a matrix is 128 MB, and its time far more than its rows'
    days = members.select("rebalance_date").distinct().count()
    dealt = dealt.repartition(max(1, min(2000, days * blocks * (blocks + 1) // 2)), "rebalance_date", "i", "j")
    edges = settled(dealt.groupBy("rebalance_date", "i", "j").applyInArrow(_block_tree(blocks), _EDGES))
    parts = blocks * blocks
    while True:
        edges = edges.groupBy("rebalance_date", F.floor(F.col("part") / FAN).cast("int").alias("_g")).applyInArrow(_forest(FAN), _EDGES)
        parts = -(-parts // FAN)
        if parts == 1:
            return edges.select("rebalance_date", "a", "b", "height", F.lit(0).cast("long").alias("step"))


def _single_tree(members: DataFrame, block: int, finish: int) -> DataFrame:
    """Merges of single linkage: equal vectors first, the distinct ones by their spanning tree."""
    firsts = settled(members.groupBy("rebalance_date", "z").agg(F.min("ticker").alias("ticker"), F.count(F.lit(1)).alias("_copies")))
    again = firsts.filter("_copies > 1").select("rebalance_date", "z", F.col("ticker").alias("a"))
    copies = members.join(again, ["rebalance_date", "z"]).filter(F.col("ticker") != F.col("a")).select(
        "rebalance_date", "a", F.col("ticker").alias("b"), F.lit(0.0).alias("height"), F.lit(-1).cast("long").alias("step"))
    longest = firsts.groupBy("rebalance_date").agg(F.count(F.lit(1)).alias("rows")).agg(F.max("rows")).first()[0] or 0
    if longest <= WHOLE * block and longest > finish:
        tree = firsts.select("rebalance_date", "ticker", "z").groupBy("rebalance_date").applyInPandas(_whole("single"), _MERGES)
    else:
        tree = _spanning_tree(firsts, max(longest, 1), min(SPAN, block * 4))
    return tree.unionByName(copies)


def merge_tree(windows: DataFrame, linkage: str = "single", block: int = BLOCK, finish: int = FINISH) -> DataFrame:
    """All merges of each rebalance date: two clusters by one of their members' names, height, and step.

    Steps order the merges of complete, average and ward linkage; those of single linkage are ordered by height.
    """
    if linkage not in LINKAGES:
        raise ValueError(f"linkage must be one of {LINKAGES}")
    norm = F.sqrt(dot(F.col("x"), F.col("x")))
    members = settled(windows.select(
        "rebalance_date", "ticker", F.col("ticker").alias("cluster"), F.lit(1).cast("long").alias("n"),
        F.transform("x", lambda v: v / norm).alias("z")))
    if linkage == "single":
        return _single_tree(members, block, finish)
    longest = members.groupBy("rebalance_date").agg(F.count(F.lit(1)).alias("rows")).agg(F.max("rows")).first()[0] or 0
    if finish < longest <= WHOLE * block:
        return members.groupBy("rebalance_date").applyInPandas(_whole(linkage), _MERGES)
    widest = lambda: members.groupBy("rebalance_date").agg(F.count_distinct("cluster").alias("c"), F.count(F.lit(1)).alias("rows")).agg(
        F.max("c"), F.max("rows")).first()
    merges, step = None, 0
    while True:
        clusters, rows = widest()
        blocks = -(-(rows or 1) // block)
        if (clusters or 0) <= max(finish, 1):
            break
        pair = F.struct("value", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
        near = settled(_distances(members, linkage, blocks, False, block).groupBy("rebalance_date", "a").agg(F.min(pair).alias("p")))
        near = near.select("rebalance_date", "a", "p.value", "p.low", "p.high")
        pairs = near.groupBy("rebalance_date", "low", "high").agg(F.min("value").alias("height"), F.count(F.lit(1)).alias("_n"))
        mutual = pairs.filter("_n = 2")
        new = settled(mutual.select("rebalance_date", F.col("low").alias("a"), F.col("high").alias("b"), "height", F.lit(step).cast("long").alias("step")))
        merges = new if merges is None else merges.unionByName(new)
        parents = new.select("rebalance_date", F.col("b").alias("cluster"), F.col("a").alias("parent"))
        moved = members.join(parents, ["rebalance_date", "cluster"], "left").withColumn("cluster", F.coalesce("parent", "cluster")).drop("parent", *([] if linkage == "ward" else ["n"]))
        if linkage == "ward":  # one row a cluster: its centroid
            weigh = F.transform("z", lambda v: v * F.col("n"))
            t = members.select(F.size("z")).first()[0]
            moved = moved.select("rebalance_date", "cluster", "n", weigh.alias("z")).groupBy("rebalance_date", "cluster").agg(
                F.sum("n").alias("n"), *[F.sum(F.col("z")[k]).alias(f"s{k}") for k in range(t)])
            moved = moved.select("rebalance_date", F.col("cluster").alias("ticker"), "cluster", "n", F.array(*[F.col(f"s{k}") / F.col("n") for k in range(t)]).alias("z"))
        else:
            sizes = moved.groupBy("rebalance_date", "cluster").agg(F.count(F.lit(1)).alias("n"))
            moved = moved.join(sizes, ["rebalance_date", "cluster"])
        members, step = settled(moved.select("rebalance_date", "ticker", "cluster", "n", "z")), step + 1
    last = _distances(members, linkage, blocks, True, block).groupBy("rebalance_date").applyInPandas(_finish(linkage, step), _MERGES)
    return last if merges is None else merges.unionByName(last)


def _find(up: list[int], i: int) -> int:
    while up[i] != i:
        up[i] = up[up[i]]
        i = up[i]
    return i


def _leaves(n: int, merged: Iterable[tuple[int, int]]) -> list[int]:
    """Leaves in tree order, the side with the first leaf first."""
    up, last, following = list(range(n)), list(range(n)), [-1] * n
    for a, b in merged:  # a root is the first of its cluster and the head of its list
        a, b = sorted((_find(up, a), _find(up, b)))
        following[last[a]], last[a], up[b] = b, last[b], a
    order, i = [], 0
    while i >= 0:
        order.append(i)
        i = following[i]
    return order


def _cut(n: int, merged: Iterable[tuple[int, int]]) -> list[int]:
    """The first leaf of each leaf's cluster."""
    up = list(range(n))
    for a, b in merged:
        a, b = sorted((_find(up, a), _find(up, b)))
        up[b] = a
    return [_find(up, i) for i in range(n)]


def _leaf_task(linkage: str, clusters: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Leaves in tree order, the side with the first name first; clusters left when the highest merges are undone."""
        names = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {c: i for i, c in enumerate(names)}
        rows = list(zip(pdf["height"], pdf["step"], (at[x] for x in pdf["a"]), (at[x] for x in pdf["b"])))
        rows.sort(key=lambda r: (*r,) if linkage == "single" else (r[1],))
        order = _leaves(len(names), (r[2:] for r in rows))
        left = _cut(len(names), (r[2:] for r in sorted(rows, key=lambda r: (r[0], r[1]))[:max(len(names) - clusters, 0)]))
        return pd.DataFrame({"rebalance_date": _strings([pdf["rebalance_date"].iloc[0]] * len(order)), "ticker": _strings(names[i] for i in order),
                             "pos": np.arange(len(order)), "cluster": _strings(names[left[i]] for i in order)})

    return run


def leaf_order(windows: DataFrame, linkage: str = "single", clusters: int = 1, block: int = BLOCK, finish: int = FINISH) -> DataFrame:
    """(rebalance_date, ticker, x, variance, pos, cluster): place in the tree's order, and cluster where the tree is cut into ``clusters``."""
    tree = merge_tree(windows.select("rebalance_date", "ticker", "x"), linkage, block, finish)
    order = tree.groupBy("rebalance_date").applyInPandas(_leaf_task(linkage, clusters), "rebalance_date date, ticker string, pos bigint, cluster string")
    # a date of one asset has no merge
    return windows.join(order, ["rebalance_date", "ticker"], "left").withColumns(
        {"pos": F.coalesce("pos", F.lit(0)), "cluster": F.coalesce("cluster", "ticker")})


def _halves(pos: pd.Series, n: pd.Series) -> pd.Series:
    """The blocks a leaf lies in when n leaves are halved again and again, and its side of each."""

    def path(p: int, hi: int) -> list[dict]:
        lo, out = 0, []
        while hi - lo > 1:
            mid = lo + (hi - lo) // 2
            out.append({"level": len(out), "start": lo, "left": p < mid})
            lo, hi = (lo, mid) if p < mid else (mid, hi)
        return out

    return pd.Series([path(int(p), int(k)) for p, k in zip(pos, n)])


def bisected(ordered: DataFrame, lookback: int) -> DataFrame:
    """Weights of leaves in order: halves share by the inverse of the variance of their inverse-variance portfolios.

    Needs rebalance_date, ticker, x, variance and pos. A half's portfolio is a sum of vectors, so no leaf meets another.
    """
    counts = ordered.groupBy("rebalance_date").agg(F.count(F.lit(1)).alias("_n"))  # a row a rebalance date
    halves = pandas_udf(_halves, "array<struct<level: int, start: bigint, left: boolean>>")
    leaves = settled(ordered.join(F.broadcast(counts), "rebalance_date").withColumn("_path", halves("pos", "_n")))
    steps = leaves.select("rebalance_date", "ticker", "x", "variance", F.explode("_path").alias("_s")).select("*", "_s.level", "_s.start", "_s.left")
    key = ["rebalance_date", "level", "start"]
    sums = steps.groupBy(*key, "left").agg(F.sum(1 / F.col("variance")).alias("_i"), *[F.sum(F.col("x")[k] / F.col("variance")).alias(f"p{k}") for k in range(lookback)])
    vector = F.array(*[f"p{k}" for k in range(lookback)])
    risk = sums.select(*key, "left", (dot(vector, vector) / lookback / F.col("_i") ** 2).alias("v"))
    sides = risk.groupBy(*key).agg(F.max(F.when(F.col("left"), F.col("v"))).alias("l"), F.max(F.when(~F.col("left"), F.col("v"))).alias("r"))
    share = sides.select(*key, F.when(F.col("l") + F.col("r") > 0, 1 - F.col("l") / (F.col("l") + F.col("r"))).otherwise(0.5).alias("_left"))
    parts = steps.select("ticker", *key, "left").join(share, key).groupBy("rebalance_date", "ticker").agg(
        F.product(F.when(F.col("left"), F.col("_left")).otherwise(1 - F.col("_left"))).alias("w"))
    return leaves.select("rebalance_date", "ticker").join(parts, ["rebalance_date", "ticker"], "left").withColumn("w", F.coalesce("w", F.lit(1.0)))


def _bisection(x: np.ndarray, variance: np.ndarray) -> np.ndarray:
    """``bisected`` of one date's leaves, in order; a level adds up every half at once."""
    n = len(x)
    w, each, inverse = np.ones(n), x / variance[:, None], 1 / variance
    lo, hi = (np.array([0]), np.array([n])) if n > 1 else (np.zeros(0, int), np.zeros(0, int))
    while len(lo):
        mid = lo + (hi - lo) // 2
        ends = np.stack([lo, mid, hi], axis=1).ravel()
        ends = ends[:-1] if hi[-1] == n else ends
        of = lambda v: np.add.reduceat(v, ends, axis=0)
        own, total = of(each), of(inverse)
        risk = (own * own).sum(axis=1) / x.shape[1] / total**2
        left, right = risk[0::3], risk[1::3]
        with np.errstate(invalid="ignore"):
            share = np.where(left + right > 0, 1 - left / (left + right), 0.5)
        for start, end, part in ((lo, mid, share), (mid, hi, 1 - share)):
            size = end - start
            w[np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))] *= np.repeat(part, size)
        lo, hi = np.stack([lo, mid], axis=1).ravel(), np.stack([mid, hi], axis=1).ravel()
        lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    return w


def _alone(linkage: str, clusters: int | None, dense: int):
    """A date's weights from its vectors: tree, order of leaves and halves, or the halves of so many clusters."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("ticker", "ascending")], null_placement="at_end")).combine_chunks()
        n, variance = table.num_rows, table.column("variance").to_numpy()
        x = table.column("x").chunk(0).flatten().to_numpy().reshape(n, -1)
        # added up one after another, as ``dot`` does
        a, b, heights = merges(x / np.sqrt(np.cumsum(x * x, axis=1)[:, -1:]), linkage, dense)
        order = np.array(_leaves(n, zip(a.tolist(), b.tolist())))
        w, out = np.ones(n), table.select(["rebalance_date", "ticker"])
        if clusters is None:
            w[order] = _bisection(x[order], variance[order])
            return out.append_column("w", pa.array(w))
        low = np.argsort(heights, kind="stable")[:max(n - clusters, 0)]
        first = np.array(_cut(n, zip(a[low].tolist(), b[low].tolist())))
        place = np.empty(n, int)
        place[order] = np.arange(n)
        names, group = np.unique(first, return_inverse=True)
        inverse, begins, books = np.zeros(len(names)), np.full(len(names), n), np.zeros((len(names), x.shape[1]))
        np.add.at(inverse, group, 1 / variance)
        np.minimum.at(begins, group, place)
        np.add.at(books, group, x / variance[:, None])
        books /= inverse[:, None]
        by = np.argsort(begins)
        share = np.empty(len(names))
        share[by] = _bisection(books[by], np.maximum((books[by] ** 2).sum(axis=1) / x.shape[1], 1e-18))
        w = share[group] / variance / inverse[group]
        return out.append_column("cluster", table.column("ticker").take(pa.array(first))).append_column("w", pa.array(w))

    return run


def _in_tasks(windows: DataFrame, lookback: int, linkage: str, clusters: int | None, block: int) -> DataFrame | None:
    """A task a date, or None where a date has more assets than a task takes."""
    if linkage not in LINKAGES:
        raise ValueError(f"linkage must be one of {LINKAGES}")
    days, longest = windows.groupBy("rebalance_date").agg(F.count(F.lit(1)).alias("rows")).agg(F.count(F.lit(1)), F.max("rows")).first()
    if (longest or 0) > ALONE * block:
        return None
    # partitions enough that few dates share one: a date takes far longer than its rows do
    rows = varying(windows, lookback).select("rebalance_date", "ticker", "x", "variance").repartition(max(1, min(2000, 4 * days)), "rebalance_date")
    labels = "" if clusters is None else "cluster string, "
    return rows.groupBy("rebalance_date").applyInArrow(_alone(linkage, clusters, WHOLE * block), f"rebalance_date date, ticker string, {labels}w double")


def hrp(windows: DataFrame, lookback: int, linkage: str = "single", block: int = BLOCK, finish: int = FINISH) -> DataFrame:
    """Hierarchical risk parity: (rebalance_date, ticker, w), weights of 0 or more that sum to 1 on each date."""
    done = _in_tasks(windows, lookback, linkage, None, block)
    if done is not None:
        return settled(done)  # merged once, however often it is read
    rows = settled(varying(windows, lookback))
    return bisected(leaf_order(rows, linkage, 1, block, finish), lookback)


def hrp_with_clusters(windows: DataFrame, lookback: int, clusters: int, linkage: str = "ward", block: int = BLOCK, finish: int = FINISH) -> DataFrame:
    """The tree cut into clusters: inverse-variance weights within each, bisection over the clusters' portfolios."""
    done = _in_tasks(windows, lookback, linkage, clusters, block)
    if done is not None:
        return settled(done)
    rows = settled(leaf_order(settled(varying(windows, lookback)), linkage, clusters, block, finish))
    sums = [F.sum(F.col("x")[k] / F.col("variance")).alias(f"p{k}") for k in range(lookback)]
    books = rows.groupBy("rebalance_date", "cluster").agg(F.sum(1 / F.col("variance")).alias("_i"), F.min("pos").alias("_first"), *sums)
    books = settled(books.select("rebalance_date", F.col("cluster").alias("ticker"), "_i", "_first", F.array(*[F.col(f"p{k}") / F.col("_i") for k in range(lookback)]).alias("x")))
    # at most ``clusters`` rows a date
    places = books.groupBy("rebalance_date").agg(F.array_sort(F.collect_list(F.struct("_first", "ticker"))).alias("_l")).select(
        "rebalance_date", F.posexplode("_l").alias("pos", "_c")).select("rebalance_date", F.col("pos").cast("long").alias("pos"), F.col("_c.ticker").alias("ticker"))
    books = books.withColumn("variance", F.greatest(dot(F.col("x"), F.col("x")) / lookback, F.lit(1e-18)))
    shares = bisected(books.join(places, ["rebalance_date", "ticker"]), lookback)
    within = rows.join(books.select("rebalance_date", F.col("ticker").alias("cluster"), "_i"), ["rebalance_date", "cluster"])
    return within.join(shares.select("rebalance_date", F.col("ticker").alias("cluster"), F.col("w").alias("_share")), ["rebalance_date", "cluster"]).select(
        "rebalance_date", "ticker", "cluster", (F.col("_share") / F.col("variance") / F.col("_i")).alias("w"))
