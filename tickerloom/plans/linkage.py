"""The merge tree of one date's vectors in one task, without a matrix of them.

A task holds the vectors and, for each cluster, the few clusters nearer than a radius of its own (``LISTED`` of them, by a
sample): a pair that is in neither list is known to be at least as far as both radii. Clusters that are
each other's nearest, with a distance within both radii, merge without another look at the rest. What a merged cluster's
list can't tell any more is measured again, its members against all others, a strip at a time; two clusters that both ask are
measured once. At most ``dense`` clusters are finished on their matrix.

Strips are measured in single precision, with vectors that are nearly equal (correlation over ``HOT``) in double, and decide
only which pairs are listed; radii give way by the error. Every listed distance is then taken from
the members in double precision, and so is every height.

Equal vectors join the first of them at height 0. Ties go to the pair that comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Clusters listed with each, the sample that its radius is taken from, and rows that are kept where the sample found none nearer.
LISTED, SAMPLE, LEAST = 24, 4096, 8
#: Clusters of a strip's rows and of a block of its columns; pairs of vectors gathered at a time, and from where on a pair of clusters is multiplied.
ROWS, COLUMNS, GATHERED, LARGE = 256, 4096, 40_000, 4096
#: Correlation from which single precision doesn't tell distances, and the error of those below (64 roundings over 4 distances of 0.1).
HOT, ERROR = 0.98, 1e-5


def closest(d: np.ndarray, size: np.ndarray, linkage: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All merges on a matrix of distances, which is used up: always the closest pair, the first among equals.

    Every cluster's nearest is kept, so a merge reads one row of the matrix and those of clusters whose nearest is gone.
    """
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, near = size.astype(float), d.argmin(axis=1)
    low = d[np.arange(n), near]
    a, b, heights = np.zeros(n - 1, int), np.zeros(n - 1, int), np.zeros(n - 1)
    for k in range(n - 1):
        i = int(low.argmin())
        j = int(near[i])
        height, di, dj = d[i, j], d[i], d[j]
        a[k], b[k], heights[k] = i, j, height
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
        d[i], d[:, i], d[j], d[:, j] = new, new, np.inf, np.inf
        size[i] += size[j]
        low[j] = np.inf
        lost = np.isfinite(low) & ((near == i) | (near == j))
        lost[i] = False
        closer = (new < low) | ((new == low) & (i < near))
        closer &= np.isfinite(new) & ~lost
        low[closer], near[closer] = new[closer], i
        for c in (i, *np.flatnonzero(lost)):
            near[c] = d[c].argmin()
            low[c] = d[c, near[c]]
    return a, b, heights


def apart(z: np.ndarray, linkage: str) -> np.ndarray:
    """The matrix of distances of vectors of length 1; changed in place, as a copy is as large."""
    d = z @ z.T
    if linkage == "ward":
        sq = (z * z).sum(axis=1)
        d *= -2
        d += sq[:, None]
        d += sq[None, :]
        np.maximum(d, 0, out=d)
        d /= 4
    else:
        np.subtract(1, d, out=d)
        d /= 2
        np.maximum(d, 0, out=d)
        np.sqrt(d, out=d)
    return np.minimum(d, d.T)


class _Clusters:
    """Clusters by the place of their first vector, and the pairs of them whose distance is known."""

    def __init__(self, z: np.ndarray, weight: np.ndarray, linkage: str):
        self.linkage, self.ward = linkage, linkage == "ward"
        # ward's clusters are a centroid each; for the others half a product is half a correlation
        self.z = z.copy() if self.ward else z * np.sqrt(0.5)
        self.z32 = self.z.astype(np.float32)
        self.weight = weight.astype(float)
        self.even = bool((weight == 1).all())
        n = len(z)
        self.size, self.label, self.alive = self.weight.copy(), np.arange(n), np.ones(n, bool)
        self.joined, self.radius = False, np.full(n, -np.inf)
        self.a, self.b, self.d = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        self.rng = np.random.default_rng(7)
        self._placed()

    def _placed(self) -> None:
        """Members of each cluster, one after another; single linkage lists vectors."""
        if self.linkage in ("ward", "single"):
            self.order, self.start, self.count = np.arange(len(self.z)), np.arange(len(self.z)), self.alive.astype(int)
        else:
            self.order = np.argsort(self.label, kind="stable")
            self.count = np.bincount(self.label, minlength=len(self.z))
            self.start = np.cumsum(self.count) - self.count

    def error(self, ids: np.ndarray) -> np.ndarray:
        return self.size[ids] * ERROR / 2 if self.ward else np.full(len(ids), ERROR)

    def by_count(self, ids: np.ndarray) -> np.ndarray:
        return ids[np.argsort(-self.count[ids], kind="stable")]

    def blocks(self, ids: np.ndarray, step: int) -> Iterator[tuple[int, np.ndarray, list]]:
        """Where a block begins, its clusters, and their members: the first of each, then the second of those that have one, and so on.

        Clusters come with the most members first, so the k-th members belong to the first clusters of a block. Members go in
        groups, (vectors, how many of each k), that are multiplied at once.
        """
        for lo in range(0, len(ids), step):
            part = ids[lo:lo + step]
            lengths = np.searchsorted(-self.count[part], -np.arange(self.count[part[0]]), "left")
            group = (np.cumsum(lengths) - lengths) // max(step, 512)
            members = []
            for g in range(int(group[-1]) + 1):
                ks = np.flatnonzero(group == g)
                if len(ks):
                    members.append((np.concatenate([self.order[self.start[part[:lengths[k]]] + k] for k in ks]), lengths[ks].tolist()))
            yield lo, part, members

    def between(self, rows: tuple, columns: tuple, double: bool = False, held: dict | None = None) -> np.ndarray:
        """Distances of two blocks' clusters."""
        (p, row_groups), (q, column_groups) = rows, columns
        z, held = self.z if double else self.z32, {} if held is None else held
        terms = int(self.count[p[0]] * self.count[q[0]])
        kind = np.float64 if double or terms > 64 else np.float32
        total = None
        for r, rs in row_groups:
            zr = z[r]
            for at, (c, cs) in enumerate(column_groups):
                key = (double, id(column_groups), at)
                if key not in held:
                    held[key] = z[c]
                zc = held[key]
                g = zr @ zc.T
                if self.ward:
                    n_p, n_q = self.size[p].astype(kind)[:, None], self.size[q].astype(kind)[None, :]
                    g *= -2
                    g += (zr * zr).sum(axis=1)[:, None]
                    g += (zc * zc).sum(axis=1)[None, :]
                    np.maximum(g, 0, out=g)
                    g *= n_p * n_q / (2 * (n_p + n_q))
                    return g
                np.subtract(0.5, g, out=g)
                if double:
                    np.maximum(g, 0, out=g)
                else:
                    hot = np.flatnonzero(g < (1 - HOT) / 2)
                    if len(hot) > g.size // 64:
                        g = np.maximum(0.5 - self.z[r] @ self.z[c].T, 0).astype(np.float32)
                    elif len(hot):
                        u, v = np.divmod(hot, g.shape[1])
                        for lo in range(0, len(hot), GATHERED):
                            s = slice(lo, lo + GATHERED)
                            g.ravel()[hot[s]] = np.maximum(0.5 - np.einsum("ij,ij->i", self.z[r[u[s]]], self.z[c[v[s]]]), 0)
                if self.linkage == "average":
                    np.sqrt(g, out=g)
                    if not self.even:
                        g *= self.weight[r].astype(g.dtype)[:, None]
                        g *= self.weight[c].astype(g.dtype)[None, :]
                if terms == 1:
                    total = g
                    break
                if total is None:
                    total = np.full((len(p), len(q)), 0, kind)
                i = 0
                for n in rs:
                    j = 0
                    for m in cs:
                        part = total[:n, :m]
                        (np.add if self.linkage == "average" else np.maximum)(part, g[i:i + n, j:j + m], out=part)
                        j += m
                    i += n
        if self.linkage == "average":
            if not (self.even and terms == 1):
                total /= self.size[p].astype(kind)[:, None]
                total /= self.size[q].astype(kind)[None, :]
        else:
            np.sqrt(total, out=total)
        if self.linkage == "single" and self.joined:
            total[self.label[p][:, None] == self.label[q][None, :]] = np.inf
        return total

    def exact(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of pairs of clusters, from their members."""
        out = np.zeros(len(a))
        if self.ward:
            for at in range(0, len(a), GATHERED):
                s = slice(at, at + GATHERED)
                gap = self.z[a[s]] - self.z[b[s]]
                n, m = self.size[a[s]], self.size[b[s]]
                out[s] = np.einsum("ij,ij->i", gap, gap) / 2 * (n * m / (n + m))
            return out
        pairs = self.count[a] * self.count[b]
        some = np.flatnonzero(pairs <= LARGE)
        ends = np.cumsum(pairs[some])
        lo = 0
        while lo < len(some):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + GATHERED, "right")))
            e = some[lo:hi]
            n, m = pairs[e], self.count[b[e]]
            first = np.cumsum(n) - n
            within = np.arange(int(n.sum())) - np.repeat(first, n)
            u, v = np.divmod(within, np.repeat(m, n))
            u, v = self.order[np.repeat(self.start[a[e]], n) + u], self.order[np.repeat(self.start[b[e]], n) + v]
            g = np.sqrt(np.maximum(0.5 - np.einsum("ij,ij->i", self.z[u], self.z[v]), 0))
            if self.linkage == "average":
                out[e] = np.add.reduceat(g if self.even else g * self.weight[u] * self.weight[v], first) / (self.size[a[e]] * self.size[b[e]])
            else:
                out[e] = np.maximum.reduceat(g, first)
            lo = hi
        for e in np.flatnonzero(pairs > LARGE):
            u, v = (self.order[self.start[c]:self.start[c] + self.count[c]] for c in (a[e], b[e]))
            found = []
            for at in range(0, len(u), 64):
                r = u[at:at + 64]
                for to in range(0, len(v), COLUMNS):
                    c = v[to:to + COLUMNS]
                    g = np.sqrt(np.maximum(0.5 - self.z[r] @ self.z[c].T, 0))
                    found.append(self.weight[r] @ g @ self.weight[c] if self.linkage == "average" else g.max())
            out[e] = sum(found) / (self.size[a[e]] * self.size[b[e]]) if self.linkage == "average" else max(found)
        return out

    def measure(self, asked: np.ndarray) -> None:
        """Lists of some clusters, from their distances to all others."""
        every = np.flatnonzero(self.alive)
        n = len(every)
        asked = self.by_count(asked)
        others = self.by_count(np.setdiff1d(every, asked, assume_unique=True))
        fresh = np.zeros(len(self.alive), bool)
        fresh[asked] = True
        kept = ~(fresh[self.a] | fresh[self.b])
        reach = self.radius + self.error(np.arange(len(self.alive)))
        reach[asked] = np.inf
        if n > 2 * LISTED:
            drawn = self.by_count(self.rng.choice(every, min(n, SAMPLE), replace=False))
            place, rank = max(1, round(LISTED * len(drawn) / n)), np.full(len(self.alive), -1)
            rank[drawn] = np.arange(len(drawn))
            columns, held = [(p, m) for _, p, m in self.blocks(drawn, COLUMNS)], {}
            for _, part, members in self.blocks(asked, ROWS):
                v = np.concatenate([self.between((part, members), c, held=held) for c in columns], axis=1)
                own = rank[part]
                v[np.flatnonzero(own >= 0), own[own >= 0]] = np.inf
                at = min(place, v.shape[1] - 1)
                reach[part] = np.partition(v, at, axis=1)[:, at]
        a, b = [self.a[kept]], [self.b[kept]]
        # a strip's columns begin with its own rows: those before have met it
        columns = [(lo, p, m) for lo, p, m in self.blocks(asked, COLUMNS)] + [(len(asked) + lo, p, m) for lo, p, m in self.blocks(others, COLUMNS)]
        held: dict = {}
        for lo, part, members in self.blocks(asked, ROWS):
            far = reach[part].astype(np.float32)[:, None]
            for at, q, of in columns:
                if at + len(q) <= lo:
                    continue
                v = self.between((part, members), (q, of), held=held)
                near = v < far
                near |= v < reach[q].astype(np.float32)[None, :]
                i, j = np.divmod(np.flatnonzero(near), len(q))
                later = at + j > lo + i
                a.append(part[i[later]])
                b.append(q[j[later]])
        self.radius[asked] = reach[asked] - self.error(asked)
        known = int(kept.sum())
        a, b = np.concatenate(a), np.concatenate(b)
        a, b = np.minimum(a, b), np.maximum(a, b)
        self.a, self.b, self.d = a, b, np.concatenate([self.d[kept], self.exact(a[known:], b[known:])])
        best = self.best(self.a, self.b)
        self._equals(asked[best[asked] > self.radius[asked] + 1e-12], every)

    def _equals(self, asked: np.ndarray, every: np.ndarray) -> None:
        """Lists of clusters with too many equally near for a radius by the sample: the first few of all, in double precision."""
        n, asked, columns = len(self.alive), self.by_count(asked), self.by_count(every)
        blocks, held, back = [(p, m) for _, p, m in self.blocks(columns, COLUMNS)], {}, np.argsort(columns)
        pairs = []
        for _, part, members in self.blocks(asked, 16):
            v = np.concatenate([self.between((part, members), c, True, held) for c in blocks], axis=1)[:, back]
            v[np.arange(len(part)), np.searchsorted(every, part)] = np.inf
            some = np.argsort(v, axis=1, kind="stable")[:, :LEAST]
            found = np.take_along_axis(v, some, axis=1)
            self.radius[part] = found[:, -1]
            a, b = np.repeat(part, some.shape[1]), every[some.ravel()]
            pairs.append((np.minimum(a, b) * n + np.maximum(a, b))[np.isfinite(found.ravel())])
        if pairs:
            a, b = np.divmod(np.setdiff1d(np.concatenate(pairs), self.a * n + self.b), n)
            self.a, self.b, self.d = np.concatenate([self.a, a]), np.concatenate([self.b, b]), np.concatenate([self.d, self.exact(a, b)])

    def best(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(self.alive), np.inf)
        np.minimum.at(out, a, self.d)
        np.minimum.at(out, b, self.d)
        return out

    def nearest(self) -> tuple[np.ndarray, np.ndarray]:
        """The place among the listed pairs of each cluster's nearest, -1 where the list doesn't tell it; and its distance."""
        a, b, radius = self.a, self.b, self.radius
        if self.linkage == "single":
            a, b, radius = self.label[a], self.label[b], np.full(len(self.alive), np.inf)
            np.minimum.at(radius, self.label, self.radius)
        best = self.best(a, b)
        at = [np.flatnonzero((self.d == best[own]) & (best <= radius + 1e-12)[own]) for own in (a, b)]
        own, pair = np.concatenate([a[at[0]], b[at[1]]]), np.concatenate(at)
        order = np.lexsort((self.b[pair], self.a[pair], own))
        order = order[np.r_[True, own[order][1:] != own[order][:-1]]] if len(order) else order
        near = np.full(len(self.alive), -1)
        near[own[order]] = pair[order]
        return near, best

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join each ``b`` to its ``a``; clusters meet in one pair only."""
        n, to = len(self.alive), np.arange(len(self.alive))
        to[b] = a
        na, nb = self.size[a], self.size[b]
        if self.linkage == "average":
            self.radius[a] = (na * self.radius[a] + nb * self.radius[b]) / (na + nb)
        else:
            self.radius[a] = (np.maximum if self.linkage == "complete" else np.minimum)(self.radius[a], self.radius[b])
        if self.ward:
            self.z[a] = (self.z[a] * na[:, None] + self.z[b] * nb[:, None]) / (na + nb)[:, None]
            self.z32[a] = self.z[a]
        self.size[a] += nb
        self.alive[b] = False
        self.label = to[self.label]
        self._placed()
        changed = np.zeros(n, bool)
        changed[a] = True
        u, v = to[self.a], to[self.b]
        again = changed[u] | changed[v]
        key = np.unique((np.minimum(u, v) * n + np.maximum(u, v))[again & (u != v)])
        p, q = np.divmod(key, n)
        d = self.exact(p, q)
        within = d <= np.maximum(self.radius[p], self.radius[q]) + 1e-12
        self.a, self.b, self.d = (np.concatenate([x[~again], y[within]]) for x, y in ((self.a, p), (self.b, q), (self.d, d)))

    def matrix(self) -> tuple[np.ndarray, np.ndarray]:
        """The clusters left and their distances."""
        every = np.flatnonzero(self.alive)
        ids = self.by_count(every)
        d, n = np.empty((len(ids), len(ids))), len(ids)
        columns, held = list(self.blocks(ids, COLUMNS)), {}
        for lo, part, members in self.blocks(ids, ROWS):
            for at, q, of in columns:
                if at + len(q) > lo:
                    d[lo:lo + len(part), at:at + len(q)] = self.between((part, members), (q, of), True, held)
        for lo in range(0, n, ROWS):
            hi = min(lo + ROWS, n)
            d[lo:hi, lo:hi] = np.minimum(d[lo:hi, lo:hi], d[lo:hi, lo:hi].T)
            d[hi:, lo:hi] = d[lo:hi, hi:].T
        if (ids != every).any():
            back = np.argsort(ids)
            for lo in range(0, n, ROWS):
                d[lo:lo + ROWS] = d[lo:lo + ROWS, back]
            d = d[back]
        return every, d


def _spanning(c: _Clusters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Single linkage: the nearest pair out of any set of joined vectors is in the spanning tree, so one side's list will do.

    The largest set never asks.
    """
    out, left = [], len(c.z)
    c.measure(np.arange(left))
    while left > 1:
        open_ = c.label[c.a] != c.label[c.b]
        c.a, c.b, c.d = c.a[open_], c.b[open_], c.d[open_]
        near, best = c.nearest()
        pairs = np.unique(near[near >= 0])
        if not len(pairs):
            largest = np.bincount(c.label).argmax()
            c.measure(np.flatnonzero((c.label != largest) & (c.radius < best[c.label])))
            continue
        up = np.arange(len(c.z)).tolist()

        def find(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        kept = []
        for e, u, v in zip(pairs.tolist(), c.label[c.a[pairs]].tolist(), c.label[c.b[pairs]].tolist()):
            u, v = sorted((find(u), find(v)))
            if u != v:
                up[v] = u
                kept.append(e)
        c.label, c.joined, left = np.array([find(i) for i in range(len(up))])[c.label], True, left - len(kept)
        out.append((c.a[kept], c.b[kept], c.d[kept]))
    a, b, d = (np.concatenate(x) for x in zip(*out))
    return a, b, d


def _agglomerated(c: _Clusters, dense: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    out, left, own = [], len(c.z), np.arange(len(c.z))
    c.measure(own)
    while left > max(dense, 1):
        near, best = c.nearest()
        a = np.flatnonzero(near >= 0)
        a = a[(c.a[near[a]] == a) & (near[c.b[near[a]]] == near[a])]
        if len(a):
            b = c.b[near[a]]
            out.append((a, b, best[a]))
            left -= len(a)
            c.merge(a, b)
        else:
            c.measure(np.flatnonzero(c.alive & (near < 0)))
    if left > 1:
        every, d = c.matrix()
        a, b, heights = closest(d, c.size[every], c.linkage)
        out.append((every[a], every[b], heights))
    a, b, d = (np.concatenate(x) for x in zip(*out))
    return a, b, d


def merges(z: np.ndarray, linkage: str, dense: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All merges of vectors of length 1, in an order in which they may be done: two clusters by the place of a member, and height."""
    n, out = len(z), []
    first, weight = np.arange(n), np.ones(n)
    if linkage == "single" or n > dense:
        rows = np.ascontiguousarray(z + 0.0)
        rows = rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
        _, first, back, weight = np.unique(rows, return_index=True, return_inverse=True, return_counts=True)
        copies = np.setdiff1d(np.arange(n), first)
        of = first[back[copies]]
        by = np.lexsort((copies, of))
        out.append((of[by], copies[by], np.zeros(len(copies))))
        by = np.argsort(first)
        first, weight = first[by], weight[by]
        z = z[first] if len(copies) else z
    if len(z) > 1:
        if len(z) <= dense:
            d = apart(z, linkage) if linkage != "ward" or (weight == 1).all() else _Clusters(z, weight, linkage).matrix()[1]
            a, b, heights = closest(d, weight, linkage)
        elif linkage == "single":
            a, b, heights = _spanning(_Clusters(z, weight, linkage))
        else:
            a, b, heights = _agglomerated(_Clusters(z, weight, linkage), dense)
        out.append((first[a], first[b], heights))
    a, b, heights = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    if linkage == "single":  # a spanning tree's edges come as they were found, a matrix's merges in their order
        order = np.argsort(heights, kind="stable") if len(z) <= dense else np.lexsort((np.maximum(a, b), np.minimum(a, b), heights))
        a, b, heights = a[order], b[order], heights[order]
    return a, b, heights
