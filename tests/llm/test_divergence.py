import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tickerloom.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top=50):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = [s for l, s in groups if l == lang]
        whole = sum((counts[lang, s] for s in sources), Counter())

        def prices(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q, p = prices(whole), {s: prices(counts[lang, s]) for s in sources}
        for s in sources:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            out |= {(lang, s, "pair", o, -v, i) for i, (v, o) in enumerate(sorted(pair), 1)}
            term = [(q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "term", t.decode(), -v, i) for i, (v, t) in enumerate(sorted(term)[:top], 1)}
    return out


def test_prices_are_exact():
    rng = random.Random(1)
    for _ in range(500):
        total = rng.randrange(1, 10 ** rng.randrange(1, 16))
        n = rng.randrange(0, total + 1)
        assert int(D.price(np.array([n]), total)[0]) == 1 + 10**9 * (n + 5) // total


@pytest.mark.parametrize("stretch", [1, 3, 256])
def test_gallop_finds_what_both_hold(monkeypatch, stretch):
    monkeypatch.setattr(D, "STRETCH", stretch)
    rng = np.random.default_rng(stretch)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, rng.integers(1, 300), rng.integers(0, 80))) for _ in range(2))
        s, l = D.gallop(a, b)
        assert a[s].tolist() == np.intersect1d(a, b).tolist() and (a[s] == b[l]).all()


@pytest.mark.parametrize("block", [5, 4096])
def test_rows_equal_brute_force(spark, monkeypatch, block):
    rng = random.Random(block)
    words = ["the", "The", "of", "été", "ÉTÉ", "日本", "x1y", "a-b", "zz", "qu", "İ", " n"] + [chr(97 + i) * k for i in range(20) for k in (1, 2)]
    rows = []
    for i in range(400):
        lang = rng.choice(["en", "en", "en", "fr", None, ""])
        source = rng.choice(["s0", "s0", "s0", "s1", "s2", "é", None])
        rows.append((lang, source, " ".join(rng.choices(words[i % 7:], k=rng.choice([0, 1, 5, 40])))))
    rows += [("de", "s0", "einzig"), ("it", "s0", None), ("it", "s1", "12 34"), ("en", "none", "  "), ("en", "s1", "a\x00b")] + rows[:5]
    df = spark.createDataFrame([(*r, 1) for r in rows], "lang string, source string, text string, value int").repartition(3)
    got = [tuple(r) for r in D.audit(df, min_docs=20, block=block).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 20)


def test_partial_counts_flush(spark, monkeypatch):
    monkeypatch.setattr(D, "HELD", 3)
    rows = [("en", f"s{i % 3}", "a b c d " * (i % 4)) for i in range(60)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1)
    got = {tuple(r) for r in D.audit(df, min_docs=10).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == brute(rows, 10)


def test_empty_table(spark):
    assert D.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0
