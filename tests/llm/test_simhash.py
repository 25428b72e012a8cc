import random

import pytest
import re

import xxhash

from tickerloom.llm import simhash as S
from tickerloom.llm.components import connected


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hs = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > n)


def slow_groups(fps):
    """fps: [(id, fp)] -> {position: smallest id reachable}"""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    out = {}
    for i in range(len(fps)):
        ids = [fps[j][0] for j in range(len(fps)) if find(j) == find(i) and fps[j][0] is not None]
        out[i] = min(ids, default=None)
    return out


def test_whole_operator_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["w%d" % i for i in range(60)] + ["É", "ß", "ÀB"]
    texts = [" ".join(rng.choices(vocab, k=rng.choice([0, 1, 2, 3, 40, 200]))) for _ in range(120)]
    for t in texts[:60]:
        words = t.split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append("\t".join(words))
    texts += [None, "", "  \n", "A\x1cB c d", "Same text here", "same TEXT  here"] + ["copy of one text " * 30] * 5
    ids = list(range(len(texts)))
    ids[7] = ids[8]  # a repeated id
    ids[-1] = None
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").selectExpr("*", "1 AS fp", "'x' AS component_id")
    got = S.near_duplicates(df).collect()
    prints = [slow_print(t) for t in texts]
    groups = slow_groups(list(zip(ids, prints)))
    want = [(ids[i], f"{prints[i]:016x}", groups[i]) for i in range(len(ids))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    kept = S.one_of_each(df).collect()
    assert {r["doc_id"] for r in kept} == set(groups.values())
    # one row of every group, also where groups share an id
    own = slow_groups(list(enumerate(prints)))
    place = {texts[i]: own[i] for i in range(len(texts))}
    assert sorted(place[r["text"]] for r in kept) == sorted(set(own.values()))


@pytest.mark.parametrize("rows,want", [
    ([(1, "a"), (2, "a"), (2, "b")], {(1, "a"), (2, "b")}),
    ([(2, "a"), (2, "b"), (3, "b")], {(2, "a"), (2, "b")}),
    ([(4, "a"), (4, "a"), (None, "a"), (None, "c"), (None, "c")], {(4, "a"), (None, "c")}),
    ([(5, None), (6, ""), (5, " ")], None),
])
def test_no_group_loses_its_only_text(spark, rows, want):
    """Ids that repeat with other texts, equal rows, rows without ids."""
    texts = {"a": "one two three four five six seven", "b": "alpha beta gamma delta epsilon zeta", "c": "red green blue black white grey"}
    df = spark.createDataFrame([(i, texts.get(t, t), "x") for i, t in rows], "doc_id long, text string, root string").repartition(3)
    got = {(r["doc_id"], r["text"]) for r in S.one_of_each(df).collect()}
    if want is None:  # all empty: one group, of which one row of the smallest id stays
        assert len(got) == 1 and got <= {(5, None), (5, " ")}
    else:
        assert got == {(i, texts[t]) for i, t in want}
    assert S.one_of_each(df).count() == len(got)


def test_long_lists_are_split_and_lose_no_link(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(63)
    fps = {centre}
    while len(fps) < 300:
        fps.add((rng.choice(sorted(fps)) ^ (1 << rng.randrange(40)) ^ (1 << rng.randrange(40))) & (2**63 - 1))
    fps |= {rng.getrandbits(63) for _ in range(50)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r["node"]: r["root"] for r in connected(S.links(df, limit=16)).collect()}
    groups = slow_groups([(f, f) for f in fps])
    assert {f: roots.get(f, f) for f in fps} == {fps[i]: g for i, g in groups.items()}


def test_components_of_chains_and_no_links(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 90)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(df).count() == 0 and S.one_of_each(df).count() == 0
