import numpy as np
import pandas as pd
import pytest

from tickerloom.llm import forest as R

ROOT = "/root/testdata/sf0.1"


def brute(ids, x, k=20, every=20):
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = x @ x[q]
        order = sorted((i for i in range(len(ids)) if i != q), key=lambda i: (-s[i], ids[i]))[:k]
        out[int(ids[q])] = [(int(ids[i]), s[i]) for i in order]
    return out


def rows_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("sample", [R.SAMPLE, 500])
def test_recall_and_exact_scores(spark, monkeypatch, sample):
    # with 500, most vectors were not there when the forest was fitted
    monkeypatch.setattr(R, "SAMPLE", sample)
    df = spark.read.parquet(f"{ROOT}/embeddings.parquet").repartition(3)
    table = df.toPandas()
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(float)
    want, got, at = brute(ids, x), rows_of(R.nearest(df)), {i: k for k, i in enumerate(ids)}
    assert set(want) == set(got) and all(len(v) == 20 for v in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    for q, found in got.items():
        assert q not in {i for i, _ in found} and found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert np.allclose([s for _, s in found], [x[at[i]] @ x[at[q]] for i, _ in found], rtol=0, atol=1e-12)


def test_all_leaves_give_the_exact_result_with_copies_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (300, 4)).astype(float)
    x[50:120] = x[50]  # a vector that many rows hold
    x[~x.any(axis=1)] = 1.0
    ids = rng.permutation(600)[:300]
    df = spark.createDataFrame([(int(i), v.tolist(), 1.0) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, score double")
    monkeypatch.setattr(R, "LEAF", 16)
    monkeypatch.setattr(R, "PART", 8)
    got = rows_of(R.nearest(df, leaves=10**6))
    assert got == brute(ids, x)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]),
            (40, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (-20, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = rows_of(R.nearest(df))
    assert got == {0: [(20, 0.5), (3, 0.0), (-20, -1.0)], 20: [(0, 0.5), (3, 0.5), (-20, -0.5)], -20: [(3, 0.0), (20, -0.5), (0, -1.0)]}
    assert R.nearest(df.limit(0)).count() == 0 and R.nearest(df.filter("vec_id = 0")).count() == 0


def test_forest_alone_on_many_vectors():
    """Recall of the opened leaves, the share of the table they hold, and that a bar cuts off none of the nearest found."""
    rng, k, n = np.random.default_rng(7), 20, 50_000
    x = rng.normal(size=(n, 4)) @ rng.normal(size=(4, 32)) + 0.01 * rng.normal(size=(n, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = R.Index(pd.DataFrame({"entry": np.arange(R.SAMPLE), "v": list(x[:R.SAMPLE])}), n, k, R.TREES, None)
    leaf, hit, read = index.forest.leaf(x), [], []
    asked = np.arange(n - 200, n)
    for i, (found, bar) in zip(asked, index.ask(x[asked], k)):
        candidate = np.isin(leaf, found).any(axis=1)
        candidate[i] = False
        score = x @ x[i]
        score[i] = -np.inf
        own = np.sort(score[candidate])[-k:]
        assert len(own) == k and own[0] >= bar
        hit.append(np.mean(candidate[np.argsort(-score)[:k]]))
        read.append(candidate.mean())
    assert np.mean(hit) >= 0.9 and np.mean(read) <= 0.1, (np.mean(hit), np.mean(read))
