import random
import zlib

import numpy as np

from tickerloom.llm import quality as Q
from tickerloom.llm import toxicity as T
from tickerloom.llm.learn import platt, runs

ROOT = "/root/testdata/sf0.1"


def auc(score, y):
    rank = np.empty(len(score))
    rank[np.argsort(score, kind="stable")] = np.arange(1, len(score) + 1)
    pos = (y == 1).sum()
    return (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


def test_windows_and_calibration():
    text, words = runs(np.array([0, 5, 0, 4, 1]), 4)
    assert text.tolist() == [1, 1, 3, 4] and words.tolist() == [4, 1, 4, 1]
    x = np.array([-2.0, -1, 0, 1, 2, 3] * 20)
    a, b = platt(x, (x > 0.5).astype(int))
    assert a > 0 and abs(b + 0.5 * a) < 1


def test_toxicity_word_scores_one_gram_at_a_time():
    rng = np.random.default_rng(1)
    table = rng.normal(size=1 << T.BUCKET_BITS)
    texts = ["Ab\tcdé x", None, "", "longer wording here"]
    buf, start, end, count = T.prepared(texts)
    assert count.tolist() == [3, 0, 0, 3]
    raw = buf.astype(np.uint8).tobytes()
    got = T.word_scores(table, buf, start, end)
    for s, e, value in zip(start, end, got):
        word, sizes = raw[s - 1:e + 1], []
        for n in T.GRAMS:
            for i in range(len(word) - n + 1):
                h = 0
                for c in word[i:i + n]:
                    h = (h * 0x01000193 + c) & 0xFFFFFFFF
                h = ((h ^ ((n - 1) * 0x5BD1E995 & 0xFFFFFFFF)) * 0x9E3779B1) & 0xFFFFFFFF
                sizes.append(table[h >> (32 - T.BUCKET_BITS)])
        assert abs(np.mean(sizes) - value) < 1e-9


def test_unseen_misspellings_share_subwords():
    rng = random.Random(2)
    plain = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 8))) for _ in range(300)]
    def doc(toxic):
        words = rng.choices(plain, k=60)
        for _ in range(3 * toxic):
            words[rng.randrange(60)] = "scoundrel" + rng.choice("abcdef")
        return " ".join(words)
    sample = [(doc(i % 2), i % 2) for i in range(240)]
    model = T.fit(sample)
    clean, bad = " ".join(rng.choices(plain, k=60)), " ".join(rng.choices(plain, k=60) + ["scoundrelzz"])
    low, high, none, blank = T.score(model, [clean, bad, None, " \n"])
    assert low < 0.3 and high > 0.5 and none == blank == 0.0


def test_attention_gradients_are_the_numerical_ones():
    rng = np.random.default_rng(3)
    net = Q.Attention(5)
    x, size, y = rng.normal(size=(7, 5)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])
    first, owner = np.array([0, 3, 4]), np.repeat(np.arange(3), size)

    def loss():
        p = Q.sigmoid(net.forward(x, first, owner)["logit"])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, g in net.gradients(x, first, owner, y).items():
        for i in np.ndindex(g.shape):
            v = net.p[k][i]
            net.p[k][i] = v + 1e-6
            up = loss()
            net.p[k][i] = v - 1e-6
            down = loss()
            net.p[k][i] = v
            assert abs((up - down) / 2e-6 - g[i]) < 1e-6


def test_passage_features_do_not_depend_on_the_batch():
    texts = ["THE!! CAPS!! " * 50, None, "", " \n lead", "one two two two\nthree é | *** 12", "w " * 200]
    text, x = Q.passages(texts)
    assert text.tolist() == [0, 0, 3, 4, 5, 5, 5, 5] and x.shape[1] == Q.FEATURES
    for i, t in enumerate(texts):
        assert np.allclose(Q.passages([t])[1], x[text == i])


def held_out_rows(out, labels, name):
    y = {r["doc_id"]: r[name] for r in labels.collect()}
    rows = out.collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    rows = [r for r in rows if r["held_out"] and r["doc_id"] in y]
    return np.array([r["score"] for r in rows]), np.array([y[r["doc_id"]] for r in rows]), np.array([r["predicted"] for r in rows])


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{ROOT}/documents.parquet"), spark.read.parquet(f"{ROOT}/labels.parquet")
    s, y, p = held_out_rows(Q.quality_report(docs, labels), labels, "quality")
    assert auc(s, y) > 0.99 and (p == y).mean() > 0.98
    s, y, p = held_out_rows(T.toxicity_report(docs, labels), labels, "toxic")
    # 305 toxic documents to learn from
    assert auc(s, y) > 0.95 and p[y == 0].mean() < 0.01 and p[y == 1].mean() > 0.6


def test_no_labels_nulls_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "some text", 0.5), (1, "some text", 0.5), (None, None, 0.1), (2, "", 0.1)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bad = spark.createDataFrame([(None, 1, 1), (1, None, None), (1, 1, 0), (1, 0, 1), (5, 7, 7)], "doc_id long, quality int, toxic int")
    for labels in (none, bad):
        for report in (Q.quality_report, T.toxicity_report):
            rows = report(docs, labels).collect()
            assert sorted(r["score"] for r in rows) == [0.0, 0.0, 0.5, 0.5]
            assert report(docs.limit(0), labels).count() == 0
    assert Q.accepted(docs, none).columns == docs.columns


def test_scores_mean_the_same_when_the_sample_evens_the_labels_out(spark):
    rng = random.Random(7)
    kinds = {"ALL! CAPS! 12 | * HERE! " * 4: 0.95, "plain words in a quiet line " * 4: 0.8}
    rows = [(i, text, int(rng.random() < share)) for i in range(3000) for text, share in [list(kinds.items())[i % 2]]]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 1 - y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    for module, good in ((Q, lambda s: s), (T, lambda s: 1 - s)):
        got = good(module.score(module.trained(docs, labels, rows=300), list(kinds)))  # 150 of either label
        for s, text in zip(got, kinds):
            want = np.mean([y for _, t, y in known if t == text])
            assert abs(s - want) < 0.12, (module.__name__, s, want)
    few = [("x", 0)] * 40 + [("x", 1)]
    assert abs(Q.fit([("", y) for _, y in few], (0.1, 1.0))["base"] - 1.5 / 402) < 1e-9
    assert abs(T.fit(few, (0.1, 1.0))["base"] - 1.5 / 402) < 1e-9


def test_toxic_phrase_counts_wherever_it_stands():
    rng = np.random.default_rng(8)
    table = rng.normal(size=1 << T.BUCKET_BITS)
    phrase, fill = "vile rotten wretched scum", "so it is"
    weigh = lambda t: T.word_scores(table, *T.prepared([t])[:3])
    table -= weigh(fill).max() + 9
    for w in phrase.split():  # toxic words, and no others, have high scores
        for b in (b for _, b in T.buckets(T.prepared([w])[0])):
            table[b] = 9.0
    whole = T.worst(table, 0.5, [phrase])[0]
    for before in range(9):
        text = " ".join([*(fill.split() * 3)[:before], phrase, fill])
        assert abs(T.worst(table, 0.5, [text])[0] - whole) < 1e-9
    # all windows against one at a time, in a batch with short, blank and repeating texts
    texts = ["a", None, "x y z", "b b b b c", "one two two three four five five", " \n", "p q r s"]
    text, odds = T.window_scores(table, 0.5, texts)
    want = []
    for i, t in enumerate(texts):
        words = (t or "").split()
        for at in range(max(len(words) - T.WINDOW + 1, min(len(words), 1))):
            lot = words[at:at + T.WINDOW]
            one = [weigh(w)[0] for w, before in zip(lot, [None, *lot]) if w != before]
            want.append((i, sum(one) / T.WINDOW + 0.5))
    assert text.tolist() == [i for i, _ in want] and np.allclose(odds, [v for _, v in want])


def test_sample_is_bounded_where_ids_repeat(spark):
    """50,000 rows of one labelled id and a text beyond the bound: one row an id, whatever the rows."""
    from tickerloom.llm.common import LONGEST, labelled_sample
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = spark.range(50_000).selectExpr(f"{ids[0]} AS doc_id", "concat('copy ', id % 7) AS text")
    rows = rows.union(spark.createDataFrame([(i, f"text {i}") for i in ids[1:]] + [(ids[1], "text")], "doc_id int, text string"))
    rows = rows.union(spark.range(1).selectExpr("99 AS doc_id", f"repeat('x', {LONGEST + 1}) AS text"))
    labels = spark.createDataFrame([(i, i % 2) for i in [*ids, 99]], "doc_id int, toxic int")
    got, _ = labelled_sample(rows, labels, "toxic", 4000, "toxic:")
    again, _ = labelled_sample(rows.repartition(5), labels, "toxic", 4000, "toxic:")
    assert len(got) == len(ids) and got == again and max(len(t) for t, _ in got) < 20
