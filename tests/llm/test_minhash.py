import hashlib
import random
import re

import numpy as np

from tickerloom.llm import minhash as M


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def texts_of(rng, n=60):
    vocab = ["w%d" % i for i in range(80)] + ["É", "ß", "ÀB", "Long" * 30]
    return [" ".join(rng.choices(vocab, k=rng.choice([0, 1, 4, 5, 6, 60, 300]))) for _ in range(n)]


def test_shingles_are_those_of_the_text():
    texts = texts_of(random.Random(1)) + [None, "", " ", "a b c d e", "A  b\tc\nd e", "A B C D E "]
    hashes, first = M.shingle_hashes(texts)
    seen = {}
    for t, a, b in zip(texts, first, first[1:]):
        want, got = shingle_set(t), set(hashes[a:b].tolist())
        assert len(want) == len(got)
        for s in want:
            seen.setdefault(s, set())
        alone = M.shingle_hashes([t])[0]
        assert alone.tolist() == hashes[a:b].tolist()
    assert M.fingerprints(["a b c d e"]).tolist() == M.fingerprints(["A  b\tc\nd e\n"]).tolist()
    assert len(set(M.shingle_hashes(["a b", "b a", "ab", "a", "b", "ba"])[0].tolist())) == 6


def test_likeness_estimates_jaccard():
    rng, errors = random.Random(2), []
    for _ in range(60):
        a = [rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(400)]
        b = a[:rng.randrange(400)] + [str(rng.random()) for _ in range(50)]
        x, y = " ".join(a), " ".join(b)
        p = M.fingerprints([x, y])
        s, t = shingle_set(x), shingle_set(y)
        errors.append((p[0] == p[1]).mean() - len(s & t) / len(s | t))
    assert np.abs(errors).max() < 0.18 and abs(np.mean(errors)) < 0.03


def test_report_against_brute_force(spark):
    rng = random.Random(3)
    texts = [t or "" for t in texts_of(rng, 70)]
    rows = [(i * 2, t, "x", 9) for i, t in enumerate(texts)] + [(7, None, "x", 9), (9, "", "x", 9), (11, texts[5], "x", 9)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, print string, part int").repartition(3)
    got = {r["doc_id"]: r for r in M.edited_report(df).collect()}
    order = sorted((i, t or "") for i, t, *_ in rows)
    assert len(got) == len(order)
    hexed = lambda p: p.tobytes().hex()
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        h = len(t) // 2
        e = t[:len(t) - h] + nxt[:h]
        p, q, n = M.fingerprints([t])[0], M.fingerprints([e])[0], M.fingerprints([nxt])[0]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (hexed(p), hexed(q))
        assert (r["near_edited"], r["near_next"]) == ((p == q).mean(), (p == n).mean())


def test_one_document_null_id_and_none(spark):
    (r,) = M.edited_report(spark.createDataFrame([(None, "one two three four five six")], "doc_id long, text string")).collect()
    assert r["doc_id"] is None and r["near_next"] == 1.0
    assert M.edited_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_duplicates_lose_no_link(spark):
    rng, texts = random.Random(5), []
    for _ in range(12):
        words = [str(rng.random()) for _ in range(rng.choice([3, 60, 200]))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(9)):
            words = list(words)
            words[rng.randrange(len(words))] = str(rng.random())
            texts.append(" ".join(words))
    texts += [texts[0]] * 5 + [None, "", " "]
    sets = [shingle_set(t) for t in texts]
    group = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                u = len(sets[i] | sets[j])
                if group[i] != group[j] and (len(sets[i] & sets[j]) / u if u else 1.0) >= 0.8:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for limit in (M.LIST, 4):
        assert {r["doc_id"]: r["class_id"] for r in M.near_duplicates(df, limit=limit).collect()} == dict(enumerate(group))


def test_pairs_at_the_threshold_share_a_band(spark):
    rng, texts = random.Random(9), []
    for _ in range(150):
        words = [str(rng.random()) for _ in range(100)]
        other = words[:89] + [str(rng.random()) for _ in range(11)]
        other[89] = words[89]
        texts += [" ".join(words), " ".join(other)]
    for a, b in zip(texts[::2], texts[1::2]):
        s, t = shingle_set(a), shingle_set(b)
        assert 0.8 <= len(s & t) / len(s | t) < 0.83
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in M.near_duplicates(df).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}
