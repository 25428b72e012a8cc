import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tickerloom.llm import residual as R
from tickerloom.llm import wordends as W


def reference_ids(tokenizer, text):
    return np.asarray(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("cut", [5, 1 << 20])
def test_units_are_encoded_as_the_whole_pipeline_does(monkeypatch, cut):
    monkeypatch.setattr(W, "SLICE", cut)
    e, rng = W.UnitEncoder(R.vocabulary_file(None), cache_units=50), random.Random(cut)
    texts = ["", " ", "it's I'LL we'd", "<|endoftext|> <|startoftext|>x", "É é J̌ ΣΑΣ İ ǅ", "a\x1cb c d\te", "12 34x½²", "日本語 テキスト 😀", "ªº µ ß ŒUVRE"]
    texts += ["".join(rng.choice("abcDE ,.'s1\n\téÀ́ſ½ ") for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += [" ".join(rng.choice(["The", "the,", "Ère.", "of", "x-y", "--", "a.b", "c.,"]) for _ in range(30)) for _ in range(50)]
    assert e.by_unit
    for t in texts + [None]:
        assert b"".join(e.slices(t)) == reference_ids(e.tokenizer, t)


def slow_best_fit(lengths, capacity):
    loads = []
    for n in lengths:
        fits = [i for i, v in enumerate(loads) if v + n <= capacity]
        if fits:
            loads[max(fits, key=lambda i: loads[i])] += n
        else:
            loads.append(n)
    return sorted(loads)


def test_best_fit_and_what_goes_on():
    rng = random.Random(3)
    for _ in range(200):
        cap = rng.choice([7, 64, 100])
        lengths = sorted((rng.randint(1, cap) for _ in range(rng.randrange(60))), reverse=True)
        bins, offsets, loads = R.best_fit(lengths, cap)
        assert sorted(loads) == slow_best_fit(lengths, cap)
        assert (np.asarray(loads) <= cap // 2).sum() <= 1
        at = defaultdict(int)
        for n, b, o in zip(lengths, bins, offsets):
            assert o == at[b]
            at[b] += n
        if loads:
            on = R.going_on(np.asarray(loads), cap, 3)
            rest = np.delete(np.asarray(loads), on)
            assert (rest > cap // 2).all() and len(on) <= 4


def check(rows, docs, capacity, tokenizer):
    """Every id once, gapless sequences; returns the number of sequences and of ids."""
    by_row, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_row[r["row"]].append(r)
        by_bin[r["sequence_id"]].append(r)
    got = []
    for parts in by_row.values():
        parts.sort(key=lambda r: r["piece"])
        at = 0
        for i, r in enumerate(parts):
            assert (r["piece"], r["start"]) == (i, at) and (r["length"] == capacity or i == len(parts) - 1)
            at += r["length"]
        got.append((repr(parts[0]["doc_id"]), at, tuple(r["ids_crc32"] for r in parts)))
    want = []
    for doc_id, text in docs:
        ids = reference_ids(tokenizer, text) + b"\x01\0\0\0"
        cuts = [ids[a:a + 4 * capacity] for a in range(0, len(ids), 4 * capacity)]
        want.append((repr(doc_id), len(ids) // 4, tuple(zlib.crc32(c) for c in cuts)))
    assert sorted(got) == sorted(want)
    total = 0
    for parts in by_bin.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        total += at
    return len(by_bin), total


@pytest.mark.parametrize("parts,batch", [(1, 400_000), (40, 400_000), (5, 7)])
def test_tree_of_any_height(spark, parts, batch):
    rng = random.Random(parts)
    tok = W.UnitEncoder(R.vocabulary_file(None)).tokenizer
    docs = [(i if i % 50 else None, " ".join(rng.choices(["the", "Packing", "of", "größe", "qzx."], k=rng.choice([0, 1, 9, 30, 60, 150])))) for i in range(500)]
    docs += [(7, None), (8, ""), (7, None)] + docs[1:4]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, bin string, load int")
    cut, _ = R.written(R.pieces(df, 64), "test-pieces")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        used, total = check(R.placed(cut, 64, fan=3, batch=batch).collect(), docs, 64, tok)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    # few pieces a partition leave little choice; the bound is the number of full sequences
    assert used <= (-(-total // 64) + 2 if parts == 1 else 1.03 * total / 64)


def test_wide_items_are_not_sent_up(spark):
    """All pieces of 0.6 of the capacity: no two fit, and only a few bins of each partition go on."""
    df = spark.createDataFrame([(i, "a " * 59) for i in range(3000)], "doc_id long, text string")
    rows = R.placed(R.pieces(df, 100), 100)
    assert rows.count() == rows.select("sequence_id").distinct().count() == 3000


def test_report_and_sequences(spark):
    rng = random.Random(9)
    tok = W.UnitEncoder(R.vocabulary_file(None)).tokenizer
    docs = [(i, " ".join(rng.choices(["one", "two", "trois"], k=rng.choice([0, 10, 500, 6000])))) for i in range(60)] + [(None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    used, total = check(R.pack_report(df).collect(), docs, 4096, tok)
    assert used <= -(-total // 4096) + 1
    made = R.sequences(df).collect()
    assert len(made) == used and all(len(r["ids"]) == 4 * r["length"] <= 4 * 4096 for r in made)
    ids = np.sort(np.concatenate([np.frombuffer(r["ids"], "<u4") for r in made]))
    want = np.sort(np.concatenate([np.frombuffer(reference_ids(tok, t) + b"\x01\0\0\0", "<u4") for _, t in docs]))
    assert (ids == want).all()


def test_empty_table(spark):
    assert R.pack_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
