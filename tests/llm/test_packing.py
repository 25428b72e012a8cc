import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tickerloom.llm import packing as P
from tickerloom.llm.tokens import Encoder


@pytest.mark.parametrize("n", [1, 2, 3, 477, 1365, 2047, 2048, 2049, 10_000])
def test_pieces_have_reciprocal_lengths(n):
    cut = P.cut_lengths(n)
    assert sum(cut) == n and all(any(2048 // k == c for k in range(1, 2049)) for c in cut)


def test_words_are_encoded_as_the_whole_pipeline_does():
    e, rng = Encoder(), random.Random(1)
    texts = ["", " ", "  a", "a ", "a\n b", "a \nb", "it's I'll 12 34x", "<|endoftext|> x", "é ü　x 　y", "a\x1c b", "日本語 テキスト 😀"]
    texts += ["".join(rng.choice("ab ,.'s1\n\té ") for _ in range(40)) for _ in range(2000)]
    for t, ids in zip(texts, e.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids
    small = Encoder(cache_words=3)
    assert small.encode(texts) == e.encode(texts) and e.encode([None]) == [b""]


def test_every_id_lies_once_and_sequences_are_gapless(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["the", "packing", "of", "Wörter", "qzx", "\n"], k=rng.choice([0, 1, 7, 300, 3000]))) for _ in range(90)] + [None, "", "y" * 9000]
    rows = [(i if i != 5 else None, t, "x", 1) for i, t in enumerate(texts)] + [(0, texts[0], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, start int").repartition(3)
    got = P.packed(df).collect()
    enc, docs, bins = Encoder(), defaultdict(list), defaultdict(list)
    for r in got:
        docs[r["row"]].append(r)
        bins[r["sequence_id"]].append(r)
    want = sorted((i, enc.encode([t])[0] + b"\x01\0\0\0") for i, t, *_ in [(x[0] if x[0] is not None else -1, x[1]) for x in rows])
    built = []
    for parts in docs.values():
        parts.sort(key=lambda r: r["start"])
        at = 0
        for r in parts:
            assert r["start"] == at and r["length"] == len(r["ids"]) // 4
            at += r["length"]
        assert {r["doc_tokens"] for r in parts} == {at}
        built.append((parts[0]["doc_id"] if parts[0]["doc_id"] is not None else -1, b"".join(r["ids"] for r in parts)))
    assert sorted(built) == want
    total = padded = 0
    for parts in bins.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        total, padded = total + at, padded + (at if at & (at - 1) == 0 else 2048)
    assert padded / total < 1.01
    for r in P.pack_report(df).select("doc_id", "start", "ids_crc32", "length").collect():
        if r["doc_id"] == 1:
            part = dict((i, b) for i, b in want)[1][4 * r["start"]:4 * (r["start"] + r["length"])]
            assert r["ids_crc32"] == zlib.crc32(part)


def test_empty_table(spark):
    assert P.packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
