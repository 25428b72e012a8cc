import random
import time
import zlib

import numpy as np
import pytest

from tickerloom.llm import rangecoder as R
from tickerloom.llm import token_files as T
from tickerloom.llm.tokens import Encoder


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    blocks = [(rng.integers(0, 50257, n), [(5, n, 0), (None, 1, 3)]) for n in (0, 1, 5, 100, 1500)]
    blocks += [(np.full(3000, 7), []), (np.arange(6000) % 50, [(-1, 6000, 0)]), (np.full(500, 50256), [])]
    coded = R.encode_blocks(blocks, 50257)
    for (ids, docs), (got, got_docs) in zip(blocks, R.decode_blocks(coded, 50257)):
        assert got.tolist() == list(ids) and got_docs == docs
    assert len(coded[5]) < 200  # a run costs next to nothing
    # each block is decoded alone, from a reset state
    assert R.decode_blocks([coded[4]], 50257)[0][0].tolist() == blocks[4][0].tolist()
    assert R.encode_blocks([], 50257) == [] and R.decode_blocks([], 50257) == []


def test_damage_is_found():
    (coded,) = R.encode_blocks([(np.arange(200), [])], 50257)
    for i in (0, 6, len(coded) // 2, len(coded) - 1):
        with pytest.raises(ValueError):
            R.decode_blocks([coded[:i] + bytes([coded[i] ^ 1]) + coded[i + 1:]], 50257)


def test_files_give_back_every_document_in_order(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["the", "file", "of", "Wörter", "qzx", "\n"], k=rng.choice([0, 1, 7, 300, 9000]))) for _ in range(60)]
    rows = [(i * 3 % 61, t, "x", 0) for i, t in enumerate(texts)] + [(70, None, "x", 0), (71, "", "x", 0), (3, texts[1], "x", 0), (None, "no id", "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, start int").repartition(3)
    got = sorted(T.round_trip(df).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    enc, at = Encoder(), 0
    by_id = {}
    for i, t, *_ in rows:
        by_id.setdefault(i, set()).add(enc.encode([t])[0] + b"\x02\0\0\0")
    for r in got:
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in {(len(b) // 4, zlib.crc32(b)) for b in by_id[r["doc_id"]]}
        at += r["n_tokens"]
    path = T.shared_folder(spark, "test-token-files")
    T.write(df, path)
    whole = T.read(spark, path).collect()
    assert sorted((r["doc_id"] or -1, len(r["ids"]) // 4, zlib.crc32(r["ids"])) for r in whole) == sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in got)


def test_empty_table(spark):
    assert T.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_block_learns_from_all_of_its_ids():
    rng = np.random.default_rng(3)
    follows, ids = rng.permutation(5000), rng.integers(0, 5000, R.BLOCK // 8)
    for i in np.flatnonzero(rng.random(len(ids) - 1) < 0.8).tolist():
        ids[i + 1] = follows[ids[i]]
    (coded,) = R.encode_blocks([(ids, [])], 50257)
    assert len(coded) * 8 < 7 * len(ids)  # alone, an id has 12.3 bits
    assert R.decode_blocks([coded], 50257)[0][0].tolist() == ids.tolist()


def test_coding_takes_a_fraction_of_a_microsecond_an_id():
    ids = np.minimum(np.random.default_rng(5).zipf(1.2, 1_000_000), 50256)

    def seconds(f):
        begin = time.process_time()
        return f(), time.process_time() - begin

    _, usual = seconds(lambda: sum(range(50_000_000)))  # some 1.2 s
    for _ in range(3):  # other work on the machine may slow one down
        coded, one = seconds(lambda: R.encode_blocks([(ids[i:i + R.BLOCK], []) for i in range(0, len(ids), R.BLOCK)], 50257))
        got, other = seconds(lambda: R.decode_blocks(coded, 50257))
        assert np.array_equal(np.concatenate([g for g, _ in got]), ids)
        if one + other < 0.5 * usual:
            return
    raise AssertionError(f"{one + other:.2f} s for a million ids, where a sum of 50 million numbers takes {usual:.2f} s")


def test_blocks_that_can_not_be_coded_are_refused():
    for ids, size in (([50257], 50257), ([1], 1 << 18), (np.zeros(R.BLOCK + 1), 50257)):
        with pytest.raises(ValueError):
            R.encode_blocks([(np.asarray(ids), [])], size)


def test_documents_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 50)
    texts = ["", "one", "of the " * 400, "end of it"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    path, enc = T.shared_folder(spark, "test-token-files"), Encoder()
    T.write(df, path)
    sizes = spark.read.parquet(path)
    assert sizes.count() > 30 and sizes.filter("ids > 50").isEmpty()
    got = {r["doc_id"]: bytes(r["ids"]) for r in T.read(spark, path).collect()}
    assert got == {i: enc.encode([t])[0] + b"\x02\0\0\0" for i, t in enumerate(texts)}


def test_unseen_words_get_the_ids_of_the_whole_pipeline():
    rng = random.Random(9)
    parts = ["ab", "Ünï", "é", "ß", "x1", "٣", "½", "中文", "жук", "'s", "'ll", "'", ".", ",&&&", "%%%", "-", "…", "»", "\n", "\n\n", "\t", "\r", "\x1f", "\xa0", " ", "é", "ª", "_", "😀", "\0"]
    texts = [" ".join("".join(rng.choices(parts, k=rng.choice([1, 2, 3, 5]))) for _ in range(rng.choice([1, 4, 30]))) for _ in range(3000)]
    enc = Encoder(cache_words=500)  # generations pass
    for text, got in zip(texts, enc.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
