import random

import numpy as np

from tickerloom.llm import licenses as L

ROOT = "/root/testdata/sf0.01"
PLAIN = {"Apache": "licensed under the apache license", "MIT": "released under the mit license", "GPL": "gnu general public license, version 3",
         "CC-BY-NC": "cc by-nc 4.0"}


def test_families_against_their_notices(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    rows = {r["doc_id"]: r for r in L.license_report(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(rows) == set(texts)
    for i, t in texts.items():
        said = {f for f, x in PLAIN.items() if x in t.lower()}
        assert rows[i]["family"] in said if said else rows[i]["family"] in (None, "Proprietary")
        assert rows[i]["pieces"] == sum(1 for _ in L.pieces(t))
        if rows[i]["family"]:
            assert rows[i]["probability"] >= L.SURE and rows[i]["likeness"] >= L.LIKE and rows[i]["licence_pieces"] > 0


def test_variations_are_told_apart_and_near_misses_are_unknown():
    rng = random.Random(1)
    words = ["w%d" % i for i in range(500)]
    corpus = [" ".join(rng.choices(words, k=200)) for _ in range(60)]
    model = L.fit(corpus)
    good = {
        "Apache": "This file is LICENSED under the Apache License, Version 2.0!", "MIT": "w1 w2 Released under the MIT License. w3 w4",
        "GPL": "this work is licensed under the GNU general public license version 3", "CC-BY-NC": "licensed under cc by-nc 4.0",
        "LGPL": "This library is licensed under the GNU Lesser General Public License, version 3."}
    count, found = L.classified(model, list(good.values()), L.Numbers())
    assert [(i, f) for i, f, *_ in found] == list(enumerate(good)) and count.tolist() == [1] * len(good)
    bad = ["the license under version public", "He was released under the sun", "a licensed driver gave general permission to the public", None, "", "\n \n"]
    count, found = L.classified(model, bad + corpus[:5], L.Numbers())
    assert found == [] and count[3:6].tolist() == [0, 0, 0]
    # a long paragraph holds it, and a small bound on kept words changes nothing
    long = " ".join(rng.choices(words, k=3000)) + " Released under the MIT License. " + " ".join(rng.choices(words, k=3000))
    assert {f for _, f, *_ in L.classified(model, [long], L.Numbers(10))[1]} == {"MIT"}


def test_grams_stay_in_their_piece():
    n = L.Numbers()
    one, two = n.of(["a", "b", "c"]), n.of(["d", "e"])
    alone = [L.buckets(x, np.zeros(len(x), int)) for x in (one, two)]
    both = L.buckets(np.concatenate([one, two]), np.array([0, 0, 0, 1, 1]))
    for k in range(L.GRAMS):
        assert both[k].tolist() == alone[0][k].tolist() + alone[1][k].tolist()


def test_nulls_repeated_rows_and_no_rows(spark):
    text = "x y\nReleased under the MIT License.\nz"
    df = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (None, None, None), (2, "", "b"), (None, text, "c")], "doc_id long, text string, family string")
    got = sorted(((r["doc_id"], r["family"], r["licence_pieces"]) for r in L.license_report(df).collect()), key=repr)
    assert got == sorted([(1, "MIT", 1), (1, "MIT", 1), (None, None, 0), (2, None, 0), (None, "MIT", 1)], key=repr)
    assert L.license_report(df.limit(0)).count() == 0
