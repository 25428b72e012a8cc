import random
import re

import numpy as np
import pytest

from tickerloom.llm import chunks as C


def slow_cuts(text):
    """Word starts where chunks begin, one byte at a time."""
    raw = text.encode() + b"\n"
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    low = []
    for s, _ in words:
        h = 0
        for b in raw[max(0, s - 16):s]:
            h = (2 * h + int(C.GEAR[b])) % 65536
        low.append(s >= 16 and h < C.BOUND and s != words[0][0])
    begins = [i for i in range(len(words)) if i == 0 or (low[i] and not low[i - 1] and not (i > 1 and low[i - 2]))]
    return [(words[i][0], words[j - 1][1], words[j][0] if j < len(words) else len(raw) - 1, j - i)
            for i, j in zip(begins, begins[1:] + [len(words)])]


def some_words(rng, n):
    return ["%s%d" % (rng.choice("abcdé"), rng.randrange(10**6)) for _ in range(n)]


def test_chunks_match_the_rule_one_byte_at_a_time():
    rng = random.Random(1)
    texts = [rng.choice([" ", "\n", "  "]).join(some_words(rng, n)) for n in (0, 1, 2, 3, 5, 40, 400)] + [None, "", " \n", " lead and trail ", "x" * 5000]
    text, first, last, stop, words, _, offsets = C.cut(texts)
    for i, t in enumerate(texts):
        m = text == i
        got = list(zip((first[m] - offsets[i]).tolist(), (last[m] - offsets[i]).tolist(), (stop[m] - offsets[i]).tolist(), words[m].tolist()))
        assert got == (slow_cuts(t) if (t or "").strip() else [])


def slow_spans(rows):
    """rows: (id, text) with distinct ids"""
    chunks = {i: slow_cuts(t) for i, t in rows}
    raw = {i: (t or "").encode() for i, t in rows}
    kept = {}
    for i in sorted(raw):
        for s, e, _, _ in chunks[i] if (raw[i]).strip() else []:
            kept.setdefault(raw[i][s:e], i)
    out = []
    for i in raw:
        run = []
        for c in [*(chunks[i] if raw[i].strip() else []), None]:
            if c and kept[raw[i][c[0]:c[1]]] < i and (not run or run[-1][2] == c[0]):
                run.append(c)
                continue
            if sum(x[3] for x in run) >= C.MIN_WORDS:
                out.append((i, run[0][0], run[-1][2], sum(x[3] for x in run)))
            run = [c] if c and kept[raw[i][c[0]:c[1]]] < i else []
    return out


@pytest.mark.parametrize("hot", [C.HOT, 10**6])
def test_spans_against_brute_force_and_passages_are_caught(spark, monkeypatch, hot):
    # with a million, every digest is hot and dealt over the salts
    monkeypatch.setattr(C, "HOT", hot)
    rng = random.Random(2)
    passages = [some_words(rng, n) for n in (51, 60, 90, 200)]
    rows, planted, clean = [], set(), set()
    for i in range(80):
        words = some_words(rng, rng.choice([0, 3, 50, 300]))
        if i % 4 == 0:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passages[i // 4 % 4]
            if i >= 16:
                planted.add(i)
        elif i > 60:
            words = rows[rng.randrange(1, 60)][1].split(" ")
        else:
            clean.add(i)
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string").repartition(3)
    got = [(r["doc_id"], r["at"], r["stop"], r["words"]) for r in C.spans(df).collect()]
    assert sorted(got) == sorted(slow_spans(rows))
    found = {g[0] for g in got}
    assert planted <= found and not clean & found
    # taken out: nothing but the spans, and what is left holds no repeat
    left = {r["doc_id"]: r["text"] for r in C.deduplicated(df).collect()}
    for i, t in rows:
        raw, at, keep = (t or "").encode(), 0, b""
        for _, a, b, _ in sorted(g for g in got if g[0] == i):
            keep += raw[at:a]
            at = b
        want = (keep + raw[at:]).decode()
        if at and not want.split():
            assert i not in left
        else:
            assert left[i] == want
    again = spark.createDataFrame(list(left.items()), "doc_id long, text string")
    assert C.spans(again).count() <= 1


def test_an_insertion_moves_chunks_without_changing_them():
    rng = random.Random(3)
    words = some_words(rng, 400)
    a, b = " ".join(words), " ".join(words[:100] + ["inserted"] + words[100:])
    parts = lambda t: {t.encode()[s:e] for s, e, _, _ in slow_cuts(t)}
    assert len(parts(a) & parts(b)) > 0.9 * len(parts(a))


def test_nulls_repeated_ids_and_no_rows(spark):
    p = " ".join(some_words(random.Random(4), 80))
    rows = [(None, p), (None, p), (1, p), (1, p), (1, "other " + p + " end"), (2, None), (3, ""), (5, p + " own words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = C.deduplicated(df).collect()
    assert sorted(map(repr, (r["doc_id"] for r in left))) == sorted(["1", "1", "1", "2", "3", "5"])
    assert {r["text"] for r in left if r["doc_id"] == 1} == {p, "other " + p + " end"}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert C.spans(empty).count() == 0 and C.deduplicated(empty).count() == 0


def copied_words(a, b):
    """Most words of neighbouring chunks of b that are chunks of a."""
    def parts(t):
        _, first, last, _, words, buf, _ = C.cut([t])
        return [(buf[i:j].tobytes(), n) for i, j, n in zip(first, last, words)]

    held, run, best = {p for p, _ in parts(a)}, 0, 0
    for p, n in parts(b):
        run = run + n if p in held else 0
        best = max(best, run)
    return best


def test_shared_passages_of_repeated_words_are_found():
    rng = random.Random(6)
    for period in (1, 1, 1, 2, 2, 3, 4) * 20:
        cycle = some_words(rng, period)
        passage = [cycle[i % period] for i in range(rng.choice([51, 60, 90]))]
        a, b = (" ".join([*some_words(rng, rng.randrange(5, 60)), *p, *some_words(rng, 30)]) for p in (passage, passage[rng.randrange(period):]))
        assert copied_words(a, b) >= C.MIN_WORDS
    # stretches of one word after the other
    for _ in range(40):
        passage = [w for w in some_words(rng, 3) for _ in range(20)]
        a, b = (" ".join([*some_words(rng, rng.randrange(5, 60)), *passage, *some_words(rng, 30)]) for _ in range(2))
        assert copied_words(a, b) >= C.MIN_WORDS
    # a text's chunks do not depend on its batch
    texts = [" ".join(["again"] * n) for n in (1, 3, 40, 100)] + [None, "x y " * 50]
    both = C.cut(texts)
    for i, t in enumerate(texts):
        assert C.cut([t])[4].tolist() == both[4][both[0] == i].tolist()


def test_chunks_of_different_documents_are_no_passage(spark):
    rng = random.Random(11)
    text = " ".join(some_words(rng, 400))
    parts = [text.encode()[s:e].decode() for s, e, *_ in slow_cuts(text)]
    half = len(parts) // 2
    # each chunk of the later text stands in an earlier document: no two side by side, but for the last half
    rows = [(i, p) for i, p in enumerate(parts[:half])] + [(1000, " ".join(parts[half - 4:])), (2000, text)]
    found = C.spans(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id = 2000").collect()
    begin = len(" ".join(parts[:half - 4]).encode())
    assert len(found) == 1 and found[0]["at"] > begin and found[0]["kept_doc_id"] == 1000
