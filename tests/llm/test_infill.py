import hashlib
import random
import re

import pytest

from tickerloom.llm import infill as I

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(text, doc_id):
    """Independent of the buffer: by units and string joins."""
    text = text or ""
    u = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return len(u), "plain", None, None, text
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h4 % 100 < 80:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("block,cut", [(1, 1), (2, 3), (7, 5), (1 << 16, 1 << 20)])
def test_rotation_and_slices_of_any_size(monkeypatch, block, cut):
    monkeypatch.setattr(I, "BLOCK", block)
    monkeypatch.setattr(I, "SLICE", cut)
    rng = random.Random(block)
    for n in range(120):
        buf = bytearray(rng.randbytes(rng.randrange(60)))
        a, b, c = sorted(rng.choices(range(len(buf) + 1), k=3))
        want = buf[:a] + buf[b:c] + buf[a:b] + buf[c:]
        I.rotate(buf, a, b, c)
        assert buf == want
        text = "".join(rng.choice("ab<PSM> \n\té日😀 ") for _ in range(rng.randrange(40)))
        for i in (n, n + 1000):
            got = I.transform(text, i)
            assert got == brute(text, i) and I.restore(got[4], got[1]) == text


def test_documents(spark):
    rng = random.Random(5)
    texts = [None, "", " ", "\n\n", "a", " a", "a ", "x <P> y", "<S", "M><", "<<P", "é à", "a\x00b c"]
    texts += ["".join(rng.choice("abc é\n <>") for _ in range(rng.randrange(300))) for _ in range(300)] + ["wörd " * 400_000]
    rows = [(i if i != 20 else None, t, "form", 1) for i, t in enumerate(texts)]
    rows += rows[15:18]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted((tuple(r) for r in I.infilled(df).collect()), key=key)
    want = sorted(((i, *brute(t, i)) for i, t, *_ in rows), key=key)
    assert got == want and {r[2] for r in got} == {"plain", "psm", "spm"}
    sha = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    report = sorted((tuple(r) for r in I.infill_report(df).collect()), key=key)
    assert report == sorted(((*w[:5], sha(w[5]), sha(r[1])) for w, r in zip(want, sorted(rows, key=key))), key=key)


def test_empty_table(spark):
    assert I.infill_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
