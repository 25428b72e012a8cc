"""Fill-in-middle transformation by block rotation inside one buffer.

A text is cut at two places between its units (a word with the white space before it; white space at
the end is a unit of its own). The sentinels go into a bytearray before prefix, middle and suffix, and
the blocks are brought into the order of the form by rotations: two neighbouring blocks change places
when each is reversed and then both together. Nothing but the buffer holds the text, and a reversal
moves at most ``BLOCK`` bytes at a time. The inverse rotation, found from the sentinels in the output
alone, and the deletion of the sentinels give the text back byte for byte.

Cuts and form depend on the hash of seed and id, so reruns agree and every row stands for itself:
nothing is shuffled, and a lost task repeats its own rows only.

Defined cases: a null text is an empty one and stays plain, as does a text that holds a sentinel; a
null id is hashed as an empty string; repeated rows give repeated results; an empty table gives no
rows; input columns other than ``doc_id`` and ``text`` are ignored, whatever their names. A long text takes
about four times its bytes: the row, its buffer and the output; units are counted in slices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from tickerloom.llm.common import batched_texts, text_of

SEED, RATE, SPM_SHARE = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
BLOCK = 1 << 16
SLICE = 1 << 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def reverse(buf: bytearray, i: int, j: int) -> None:
    """Reverse buf[i:j] in place, a block from either end at a time."""
    while j - i > 2 * BLOCK:
        head = buf[i:i + BLOCK]
        buf[i:i + BLOCK] = buf[j - BLOCK:j][::-1]
        buf[j - BLOCK:j] = head[::-1]
        i, j = i + BLOCK, j - BLOCK
    buf[i:j] = buf[i:j][::-1]


def rotate(buf: bytearray, a: int, b: int, c: int) -> None:
    """Exchange the neighbouring blocks buf[a:b] and buf[b:c]."""
    reverse(buf, a, b)
    reverse(buf, b, c)
    reverse(buf, a, c)


def _ends(raw: bytes, start: int) -> np.ndarray:
    """Where units end within the slice that begins at ``start``; the end of the text ends one."""
    part = np.frombuffer(raw, np.uint8, min(SLICE + 1, len(raw) - start), start)
    word = ~((part == 32) | ((part >= 9) & (part <= 13)))
    ends = np.flatnonzero(word[:-1] & ~word[1:]) + (start + 1)
    return np.append(ends, len(raw)) if start + SLICE >= len(raw) else ends


class Units:
    """Number and places of the units of a text, from slices of it."""

    def __init__(self, raw: bytes):
        self.raw, self.held = raw, (-1, None)
        counts = [len(self._of(s)) for s in range(0, len(raw), SLICE)]
        self.before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        self.n = int(self.before[-1])

    def _of(self, start: int) -> np.ndarray:
        if self.held[0] != start:
            self.held = (start, _ends(self.raw, start))
        return self.held[1]

    def end(self, k: int) -> int:
        """Byte position after the first ``k`` units."""
        if not k:
            return 0
        s = int(np.searchsorted(self.before, k, "left")) - 1
        return int(self._of(s * SLICE)[k - 1 - int(self.before[s])])


def code_points(raw: bytes, start: int, stop: int) -> int:
    n = 0
    for s in range(start, stop, SLICE):
        part = np.frombuffer(raw, np.uint8, min(SLICE, stop - s), s)
        n += int(np.count_nonzero((part & 0xC0) != 0x80))
    return n


def transform(text: str | None, doc_id: int | None, seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    raw = (text or "").encode("utf-8")
    units = Units(raw)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[4 * i:4 * i + 4], "big") for i in range(4))
    if not raw or h3 % 100 >= rate or any(m in raw for m in (PREFIX, SUFFIX, MIDDLE)):
        return units.n, "plain", None, None, text or ""
    low, high = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    a, b = units.end(low), units.end(high)
    buf = bytearray(raw)
    for at, mark in ((b, SUFFIX), (a, MIDDLE), (0, PREFIX)):  # from the right: the places before it stay
        buf[at:at] = mark
    m, s = a + len(PREFIX), b + len(PREFIX) + len(MIDDLE)
    form = "spm" if h4 % 100 < spm_share else "psm"
    rotate(buf, 0 if form == "spm" else m, s, len(buf))
    return units.n, form, code_points(raw, 0, a), code_points(raw, a, b), buf.decode("utf-8")


def restore(output: str, form: str) -> str:
    """The text that ``transform`` brought into this form."""
    if form == "plain":
        return output
    buf = bytearray(output.encode("utf-8"))
    if form == "psm":
        s, m = buf.index(SUFFIX), buf.index(MIDDLE)
        rotate(buf, s, m, len(buf))
        m, s = s, s + len(buf) - m
    else:
        p, m = buf.index(PREFIX), buf.index(MIDDLE)
        rotate(buf, 0, p, len(buf))
        m, s = m - p, len(buf) - p
    for at, mark in ((s, SUFFIX), (m, MIDDLE), (0, PREFIX)):
        del buf[at:at + len(mark)]
    return buf.decode("utf-8")


def infilled(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE) -> DataFrame:
    """One row per document: its units, form, lengths of prefix and middle, and the output text."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, texts = frame["doc_id"].tolist(), frame["text"].tolist()
            ids = [None if pd.isna(i) else int(i) for i in ids]
            for a, b in batched_texts(texts):
                rows = [(i, *transform(t, i, seed, rate, spm_share)) for i, t in zip(ids[a:b], texts[a:b])]
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({"doc_id": "Int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInPandas(run, SCHEMA)


def restored(output: str = "output", form: str = "form"):
    """Column of the texts that the output and form columns stand for."""

    @pandas_udf("string")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([restore(o, f) for o, f in zip(outputs, forms)], dtype=object)

    return back(output, form)


def infill_report(docs: DataFrame, **options) -> DataFrame:
    """The transformed documents with digests in place of output and restored text."""
    return infilled(docs, **options).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), c AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM t
), p AS (
  SELECT *, array_to_string(u[1:least(x, y)], '') AS pre, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS mid,
         array_to_string(u[greatest(x, y) + 1:n], '') AS suf
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
