"""Divergence between the sources of a language: pair tasks over sorted term counts.

Each language keeps the terms that stand in at least ``MIN_DOCS`` of its documents. A group (language,
source) gives each kept term the price ``1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V))``: N is
the sum of its counts, V the number of kept terms. The distance of two groups is the sum of the
absolute differences of their prices over all kept terms.

Documents are counted where they are read; a task sends on partial counts by (language, term), so
counts, document frequencies and the choice of terms need one exchange. The kept terms of a language are
dealt into blocks of about ``BLOCK`` terms by hash and numbered within the block, in order. A group is
then one row a block: its term ids, ascending, and their counts. For every unordered pair of groups and
every block the two rows meet in a co-group, and the shorter list gallops through the longer one: ids in both, ids on
one side only, and (after the sum over blocks) ids in neither are each priced, and the sum counts for
both directions. The language as a whole takes part as a group of its own, whose pairs give the terms
that a group uses more than its language does.

A task holds two rows of a block, however large a group, a language or the table is. The rows of a
group travel once for each partner, as the result itself has a row for each.

Integers only: a price is a long division in base 1000, exact below 9e15 occurrences a group.

Defined cases: null text, language and source count as ''; a repeated row is a document of its own; a
group without terms has prices for the count 0; a language that keeps no term gives pairs of value 0;
a language of one source gives no pairs; an empty table gives no rows; other input columns are ignored.
A long text takes about its bytes twice and its distinct terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import written

MIN_DOCS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Terms of a block, and of a stretch of the shorter list that gallops at once.
BLOCK, STRETCH = 4096, 256
#: Tables of languages or groups up to so many rows are broadcast; beyond, they are joined by shuffle.
FEW = 100_000
#: Partial counts a task holds before it sends them on.
HELD = 400_000
#: Counts of a term travel as one number: occurrences above, documents in the low bits, sent on before these are full.
DOC_BITS = 22

#: Bytes of terms: ASCII letters, lower-cased, and all of a non-ASCII character; others separate.
_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """Partial counts (lang, source, term, n occurrences, docs documents); the term '' stands for the group itself."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        size = seen = 0

        def taken() -> Iterator[pd.DataFrame]:
            for (lang, source), terms in held.items():
                packed = np.fromiter(terms.values(), np.int64, len(terms))
                yield pd.DataFrame({"lang": lang, "source": source, "term": [t.decode("utf-8") for t in terms],
                                    "n": packed >> DOC_BITS, "docs": packed & ((1 << DOC_BITS) - 1)})
            held.clear()

        for frame in frames:
            for lang, source, text in zip(frame["lang"].tolist(), frame["source"].tolist(), frame["text"].tolist()):
                terms = held.setdefault((lang, source), {b"": 0})
                before = len(terms)
                for t, n in Counter(text.encode("utf-8").translate(_BYTES).split()).items():
                    terms[t] = terms.get(t, 0) + (n << DOC_BITS) + 1
                size, seen = size + len(terms) - before, seen + 1
                if size > HELD or seen >> (DOC_BITS - 1):
                    yield from taken()
                    size = seen = 0
        yield from taken()

    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return texts.mapInPandas(count, "lang string, source string, term string, n long, docs long")


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, whole, lead): counts of kept terms, their language's count, and one leading row a term.

    A row with the term '' stands for each group.
    """
    term = Window.partitionBy("lang", "term")
    return (
        # partial sums of many tasks meet by (lang, term): both sums below need no further exchange
        term_counts(docs).repartition("lang", "term")
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .withColumns({"whole": F.sum("n").over(term), "docs": F.sum("docs").over(term),
                      "lead": F.col("source") == F.min("source").over(term)})
        .filter((F.col("docs") >= min_docs) | (F.col("term") == "")).drop("docs"))


def price(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / total), by long division so that nothing overflows."""
    rest = counts.astype(np.int64) + PRIOR
    out, rest = rest // total, rest % total
    for _ in range(3):
        rest *= 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in either ascending list of the ids in both; the shorter one gallops through the longer."""
    found_s, found_l, at = [], [], 0
    for i in range(0, len(short), STRETCH):
        part, step = short[i:i + STRETCH], 1
        while at + step < len(long) and long[at + step] < part[-1]:
            step *= 2
        near = long[at:at + step + 1]
        pos = np.searchsorted(near, part)
        hit = np.flatnonzero(near[np.minimum(pos, len(near) - 1)] == part) if len(near) else np.zeros(0, np.int64)
        found_s.append(hit + i)
        found_l.append(pos[hit] + at)
        at += int(pos[-1]) if len(near) else 0
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_s]), np.concatenate([none, *found_l])


def merged_value(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], total_a: int, total_b: int) -> tuple[int, int]:
    """Sum of the differences of prices over the terms of either group, and the number of such terms."""
    (ids_a, n_a), (ids_b, n_b) = a, b
    if len(ids_a) <= len(ids_b):
        at_a, at_b = gallop(ids_a, ids_b)
    else:
        at_b, at_a = gallop(ids_b, ids_a)
    price_a, price_b = price(n_a, total_a), price(n_b, total_b)
    none_a, none_b = (int(price(np.zeros(1, np.int64), t)[0]) for t in (total_a, total_b))
    only_a, only_b = np.ones(len(ids_a), bool), np.ones(len(ids_b), bool)
    only_a[at_a] = only_b[at_b] = False
    value = int(np.abs(price_a[at_a] - price_b[at_b]).sum())
    value += int(np.abs(price_a[only_a] - none_b).sum()) + int(np.abs(price_b[only_b] - none_a).sum())
    return value, len(ids_a) + len(ids_b) - len(at_a)


def _arrays(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.asarray(rows["ids"].iloc[0], np.int64), np.asarray(rows["counts"].iloc[0], np.int64)


_PART = "lang string, a string, b string, item string, value long, touched long"


def _part(lang: str, a: str, b: str | None, items: list, values: np.ndarray, touched: int = 0) -> pd.DataFrame:
    n = len(items)
    same = lambda x: pd.Series([x] * n, dtype=object)
    return pd.DataFrame({"lang": same(lang), "a": same(a), "b": same(b), "item": pd.Series(items, dtype=object),
                         "value": np.asarray(values, np.int64), "touched": np.full(n, touched, np.int64)})


def _pair_task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    head = (left if len(left) else right).iloc[0]
    value, touched = merged_value(_arrays(left), _arrays(right), int(head["total_a"]), int(head["total_b"]))
    return _part(head["lang"], head["a"], head["b"], [None], [value], touched)


def _whole_task(top: int):
    def task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The group's terms of a block above the language's price, the first ``top``; ids are in the order of terms."""
        if not len(left):
            return _part("", "", None, [], [])
        head, terms = left.iloc[0], right["terms"].iloc[0]
        (ids, n), (ids_all, n_all) = _arrays(left), _arrays(right)
        at, at_all = gallop(ids, ids_all)
        over = price(n[at], int(head["total_a"])) - price(n_all[at_all], int(head["total_b"]))
        order = np.lexsort((ids_all[at_all], -over))
        order = order[over[order] > 0][:top]
        return _part(head["lang"], head["a"], None, [terms[i] for i in at_all[order]], over[order])

    return task


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the other sources, and the terms a group favours."""
    counts, _ = written(kept_counts(docs, min_docs), "divergence-counts")
    total = F.greatest(F.col("n") + PRIOR * F.col("v"), F.lit(1)).alias("total")  # 1 where there is nothing to price
    langs = counts.groupBy("lang").agg(F.count_if(F.col("lead") & (F.col("term") != "")).alias("v"), F.sum("n").alias("n"))
    langs = _small(written(langs.select("lang", "v", total), "divergence-langs")[0])
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("n")).join(langs.select("lang", "v"), "lang")
    groups = written(groups.select("lang", "source", "v", total), "divergence-groups")[0]

    # term numbers within hashed blocks, then one row a group and block; dealt by both keys, as a language may be most of the table
    dealt = (
        counts.filter("term <> ''").join(langs.select("lang", "v"), "lang")
        .withColumn("block", F.pmod(F.xxhash64("term"), F.expr(f"v div {block} + 1"))).repartition("lang", "block")
        .withColumn("id", (F.dense_rank().over(Window.partitionBy("lang", "block").orderBy("term")) - 1).cast("int")))
    listed = lambda n: F.array_sort(F.collect_list(F.struct("id", F.col(n).alias("n"))))
    dealt, _ = written(dealt.select("lang", "source", "block", "id", "n", "whole", "lead", "term"), "divergence-blocks")
    rows = dealt.groupBy("lang", "source", "block").agg(listed("n").alias("l")).select(
        "lang", "source", "block", F.col("l.id").alias("ids"), F.col("l.n").alias("counts"))
    rows, _ = written(rows, "divergence-rows")
    whole = dealt.filter("lead").groupBy("lang", "block").agg(
        F.array_sort(F.collect_list(F.struct("id", "whole", "term"))).alias("l")).select(
        "lang", "block", F.col("l.id").alias("ids"), F.col("l.whole").alias("counts"), F.col("l.term").alias("terms"))

    # unordered pairs of a language's groups; a language of many sources is spread over 16 tasks
    a = groups.select("lang", "v", F.col("source").alias("a"), F.col("total").alias("total_a"), (F.abs(F.xxhash64("source")) % 16).alias("_s"))
    b = groups.select("lang", F.col("source").alias("b"), F.col("total").alias("total_b"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("_s"))
    pairs = a.join(b, ["lang", "_s"]).filter("a < b").drop("_s")
    key = ["lang", "a", "b", "block"]
    cells = [*key, "total_a", "total_b", "ids", "counts"]  # named anew, as both sides come from one table
    meet = lambda side: rows.withColumnRenamed("source", side).join(pairs, ["lang", side]).select(*[F.col(c).alias(c) for c in cells])
    parts = meet("a").groupBy(*key).cogroup(meet("b").groupBy(*key)).applyInPandas(_pair_task, _PART)
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("touched").alias("touched"))
    absent = lambda t: F.expr(f"{SCALE * PRIOR} div {t}")
    rest = (F.col("v") - F.coalesce("touched", F.lit(0))) * F.abs(absent("total_a") - absent("total_b"))
    priced = pairs.join(sums, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", F.lit(0)) + rest)
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    near = priced.select("lang", "value", both.alias("_p")).select("lang", "_p.source", F.lit("pair").alias("part"), "_p.item", "value")

    # each group beside its whole language
    own = rows.withColumnRenamed("source", "a").join(
        groups.select("lang", F.col("source").alias("a"), F.col("total").alias("total_a")), ["lang", "a"]).join(
        langs.select("lang", F.col("total").alias("total_b")), "lang")
    all_of = whole.join(_small(groups.select("lang", F.col("source").alias("a"))), "lang")
    all_of = all_of.select(*[F.col(c).alias(c) for c in all_of.columns])
    key = ["lang", "a", "block"]
    favoured = own.groupBy(*key).cogroup(all_of.groupBy(*key)).applyInPandas(_whole_task(top), _PART)
    favoured = favoured.select("lang", F.col("a").alias("source"), F.lit("term").alias("part"), "item", "value")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    near = near.withColumn("rank", F.row_number().over(by_value))
    favoured = favoured.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)
    return near.unionByName(favoured)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), w AS (SELECT k, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
grid AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, v
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
), p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v)::HUGEINT AS p FROM grid),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * max(v))::HUGEINT AS q
  FROM grid GROUP BY lang, term
), pr AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), tm AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pr
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM tm
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""
