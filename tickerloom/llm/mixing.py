"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets: sources in code-point order (null last) weigh 3, 1, 2, 3, ... and share ``share`` of all
words; no target exceeds ``cap`` times its source, what is cut off is shared out by weight again.
Quotas: the mix is a number of blocks of ``block`` words. They go to sources by the highest
quotients target / (2k + 1), and each source's blocks to its shards by the highest quotients
words / (2k + 1). A shard is a fixed hash bucket of a source's documents in a seeded order; its
blocks are taken in that order, whole passes first, so at most one document of a shard is cut.

Only the id, source and word count of a document are shuffled. The tables of sources and shards are
small (shards per source are bounded); a source of any size is spread over its shards.

Defined cases: null and blank texts have size 0 and are taken 0 times; a null source is a source of
its own, last in order; repeated rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import SPACE, clean_names, n_words

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
BLOCK = 64
SHARD_DOCS, MAX_SHARDS = 256, 4096
SEED = "mix-1"


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Add ``target`` to a table (source, source_size) with one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("_w", weight).withColumn("_top", (F.col("source_size") * cap).cast("long"))
    # sources in the order in which they reach their cap as the common level rises
    order = Window.orderBy(F.col("_top") / F.col("_w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = s.withColumn("_all", F.sum("source_size").over(whole) * F.lit(share))
    left = F.col("_all") - F.coalesce(F.sum("_top").over(before), F.lit(0))
    weight_left = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    s = s.withColumn("_capped", left / weight_left * F.col("_w") >= F.col("_top"))
    spare = F.col("_all") - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_top"))).over(whole), F.lit(0))
    level = spare / F.sum(F.when(~F.col("_capped"), F.col("_w"))).over(whole)
    target = F.when(F.col("_capped"), F.col("_top").cast("double")).otherwise(level * F.col("_w"))
    return s.withColumn("target", F.coalesce(target, F.lit(0.0))).drop("_w", "_top", "_all", "_capped")


def sainte_lague(parties: DataFrame, keys: Sequence[str], party: str, votes: str, seats: Column, out: str) -> DataFrame:
    """Add ``out``: the seats of each party, within ``keys``, by the highest quotients votes / (2k + 1).

    Rounding votes by the common divisor gives an exact apportionment of some number of seats near
    the wanted one; the missing ones go to the highest next quotients, the surplus ones leave by the
    lowest. So nobody walks through the seats one by one.
    """
    group = Window.partitionBy(*keys)
    p = parties.withColumn("_seats", seats)
    p = p.withColumn("_total", F.sum(votes).over(group))
    p = p.withColumn("_base", F.coalesce(F.floor(F.col(votes) * F.col("_seats") / F.nullif(F.col("_total"), F.lit(0)) + 0.5), F.lit(0)))
    p = p.withColumn("_missing", F.when(F.col("_total") > 0, F.col("_seats") - F.sum("_base").over(group)).otherwise(F.lit(0)))
    steps = p.filter((F.col("_missing") != 0) & (F.col(votes) > 0)).select(
        *keys, party, "_missing", "_base", votes, F.explode(F.sequence(F.lit(0), F.abs("_missing").cast("int") - 1)).alias("_j"))
    up = F.col("_missing") > 0
    odd = F.when(up, 2 * (F.col("_base") + F.col("_j")) + 1).otherwise(2 * (F.col("_base") - F.col("_j")) - 1)
    quotient = F.col(votes) / odd
    first = F.when(up, -quotient).otherwise(quotient)
    ranked = (
        steps.filter(odd > 0)
        .withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(first, F.col(party).asc_nulls_last(), "_j")))
        .filter(F.col("_rank") <= F.abs("_missing"))
        .groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(party).alias("_party"))
        .agg(F.sum(F.signum("_missing")).cast("long").alias("_more"))
    )
    same = F.col(party).eqNullSafe(F.col("_party"))
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (
        p.join(ranked, same, "left")
        .withColumn(out, (F.col("_base") + F.coalesce("_more", F.lit(0))).cast("long"))
        .drop("_seats", "_total", "_base", "_missing", "_more", "_party", *[f"_k{i}" for i in range(len(keys))])
    )


def plan(docs: DataFrame, block: int = BLOCK, seed: str = SEED, weights: Sequence[int] = WEIGHTS,
         share: float = SHARE, cap: int = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of each document; no text moves."""
    sized = docs.select("doc_id", "source", n_words().alias("size"))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    goal = targets(per_source, weights, share, cap)
    blocks = F.floor(F.sum("target").over(Window.partitionBy()) / block + 0.5)
    goal = sainte_lague(goal, (), "source", "target", blocks, "_blocks")
    goal = goal.withColumn("_shards", F.least(F.lit(MAX_SHARDS), F.ceil(F.col("_docs") / SHARD_DOCS)).cast("long"))
    goal = goal.withColumnRenamed("source", "_source").drop("_docs")

    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    placed = sized.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("_order", key)
    placed = placed.withColumn("_shard", F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") % F.col("_shards"))

    shards = placed.groupBy("source", "_shard").agg(F.sum("size").alias("_words"), F.max("_blocks").alias("_blocks"))
    shards = sainte_lague(shards, ("source",), "_shard", "_words", F.col("_blocks"), "_quota")
    shards = shards.select(F.col("source").alias("_source"), F.col("_shard").alias("_sh"), "_words",
                           F.least(F.col("_quota") * block, F.col("_words") * cap).alias("_quota"))

    run = Window.partitionBy("source", "_shard").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_before", F.coalesce(F.sum("size").over(run), F.lit(0)))
    placed = placed.join(shards, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_shard") == F.col("_sh")))
    words = F.greatest(F.col("_words"), F.lit(1))
    passes, rest = F.floor(F.col("_quota") / words), F.col("_quota") % words
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    return placed.select("doc_id", "source", "size", "source_size", "target", (passes * F.col("size") + part).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: whole copies, then the cut document's first words.

    Documents that the mix doesn't take leave; one it takes twice comes twice. Rows that share
    doc_id, source and size are interchangeable and are paired up in any order.
    """
    names = docs.columns
    twin = Window.partitionBy("doc_id", "source", "size").orderBy(F.col("taken"))
    chosen = plan(docs, **options).withColumn("_twin", F.row_number().over(twin))
    chosen = chosen.filter("taken > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_src"), F.col("size").alias("_n"), "_twin", "taken")
    rows = docs.withColumn("_size", n_words())
    rows = rows.withColumn("_row", F.row_number().over(Window.partitionBy("doc_id", "source", "_size").orderBy(F.xxhash64(text_or_empty()))))
    rows = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_src"))
                     & (F.col("_size") == F.col("_n")) & (F.col("_row") == F.col("_twin")))
    whole, rest = F.floor(F.col("taken") / F.col("_size")).cast("int"), F.col("taken") % F.col("_size")
    pieces = F.split("text", rf"(?<=[^{SPACE}])(?=[{SPACE}])")
    cut = F.when(rest > 0, F.array(F.array_join(F.slice(pieces, F.lit(1), rest.cast("int")), ""))).otherwise(F.array().cast("array<string>"))
    out = rows.withColumn("_text", F.explode(F.concat(F.array_repeat(F.col("text"), whole), cut)))
    return out.select(*[F.col("_text").alias("text") if c == "text" else F.col(c) for c in names])


def text_or_empty() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per document: what the mix takes of it."""
    return plan(clean_names(docs, ["size", "source_size", "target", "taken"])).select(
        "doc_id", "size", "source_size", "target", "taken", "source")


SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs FROM d GROUP BY source),
w AS (SELECT *, list_value(3, 1, 2)[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w, source_size * 2 AS top,
      sum(source_size) OVER () * 1.5::DOUBLE AS al FROM s),
c AS (SELECT *, (al - coalesce(sum(top) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) * w >= top AS capped FROM w
      WINDOW o AS (ORDER BY top / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, coalesce(CASE WHEN capped THEN top::DOUBLE ELSE (al - coalesce(sum(CASE WHEN capped THEN top END) OVER (), 0))::DOUBLE
      / sum(CASE WHEN NOT capped THEN w END) OVER () * w END, 0.0) AS target FROM c),
g AS (SELECT *, floor(sum(target) OVER () / {BLOCK} + 0.5) AS seats, sum(target) OVER () AS votes FROM t),
q0 AS (SELECT *, row_number() OVER (ORDER BY quotient DESC, source ASC NULLS LAST) AS place FROM
      (SELECT source, seats, target / (2 * k + 1) AS quotient FROM g, range(0, (target / {BLOCK} + 3)::BIGINT) r(k) WHERE target > 0)),
q AS (SELECT source, count(*) AS blocks FROM q0 WHERE place <= seats GROUP BY source),
p AS (SELECT d.*, t.source_size, t.target, coalesce(q.blocks, 0) AS blocks, md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS ord,
      ('0x' || md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null'))[1:8])::BIGINT % least({MAX_SHARDS}, ceil(t.docs / {SHARD_DOCS}))::BIGINT AS shard
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN q ON d.source IS NOT DISTINCT FROM q.source),
h AS (SELECT source, shard, sum(size)::BIGINT AS words, max(blocks) AS blocks FROM p GROUP BY source, shard),
h0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY quotient DESC, shard) AS place FROM
      (SELECT source, shard, blocks, words / (2 * k + 1) AS quotient FROM h, range(0, 2 * words // {BLOCK} + 4) r(k) WHERE words > 0)),
hq AS (SELECT source, shard, count(*) AS n FROM h0 WHERE place <= blocks GROUP BY source, shard),
z AS (SELECT h.source, h.shard, words, least(coalesce(n, 0) * {BLOCK}, words * 2) AS quota FROM h
      LEFT JOIN hq ON h.source IS NOT DISTINCT FROM hq.source AND h.shard = hq.shard),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT doc_id, size, source_size, target,
       (quota // greatest(words, 1) * size + greatest(0, least(size, quota % greatest(words, 1) - before)))::BIGINT AS taken, b.source
FROM b JOIN z ON b.source IS NOT DISTINCT FROM z.source AND b.shard = z.shard
"""
