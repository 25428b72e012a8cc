import random
import re
from collections import Counter, defaultdict

import corpus_pipeline as C
from tickerloom.llm import mixing as M
from tickerloom.llm import quality, simhash
from tickerloom.llm.tokens import Encoder

from .test_chunks import slow_spans
from .test_simhash import slow_groups, slow_print

ROOT = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    labels = spark.read.parquet(f"{ROOT}/labels.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}

    good = C.keep_good(spark, docs, ROOT)
    model = quality.trained(docs, labels)
    want = {i for i, r in rows.items() if quality.score(model, [r["text"]])[0] >= 0.5}
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == want and 0 < len(want) < len(rows)

    single = C.drop_near_duplicates(spark, good, ROOT)
    ids = sorted(want)
    groups = slow_groups([(i, slow_print(rows[i]["text"])) for i in ids])
    kept = {i for k, i in enumerate(ids) if groups[k] == i}
    assert single.columns == docs.columns and sorted(r["doc_id"] for r in single.collect()) == sorted(kept)

    cleaned = C.drop_repeated_passages(spark, single, ROOT)
    spans = defaultdict(list)
    for i, a, b, _ in slow_spans([(i, rows[i]["text"]) for i in sorted(kept)]):
        spans[i].append((a, b))
    texts = {}
    for i in kept:
        raw, at, keep = rows[i]["text"].encode(), 0, b""
        for a, b in sorted(spans[i]):
            keep, at = keep + raw[at:a], b
        texts[i] = (keep + raw[at:]).decode()
        if spans[i] and not texts[i].split():
            del texts[i]
    got = cleaned.collect()
    assert cleaned.columns == docs.columns and {r["doc_id"]: r["text"] for r in got} == texts
    assert all(r["n_chars"] == len(r["text"]) for r in got)

    plan = {r["doc_id"]: r["taken"] for r in M.plan(cleaned).collect()}
    mixed = C.mix_sources(spark, cleaned, ROOT)
    taken = Counter()
    for r in mixed.collect():
        n = len(WORDS.findall(r["text"]))
        assert texts[r["doc_id"]].startswith(r["text"]) and n > 0
        taken[r["doc_id"]] += n
    assert mixed.columns == docs.columns and taken == Counter({i: n for i, n in plan.items() if n})

    packed = C.pack(spark, mixed, ROOT).collect()
    enc = Encoder()
    assert sum(r["length"] for r in packed) == sum(len(enc.encode([r["text"]])[0]) // 4 + 1 for r in mixed.collect())
    whole = C.run(spark, ROOT).collect()
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in whole if r["length"] == 2048) == sorted(
        (r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed if r["length"] == 2048)


def test_empty_table_and_null_rows(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    for few in (docs.limit(0), docs.limit(3).selectExpr("cast(null as bigint) doc_id", "cast(null as string) text", "cast(null as string) lang", "cast(null as string) source", "cast(null as bigint) n_chars")):
        for _, stage in C.STAGES:
            out = stage(spark, few, ROOT)
            assert out.count() <= few.count()


def slow_mix(rows):
    """rows: (id, source, words) -> {id: taken} by walking through seats, shards and documents."""
    import hashlib
    total, by = sum(n for _, _, n in rows), defaultdict(list)
    for i, s, n in rows:
        by[s].append((i, n))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    size = {s: sum(n for _, n in by[s]) for s in names}
    capped, rest = {}, set(names)
    while True:
        level = (1.5 * total - sum(capped.values())) / max(1e-9, sum(weight[s] for s in rest)) if rest else 0
        over = {s for s in rest if level * weight[s] > 2 * size[s]}
        if not over:
            break
        capped |= {s: 2 * size[s] for s in over}
        rest -= over
    target = {s: capped.get(s, level * weight[s]) for s in names}

    def seats(votes, n):
        got = Counter()
        for _ in range(n):
            best = max((p for p in votes if votes[p] > 0), key=lambda p: votes[p] / (2 * got[p] + 1))
            got[best] += 1
        return got

    quota, taken = seats(target, int(sum(target.values()) / M.BLOCK + 0.5)), {}
    for s in names:
        shards = defaultdict(list)
        n_shards = min(M.MAX_SHARDS, -(-len(by[s]) // M.SHARD_DOCS))
        for i, n in by[s]:
            key = hashlib.md5(f"{M.SEED}:{i}".encode()).hexdigest()
            shards[int(key[:8], 16) % n_shards].append((key, i, n))
        own = seats({k: sum(d[2] for d in v) for k, v in shards.items()}, quota[s])
        for k, v in shards.items():
            words = sum(d[2] for d in v)
            left = min(own[k] * M.BLOCK, 2 * words)
            for _, i, n in v:
                taken[i] = left // max(words, 1) * n
            left %= max(words, 1)
            for _, i, n in sorted(v):
                taken[i] += min(n, left)
                left -= min(n, left)
    return taken, target, size


def test_mix_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "a", "a", "b", "c", "d", None]), rng.choice([0, 1, 30, 200, 900])) for i in range(900)]
    rows += [(2000, "tiny", 3), (2001, "zero", 0)]
    df = spark.createDataFrame([(i, s, " ".join(["w"] * n) if n else None, 5) for i, s, n in rows], "doc_id long, source string, text string, size int")
    taken, target, size = slow_mix(rows)
    got = {r["doc_id"]: r for r in M.mix_report(df).collect()}
    assert {i: r["taken"] for i, r in got.items()} == taken
    source = {i: s for i, s, _ in rows}
    assert all(abs(r["target"] - target[source[i]]) < 1e-6 and r["source_size"] == size[source[i]] for i, r in got.items())
    assert all(r["taken"] <= 2 * r["size"] for r in got.values())
    for s in target:
        assert abs(sum(t for i, t in taken.items() if source[i] == s) - target[s]) <= M.BLOCK + 6
    assert M.mix_report(df.limit(0)).count() == 0
    assert sum(r["taken"] for r in M.mix_report(df.filter("source = 'zero'")).collect()) == 0
    twice = M.mix_report(df.union(df)).collect()
    assert len(twice) == 2 * len(rows)
