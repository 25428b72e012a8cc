"""Token-id files of a corpus in document order, written block by block and read back.

``write`` range-partitions documents by id, encodes every whole text, appends the end id, and cuts
each partition's ids into blocks of the range coder. A file is one partition's blocks; the container
is a Parquet folder with a row per block (file, block, ids, data), so Spark's commit protocol keeps
files whole when executors are lost, on any store that Spark writes to. ``read`` decodes a file's
blocks and hands out each document's ids; ``offsets`` places the files one behind the other.

Memory of a task: the ids of two blocks, the block at hand and, on reading, the ids of the document
at hand. Only the sizes of files meet in one place.

Defined cases: a null or empty text is the end id alone; null ids come first; rows that repeat an id
are documents of their own, in the order of their texts' hashes; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.llm import rangecoder
from tickerloom.llm.common import batched_texts, shared_folder
from tickerloom.llm.rangecoder import BLOCK
from tickerloom.llm.tokens import LARGE_CACHE, encoder

END_ID = 2
BLOCKS = "file long, block long, ids long, data binary"


def write(docs: DataFrame, path: str, end_id: int = END_ID, vocabulary: str | None = None) -> None:
    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary, LARGE_CACHE)
        size = enc.tokenizer.get_vocab_size()
        file, end = TaskContext.get().partitionId(), end_id.to_bytes(4, "little")
        held, docs_of, done = bytearray(), [], 0  # docs_of: (id, number of ids, place in held)

        def block(n: int) -> pd.DataFrame:
            """A block of the first n ids of what is held."""
            nonlocal docs_of, done
            begin = [(doc_id, k, at) for doc_id, k, at in docs_of if at < n]
            docs_of = [(doc_id, k, at - n) for doc_id, k, at in docs_of[len(begin):]]
            data = rangecoder.encode_blocks([(np.frombuffer(bytes(held[:4 * n]), dtype="<u4"), begin)], size)
            del held[:4 * n]
            done += 1
            return pd.DataFrame({"file": file, "block": done - 1, "ids": n, "data": data})

        for frame in frames:
            texts, doc_ids = frame["text"].tolist(), frame["doc_id"].tolist()
            for a, b in batched_texts(texts):
                for doc_id, ids in zip(doc_ids[a:b], enc.encode(texts[a:b])):
                    docs_of.append((None if pd.isna(doc_id) else int(doc_id), len(ids) // 4 + 1, len(held) // 4))
                    held += ids
                    held += end
                while len(held) >= 8 * BLOCK:  # two blocks: the rest is then shared out evenly
                    yield block(BLOCK)
        while n := len(held) // 4:
            yield block(-(-n // -(-n // BLOCK)))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id")
    rows = rows.sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows.mapInPandas(encode, BLOCKS).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, vocabulary: str | None = None, digests: bool = False) -> DataFrame:
    """file, start (ids of the file's documents before), doc_id, ids (little-endian uint32) of each document.

    With ``digests`` the number of ids and their crc32 come in place of the ids, taken as the blocks are decoded.
    """

    schema = "file long, start long, doc_id long, " + ("n_tokens long, ids_crc32 long" if digests else "ids binary")

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = encoder(vocabulary, LARGE_CACHE).tokenizer.get_vocab_size()
        now = -1
        at, doc_id, want, parts, got, crc = 0, None, 0, [], 0, 0

        for file, data in ((f, d) for frame in frames for f, d in zip(frame["file"], frame["data"])):
            out = []
            (ids, docs), = rangecoder.decode_blocks([data], size)
            if file != now:
                if got != want:
                    raise ValueError(f"file {now} ends inside a document")
                now, at, want, got = file, 0, 0, 0
            raw, place = ids.tobytes(), 0
            starts = [d[2] for d in docs] + [len(ids)]
            for i in range(-1, len(docs)):
                if i >= 0:
                    if got != want:
                        raise ValueError(f"file {now} lacks ids of a document")
                    doc_id, want, place = docs[i]
                    parts, got, crc = [], 0, 0
                stop = starts[i + 1]
                if stop > place:
                    part = raw[4 * place:4 * stop]
                    got += stop - place
                    if digests:
                        crc = zlib.crc32(part, crc)
                    else:
                        parts.append(part)
                    if got == want:
                        out.append((now, at, doc_id, *((got, crc) if digests else (b"".join(parts),))))
                        at += got
                        parts = []
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")]).astype({"doc_id": "Int64"})
        if got != want:
            raise ValueError(f"file {now} ends inside a document")

    rows = spark.read.schema(BLOCKS).parquet(path).select("file", "block", "data")
    return rows.repartition("file").sortWithinPartitions("file", "block").mapInPandas(decode, schema)


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """(file, before): ids in all files before; one row per file."""
    sizes = spark.read.schema(BLOCKS).parquet(path).groupBy("file").agg(F.sum("ids").alias("n"))
    w = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("file", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))


def round_trip(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the files (below ``spark.checkpoint.dir`` unless a path is given), read them, and give a row per document."""
    spark = docs.sparkSession
    path = path or shared_folder(spark, "token-files")
    write(docs, path, **options)
    # a row a file: small beside the files themselves, and no document travels to meet it
    rows = read(spark, path, options.get("vocabulary"), digests=True).join(F.broadcast(offsets(spark, path)), "file")
    return rows.select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
