"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.session import ensure_checkpoint_dir

#: White space of the word rule ``[^\x20\x09-\x0D]+``, which is also what ``bytes.split()`` splits on.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: Characters of the longest text that a classifier learns from; texts of any length are scored.
LONGEST = 500_000


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def text_of(col: str | Column = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def n_words(col: str | Column = "text") -> Column:
    return F.regexp_count(text_of(col), F.lit(WORD)).cast("long")


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder under the checkpoint folder, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write to the shared folder and read again. Returns the frame and its folder."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``written`` made, once nothing reads it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def held_out(doc_id: Column) -> Column:
    """Rows no classifier learns from: crc32 of the id as text leaves 1 after division by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, seed: str) -> tuple[list[tuple[str, int]], tuple[float, float]]:
    """(text, label) of at most about ``rows`` labelled documents outside the held-out third, and the share taken of either label.

    Ids are drawn by hash, so the sample depends on neither row order nor partitions. A label is
    used once per id: ids that the labels mark both ways are left out. The sampled labels have a
    known bound and are broadcast. An id gives one text, that with the smallest hash where rows repeat it, and none
    that is longer than ``LONGEST`` characters, so what comes to the driver is bounded in rows and in size.
    """
    known = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_y")).filter("y = _y").drop("_y")
        .withColumn("_h", F.crc32(F.concat(F.lit(seed), F.col("doc_id").cast("string")).cast("binary")))
    )
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], (1.0, 1.0)
    # half of the rows for either class where it has as many
    small = min(counts.get(0, 0), counts.get(1, 0))
    take = {k: rows - small if n > small and small < rows // 2 else rows // 2 for k, n in counts.items()}
    share = {k: min(1.0, take[k] / n) for k, n in counts.items()}
    keep = F.lit(False)
    for k in counts:
        keep |= (F.col("y") == k) & (F.col("_h") < F.lit(int(share[k] * 2**32)))
    chosen = known.filter(keep).select("doc_id", "y")
    texts = docs.select("doc_id", text_of().alias("text")).filter(F.length("text") <= LONGEST)
    got = (
        texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y")
        .agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).collect())
    return sorted((r["text"], r["y"]) for r in got), (share.get(0, 1.0), share.get(1, 1.0))


def clean_names(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop input columns whose names an operator's own output columns take."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def crc_ids(data: bytes) -> int:
    return zlib.crc32(data)


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in a byte array, by the word rule."""
    inside = np.empty(len(buf) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not((buf == 32) | ((buf >= 9) & (buf <= 13)), out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def batched_texts(texts: Sequence[str | None], size: int = 1 << 20):
    """Slices of a batch whose texts hold about ``size`` characters, so that arrays stay small."""
    start, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= size:
            yield start, i + 1
            start, n = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def concatenated(texts: Sequence[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts, a newline after each, and the offsets where texts begin and the end."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    if lower:
        raw = [b.lower() for b in raw]
    offsets = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(b) + 1 for b in raw], out=offsets[1:])
    return np.frombuffer(b"".join(b + b"\n" for b in raw), dtype=np.uint8), offsets
