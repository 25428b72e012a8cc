"""From raw documents to packed training sequences, in five stages.

Each stage takes all that the one before kept and returns the columns of ``documents``, but for the
last, which returns the packed pieces. Between stages the documents are written as Parquet to the
shared folder (``spark.checkpoint.dir``) and read again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm import chunks, mixing, packing, quality, simhash
from tickerloom.llm.common import remove, table, written
from tickerloom.llm.tokens import SMALL_CACHE


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of texts that a stage has changed."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document keeps."""
    return _recounted(chunks.deduplicated(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those it cuts are cut."""
    return _recounted(mixing.mixed(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids."""
    return packing.pack_report(docs, cache_words=SMALL_CACHE)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

#: The classifier, XXH64, the gear hash and the tokenizer have no SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, new = written(stage(spark, docs, sf_dir), "pipeline")
        if path:
            remove(spark, path)
        path = new
    return STAGES[-1][1](spark, docs, sf_dir)
