"""Registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickerloom.llm import chunks, divergence, forest, infill, licenses, minhash, mixing, packing, quality, residual, simhash, token_files, toxicity
from tickerloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op10_source_mix", mixing.SQL)
def source_mix(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix_report(table(spark, root, "documents"))


@query("op9_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, root: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, root, "documents"))


@query("op1_harmonic_packing")
def harmonic_packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack_report(table(spark, root, "documents"))


@query("op4_token_id_files")
def token_id_files(spark: SparkSession, root: str) -> DataFrame:
    return token_files.round_trip(table(spark, root, "documents"))


@query("op7_minhash_fingerprints")
def minhash_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    return minhash.edited_report(table(spark, root, "documents"))


@query("op6_chunk_substring_dedup")
def chunk_substring_dedup(spark: SparkSession, root: str) -> DataFrame:
    return chunks.repeat_report(table(spark, root, "documents"))


@query("op5_subword_toxicity")
def subword_toxicity(spark: SparkSession, root: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, root, "documents"), table(spark, root, "labels"))


@query("op8_attention_quality")
def attention_quality(spark: SparkSession, root: str) -> DataFrame:
    return quality.quality_report(table(spark, root, "documents"), table(spark, root, "labels"))


@query("op3_projection_forest")
def projection_forest(spark: SparkSession, root: str) -> DataFrame:
    return forest.nearest(table(spark, root, "embeddings"))


@query("op2_license_families")
def license_families(spark: SparkSession, root: str) -> DataFrame:
    return licenses.license_report(table(spark, root, "documents"))


@query("op13_rotation_infill", infill.SQL)
def rotation_infill(spark: SparkSession, root: str) -> DataFrame:
    return infill.infill_report(table(spark, root, "documents"))


@query("op11_source_divergence", divergence.SQL)
def source_divergence(spark: SparkSession, root: str) -> DataFrame:
    return divergence.audit(table(spark, root, "documents"))


@query("op12_residual_packing")
def residual_packing(spark: SparkSession, root: str) -> DataFrame:
    return residual.pack_report(table(spark, root, "documents"))
