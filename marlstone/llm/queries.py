"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import flac, hamming, html, langid, licences, mixing, packing, repeats, simhash, tokencount
from .common import documents


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(documents(spark, sf_dir))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(documents(spark, sf_dir))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(documents(spark, sf_dir))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), packing.vocabulary())


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(documents(spark, sf_dir))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.findings(documents(spark, sf_dir))


def op8_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(documents(spark, sf_dir), tokencount.vocabulary())


def op9_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digest(documents(spark, sf_dir))


def op10_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_langid, op2_html, op3_simhash, op4_repeats, op5_pack, op6_mix, op7_licences, op8_tokencount, op9_flac, op10_hamming)}


def oracle_sql() -> dict[str, str]:
    return {"op6_mix": mixing.SQL, "op10_hamming": hamming.SQL}
