"""One query for each operator, over the whole of its table and with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import html, langid, quality
from quillon.llm.compression import compression_report
from quillon.llm.decontaminate import benchmark_leaks
from quillon.llm.near import near_groups
from quillon.llm.oracles import REPEATED_PASSAGES
from quillon.llm.packing import packed_sequences
from quillon.llm.repeats import repeated_passages
from quillon.llm.sharding import sharded
from quillon.llm.tokens import token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.classified(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identified(docs, langid.train(docs))


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_report(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_sequences(_table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html.extracted(pages, html.train(pages))


def op10_suffix_array_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_near_duplicates,
        op3_quality_classifier,
        op4_language_id,
        op5_benchmark_leaks,
        op6_sharding,
        op7_quality_rules,
        op8_best_fit_packing,
        op9_html_extraction,
        op10_suffix_array_repeats,
    )
}
#: the other methods can't be written as SQL that runs over whole tables; tests hold each against a brute-force version
ORACLES: dict[str, str] = {op10_suffix_array_repeats.__name__: REPEATED_PASSAGES}
