"""The registered queries opN_<name> over the given tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table
from . import (
    conversations,
    exact_dedup,
    licenses,
    mixing,
    packing,
    periodic_runs,
    quality_classifier,
    quality_rules,
    sharding,
    simhash,
    substring_dedup,
    toxicity,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_licenses(spark: SparkSession, d: str) -> DataFrame:
    return licenses.license_report(read_table(spark, d, "documents"))


@register
def op2_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, d, "documents"))


ORACLES["op2_exact_dedup"] = exact_dedup.ORACLE.strip()


@register
def op3_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_plan(read_table(spark, d, "documents"))


ORACLES["op3_mixing"] = mixing.ORACLE.strip()


@register
def op4_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard_digests(read_table(spark, d, "documents"))


@register
def op5_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.warc_round_trip(read_table(spark, d, "pages"))


ORACLES["op5_warc"] = warc.ORACLE.strip()


@register
def op6_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.simhash_components(read_table(spark, d, "documents"))


@register
def op7_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed_pieces(read_table(spark, d, "documents"))


@register
def op8_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules.judged(read_table(spark, d, "documents"))


@register
def op9_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, read_table(spark, d, "labels")))


@register
def op10_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    return quality_classifier.score_quality(docs, quality_classifier.train(docs, read_table(spark, d, "labels")))


@register
def op11_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return substring_dedup.kept_digests(read_table(spark, d, "documents"))


ORACLES["op11_substring_dedup"] = substring_dedup.ORACLE.strip()


@register
def op12_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    return periodic_runs.run_digests(periodic_runs.plant_periods(read_table(spark, d, "documents")), text_col="body")


@register
def op13_conversation_repair(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversation_repair(read_table(spark, d, "conversations"))
