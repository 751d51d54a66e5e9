"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from invoicefields.llm import chat, decontaminate, fim, langid, matroska, merkle, minhash, mixing, quality
from invoicefields.llm import secret_scan, substrings, tokens, toxicity
from invoicefields.llm.common import table
from invoicefields.llm.oracles import ORACLES as ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Without the longest match, the one column that check SQL cannot say."""
    report = decontaminate.contamination_report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return report.drop("longest_match")


def op2_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"), n=3, limit=0.85)


def op3_chat(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations, and one whose texts are control strings themselves."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)],
                                 "conv_id long, turn long, role string, text string")
    return chat.conversation_report(rows.unionByName(more))


def op4_substrings(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.removal_report(table(spark, sf, "documents"))


def op5_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op6_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf, "documents"))


def op7_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf, "documents"))


def op8_matroska(spark: SparkSession, sf: str) -> DataFrame:
    return matroska.media_report(table(spark, sf, "documents"))


def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))


def op10_langid(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identify(table(spark, sf, "documents"))


def op11_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op12_merkle(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.manifest_report(table(spark, sf, "documents"))


def op13_fim(spark: SparkSession, sf: str) -> DataFrame:
    return fim.fim_report(table(spark, sf, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_decontamination, op2_minhash, op3_chat, op4_substrings, op5_quality, op6_tokens, op7_secrets,
    op8_matroska, op9_mixing, op10_langid, op11_toxicity, op12_merkle, op13_fim)}
