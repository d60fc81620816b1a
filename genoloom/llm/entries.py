"""The operators' queries over the driver's tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.llm import decontam, icws, langid, lm, mixing, quality, quotes, rules, substring, tokcount
from genoloom.llm.common import table


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op2_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(table(spark, sf_dir, "conversations"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "n_chars", "source", F.md5(F.col("text").cast("binary")).alias("text_md5"), "copy", F.round("mix_rate", 9).alias("mix_rate"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return tokcount.token_counts(table(spark, sf_dir, "documents"), f.read())


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return icws.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_quotations": op2_quotations,
    "op3_decontamination": op3_decontamination,
    "op4_language": op4_language,
    "op5_mixture": op5_mixture,
    "op6_quality": op6_quality,
    "op7_rules": op7_rules,
    "op8_substrings": op8_substrings,
    "op9_tokens": op9_tokens,
    "op10_near_duplicates": op10_near_duplicates,
}

ORACLES: dict[str, str] = {"op2_quotations": quotes.OP2_SQL, "op5_mixture": mixing.OP5_SQL, "op7_rules": rules.OP7_SQL, "op8_substrings": substring.OP8_SQL}
