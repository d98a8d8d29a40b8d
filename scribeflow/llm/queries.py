"""Thin queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontam, gif, langid, lexical, linededup, merkle, secrets, simhash, tokencodes, toxicity, warc


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), word_vocabulary())


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_table(table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_table(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_table(table(spark, sf_dir, "documents"))


def op7_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencodes.token_table(table(spark, sf_dir, "documents"), word_vocabulary())


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_table(table(spark, sf_dir, "documents"))


def op9_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.media_table(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversation_table(table(spark, sf_dir, "conversations"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_table(table(spark, sf_dir, "documents"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_table(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_warc": op2_warc,
    "op3_simhash": op3_simhash,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_line_dedup": op6_line_dedup,
    "op7_token_codes": op7_token_codes,
    "op8_language": op8_language,
    "op9_gif": op9_gif,
    "op10_chat": op10_chat,
    "op11_lexical": op11_lexical,
    "op12_merkle": op12_merkle,
    "op13_secrets": op13_secrets,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": warc.WARC_SQL,
    "op4_decontamination": decontam.LEAK_SQL,
    "op6_line_dedup": linededup.LINE_SQL,
    "op10_chat": chat.CHAT_SQL,
    "op11_lexical": lexical.LEXICAL_SQL,
    "op12_merkle": merkle.MERKLE_SQL,
}
