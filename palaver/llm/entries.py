"""The registered queries of the subpackage, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palaver.llm import align, audio, chat, decontaminate, language, licenses, merkle, mixing, near_dup, quality, suffix_dedup, tokens, url_filter
from palaver.session import configure

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, folder: str) -> DataFrame:
    return audio.align(audio.sung(spark, _table(spark, folder, "conversations")))


def op2(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_sizes(_table(spark, folder, "documents"))


def op3(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, folder, "conversations").select(*extra.columns)
    return chat.digests(chat.format_chats(rows.unionByName(extra)))


def op4(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_table(spark, folder, "documents"))


def op5(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op6(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, folder, "documents"))


def op7(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, folder, "documents"), shingle=2)


def op8(spark: SparkSession, folder: str) -> DataFrame:
    return language.predict(_table(spark, folder, "documents"))


def op9(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.tokenised(_table(spark, folder, "documents"), tokenizer_file(), dtype="<u2")


def op10(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(_table(spark, folder, "pages"))


def op11(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.document_proofs(_table(spark, folder, "documents"))


def op12(spark: SparkSession, folder: str) -> DataFrame:
    return quality.predict(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op13(spark: SparkSession, folder: str) -> DataFrame:
    return align.align(_table(spark, folder, "documents"), tokenizer_file(), tokenizer_file("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    "op1_audio_fingerprints": op1,
    "op2_source_mixing": op2,
    "op3_chat_format": op3,
    "op4_license_scan": op4,
    "op5_decontamination": op5,
    "op6_suffix_dedup": op6,
    "op7_minhash_near_dedup": op7,
    "op8_language_id": op8,
    "op9_token_files": op9,
    "op10_url_filter": op10,
    "op11_merkle_manifest": op11,
    "op12_quality_classifier": op12,
    "op13_token_alignment": op13,
}

ORACLES: dict[str, str] = {
    "op3_chat_format": chat.SQL,
    "op11_merkle_manifest": merkle.SQL,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
