"""The registered queries of this subpackage: thin readings of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, divergence, language_model, mainpage, mixing, neardup, neighbours, packing, pieces, quality, suffixes, toxicity, urls
from .ship import ship


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainpage.extract(_read(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path())


def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_conversations(_read(spark, sf_dir, "conversations"), tokenizer_path())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, _read(spark, sf_dir, "labels")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(_read(spark, sf_dir, "documents"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(_read(spark, sf_dir, "documents"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.report(_read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_read(spark, sf_dir, "embeddings"))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(_read(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(_read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_urls": op1_urls,
        "op2_main_text": op2_main_text,
        "op3_packing": op3_packing,
        "op4_toxicity": op4_toxicity,
        "op5_mixing": op5_mixing,
        "op6_neardup": op6_neardup,
        "op7_language_model": op7_language_model,
        "op8_quality": op8_quality,
        "op9_neighbours": op9_neighbours,
        "op10_suffixes": op10_suffixes,
        "op11_alignment": op11_alignment,
        "op12_divergence": op12_divergence,
        "op13_sentencepiece": op13_sentencepiece,
        "pack_conversations": pack_conversations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_urls": urls.oracle(),
        "op5_mixing": mixing.oracle(),
        "op6_neardup": neardup.oracle(),
        "op8_quality": quality.oracle(),
        "op12_divergence": divergence.oracle(),
    }
