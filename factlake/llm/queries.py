"""The registered queries of the corpus operators: thin calls with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html, jaccard, langid, media, mixing, packing, paragraphs, quality, secrets, suffix


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public vocabulary that packing counts by."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated(_table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(_table(spark, sf_dir, "documents"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(_table(spark, sf_dir, "documents"))


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removed(_table(spark, sf_dir, "documents"), spans=False).drop("removed")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_secrets": op2_secrets,
    "op3_quality": op3_quality,
    "op4_paragraphs": op4_paragraphs,
    "op5_media": op5_media,
    "op6_jaccard": op6_jaccard,
    "op7_language": op7_language,
    "op8_mixing": op8_mixing,
    "op9_suffix": op9_suffix,
    "op10_main_text": op10_main_text,
}
ORACLES: dict[str, str] = {"op2_secrets": secrets.SQL, "op8_mixing": mixing.SQL}
