"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docweft.llm import oracles
from docweft.llm.shared import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: How tables of streams are written: seek tables and frame headers of a stream are much alike.
STREAMS = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweft.llm import langid

    return langid.languages_of(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweft.llm import decontaminate

    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweft.llm import lmscore

    targets = _table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0")
    return lmscore.lm_scores(_table(spark, sf_dir, "documents"), targets)


def op8_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweft.llm import flac

    media = stored(flac.flac_encode(_table(spark, sf_dir, "documents").select("doc_id", "text")), "media", **STREAMS)
    return flac.flac_digest(media)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweft.llm import repeats

    return repeats.without_repeats(_table(spark, sf_dir, "documents"), width=35)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweft.llm import quality

    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweft.llm import minhash

    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def _domains(labels: DataFrame) -> DataFrame:
    """The labelled table of the mixing query: toxic, else good or poor by quality."""
    return labels.selectExpr("doc_id", "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'poor' WHEN quality = 1 THEN 'good' END AS domain")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweft.llm import mixing

    labelled = _domains(_table(spark, sf_dir, "labels"))
    return mixing.mixing_rates(_table(spark, sf_dir, "documents"), labelled, {"good": 0.9, "poor": 0.07, "toxic": 0.03})


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweft.llm import secrets

    return secrets.secret_report(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweft.llm import toxicity

    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweft.llm import whitening

    return whitening.whitened(_table(spark, sf_dir, "embeddings"), most=32)


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweft.llm import vectorpairs

    return vectorpairs.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_duplicates, op2_mixing, op3_secrets, op4_toxicity, op5_language, op6_decontamination, op7_lm_scores, op8_flac_media, op9_repeats, op10_quality, op11_whitening, op12_near_vectors)}


def oracle_sql() -> dict[str, str]:
    return {"op1_near_duplicates": oracles.OP1, "op3_secrets": oracles.OP3, "op9_repeats": oracles.OP9, "op12_near_vectors": oracles.OP12}
