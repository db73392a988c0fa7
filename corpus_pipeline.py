"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
All but the last return the columns of ``documents``; the last adds the rate at which
to use a row and the whole number of copies that this gives it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm import decontaminate, minhash, mixing, secrets, toxicity
from docweft.llm.shared import scratch, stored

#: Share of words that texts of each domain are to have, and words to train on for each word that the stages before keep.
WEIGHTS = {"good": 0.92, "poor": 0.08}
BUDGET = 1.0


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores at 0.3 or more go."""
    return toxicity.toxicity_filter(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 of five-word shingles, the one with the smallest id stays."""
    return minhash.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage that aligns with a benchmark item go."""
    return decontaminate.decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets; ``n_chars`` follows the text."""
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates bring the words of good and poor texts to their target shares; copies round them."""
    labelled = _table(spark, sf_dir, "labels").selectExpr("doc_id", "CASE WHEN quality = 0 THEN 'poor' WHEN quality = 1 THEN 'good' END AS domain")
    return mixing.mixed(docs, labelled, WEIGHTS, BUDGET)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix),
]

#: SQL expresses neither the trained stages nor the alignment; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again before the next, and what led to it deleted."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as made:
            docs = stored(stage(spark, docs, sf_dir), name)
            made.pop()
    return docs
