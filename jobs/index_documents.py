"""Keep a sparse search index up to date with a growing folder of documents.

    python -m jobs.index_documents SOURCE OUT [--settings jobs/index_documents.json]

SOURCE is a folder of Parquet documents, or a pattern of such folders and files; new
files in it are new documents.
A file stream with a checkpoint below OUT takes what is new, at most ``files_per_batch``
files in a micro-batch, and ends.  A micro-batch adds to three tables below OUT:

    documents   doc_id, content_hash, is_duplicate, n_tokens    by batch
    postings    term, doc_id, tf, len                           by batch and first letter
    vocabulary  term, df                                        by batch and first letter

A document whose normalised text an earlier one has keeps its row in ``documents`` and
has no postings.  "Earlier" is by batch, then by id.  A document is indexed once: a row
whose id is in the index already is refused, of rows of one batch with the same id
the smallest text counts, and rows without an id are refused.  A null text is an empty one.
Only the id and text columns are read, so other columns may have any name.

Each batch is written under its number, ``documents`` last, and a batch that runs again
after a failure overwrites what it had written; readers take batches that have their
documents.  A run without new files changes nothing.  As postings of a batch never
change, document frequencies of batches add up, and ``index`` needs no pass over postings.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions.text import content_hash, tokenize
from docweft.operators.dedup import exact_duplicates
from docweft.operators.retrieval import SparseIndex, bm25_idf, term_frequencies
from docweft.sources.store import kept, scratch
from jobs.settings import command

log = logging.getLogger("jobs.index_documents")

DOCUMENTS = "doc_id bigint, content_hash string, is_duplicate boolean, n_tokens bigint, batch bigint"
POSTINGS = "term string, doc_id bigint, tf bigint, len bigint, batch bigint, letter string"
VOCABULARY = "term string, df bigint, batch bigint, letter string"


@dataclass(frozen=True)
class Settings:
    id_column: str = "doc_id"
    text_column: str = "text"
    schema: str = "doc_id BIGINT, text STRING"
    files_per_batch: int = 1000


def tables(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The three tables, each of the batches that are complete."""
    documents = spark.read.schema(DOCUMENTS).parquet(f"{out}/documents")
    whole = documents.select("batch").distinct()
    rest = {name: spark.read.schema(schema).parquet(f"{out}/{name}").join(F.broadcast(whole), "batch", "left_semi") for name, schema in (("postings", POSTINGS), ("vocabulary", VOCABULARY))}
    return {"documents": documents, **rest}


def index(spark: SparkSession, out: str) -> SparseIndex:
    """The index as it stands, for searches: frequencies of all batches together."""
    found = tables(spark, out)
    stats = found["documents"].filter("NOT is_duplicate").agg(F.count("*").alias("n"), F.avg("n_tokens").alias("avgdl"))
    df = found["vocabulary"].groupBy("term").agg(F.sum("df").alias("df"))
    return SparseIndex(found["postings"].withColumnRenamed("doc_id", "chunk_id"), bm25_idf(df, stats), stats)


def _write(rows: DataFrame, path: str, *by: str) -> int:
    """Overwrite ``path``, with large partitions split and small ones joined; the number of rows."""
    spread = rows.hint("rebalance", *by).sortWithinPartitions(*by, "term") if by else rows
    spread.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).count()


def take(batch: DataFrame, number: int, out: str) -> None:
    """Add the documents (doc_id, text) of one batch."""
    spark = batch.sparkSession
    with scratch(spark):
        fresh = batch.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        known = None
        if number:  # every batch before it has written its documents
            before = spark.read.schema(DOCUMENTS).parquet(f"{out}/documents").filter(F.col("batch") < number)
            fresh = fresh.join(before.select("doc_id"), "doc_id", "left_anti")
            known = before.filter("NOT is_duplicate").select("content_hash")
        fresh = kept(fresh.select("doc_id", "text", content_hash("text").alias("content_hash"), F.size(tokenize("text")).cast("bigint").alias("n_tokens")), "fresh")
        marked = kept(exact_duplicates(fresh.drop("text"), known, "doc_id"), "marked")
        corpus = fresh.join(marked.filter("NOT is_duplicate").select("doc_id"), "doc_id", "left_semi")
        counted = term_frequencies(corpus.withColumnRenamed("doc_id", "chunk_id")).select("term", F.col("chunk_id").alias("doc_id"), "tf", F.col("len").cast("bigint").alias("len"), F.left("term", F.lit(1)).alias("letter"))
        postings = _write(counted, f"{out}/postings/batch={number}", "letter")
        own = spark.read.schema(counted.schema).parquet(f"{out}/postings/batch={number}")
        terms = _write(own.groupBy("term", "letter").agg(F.count("*").alias("df")).select("term", "df", "letter"), f"{out}/vocabulary/batch={number}", "letter")
        documents = _write(marked.select("doc_id", "content_hash", "is_duplicate", "n_tokens"), f"{out}/documents/batch={number}")
    log.info("batch %d: wrote %d documents, %d postings and %d terms below %s", number, documents, postings, terms, out)


def run(spark: SparkSession, source: str, out: str, settings: Settings = Settings()) -> int:
    """Index what is new in ``source``; the number of rows read."""
    stream = spark.readStream.schema(settings.schema).option("maxFilesPerTrigger", settings.files_per_batch).parquet(source)
    rows = stream.select(F.col(settings.id_column).cast("bigint").alias("doc_id"), F.col(settings.text_column).cast("string").alias("text"))
    writer = rows.writeStream.foreachBatch(lambda batch, number: take(batch, number, out))
    query = writer.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    read = sum(p.numInputRows for p in query.recentProgress)
    log.info("read %d new rows of %s", read, source)
    return read


if __name__ == "__main__":
    command("index_documents", "Keep a sparse search index up to date with a growing folder of documents.", {"source": "folder of Parquet documents", "out": "folder of the index"}, Settings, run)
