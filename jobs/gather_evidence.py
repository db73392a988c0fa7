"""Gather the passages from which each question of a file is to be answered.

    python -m jobs.gather_evidence INDEX DOCUMENTS QUESTIONS OUT [--settings jobs/gather_evidence.json]

INDEX is the output of ``jobs.index_documents`` over DOCUMENTS; DOCUMENTS and QUESTIONS
are Parquet.  Each question is searched in the index; its best documents are cut to the
budget of a passage, get their marker and header, and fill the budget of the context in
order.  Two tables are written below OUT:

    passages   question_id, marker, doc_id, score, block    by lang of the document
    questions  question_id, passages, chars                 by status

The status of a question is ``evidence``, ``no_evidence`` (no document has any of its
words), or ``refused`` (blank, or longer than a query may be).  A question whose id comes
several times counts once, with its smallest text; rows without an id are left out.  A
document without a language is in the partition ``unknown``.

Questions are taken in passes of about ``questions_per_pass``, dealt by a hash of their
id, so that the terms of a pass are a bounded table, which the search sends to all tasks.
Both tables are replaced whole, so a rerun gives the same.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions.text import content_hash
from docweft.operators import retrieval
from docweft.operators.answers import context_blocks
from docweft.params import AskParams, SearchParams
from docweft.sources.store import kept, scratch
from jobs import index_documents
from jobs.settings import command

log = logging.getLogger("jobs.gather_evidence")

PASSAGES = "question_id bigint, marker bigint, doc_id bigint, score double, block string, lang string"
QUESTIONS = "question_id bigint, passages bigint, chars bigint, status string"


@dataclass(frozen=True)
class Settings:
    id_column: str = "item_id"
    question_column: str = "text"
    top_k: int = 6
    chunk_char_budget: int = 1400
    context_char_budget: int = 9000
    questions_per_pass: int = 500


def _write(rows: DataFrame, path: str, by: str, schema: str, mode: str) -> DataFrame:
    rows.write.mode(mode).option("partitionOverwriteMode", "static").partitionBy(by).parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def found_in(index: retrieval.SparseIndex, indexed: DataFrame, documents: DataFrame, questions: DataFrame, settings: Settings) -> DataFrame:
    """The passages of a bounded table of ``questions`` (query_id, query); ``indexed`` (chunk_id, content_hash) tells which text of an id was indexed."""
    best = retrieval.top(index.scores(questions), settings.top_k, ("query_id",), digits=6)
    hits = retrieval.hydrate(retrieval.hydrate(best, indexed), documents).filter(F.col("content_hash") == content_hash("text"))
    hits = hits.groupBy("query_id", "rank", "score", "chunk_id").agg(F.min(F.struct("text", "lang", "source")).alias("d")).select("query_id", "rank", "score", "chunk_id", "d.*")
    none = F.lit(None).cast("int")
    named = hits.select("query_id", "rank", "score", "chunk_id", "lang", "text", F.concat(F.lit("doc"), F.col("chunk_id").cast("string"), F.lit(".txt")).alias("filename"), none.alias("page_start"), none.alias("page_end"), F.col("source").alias("section"))
    p = AskParams(top_k=settings.top_k, chunk_char_budget=settings.chunk_char_budget, context_char_budget=settings.context_char_budget)
    blocks = context_blocks(named, p, ("query_id",))
    return blocks.select(F.col("query_id").alias("question_id"), F.col("marker").cast("bigint").alias("marker"), F.col("chunk_id").alias("doc_id"), "score", "block", F.coalesce("lang", F.lit("unknown")).alias("lang"))


def run(spark: SparkSession, index: str, documents: str, questions: str, out: str, settings: Settings = Settings()) -> int:
    """Write the passages and states of all questions; the number of questions."""
    searched = index_documents.index(spark, index)
    indexed = index_documents.tables(spark, index)["documents"].filter("NOT is_duplicate").select(F.col("doc_id").alias("chunk_id"), "content_hash")
    docs = spark.read.parquet(documents).select(F.col("doc_id").cast("bigint").alias("chunk_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    with scratch(spark):
        searched.vocabulary = kept(searched.vocabulary, "vocabulary")
        asked = spark.read.parquet(questions).select(F.col(settings.id_column).cast("bigint").alias("query_id"), F.trim(F.coalesce(F.col(settings.question_column).cast("string"), F.lit(""))).alias("query"))
        asked = kept(asked.filter("query_id IS NOT NULL").groupBy("query_id").agg(F.min("query").alias("query")), "questions")
        good = asked.filter(F.length("query").between(1, SearchParams.max_query_chars))
        n = good.count()
        passes = max(1, -(-n // settings.questions_per_pass))
        log.info("read %d questions, %d of them to be asked, in %d passes", asked.count(), n, passes)
        parts = []
        for i in range(passes):
            part = good.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)
            parts.append(kept(found_in(searched, indexed, docs, part, settings), "passages"))
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        passages = _write(rows, f"{out}/passages", "lang", PASSAGES, "overwrite")
        per = passages.groupBy("question_id").agg(F.count("*").alias("passages"), F.sum(F.length("block")).alias("chars"))
        state = asked.withColumnRenamed("query_id", "question_id").join(per, "question_id", "left").fillna(0, ["passages", "chars"])
        status = F.when(~F.length("query").between(1, SearchParams.max_query_chars), "refused").when(F.col("passages") > 0, "evidence").otherwise("no_evidence")
        _write(state.select("question_id", "passages", "chars", status.alias("status")), f"{out}/questions", "status", QUESTIONS, "overwrite")
        written = passages.count()
    log.info("wrote %d passages of %d questions below %s", written, n, out)
    return n


if __name__ == "__main__":
    command(
        "gather_evidence",
        "Gather the passages from which each question of a file is to be answered.",
        {"index": "folder of jobs.index_documents", "documents": "Parquet of documents", "questions": "Parquet of questions", "out": "folder to write to"},
        Settings,
        run,
    )
