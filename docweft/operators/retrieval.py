"""Sparse, dense and hybrid retrieval.

A corpus is (chunk_id, text); a ranking is (chunk_id, score) or (query_id, chunk_id,
score), best first, ties by chunk_id.  Queries are few and bounded; the corpus is not and
is never collected.  A sparse index is tokenised and written once: postings in the order
of their terms, so that a search reads the row groups of its own terms only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.functions.citations import cut_at
from docweft.functions.scoring import dot
from docweft.functions.segments import SPAN, sentence_spans
from docweft.functions.text import tokenize
from docweft.params import SearchParams, checked_query
from docweft.sources.store import claimed, committed, kept, scratch

#: Okapi BM25 (fixed values): saturation, length share, and the floor of negative idf as a share of the mean.
K1, B, EPSILON = 1.5, 0.75, 0.25


def term_frequencies(corpus: DataFrame) -> DataFrame:
    """(chunk_id, term, len, tf): tasks count the terms of whole texts, so that tokens are never shuffled.

    Texts of one chunk_id that have as many tokens are counted together; only if ids repeat are counts shuffled.
    """
    schema = T.StructType([corpus.schema["chunk_id"], T.StructField("term", T.StringType()), T.StructField("len", T.IntegerType()), T.StructField("tf", T.LongType())])
    tokens = re.compile("[a-z0-9]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [tokens.findall(text.lower()) for text in part.column("text").to_pylist()]
                counts = [Counter(f) for f in found]
                size = [len(c) for c in counts]
                own = np.repeat(np.arange(len(size)), size)
                terms, tfs = (pa.array(list(chain.from_iterable(x)), kind) for x, kind in ((counts, pa.string()), ((c.values() for c in counts), pa.int64())))
                yield pa.RecordBatch.from_arrays([part.column("chunk_id").take(pa.array(own)), terms, pa.array(np.array([len(f) for f in found], dtype=np.int32)[own]), tfs], schema.names)

    counted = corpus.filter("text IS NOT NULL").select("chunk_id", "text").mapInArrow(run, schema)
    if corpus.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return counted
    return counted.groupBy("chunk_id", "term", "len").agg(F.sum("tf").alias("tf"))


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """One row: n and avgdl."""
    return corpus.agg(F.count("*").alias("n"), F.avg(F.size(tokenize("text"))).alias("avgdl"))


def bm25_idf(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf): negative values become EPSILON times the mean over the vocabulary."""
    one = stats.select("n")  # a single row
    raw = df.join(F.broadcast(one)).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def asked_terms(queries: DataFrame) -> list[tuple[int, str, int]]:
    """(query_id, term, times) of a small table of queries."""
    rows = queries.select("query_id", F.explode(tokenize("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    return [tuple(r) for r in rows.collect()]


class SparseIndex:
    """Postings (term, chunk_id, tf, len), vocabulary (term, df, idf) and stats (n, avgdl).

    Postings that are partitioned by the first ``letter`` of their terms are read for the letters of a query only.
    """

    def __init__(self, postings: DataFrame, vocabulary: DataFrame, stats: DataFrame):
        self.spark = postings.sparkSession
        self.postings, self.vocabulary, self.stats = postings, vocabulary, stats
        self.avgdl = stats.first().avgdl

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> SparseIndex:
        """A committed version."""
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "vocabulary", "stats")))

    @classmethod
    def build(cls, corpus: DataFrame, top: str) -> SparseIndex:
        """Write the next version below a folder; readers see it once its stats are there."""
        spark = corpus.sparkSession
        version = claimed(spark, top)
        path = f"{top}/version={version}"
        with scratch(spark):
            # in ranges of terms, those of one term over several files if it has very many rows; ranges are drawn from stored counts
            counted = kept(term_frequencies(corpus), "counted")
            counted.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id").select("term", "chunk_id", "tf", "len").write.parquet(f"{path}/postings")
        df = spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("df"))
        # tokenised once, for the vocabulary and for the table
        stats = spark.createDataFrame([corpus_stats(corpus).first()], "n bigint, avgdl double")
        bm25_idf(df, stats).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/vocabulary")
        stats.write.parquet(f"{path}/stats")
        return cls.at(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, top: str) -> SparseIndex:
        """The newest version below a folder."""
        return cls.at(spark, f"{top}/version={committed(spark, top, 'stats')[-1]}")

    def scores(self, queries: DataFrame) -> DataFrame:
        """(query_id, chunk_id, score) of every pair with a shared term and a positive score; a term counts as often as the query has it."""
        asked = asked_terms(queries)
        terms = sorted({term for _, term, _ in asked})
        idf = {r.term: r.idf for r in self.vocabulary.filter(F.col("term").isin(terms)).collect()} if terms else {}
        weighted = self.spark.createDataFrame([(q, term, float(times * idf[term])) for q, term, times in asked if term in idf], T.StructType([queries.schema["query_id"], T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())]))
        postings = self.postings.filter(F.col("term").isin(sorted(idf) or [""]))
        if "letter" in postings.columns:
            postings = postings.filter(F.col("letter").isin(sorted({term[0] for term in idf}) or [""]))
        hit = postings.join(F.broadcast(weighted), "term")  # a row for each term of the queries
        part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / (self.avgdl or 1.0)))
        return hit.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score")).filter("score > 0")

    def search(self, query: str, n: int = SearchParams.retrieve_n) -> DataFrame:
        queries = self.spark.createDataFrame([(0, query)], "query_id int, query string")
        return top(self.scores(queries).select("chunk_id", "score"), n)


def top(scores: DataFrame, n: int, keys: tuple[str, ...] = (), digits: int | None = None) -> DataFrame:
    """The n best rows (of each key), with ``rank``."""
    if digits is not None:
        scores = scores.withColumn("score", F.round("score", digits))
    order = [F.desc("score"), F.asc("chunk_id")]
    if keys:
        ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        return ranked.filter(F.col("rank") <= n)
    return scores.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def literal_vector(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def cosine_topk(vectors: DataFrame, query: list[float], k: int, keep: Column | None = None) -> DataFrame:
    """(chunk_id, score, rank) of unit vectors; ``keep`` filters before the ranking, not after it."""
    found = vectors if keep is None else vectors.filter(keep)
    return top(found.select("chunk_id", dot("embedding", literal_vector(query)).alias("score")), k)


def cosine_topk_overfetch(vectors: DataFrame, query: list[float], k: int, keep: Column, factor: int = 4) -> DataFrame:
    """Filter after fetching ``factor`` k rows: may give fewer than k."""
    first = top(vectors.select("chunk_id", "doc_id", dot("embedding", literal_vector(query)).alias("score")), factor * k).drop("rank")
    return top(first.filter(keep).select("chunk_id", "score"), k)


def cosine_topk_many(vectors: DataFrame, queries: np.ndarray, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank) for a bounded block of queries: one matrix product a batch, k rows a task and query."""
    schema = T.StructType([T.StructField("query_id", T.IntegerType()), vectors.schema["chunk_id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("embedding").flatten().to_numpy().reshape(batch.num_rows, -1)
                s = x @ queries.T.astype(x.dtype)
                best = np.argsort(-s, axis=0, kind="stable")[:k]
                q = np.repeat(np.arange(len(queries), dtype=np.int32), len(best))
                rows = best.T.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(q), batch.column("chunk_id").take(pa.array(rows)), pa.array(s[rows, q].astype(np.float64))], schema.names)

    return top(vectors.select("chunk_id", "embedding").mapInArrow(run, schema), k, ("query_id",))


def rrf(dense: DataFrame, sparse: DataFrame, k: int = 60, w: float = 0.5, n: int = 30) -> DataFrame:
    """Weighted reciprocal rank fusion of two rankings (chunk_id, score, rank); a repeated id keeps its best rank."""

    def best(r: DataFrame, name: str) -> DataFrame:
        return r.groupBy("chunk_id").agg(F.min("rank").alias(f"{name}_rank"), F.min_by("score", "rank").alias(f"{name}_score"))

    both = best(dense, "dense").join(best(sparse, "bm25"), "chunk_id", "full")
    part = lambda name, weight: F.coalesce(F.lit(weight) / (k + F.col(f"{name}_rank")), F.lit(0.0))
    fused = both.withColumn("fused_score", part("dense", w) + part("bm25", 1 - w))
    return fused.orderBy(F.desc("fused_score"), "chunk_id").limit(n)


def hydrate(ranking: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rankings with their chunks' columns; ids without a chunk drop out.  A ranking has at most a few hundred rows."""
    return chunks.join(F.broadcast(ranking), "chunk_id")


def with_filename(hits: DataFrame, documents: DataFrame) -> DataFrame:
    names = documents.select("doc_id", "filename")
    return hits.join(names, "doc_id", "left").withColumn("filename", F.coalesce("filename", F.lit("(deleted)")))


def overlap_score(query: str, text: Column | str) -> Column:
    """Distinct query terms that the text has: the built-in reranker."""
    terms = F.array_distinct(tokenize(F.lit(query)))
    return F.size(F.array_intersect(terms, tokenize(text))).cast("double")


def rerank(hits: DataFrame, query: str, n: int, score: Column | None = None) -> DataFrame:
    scored = hits.withColumn("rerank_score", overlap_score(query, "text") if score is None else score)
    return scored.orderBy(F.desc("rerank_score"), "chunk_id").limit(n)


def _terms(query: str) -> list[str]:
    return sorted({t for t in re.findall("[a-z0-9]+", query.lower()) if len(t) > 1})


def term_highlights(query: str, text: Column | str, most: int = 20) -> Column:
    """array<struct<start, end>> of the query's terms as whole words, in either case, the first ``most``; empty without any.

    The text is cut at the terms, and the running lengths of the pieces are the ends of the
    spans.  Whole words never touch, so neither do spans.
    """
    terms = _terms(query)
    if not terms:
        return F.array().cast(T.ArrayType(SPAN))
    # the first letter is looked at before the border of a word, which costs much more to tell
    heads = "".join(sorted({t[0] for t in terms}))
    pieces = F.slice(cut_at(text, rf"(?iU)(?=[{heads}])\b(?:{'|'.join(terms)})\b"), 1, 2 * most)
    # one pass over the pieces, which are named once: what a lambda names is computed anew for each element
    none = F.struct(F.lit(0).alias("at"), F.lit(False).alias("term"), F.array().cast(T.ArrayType(SPAN)).alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p)
        spans = F.when(acc["term"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"))))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), (~acc["term"]).alias("term"), spans.alias("spans"))

    return F.aggregate(pieces, none, step, lambda acc: acc["spans"])


def best_sentence(query: str, nearest: np.ndarray | None = None):
    """A UDF for the sentence with most distinct query terms, the earliest of equals; null without any.

    With a query vector as ``nearest``, a text of which no sentence has a term gets the sentence nearest to it.
    """
    terms = set(_terms(query))

    def best(text: str | None) -> dict | None:
        lower = (text or "").lower()
        if any(t in lower for t in terms):
            found = [(len(terms & set(re.findall("[a-z0-9]+", text[a:b].lower()))), -a, b) for a, b in sentence_spans(text)]
            top_ = max(found, default=(0, 0, 0))
            if top_[0]:
                return {"start": -top_[1], "end": top_[2]}
        if nearest is None:
            return None  # no term is anywhere, so no sentence has to be found
        return _nearest_sentence(text, nearest)

    @F.pandas_udf(SPAN)
    def sentence(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best(t) or {"start": None, "end": None} for t in texts], columns=["start", "end"], dtype="Int32")

    return sentence


def hit_segments(text: str, spans: str, sentence: str) -> Column:
    """array<struct<text, shown>> of a hit: cut at the spans of query terms, else at the best sentence, else the plain text."""
    chosen = F.when(F.size(spans) > 0, F.col(spans)).when(F.col(f"{sentence}.start").isNotNull(), F.array(F.col(sentence))).otherwise(F.array().cast(T.ArrayType(SPAN)))
    kind = F.when(F.size(spans) > 0, F.lit("term")).otherwise(F.lit("sentence"))
    ends = F.concat(F.array(F.lit(0)), F.flatten(F.transform(chosen, lambda s: F.array(s["start"], s["end"]))), F.array(F.length(text)))
    # the stretches between neighbouring ends are in turn outside and inside of the chosen spans
    pieces = F.transform(F.slice(ends, F.lit(1), F.size(ends) - 1), lambda a, i: F.struct(F.substring(F.col(text), a + 1, F.get(ends, i + 1) - a).alias("text"), F.when(i % 2 == 1, kind).otherwise(F.lit("plain")).alias("shown")))
    return F.filter(pieces, lambda p: p["text"] != "")


#: Bytes of tokens as they are, all others as blanks.
TOKEN_BYTES = bytes(b if re.match(b"[a-z0-9]", bytes([b])) else 32 for b in range(256))


def hashed_embedding(text: str, dim: int = 64) -> np.ndarray:
    """A unit bag-of-words vector by signed feature hashing: the built-in embedder."""
    tokens = text.lower().encode("utf-8", "replace").translate(TOKEN_BYTES).split()
    h = np.fromiter(map(crc32, tokens), dtype=np.int64, count=len(tokens))
    out = np.bincount(h % dim, weights=1.0 - 2.0 * (h < 1 << 31), minlength=dim)  # whole numbers, whatever the order
    size = np.linalg.norm(out)
    return out / size if size else out


def embed(df: DataFrame, text: str = "text", dim: int = 64, prefix: str = "") -> DataFrame:
    """All columns and ``embedding``; ``prefix`` is put before each text (queries of an asymmetric model)."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashed_embedding(prefix + (t or ""), dim).astype(np.float32))

    return df.withColumn("embedding", vectors(text))


def _nearest_sentence(text: str | None, query_vector: np.ndarray) -> dict:
    """The sentence nearest to the query vector, the first of equals."""
    found = sentence_spans(text or "")
    if not found:
        return {"start": None, "end": None}
    at = int(np.argmax([hashed_embedding(text[a:b], len(query_vector)) @ query_vector for a, b in found])) if len(found) > 1 else 0
    return {"start": found[at][0], "end": found[at][1]}


def semantic_sentence(query_vector: np.ndarray, enabled: bool = True):
    """A UDF for the sentence nearest to the query vector (the first of equals), or simply the first sentence."""

    def best(text: str | None) -> dict:
        if enabled:
            return _nearest_sentence(text, query_vector)
        start, end = next(iter(sentence_spans(text or "")), (None, None))
        return {"start": start, "end": end}

    @F.pandas_udf(SPAN)
    def sentence(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best(t) for t in texts], columns=["start", "end"], dtype="Int32")

    return sentence


def hybrid_search(index: SparseIndex, chunks: DataFrame, query: str, vector: list[float], p: SearchParams = SearchParams()) -> DataFrame:
    """Dense and sparse top lists, fused, hydrated and reranked: (rank, chunk_id, text, scores)."""
    query = checked_query(query, p.max_query_chars)
    dense = cosine_topk(chunks, vector, p.retrieve_n)
    sparse = index.search(query, p.retrieve_n)
    fused = rrf(dense, sparse, p.rrf_k, p.dense_weight, p.retrieve_n)
    hits = rerank(hydrate(fused, chunks.drop("embedding")), query, p.return_n)
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rerank_score"), "chunk_id")))
