"""Queries of retrieval: sparse, dense and hybrid search, joins of rankings, question contexts."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from docweft.functions.scoring import dot
from docweft.operators import answers, retrieval
from docweft.params import SearchParams
from docweft.plans.registry import query, table
from docweft.sources.store import fingerprint, work_dir

QUERY = "licensed under the worthless terms of trash, trash and scum"
MANY = ["apache license version", "all rights reserved", "idiot clown", "token password secret", "der die das und"]
TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def corpus(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def chunk_vectors(spark, d):
    """The embeddings as chunks: ten of them make a document."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 10).cast("bigint").alias("doc_id"), "embedding")


_indexes: dict[tuple, retrieval.SparseIndex] = {}


def sparse_index(spark, d) -> retrieval.SparseIndex:
    """The index of the documents: built once in a session for the files as they are, and read by every search."""
    key = (spark.sparkContext.applicationId, fingerprint(spark, f"{d}/documents.parquet"))
    if key not in _indexes:
        _indexes[key] = retrieval.SparseIndex.build(corpus(spark, d), f"{work_dir(spark)}/docweft-index-{uuid.uuid4().hex}")
    return _indexes[key]


def query_vector(spark, d) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").filter("vec_id = 0").first().embedding]


STATS = f"""tok AS (SELECT doc_id AS chunk_id, unnest({TOKENS}) AS term FROM documents),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
len AS (SELECT doc_id AS chunk_id, len({TOKENS}) AS len FROM documents),
st AS (SELECT count(*) AS n, avg(len) AS avgdl FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
raw AS (SELECT term, df, ln(n - df + CAST(0.5 AS DOUBLE)) - ln(df + CAST(0.5 AS DOUBLE)) AS raw FROM df, st),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN CAST(0.25 AS DOUBLE) * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


def _scores(queries: list[str]) -> str:
    values = ", ".join(f"({i}, '{q}')" for i, q in enumerate(queries))
    return f"""{STATS}, q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(q), '[a-z0-9]+')) AS term FROM (VALUES {values}) v(query_id, q)) GROUP BY 1, 2),
sc AS (SELECT query_id, chunk_id, round(sum(times * idf * tf * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * len / avgdl))), 6) AS score
  FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN len USING (chunk_id), st GROUP BY 1, 2),
sparse AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc WHERE score > 0)"""


BM25 = _scores([QUERY])
DENSE = """dense AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT vec_id AS chunk_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings) ORDER BY rank LIMIT 30)"""


@query("agg_bm25_stats", f"WITH {STATS} SELECT CAST(n AS BIGINT) AS n, round(avgdl, 6) AS avgdl FROM st")
def bm25_stats(spark, d):
    return retrieval.corpus_stats(corpus(spark, d)).select("n", F.round("avgdl", 6).alias("avgdl"))


@query("bm25_idf", f"WITH {STATS} SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM idf")
def bm25_idf(spark, d):
    return sparse_index(spark, d).vocabulary.select("term", "df", F.round("idf", 6).alias("idf"))


def _sparse(spark, d, queries=(QUERY,), n=30):
    q = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    return retrieval.top(sparse_index(spark, d).scores(q), n, ("query_id",), digits=6)


@query("bm25_search", f"WITH {BM25} SELECT chunk_id, score, rank FROM sparse WHERE rank <= 30")
def bm25_search(spark, d):
    return _sparse(spark, d).select("chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query("bm25_search_multi", f"WITH {_scores(MANY)} SELECT CAST(query_id AS INTEGER) AS query_id, chunk_id, score, rank FROM sparse WHERE rank <= 10")
def bm25_many(spark, d):
    return _sparse(spark, d, MANY, 10).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query("index_snapshot_swap", f"WITH {STATS} SELECT term, CAST(df AS BIGINT) AS df FROM df")
def index_snapshot_swap(spark, d):
    """A second version takes the place of the first, of half of the documents, once it is whole."""
    top, docs = f"{work_dir(spark)}/docweft-index-{uuid.uuid4().hex}", corpus(spark, d)
    half = retrieval.SparseIndex.build(docs.filter("chunk_id % 2 = 0"), top)
    before = half.vocabulary.count()
    retrieval.SparseIndex.build(docs, top)
    assert half.vocabulary.count() == before  # a reader keeps the version that it opened
    return retrieval.SparseIndex.open(spark, top).vocabulary.select("term", "df")


def _dense(spark, d, n=30):
    score = F.round(dot("embedding", retrieval.literal_vector(query_vector(spark, d))), 6)
    return retrieval.top(chunk_vectors(spark, d).select("chunk_id", score.alias("score")), n)


@query("cosine_topk", f"WITH {DENSE} SELECT chunk_id, score, rank FROM dense")
def cosine_topk(spark, d):
    return _dense(spark, d).withColumn("rank", F.col("rank").cast("long"))


@query(
    "cosine_topk_filtered",
    """SELECT vec_id AS chunk_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score
FROM embeddings WHERE (vec_id // 10) % 7 = 0 ORDER BY list_inner_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 20""",
)
def cosine_filtered(spark, d):
    found = retrieval.cosine_topk(chunk_vectors(spark, d), query_vector(spark, d), 20, F.col("doc_id") % 7 == 0)
    return found.select("chunk_id", F.round("score", 6).alias("score"))


@query(
    "cosine_topk_many",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query, v.vec_id AS chunk_id, list_inner_product(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) AS rank FROM s) SELECT query, chunk_id, CAST(rank AS BIGINT) AS rank, round(score, 5) AS score FROM r WHERE rank <= 10""",
)
def cosine_many(spark, d):
    asked = table(spark, d, "embeddings").filter("vec_id % 100 = 0").select("vec_id", "embedding").orderBy("vec_id").toArrow()  # the stated query set
    block = np.array([x.as_py() for x in asked.column("embedding")], dtype=np.float64)
    ids = spark.createDataFrame([(i, v.as_py()) for i, v in enumerate(asked.column("vec_id"))], "query_id int, query bigint")
    found = retrieval.cosine_topk_many(chunk_vectors(spark, d), block, 10)
    return found.join(F.broadcast(ids), "query_id").select("query", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


def _rrf(weight: float) -> str:
    return f"""WITH {BM25}, {DENSE}, f AS (SELECT coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.rank AS dense_rank, b.rank AS bm25_rank,
  round(coalesce(CAST({weight} AS DOUBLE) / (60 + a.rank), 0) + coalesce(CAST({1 - weight} AS DOUBLE) / (60 + b.rank), 0), 9) AS fused_score
  FROM dense a FULL JOIN (SELECT * FROM sparse WHERE rank <= 30) b ON a.chunk_id = b.chunk_id)
SELECT chunk_id, CAST(dense_rank AS BIGINT) AS dense_rank, CAST(bm25_rank AS BIGINT) AS bm25_rank, fused_score FROM f ORDER BY fused_score DESC, chunk_id LIMIT 30"""


def _fused(spark, d, weight: float):
    fused = retrieval.rrf(_dense(spark, d), _sparse(spark, d).drop("query_id"), 60, weight, 60)
    rounded = fused.select("chunk_id", F.col("dense_rank").cast("long").alias("dense_rank"), F.col("bm25_rank").cast("long").alias("bm25_rank"), F.round("fused_score", 9).alias("fused_score"))
    return rounded.orderBy(F.desc("fused_score"), "chunk_id").limit(30)


@query("rrf_fuse", _rrf(0.5))
def rrf_fuse(spark, d):
    return _fused(spark, d, 0.5)


@query("join_rrf", _rrf(0.8))
def join_rrf(spark, d):
    return _fused(spark, d, 0.8)


@query("union_ids", f"WITH {BM25}, {DENSE} SELECT chunk_id FROM dense UNION SELECT chunk_id FROM sparse WHERE rank <= 30")
def union_ids(spark, d):
    return _dense(spark, d).select("chunk_id").union(_sparse(spark, d).select("chunk_id")).distinct()


@query("rank_enumerate", f"WITH {DENSE} SELECT chunk_id, rank FROM dense WHERE rank <= 5")
def rank_enumerate(spark, d):
    return _dense(spark, d, 5).select("chunk_id", F.col("rank").cast("long").alias("rank"))


OVERLAP = "len(list_intersect(list_distinct(regexp_extract_all('{q}', '[a-z0-9]+')), list_distinct(" + TOKENS + ")))"


@query("rerank", f"""WITH {BM25} SELECT chunk_id, CAST({OVERLAP.format(q=QUERY)} AS DOUBLE) AS rerank_score FROM sparse JOIN documents ON doc_id = chunk_id WHERE rank <= 30 ORDER BY rerank_score DESC, chunk_id LIMIT 10""")
def rerank(spark, d):
    hits = retrieval.hydrate(_sparse(spark, d).select("chunk_id"), corpus(spark, d))
    return retrieval.rerank(hits, QUERY, 10).select("chunk_id", "rerank_score")


@query("intersect_ids", f"SELECT doc_id AS chunk_id, CAST({OVERLAP.format(q=QUERY)} AS BIGINT) AS shared FROM documents")
def intersect_ids(spark, d):
    return corpus(spark, d).select("chunk_id", retrieval.overlap_score(QUERY, "text").cast("long").alias("shared"))


@query("join_hydrate", f"WITH {BM25} SELECT chunk_id, rank, n_chars FROM sparse JOIN documents ON doc_id = chunk_id WHERE rank <= 30")
def join_hydrate(spark, d):
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "n_chars")
    return retrieval.hydrate(_sparse(spark, d).select("chunk_id", F.col("rank").cast("long").alias("rank")), chunks)


@query("join_filename", f"WITH {DENSE} SELECT chunk_id, coalesce(p_name, '(deleted)') AS filename FROM dense LEFT JOIN part ON p_partkey = chunk_id // 10 AND p_partkey % 2 = 0")
def join_filename(spark, d):
    names = table(spark, d, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("filename"))
    hits = _dense(spark, d).withColumn("doc_id", F.floor(F.col("chunk_id") / 10).cast("bigint"))
    return retrieval.with_filename(hits, names).select("chunk_id", "filename")


@query(
    "hybrid_search",
    f"""WITH {BM25}, {DENSE}, f AS (SELECT coalesce(a.chunk_id, b.chunk_id) AS chunk_id, round(coalesce(CAST(0.5 AS DOUBLE) / (60 + a.rank), 0) + coalesce(CAST(0.5 AS DOUBLE) / (60 + b.rank), 0), 9) AS fused_score
  FROM dense a FULL JOIN (SELECT * FROM sparse WHERE rank <= 30) b ON a.chunk_id = b.chunk_id), c AS (SELECT * FROM f ORDER BY fused_score DESC, chunk_id LIMIT 30)
SELECT chunk_id, fused_score, CAST({OVERLAP.format(q=QUERY)} AS DOUBLE) AS rerank_score FROM c JOIN documents ON doc_id = chunk_id ORDER BY rerank_score DESC, chunk_id LIMIT 10""",
)
def hybrid_search(spark, d):
    hits = retrieval.hydrate(_fused(spark, d, 0.5).select("chunk_id", "fused_score"), corpus(spark, d))
    return retrieval.rerank(hits, QUERY, SearchParams().return_n).select("chunk_id", "fused_score", "rerank_score")


@query("search_debug", f"WITH {BM25}, {DENSE} SELECT 'dense' AS side, chunk_id, score, rank FROM dense UNION ALL SELECT 'bm25', chunk_id, score, rank FROM sparse WHERE rank <= 30")
def search_debug(spark, d):
    side = lambda df, name: df.select(F.lit(name).alias("side"), "chunk_id", "score", F.col("rank").cast("long").alias("rank"))
    return side(_dense(spark, d), "dense").unionByName(side(_sparse(spark, d), "bm25"))


#: Whole words and what is between them in turn; the spans are the words that the query has.
WORDS = ", ".join(f"'{w.strip(',')}'" for w in QUERY.split())


@query(
    "term_highlights",
    rf"""WITH p AS (SELECT doc_id AS chunk_id, string_split(regexp_replace(text, '([\p{{L}}\p{{M}}\p{{N}}_]+)', chr(57344) || '\1' || chr(57344), 'g'), chr(57344)) AS parts FROM documents),
i AS (SELECT chunk_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM p),
e AS (SELECT chunk_id, part, i, sum(length(part)) OVER (PARTITION BY chunk_id ORDER BY i) AS ends FROM i)
SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY i) - 1 AS position, CAST(ends - length(part) AS BIGINT) AS start, CAST(ends AS BIGINT) AS "end" FROM e WHERE i % 2 = 0 AND lower(part) IN ({WORDS}) QUALIFY position < 20""",
)
def term_highlights(spark, d):
    rows = corpus(spark, d).select("chunk_id", F.posexplode(retrieval.term_highlights(QUERY, "text")).alias("position", "s"))
    return rows.select("chunk_id", *(F.col(c).cast("long").alias(n) for c, n in (("position", "position"), ("s.start", "start"), ("s.end", "end"))))


@query("best_sentence_terms")
def best_sentence_terms(spark, d):
    return corpus(spark, d).select("chunk_id", retrieval.best_sentence(QUERY)("text").alias("s")).filter("s.start IS NOT NULL")


@query("best_sentence_semantic")
def best_sentence_semantic(spark, d):
    vector = retrieval.hashed_embedding(QUERY)
    return retrieval.hydrate(_sparse(spark, d).select("chunk_id"), corpus(spark, d)).select("chunk_id", retrieval.semantic_sentence(vector)("text").alias("s"))


@query(
    "best_line_terms",
    rf"""SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(shared AS BIGINT) AS shared FROM (
  SELECT doc_id, pos, {OVERLAP.format(q=QUERY).replace('text', 'line')} AS shared, row_number() OVER (PARTITION BY doc_id ORDER BY {OVERLAP.format(q=QUERY).replace('text', 'line')} DESC, pos) AS r
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)) WHERE r = 1 AND shared > 0""",
)
def best_line_terms(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    scored = lines.select("doc_id", F.col("pos").cast("long").alias("pos"), retrieval.overlap_score(QUERY, "line").cast("long").alias("shared")).filter("shared > 0")
    return scored.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("shared"), "pos"))).filter("r = 1").drop("r")


@query("embed_passages")
def embed_passages(spark, d):
    return retrieval.embed(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.size("embedding").alias("dim"), F.round(F.sqrt(dot("embedding", "embedding")), 4).alias("norm"))


@query("embed_query")
def embed_query(spark, d):
    return retrieval.embed(table(spark, d, "benchmark").select("item_id", "text"), prefix="query: ").select("item_id", "embedding")


CONTEXT = f"""{BM25}, h AS (SELECT rank, '[' || rank || '] (doc' || doc_id || '.txt, p. ' || (doc_id % 9) || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '–' || (doc_id % 9 + 1) END || ', section "' || source || '")' || chr(10)
    || CASE WHEN length(text) <= 400 THEN text WHEN regexp_extract(left(text, 400), '(?s)^(.*[^ \\t\\n\\r\\f])[ \\t\\n\\r\\f]+[^ \\t\\n\\r\\f]+[ \\t\\n\\r\\f]*$', 1) <> ''
      THEN regexp_extract(left(text, 400), '(?s)^(.*[^ \\t\\n\\r\\f])[ \\t\\n\\r\\f]+[^ \\t\\n\\r\\f]+[ \\t\\n\\r\\f]*$', 1) || '…' ELSE regexp_replace(left(text, 400), '\\s+$', '') || '…' END AS block
  FROM sparse JOIN documents ON doc_id = chunk_id WHERE rank <= 6),
r AS (SELECT rank AS marker, block, sum(length(block)) OVER (ORDER BY rank) AS running FROM h)"""


def _context(spark, d):
    from docweft.params import AskParams

    docs = table(spark, d, "documents").withColumn("chunk_id", F.col("doc_id"))
    page = F.col("doc_id") % 9
    hits = retrieval.hydrate(_sparse(spark, d, n=6).select("chunk_id", "rank"), docs).select(
        "rank", "chunk_id", "text", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), page.alias("page_start"), F.when(F.col("doc_id") % 2 == 0, page).otherwise(page + 1).alias("page_end"), F.col("source").alias("section")
    )
    return answers.context_blocks(hits, AskParams(chunk_char_budget=400, context_char_budget=1500))


@query("build_qa_context", f"WITH {CONTEXT} SELECT CAST(marker AS BIGINT) AS marker, block, CAST(running AS BIGINT) AS running FROM r WHERE running <= 1500")
def build_qa_context(spark, d):
    return _context(spark, d).select(F.col("marker").cast("long").alias("marker"), "block", "running")


@query("running_budget", f"WITH {CONTEXT} SELECT CAST(count(*) AS BIGINT) AS included, CAST(max(running) AS BIGINT) AS used FROM r WHERE running <= 1500")
def running_budget(spark, d):
    return _context(spark, d).agg(F.count("*").alias("included"), F.max("running").alias("used"))


#: Questions of which the last has no hit at all; the third gets no answer from the model, and the fourth an empty one.
ASKED = [*MANY[:4], "zzqqzz xxyyxx"]


@query(
    "answer_ladder",
    f"""WITH {_scores(ASKED)}, n AS (SELECT query_id, count(*) AS n FROM sparse WHERE rank <= 6 GROUP BY 1), q0 AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4)) v(query_id))
SELECT CAST(query_id AS INTEGER) AS query_id, CAST(coalesce(n, 0) AS BIGINT) AS hits, CASE WHEN n IS NULL THEN 'no_evidence' WHEN query_id IN (2, 3) THEN 'unavailable' ELSE 'llm' END AS status FROM q0 LEFT JOIN n USING (query_id)""",
)
def answer_ladder(spark, d):
    questions = spark.createDataFrame(list(enumerate(ASKED)), "query_id int, query string")
    hits = _sparse(spark, d, ASKED, 6).groupBy("query_id").agg(F.count("*").alias("hits"))
    said = F.when(F.col("query_id") == 2, F.lit(None)).when(F.col("query_id") == 3, F.lit("  ")).otherwise(F.concat(F.lit("It is so [1]: "), "query"))
    both = questions.join(hits, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return both.select("query_id", "hits", answers.answer_status(F.col("hits"), said).alias("status"))


@query("llm_complete", "SELECT 'llm' AS status, 'It is [1] and, from 2 messages.' AS answer, CAST(1 AS INTEGER) AS citations")
def llm_complete(spark, d):
    model = answers.Model(lambda messages: f"It is [1] and [99], from {len(messages)} messages.")
    found = answers.answer("What is licensed?", _context(spark, d).drop("marker", "block", "running"), model)
    return spark.createDataFrame([(found["status"], found["answer"], len(found["citations"]))], "status string, answer string, citations int")
