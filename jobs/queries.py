"""The jobs as registered queries: each runs its job twice into a new folder and returns all that stands there, with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docweft.plans.registry import query
from docweft.sources.store import work_dir
from jobs import gather_evidence, index_documents

TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
INDEXED = rf"""h AS (SELECT doc_id, text, len({TOKENS}) AS len, sha256(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))) AS content_hash FROM documents),
m AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) > 1 AS is_duplicate FROM h),
tok AS (SELECT doc_id, len, unnest({TOKENS}) AS term FROM m WHERE NOT is_duplicate),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM tok GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)"""


def _folder(spark, name: str) -> str:
    return f"{work_dir(spark)}/docweft-{name}-{uuid.uuid4().hex}"


def _indexed(spark, d) -> str:
    out = _folder(spark, "job1")
    for _ in range(2):
        index_documents.run(spark, f"{d}/documents.parquet*", out)  # a pattern: the table may be a file or a folder
    return out


@query(
    "job1_index",
    f"""WITH {INDEXED}
SELECT 'document' AS kind, doc_id, content_hash AS name, CAST(is_duplicate AS BIGINT) AS n, CAST(len AS BIGINT) AS len, CAST(NULL AS VARCHAR) AS letter, CAST(0 AS BIGINT) AS batch FROM m
UNION ALL SELECT 'posting', doc_id, term, CAST(tf AS BIGINT), CAST(len AS BIGINT), left(term, 1), 0 FROM tf
UNION ALL SELECT 'term', NULL, term, CAST(df AS BIGINT), NULL, left(term, 1), 0 FROM df""",
)
def job1_index(spark, d):
    """All three tables of the index, one below the other."""
    found, none = index_documents.tables(spark, _indexed(spark, d)), lambda kind: F.lit(None).cast(kind)
    columns = {
        "documents": (F.lit("document"), F.col("doc_id"), F.col("content_hash"), F.col("is_duplicate").cast("bigint"), F.col("n_tokens"), none("string")),
        "postings": (F.lit("posting"), F.col("doc_id"), F.col("term"), F.col("tf"), F.col("len"), F.col("letter")),
        "vocabulary": (F.lit("term"), none("bigint"), F.col("term"), F.col("df"), none("bigint"), F.col("letter")),
    }
    one, two, three = (found[name].select(*(c.alias(n) for c, n in zip(cs, ("kind", "doc_id", "name", "n", "len", "letter"), strict=True)), "batch") for name, cs in columns.items())
    return one.unionByName(two).unionByName(three)


@query(
    "job2_evidence",
    rf"""WITH {INDEXED},
st AS (SELECT count(*) AS n, avg(len) AS avgdl FROM m WHERE NOT is_duplicate),
raw AS (SELECT term, ln(n - df + CAST(0.5 AS DOUBLE)) - ln(df + CAST(0.5 AS DOUBLE)) AS raw FROM df, st),
idf AS (SELECT term, CASE WHEN raw < 0 THEN CAST(0.25 AS DOUBLE) * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT item_id AS question_id, trim(text, ' ') AS q FROM benchmark),
q AS (SELECT question_id, term, count(*) AS times FROM (SELECT question_id, unnest(regexp_extract_all(lower(q), '[a-z0-9]+')) AS term FROM asked WHERE length(q) BETWEEN 1 AND 1000) GROUP BY 1, 2),
sc AS (SELECT question_id, doc_id, round(sum(times * idf * tf * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * len / avgdl))), 6) AS score FROM q JOIN tf USING (term) JOIN idf USING (term), st GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0),
b AS (SELECT question_id, rank AS marker, doc_id, score, coalesce(lang, 'unknown') AS lang, '[' || rank || '] (doc' || doc_id || '.txt' || CASE WHEN coalesce(source, '') = '' THEN '' ELSE ', section "' || source || '"' END || ')' || chr(10) || CASE WHEN length(text) <= 1400 THEN text
    WHEN regexp_extract(left(text, 1400), '(?s)^(.*[^ \t\n\r\f])[ \t\n\r\f]+[^ \t\n\r\f]+[ \t\n\r\f]*$', 1) <> '' THEN regexp_extract(left(text, 1400), '(?s)^(.*[^ \t\n\r\f])[ \t\n\r\f]+[^ \t\n\r\f]+[ \t\n\r\f]*$', 1) || '…' ELSE regexp_replace(left(text, 1400), '\s+$', '') || '…' END AS block
  FROM r JOIN documents USING (doc_id) WHERE rank <= 6),
p AS (SELECT * FROM (SELECT *, sum(length(block)) OVER (PARTITION BY question_id ORDER BY marker) AS running FROM b) WHERE running <= 9000),
s AS (SELECT question_id, count(*) AS passages, sum(length(block)) AS chars FROM p GROUP BY 1)
SELECT 'passage' AS kind, question_id, CAST(marker AS BIGINT) AS marker, doc_id, score, block, lang AS part, CAST(NULL AS BIGINT) AS chars FROM p
UNION ALL SELECT 'question', question_id, CAST(coalesce(passages, 0) AS BIGINT), NULL, NULL, NULL, CASE WHEN length(q) NOT BETWEEN 1 AND 1000 THEN 'refused' WHEN passages > 0 THEN 'evidence' ELSE 'no_evidence' END, CAST(coalesce(chars, 0) AS BIGINT) FROM asked LEFT JOIN s USING (question_id)""",
)
def job2_evidence(spark, d):
    """The items of ``benchmark`` as questions to all documents: passages and questions, one below the other."""
    index, out = _indexed(spark, d), _folder(spark, "job2")
    for _ in range(2):
        gather_evidence.run(spark, index, f"{d}/documents.parquet", f"{d}/benchmark.parquet", out)
    none = lambda kind: F.lit(None).cast(kind)
    passages = spark.read.schema(gather_evidence.PASSAGES).parquet(f"{out}/passages").select(F.lit("passage").alias("kind"), "question_id", "marker", "doc_id", "score", "block", F.col("lang").alias("part"), none("bigint").alias("chars"))
    questions = spark.read.schema(gather_evidence.QUESTIONS).parquet(f"{out}/questions")
    return passages.unionByName(questions.select(F.lit("question").alias("kind"), "question_id", F.col("passages").alias("marker"), none("bigint").alias("doc_id"), none("double").alias("score"), none("string").alias("block"), F.col("status").alias("part"), "chars"))
