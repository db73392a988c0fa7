"""Queries of ingestion: extraction, chunking, deduplication, ids, repositories, events and streams."""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.functions import text as t
from docweft.functions.segments import split_sentences
from docweft.operators import dedup, events
from docweft.plans.registry import query, table
from docweft.plans.search_queries import chunk_vectors
from docweft.sources import files, store

TEXT = "A first paragraph.\nOf two lines.\n\n  A second one.\n \t\n\n# no heading in plain text"
MARKDOWN = "# Tides\n\nTides rise and fall. Twice a day they do.\n\n## Causes\nThe moon pulls.\n\n# Uses\n\n##### Mills\n\nMills turn."


def small_docx() -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    para = lambda style, text: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    body = para("Title", "Of Bees") + para("Heading1", "Hives") + "<w:p><w:r><w:t>Bees live there.</w:t></w:r></w:p>" + para("Heading2", "Frames") + "<w:p><w:r><w:t>They hold combs.</w:t></w:r></w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def small_pdf() -> bytes:
    stream = b"BT /F1 24 Tf 72 700 Td (On Lamps) Tj ET BT /F1 11 Tf 72 650 Td (Lamps give light in the evening and the night.) Tj 0 -14 Td (Oil burns in them.) Tj ET"
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", b"<< /Length %d >>\nstream\n%s\nendstream" % (len(stream), stream)]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"%%EOF"


def uploads(spark):
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w") as z:
        for i in range(202):
            z.writestr(f"f{i}", "x")
    rows = [("up/a.txt", TEXT.encode()), ("up/b.md", MARKDOWN.encode()), ("up/c.docx", small_docx()), ("up/d.pdf", small_pdf()), ("up/e.docx", bomb.getvalue()), ("up/f.txt", b""), ("up/g.pdf", b"plain"), ("up/h.docx", b"PK\x03\x04broken")]
    return spark.createDataFrame(rows, "path string, content binary")


#: The documents' lines as paragraphs, and the same with every fourth line as a heading.
LINES = r"l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, p FROM (SELECT doc_id, regexp_replace(unnest(ls), '^\s+|\s+$', '', 'g') AS p, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE p <> '')"
HEADED = LINES + r", h AS (SELECT doc_id, i, i % 4 = 1 AS heading, CASE WHEN i % 4 = 1 THEN regexp_replace(left(p, 20), '\s+$', '') ELSE p END AS p FROM l)"
_PLACED = "CAST(coalesce(sum(length(p) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start"


def lines(spark, d):
    """(doc_id, lines): the trimmed lines of each document that are not empty."""
    trimmed = F.transform(F.split("text", "\n"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    return table(spark, d, "documents").select("doc_id", F.filter(trimmed, lambda p: p != "").alias("lines"))


def as_files(spark, d, markdown: bool):
    """A file of each document, with a blank line between its lines."""
    heading = lambda p, i: F.when(i % 4 == 0, F.concat(F.lit("## "), F.left(p, F.lit(20)))).otherwise(p)
    body = F.array_join(F.transform("lines", heading) if markdown else F.col("lines"), "\n\n")
    return lines(spark, d).select("doc_id", body.cast("binary").alias("content"), F.lit("md" if markdown else "txt").alias("file_type"))


def _blocks(spark, d, markdown: bool):
    found = files.extracted(as_files(spark, d, markdown), "doc_id")
    return found.select("doc_id", F.posexplode("blocks").alias("i", "b")).select("doc_id", (F.col("i") + 1).cast("long").alias("i"), "b.*")


@query("src_text", f"WITH {LINES} SELECT doc_id, i, p AS text, {_PLACED} FROM l")
def src_text(spark, d):
    return _blocks(spark, d, False).select("doc_id", "i", "text", "start")


_SECTIONS = "g AS (SELECT *, sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM h), s AS (SELECT *, first_value(p) OVER (PARTITION BY doc_id, n ORDER BY i) AS section FROM g)"


_PARTS = f"WITH {HEADED}, {_SECTIONS} SELECT doc_id, i, p AS text, section, CASE WHEN heading THEN 2 END AS heading FROM s"


@query("src_markdown", _PARTS)
def src_markdown(spark, d):
    return _blocks(spark, d, True).select("doc_id", "i", "text", "section", "heading")


def docx_of(lines: pd.Series) -> bytes:
    """A DOCX file of paragraphs, every fourth a heading of at most 20 characters."""
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{"Normal" if i % 4 else "Heading2"}"/></w:pPr><w:r><w:t xml:space="preserve">{escape(p if i % 4 else p[:20])}</w:t></w:r></w:p>' for i, p in enumerate(lines))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@F.pandas_udf(T.BinaryType())
def docx_files(lines: pd.Series) -> pd.Series:
    return lines.map(docx_of)


@query("src_docx", _PARTS)
def src_docx(spark, d):
    made = lines(spark, d).select("doc_id", docx_files("lines").alias("content"), F.lit("docx").alias("file_type"))
    found = files.extracted(made, "doc_id").select("doc_id", F.posexplode("blocks").alias("i", "b"))
    return found.select("doc_id", (F.col("i") + 1).cast("long").alias("i"), "b.text", "b.section", "b.heading")


def part_files(spark, d):
    """A PDF of each part: its name in large letters over a sentence about it."""
    told = F.concat(F.lit("This part is called "), "p_name", F.lit(" and of brand "), "p_brand", F.lit("."))
    shown = F.concat(F.lit("BT /F1 24 Tf 72 700 Td ("), "p_name", F.lit(") Tj ET BT /F1 11 Tf 72 650 Td ("), told, F.lit(") Tj ET"))
    body = F.concat(F.lit("%PDF-1.4\n1 0 obj << /Type /Page /Contents 2 0 R >> endobj\n2 0 obj << >>\nstream\n"), shown, F.lit("\nendstream\nendobj\n%%EOF"))
    parts = files.spread(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey")
    return parts.select("p_partkey", body.cast("binary").alias("content"), F.lit("pdf").alias("file_type"))


@query(
    "src_pdf",
    """SELECT p_partkey, p_name AS title, i, text, CAST(CASE WHEN i = 1 THEN 0 ELSE length(p_name) + 2 END AS INTEGER) AS start, CAST(CASE WHEN i = 1 THEN 0 ELSE length(p_name) + 2 END + length(text) AS INTEGER) AS "end", section, page, heading
FROM (SELECT p_partkey, p_name, CAST(i AS BIGINT) AS i, CASE WHEN i = 1 THEN p_name ELSE 'This part is called ' || p_name || ' and of brand ' || p_brand || '.' END AS text, p_name AS section, CAST(1 AS INTEGER) AS page, CASE WHEN i = 1 THEN CAST(1 AS INTEGER) END AS heading
FROM part, (VALUES (1), (2)) v(i))""",
)
def src_pdf(spark, d):
    found = files.extracted(part_files(spark, d), "p_partkey").select("p_partkey", "title", F.posexplode("blocks").alias("i", "b"))
    return found.select("p_partkey", "title", (F.col("i") + 1).cast("long").alias("i"), "b.text", "b.start", "b.end", "b.section", "b.page", "b.heading")


@query("src_dispatch", f"WITH {LINES} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'txt' ELSE 'md' END AS file_type, CAST(count(*) AS INTEGER) AS n_blocks, CAST(0 AS INTEGER) AS page_count FROM l GROUP BY doc_id UNION ALL SELECT p_partkey, 'pdf', CAST(2 AS INTEGER), CAST(1 AS INTEGER) FROM part")
def src_dispatch(spark, d):
    """Each file by the reader of its type: texts, Markdown, and PDF."""
    text = as_files(spark, d, False).filter("doc_id % 2 = 0").unionByName(as_files(spark, d, True).filter("doc_id % 2 = 1")).filter("length(content) > 0")
    found = files.extracted(text.unionByName(part_files(spark, d).withColumnRenamed("p_partkey", "doc_id")).withColumn("kind", F.struct("doc_id", "file_type")), "kind")
    return found.select("kind.doc_id", "kind.file_type", F.size("blocks").alias("n_blocks"), "page_count")


#: Uploads of the documents under four names; those that are blank, or hold something else than they claim, are refused.
@query("src_upload", "SELECT 'd' || doc_id || '.' || e AS filename, CASE WHEN e IN ('txt', 'md') AND text <> '' THEN e END AS file_type, CASE WHEN e = 'exe' THEN 'unsupported_type' WHEN text = '' THEN 'empty_file' WHEN e = 'pdf' THEN 'magic_mismatch' END AS error FROM (SELECT doc_id, coalesce(text, '') AS text, list_extract(['txt', 'md', 'pdf', 'exe'], CAST(doc_id % 4 + 1 AS BIGINT)) AS e FROM documents)")
def src_upload(spark, d):
    ext = F.element_at(F.array(*map(F.lit, ("txt", "md", "pdf", "exe"))), (F.col("doc_id") % 4 + 1).cast("int"))
    named = table(spark, d, "documents").select(F.concat(F.lit("up/d"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return files.validated_uploads(named).select("filename", "file_type", "error")


@query("verify_docx_zip", "SELECT doc_id, CASE doc_id % 2 WHEN 1 THEN 'unsupported_type' END AS error FROM documents")
def verify_docx_zip(spark, d):
    """DOCX files of the documents, every other one with its end cut off."""
    whole = lines(spark, d).select("doc_id", docx_files("lines").alias("content"))
    cut = whole.withColumn("content", F.when(F.col("doc_id") % 2 == 1, F.expr("substring(content, 1, length(content) - 30)")).otherwise(F.col("content")))
    return cut.select("doc_id", files.verify_zip("content").alias("error"))


@query("section_path", f"WITH {HEADED}, {_SECTIONS} SELECT doc_id, i, section FROM s")
def section_path(spark, d):
    return _blocks(spark, d, True).select("doc_id", "i", "section")


@query("doc_builder", f"WITH {HEADED}, {_SECTIONS} SELECT doc_id, i, {_PLACED}, CAST(length(p) AS INTEGER) AS size, section, CASE WHEN heading THEN 2 END AS heading FROM s")
def doc_builder(spark, d):
    return _blocks(spark, d, True).select("doc_id", "i", "start", (F.col("end") - F.col("start")).alias("size"), "section", "heading")


@query("chunk_sections", rf"WITH {HEADED}, {_SECTIONS} SELECT doc_id, CAST(n - 1 AS INTEGER) AS chunk_index, any_value(section) AS section, CAST(sum(len(regexp_extract_all(p, '[^ \t\n\r\f\v]+'))) AS INTEGER) AS token_count FROM s GROUP BY doc_id, n")
def chunk_sections(spark, d):
    """With room for any section, each is one chunk."""
    md = as_files(spark, d, True).select("doc_id", F.col("content").cast("string").alias("text"))
    return files.chunked(md, "doc_id", markdown=True, target=1 << 30, ratio=0.0).select("doc_id", "chunk_index", "section", "token_count")


def sentences_sql(source: str, keys: str) -> str:
    """SQL of ``s``: each word of ``source`` (keys, p) with its place and the number of its sentence."""
    return rf"""x AS (SELECT {keys}, unnest(regexp_extract_all(p, '\S+\s*')) AS x, generate_subscripts(regexp_extract_all(p, '\S+\s*'), 1) AS k FROM {source}),
y AS (SELECT *, regexp_replace(x, '\s+$', '') AS word, coalesce(sum(length(x)) OVER (PARTITION BY {keys} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM x),
z AS (SELECT *, regexp_extract(word, '[.!?]+$') AS stop, left(lead(word) OVER w, 1) AS next_, lag(word) OVER w AS before FROM y WINDOW w AS (PARTITION BY {keys} ORDER BY k)),
b AS (SELECT *, CASE WHEN length(stop) < length(word) THEN left(word, length(word) - length(stop)) ELSE coalesce(before, '') END AS stem FROM z),
e AS (SELECT *, stop <> '' AND next_ IS NOT NULL AND NOT (next_ = lower(next_) AND next_ <> upper(next_)) AND trim(lower(stem), '.') NOT IN ('e.g', 'i.e', 'etc', 'vs', 'cf', 'fig', 'eq', 'al', 'dr', 'mr', 'mrs', 'ms', 'prof', 'no')
  AND NOT (stop = '.' AND length(stem) = 1 AND stem = upper(stem) AND stem <> lower(stem)) AS ends FROM b),
s AS (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM e)"""


@query("chunk_units", f"WITH {LINES}, {sentences_sql('l', 'doc_id, i')} SELECT doc_id, CAST(i AS BIGINT) AS i, CAST(min(start) AS INTEGER) AS start, CAST(max(start + length(word)) AS INTEGER) AS \"end\" FROM s GROUP BY doc_id, i, n")
def chunk_units(spark, d):
    spread = lines(spark, d).select("doc_id", F.posexplode("lines").alias("i", "p"))
    return spread.select("doc_id", (F.col("i") + 1).cast("long").alias("i"), F.explode(split_sentences("p")).alias("s")).select("doc_id", "i", "s.start", "s.end")


@query("split_sentences", f"WITH {sentences_sql('(SELECT doc_id, text AS p FROM documents)', 'doc_id')}, c AS (SELECT doc_id, CAST(max(n) + 1 AS INTEGER) AS n FROM s GROUP BY 1) SELECT doc_id, coalesce(c.n, 0) AS n_sentences FROM documents LEFT JOIN c USING (doc_id)")
def sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(split_sentences("text")).alias("n_sentences"))


@query("chunk_pack")
def chunk_pack(spark, d):
    return files.chunked(table(spark, d, "documents"), "doc_id", target=200).drop("text")


#: Every document as its words, in runs of eight: without full stops each document is one unit that does not fit.
_RUNS = r"w AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[.!?]', ' ', 'g'), '[^ \t\n\r\f\v]+') AS ws FROM documents), n AS (SELECT doc_id, ws, unnest(range(0, (len(ws) + 7) // 8)) AS i FROM w)"


@query("chunk_oversized_words", f"WITH {_RUNS} SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(len(ws[8 * i + 1 : 8 * i + 8]) AS INTEGER) AS token_count, sha256(lower(array_to_string(ws[8 * i + 1 : 8 * i + 8], ' '))) AS content_hash FROM n")
def chunk_oversized_words(spark, d):
    plain = table(spark, d, "documents").select("doc_id", F.regexp_replace(F.regexp_replace("text", "[.!?]", " "), r"\s+", " ").alias("text"))
    return files.chunked(plain, "doc_id", target=8, ratio=0.0).select("doc_id", "chunk_index", "token_count", "content_hash")


@query("chunk_oversized")
def chunk_oversized(spark, d):
    return files.chunked(table(spark, d, "documents"), "doc_id", target=8, ratio=0.0).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max("token_count").alias("most"))


@query("chunk_overlap")
def chunk_overlap(spark, d):
    rows = files.chunked(table(spark, d, "documents"), "doc_id", target=100, ratio=0.25)
    last = F.lag("char_end").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    return rows.select("doc_id", "chunk_index", F.greatest(last - F.col("char_start"), F.lit(0)).alias("overlap"))


HASHED = r"h AS (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS content_hash FROM documents)"


def hashed(spark, d):
    return table(spark, d, "documents").select("doc_id", t.content_hash("text").alias("content_hash"))


@query("dedup_first_wins", f"WITH {HASHED} SELECT doc_id, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) > 1 AS is_duplicate FROM h")
def dedup_first_wins(spark, d):
    return dedup.exact_duplicates(hashed(spark, d), order="doc_id").select("doc_id", "is_duplicate")


@query("join_exact_dup", f"WITH {HASHED} SELECT doc_id, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) > 1 OR content_hash IN (SELECT content_hash FROM h WHERE doc_id < 300) AS is_duplicate FROM h WHERE doc_id >= 300")
def join_exact_dup(spark, d):
    h = hashed(spark, d)
    return dedup.exact_duplicates(h.filter("doc_id >= 300"), h.filter("doc_id < 300"), "doc_id").select("doc_id", "is_duplicate")


@query("content_hash_groups", f"WITH {HASHED} SELECT content_hash, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first FROM h GROUP BY 1 HAVING count(*) > 1")
def content_hash_groups(spark, d):
    return hashed(spark, d).groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


NEAR = "p AS (SELECT x.vec_id AS a, y.vec_id AS b, list_inner_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS sim FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id)"


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@query("join_near_dup", f"WITH {NEAR} SELECT a, b, round(sim, 6) AS sim FROM p WHERE sim > CAST(0.35 AS DOUBLE)")
def join_near_dup(spark, d):
    return dedup.similar_pairs(vectors(spark, d), 0.35).select("a", "b", F.round("sim", 6).alias("sim"))


@query("near_dup_onepass", f"WITH {NEAR} SELECT vec_id AS id, vec_id IN (SELECT b FROM p WHERE sim > CAST(0.35 AS DOUBLE)) AS is_near_dup FROM embeddings")
def near_dup_onepass(spark, d):
    return dedup.near_duplicates_onepass(vectors(spark, d), 0.35)


@query("near_dup_sequential", """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings),
p AS (SELECT x.n AS a, y.n AS b FROM v x JOIN v y ON x.n < y.n AND list_inner_product(x.e, y.e) > CAST(0.3 AS DOUBLE)),
e AS (SELECT b, list(a) AS near FROM p GROUP BY 1),
k AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept, false AS gone UNION ALL
  SELECT k.n + 1, CASE WHEN list_has_any(coalesce(e.near, []), k.kept) THEN k.kept ELSE list_append(k.kept, k.n + 1) END, list_has_any(coalesce(e.near, []), k.kept) FROM k LEFT JOIN e ON e.b = k.n + 1 WHERE k.n < (SELECT count(*) FROM v))
SELECT v.vec_id AS id, k.gone AS is_near_dup FROM k JOIN v USING (n)""")
def near_dup_sequential(spark, d):
    return dedup.near_duplicates(vectors(spark, d), 0.3)


@query("near_dup_known", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT DISTINCT x.vec_id AS id FROM v x JOIN v y ON x.vec_id % 2 = 1 AND y.vec_id % 2 = 0 AND list_inner_product(x.e, y.e) > CAST(0.35 AS DOUBLE)""")
def near_dup_known(spark, d):
    """Candidates against what is indexed: the odd vectors against the even ones."""
    v = vectors(spark, d)
    return dedup.near_known(v.filter("id % 2 = 1"), v.filter("id % 2 = 0"), 0.35)


@query("vector_id_alloc", "SELECT c_custkey, CAST((SELECT max(vec_id) FROM embeddings) + row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS vector_id FROM customer WHERE c_acctbal > 0")
def vector_id_alloc(spark, d):
    kept = table(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey")
    stored = table(spark, d, "embeddings").select(F.col("vec_id").alias("vector_id"))
    return dedup.vector_ids(kept, stored, "c_custkey").select("c_custkey", F.col("vector_id").cast("long").alias("vector_id"))


@query("agg_ingest_stats", f"WITH {LINES}, m AS (SELECT doc_id, row_number() OVER (PARTITION BY sha256(lower(p)) ORDER BY doc_id, i) > 1 AS dup FROM l), t AS (SELECT user_id, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1000 AS total_ms FROM events GROUP BY 1) SELECT doc_id, CAST(count(*) AS BIGINT) AS chunk_count, CAST(count(*) FILTER (NOT dup) AS BIGINT) AS indexed_count, CAST(count(*) FILTER (dup) AS BIGINT) AS duplicate_count, round(any_value(total_ms), 3) AS total_ms FROM m LEFT JOIN t ON user_id = doc_id GROUP BY 1")
def agg_ingest_stats(spark, d):
    rows = lines(spark, d).select("doc_id", F.posexplode("lines").alias("i", "p")).select("doc_id", F.struct("doc_id", "i").alias("chunk_id"), F.sha2(F.lower("p"), 256).alias("content_hash"))
    return dedup.ingest_stats(dedup.exact_duplicates(rows), log(spark, d)).withColumn("total_ms", F.round("total_ms", 3))


def brand_files(spark, d):
    """A PDF of each brand that names its parts, each in the font size of the part."""
    shown = F.concat(F.lit("BT /F1 "), F.col("p_size").cast("string"), F.lit(" Tf ("), "p_name", F.lit(") Tj ET"))
    stream = table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_list(shown)), "\n").alias("s"))
    body = F.concat(F.lit("%PDF-1.4\n1 0 obj << /Type /Page /Contents 2 0 R >> endobj\n2 0 obj << >>\nstream\n"), "s", F.lit("\nendstream\nendobj\n%%EOF"))
    return stream.select(F.col("p_brand").alias("path"), body.cast("binary").alias("content"))


@query("agg_font_census", "SELECT p_brand AS path, CAST(p_size AS DOUBLE) AS size, CAST(sum(length(p_name)) AS BIGINT) AS mass FROM part GROUP BY 1, 2")
def agg_font_census(spark, d):
    return files.font_masses(brand_files(spark, d))


@query("agg_max_vector_id", "SELECT coalesce(max(vec_id), -1) AS a, coalesce(max(vec_id) FILTER (vec_id < 0), -1) AS b FROM embeddings")
def agg_max_vector_id(spark, d):
    return table(spark, d, "embeddings").agg(F.coalesce(F.max("vec_id"), F.lit(-1)).alias("a"), F.coalesce(F.max(F.when(F.col("vec_id") < 0, F.col("vec_id"))), F.lit(-1)).alias("b"))


def _store(spark, d) -> store.VectorStore:
    v = chunk_vectors(spark, d)
    return store.VectorStore(v.select(F.col("chunk_id").alias("vector_id"), F.col("chunk_id").cast("string").alias("chunk_id"), "doc_id", "embedding"), 64)


@query("vec_health", "SELECT CAST(count(*) AS BIGINT) AS vectors, CAST(count(DISTINCT vec_id // 10) AS BIGINT) AS documents, max(vec_id) AS max_vector_id FROM embeddings")
def vec_health(spark, d):
    return _store(spark, d).health()


@query("vec_upsert", "SELECT vec_id AS vector_id, round(CASE WHEN vec_id % 5 = 0 THEN 2 * CAST(embedding[1] AS DOUBLE) ELSE CAST(embedding[1] AS DOUBLE) END, 6) AS x FROM embeddings")
def vec_upsert(spark, d):
    s = _store(spark, d)
    new = s.vectors.filter("vector_id % 5 = 0").withColumn("embedding", F.transform("embedding", lambda x: x * F.lit(2).cast("float")))
    return s.upsert(new).vectors.select("vector_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("x"))


@query("vec_reconstruct", "SELECT CAST(o.o_orderkey AS BIGINT) AS ordinal, e.vec_id IS NOT NULL AS known, round(CAST(e.embedding[1] AS DOUBLE), 6) AS x FROM orders o LEFT JOIN embeddings e ON e.vec_id = o.o_custkey")
def vec_reconstruct(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("ordinal"), F.col("o_custkey").alias("vector_id"))
    rows = _store(spark, d).reconstruct(ids)
    return rows.select("ordinal", F.col("embedding").isNotNull().alias("known"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("x"))


@query("vec_delete_doc", "SELECT vec_id AS vector_id FROM embeddings WHERE vec_id // 10 NOT IN (SELECT n_nationkey FROM nation)")
def vec_delete_doc(spark, d):
    gone = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("doc_id"))
    return _store(spark, d).delete_documents(gone).vectors.select("vector_id")


@query("join_cascade", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def join_cascade(spark, d):
    gone = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(gone, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("page", "SELECT o_orderkey, o_orderdate, CAST(n AS BIGINT) AS total FROM (SELECT *, count(*) OVER () AS n FROM orders WHERE o_orderstatus = 'O') ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def page(spark, d):
    found = table(spark, d, "orders").filter("o_orderstatus = 'O'")
    rows = found.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(100).limit(50)
    return rows.join(F.broadcast(found.agg(F.count("*").alias("total")))).select("o_orderkey", "o_orderdate", "total")


@query("agg_page_total", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS total FROM orders GROUP BY 1")
def page_total(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("total"))


@query("repo_latest", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def repo_latest(spark, d):
    return store.latest(table(spark, d, "orders"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("repo_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def repo_upsert(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return store.upserted(old, old.filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"])


@query("repo_get_many", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def repo_get_many(spark, d):
    wanted = table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, d, "supplier").join(wanted, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


def log(spark, d):
    return table(spark, d, "events").withColumnRenamed("user_id", "doc_id")


@query("agg_latest_event", "SELECT user_id AS doc_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def latest_event(spark, d):
    return events.latest_events(log(spark, d).select("doc_id", "event_id", "event_type"))


@query("stage_duration", "SELECT event_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id)) / CAST(1000 AS DOUBLE), 3) AS duration_ms FROM events")
def stage_duration(spark, d):
    return events.stage_durations(log(spark, d)).select("event_id", F.round("duration_ms", 3).alias("duration_ms"))


@query("replay_after", "SELECT event_id, event_type FROM events WHERE user_id = 5 AND event_id > 1000")
def replay_after(spark, d):
    return events.replay_after(log(spark, d), 5, 1000).select("event_id", "event_type")


@query("status_fanout", "SELECT user_id AS doc_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 3")
def status_fanout(spark, d):
    return events.fan_out(log(spark, d), 3).select("doc_id", "event_id")


@query("sse_replay_live", "SELECT DISTINCT event_id, event_type FROM events WHERE user_id = 5 AND event_id > 200")
def sse_replay_live(spark, d):
    one = log(spark, d).filter("doc_id = 5 AND event_id > 200").select("event_id", "event_type")
    return events.replay_then_live(one.filter("event_id < 5000"), one.filter("event_id > 3000"))


@query("graph_events", "SELECT * FROM (VALUES (0, 'graph_start'), (1, 'graph_progress'), (2, 'graph_progress'), (3, 'graph_progress'), (4, 'graph_done')) v(position, status)")
def graph_events(spark, d):
    from docweft.plans.graph_queries import _recomputed

    return _recomputed(spark, d).events.select("position", "status")


@query("restart_recovery", "SELECT user_id AS doc_id FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) NOT IN ('purchase', 'click')")
def restart_recovery(spark, d):
    from docweft.streaming.jobs import recovered

    e = log(spark, d)
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "click", "failed").otherwise(F.col("event_type"))
    return recovered(e.groupBy("doc_id").agg(F.min("ts").alias("created_at")), e.select("doc_id", "event_id", status.alias("status"))).select("doc_id")


@query("restart_wipe", "WITH last AS (SELECT user_id, arg_max(event_type, event_id) AS t FROM events GROUP BY 1) SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM last WHERE t NOT IN ('purchase', 'click'))")
def restart_wipe(spark, d):
    """Rows of documents that start again go first."""
    from docweft.streaming.jobs import wiped

    return wiped(table(spark, d, "orders").withColumnRenamed("o_custkey", "doc_id"), restart_recovery(spark, d)).select("o_orderkey")


@query("restart_mismatch", "SELECT s_suppkey AS doc_id FROM supplier WHERE s_acctbal > 0 AND (SELECT count(*) FROM part) <> (SELECT count(*) FROM customer)")
def restart_mismatch(spark, d):
    """Chunks with a vector id and vectors that are not as many: all done documents are reset."""
    from docweft.streaming.jobs import to_reset

    chunks, stored = table(spark, d, "part").select(F.col("p_partkey").alias("vector_id")), table(spark, d, "customer")
    docs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.when(F.col("s_acctbal") > 0, "done").otherwise("failed").alias("status"))
    return to_reset(chunks, stored, docs).select("doc_id")


@query("token_bucket", """WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) / CAST(1000000 AS DOUBLE) AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT user_id, n, event_id, s, CAST(6 AS DOUBLE) - 1 AS left_, true AS allowed, CAST(0 AS DOUBLE) AS retry_after FROM r WHERE n = 1 UNION ALL
  SELECT user_id, n, event_id, s, CASE WHEN have >= 1 - 1e-10 THEN have - 1 ELSE have END, have >= 1 - 1e-10, CASE WHEN have >= 1 - 1e-10 THEN 0 ELSE (1 - have) * 10 END
  FROM (SELECT r.user_id, r.n, r.event_id, r.s, least(6, f.left_ + greatest(0, r.s - f.s) / 10) AS have FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1))
SELECT user_id AS doc_id, event_id, allowed, round(retry_after, 3) AS retry_after FROM f""")
def token_bucket(spark, d):
    return events.rate_limited(log(spark, d), 6).withColumn("retry_after", F.round("retry_after", 3))


@query("repo_create", """WITH n AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey + 1000000 FROM orders WHERE o_orderstatus = 'F')
SELECT c_custkey, c_name FROM customer UNION ALL SELECT k, 'new' FROM n WHERE k NOT IN (SELECT c_custkey FROM customer)""")
def repo_create(spark, d):
    """Keys of orders, each as often as it has orders, most of them taken already, and the same keys moved out of reach."""
    old = table(spark, d, "customer").select("c_custkey", "c_name")
    new = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.explode(F.array(F.col("o_custkey"), F.col("o_custkey") + 1000000)).alias("c_custkey"), F.lit("new").alias("c_name"))
    return store.Keyed(old, "c_custkey").created(new)[0].rows


@query("repo_conflicts", "SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS turn FROM orders) WHERE turn > 1 OR o_custkey IN (SELECT c_custkey FROM customer)")
def repo_conflicts(spark, d):
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    old = table(spark, d, "customer").select("c_custkey", F.lit(0).cast("bigint").alias("o_orderkey"))
    return store.Keyed(old, "c_custkey").created(new)[1].select("o_orderkey")


@query("repo_update_status", "SELECT c_custkey, c_name, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'done' ELSE c_mktsegment END AS status FROM customer")
def repo_update_status(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("status"))
    changes = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.lit("done").alias("status"))
    return store.Keyed(rows, "c_custkey").updated(changes).rows


@query("repo_delete_by", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def repo_delete_by(spark, d):
    gone = table(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return store.Keyed(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_orderkey", "l_linenumber").deleted(gone, "l_suppkey").rows.drop("l_suppkey")


@query("events_append", "SELECT event_id, event_type FROM events UNION ALL SELECT (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY o_orderkey), 'queued' FROM orders")
def events_append(spark, d):
    log_ = table(spark, d, "events").select("event_id", "event_type")
    new = table(spark, d, "orders").select("o_orderkey", F.lit("queued").alias("event_type"))
    return store.appended(log_, new, "o_orderkey")


@query("repo_existing_hashes", "SELECT DISTINCT sha256(p_name) AS content_hash FROM part WHERE p_partkey % 3 = 0 AND sha256(p_name) IN (SELECT sha256(p_name) FROM part WHERE p_partkey % 3 = 1)")
def repo_existing_hashes(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.sha2("p_name", 256).alias("content_hash"))
    return rows.filter("p_partkey % 3 = 0").join(rows.filter("p_partkey % 3 = 1"), "content_hash", "left_semi").select("content_hash").distinct()


@query("sink_sql", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE 0 END AS c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def sink_sql(spark, d):
    """Insert, update and delete, each written as a version and read again; the newest one counts."""
    top = f"{store.work_dir(spark)}/docweft-sink-{uuid.uuid4().hex}"

    def write(rows) -> store.Keyed:
        store.commit({"customers": rows, "done": spark.range(1)}, top, store.claimed(spark, top), "done")
        return store.Keyed(spark.read.parquet(f"{top}/version={store.committed(spark, top, 'done')[-1]}/customers"), "c_custkey")

    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    now = write(rows.filter("c_custkey % 2 = 0"))
    now = write(now.created(rows)[0].rows)
    now = write(now.updated(rows.filter("c_custkey % 2 = 1").withColumn("c_acctbal", F.lit(0.0))).rows)
    return write(now.deleted(table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))).rows).rows


@query("chunks_assign_vector_ids", "SELECT p_partkey, CASE WHEN p_size > 25 THEN row_number() OVER (PARTITION BY p_size > 25 ORDER BY p_partkey) + (SELECT max(vec_id) FROM embeddings) END AS vector_id FROM part")
def assign_vector_ids(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_size", F.lit(None).cast("bigint").alias("vector_id"))
    stored = table(spark, d, "embeddings").select(F.col("vec_id").alias("vector_id"))
    ids = dedup.vector_ids(rows.filter("p_size > 25").select("p_partkey"), stored, "p_partkey").select("p_partkey", F.col("vector_id").cast("bigint").alias("vector_id"))
    return store.Keyed(rows, "p_partkey").updated(ids).rows.select("p_partkey", "vector_id")


@query("ingest_pipeline", r"""WITH c AS (SELECT doc_id, sha256(lower(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g'))) AS content_hash, len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) AS token_count FROM documents WHERE regexp_matches(text, '\S')),
d AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) > 1 AS is_duplicate FROM c)
SELECT doc_id, CAST(token_count AS INTEGER) AS token_count, content_hash, is_duplicate, CASE WHEN NOT is_duplicate THEN CAST(row_number() OVER (PARTITION BY is_duplicate ORDER BY doc_id) - 1 AS BIGINT) END AS vector_id FROM d""")
def ingest_pipeline(spark, d):
    """Chunking, exact duplicates, embedding and ids; near ones, which the embedder decides, are left in here and tested on their own."""
    from docweft.params import ChunkParams
    from docweft.streaming.jobs import default_embedder, indexed

    chunks = files.chunked(table(spark, d, "documents"), "doc_id", target=1 << 30, ratio=0.0).withColumn("chunk_id", F.col("doc_id"))
    return indexed(chunks, default_embedder, ChunkParams(near_dup_cosine=1.0)).select("doc_id", "token_count", "content_hash", "is_duplicate", "vector_id")


@query("ingest_job")
def ingest_job(spark, d):
    """The files below a folder through all stages of the job, as its tables show them."""
    from docweft.streaming.jobs import Tables, process

    top = f"{store.work_dir(spark)}/docweft-ingest-{uuid.uuid4().hex}"
    rows = uploads(spark).withColumns({"modificationTime": F.timestamp_seconds(F.lit(0)), "length": F.length("content").cast("long")})
    process(spark, rows, top, 0)
    return Tables(spark, top).documents().select("path", "status", "error", "chunk_count", "indexed_count", "duplicate_count")
