"""Queries of what clients compute for display."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweft.functions import scoring as s
from docweft.functions import text as t
from docweft.functions.citations import marked
from docweft.operators import graph, retrieval
from docweft.plans.graph_queries import DIST, EDGES, ENT, RAW, distribution, edge_table, entities, raw_edges
from docweft.plans.search_queries import QUERY, corpus
from docweft.plans.registry import query, table


@query("size_tier", "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 's' WHEN o_totalprice < 250000 THEN 'm' WHEN o_totalprice < 1000000 THEN 'l' ELSE 'xl' END AS tier FROM orders")
def size_tier(spark, d):
    return table(spark, d, "orders").select("o_orderkey", s.size_tier("o_totalprice").alias("tier"))


@query("stroke_width", f"WITH {EDGES} SELECT source, target, round(1 + 4 * combined_score, 6) AS width FROM edges")
def stroke_width(spark, d):
    return edge_table(spark, d).select("source", "target", F.round(s.stroke_width("combined_score"), 6).alias("width"))


@query("signal_contrib", f"WITH {RAW} SELECT k, round(CAST(0.5 AS DOUBLE) * semantic, 6) AS s, round(CAST(0.3 AS DOUBLE) * entity, 6) AS e, round(CAST(0.2 AS DOUBLE) * topic, 6) AS t FROM raw")
def signal_contrib(spark, d):
    parts = s.contributions("semantic", "entity", "topic")
    return raw_edges(spark, d).select("k", *(F.round(c, 6).alias(n) for c, n in zip(parts, "set", strict=True)))


COMBINED = "(CAST(0.5 AS DOUBLE) * semantic + CAST(0.3 AS DOUBLE) * entity + CAST(0.2 AS DOUBLE) * topic)"


@query("contribution_pct", f"WITH {RAW} SELECT k, round(CAST(0.5 AS DOUBLE) * semantic / CASE WHEN {COMBINED} = 0 THEN 1 ELSE {COMBINED} END, 6) AS share FROM raw")
def contribution_pct(spark, d):
    part = s.contributions("semantic", "entity", "topic")[0]
    return raw_edges(spark, d).select("k", F.round(s.contribution_share(part, "semantic", "entity", "topic"), 6).alias("share"))


@query("topic_slot", "SELECT e.event_id, CAST(CASE WHEN event_id % 10 = 0 THEN -1 ELSE user_id % 8 END AS INTEGER) AS slot FROM events e")
def topic_slot(spark, d):
    topic = F.when(F.col("event_id") % 10 != 0, F.col("user_id"))
    return table(spark, d, "events").select("event_id", s.topic_slot(topic).alias("slot"))


@query("topic_legend", "SELECT CAST(user_id % 8 AS BIGINT) AS slot, min(user_id) AS first FROM events GROUP BY 1")
def topic_legend(spark, d):
    return table(spark, d, "events").groupBy(s.topic_slot("user_id").cast("long").alias("slot")).agg(F.min("user_id").alias("first"))


@query("link_params", f"WITH {EDGES} SELECT source, target, round(240 - 140 * combined_score, 6) AS distance, round(CAST(0.2 AS DOUBLE) + CAST(0.6 AS DOUBLE) * combined_score, 6) AS strength FROM edges")
def link_params(spark, d):
    return edge_table(spark, d).select("source", "target", F.round(s.link_distance("combined_score"), 6).alias("distance"), F.round(s.link_strength("combined_score"), 6).alias("strength"))


@query("seed_position", """SELECT s_suppkey, round(cos((s_suppkey / greatest(n, 1)) * 2 * pi()) * r, 3) + 0 AS x, round(sin((s_suppkey / greatest(n, 1)) * 2 * pi()) * r * CAST(0.72 AS DOUBLE), 3) + 0 AS y
FROM (SELECT s_suppkey, n, 180 + n * 14 + (s_suppkey * 7919) % 61 - 30 AS r FROM supplier, (SELECT count(*) AS n FROM supplier))""")
def seed_position(spark, d):
    sup = table(spark, d, "supplier")
    x, y = s.seed_position("s_suppkey", "n")
    return sup.join(F.broadcast(sup.agg(F.count("*").alias("n")))).select("s_suppkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("canonical_pair", f"WITH {RAW} SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM raw")
def canonical_pair(spark, d):
    return raw_edges(spark, d).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def corpus_key_of(ids):
    """A short order-free key of an array of ids: a running hash times 33 over their sorted text, modulo 2**32, in base 36."""
    text = F.array_join(F.array_sort(ids), "|")
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    hashed = F.aggregate(codes, F.lit(5381).cast("bigint"), lambda h, c: F.pmod(h * 33 + c, F.lit(1 << 32)))
    return F.lower(F.conv(hashed.cast("string"), 10, 36))


@query("corpus_key", """WITH RECURSIVE t AS (SELECT string_agg(CAST(n_nationkey AS VARCHAR), '|' ORDER BY CAST(n_nationkey AS VARCHAR)) AS s FROM nation),
h AS (SELECT 0 AS i, CAST(5381 AS HUGEINT) AS h UNION ALL SELECT i + 1, (h * 33 + ord(s[i + 1])) % 4294967296 FROM h, t WHERE i < length(s)),
b AS (SELECT h AS n, '' AS k FROM h WHERE i = (SELECT length(s) FROM t) UNION ALL SELECT n // 36, '0123456789abcdefghijklmnopqrstuvwxyz'[CAST(n % 36 AS BIGINT) + 1] || k FROM b WHERE n > 0) SELECT k AS key FROM b WHERE n = 0""")
def corpus_key(spark, d):
    # a key of the nodes that one screen shows: a bounded set
    return table(spark, d, "nation").agg(F.collect_list(F.col("n_nationkey").cast("string")).alias("ids")).select(corpus_key_of(F.col("ids")).alias("key"))


_NAMED = f"""{ENT}, r AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY round(idf, 4) DESC, text) AS r FROM ent JOIN idf USING (text, label)),
named AS (SELECT doc_id, string_agg(text, ', ' ORDER BY r) AS names FROM r WHERE r <= 3 GROUP BY 1)"""


@query("node_summary", f"""WITH {_NAMED} SELECT d.doc_id, 'A ' || CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars / 1024.0 >= 10 THEN CAST(floor(n_chars / 1024.0 + 0.5) AS BIGINT) || ' KB' ELSE printf('%.1f', floor(CAST(n_chars AS DOUBLE) / 1024 * 10 + 0.5) / 10) || ' KB' END
  || ' TXT split into ' || n || ' chunk' || CASE WHEN n = 1 THEN '' ELSE 's' END || '. Mostly about ' || lang || ', ' || source || '.' || coalesce(' Mentions ' || names || '.', '') AS summary
FROM (SELECT *, len(string_split(text, chr(10))) AS n FROM documents) d LEFT JOIN named ON named.doc_id = d.doc_id""")
def node_summary(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("size_bytes"), F.lit("txt").alias("file_type"), F.size(F.split("text", "\n")).alias("chunk_count"), F.array("lang", "source").alias("terms"))
    named = graph.top_entities(entities(spark, d), table(spark, d, "documents"), 3)
    return docs.join(named, "doc_id", "left").select("doc_id", t.node_summary("size_bytes", "file_type", "chunk_count", "terms", F.transform("entities", lambda e: e["text"])).alias("summary"))


MARKED = ["apache", "license", "apache license", "trash"]


@query("evidence_marks", r"""WITH p AS (SELECT doc_id, unnest(ps) AS text, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '(?i)apache license|apache|license|trash', chr(57344) || '\0' || chr(57344), 'g'), chr(57344)) AS ps FROM documents) WHERE len(ps) > 1)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS position, text, i % 2 = 0 AS marked FROM p WHERE text <> ''""")
def evidence_marks(spark, d):
    found = table(spark, d, "documents").select("doc_id", marked("text", MARKED).alias("marks")).filter(F.exists("marks", lambda m: m["marked"]))
    return found.select("doc_id", F.posexplode("marks").alias("position", "m")).select("doc_id", "position", "m.*")


@query("hit_segments")
def hit_segments(spark, d):
    docs = corpus(spark, d).select("chunk_id", "text", retrieval.term_highlights(QUERY, "text").alias("spans"))
    # where no term is marked, the best sentence by terms is, or else the one nearest to the query
    sentence = retrieval.best_sentence(QUERY, retrieval.hashed_embedding(QUERY))
    docs = docs.withColumn("sentence", sentence(F.when(F.size("spans") == 0, F.col("text"))))
    return docs.select("chunk_id", F.posexplode(retrieval.hit_segments("text", "spans", "sentence")).alias("position", "s")).select("chunk_id", "position", "s.*")


@query("topic_rank", "SELECT user_id AS doc_id, CAST(topic AS BIGINT) AS topic, CAST(row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, topic DESC) AS BIGINT) AS r FROM (WITH " + DIST + " SELECT * FROM dist) WHERE weight > 0 QUALIFY r <= 3")
def topic_rank(spark, d):
    return graph.top_topics(distribution(spark, d), 3).select("doc_id", "topic", F.col("rank").cast("long").alias("r"))
