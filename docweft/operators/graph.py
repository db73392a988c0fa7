"""The document connection graph: three pair signals, edges with evidence, and views of nodes and edges.

Every signal is a table of unordered pairs (a < b).  Pairs of the entity signal come
from sparse products of blocks and so exist only where something is shared; the semantic signal
multiplies blocks of vectors and keeps the k best chunk pairs of each document pair.  Both
take the least score that matters, and then give only the pairs that reach it; so does
the topic signal, by cells of distributions that a metric keeps apart.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions.scoring import calibrate, combine, dominant_signal, topic_similarity
from docweft.functions.text import entity_kept, normalize_entity
from docweft.operators import tiles
from docweft.operators.dedup import CLOSENESS, COSINE, chosen_pivots, similar_pairs, vector_ids
from docweft.operators.tiles import chunk_pairs, entity_pairs, signal_pairs, vector_pairs
from docweft.params import GraphParams
from docweft.sources.store import kept

#: Vectors of a block: each block is shipped to all that it meets, so large ones keep the shuffle small.
BLOCK_ROWS = 1 << 15


def mentions(docs: DataFrame, p: GraphParams = GraphParams()) -> DataFrame:
    """(doc_id, text, label, count) by the built-in extractor: capitalised words of three and more characters are ORG."""
    words = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z](?<![A-Za-z0-9-][A-Z])[A-Za-z0-9-]{2,}"), F.lit(0))).alias("w"))
    named = words.select("doc_id", normalize_entity("w").alias("text"), F.lit("ORG").alias("label"))
    return named.filter(entity_kept("text", "label", p.entity_labels, p.min_entity_len)).groupBy("doc_id", "text", "label").agg(F.count("*").alias("count"))


def entity_idf(entities: DataFrame, n_docs: int | DataFrame) -> DataFrame:
    """(text, label, df, idf) with idf = ln(1 + N / df); N counts documents without entities, too."""
    df = entities.groupBy("text", "label").agg(F.count("*").alias("df"))
    n = F.lit(n_docs) if isinstance(n_docs, int) else None
    df = df.withColumn("n", n) if n is not None else df.join(F.broadcast(n_docs.agg(F.count("*").alias("n"))))
    return df.select("text", "label", "df", F.log1p(F.col("n") / F.col("df")).alias("idf"))


def with_idf(entities: DataFrame, n_docs: int | DataFrame) -> DataFrame:
    return entities.join(entity_idf(entities, n_docs).select("text", "label", "idf"), ["text", "label"])


def entity_numbers(entities: DataFrame, n_docs: int | DataFrame) -> DataFrame:
    """(text, label, idf, entity) of stored ``entities``: numbers from 0 in the order in which entities are listed, rarest by the rounded idf first, then by text and label."""
    found = kept(entity_idf(entities, n_docs).select("text", "label", "idf", F.struct((-F.round("idf", 4)).alias("k"), "text", "label").alias("place")), "idf")
    ranked = vector_ids(found, entities.sparkSession.createDataFrame([], "vector_id bigint"), "place")
    return ranked.select("text", "label", "idf", F.col("vector_id").cast("long").alias("entity"))


def numbered(entities: DataFrame, n_docs: int | DataFrame) -> DataFrame:
    """``entities`` with ``idf`` and the number ``entity``; they are stored, as they are read twice."""
    entities = kept(entities, "mentions")
    return entities.join(entity_numbers(entities, n_docs), ["text", "label"])


def entity_scores(entities: DataFrame, n_docs: int | DataFrame, least: float = 0.0, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b, score, n): idf-weighted Jaccard and number of shared entities of pairs that share one.

    With ``least``, only of pairs with that score: they meet on their rarest entities, never
    on those that most documents have.  With ``pairs`` (a < b), only of those.
    """
    return entity_pairs(numbered(entities, n_docs), least, pairs)


def entity_overlap(entities: DataFrame, n_docs: int | DataFrame, most: int = 25, least: float = 0.0, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b, score, shared): as ``entity_scores``, with the rarest shared entities."""
    return entity_pairs(numbered(entities, n_docs), least, pairs, most)


def entity_lists(entities: DataFrame, n_docs: int | DataFrame, most: int = 25) -> DataFrame:
    """(a, b, shared): the rarest shared entities of all pairs that share one, as text:count_a:count_b with commas."""
    return tiles.entity_lists(numbered(entities, n_docs), most)


def top_entities(entities: DataFrame, n_docs: int | DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, entities): rarest first, by the rounded idf, then text and label."""
    one = F.struct((-F.round("idf", 4)).alias("k"), "text", "label", F.round("idf", 4).alias("idf"), "count")
    rows = with_idf(entities, n_docs).groupBy("doc_id").agg(F.sort_array(F.collect_list(one)).alias("l"))
    picked = F.slice("l", 1, most) if most else F.col("l")
    return rows.select("doc_id", F.transform(picked, lambda s: F.struct(s["text"].alias("text"), s["label"].alias("label"), s["idf"].alias("idf"), s["count"].alias("count"))).alias("entities"))


def semantic_overlap(vectors: DataFrame, p: GraphParams = GraphParams(), rows: int = BLOCK_ROWS, least: float | None = None) -> DataFrame:
    """(a, b, raw, score, pairs): the calibrated mean of the k largest cosines of each document pair, by matrix products of blocks.

    All vectors of a document are in one block, so a pair of documents is settled in the task
    where its two blocks meet.  A document larger than ``rows`` vectors makes a block of its own size.
    With ``least``, only pairs with a larger score are given.  Such a pair has two chunks whose
    cosine is above that score's raw value, so the pairs that have come from a similarity join
    over cells of vectors (``dedup.similar_pairs``), and only they are computed.  If so many pairs of
    documents would come that way that it is no help, all blocks meet, and a task gives what it finds above.
    """
    if least is None:
        return _overlaps(chunk_pairs(vectors, p.top_k_pairs, rows), p)
    above = p.semantic_floor + least * (p.semantic_ceil - p.semantic_floor)
    if _near_share(vectors, above) >= DENSE:
        found = _overlaps(chunk_pairs(vectors, p.top_k_pairs, rows, above=above), p)
    else:
        met = similar_pairs(vectors.select(F.col("doc_id").alias("id"), "embedding"), above, rows, once=True).filter("a <> b").distinct()
        found = semantic_of(vectors, met, p, rows)
    return found.filter(F.col("score") > least)


#: Share of pairs of documents with near vectors from which on it is no help to look for them first.
DENSE = 0.05


def _near_share(vectors: DataFrame, above: float) -> float:
    """The share of pairs of documents of which two vectors are above a cosine, as the vectors that the similarity join would take for pivots show it."""
    sample = chosen_pivots(vectors.select(F.col("chunk_id").alias("id"), "embedding"))
    near = (COSINE.similarity(sample, sample) > above)[np.triu_indices(len(sample), 1)]
    size = vectors.agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("docs")).first()
    return float(1 - (1 - near.mean()) ** ((size.rows / size.docs) ** 2)) if len(near) else 0.0


def semantic_of(vectors: DataFrame, pairs: DataFrame, p: GraphParams = GraphParams(), rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, raw, score, pairs) of the given pairs (a < b) of documents, by the vectors of each two; pairs without vectors drop out."""
    return _overlaps(chunk_pairs(vectors, p.top_k_pairs, rows, pairs), p)


def _overlaps(best: DataFrame, p: GraphParams, *more: str) -> DataFrame:
    """(a, b, raw, score, pairs) of pairs of documents with their best chunk pairs in order."""
    raw = F.aggregate("l", F.lit(0.0), lambda t, x: t + x["sim"]) / F.size("l")
    listed = F.transform("l", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.round(x["sim"], 4).alias("sim")))
    means = best.select("a", "b", raw.alias("raw"), listed.alias("pairs"), *more)
    return means.select("a", "b", "raw", F.when(F.col("raw").isNotNull(), calibrate("raw", p.semantic_floor, p.semantic_ceil)).alias("score"), "pairs", *more)


def topic_pairs(distribution: DataFrame, least: float, rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, score) of the pairs whose topic similarity is above ``least`` (0 or more).

    The root of the divergence is a metric, so the pairs come from the similarity join over cells of
    distributions.  A document without mass is similar to none; a topic that a document has no row
    for weighs 0 there, and repeated rows of a topic add up.
    """
    if least < 0:
        raise ValueError("least must not be negative")
    weights = distribution.filter("doc_id IS NOT NULL AND topic IS NOT NULL AND weight > 0").groupBy("doc_id", "topic").agg(F.sum("weight").alias("weight"))
    n = weights.agg(F.max("topic")).first()[0]
    lists = weights.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("topic").cast("int"), "weight"))).alias("m"), F.sum("weight").alias("mass"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(int(n or 0))), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)) / F.col("mass"))
    found = similar_pairs(lists.select(F.col("doc_id").alias("id"), dense.alias("embedding")), least, rows, CLOSENESS)
    return found.select("a", "b", F.col("sim").alias("score"))


def _shares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The closeness of rows of weights as they are; one without mass is similar to none."""
    mass = [m.sum(axis=1, keepdims=True) for m in (x, y)]
    sim = CLOSENESS.similarity(*(np.divide(m, t, out=np.zeros_like(m), where=t > 0) for m, t in zip((x, y), mass, strict=True)))
    return np.where((mass[0] > 0) & (mass[1].T > 0), np.clip(sim, 0.0, 1.0), 0.0)


def all_topic_pairs(vectors: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, score) of all pairs (a < b) of ``vectors`` (doc_id, p), weights in the order of the same topics: by tiles, as every pair is a row of the result."""
    return vector_pairs(vectors.select(F.col("doc_id").alias("id"), F.col("p").alias("embedding")), _shares, rows)


def _rowwise(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The topic similarity of the rows of two matrices, row by row; one without mass is similar to none."""
    mass = [m.sum(axis=1, keepdims=True) for m in (x, y)]
    p, q = (np.divide(m, t, out=np.zeros_like(m), where=t > 0) for m, t in zip((x, y), mass, strict=True))
    middle, js = (p + q) / 2, np.zeros(len(x))
    for side in (p, q):
        js += (side * np.log2(np.divide(side, middle, out=np.ones_like(middle), where=side > 0))).sum(axis=1)
    known = (mass[0][:, 0] > 0) & (mass[1][:, 0] > 0)
    return np.where(known, np.clip(1 - np.sqrt(np.maximum(js / 2, 0)), 0.0, 1.0), 0.0)


def tiled_edges(vectors: DataFrame, entities: DataFrame, n_docs: int | DataFrame, topics: DataFrame | None, p: GraphParams, least: float | None, chunks: DataFrame | None = None) -> DataFrame:
    """The edges, with all signals settled where two blocks of documents meet: for graphs in which most pairs of documents with vectors are near enough.

    ``topics`` (doc_id, p) are weights in the order of the same topics; ``least`` is the entity score that an edge without a semantic one needs.
    With ``chunks`` (chunk_id, text), each once, blocks carry their texts, and edges have ``evidence`` as ``with_evidence`` gives it.
    Only documents with vectors are in these blocks.  Pairs of others have no semantic score: those that entities carry are found by that
    least score (``_bare_edges``).
    """
    more = []
    entities = kept(entities, "mentions")
    numbers = kept(entity_numbers(entities, n_docs), "numbers")
    owners = kept(vectors.filter("doc_id IS NOT NULL").select("doc_id").distinct(), "owners")
    mine = lambda rows: rows.join(owners, "doc_id", "left_semi")
    if chunks is not None:
        vectors, more = vectors.join(chunks.select("chunk_id", "text", F.lit(True).alias("known")), "chunk_id", "left"), ["evidence"]
    weights = p.semantic_weight, p.entity_weight, p.topic_weight
    found = signal_pairs(vectors, mine(entities).join(numbers, ["text", "label"]), None if topics is None else mine(topics), p.top_k_pairs, 25, p.semantic_floor, p.semantic_ceil, weights, p.edge_threshold, least, _rowwise, p.top_k_pairs if more else None)
    own = _overlaps(found, p, "entity_score", "shared", "topic_score", *more)
    if more:
        own = own.withColumn("evidence", F.transform("evidence", lambda x: F.struct(F.round(x["similarity"], 4).alias("similarity"), x["text_a"].alias("text_a"), x["text_b"].alias("text_b"))))
    settled = scored_edges(own.select("a", "b", F.coalesce("score", F.lit(0.0)).alias("semantic_score"), "entity_score", "topic_score", F.col("pairs").alias("top_pairs"), F.col("shared").alias("shared_entities"), *more), p, *more)
    if least is None:
        return settled
    bare = _bare_edges(entities.join(numbers, ["text", "label"]), owners, topics, p, least)
    return settled.union(bare.select(*(F.col(c) if c in bare.columns else F.lit(None).cast(settled.schema[c].dataType).alias(c) for c in settled.columns)))


def _bare_edges(weighted: DataFrame, owners: DataFrame, topics: DataFrame | None, p: GraphParams, least: float) -> DataFrame:
    """The edges of pairs of which not both documents are among ``owners`` of vectors, stored: their entity score is ``least`` or more."""
    found = entity_pairs(weighted, least, most=25)
    for end in ("a", "b"):
        found = found.join(owners.select(F.col("doc_id").alias(end), F.lit(True).alias(f"has_{end}")), end, "left")
    rows = kept(found.filter("has_a IS NULL OR has_b IS NULL"), "bare")
    score = F.lit(0.0)
    if topics is not None:
        for end, name in (("a", "p"), ("b", "q")):
            rows = rows.join(topics.select(F.col("doc_id").alias(end), F.col("p").alias(name)), end, "left")
        score = F.coalesce(topic_similarity("p", "q"), F.lit(0.0))
    pairs = rows.select("a", "b", F.lit(0.0).alias("semantic_score"), F.col("score").alias("entity_score"), score.alias("topic_score"), F.lit(None).cast("string").alias("top_pairs"), F.col("shared").alias("shared_entities"))
    return kept(scored_edges(pairs, p).drop("top_pairs"), "bare")


def edges(semantic: DataFrame, entity: DataFrame, topic: DataFrame, p: GraphParams = GraphParams()) -> DataFrame:
    """Edges (source < target) at or above the threshold, judged before scores are rounded; a missing signal counts 0."""
    s = semantic.select("a", "b", F.col("score").alias("semantic_score"), F.col("pairs").alias("top_pairs"))
    e = entity.select("a", "b", F.col("score").alias("entity_score"), F.col("shared").alias("shared_entities"))
    t = topic.select("a", "b", F.col("score").alias("topic_score"))
    zero = {c: 0.0 for c in ("semantic_score", "entity_score", "topic_score")}
    return scored_edges(s.join(e, ["a", "b"], "full").join(t, ["a", "b"], "full").fillna(zero), p)


def scored_edges(pairs: DataFrame, p: GraphParams = GraphParams(), *more: str) -> DataFrame:
    """The edges of a table of pairs (a, b) that has all three scores and the evidence, with the columns ``more``."""
    reached = pairs.withColumn("combined_score", combine("semantic_score", "entity_score", "topic_score", p)).filter(F.col("combined_score") >= p.edge_threshold)
    signals = ("semantic_score", "entity_score", "topic_score")
    return reached.select(F.col("a").alias("source"), F.col("b").alias("target"), *(F.round(c, 6).alias(c) for c in (*signals, "combined_score")), dominant_signal(*signals, p).alias("dominant_signal"), "top_pairs", "shared_entities", *more)


def canonical(source: str, target: str, *evidence: tuple[str, str]) -> list[Column]:
    """Columns for an edge with its ends in order, and each pair of evidence columns turned with them."""
    flip = F.col(source) > F.col(target)
    out = [F.least(source, target).alias(source), F.greatest(source, target).alias(target)]
    for a, b in evidence:
        out += [F.when(flip, F.col(b)).otherwise(F.col(a)).alias(a), F.when(flip, F.col(a)).otherwise(F.col(b)).alias(b)]
    return out


def edge_between(table: DataFrame, x: int, y: int) -> DataFrame:
    """One edge, whichever end is named first."""
    return table.filter((F.col("source") == min(x, y)) & (F.col("target") == max(x, y)))


def edge_evidence(edge: DataFrame, chunks: DataFrame, *keys: str) -> DataFrame:
    """(keys, position, text_a, text_b, similarity) of the top pairs of an edge, or of all by their keys; a pair with a missing chunk drops out."""
    pairs = edge.select(*keys, F.posexplode("top_pairs").alias("position", "p")).select(*keys, "position", "p.a", "p.b", F.col("p.sim").alias("similarity"))
    text = chunks.select("chunk_id", "text")
    a, b = text.withColumnsRenamed({"chunk_id": "a", "text": "text_a"}), text.withColumnsRenamed({"chunk_id": "b", "text": "text_b"})
    return pairs.join(a, "a").join(b, "b").select(*keys, "position", "text_a", "text_b", "similarity")


def with_evidence(edges_: DataFrame, chunks: DataFrame) -> DataFrame:
    """All edges and ``evidence``, the texts and similarities of their top pairs in order; null without any.

    The edges are written once, as they are read twice here: they may be a whole graph that is yet to be computed.
    """
    edges_ = kept(edges_, "edges")
    rows = edge_evidence(edges_, chunks, "source", "target")
    lists = rows.groupBy("source", "target").agg(F.sort_array(F.collect_list(F.struct("position", "similarity", "text_a", "text_b"))).alias("l"))  # top_k_pairs a list
    found = lists.select("source", "target", F.transform("l", lambda x: F.struct(x["similarity"].alias("similarity"), x["text_a"].alias("text_a"), x["text_b"].alias("text_b"))).alias("evidence"))
    return edges_.join(found, ["source", "target"], "left")


def without_documents(table: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges of which neither end is among ``gone`` (doc_id)."""
    one = table.join(gone.select(F.col("doc_id").alias("source")), "source", "left_anti")
    return one.join(gone.select(F.col("doc_id").alias("target")), "target", "left_anti").select(*table.columns)


def incident(table: DataFrame, node: int) -> DataFrame:
    """A node's edges with the opposite node, best first."""
    own = table.filter((F.col("source") == node) | (F.col("target") == node))
    return own.withColumn("opposite", F.when(F.col("source") == node, F.col("target")).otherwise(F.col("source"))).orderBy(F.desc("combined_score"), "opposite")


def relevance(hits: DataFrame, documents: DataFrame, p: GraphParams = GraphParams()) -> DataFrame:
    """(doc_id, relevance, match_count) of all documents for a query's nearest chunks (doc_id, score); unknown owners are ignored."""
    c = calibrate("score", p.semantic_floor, p.semantic_ceil)
    per = hits.withColumn("c", c).groupBy("doc_id").agg(F.max("c").alias("relevance"), F.sum(F.when(F.col("c") >= p.query_relevance_threshold, 1).otherwise(0)).alias("match_count"))
    joined = documents.select("doc_id").join(per, "doc_id", "left")
    return joined.select("doc_id", F.round(F.coalesce("relevance", F.lit(0.0)), 4).alias("relevance"), F.coalesce("match_count", F.lit(0)).cast("long").alias("match_count"))


def lit_edges(table: DataFrame, lit: DataFrame) -> DataFrame:
    """Edges with both ends among ``lit`` (doc_id)."""
    one = table.join(lit.select(F.col("doc_id").alias("source")), "source", "left_semi")
    return one.join(lit.select(F.col("doc_id").alias("target")), "target", "left_semi")


def stale(documents: DataFrame, analysis: DataFrame, params_hash: str) -> DataFrame:
    """Documents without an analysis of the present parameters."""
    return documents.join(analysis.filter(F.col("params_hash") == params_hash), "doc_id", "left_anti")


def topic_distribution(loadings: DataFrame) -> DataFrame:
    """(doc_id, topic, weight): mean loading over a document's chunks, scaled to sum 1; a zero document stays zero."""
    mean = loadings.groupBy("doc_id", "topic").agg(F.avg("loading").alias("mean"))
    total = F.sum("mean").over(Window.partitionBy("doc_id"))
    return mean.select("doc_id", "topic", F.when(total > 0, F.col("mean") / total).otherwise(F.lit(0.0)).alias("weight"))


def dominant_topics(distribution: DataFrame) -> DataFrame:
    """(doc_id, dominant_topic): the largest weight, the lowest topic of equals, null without mass."""
    best = distribution.groupBy("doc_id").agg(F.max(F.struct("weight", (-F.col("topic")).alias("t"))).alias("m"))
    return best.select("doc_id", F.when(F.col("m.weight") > 0, -F.col("m.t")).alias("dominant_topic"))


def top_topics(distribution: DataFrame, most: int = 3) -> DataFrame:
    """(doc_id, topic, weight, rank): the largest weights above 0, the highest topic of equals first."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("weight"), F.desc("topic"))
    ranked = distribution.filter("weight > 0").withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= most).select("doc_id", "topic", F.round("weight", 4).alias("weight"), "rank")
