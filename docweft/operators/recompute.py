"""The graph recompute: from chunks and vectors to edges, analyses and their events, as one version of tables.

A run claims the next version number, reads what is there, writes ``edges`` and
``events`` and, last, ``analysis``: readers take the newest version that has it, so they
see a whole graph or the one before.  Of runs that overlap the one that started last
wins, as it has the higher number and saw at least as much.  ``recompute_serialised`` has
runs follow each other under a lease: triggers that come during a run make one more run.

Signals are only computed where an edge can come from.  With the weights w_s, w_e, w_t an
edge without a semantic score needs w_e entity + w_t topic >= threshold.  If topics alone
cannot carry it, its entity score is (threshold - w_t) / w_e at least; if they can and
entities cannot, its topic score is (threshold - w_e) / w_t; if either can, one of both is
threshold / (w_e + w_t).  Pairs with that or a semantic score above 0 are the candidates, and
the other signals, and the best chunk pairs as evidence, are computed for them.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions.scoring import topic_similarity
from docweft.operators import graph, topics
from docweft.operators.dedup import COSINE, chosen_pivots
from docweft.params import GraphParams, params_hash
from docweft.sources.lease import serialised
from docweft.sources.store import claimed, commit, committed, kept, scratch

TOPICS_SHOWN, ENTITIES_SHOWN, SHARED_SHOWN = 3, 10, 3
#: Candidates may miss their least score by rounding errors.
SLACK = 1e-7


def topic_vectors(distribution: DataFrame) -> DataFrame:
    """(doc_id, p): each document's weights in the order of the topics."""
    rows = distribution.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("topic", "weight"))).alias("l"))
    return rows.select("doc_id", F.transform("l", lambda x: x["weight"]).alias("p"))


def least_scores(p: GraphParams, topics: bool = True) -> tuple[float | None, float | None]:
    """The least entity and topic scores of which a pair without a semantic score has one if it is an edge; None: that signal needs no look."""
    if p.edge_threshold <= 0:
        raise ValueError("edge_threshold must be above 0")
    e, t = p.entity_weight, p.topic_weight if topics else 0.0
    if e + t < p.edge_threshold:
        return None, None
    if t < p.edge_threshold:
        return (p.edge_threshold - t) / e, None
    if e < p.edge_threshold:
        return None, (p.edge_threshold - e) / t
    return (p.edge_threshold / (e + t),) * 2


def scored_pairs(vectors: DataFrame, entities: DataFrame, n_docs: int | DataFrame, distribution: DataFrame | None, p: GraphParams) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three signals of every pair of documents that can reach the threshold (above 0: else every pair is an edge)."""
    semantic = graph.semantic_overlap(vectors, p, least=0.0)
    semantic = kept(semantic, "semantic")
    entity_least, topic_least = least_scores(p, topics=distribution is not None)
    pairs = semantic.select("a", "b")
    if entity_least is not None:
        pairs = pairs.union(graph.entity_scores(entities, n_docs, least=entity_least - SLACK).select("a", "b"))
    if topic_least is not None:
        pairs = pairs.union(graph.topic_pairs(distribution, max(0.0, topic_least - SLACK)).select("a", "b"))
    pairs = kept(pairs.distinct(), "candidates")
    semantic = semantic.unionByName(graph.semantic_of(vectors, pairs.join(semantic.select("a", "b"), ["a", "b"], "left_anti"), p))
    entity = graph.entity_overlap(entities, n_docs, pairs=pairs)
    if distribution is None:
        return semantic, entity, pairs.withColumn("score", F.lit(0.0))
    side = topic_vectors(distribution)
    topic = pairs.join(side.select(F.col("doc_id").alias("a"), "p"), "a").join(side.select(F.col("doc_id").alias("b"), F.col("p").alias("q")), "b")
    return semantic, entity, topic.select("a", "b", topic_similarity("p", "q").alias("score"))


#: Share of pairs of vectors above the floor from which on most pairs of documents are near enough.
DENSE = 0.05


def all_edges(vectors: DataFrame, entities: DataFrame, n_docs: int | DataFrame, distribution: DataFrame | None, p: GraphParams, chunks: DataFrame | None = None) -> DataFrame:
    """The edges by the way that fits the vectors, with the same result; with ``chunks`` (chunk_id, text), also their ``evidence``.

    Where cells keep few vectors apart - as the vectors that the similarity join would take for pivots show -
    blocks of documents meet and settle all signals at once; else candidates are looked for first.
    """
    least, topic_least = least_scores(p, topics=distribution is not None)
    sample = chosen_pivots(vectors.select(F.col("chunk_id").alias("id"), "embedding"))
    near = (COSINE.similarity(sample, sample) > p.semantic_floor)[np.triu_indices(len(sample), 1)]
    once = chunks is None or chunks.filter("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    if topic_least is None and once and len(near) and near.mean() >= DENSE:
        return graph.tiled_edges(vectors, entities, n_docs, None if distribution is None else topic_vectors(distribution), p, None if least is None else least - SLACK, chunks)
    found = graph.edges(*scored_pairs(vectors, entities, n_docs, distribution, p), p)
    return found if chunks is None else graph.with_evidence(found, chunks)


def analyses(documents: DataFrame, entities: DataFrame, n_docs: int | DataFrame, distribution: DataFrame | None, terms: list[list[str]], p: GraphParams) -> DataFrame:
    """(doc_id, dominant_topic, topics, entities, params_hash) of every document; topics have their terms."""
    named = graph.top_entities(entities, n_docs)
    out = documents.select("doc_id").distinct().join(named, "doc_id", "left")
    if distribution is not None:
        words = F.array(*(F.array(*map(F.lit, t)) for t in terms))
        one = F.struct("rank", F.col("topic"), "weight", F.get(words, F.col("topic")).alias("terms"))
        best = graph.top_topics(distribution, TOPICS_SHOWN).groupBy("doc_id").agg(F.sort_array(F.collect_list(one)).alias("topics"))
        out = out.join(graph.dominant_topics(distribution), "doc_id", "left").join(best, "doc_id", "left")
    else:
        out = out.withColumns({"dominant_topic": F.lit(None).cast("int"), "topics": F.lit(None).cast("array<struct<rank:int,topic:int,weight:double,terms:array<string>>>")})
    return out.select("doc_id", "dominant_topic", "topics", "entities", F.lit(params_hash(p)).alias("params_hash"), F.current_timestamp().alias("updated_at"))


def recompute(spark: SparkSession, chunks: DataFrame, vectors: DataFrame, top: str, p: GraphParams = GraphParams(), triggered_by: str | None = None, reason: str = "ingestion", check: Callable[[], None] | None = None) -> str:
    """Compute and commit the next version from ``chunks`` (doc_id, chunk_id, text) and ``vectors`` (doc_id, chunk_id, embedding).

    Chunks that are duplicates still count for a document's entities and topics; they have no
    vector and so no part in its semantic signal.  With a document that triggered the run,
    at most five events (start, three steps, done) are written for it.
    """
    with scratch(spark):
        return _recomputed(spark, chunks, vectors, top, p, triggered_by, reason, check)


def _recomputed(spark: SparkSession, chunks: DataFrame, vectors: DataFrame, top: str, p: GraphParams, triggered_by: str | None, reason: str, check: Callable[[], None] | None) -> str:
    version, events = claimed(spark, top), []
    began = last = time.time()

    def emit(status: str, **detail) -> None:
        nonlocal last
        now = time.time()
        events.append((len(events), triggered_by, status, str({"reason": reason, **detail}), round(1000 * (now - last), 3), now))
        last = now

    documents = kept(chunks.select("doc_id").distinct(), "documents")
    n = documents.count()
    emit("graph_start", documents=n)
    entities = kept(graph.mentions(chunks.select("doc_id", "text"), p), "entities")
    emit("graph_progress", step="entities")
    model, loadings = topics.fit(chunks.select("doc_id", "chunk_id", "text"), p)
    distribution = None if model is None else kept(graph.topic_distribution(loadings), "topics")
    emit("graph_progress", step="topics")
    edges = kept(all_edges(vectors, entities, n, distribution, p).withColumns({"params_hash": F.lit(params_hash(p)), "updated_at": F.current_timestamp()}), "edges")
    emit("graph_progress", step="scoring")
    found = analyses(documents, entities, n, distribution, model.terms() if model else [], p)
    emit("graph_done", edges=edges.count(), duration_ms=round(1000 * (time.time() - began), 3))
    log = spark.createDataFrame(events if triggered_by is not None else [], "position int, doc_id string, status string, detail string, duration_ms double, at double")
    commit({"edges": edges, "events": log, "analysis": found}, top, version, "analysis", check)
    return version


def recompute_serialised(spark: SparkSession, load: Callable[[], tuple[DataFrame, DataFrame]], top: str, p: GraphParams = GraphParams(), triggered_by: str | None = None, reason: str = "ingestion", ttl: float = 60.0) -> list[str]:
    """Versions computed here of what ``load()`` gives (chunks, vectors) when a run begins; none if the run under way will be followed by one that sees this trigger."""
    return serialised(spark, top, lambda check: recompute(spark, *load(), top, p, triggered_by, reason, check), ttl)


class Graph:
    """The newest committed version."""

    def __init__(self, spark: SparkSession, top: str):
        versions = committed(spark, top, "analysis")
        if not versions:
            raise ValueError(f"no graph has been computed below {top}")
        self.version = versions[-1]
        self.edges, self.analysis, self.events = (spark.read.parquet(f"{top}/version={self.version}/{name}") for name in ("edges", "analysis", "events"))

    def nodes(self, documents: DataFrame) -> DataFrame:
        """``documents`` with their analysis: dominant topic, three topics, ten entities."""
        return node_list(documents, self.analysis)

    def listed_edges(self) -> DataFrame:
        """All edges, best first, each with its three rarest shared entities."""
        return edge_list(self.edges)

    def meta(self, documents: DataFrame, p: GraphParams = GraphParams()) -> DataFrame:
        return graph_meta(self.edges, self.analysis, documents, p)


def node_list(documents: DataFrame, analysis: DataFrame) -> DataFrame:
    own = analysis.select("doc_id", "dominant_topic", "topics", F.slice("entities", 1, ENTITIES_SHOWN).alias("entities"))
    return documents.join(own, "doc_id", "left")


def edge_list(edges: DataFrame) -> DataFrame:
    return edges.withColumn("shared_entities", F.slice("shared_entities", 1, SHARED_SHOWN)).orderBy(F.desc("combined_score"), "source", "target")


def graph_meta(edges: DataFrame, analysis: DataFrame, documents: DataFrame, p: GraphParams) -> DataFrame:
    """One row: counts, the time of the last update, whether the graph is stale, and the weights in force.

    A graph is stale if an analysis has other parameters or no document, or a document no analysis.
    """
    present = documents.select("doc_id").distinct().withColumn("_present", F.lit(True))
    both = analysis.select("doc_id", "params_hash", "updated_at").withColumn("_analysed", F.lit(True)).join(present, "doc_id", "full")
    bad = F.col("_analysed").isNull() | F.col("_present").isNull() | (F.col("params_hash") != params_hash(p))
    state = both.agg(F.count("_present").alias("documents"), F.max("updated_at").alias("updated_at"), F.coalesce(F.bool_or(bad), F.lit(False)).alias("stale"))
    counted = edges.agg(F.count("*").alias("edges"))
    return state.join(F.broadcast(counted)).withColumns({"semantic_weight": F.lit(p.semantic_weight), "entity_weight": F.lit(p.entity_weight), "topic_weight": F.lit(p.topic_weight), "edge_threshold": F.lit(p.edge_threshold)})
