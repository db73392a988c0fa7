import numpy as np
import pytest
from pyspark.sql import functions as F

from docweft.operators import graph, tiles
from docweft.plans import registry

registry.load_all()


def plain(docs, n_docs):
    """(score, shared) of each pair, entity by entity."""
    df = {}
    for own in docs.values():
        for e in own:
            df[e] = df.get(e, 0) + 1
    idf = {e: np.log1p(n_docs / k) for e, k in df.items()}
    out = {}
    for a in docs:
        for b in docs:
            both = docs[a].keys() & docs[b].keys()
            if a < b and both:
                w = sum(idf[e] for e in both)
                listed = sorted(both, key=lambda e: (-round(idf[e], 4), e))
                out[a, b] = (w / (sum(idf[e] for e in docs[a]) + sum(idf[e] for e in docs[b]) - w), [(e, docs[a][e], docs[b][e]) for e in listed])
    return out


@pytest.mark.parametrize("kind,cells,probe", [("long", 1 << 21, 8), ("string", 64, 8), ("long", 300, 0), ("string", 50, 0)])
def test_many_blocks_give_what_pairs_give(spark, monkeypatch, kind, cells, probe):
    """Blocks, parts of tiles and both ways to meet lose nothing; counts follow their documents."""
    for name, value in (("ENTRIES", 90), ("CELLS", cells), ("PROBE", probe)):
        monkeypatch.setattr(tiles, name, value)
    rng = np.random.default_rng(cells)
    name = int if kind == "long" else "d{}".format
    docs = {name(d): {f"e{int(k)}": int(rng.integers(1, 9)) for k in rng.zipf(1.3, 14) % 60} for d in range(45)}
    rows = [(d, e, "ORG", c) for d, own in docs.items() for e, c in own.items()]
    e = spark.createDataFrame(rows, f"doc_id {kind}, text string, label string, count long")
    want = plain(docs, 50)
    key = lambda df: {(r.a, r.b): (round(r.score, 9), [(s.text, s.count_a, s.count_b) for s in r.shared]) for r in df.collect()}
    short = lambda pairs: {k: (round(want[k][0], 9), want[k][1][:3]) for k in pairs}
    if probe:
        assert key(graph.entity_overlap(e, 50, most=3)) == short(want)
        assert {(r.a, r.b): r.n for r in graph.entity_scores(e, 50).collect()} == {k: len(v[1]) for k, v in want.items()}
    assert key(graph.entity_overlap(e, 50, most=3, least=0.3)) == short(k for k, v in want.items() if v[0] >= 0.3)
    asked = sorted(k for i, k in enumerate(want) if i % 3 == 0)
    pairs = spark.createDataFrame([*asked, (name(998), name(999))], f"a {kind}, b {kind}")
    assert key(graph.entity_overlap(e, 50, most=3, pairs=pairs)) == short(asked)


@pytest.mark.parametrize("kind,listed,size", [("long", 1 << 19, 1 << 28), ("string", 60, 1 << 28), ("long", 200, 40)])
def test_lists_of_all_pairs_are_put_together_where_blocks_meet(spark, monkeypatch, kind, listed, size):
    """The texts that structs would give, whatever the parts and the arrays they are in; no list of structs leaves a task."""
    for name, value in (("ENTRIES", 90), ("LISTED", listed), ("BYTES", size)):
        monkeypatch.setattr(tiles, name, value)
    rng = np.random.default_rng(listed)
    name = int if kind == "long" else "d{}".format
    docs = {name(d): {f"é{int(k)}": int(rng.integers(1, 120)) for k in rng.zipf(1.3, 14) % 60} for d in range(45)}
    rows = [(d, e, "ORG", c) for d, own in docs.items() for e, c in own.items()]
    e = spark.createDataFrame(rows, f"doc_id {kind}, text string, label string, count long")
    want = {k: ",".join(f"{t}:{x}:{y}" for t, x, y in v[1][:3]) for k, v in plain(docs, 50).items()}
    found = graph.entity_lists(e, 50, most=3)
    got = [(r.a, r.b, r.shared) for r in found.collect()]
    assert len(got) == len(want) and {(a, b): s for a, b, s in got} == want
    assert found.columns == ["a", "b", "shared"] and graph.entity_lists(e.limit(0), 50).count() == 0
    # the queries give what leaves the tasks: no row is rebuilt after it
    plan = registry.QUERIES["join_entities"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("MapInArrow")


def test_mentions_are_whole_words(spark):
    """Only runs of letters, digits and hyphens that begin with a capital count, and each as a whole."""
    texts = ["aBCD Abc-d9 x-Yzzz 9Abc A-b AB Abc,Abc ABC\nAbc", "éAbc -Abc The AbcÉ A--", None, ""]
    got = {(r.doc_id, r.text): r["count"] for r in graph.mentions(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {(0, "abc-d9"): 1, (0, "a-b"): 1, (0, "abc"): 4, (1, "abc"): 2, (1, "the"): 1, (1, "a--"): 1}


def test_no_entities(spark):
    none = spark.createDataFrame([], "doc_id long, text string, label string, count long")
    assert graph.entity_overlap(none, 3).count() == 0 and graph.entity_scores(none, 3, least=0.5).count() == 0


def test_pairs_that_share_make_no_rows_of_the_shuffle(spark):
    """Entities that all documents have: the plan joins blocks, not entities, so nothing grows with the pairs before the result."""
    e = spark.createDataFrame([(d, f"e{k}", "ORG", 1) for d in range(30) for k in range(5)], "doc_id long, text string, label string, count long")
    found = graph.entity_overlap(e, 30)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan.split("MapInArrow")[0] and found.count() == 435


def test_equal_products_go_by_chunk_whatever_the_blocks(spark):
    """Documents of different sizes in many blocks: the best pairs of each two, ties by the chunk of the smaller document first."""
    rng = np.random.default_rng(4)
    rows = [(d, 10 * d + c, np.eye(4)[rng.integers(4)].tolist()) for d in range(23) for c in range(1 + d % 4)]
    v = spark.createDataFrame(rows, "doc_id long, chunk_id long, embedding array<double>")
    want = {}
    for a in range(23):
        for b in range(a + 1, 23):
            met = [(-float(np.dot(x, y)), ca, cb) for da, ca, x in rows if da == a for db, cb, y in rows if db == b]
            want[a, b] = [(ca, cb, -s) for s, ca, cb in sorted(met)[:3]]
    key = lambda df: {(r.a, r.b): [(q.a, q.b, q.sim) for q in r.l] for r in df.collect()}
    assert key(tiles.chunk_pairs(v, 3, 7)) == want
    asked = sorted(want)[::5]
    found = tiles.chunk_pairs(v, 3, 7, spark.createDataFrame([*asked, (5, 99)], "a long, b long"))
    assert key(found) == {k: want[k] for k in asked}
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_all_topic_pairs(spark):
    """Every pair once, in many blocks, with and without mass, as the column scores them."""
    from pyspark.sql import functions as F

    from docweft.functions.scoring import topic_similarity

    x = np.random.default_rng(3).dirichlet(np.full(4, 0.5), 30)
    x[7], x[9], x[11] = 0, x[8] * 3, [1, 0, 0, 0]
    rows = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)], "doc_id long, p array<double>")
    found = graph.all_topic_pairs(rows, 8)
    assert "NestedLoop" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 435
    both = found.join(rows.withColumnRenamed("doc_id", "a"), "a").join(rows.select(F.col("doc_id").alias("b"), F.col("p").alias("q")), "b")
    assert both.filter(F.abs(F.col("score") - topic_similarity("p", "q")) > 1e-6).count() == 0
    assert found.filter("a < b").select("a", "b").distinct().count() == 435


@pytest.mark.parametrize("name", ["edge_view", "build_edge_prompt", "edges_whole", "template_render", "cache_key"])
def test_the_graph_is_computed_once(spark, name):
    """What follows a whole graph reads its stored edges: no signal is in the plan of the view."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Relation" in plan


def test_ids_that_meet_all_others_are_dealt_over_tasks(spark):
    found = registry.QUERIES["join_docpairs"](spark, "/root/testdata/sf0.01")
    parts = found.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) > 50 and sum(r["count"] for r in parts) == 100 * 99 // 2


def test_the_first_edge_needs_no_other(spark, tmp_path):
    """The evidence of one edge reads the vectors of its two documents; others, however odd, take no part."""
    near = [(1, [1.0, 0.0]), (12, [0.6, 0.8]), (14, [1.0, 0.0]), (25, [1.0])]
    rows = [(v, [float(x) for x in e]) for v, e in near]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = registry.QUERIES["join_edge_evidence"](spark, str(tmp_path)).collect()
    assert sorted((r.position, r.similarity, r.text_a, r.text_b) for r in found) == [(0, 1.0, "doc 1", "doc 14"), (1, 0.6, "doc 1", "doc 12")]


def test_edges_are_settled_where_blocks_meet(spark, monkeypatch):
    """All signals in one meeting of two blocks give the edges that tables of pairs give, and no row of a pair is shuffled."""
    from docweft.operators import recompute
    from docweft.params import GraphParams

    monkeypatch.setattr(tiles, "LEAST_ENTRIES", 10)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(60, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(int(np.sqrt(i) * 3), i, y.tolist()) for i, y in enumerate(x)], "doc_id long, chunk_id long, embedding array<double>")
    e = spark.createDataFrame([(d, f"e{k}", "ORG", int(k) + 1) for d in range(8, 40) for k in ({int(j) for j in rng.integers(0, 12, 5)} if d < 36 else range(5))], "doc_id long, text string, label string, count long")
    w = rng.dirichlet([0.3] * 4, 30)
    w[5] = 0
    dist = spark.createDataFrame([(d, t, float(w[d, t])) for d in range(30) for t in range(4)], "doc_id long, topic int, weight double")
    key = lambda edges: {(r.source, r.target): (r.semantic_score, r.entity_score, r.topic_score, r.combined_score, r.dominant_signal, r.top_pairs, r.shared_entities) for r in edges.collect()}
    for threshold, topics in ((0.3, dist), (0.3, None), (0.45, dist)):
        p = GraphParams(semantic_floor=0.0, semantic_ceil=0.9, top_k_pairs=3, edge_threshold=threshold)
        found = recompute.all_edges(v, e, 40, topics, p)
        plan = found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")
        assert len(plan) == 2 and "Join" not in plan[0] and "Aggregate" not in plan[0]
        want = key(graph.edges(*recompute.scored_pairs(v, e, 40, topics, p), p))
        assert key(found) == want and len(want) > 20
        assert any(r[5] is None for r in want.values()) == (threshold == 0.3)  # entities alone carry an edge of 0.3


def test_blocks_that_share_nothing_never_meet(spark, monkeypatch):
    """Groups of documents with entities of their own, as copies of a table have: pairs of blocks grow with the groups, not with their square."""
    for name, value in (("ENTRIES", 20), ("SLICE", 8)):
        monkeypatch.setattr(tiles, name, value)
    rng = np.random.default_rng(2)
    docs = {10 * g + i: {f"g{g}e{k}": 1 for k in {int(k) for k in rng.integers(0, 6, 5)}} for g in range(12) for i in range(6)}
    rows = [(d, e, "ORG", c) for d, own in docs.items() for e, c in own.items()]
    e = spark.createDataFrame(rows, "doc_id long, text string, label string, count long")
    _, blocks, n, asked = tiles._dealt(graph.numbered(e, 80), False)
    assert blocks.count() > tiles.MANY_BLOCKS and asked.count() < n * (n + 1) / 4 and blocks.columns == ["block", "data"]
    got = {(r.a, r.b): (round(r.score, 9), r.n) for r in graph.entity_scores(e, 80).collect()}
    assert got == {k: (round(s, 9), len(shared)) for k, (s, shared) in plain(docs, 80).items()}
    numbers = [r.text for r in graph.numbered(e, 80).select("entity", "text").distinct().orderBy("entity").collect()]
    df = {t: sum(t in own for own in docs.values()) for t in numbers}
    assert numbers == sorted(numbers, key=lambda t: (-round(float(np.log1p(80 / df[t])), 4), t)) and len(set(numbers)) == len(df)


def test_evidence_comes_from_the_blocks(spark, monkeypatch):
    """Texts that travel with the vectors of their blocks give the evidence that joins of the stored edges give; chunks without a row drop out."""
    from docweft.operators import recompute
    from docweft.params import GraphParams

    monkeypatch.setattr(tiles, "EDGES", 7)
    rng = np.random.default_rng(5)
    x = np.abs(rng.normal(size=(50, 6)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i // 2 if i < 36 else i, i, y.tolist()) for i, y in enumerate(x)], "doc_id long, chunk_id long, embedding array<double>")
    e = spark.createDataFrame([(d, f"e{k}", "ORG", 1) for d in range(60) for k in ((d % 9, d % 4) if d < 30 else range(4))], "doc_id long, text string, label string, count long")
    chunks = spark.createDataFrame([(i, None if i % 11 == 0 else f"text {i}") for i in range(48) if i % 5], "chunk_id long, text string")
    p = GraphParams(semantic_floor=0.0, semantic_ceil=0.9, top_k_pairs=3, edge_threshold=0.29)
    found = recompute.all_edges(v, e, 60, None, p, chunks)
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")
    assert len(plan) == 2 and "Join" not in plan[0] and "Aggregate" not in plan[0]
    want = graph.with_evidence(graph.edges(*recompute.scored_pairs(v, e, 60, None, p), p), chunks)
    key = lambda edges: {(r.source, r.target): (r.combined_score, r.top_pairs, r.shared_entities, r.evidence) for r in edges.select(*want.columns).collect()}
    got = key(found)
    assert got == key(want) and any(r[1] is None for r in got.values())  # pairs without vectors are edges, too
    assert {len(r[3] or []) for r in got.values()} >= {0, 1, 2, 3} and any(s.text_a is None for r in got.values() for s in r[3] or [])
    assert max(a for a, _ in got) > 50  # and so are those of which neither has a vector
    again = recompute.all_edges(v, e, 60, None, p, chunks.union(chunks.filter("chunk_id = 7")))
    assert {k: len(r[3] or []) for k, r in key(again).items() if r[1]} != {k: len(r[3] or []) for k, r in got.items() if r[1]}  # a repeated chunk counts as often as it is there


def test_ids_of_many_rows_meet_once_in_steps(spark, monkeypatch):
    """Pairs of repeated ids: of two blocks each once, whatever the steps."""
    from docweft.operators import dedup

    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = [int(i) for i in rng.integers(0, 14, 60)]
    v = spark.createDataFrame([(d, y.tolist()) for d, y in zip(own, x)], "id long, embedding array<double>")
    want = {(min(own[i], own[j]), max(own[i], own[j])) for i in range(60) for j in range(i) if x[i] @ x[j] > 0.8}
    for cells in (1 << 22, 60, 150):
        monkeypatch.setattr(dedup, "CELLS", cells)
        got = [(r.a, r.b) for r in dedup.similar_pairs(v, 0.8, 1 << 14, once=True).collect()]
        assert set(got) == want and len(got) == len(set(got))


def test_pairs_above_a_score_are_found_either_way(spark, monkeypatch):
    """Where looking for near vectors first is no help, blocks meet once, and no pair below the score leaves a task."""
    from docweft.params import GraphParams

    rng = np.random.default_rng(10)
    x = rng.normal(size=(90, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i // 4, i, y.tolist()) for i, y in enumerate(x)], "doc_id long, chunk_id long, embedding array<double>")
    p = GraphParams(semantic_floor=0.0, semantic_ceil=0.9, top_k_pairs=3)
    key = lambda df: {(r.a, r.b): (round(r.raw, 9), r.pairs) for r in df.collect()}
    want = key(graph.semantic_overlap(v, p, 16).filter("score > 0.6"))
    straight = graph.semantic_overlap(v, p, 16, least=0.6)
    assert "Aggregate" not in straight._jdf.queryExecution().optimizedPlan().toString() and key(straight) == want and 20 < len(want) < 250
    monkeypatch.setattr(graph, "DENSE", 2.0)
    assert key(graph.semantic_overlap(v, p, 16, least=0.6)) == want
