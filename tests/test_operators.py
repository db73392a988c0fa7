import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweft.functions import scoring, text
from docweft.operators import answers, dedup, graph, recompute, retrieval, topics
from docweft.params import AskParams, ChunkParams, GraphParams, SearchParams, checked_query, params_hash
from docweft.sources import store


def ranking(spark, items):
    rows = [(c, s, i + 1) for i, (c, s) in enumerate(items)]
    return spark.createDataFrame(rows, "chunk_id string, score double, rank int")


@pytest.mark.parametrize(
    ("dense", "sparse", "k", "w", "want"),
    [
        ([("a", 0.9)], [("a", 7.5)], 60, 0.5, [("a", 0.5 / 61 + 0.5 / 61)]),
        ([("a", 0.9), ("b", 0.8)], [("b", 5.0)], 60, 0.6, [("b", 0.6 / 62 + 0.4 / 61), ("a", 0.6 / 61)]),
        ([("d", 0.7)], [("s", 3.0)], 10, 0.5, [("d", 0.5 / 11), ("s", 0.5 / 11)]),
        ([("z", 1.0), ("a", 0.9)], [("a", 2.0), ("z", 1.0)], 60, 0.5, [("a", 0.5 / 61 + 0.5 / 62), ("z", 0.5 / 61 + 0.5 / 62)]),
        ([("a", 3.0), ("b", 2.0)], [("b", 1.0)], 60, 1.0, [("a", 1 / 61), ("b", 1 / 62)]),
        ([], [], 60, 0.5, []),
    ],
)
def test_rrf(spark, dense, sparse, k, w, want):
    got = retrieval.rrf(ranking(spark, dense), ranking(spark, sparse), k, w).collect()
    assert [r.chunk_id for r in got] == [c for c, _ in want]
    assert all(math.isclose(r.fused_score, s) for r, (_, s) in zip(got, want))


def test_bm25_against_plain_python(spark, tmp_path):
    corpus = {1: "the owl slept", 2: "the fox sat in snow", 3: "a heron", 4: "the owl and the owl"}
    query = "owl owl heron zebra"
    docs = {i: t.split() for i, t in corpus.items()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    vocabulary = {t for d in docs.values() for t in d}
    df = {t: sum(t in d for d in docs.values()) for t in vocabulary}
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in raw.items()}
    want = {i: sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in query.split()) for i, d in docs.items()}
    table = spark.createDataFrame(list(corpus.items()), "chunk_id long, text string")
    top = f"file://{tmp_path}/index"
    retrieval.SparseIndex.build(table.limit(1), top)
    index = retrieval.SparseIndex.build(table, top)
    got = {r.chunk_id: r.score for r in retrieval.SparseIndex.open(spark, top).search(query).collect()}
    assert index.search("zebra").count() == 0 == index.search("...").count()
    assert got.keys() == {i for i, s in want.items() if s > 0} and all(math.isclose(got[i], want[i]) for i in got)


def test_dense_and_filters(spark, tmp_path):
    v = spark.createDataFrame([(i, i // 2, [float(i == j) for j in range(4)]) for i in range(4)], "chunk_id long, doc_id long, embedding array<float>")
    q = [0.1, 0.9, 0.3, 0.0]
    assert [r.chunk_id for r in retrieval.cosine_topk(v, q, 2).collect()] == [1, 2]
    assert [r.chunk_id for r in retrieval.cosine_topk(v, q, 2, F.col("doc_id") == 1).collect()] == [2, 3]
    assert [r.chunk_id for r in retrieval.cosine_topk_overfetch(v, q, 1, F.col("doc_id") == 1, 2).collect()] == [2]
    many = retrieval.cosine_topk_many(v, np.array([q, [0, 0, 0, 1.0]]), 1).collect()
    assert {(r.query_id, r.chunk_id) for r in many} == {(0, 1), (1, 3)}
    chunks = v.withColumn("text", F.lit("some words"))
    index = retrieval.SparseIndex.build(chunks, f"file://{tmp_path}/index")
    assert len(retrieval.hybrid_search(index, chunks, "words", q, SearchParams(return_n=3)).collect()) == 3


def test_highlights(spark):
    df = spark.createDataFrame([("The lighthouse by the bay. The Bay road, bays.",), (None,), ("nothing here",), ("ok. But a bay",)], "text string")
    both = df.select("text", retrieval.term_highlights("lighthouse bay a", "text").alias("h"), retrieval.best_sentence("bay road")("text").alias("s"))
    rows = both.collect()
    assert [(s.start, s.end) for s in rows[0].h] == [(4, 14), (22, 25), (31, 34)] and rows[1].h == [] == rows[2].h
    assert (rows[0].s.start, rows[0].s.end) == (27, 46) and rows[2].s.start is None
    shown = [[tuple(x) for x in r.g] for r in both.select(retrieval.hit_segments("text", "h", "s").alias("g")).collect() if r.g is not None]
    assert shown[0] == [("The ", "plain"), ("lighthouse", "term"), (" by the ", "plain"), ("bay", "term"), (". The ", "plain"), ("Bay", "term"), (" road, bays.", "plain")]
    assert [("nothing here", "plain")] in shown
    odd = spark.createDataFrame([("élan lan LAN-lan _lan_ 😀lan " + "lan " * 30,), ("",)], "text string")
    spans = odd.select(retrieval.term_highlights("lan", "text").alias("h"), retrieval.term_highlights("lan", "text", most=3).alias("few"), retrieval.term_highlights("a ?", "text").alias("none")).collect()
    assert [(s.start, s.end) for s in spans[0].h][:5] == [(5, 8), (9, 12), (13, 16), (24, 27), (28, 31)] and len(spans[0].h) == 20
    assert spans[0].few == spans[0].h[:3] and spans[0].none == [] == spans[1].h
    one = both.withColumn("h", F.slice("h", 1, 0)).filter("text LIKE 'The%'").select(retrieval.hit_segments("text", "h", "s").alias("g")).first().g
    assert [tuple(x) for x in one] == [("The lighthouse by the bay. ", "plain"), ("The Bay road, bays.", "sentence")]


def plain_overlap(rows, k, floor, ceil):
    """(a, b) -> (raw, score, pairs) by every pair of vectors."""
    out = {}
    for i, (da, ca, x) in enumerate(rows):
        for db, cb, y in rows:
            if da < db:
                out.setdefault((da, db), []).append((-float(np.dot(x, y)), ca, cb))
    best = {key: sorted(found)[:k] for key, found in out.items()}
    raw = {key: -sum(s for s, *_ in found) / len(found) for key, found in best.items()}
    return {key: (raw[key], min(1, max(0, (raw[key] - floor) / (ceil - floor))), [(a, b) for _, a, b in best[key]]) for key in best}


CASES = [(2, 0, 1, [[1, 0, 0, 0], [0, 1, 0, 0]], [[1, 0, 0, 0]], 0.5, 0.5), (10, 0, 1, [[1, 0, 0, 0]], [[1, 0, 0, 0]], 1, 1), (1, 0.5, 0.95, [[1, 0, 0, 0]], [[0, 1, 0, 0]], 0, 0), (1, 0.5, 0.95, [[1, 0, 0, 0]], [[0.5**0.5, 0.5**0.5, 0, 0]], 0.5**0.5, (0.5**0.5 - 0.5) / 0.45)]


@pytest.mark.parametrize(("k", "floor", "ceil", "a", "b", "raw", "score"), CASES)
def test_semantic_overlap(spark, k, floor, ceil, a, b, raw, score):
    rows = [(1, i, x) for i, x in enumerate(a)] + [(2, 10 + i, x) for i, x in enumerate(b)]
    v = spark.createDataFrame([(d, c, [float(y) for y in x]) for d, c, x in rows], "doc_id long, chunk_id long, embedding array<double>")
    r = graph.semantic_overlap(v, GraphParams(top_k_pairs=k, semantic_floor=floor, semantic_ceil=ceil)).collect()[0]
    assert math.isclose(r.raw, raw, abs_tol=1e-9) and math.isclose(r.score, score, abs_tol=1e-9) and r.pairs[0].a == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_blocks_give_what_all_pairs_give(spark, kind):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    name = int if kind == "long" else "{:03d}".format
    rows = [(name(i // 3), name(i), y) for i, y in enumerate(x)]
    v = spark.createDataFrame([(d, c, y.tolist()) for d, c, y in rows], f"doc_id {kind}, chunk_id {kind}, embedding array<double>")
    p = GraphParams(top_k_pairs=4, semantic_floor=0.0)
    want = plain_overlap(rows, 4, 0.0, 0.95)
    got = {(r.a, r.b): r for r in graph.semantic_overlap(v, p, rows=10).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(r.raw, want[key][0], abs_tol=1e-9) and [(q.a, q.b) for q in r.pairs] == want[key][2] for key, r in got.items())
    some = {(r.a, r.b): round(r.raw, 9) for r in graph.semantic_overlap(v, p, rows=10, least=0.4).collect()}
    assert some == {key: round(raw, 9) for key, (raw, score, _) in want.items() if score > 0.4} and some
    pairs = {(r.a, r.b) for r in dedup.similar_pairs(v.select(F.col("chunk_id").alias("id"), "embedding"), 0.5, rows=10).collect()}
    assert pairs == {(name(i), name(j)) for i in range(60) for j in range(i + 1, 60) if x[i] @ x[j] > 0.5}


def test_entities_that_reach_a_score_or_are_asked_for(spark):
    rng = np.random.default_rng(2)
    docs = {d: {f"e{int(k)}": int(rng.integers(1, 4)) for k in rng.zipf(1.3, 12) % 40} for d in range(30)}
    e = entities(spark, docs)
    key = lambda df: {(r.a, r.b): (round(r.score, 9), [s.text for s in r.shared]) for r in df.collect()}
    whole = key(graph.entity_overlap(e, 30))
    for least in (0.2, 0.5):
        assert key(graph.entity_overlap(e, 30, least=least)) == {k: v for k, v in whole.items() if v[0] >= least}
    asked = [(a, b) for a, b in whole if (a + b) % 3 == 0] + [(0, 1)]
    assert key(graph.entity_overlap(e, 30, pairs=spark.createDataFrame(sorted(set(asked)), "a long, b long"))) == {k: v for k, v in whole.items() if k in set(asked)}


def test_sequential_near_duplicates(spark):
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.normal(size=(40, 6)) * 0.4, axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    kept, want = [], {}
    for i, y in enumerate(x):
        want[i] = any(x[j] @ y > 0.9 for j in kept)
        if not want[i]:
            kept.append(i)
    v = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)], "id long, embedding array<double>")
    assert {r.id: r.is_near_dup for r in dedup.near_duplicates(v, 0.9).collect()} == want


def entities(spark, docs):
    rows = [(d, e, "ORG", c) for d, own in docs.items() for e, c in own.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, label string, count long")


def test_entities(spark):
    e = entities(spark, {1: {"gneiss": 1, "shale": 1}, 2: {"gneiss": 1, "chert": 1}, 3: {"basalt": 1, "pumice": 1}, 4: {"basalt": 1, "marl": 1}, 5: {"basalt": 1, "loess": 1}})
    idf = {r.text: r.idf for r in graph.entity_idf(e, 5).collect()}
    assert math.isclose(idf["gneiss"], math.log(3.5)) and math.isclose(idf["basalt"], math.log(1 + 5 / 3)) and math.isclose(idf["shale"], math.log(6))
    score = {(r.a, r.b): r.score for r in graph.entity_overlap(e, 5).collect()}
    assert math.isclose(score[1, 2], math.log(3.5) / (math.log(3.5) + 2 * math.log(6))) and score[1, 2] > score[3, 4]
    r = graph.entity_overlap(entities(spark, {1: {"rare": 7, "common": 2}, 2: {"rare": 3, "common": 5}, 3: {"common": 1}}), 3).filter("a = 1 AND b = 2").first()
    assert [(s.text, s.count_a, s.count_b) for s in r.shared] == [("rare", 7, 3), ("common", 2, 5)]


def test_topic_similarity_and_combination(spark):
    rows = [([0.5, 0.3, 0.2], [0.5, 0.3, 0.2]), ([1.0, 0.0], [0.0, 1.0]), (None, [1.0]), ([0.0, 0.0], [1.0, 0.0])]
    got = [r.s for r in spark.createDataFrame(rows, "p array<double>, q array<double>").select(scoring.topic_similarity("p", "q").alias("s")).collect()]
    assert got == [1.0, 0.0, 0.0, 0.0]
    rows = [(0.8, 0.5, 0.2), (0.6, 0.9, 0.0), (0.1, 0.9, 0.0), (0.0, 0.0, 0.9)]
    df = spark.createDataFrame(rows, "s double, e double, t double")
    got = df.select(scoring.combine("s", "e", "t").alias("c"), scoring.dominant_signal("s", "e", "t").alias("d")).collect()
    assert math.isclose(got[0].c, 0.59) and [r.d for r in got[1:]] == ["semantic", "entity", "topic"]
    even = GraphParams(semantic_weight=1, entity_weight=1, topic_weight=1)
    tie = spark.createDataFrame([(0.5, 0.5, 0.5), (0.0, 0.5, 0.5)], "s double, e double, t double").select(scoring.dominant_signal("s", "e", "t", even).alias("d")).collect()
    assert [r.d for r in tie] == ["semantic", "entity"]


def test_params():
    base = params_hash(GraphParams())
    assert len(base) == 64 and base == params_hash(GraphParams(top_entities_per_node=3)) and base != params_hash(GraphParams(n_topics=4))
    for bad in (lambda: GraphParams(semantic_floor=0.9, semantic_ceil=0.9), lambda: SearchParams(rrf_k=0), lambda: AskParams(top_k=11), lambda: ChunkParams(overlap_ratio=0.5), lambda: checked_query("  ")):
        with pytest.raises(ValueError, match="."):
            bad()


def test_edges_and_views(spark):
    sem = spark.createDataFrame([(1, 2, 0.7), (1, 3, 0.1)], "a long, b long, score double").withColumn("pairs", F.array(F.struct(F.lit(1).alias("a"), F.lit(2).alias("b"), F.lit(0.71).alias("sim"))))
    ent = graph.entity_overlap(entities(spark, {2: {"brontide": 1}, 3: {"brontide": 1}}), 3)
    topic = spark.createDataFrame([(1, 2, 0.0)], "a long, b long, score double")
    e = graph.edges(sem, ent, topic)
    assert [(r.source, r.target, r.combined_score) for r in e.collect()] == [(1, 2, 0.35)]
    assert graph.edge_between(e, 2, 1).count() == 1
    text_ = e.withColumns({"doc_a": F.lit("A"), "doc_b": F.lit("B")}).select(answers.template_explanation().alias("t")).first().t
    assert text_ == '"A" and "B" are linked mainly by closely related passages (top pair similarity 0.71). Their closest passages overlap with similarity 0.71. Signal scores: semantic 0.70, entity 0.00, topic 0.00 (combined 0.35).'
    both = graph.edges(sem, ent, topic, GraphParams(edge_threshold=0.2)).filter("source = 2").withColumns({"doc_a": F.lit("A"), "doc_b": F.lit("B")})
    assert "shared references to brontide" in both.select(answers.template_explanation().alias("t")).first().t
    lit = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert graph.lit_edges(e, lit).count() == 1 and graph.lit_edges(e, lit.limit(1)).count() == 0


def test_passes_of_the_topics_run_in_few_jobs(spark):
    """A pass is one job over sparse rows, whose products are those of dense ones; it asks not for one job each partition."""
    rng = np.random.default_rng(5)
    dense = np.where(rng.random((90, 12)) < 0.3, rng.random((90, 12)), 0.0)
    dense[[0, 40, 89]] = 0
    rows = spark.createDataFrame([([int(j) for j in np.flatnonzero(v)], [float(x) for x in v[v > 0]]) for v in dense], "index array<int>, weight array<double>").repartition(9)
    packed, basis = topics._packed(rows), rng.random((12, 3))
    spark.sparkContext.setJobGroup("a pass", "")
    found = topics._summed(packed, 12, lambda v: np.concatenate([v.turned(v.times(basis)).ravel(), v.times(basis).sum(axis=0)]))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("a pass")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert np.allclose(found, np.concatenate([(dense.T @ (dense @ basis)).ravel(), (dense @ basis).sum(axis=0)])) and len(jobs) <= 2


def test_topics(spark):
    words = {0: "neural network training gradient", 1: "cell membrane protein enzyme", 2: "ocean whale reef current"}
    rows = [(d, 10 * d + i, f"{w} {w} filler{d}") for d, w in words.items() for i in range(2)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_id long, text string")
    p = GraphParams(n_topics=3)
    first, loadings = topics.fit(chunks, p)
    again, _ = topics.fit(chunks, p)
    assert np.array_equal(first.components, again.components)
    dist = graph.topic_distribution(loadings)
    assert all(math.isclose(r.s, 1, abs_tol=1e-6) for r in dist.groupBy("doc_id").agg(F.sum("weight").alias("s")).collect())
    assert len({r.dominant_topic for r in graph.dominant_topics(dist).collect()}) == 3
    assert topics.fit(chunks.limit(0), p) == (None, None)
    assert topics.fit(spark.createDataFrame([(1, 1, "the and of")], "doc_id long, chunk_id long, text string"), p) == (None, None)
    assert topics.fit(spark.createDataFrame([(1, 1, "single chunk")], "doc_id long, chunk_id long, text string"), p)[0].components.shape[0] == 1


def test_answers(spark):
    hits = spark.createDataFrame([(i, f"c{i}", "x" * 200, "d.pdf", None, None, None) for i in range(1, 4)], "rank int, chunk_id string, text string, filename string, page_start int, page_end int, section string")
    assert [r.marker for r in answers.context_blocks(hits, AskParams(context_char_budget=300)).collect()] == [1]
    found = answers.answer("q", hits, lambda m: "True [1]. False [9].")
    assert found["status"] == "llm" and found["answer"] == "True [1]. False." and found["citations"] == [(1, "c1")]
    assert answers.answer("q", hits)["status"] == "unavailable" and answers.answer("q", hits.limit(0))["status"] == "no_evidence"
    assert answers.answer("q", hits, lambda m: 1 / 0)["status"] == "unavailable"


def test_explanation_prompts(spark):
    """Three pairs at most, cut at words, the least similar one out while a message is too long; edges without pairs or entities have one, too."""
    pairs = [(10, 20, 0.9), (11, 21, 0.75), (12, 99, 0.7), (13, 22, 0.5), (10, 21, 0.25)]
    rows = [(1, 2, "entity", pairs, [(f"e{i}", "ORG") for i in range(8)]), (1, 3, "topic", None, None), (2, 3, "topic", [], [])]
    edges = spark.createDataFrame(rows, "source long, target long, dominant_signal string, top_pairs array<struct<a:long,b:long,sim:double>>, shared_entities array<struct<text:string,label:string>>")
    chunks = spark.createDataFrame([(10, "word " * 500), (11, "short"), (13, None), (20, "unbreakable" * 100), (21, "b"), (22, "last")], "chunk_id long, text string")
    shown = graph.with_evidence(edges, chunks).withColumns({"doc_a": F.lit("one.md"), "doc_b": F.lit("two.md")})

    def content(**limits):
        found = shown.select("source", "target", answers.explanation_prompt(**limits).alias("m")).collect()
        assert all([m.role for m in r.m] == ["system", "user"] and "instruction" in r.m[0].content for r in found)
        return {(r.source, r.target): r.m[1].content for r in found}

    head = "A: one.md\nB: two.md\nStrongest signal: {}\nShared entities: {}\n<excerpts>\n"
    best = "[1, similarity 0.90]\nA: " + ("word " * 4)[:-1] + "…\nB: " + ("unbreakable" * 3)[:24] + "…"
    rest = ["[2, similarity 0.75]\nA: short\nB: b", "[3, similarity 0.50]\nA: \nB: last"]  # the pair with chunk 99 is no evidence
    start, named = head.format("entity", ", ".join(f"e{i} (ORG)" for i in range(6))), (1, 2)
    got = content(excerpt=24)
    assert got[named] == start + "\n\n".join([best, *rest]) + "\n</excerpts>"
    assert got[1, 3] == got[2, 3] == head.format("topic", "none") + "\n</excerpts>"
    two = start + "\n\n".join([best, rest[0]]) + "\n</excerpts>"
    assert content(excerpt=24, limit=len(two))[named] == two and content(excerpt=24, limit=len(two) - 1)[named] == start + best + "\n</excerpts>"
    assert content(limit=10)[named] == start + "\n</excerpts>"


def test_names_and_types(spark):
    names = {r"..\..\up\report.txt": "report.txt", "/var/tmp/shadow": "shadow", r"D:\y\PRN.pdf": "_PRN.pdf", "aux.txt": "_aux.txt", "dots at the end...": "dots at the end", "": "unnamed"}
    got = {r.n: r.s for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", text.sanitize_filename("n").alias("s")).collect()}
    assert got == names
    long = spark.createDataFrame([("a" * 400 + ".pdf",)], "n string").select(text.sanitize_filename("n").alias("s")).first().s
    assert len(long) <= 255 and long.endswith(".pdf")
    cut = spark.createDataFrame([("foo bar baz",), ("short",), ("unbreakable",)], "t string").select(text.truncate_at_word("t", 8).alias("s")).collect()
    assert [r.s for r in cut] == ["foo…", "short", "unbreaka…"]


def test_store(spark, tmp_path):
    v = spark.createDataFrame([(i, f"c{i}", i // 2, [float(i), 0.0]) for i in range(6)], store.VECTOR)
    s = store.VectorStore.empty(spark, 2).upsert(v)
    s.persist(f"{tmp_path}/v")
    again = store.VectorStore.load(spark, f"{tmp_path}/v", 2)
    assert again.health().first().vectors == 6
    assert again.delete_documents(spark.createDataFrame([(0,)], "doc_id long")).vectors.count() == 4
    with pytest.raises(ValueError, match="dimensions"):
        store.VectorStore.load(spark, f"{tmp_path}/v", 3)
    store.commit({"edges": v, "analysis": v}, f"file://{tmp_path}/g", "1", "analysis")
    assert store.committed(spark, f"file://{tmp_path}/g", "analysis") == ["1"]


def test_long_answers_are_cut(spark):
    words = "word " * 700
    df = spark.createDataFrame([(1, f'"{words}"'), (2, "short\n\n\n\nanswer"), (3, "x" * 3001), (4, None)], "i int, t string")
    got = {r.i: r.t for r in df.select("i", text.postprocess_answer("t").alias("t")).collect()}
    assert got == {1: ("word " * 599).strip() + "…", 2: "short\n\nanswer", 3: "x" * 3000 + "…", 4: None}


def test_models_fail_once_and_for_all():
    calls = []

    def broken(messages):
        calls.append(1)
        raise RuntimeError("no weights")

    model = answers.Model(broken)
    with pytest.raises(RuntimeError):
        model([("user", "x")])
    assert model([("user", "x")]) == "" and len(calls) == 1
    counted = answers.Model(lambda m: "three words here")
    assert counted([("system", "a b"), ("user", "c")]) == "three words here" and (counted.tokens_in, counted.tokens_out) == (3, 3)


def test_explanation_ladder(spark):
    none = "CAST(array() AS array<struct<a:bigint,b:bigint,sim:double>>) AS top_pairs", "CAST(array() AS array<struct<text:string,label:string,idf:double,count_a:bigint,count_b:bigint>>) AS shared_entities"
    edges = spark.range(6).selectExpr("id AS source", "id + 10 AS target", "CAST(id AS STRING) AS doc_a", "'z' AS doc_b", "0.5D AS semantic_score", "0.0D AS entity_score", "0.0D AS topic_score", "0.25D AS combined_score", "'topic' AS dominant_signal", *none)
    cache = edges.filter("source = 1").select(answers.cache_key("m").alias("cache_key"), F.lit("known").alias("explanation"))
    out = {r.source: r for r in answers.explained(edges, cache, "m", lambda e: e.withColumn("generated", F.when(F.col("source") != 2, F.lit(' "Said."'))), tokens=3).collect()}
    assert [(out[i].origin, out[i].charged) for i in range(6)] == [("llm", True), ("cache", False), ("template", True), ("llm", True), ("template", False), ("template", False)]
    assert out[1].explanation == "known" and out[0].explanation == "Said." and out[4].explanation.startswith('"4" and "z" are linked')
    assert out[4].cache_key == edges.filter("source = 4").select(answers.cache_key("template").alias("k")).first().k
    assert {r.origin for r in answers.explained(edges, cache, "m").collect()} == {"cache", "template"}


def test_keyed_tables(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id long, s string, n int")
    made, refused = store.Keyed(rows, "id").created(spark.createDataFrame([(2, "x", 0), (3, "c", 7), (3, "c", 7)], rows.schema))
    assert made.rows.count() == 3 and sorted(r.id for r in refused.collect()) == [2, 3]
    changed = made.updated(spark.createDataFrame([(3, None), (9, "z")], "id long, s string"))
    assert sorted((r.id, r.s, r.n) for r in changed.rows.collect() if r.s) == [(1, "a", 5), (2, "b", 6)] and changed.rows.count() == 3
    assert changed.deleted(spark.createDataFrame([(6,)], "n int"), "n").rows.count() == 2
    log = store.appended(spark.createDataFrame([(4, "q")], "event_id long, s string"), spark.createDataFrame([("y", 2), ("x", 1)], "s string, o int"), "o")
    assert sorted((r.event_id, r.s) for r in log.collect()) == [(4, "q"), (5, "x"), (6, "y")]


def test_recompute(spark, tmp_path):
    """Edges, analyses and events as one version; a graph is stale once documents or parameters change."""
    words = {1: "Brontide rumbles over the plain of Karst", 2: "Brontide was heard near Karst and the plain", 3: "Owls sleep by day in Lindens"}
    chunks = spark.createDataFrame([(d, f"{d}-{i}", t) for d, t in words.items() for i in range(2)], "doc_id long, chunk_id string, text string")
    vectors = retrieval.embed(chunks).drop("text")
    top, p = f"file://{tmp_path}/graph", GraphParams(n_topics=2, edge_threshold=0.3, semantic_floor=0.0, semantic_ceil=1.0)
    assert recompute.recompute(spark, chunks, vectors, top, p, triggered_by="d1") == "000000000001"
    g = recompute.Graph(spark, top)
    assert [(r.source, r.target) for r in g.listed_edges().collect()] == [(1, 2)]
    edge = g.edges.first()
    assert {e.text for e in edge.shared_entities} == {"brontide", "karst"} and edge.top_pairs
    assert [r.status for r in g.events.orderBy("position").collect()] == ["graph_start"] + ["graph_progress"] * 3 + ["graph_done"]
    nodes = {r.doc_id: r for r in g.nodes(chunks.select("doc_id").distinct()).collect()}
    assert len(nodes) == 3 and nodes[3].topics and {e.text for e in nodes[3].entities} == {"owls", "lindens"}
    meta = g.meta(chunks, p).first()
    assert (meta.documents, meta.edges, meta.stale) == (3, 1, False) and meta.updated_at
    assert g.meta(chunks.filter("doc_id > 1"), p).first().stale and g.meta(chunks, GraphParams(n_topics=3)).first().stale
    store.claimed(spark, top)  # a run that has begun and written nothing
    assert recompute.recompute(spark, chunks.limit(0), vectors.limit(0), top, p) == "000000000003"
    empty = recompute.Graph(spark, top)
    assert empty.version == "000000000003" and empty.edges.count() == 0 == empty.analysis.count() == empty.events.count()


@pytest.mark.parametrize("ws,we,wt,threshold", [(0.5, 0.3, 0.2, 0.4), (0.2, 0.2, 0.6, 0.4), (0.1, 0.45, 0.45, 0.3), (0.8, 0.1, 0.1, 0.3)])
def test_pairs_that_the_recompute_leaves_out_cannot_be_edges(spark, ws, we, wt, threshold):
    """Whatever signals can carry an edge alone; and all edges have the evidence that whole tables give them."""
    weights_of = {"semantic_weight": ws, "entity_weight": we, "topic_weight": wt, "edge_threshold": threshold}
    rng = np.random.default_rng(9)
    x = rng.normal(size=(40, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i // 2, i, y.tolist()) for i, y in enumerate(x)], "doc_id long, chunk_id long, embedding array<double>")
    e = entities(spark, {d: {f"e{int(k)}": 1 for k in rng.integers(0, 9, 4)} for d in range(20)})
    weights = rng.dirichlet([0.3] * 4, 20)
    dist = spark.createDataFrame([(d, t, float(weights[d, t])) for d in range(20) for t in range(4)], "doc_id long, topic int, weight double")
    p = GraphParams(semantic_floor=0.4, semantic_ceil=1.0, top_k_pairs=2, **weights_of)
    key = lambda edges: {(r.source, r.target): (r.combined_score, r.dominant_signal, r.top_pairs, r.shared_entities) for r in edges.collect()}
    side = recompute.topic_vectors(dist)
    all_topics = side.withColumnsRenamed({"doc_id": "a"}).join(side.withColumnsRenamed({"doc_id": "b", "p": "q"}), F.col("a") < F.col("b")).select("a", "b", scoring.topic_similarity("p", "q").alias("score"))
    whole = key(graph.edges(graph.semantic_overlap(v, p), graph.entity_overlap(e, 20), all_topics, p))
    assert key(graph.edges(*recompute.scored_pairs(v, e, 20, dist, p), p)) == whole and whole


def test_least_scores_of_candidates():
    of = lambda s, e, t, threshold, topics=True: recompute.least_scores(GraphParams(semantic_weight=s, entity_weight=e, topic_weight=t, edge_threshold=threshold), topics)
    assert of(0.5, 0.3, 0.2, 0.6) == (None, None) == of(0.5, 0.3, 0.2, 0.35, topics=False)
    assert of(0.5, 0.3, 0.2, 0.35) == (pytest.approx(0.5), None) and of(0.2, 0.2, 0.6, 0.5) == (None, pytest.approx(0.5))
    assert of(0.0, 0.5, 0.5, 0.4) == (pytest.approx(0.4), pytest.approx(0.4))
    with pytest.raises(ValueError):
        of(0.5, 0.3, 0.2, 0.0)


def test_embeddings_and_the_nearest_sentence(spark):
    import zlib

    def plain(words):
        out = np.zeros(64)
        for w in words:
            h = zlib.crc32(w.encode())
            out[h % 64] += 1 if h >= 1 << 31 else -1
        return out / (np.linalg.norm(out) or 1)

    df = spark.createDataFrame([(1, "Owls hunt at night"), (2, None), (3, "... !")], "i int, text string")
    got = {r.i: np.array(r.embedding) for r in retrieval.embed(df).collect()}
    assert np.allclose(got[1], plain(["owls", "hunt", "at", "night"]), atol=1e-6) and not got[2].any() and not got[3].any()
    asked = retrieval.embed(df.filter("i = 1"), prefix="query: ").first().embedding
    assert np.allclose(asked, plain(["query", "owls", "hunt", "at", "night"]), atol=1e-6)
    text_ = "Rivers are long. Owls hunt at night. Owls sleep."
    near = spark.createDataFrame([(text_,), (None,)], "t string")
    rows = near.select(retrieval.semantic_sentence(plain(["owls", "hunt"]))("t").alias("s"), retrieval.semantic_sentence(plain(["owls"]), enabled=False)("t").alias("f")).collect()
    assert text_[rows[0].s.start : rows[0].s.end] == "Owls hunt at night." and (rows[0].f.start, rows[0].f.end) == (0, 16) and rows[1].s.start is None


def test_cache_keys_follow_the_evidence(spark):
    def key(sim=0.5, entity="owl", score=0.4, target=2, model="m"):
        row = spark.createDataFrame([(1, target, score, 0.1, 0.2)], "source long, target long, semantic_score double, entity_score double, topic_score double")
        pairs = F.array(F.struct(F.lit(1).alias("a"), F.lit(2).alias("b"), F.lit(sim).alias("sim")))
        shared = F.array(F.struct(F.lit(entity).alias("text"), F.lit("ORG").alias("label")))
        return row.withColumns({"top_pairs": pairs, "shared_entities": shared}).select(answers.cache_key(model).alias("k")).first().k

    base = key()
    assert base == key() == key(sim=0.50001) and len(base) == 64
    assert len({base, key(sim=0.6), key(entity="bat"), key(score=0.5), key(target=3), key(model="n")}) == 6


def test_tokens_are_counted_where_the_texts_are(spark):
    """No token passes a shuffle; texts of a repeated id with as many tokens count together, and letters that lower to ASCII are letters."""
    texts = [(1, "A b a-B, a"), (2, None), (3, ""), (4, "\u212aelvin \u0130x kelvin"), (5, "\u00e9t\u00e9 9")]
    counts = lambda df: sorted((r.chunk_id, r.term, r.len, r.tf) for r in df.collect())
    one = retrieval.term_frequencies(spark.createDataFrame(texts, "chunk_id long, text string"))
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    plain = [(1, "a", 5, 3), (1, "b", 5, 2), (4, "i", 4, 1), (4, "kelvin", 4, 2), (4, "x", 4, 1), (5, "9", 2, 1), (5, "t", 2, 1)]
    assert counts(one) == plain
    twice = retrieval.term_frequencies(spark.createDataFrame([*texts, (1, "c a a a a")], "chunk_id long, text string"))
    assert counts(twice) == sorted([(1, "a", 5, 7), (1, "b", 5, 2), (1, "c", 5, 1), *plain[2:]])
    tokens = spark.createDataFrame([texts[3]], "chunk_id long, text string").select(retrieval.tokenize("text").alias("t")).first().t
    assert tokens == ["kelvin", "i", "x", "kelvin"]


def test_highlights_cut_a_text_once(spark):
    """The pattern runs once over a text, not once for each span."""
    df = spark.createDataFrame([("Tea, tea and \u0442ea: tea-\u017feas",), (None,), ("none",)], "text string").select(retrieval.term_highlights("tea seas", "text").alias("s"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert [[(x.start, x.end) for x in r.s] for r in df.collect()] == [[(0, 3), (5, 8), (18, 21), (22, 26)], [], []]


def test_no_sentence_is_looked_for_without_its_terms(spark, monkeypatch):
    best = retrieval.best_sentence("tea")
    df = spark.createDataFrame([("No cup. Green Tea. Tea.",), ("Nothing here.",), (None,)], "text string").select(best("text").alias("s"))
    assert [(r.s.start, r.s.end) if r.s and r.s.start is not None else None for r in df.collect()] == [(8, 18), None, None]


def test_hits_without_terms_show_the_nearest_sentence(spark):
    """A text that has no whole word of the query: its best sentence by terms, else by vectors."""
    df = spark.createDataFrame([(1, "No cup. A _tea_ here."), (2, "Rivers are long. Owls hunt at night. Bats sleep."), (3, "Tea."), (4, ""), (5, None)], "i int, text string")
    vector = retrieval.hashed_embedding("owls hunt")
    both = df.withColumn("h", retrieval.term_highlights("tea", "text")).withColumn("s", retrieval.best_sentence("tea", vector)(F.when(F.size("h") == 0, F.col("text"))))
    got = {r.i: [tuple(x) for x in r.g or []] for r in both.select("i", retrieval.hit_segments("text", "h", "s").alias("g")).collect()}
    assert got[1] == [("No cup. ", "plain"), ("A _tea_ here.", "sentence")] and got[3] == [("Tea", "term"), (".", "plain")] and got[4] == got[5] == []
    assert got[2] == [("Rivers are long. ", "plain"), ("Owls hunt at night.", "sentence"), (" Bats sleep.", "plain")]


def test_hit_segments_query_shows_all_three_kinds(spark):
    from docweft.plans import registry

    registry.load_all()
    rows = registry.QUERIES["hit_segments"](spark, "/root/testdata/sf0.001")
    assert {"term", "sentence", "plain"} == {r.shown for r in rows.select("shown").distinct().collect()}
