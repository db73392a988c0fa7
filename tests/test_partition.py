import numpy as np
import pytest
from pyspark.sql import functions as F

from docweft.functions.scoring import topic_similarity
from docweft.operators import dedup, graph


def table(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, embedding array<double>")


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clustered(rng, n, dim, centres, spread):
    c = rng.normal(size=(centres, dim))
    return unit(c[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, dim)))


@pytest.mark.parametrize("dim,centres,spread,threshold,rows", [(3, 5, 0.3, 0.99, 16), (16, 12, 0.08, 0.95, 20), (16, 40, 1.0, 0.6, 25), (8, 1, 0.0, 0.98, 10)])
def test_cells_lose_no_pair(spark, dim, centres, spread, threshold, rows):
    x = clustered(np.random.default_rng(dim + centres), 180, dim, centres, spread)
    want = {(i, j) for i in range(180) for j in range(i + 1, 180) if x[i] @ x[j] > threshold}
    found = dedup.similar_pairs(table(spark, x), threshold, rows).collect()
    assert {(r.a, r.b) for r in found} == want and len(found) == len(want)
    assert all(abs(r.sim - x[r.a] @ x[r.b]) < 1e-12 for r in found)
    near = {r.id for r in dedup.near_known(table(spark, x[:90]), table(spark, x[90:]), threshold, rows).collect()}
    assert near == {i for i in range(90) if (x[90:] @ x[i] > threshold).any()}


def test_clustered_vectors_compare_few_blocks(spark):
    """Of the pairs of blocks less than a tenth is compared, and no block outgrows its size by much."""
    rows = table(spark, clustered(np.random.default_rng(1), 2000, 24, 40, 0.05))
    blocks = dedup.partitioned(rows, dedup.chosen_pivots(rows), 40)
    n = blocks.count()
    met = dedup.block_pairs(blocks, blocks, 0.95, True).count()
    assert n >= 40 and met < 0.1 * n * (n + 1) / 2
    assert blocks.agg(F.max("n")).first()[0] <= 3 * 40


def test_small_tables(spark):
    assert dedup.similar_pairs(table(spark, np.zeros((0, 3))), 0.5).count() == 0
    one = table(spark, np.array([[1.0, 0.0]]))
    assert dedup.similar_pairs(one, 0.5).count() == 0
    assert dedup.near_known(one, table(spark, np.zeros((0, 2))), 0.5).count() == 0
    assert [r.id for r in dedup.near_known(one, one, 0.5).collect()] == [0]


def distributions(spark, x):
    return spark.createDataFrame([(i, t, float(w)) for i, row in enumerate(x) for t, w in enumerate(row)], "doc_id long, topic long, weight double")


def closeness(p, q):
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(s > 0, s * np.log2(s / m), 0).sum() for s in (p, q)]
    return round(1 - np.sqrt(max(0.0, sum(parts) / 2)), 12)


@pytest.mark.parametrize("topics,centres,alpha,least,rows", [(3, 4, 40.0, 0.9, 12), (8, 6, 2.0, 0.5, 20), (8, 1, 0.3, 0.0, 15)])
def test_topic_pairs_lose_none(spark, topics, centres, alpha, least, rows):
    """Also with equal distributions, with disjoint ones and with documents without mass."""
    rng = np.random.default_rng(topics + centres)
    c = rng.dirichlet(np.full(topics, 0.4), centres)
    x = np.array([rng.dirichlet(alpha * c[i % centres] + 0.02) for i in range(90)])
    x[[3, 50]] = x[7]
    x[20], x[21] = np.eye(topics)[0], np.eye(topics)[1]
    x[[30, 31]] = 0
    x[40] *= 5  # weights need not have the sum 1
    s = x / np.maximum(x.sum(axis=1, keepdims=True), 1e-300)
    want = {(i, j): closeness(s[i], s[j]) for i in range(90) for j in range(i + 1, 90) if s[i].any() and s[j].any()}
    found = {(r.a, r.b): r.score for r in graph.topic_pairs(distributions(spark, x), least, rows).collect()}
    assert set(found) == {k for k, v in want.items() if v > least} and (3, 7) in found and (20, 21) not in found
    assert all(abs(v - want[k]) < 1e-6 for k, v in found.items())


def test_topic_pairs_compare_few_blocks(spark):
    """Distributions around some centres: less than a tenth of the pairs of blocks meets, and the scores are those of the column."""
    rng = np.random.default_rng(5)
    c = rng.dirichlet(np.full(12, 0.2), 40)
    x = np.array([rng.dirichlet(300 * c[i % 40] + 0.01) for i in range(1200)])
    rows = table(spark, x)
    blocks = dedup.partitioned(rows, dedup.chosen_pivots(rows), 30, dedup.CLOSENESS)
    n = blocks.count()
    assert dedup.block_pairs(blocks, blocks, 0.9, True, dedup.CLOSENESS).count() < 0.1 * n * (n + 1) / 2
    some = graph.topic_pairs(distributions(spark, x[:60]), 0.8)
    both = some.join(rows.select(F.col("id").alias("a"), F.col("embedding").alias("p")), "a").join(rows.select(F.col("id").alias("b"), F.col("embedding").alias("q")), "b")
    assert some.count() and both.filter(F.abs(F.col("score") - topic_similarity("p", "q")) > 1e-6).count() == 0


def test_topic_pairs_of_small_tables(spark):
    none = distributions(spark, np.zeros((0, 2)))
    assert graph.topic_pairs(none, 0.5).count() == 0 and graph.topic_pairs(distributions(spark, np.zeros((3, 2))), 0.0).count() == 0
    odd = spark.createDataFrame([(1, 0, 0.5), (1, 2, 0.5), (2, 2, 0.25), (2, 2, 0.25), (2, 0, 0.5), (None, 0, 1.0), (3, None, 1.0), (4, 0, None)], "doc_id long, topic long, weight double")
    assert [(r.a, r.b, r.score) for r in graph.topic_pairs(odd, 0.5).collect()] == [(1, 2, 1.0)]
    with pytest.raises(ValueError):
        graph.topic_pairs(odd, -0.1)


def test_only_rows_that_no_round_has_settled_are_linked(spark, monkeypatch):
    """The sequential rule over many rounds drops what one by one drops; rows are linked round by round and never all at once."""
    x = np.random.default_rng(8).normal(size=(300, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows, stayed = table(spark, x), []
    for i in range(len(x)):
        if not any(x[i] @ x[j] > 0.8 for j in stayed):
            stayed.append(i)
    sizes, pairs = [], dedup.similar_pairs
    monkeypatch.setattr(dedup, "FIRST_ROWS", 16, raising=False)
    monkeypatch.setattr(dedup, "similar_pairs", lambda v, *rest: sizes.append(v.count()) or pairs(v, *rest))
    found = dedup.near_duplicates(rows, 0.8).collect()
    assert sorted(r.id for r in found if not r.is_near_dup) == stayed and len(found) == 300
    assert len(sizes) > 1 and max(sizes) < 100


def test_few_rows_make_few_cells(spark, monkeypatch):
    """A block is shipped to all blocks that it meets: a small table is not dealt into 64 of them."""
    x = np.random.default_rng(2).normal(size=(200, 5))
    made, dealt = [], dedup.partitioned
    monkeypatch.setattr(dedup, "partitioned", lambda *given: made.append(dealt(*given)) or made[-1])
    dedup.similar_pairs(table(spark, x / np.linalg.norm(x, axis=1, keepdims=True)), 0.5).count()
    assert made[0].count() == 1
