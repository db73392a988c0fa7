import numpy as np
import pytest

from docweft.llm import mixing
from docweft.llm.shared import stored


def brute(n, p, goal, m, rounds=20000):
    """The same objective by plain projected gradient on one machine."""
    total, r = n.sum(), np.ones(len(n))
    for _ in range(rounds):
        off = ((r * n) @ p - goal) / total
        r = np.maximum(0, r - 0.5 * (p @ (off / m)))
    return r


@pytest.mark.parametrize("weights", [{"a": 0.2, "b": 0.5, "c": 0.3}, {"a": 0.9, "b": 0.08, "c": 0.02}])
def test_solver_reaches_the_targets(spark, weights):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.2, 0.1], 500)
    n = rng.integers(0, 900, 500)
    table = stored(spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(n, p))], "doc_id long, n_words long, p array<double>").repartition(4), "test")
    steps, reached, goal = mixing.solve(table, ["a", "b", "c"], weights, tolerance=1e-5, most=200)
    r = mixing.replayed(p, steps)[0]
    assert (r >= 0).all() and np.allclose((r * n) @ p, reached, rtol=1e-9)
    m = (n @ p) / n.sum()
    best = brute(n, p, goal, m)
    objective = lambda r: ((((r * n) @ p - goal) / n.sum()) ** 2 / m).sum()
    assert objective(r) <= objective(best) + 1e-6
    assert abs(goal.sum() - n.sum()) < 1e-6
    _, reached, goal = mixing.solve(table, ["a", "b", "c"], {"a": 0.9, "b": 0.1})  # every text has some c: out of reach
    assert np.abs(reached - goal).max() < 0.02 * n.sum()


def corpus(spark):
    rng = np.random.default_rng(2)
    styles = {"plain": "river house bridge walk old".split(), "loud": "BUY!! NOW!! OFFER!! CLICK!!".split(), "code": "x=1; y=2; return; if(x);".split()}
    rows, labels = [], []
    for i in range(400):
        d = ["plain", "loud", "code"][min(2, i % 7)] if i % 7 < 3 else "plain"
        rows.append((i, " ".join(rng.choice(styles[d], 30)), "s", 9.0, d))
        if i % 2:
            labels.append((i, d))
    rows += [(900, None, "s", 9.0, None), (901, "", None, None, None), (902, "river house " * 20000, "s", 9.0, "plain"), (0, rows[0][1], "s", 9.0, "plain"), (None, "BUY!!", None, None, "loud")]
    return spark.createDataFrame(rows, "doc_id long, text string, domain string, rate double, truth string"), spark.createDataFrame([*labels, (None, "loud"), (5, None)], "doc_id long, domain string")


def test_posteriors_and_rates(spark):
    docs, labels = corpus(spark)
    rows = mixing.mixing_rates(docs.drop("truth"), labels, {"plain": 0.9, "loud": 0.05, "code": 0.05}).collect()
    truth = {r.doc_id: r.truth for r in docs.collect()}
    assert len(rows) == docs.count() and all(abs(sum(r.p) - 1) < 1e-9 and r.rate >= 0 for r in rows)
    assert np.mean([r.domain == truth[r.doc_id] for r in rows if r.doc_id is not None and r.doc_id < 400]) > 0.98
    n, p, r = np.array([x.n_words for x in rows]), np.array([x.p for x in rows]), np.array([x.rate for x in rows])
    reached = (n * r) @ p / n.sum()
    assert np.allclose(sorted(reached), [0.05, 0.05, 0.9], atol=2e-3)
    assert {x.n_words for x in rows if x.doc_id in (900, 901)} == {0}


def test_copies_follow_rates(spark):
    docs, labels = corpus(spark)
    out = mixing.mixed(docs, labels, {"plain": 0.9, "loud": 0.05, "code": 0.05}, budget=1.2)
    assert out.columns == ["doc_id", "text", "domain", "truth", "rate", "copies"]
    rows = out.collect()
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) and r.copies > 0 for r in rows)
    plain = {r.doc_id for r in docs.collect() if r.truth == "plain"}
    assert plain <= {r.doc_id for r in rows}


def test_edges(spark):
    docs, labels = corpus(spark)
    assert mixing.mixing_rates(docs.limit(0), labels, {"plain": 1.0}).count() == 0
    rows = mixing.mixing_rates(docs, labels.limit(0), {"all": 1.0}).collect()
    assert {r.domain for r in rows} == {"all"} and all(abs(r.rate - 1) < 1e-9 for r in rows)


def test_targets_are_met_on_weak_posteriors(spark, caplog):
    """With the query's parameters: targets that can be met are met, however little the posteriors differ; others are reported."""
    rng = np.random.default_rng(5)
    p = rng.dirichlet([60, 60, 2], size=400)
    n = rng.integers(5, 200, 400)
    table = stored(spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_words long, p array<double>").coalesce(1), "weak")
    rate = np.where(p[:, 0] > np.quantile(p[:, 0], 0.75), 4.0, 0.05)
    wanted = (rate * n) @ p
    _, reached, goal = mixing.solve(table, ["a", "b", "c"], dict(zip("abc", wanted.tolist())), budget=1.0)
    assert np.abs(reached - goal).max() <= 1e-4 * n.sum()
    with caplog.at_level("WARNING", logger=mixing.__name__):
        mixing.solve(table, ["a", "b", "c"], {"a": 1.0}, most=5)
    assert "mixing targets missed" in caplog.text
