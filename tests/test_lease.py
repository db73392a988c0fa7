import threading
import time

import pytest

from docweft.params import GraphParams
from docweft.operators import recompute
from docweft.sources import store
from docweft.sources.lease import Folder, Lease, LostLease, serialised


@pytest.fixture
def top(tmp_path):
    return f"file://{tmp_path}/shared"


def in_threads(n, work):
    out, threads = [None] * n, []
    for i in range(n):
        threads.append(threading.Thread(target=lambda i=i: out.__setitem__(i, work(i))))
        threads[-1].start()
    for t in threads:
        t.join()
    return out


def test_one_of_many_creates_a_file(spark, top):
    folder = Folder(spark, top)
    for name in "abc":
        assert sum(in_threads(8, lambda i: Folder(spark, top).created(name))) == 1
    assert folder.names() == ["a", "b", "c"] and len(set(in_threads(8, lambda i: store.claimed(spark, top)))) == 8


def test_ten_overlapping_triggers_make_two_runs(spark, top):
    begun, go, runs = threading.Event(), threading.Event(), []

    def run(check):
        runs.append(time.time())
        begun.set()
        assert go.wait(60)
        check()
        return f"run{len(runs)}"

    def trigger(i):
        if i:
            assert begun.wait(60)
        try:
            return serialised(spark, top, run)
        finally:
            with lock:
                waiting.append(i)
                if len(waiting) == 9:
                    go.set()

    waiting, lock = [], threading.Lock()
    found = in_threads(10, trigger)
    assert len(runs) == 2 and sorted(map(len, found)) == [0] * 9 + [2]
    assert serialised(spark, top, lambda check: "again") == ["again"]


def test_a_killed_holder_is_replaced_and_cannot_commit(spark, top):
    dead = Lease(spark, top, ttl=0.5)
    assert dead.acquire()
    assert not Lease(spark, top, ttl=0.5).acquire()
    time.sleep(1.2)
    assert not Lease(spark, top, ttl=0.5).acquire()  # it lives as long as it beats
    dead.ended.set()
    time.sleep(1.2)
    taken = [lease for lease in (Lease(spark, top, ttl=0.5) for _ in range(3)) if lease.acquire()]
    assert len(taken) == 1 and taken[0].token == dead.token + 1
    rows = spark.range(3)
    with pytest.raises(LostLease):
        store.commit({"edges": rows, "analysis": rows}, top, "000000000001", "analysis", dead.check)
    assert store.committed(spark, top, "analysis") == []
    store.commit({"edges": rows, "analysis": rows}, top, "000000000002", "analysis", taken[0].check)
    taken[0].release()
    assert store.committed(spark, top, "analysis") == ["000000000002"]
    assert Lease(spark, top, ttl=0.5).acquire()


def test_a_run_that_fails_leaves_its_request(spark, top):
    def broken(check):
        raise ValueError("out of paper")

    with pytest.raises(ValueError, match="out of paper"):
        serialised(spark, top, broken)
    assert len(Folder(spark, f"{top}/requests").names()) == 1
    assert serialised(spark, top, lambda check: "mended") == ["mended"]
    assert Folder(spark, f"{top}/requests").names() == []


def test_recompute_sees_what_was_there_at_its_start(spark, top):
    """A trigger during a run is followed by a run that sees the newer table."""
    text = "Anna Kern and Bertha Kern met in Kerndorf."
    tables = [[("d1", "c1", text)], [("d1", "c1", text), ("d2", "c2", text)]]
    loads = []

    def load():
        loads.append(1)
        if len(loads) == 1:  # while the first run is under way
            assert recompute.recompute_serialised(spark, load, top) == []
        rows = spark.createDataFrame(tables[len(loads) - 1], "doc_id string, chunk_id string, text string")
        return rows, rows.selectExpr("doc_id", "chunk_id", "array(CAST(1 AS DOUBLE), CAST(0 AS DOUBLE)) AS embedding")

    p = GraphParams(semantic_floor=0.5, semantic_ceil=1.0, n_topics=2)
    assert len(recompute.recompute_serialised(spark, load, top, p, triggered_by="d1")) == 2
    g = recompute.Graph(spark, top)
    assert g.analysis.count() == 2 and [(r.source, r.target) for r in g.edges.collect()] == [("d1", "d2")]


def plain_create(old, new):
    taken, refused, keys = [], [], {r[0] for r in old}
    for r in sorted(new, key=lambda r: (r[0] is None, r)):
        (refused if r[0] is None or r[0] in keys else taken).append(r)
        keys.add(r[0])
    return taken, refused


def test_keyed_tables_with_repeated_and_null_keys(spark):
    schema = "k long, v string"
    old = [(1, "one"), (4, "four")]
    new = [(1, "uno"), (2, "b"), (2, "a"), (2, "a"), (3, "c"), (None, "x"), (None, "x")]
    keyed, refused = store.Keyed(spark.createDataFrame(old, schema), "k").created(spark.createDataFrame(new, schema))
    taken, not_taken = plain_create(old, new)
    assert sorted(map(tuple, keyed.rows.collect())) == sorted(old + taken)
    assert sorted(map(tuple, refused.collect()), key=str) == sorted(not_taken, key=str)
    changes = spark.createDataFrame([(1, "z", 1), (1, "y", 2), (9, "q", 1), (None, "n", 1)], "k long, v string, at int")
    assert sorted(map(tuple, store.Keyed(spark.createDataFrame(old, schema), "k").updated(changes, "at").rows.collect())) == [(1, "y"), (4, "four")]
    assert sorted(map(tuple, store.Keyed(spark.createDataFrame(old, schema), "k").updated(changes.drop("at")).rows.collect())) == [(1, "z"), (4, "four")]
