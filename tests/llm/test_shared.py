import threading
from statistics import median

import pytest
from pyspark.sql import functions as F

from docweft.llm import shared
from docweft.llm.graphs import Labels, components

PLAIN = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}


@pytest.fixture
def without_adaptive(spark):
    """No adaptive execution and no broadcast of Spark's own choice, so that the plan alone deals the rows."""
    before = {k: spark.conf.get(k) for k in PLAIN}
    for k, v in PLAIN.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def sizes(df):
    found = {r[0]: r[1] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    return max(found.values()), median(found.values()), sum(found.values())


@pytest.mark.parametrize("members", [20_000, 200_000])
def test_a_list_of_many_members_is_dealt_over_all_tasks(spark, without_adaptive, members):
    lists = spark.range(members + 20_000).selectExpr(f"CASE WHEN id < {members} THEN -1 ELSE id % 4000 END AS value", "id AS rep")
    by_value = shared.stored(lists.groupBy("value").agg(F.count("*").alias("m"), F.min("rep").alias("a")), "by-value")
    found = shared.spread_join(lists, by_value.filter("value != 7"), "value", shared.hot_keys(by_value, "value", "m"))
    largest, middle, total = sizes(found)
    assert total == members + 20_000 - 5 and largest <= 2 * middle
    plain = lists.join(by_value, "value").filter("value != 7")
    assert found.exceptAll(plain.select(*found.columns)).isEmpty() and plain.select(*found.columns).exceptAll(found).isEmpty()


def test_hot_keys_are_bounded_and_null_keys_drop_out(spark):
    rows = spark.createDataFrame([(None, 1), (1, 2), (1, 3), (2, 4)], "k long, x long")
    by = shared.stored(rows.groupBy("k").agg(F.count("*").alias("n")), "by")
    assert sorted(map(tuple, shared.spread_join(rows, by, "k", shared.hot_keys(by.filter("k = 1"), "k", "n")).collect())) == [(1, 2, 2), (1, 3, 2), (2, 4, 1)]
    even = spark.range(5000).selectExpr("id AS k", "1 AS n")
    assert shared.hot_keys(even, "k", "n").count() == 0


def test_components_of_a_hub(spark, without_adaptive):
    hub = spark.range(1, 3000).selectExpr("id AS a", "5000 AS b").unionByName(spark.createDataFrame([(6000, 5999), (5999, 3)], "a long, b long"))
    got = {r.node: r.component for r in components(hub).collect()}
    assert len(got) == 3002 and set(got.values()) == {1}
    labels = Labels()
    for edges in (hub, spark.range(7000, 7500).selectExpr("id AS a", "2 AS b"), spark.createDataFrame([(9000, 9001)], "a long, b long")):
        labels.add(edges)
    assert {r.component for r in labels.table.filter("node < 8000").collect()} == {1} and labels.table.count() == 3504


def test_streams_keep_their_own_scratch(spark):
    """What one thread writes inside its ``scratch`` is not deleted by another that ends first."""
    first, second, out = threading.Event(), threading.Event(), {}

    def work(name, mine, other):
        with shared.scratch(spark) as made:
            table = shared.stored(spark.range(5), name)
            mine.set()
            other.wait(60)
            out[name] = (table.count(), list(made))

    threads = [threading.Thread(target=work, args=("a", first, second)), threading.Thread(target=work, args=("b", second, first))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert out["a"][0] == out["b"][0] == 5 and [len(v[1]) for v in out.values()] == [1, 1] and out["a"][1] != out["b"][1]
