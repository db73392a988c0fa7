import random
import re
from collections import Counter

from docweft.llm import minhash
from docweft.llm.graphs import components

SCHEMA = "doc_id long, text string, component_id string, n_shingles int"


def sets(rows, width):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
        out[i] = {tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()
    return out


def brute(rows, width):
    s = sets(rows, width)
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(s)
    for p, i in enumerate(ids):
        for j in ids[:p]:
            both = len(s[i] & s[j])
            if s[i] and 100 * both >= 80 * (len(s[i]) + len(s[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}, s


def rows_with_groups(rng):
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=25)
    rows, at = [], 0

    def add(words):
        nonlocal at
        rows.append((at, " ".join(words), "mine", 5))
        at += 1

    for _ in range(120):  # unrelated texts that share a passage
        add(rng.choices(vocabulary, k=60) + passage)
    base = rng.choices(vocabulary, k=120)
    for _ in range(90):  # near copies of one text, some of them only linked by others
        copy = list(base)
        for _ in range(rng.randrange(0, 7)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        add(copy)
    chain = rng.choices(vocabulary, k=200)
    for _ in range(12):  # a chain whose ends are far apart
        add(chain)
        chain = chain[8:] + rng.choices(vocabulary, k=8)
    for n in (1, 2, 3, 4, 5, 9):  # very short texts, twice each, and one with a word more
        words = rng.choices(vocabulary, k=n)
        add(words)
        add([w.upper() for w in words])
        add([*words, "more"])
    rng.shuffle(rows)
    return [(i, *r[1:]) for i, r in enumerate(rows)]


def test_components_against_brute_force(spark):
    for seed, width in ((1, 4), (2, 5)):
        rows = rows_with_groups(random.Random(seed))
        rows += [(9001, None, None, None), (9002, "", "x", 1), (9003, " \n\t", "x", 1), (9004, "long text here " * 40000, "x", 1)]
        want, s = brute(rows, width)
        got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), width=width).collect()
        assert {r.doc_id: r.component_id for r in got} == want
        assert {r.doc_id: r.n_shingles for r in got} == {i: len(x) for i, x in s.items()}
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
        assert max(Counter(want.values()).values()) > 40


def test_small_rounds_still_find_everything(spark, monkeypatch):
    monkeypatch.setattr(minhash, "ROUND", 4)
    monkeypatch.setattr(minhash, "FREQUENT", 2)
    rows = rows_with_groups(random.Random(3))[::2]
    want, _ = brute(rows, 4)
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), width=4).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = "one two three four five six seven"
    rows = [(7, text), (3, text), (3, text), (None, text), (None, "quite another text with words"), (4, "something else over here now")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert len(got) == 6
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id) == [(3, 3, True), (3, 3, True), (4, 4, True), (7, 3, False)]
    assert sorted((r.component_id or 0, r.kept) for r in got if r.doc_id is None) == [(0, False), (3, False)]
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 5), (7, 7), (200, 100)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got[160] == 100 and got[200] == 100 and got[9] == 5 and got[5] == 5 and 7 not in got


def test_ids_of_other_types_and_clashing_columns(spark):
    text = "one two three four five six seven"
    rows = [("b", text, 1), ("a", text + " eight", 2), ("", "quite another text with words", 3), (None, text, 4), ("c", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, rep int").withColumnRenamed("rep", "component_id")
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(docs, width=4, percent=80).collect()}
    assert got == {"b": ("a", False), "a": ("a", True), "": ("", True), None: ("a", False), "c": ("c", True)}
    assert {r.doc_id for r in minhash.deduplicated(docs, width=4, percent=80).collect()} == {"a", "", "c"}
    assert {r.doc_id for r in minhash.deduplicated(docs.filter("doc_id IS NULL"), width=4).collect()} == {None}


def test_jobs_hardly_grow_with_the_group(spark):
    """Four times the near copies in a group take at most one round more."""
    from pyspark import SparkContext

    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]

    def copies(n):
        out = []
        for i in range(n):
            copy = list(base)
            for _ in range(rng.randrange(1, 5)):
                copy[rng.randrange(150)] = f"w{rng.randrange(5000)}"
            out.append((i, " ".join(copy)))
        return spark.createDataFrame(out, "doc_id long, text string")

    jobs = []
    for n in (300, 1200):
        spark.sparkContext.setJobGroup(f"copies-{n}", "")
        found = minhash.near_duplicates(copies(n), width=4).select("component_id").distinct().count()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"copies-{n}")))
        assert found < n / 10
    SparkContext._active_spark_context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= 1.4 * jobs[0]


def test_texts_made_of_common_passages_only(spark, monkeypatch):
    """Links that only long lists tell: every member outside has its turn, whatever is linked before."""
    monkeypatch.setattr(minhash, "ROUND", 2)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(12)
    passages = [[f"p{i}w{j}" for j in range(14)] for i in range(16)]
    rows = [(i, " ".join(w for p in sorted(rng.sample(range(16), 12)) for w in passages[p])) for i in range(90)]
    want, _ = brute([(i, t) for i, t in rows], 4)
    assert 5 < len(set(want.values())) < 85
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert {r.doc_id: r.component_id for r in got} == want
