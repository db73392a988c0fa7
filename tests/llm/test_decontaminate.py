import random

import numpy as np
import pytest

from docweft.llm import decontaminate as dc


def plain_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 25)), rng.integers(0, 5, rng.integers(0, 60))
        score, start, end = dc.align(a, b)
        assert score == plain_align(a, b)
        assert plain_align(a, b[start:end]) == score and 0 <= start <= end <= len(b)


@pytest.fixture
def tables(spark):
    rng = random.Random(1)
    common, vocabulary = ["the", "of", "and", "to"], [f"word{i}" for i in range(4000)]

    def prose(n):
        return [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]

    items = [prose(rng.randrange(16, 50)) for _ in range(30)]
    docs, want = [], set()
    for i in range(200):
        body = prose(rng.randrange(20, 200))
        at = rng.randrange(len(body))
        if i % 4 == 0:
            k = rng.randrange(30)
            copy = [w.upper() + "," for w in items[k]]
            if i % 8 == 0:  # an edited copy: words changed, one dropped, one put in
                for _ in range(len(copy) // 7):
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
                del copy[len(copy) // 2]
                copy.insert(len(copy) // 3, "extra")
            body[at:at] = copy
            want.add((i, k))
        docs.append((i, " ".join(body), "x", 1.0))
    docs += [(500, None, None, None), (501, "", "x", 1.0), (502, "the of and to " * 20000, "x", 1.0), (0, docs[0][1], "x", 1.0), (None, " ".join(items[3]), "x", 1.0)]
    want |= {(None, 3)}
    bench = [(i, " ".join(w)) for i, w in enumerate(items)] + [(100, None), (101, ""), (102, "the of")]
    return spark.createDataFrame(docs, "doc_id long, text string, item_id string, score double"), spark.createDataFrame(bench, "item_id long, text string"), want


@pytest.mark.parametrize("block_bytes", [8 << 20, 1500])
def test_copies_and_edited_copies_are_found(tables, block_bytes):
    docs, bench, want = tables
    rows = dc.leaks(docs, bench, block_bytes=block_bytes).collect()
    assert {(r.doc_id, r.item_id) for r in rows if r.item_id < 100} == want
    assert all(0.5 <= r.similarity <= 1 and r.from_word < r.to_word for r in rows)
    assert sum(r.doc_id == 0 for r in rows if r.item_id < 100) == 2
    exact = [r for r in rows if r.doc_id is not None and r.doc_id % 8 == 4 and r.item_id < 100]
    assert exact and all(r.similarity == 1 for r in exact)


def test_every_pair_that_aligns_is_seeded(tables):
    """Seeds lose no pair that alignment of whole texts with whole items finds."""
    docs, bench, _ = tables
    items = {r.item_id: (r.text or "").split() for r in bench.collect() if r.item_id < 100}
    found = {(r.doc_id, r.item_id) for r in dc.leaks(docs, bench).collect()}
    for r in docs.filter("doc_id between 0 and 60").collect():
        words = [w.strip(",").lower() for w in r.text.split()]
        for k, item in items.items():
            names = {w: j for j, w in enumerate(dict.fromkeys([*words, *item]))}
            score, *_ = dc.align(np.array([names[w] for w in item]), np.array([names[w] for w in words]))
            assert ((r.doc_id, k) in found) == (score >= 0.5 * 2 * len(item))


def test_filter_and_empty_tables(tables):
    docs, bench, want = tables
    kept = dc.decontaminated(docs, bench.filter("item_id < 100"))
    assert kept.columns == docs.columns
    gone = {i for i, _ in want}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - gone
    assert dc.leaks(docs, bench.limit(0)).count() == 0 and dc.leaks(docs.limit(0), bench).count() == 0


def test_copies_without_a_common_4_gram_are_found(spark):
    """Every 4th word replaced, or a word put in after every 3rd: such copies reach the bound and are found as by alignment of whole texts."""
    rng = random.Random(2)
    common, vocabulary = ["the", "of", "and", "to"], [f"word{i}" for i in range(3000)]

    def prose(n):
        return [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]

    items = [prose(m) for m in range(15, 60, 2)]
    docs = []
    for item in items:
        docs.append([w if j % 4 != 3 else f"new{rng.randrange(99)}" for j, w in enumerate(item)])
        docs.append([x for j, w in enumerate(item) for x in ([w, "extra"] if j % 3 == 2 else [w])])
        for share in (0.2, 0.3, 0.4):
            docs.append([w if rng.random() > share else rng.choice(vocabulary) for w in item])
    docs = [prose(40) + d + prose(60) for d in docs]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in dc.leaks(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string"), bench).collect()}
    want = {}
    for i, doc in enumerate(docs):
        for k, item in enumerate(items):
            names = {w: j for j, w in enumerate(dict.fromkeys([*doc, *item]))}
            score, *_ = dc.align(np.array([names[w] for w in item]), np.array([names[w] for w in doc]))
            if score >= 0.5 * 2 * len(item):
                want[i, k] = score
    assert found == want
    assert all((5 * k + j, k) in found for k in range(len(items)) for j in (0, 1))


@pytest.mark.parametrize(("kind", "make"), [("int", int), ("string", lambda i: "" if i == 0 else f"id-{i}"), ("long", int)])
def test_ids_of_any_type(spark, kind, make):
    rng = random.Random(4)
    items = [[f"word{rng.randrange(500)}" for _ in range(20)] for _ in range(6)]
    bench = [(make(i), " ".join(w)) for i, w in enumerate(items)] + [(None, " ".join(items[2]))]
    docs = [(make(i), " ".join(items[i]) + " and more text") for i in range(4)] + [(None, "x " + " ".join(items[5]))]
    for block_bytes in (8 << 20, 300):
        got = {(r.doc_id, r.item_id) for r in dc.leaks(spark.createDataFrame(docs, f"doc_id {kind}, text string"), spark.createDataFrame(bench, f"item_id {kind}, text string"), block_bytes=block_bytes).collect()}
        assert got == {(make(i), make(i)) for i in range(4)} | {(make(2), None), (None, make(5))}
