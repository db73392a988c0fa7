import math
import random
import re
from collections import Counter

from docweft.llm import lmscore


def brute(rows, targets, share):
    docs = [[w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for _, t, *_ in rows]
    total = Counter(w for d in docs for w in d)
    n = sum(total.values())
    known = {w for w, c in total.items() if c >= max(1.0, share * n)}
    docs = [[w if w in known else None for w in d] for d in docs]
    size = len(known) + 2

    def model(which):
        word, context, pair = Counter(), Counter(), Counter()
        for d in which:
            for a, b in zip(["<s>", *d], d):
                word[b] += 1
                context[a] += 1
                pair[a, b] += 1
        m = sum(word.values())
        return lambda a, b: math.log(context[a] + 2) - math.log(pair[a, b] + 2 * (word[b] + 0.5) / (m + 0.5 * size))

    every, own = model(docs), model([d for r, d in zip(rows, docs) if r[0] is not None and r[0] in targets])
    out = []
    for d in docs:
        pairs = list(zip(["<s>", *d], d))
        k = max(1, len(pairs))
        a, b = sum(own(*p) for p in pairs) / k, sum(every(*p) for p in pairs) / k
        out.append((len(pairs), a, b, a - b))
    return out


def test_scores_equal_brute_force(spark):
    rng = random.Random(0)
    styles = [[f"a{i}" for i in range(12)], [f"b{i}" for i in range(12)]]  # few bigrams: no two share a counter
    rows = [(i, " ".join(rng.choice(styles[i % 2] + ["the", "OF"]) for _ in range(rng.randrange(1, 60))), "x", 1.0) for i in range(120)]
    rows += [(200, None, None, None), (201, "", "x", 1.0), (None, "a1 a2", "x", 1.0), (0, rows[0][1], "x", 1.0), (202, "b1 b2 " * 30000, "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, score double").repartition(3)
    ids = {i for i in range(0, 80, 2)} | {9999}
    targets = spark.createDataFrame([(i,) for i in [*ids, None, 0]], "doc_id long")
    for share in (1e-6, 2e-4):
        want = sorted((r[0] if r[0] is not None else -1, *w) for r, w in zip(rows, brute(rows, ids, share)))
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.target_loss, r.background_loss, r.score) for r in lmscore.lm_scores(docs, targets, share, bits=23).collect())
        assert len(got) == len(want)
        for g, w in zip(got, want):
            assert g[:2] == w[:2] and all(abs(x - y) < 1e-4 for x, y in zip(g[2:], w[2:])), (g, w)
        by = {g[0]: g[4] for g in got}
        assert max(by[i] for i in range(80, 120, 2)) < min(by[i] for i in range(81, 120, 2))


def test_no_targets_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b d")], "doc_id long, text string")
    none = docs.limit(0).select("doc_id")
    assert [r.n_words for r in lmscore.lm_scores(docs, none).collect()] == [3, 3]
    assert lmscore.lm_scores(docs.limit(0), docs.select("doc_id")).count() == 0


def close(got, want):
    got, want = sorted((r.doc_id, r.n_words, r.target_loss, r.background_loss, r.score) for r in got), sorted(want)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(x - y) < 1e-6 for g, w in zip(got, want) for x, y in zip(g[2:], w[2:]))


def test_many_bigrams_are_counted_one_by_one(spark):
    """With the parameters of the query, and some 400,000 distinct bigrams."""
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{int(rng.random() ** 2 * 3000)}" for _ in range(150))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    targets = spark.createDataFrame([(i,) for i in range(0, 3000, 3)], "doc_id long")
    want = [(r[0], *w) for r, w in zip(rows, brute(rows, set(range(0, 3000, 3)), 0))]
    close(lmscore.lm_scores(docs, targets).collect(), want)
    close(lmscore.lm_scores(docs, targets, bits=14).collect(), want)


def test_rare_words_are_known_at_any_size(spark):
    """Beyond a million running words a word that occurs once is still itself."""
    rows = [(i, f"a{i} a{i} b{i} common") for i in range(50)] + [(50, "common filler " * 1_200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    targets = spark.createDataFrame([(i,) for i in range(0, 50, 2)], "doc_id long")
    close(lmscore.lm_scores(docs, targets).collect(), [(r[0], *w) for r, w in zip(rows, brute(rows, set(range(0, 50, 2)), 0))])
