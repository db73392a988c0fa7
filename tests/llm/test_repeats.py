import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from docweft.llm import repeats
from docweft.llm.textvec import flat, word_names, words

SCHEMA = "doc_id long, text string, n_words string, at int"


def brute(texts, width):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(d[i : i + width]) for d in docs for i in range(len(d) - width + 1))
    out = []
    for d in docs:
        gone = set()
        for i in range(len(d) - width + 1):
            if seen[tuple(d[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = [w for i, w in enumerate(d) if i not in gone]
        out.append((len(d), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), " ".join(kept)))
    return out


def texts_with_repeats(rng, n=60):
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "ß", "x" * 300]
    passages = [rng.choices(vocabulary, k=k) for k in (20, 34, 35, 36, 50, 120)]
    base = rng.choices(vocabulary, k=300)
    texts = []
    for i in range(n):
        kind = i % 6
        body = rng.choices(vocabulary, k=rng.randrange(0, 120))
        if kind == 0:
            body = body + rng.choice(passages) + rng.choices(vocabulary, k=40) + rng.choice(passages)
        elif kind == 1:
            body = list(base)
            for _ in range(rng.randrange(0, 8)):
                body[rng.randrange(300)] = rng.choice(vocabulary)
        elif kind == 2:
            body = body + ["same"] * rng.randrange(10, 90) + body[:5]
        elif kind == 3:
            body = body + rng.choice([["a", "b"], ["a", "b", "c"], ["a", "a", "b"]]) * rng.randrange(5, 40)
        elif kind == 4 and texts:
            body = (rng.choice(texts) or "").split()
        sep = rng.choice([" ", "\n", "  ", "\t \r\n"])
        texts.append(sep.join(body))
    return [*texts, "", None, " \n ", "one"]


def check(spark, texts, width):
    want = brute(texts, width)
    docs = spark.createDataFrame([(i, t, "mine", 3) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: r for r in repeats.without_repeats(docs, width).collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == w[:3], (i, texts[i][:80])
    kept = {r.doc_id: r.kept for r in repeats.kept_texts(docs, width).collect()}
    assert kept == {i: w[3] for i, w in enumerate(want) if w[1]}


def test_against_brute_force(spark):
    check(spark, texts_with_repeats(random.Random(1)), 35)
    check(spark, texts_with_repeats(random.Random(2), 40), 8)


def test_many_random_batches_in_the_kernel():
    """Equal windows have equal representatives, and every window belongs to one instance."""
    for seed in range(30):
        rng = random.Random(seed)
        alphabet = [f"t{i}" for i in range(rng.choice([1, 2, 3, 8, 50]))]
        texts = [" ".join(rng.choices(alphabet, k=rng.randrange(0, 60))) for _ in range(12)]
        texts += [t + " " + " ".join(rng.choices(alphabet, k=4)) for t in texts[:4]]
        width = rng.choice([3, 5, 12, 20])
        found = words(*flat(pa.array(texts)))
        name = word_names(found)
        h, span, begin, n = repeats.instances(name, found.first, width, repeats.WordDigests(found))
        windows = [i for a, b in zip(found.first[:-1], found.first[1:]) for i in range(a, b - width + 1)]
        assert [i + k for i, m in zip(begin.tolist(), n.tolist()) for k in range(m)] == windows
        by_content, by_span = {}, {}
        for x, sp, i, m in zip(h.tolist(), span.tolist(), begin.tolist(), n.tolist()):
            for k in range(m):
                assert by_content.setdefault(tuple(name[i + k : i + k + width].tolist()), x) == x
            assert by_span.setdefault((x, sp), tuple(name[i : i + m + width - 1].tolist())) == tuple(name[i : i + m + width - 1].tolist())


def test_need_fixes_the_symbol():
    """A symbol occurs wherever the words of its need do, at the same offset."""
    rng = np.random.default_rng(0)
    base = rng.integers(0, 40, 400).astype(np.uint64)
    for _ in range(10):
        cut = int(rng.integers(0, 200))
        other = np.concatenate([rng.integers(0, 40, 30).astype(np.uint64), base[cut : cut + 150], rng.integers(0, 40, 30).astype(np.uint64)])
        a, b = (repeats.recompressed(x, np.array([0, len(x)])) for x in (base, other))
        for level in (1, 2, 3):
            there = {(int(s), int(lo), int(hi)): int(n) for s, lo, hi, n in zip(b[level].start, b[level].lo, b[level].hi, b[level].name)}
            shared = 0
            for s, lo, hi, n in zip(a[level].start, a[level].lo, a[level].hi, a[level].name):
                if lo >= cut and hi <= cut + 150:
                    move = 30 - cut
                    assert there[(int(s) + move, int(lo) + move, int(hi) + move)] == int(n)
                    shared += 1
            assert shared > 20


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = " ".join(f"u{i}" for i in range(40))
    docs = spark.createDataFrame([(5, text), (5, text), (None, text + " tail"), (None, None), (6, "short")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in repeats.without_repeats(docs).collect())
    assert got == [(0, 0, 0), (0, 41, 40), (5, 40, 40), (5, 40, 40), (6, 1, 0)]
    assert repeats.without_repeats(docs.limit(0)).count() == 0
    alone = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert repeats.without_repeats(alone).first().n_removed == 0
