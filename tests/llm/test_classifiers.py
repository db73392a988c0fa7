import re
import zlib

import numpy as np
import pyarrow as pa

from docweft.llm import learning, quality, toxicity
from docweft.llm.textvec import ALNUM, Spans, flat, mix64

GOOD = ["A calm sentence, with several different words in it. Another follows here, number {i}.", "The river ran past old houses, and people {i} talked on the bridge."]
BAD = ["BUY!! NOW!! BUY!! NOW!! {i}!!", "menu | menu | home | {i} | home | menu", "word word word word word word {i}"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, held_out int"


def corpus(spark, make, n=240):
    rows, labels = [], []
    for i in range(n):
        y = i % 3 != 0
        rows.append((i, make(i, y), "en", "s", 1, "x", 3))
        labels.append((i, int(y), int(not y)))
    rows += [(1000, None, None, None, None, None, None), (1001, "", "en", "s", 0, "x", 3), (1002, "long words " * 30000, "en", "s", 1, "x", 3), (0, rows[0][1], "en", "s", 1, "x", 3), (None, "no id", None, None, None, None, None)]
    labels += [(5000, 1, 0), (None, 1, 1), (7, None, None)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(doc_id, modulus, remainder):
    return zlib.crc32(str(doc_id).encode()) % modulus == remainder


def test_quality(spark):
    docs, labels = corpus(spark, lambda i, y: (GOOD if y else BAD)[i % (2 if y else 3)].format(i=i))
    out = quality.quality_scores(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == held(r.doc_id, 5, 0) for r in rows if r.doc_id is not None)
    known = [r for r in rows if r.doc_id is not None and r.doc_id < 240]
    assert np.mean([r.predicted == (r.doc_id % 3 != 0) for r in known]) > 0.97
    same = {r.score for r in rows if r.doc_id == 0}
    assert len(same) == 1
    assert all(r.score == 0.5 for r in quality.quality_scores(docs, labels.limit(0)).collect())
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_quality_learns_from_all_labelled_rows(spark, monkeypatch):
    """Every labelled row with a text that is not held out counts, and the cut leaves the labelled share of them below."""
    rng = np.random.default_rng(1)
    ids = range(9000)
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in rng.integers(0, 30, 6) + 8 * (i % 4 == 0))) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in [*ids, 20_000, 20_001]], "doc_id long, quality int")
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows, *rest: seen.append(rows.count()) or fit(rows, *rest))
    model = quality.train(docs, labels)
    known = [i for i in ids if not held(i, 5, 0)]
    assert seen == [len(known)]
    texts = {r.doc_id: r.text for r in docs.collect()}
    worth = model.worth(*flat(pa.array([texts[i] for i in known])))
    assert abs(np.mean(worth < model.cut) - np.mean([i % 4 == 0 for i in known])) < 0.01


def test_quality_features_match_a_plain_count():
    texts = ["a b a\nB b b!", "", None, "x1 | y2%%%", "é É"]
    x = quality.features(*flat(pa.array(texts)))
    at = quality.FEATURES.index
    words = texts[0].split()
    assert np.isclose(x[0, at("distinct_words")], len(set(words)) / len(words))
    assert np.isclose(x[0, at("repeated_word")], 0 + 0)
    assert np.isclose(x[3, at("lone_symbols")], 1 / 3) and np.isclose(x[3, at("digits")], 2 / len(texts[3]))
    assert not x[1].any() and not x[2].any()


def test_toxicity_learns_an_interaction(spark):
    rng = np.random.default_rng(0)
    filler = [f"word{j}" for j in range(60)]

    def make(i, clean):
        some = list(rng.choice(filler, 12))
        if not clean:
            some[3:5] = ["you", "clot"]  # both together are toxic; either alone is not
        elif i % 3 == 1:
            some[3] = "clot"
        else:
            some[3] = "you"
        return " ".join(some)

    docs, labels = corpus(spark, make, 600)
    rows = toxicity.toxicity_scores(docs, labels).collect()
    known = [r for r in rows if r.doc_id is not None and r.doc_id < 600 and r.held_out]
    assert all(r.held_out == held(r.doc_id, 4, 2) for r in known) and len(known) > 80
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in known]) > 0.97
    assert len(rows) == docs.count()
    share = {round(r.score, 3) for r in toxicity.toxicity_scores(docs, labels.limit(0)).collect()}
    assert share == {0.5}
    kept = toxicity.toxicity_filter(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert {1000, 1001, 1002, None} <= ids and np.mean([(i in ids) == (i % 3 != 0) for i in range(600)]) > 0.97
    assert toxicity.toxicity_filter(docs.limit(0), labels).count() == 0


def test_terms_are_words_and_their_beginnings():
    doc, _, count = toxicity.terms(*flat(pa.array(["Abcdefgh, abcdefgh!", None, "ab"])))
    assert np.bincount(doc).tolist() == [5, 0, 1] and count[:5].tolist() == [2] * 5


def test_sample_takes_ids_that_have_a_text(spark):
    """Labels of ids without a text take no place in the sample; ids with several labels or texts count once."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(0, "another"), (1, None), (50, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4000)] + [(0, 1), (3, 0), (2, None), (None, 1)], "doc_id long, quality int")
    rows = learning.labelled_sample(docs, labels, "quality", 5, 0, 20).collect()
    want = {i for i in range(40) if not held(i, 5, 0)}
    assert {r.doc_id for r in rows if r.label == 1} <= want and len(rows) == len({r.doc_id for r in rows})
    assert {r.doc_id: r.label for r in rows} == {i: 0 if i == 3 else i % 2 for i in want}
    assert {r.text for r in rows if r.doc_id == 0} <= {"another"}
    few = learning.labelled_sample(docs, labels, "quality", 5, 0, 3).collect()
    assert sorted(r.label for r in few) == [0, 0, 0, 1, 1, 1]


TEXTS = ["You awful clot, you clot", "a b a b. C!", "", None, "word " * 50 + "clot 12", "É ü ß | || 9"]  # of up to one window


def plain_words(text):
    out = []
    for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
        w = bytes(c + 32 if 65 <= c < 91 else c for c in w)
        for _ in range(4):
            w = w[1:] if len(w) > 1 and not ALNUM[w[0]] else w
            w = w[:-1] if len(w) > 1 and not ALNUM[w[-1]] else w
        out.append(w)
    return out


def name(word):
    return int(Spans(np.frombuffer(word, np.uint8))(np.array([0]), np.array([len(word)]))[0])


def test_factorization_machine_against_the_double_sum():
    rng = np.random.default_rng(3)
    slot = np.where(rng.random(1 << toxicity.BITS) < 0.5, np.arange(1 << toxicity.BITS) % 50, -1).astype(np.int32)
    machine = toxicity.Machine(slot, -0.4, rng.normal(size=50), rng.normal(size=(50, 3)))
    got = machine.score(*flat(pa.array(TEXTS)))
    for text, score in zip(TEXTS, got):
        x = np.zeros(50)
        for w in plain_words(text):
            for n in (0, *toxicity.PREFIXES):
                if not n or len(w) > n:
                    bucket = (name(w[:n] if n else w) ^ (n * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> (64 - toxicity.BITS)
                    if slot[bucket] >= 0:
                        x[slot[bucket]] += 1
        x = np.log2(1 + x)
        z = machine.bias + machine.linear @ x + sum(machine.vectors[i] @ machine.vectors[j] * x[i] * x[j] for i in range(50) for j in range(i + 1, 50))
        assert np.isclose(score, 1 / (1 + np.exp(-z)))


def test_texts_have_the_largest_score_of_their_windows(monkeypatch):
    monkeypatch.setattr(toxicity, "STEP", 2)
    texts = ["a b c d e f g", "", None, "one two", " x  y z w ", "q " * 9, "a b c d e"]
    windows = [["a b c d", "c d e f", "e f g"], [""], [""], ["one two"], ["x y z w"], ["q q q q"] * 3 + ["q q q"], ["a b c d", "c d e"]]
    rng = np.random.default_rng(6)
    slot = (np.arange(1 << toxicity.BITS) % 40).astype(np.int32)
    model = toxicity.Machine(slot, -0.2, rng.normal(size=40), rng.normal(size=(40, 2)))
    first = toxicity.window_terms(*flat(pa.array(texts)), slot)[0]
    assert np.diff(first).tolist() == [len(w) for w in windows]
    single = [model.score(*flat(pa.array(w))) for w in windows]
    assert all(len(x) == len(w) for x, w in zip(single, windows))
    assert np.allclose(model.score(*flat(pa.array(texts))), [x.max() for x in single])
    assert len(model.score(*flat(pa.array([], pa.string())))) == 0


def test_the_length_of_a_text_does_not_decide(spark):
    """Clean texts of up to 16 times the longest in the sample are left alone, and caught once a toxic text is added at any place."""
    rng = np.random.default_rng(9)
    filler = [f"word{j}" for j in range(400)]

    def make(i, clean):
        some = list(rng.choice(filler, rng.integers(5, 400)))
        for at in range(0, 0 if clean else len(some), 25):
            some[at] = ["clot", "oaf", "wretch"][rng.integers(3)]
        return " ".join(some)

    docs, labels = corpus(spark, make, 900)
    model = toxicity.train(docs, labels)
    toxic = make(0, False)
    for size in (400, 1600, 6400):
        plain = [list(rng.choice(filler, size)) for _ in range(30)]
        assert (model.score(*flat(pa.array([" ".join(p) for p in plain]))) < 0.3).mean() >= 0.9
        spoilt = [" ".join([*p[: (at := rng.integers(size))], toxic, *p[at:]]) for p in plain]
        assert (model.score(*flat(pa.array(spoilt))) >= 0.3).mean() >= 0.9


def test_worth_against_a_plain_sum():
    rng = np.random.default_rng(4)
    k = len(quality.FEATURES)
    slot = np.where(rng.random(1 << quality.BITS) < 0.7, np.arange(1 << quality.BITS) % 40, -1).astype(np.int32)
    model = quality.Ranking(rng.normal(size=k), np.abs(rng.normal(size=k)) + 0.5, rng.normal(size=2 * k), slot, rng.normal(size=40), 0.2)
    got = model.worth(*flat(pa.array(TEXTS)))
    for text, worth in zip(TEXTS, got):
        words = plain_words(text)
        names = [name(w) for w in words]
        names += [int(mix64(np.array([a * 0xA0761D6478BD642F + b & (2**64 - 1)], dtype=np.uint64))[0]) for a, b in zip(names, names[1:])]
        count = {}
        for n in names:
            if slot[n >> (64 - quality.BITS)] >= 0:
                count[slot[n >> (64 - quality.BITS)]] = count.get(slot[n >> (64 - quality.BITS)], 0) + 1
        z = (quality.features(*flat(pa.array([text])))[0] - model.mean) / model.scale
        want = quality.expanded(z[None])[0] @ model.weights + sum(model.term_weights[s] * np.log2(1 + 1000 * c / len(words)) / 4 for s, c in count.items())
        assert np.isclose(worth, want)


def test_ranking_learns_from_terms():
    """Texts that only their words tell apart."""
    rng = np.random.default_rng(5)
    filler = [f"w{i:03d}" for i in range(200)]
    label = rng.integers(0, 2, 400)
    texts = pa.array([" ".join([*rng.choice(filler, 20), "alpha" if y else "omega", *rng.choice(filler, 20)]) for y in label])
    doc, bucket, value = quality.terms(*flat(texts))
    best, times = np.unique(bucket, return_counts=True)
    best = best[times >= 3]  # as the operator's choice of buckets
    slot = np.full(1 << quality.BITS, -1, dtype=np.int32)
    slot[best] = np.arange(len(best))
    own = slot[bucket] >= 0
    doc, bucket, value = doc[own], bucket[own], value[own]
    t = np.zeros((400, len(best)), dtype=np.float32)
    t[doc, slot[bucket]] = value
    model = quality.fit(quality.features(*flat(texts.slice(0, 300))), t[:300], label[:300], slot, float((label[:300] == 0).mean()), 5000)
    assert np.mean((model.score(*flat(texts.slice(300))) >= 0.3) == label[300:]) > 0.95
