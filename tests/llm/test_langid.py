import zlib

import numpy as np
import pyarrow as pa

from docweft.llm import langid
from docweft.llm.textvec import flat


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    h, k = 3, 2
    params = []
    for _ in range(2):
        params += [rng.normal(0, 0.3, (3 * h, 257)), rng.normal(0, 0.3, (3 * h, h)), rng.normal(0, 0.1, (h, 1))]
    params += [rng.normal(0, 0.5, (k, 2 * h)), np.zeros((k, 1))]
    x = rng.integers(97, 100, (7, 4))
    x[5:, 1] = langid.PADDING
    y = np.array([0, 1, 1, 0])
    _, grads = langid.loss_and_gradients(params, x, y)
    for p, g in zip(params, grads):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in p.shape)
            if p.shape[-1] == 257:
                at = (at[0], int(rng.integers(97, 100)))
            old, eps = p[at], 1e-5
            p[at] = old + eps
            up = langid.loss_and_gradients(params, x, y)[0]
            p[at] = old - eps
            down = langid.loss_and_gradients(params, x, y)[0]
            p[at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 1e-5


def test_fast_and_training_passes_agree_and_every_byte_counts_once():
    rng = np.random.default_rng(1)
    x = rng.integers(97, 123, (langid.PIECE, 30))
    net = langid.fit(x, rng.integers(0, 2, 30), ["a", "b"], hidden=4, epochs=1)
    kept = langid._states(net.ways[0], x, range(langid.PIECE))
    out = np.empty((langid.PIECE, 4, 30), dtype=np.float32)
    langid.run_direction(*net.ways[0], x, range(langid.PIECE), out, None)
    assert np.allclose(out[-1], kept[-1][-1], atol=1e-5)
    texts = pa.array(["x" * n for n in (0, 1, 255, 256, 257, 900)])
    seen = np.zeros(6, dtype=int)
    for x, doc, fresh in langid.spans(*flat(texts)):
        np.add.at(seen, doc, fresh.sum(axis=0))
    assert seen.tolist() == [0, 1, 255, 256, 257, 900]


def test_languages(spark):
    rng = np.random.default_rng(2)
    words = {"aa": ["kama", "laka", "mala"], "bb": ["föne", "göte", "söde"]}
    rows = [(i, " ".join(rng.choice(words[lang], 20)), lang, "s", 1, "mine") for i in range(300) for lang in [("aa", "bb")[i % 2]]]
    rows += [(900, None, "aa", None, None, None), (901, "", "bb", "s", 1, "x"), (902, "12 34 !!", "aa", "s", 1, "x"), (903, "kama laka " * 20000, None, None, None, None), (0, rows[0][1], "aa", "s", 1, "x"), (None, "laka kama", "aa", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    out = langid.languages_of(docs)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = out.collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert np.mean([by[i].lang_pred == ("aa", "bb")[i % 2] for i in range(300)]) > 0.99
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902))
    assert by[903].lang_pred == "aa" and 0 <= by[903].score <= 1
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert {r.lang_pred for r in langid.languages_of(docs.filter("lang is null")).collect()} == {"und"}
    assert langid.languages_of(docs.limit(0)).count() == 0


def test_network_against_a_plain_loop():
    """Probabilities of whole texts shorter than a span and its context, one byte after the other."""
    rng = np.random.default_rng(7)
    h, k = 4, 3
    ways = [(rng.normal(0, 0.5, (3 * h, 257)).astype(np.float32), rng.normal(0, 0.4, (3 * h, h)).astype(np.float32), rng.normal(0, 0.1, (h, 1)).astype(np.float32)) for _ in range(2)]
    net = langid.Network(["a", "b", "c"], ways, rng.normal(size=(k, 2 * h)).astype(np.float32), rng.normal(size=(k, 1)).astype(np.float32))
    texts = ["Hello wörld 12", "", "x", "y z " * 60, "1 2 3"]
    got = net.documents(*flat(pa.array(texts)))

    def states(way, data):
        table, inner, bias = way
        s, out = np.zeros(h), []
        for c in data:
            a, u = table[:, c], inner @ s
            gate = np.clip(a[: 2 * h] + u[: 2 * h] + 0.5, 0, 1)
            n = np.clip(a[2 * h :] + gate[h:] * (u[2 * h :] + bias[:, 0]), -1, 1)
            s = n + gate[:h] * (s - n)
            out.append(s)
        return out

    for text, p in zip(texts, got):
        data = text.encode()
        both = zip(data, states(ways[0], data), states(ways[1], data[::-1])[::-1])
        labels = [np.exp(z := net.out @ np.concatenate([f, b]) + net.bias[:, 0]) / np.exp(z).sum() for c, f, b in both if langid._LETTER[c]]
        assert np.allclose(p, np.mean(labels, axis=0) if labels else 0, atol=1e-4)


def test_context_carries_the_state_over_the_cuts():
    """Cut into spans, a long text gets nearly the probabilities that one uncut pass gives."""
    rng = np.random.default_rng(8)
    x = rng.integers(97, 123, (langid.PIECE, 40))
    net = langid.fit(x, rng.integers(0, 2, 40), ["a", "b"], hidden=6, epochs=4)
    data = rng.integers(97, 123, 3000).astype(np.uint8)
    cut = net.documents(data, np.array([0, 3000]))[0]
    whole = net.positions(data.astype(np.int64)[:, None])[:, :, 0].mean(axis=0)
    assert np.abs(cut - whole).max() < 0.01


def test_pieces_hold_every_byte():
    data, offs = flat(pa.array(["a" * 130, "", "bc", None]))
    x, doc = langid.pieces(data, offs)
    assert doc.tolist() == [0, 0, 0, 2] and (x != langid.PADDING).sum(axis=1).tolist() == [64, 64, 2, 2]
