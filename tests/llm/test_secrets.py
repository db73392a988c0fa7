import hashlib
import random
import re

from docweft.llm import secrets

SCHEMA = "doc_id long, text string, n_hex string, kinds int"
CHARSET = "[A-Za-z0-9+/_.=-]"
PLAIN = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
    "github": (re.compile(r"gh[pousr]_[A-Za-z0-9]+"), 0, 40),
    "slack": (re.compile(r"xox[abprs]-[A-Za-z0-9-]+"), 0, 15),
    "jwt": (re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+"), 0, 24),
    "key": (re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), 0, 0),
}


def brute(text):
    out = []
    for rank, (kind, (pattern, group, least)) in enumerate(PLAIN.items()):
        out += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    out.sort()
    spans = [f"{k}:{a}:{b}" for a, _, k, b in out]
    base = [s for s, o in zip(spans, out) if o[1] < 3]
    count = [sum(o[2] == k for o in out) for k in ("assign", "access", "hex")]
    return (*count, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(spans)), out


def texts(rng):
    pieces = ["password", "PassWd", "secret", "api_key", "APIKEY", "token", "tok", '"', "'", " ", "  ", ":", "=", "é", "日本", "😀", "\n", "AKIA", "AKI", "abcdef0123456789", "0123456789abcdef" * 2, "ABCDEFGH12345678", "short", "longvalue1234", "/+=._-", "ghp_", "a" * 40, "xoxb-", "eyJhbGciOi", ".eyJzdWIiOi", "-----BEGIN RSA PRIVATE KEY-----", "\ue000", "\ue001", "plain words here", "\\", "$0"]
    return ["".join(rng.choices(pieces, k=rng.randrange(1, 40))) for _ in range(250)]


def test_spans_against_python(spark):
    some = texts(random.Random(1))
    some += ["", None, "token: secret: abcdefghijkl", "nothing " * 50000 + "password=abcdefgh12 " + "x" * 1000, "token=abc token=abcdefgh token='abcdefgh'"]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(some)], SCHEMA).repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in secrets.secret_report(docs).collect()}
    assert len(got) == len(some)
    for i, t in enumerate(some):
        assert got[i] == brute(t)[0], repr(t)[:300]


def test_small_blocks_and_shuffled_candidates(spark, monkeypatch):
    monkeypatch.setattr(secrets, "BLOCK_ROWS", 7)
    monkeypatch.setattr(secrets, "BROADCAST_ROWS", 0)
    some = texts(random.Random(2))[:80]
    rows = [(i, t) for i, t in enumerate(some)] + [(3, some[3]), (3, "token=abcdefgh99"), (None, "secret: abcdefgh1"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, *tuple(r)[1:]) for r in secrets.secret_report(docs).collect())
    assert got == sorted((i if i is not None else -1, *brute(t)[0]) for i, t in rows)
    assert secrets.secret_report(docs.limit(0)).count() == 0


def test_queries_hold_for_every_match():
    """The trigram query of a rule is true for every text that the rule matches, and mandatory trigrams are found."""
    by = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert by["hex"] == [frozenset()] and frozenset({"aki", "kia"}) in by["access"] and len(by["assign"]) == 6
    for t in texts(random.Random(3)):
        low = t.lower()
        for kind, (pattern, *_ ) in PLAIN.items():
            if pattern.search(t):
                assert any(all(g in low for g in clause) for clause in by[kind])
    assert secrets.trigram_query("abc(de|fg)h+") == [frozenset({"abc", "bcd", "cde"}), frozenset({"abc", "bcf", "cfg"})]
    for pattern, sample in [("abc(de|fg)h+xyz", "abcfghhhxyz"), ("(one|two|[0-9]+three)?four", "four"), ("a{2,3}bcd", "aaabcd"), ("(abc)+d", "abcabcd"), ("x*", "")]:
        assert re.fullmatch(pattern, sample)
        assert any(all(g in sample for g in clause) for clause in secrets.trigram_query(pattern))


def test_redaction(spark):
    some = [t for t in texts(random.Random(4))[:60] if "\ue000" not in t]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(some)], SCHEMA)
    out = secrets.redacted(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        want, at = "", 0
        for a, _, kind, b in brute(some[r.doc_id])[1]:
            if a >= at:
                want += some[r.doc_id][at:a] + f"[{kind}]"
            at = max(at, b)
        assert r.text == want + some[r.doc_id][at:]


def test_many_secrets_in_one_text_cost_no_square(spark):
    """Twice the secrets in one text take about twice the time, in reports and when redacted."""
    import time

    def taken(n):
        text = " ".join(f"token = abcdefgh{i}" for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        row = secrets.secret_report(docs).first()
        out = secrets.redacted(docs).first()
        assert row.n_assign == n and out.text == " ".join(["[assign]"] * n)
        return time.perf_counter() - began

    taken(100)
    assert taken(40_000) < 3 * taken(20_000) + 1
