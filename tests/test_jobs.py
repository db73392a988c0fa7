import hashlib
import json
import math
import re
from collections import Counter
from dataclasses import fields

import pytest

from jobs import gather_evidence, index_documents
from jobs.settings import read_settings

SCHEMA = "doc_id long, text string, lang string, source string, term string, letter string, batch int, tf double"
ROWS = [
    (3, "Lamps give light. Lamps burn oil.", "en", "a"),
    (1, "lamps  give light. lamps burn OIL.", "en", "a"),  # the same as 3 but for case and blanks
    (4, "", "en", None),
    (5, None, None, "b"),
    (6, "oil " * 3000 + "wells", "de", "b"),
    (7, "Zebras 42 run; zebras run far", "en", "a"),
    (7, "A zebra of the same id", "en", "a"),
    (None, "lost words", "en", "a"),
    (8, "¡¿…!", "es", "a"),
]
LATER = [(2, "Lamps give light. Lamps burn oil.", "en", "c"), (7, "another seven", "en", "c"), (9, "wells of oil and light", "fr", "c"), (10, "wells of oil and light", "fr", "c")]


def add(spark, folder, name, rows):
    """A new file of documents in a folder; the columns that the job does not read have clashing names."""
    spark.createDataFrame([(*r, "x", "y", 1, 0.5) for r in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def hashed(text):
    return hashlib.sha256(re.sub(r"\s+", " ", (text or "").lower()).strip().encode()).hexdigest()


def brute(*batches):
    """Documents, postings and document frequencies of batches of rows."""
    documents, seen = {}, set()
    for number, rows in enumerate(batches):
        fresh = {}
        for i, text, *_ in rows:
            if i is not None and i not in documents:
                fresh[i] = min(fresh.get(i, text or ""), text or "")
        for i in sorted(fresh):
            h = hashed(fresh[i])
            documents[i] = (h, h in seen, len(words(fresh[i])), number)
            seen.add(h)
            documents[i] += (fresh[i],)
    postings = {(t, i): (n, d[2], t[0], d[3]) for i, d in documents.items() if not d[1] for t, n in Counter(words(d[4])).items()}
    return {i: d[:4] for i, d in documents.items()}, postings, Counter(t for t, _ in postings)


def checked(spark, out, *batches):
    found, (documents, postings, df) = index_documents.tables(spark, out), brute(*batches)
    assert {r.doc_id: (r.content_hash, r.is_duplicate, r.n_tokens, r.batch) for r in found["documents"].collect()} == documents
    rows = found["postings"].collect()
    assert {(r.term, r.doc_id): (r.tf, r.len, r.letter, r.batch) for r in rows} == postings and len(rows) == len(postings)
    total = Counter()
    for r in found["vocabulary"].collect():
        total[r.term] += r.df
    assert total == df


@pytest.fixture
def source(tmp_path):
    return f"file://{tmp_path}/in", f"file://{tmp_path}/out"


def test_index_takes_only_what_is_new(spark, source):
    folder, out = source
    add(spark, folder, "day=1", ROWS)
    assert index_documents.run(spark, f"{folder}/*", out) == len(ROWS)
    checked(spark, out, ROWS)
    first = sorted(spark.read.parquet(f"{out}/postings").inputFiles())
    add(spark, folder, "day=2", LATER)
    assert index_documents.run(spark, f"{folder}/*", out) == len(LATER)
    checked(spark, out, ROWS, LATER)
    both = sorted(spark.read.parquet(f"{out}/postings").inputFiles())
    assert set(first) < set(both)  # what was there is left as it was
    assert index_documents.run(spark, f"{folder}/*", out) == 0
    assert sorted(spark.read.parquet(f"{out}/postings").inputFiles()) == both
    checked(spark, out, ROWS, LATER)


def test_a_batch_that_runs_again_leaves_the_same(spark, source):
    folder, out = source
    batches = [spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string") for rows in (ROWS, LATER)]
    index_documents.take(batches[0], 0, out)
    # a failure after the postings of the second batch: they do not count, and are replaced
    index_documents._write(spark.createDataFrame([("odd", 99, 1, 1, "o")], "term string, doc_id long, tf long, len long, letter string"), f"{out}/postings/batch=1", "letter")
    checked(spark, out, ROWS)
    for _ in range(2):
        index_documents.take(batches[1], 1, out)
        checked(spark, out, ROWS, LATER)


def test_several_batches_in_one_run(spark, source):
    folder, out = source
    for n in range(3):
        add(spark, folder, f"part{n}", [(10 * n + i, f"word{i} shared{n % 2} text", "en", "a") for i in range(4)])
    index_documents.run(spark, f"{folder}/*", out, index_documents.Settings(files_per_batch=1))
    found = index_documents.tables(spark, out)
    assert found["documents"].select("batch").distinct().count() == 3
    # the third file repeats the first
    assert {r.doc_id for r in found["documents"].filter("is_duplicate").collect()} == {20, 21, 22, 23}


def test_an_empty_table_makes_an_empty_index(spark, source):
    folder, out = source
    add(spark, folder, "none", [])
    index_documents.run(spark, f"{folder}/*", out)
    checked(spark, out, [])
    assert index_documents.index(spark, out).search("anything", 5).count() == 0


def bm25(question, documents, top):
    """The best documents of a question by plain sums."""
    n, tokens = len(documents), {i: words(t) for i, t in documents.items()}
    avgdl = sum(map(len, tokens.values())) / n
    df = Counter(t for w in tokens.values() for t in set(w))
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    idf = {t: 0.25 * sum(raw.values()) / len(raw) if v < 0 else v for t, v in raw.items()}
    score = {i: sum(idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avgdl)) for t in words(question) if t in idf) for i, w in tokens.items()}
    return sorted(((-round(s, 6), i) for i, s in score.items() if s > 0))[:top]


QUESTIONS = [(1, "Which lamps burn oil?"), (2, "zebras"), (3, "   "), (4, "x" * 1001), (5, "nothing here"), (6, None), (None, "lamps"), (7, "far wells light"), (7, "far wells lights")]


def test_evidence_of_questions(spark, source):
    folder, out = source
    add(spark, folder, "one", ROWS)
    index_documents.run(spark, f"{folder}/*", f"{out}/index")
    add(spark, folder, "two", LATER)
    index_documents.run(spark, f"{folder}/*", f"{out}/index")
    spark.createDataFrame([(*q, "clash") for q in QUESTIONS], "item_id long, text string, score string").write.parquet(f"{out}/asked")
    settings = gather_evidence.Settings(top_k=3, chunk_char_budget=40, context_char_budget=150, questions_per_pass=2)
    kept = {i: t for i, (_, dup, _, _, t) in _documents().items() if not dup}
    for _ in range(2):
        assert gather_evidence.run(spark, f"{out}/index", f"{folder}/*", f"{out}/asked", f"{out}/found", settings) == 4
        passages = spark.read.schema(gather_evidence.PASSAGES).parquet(f"{out}/found/passages").collect()
        for i, text in ((1, QUESTIONS[0][1]), (2, "zebras"), (7, "far wells light")):
            own = sorted((r.marker, r.doc_id, r.score, r.block) for r in passages if r.question_id == i)
            want = [(m, d, -s) for m, (s, d) in enumerate(bm25(text, kept, 3), 1)]
            assert [o[:3] for o in own] == [pytest.approx(w) for w in want[: len(own)]]
            size = [len(o[3]) for o in own]
            assert bool(own) == bool(want) and sum(size) <= 150 and all(o[3].startswith(f"[{o[0]}] (doc{o[1]}.txt") for o in own)
        assert {r.question_id for r in passages} == {1, 7}  # of document 7 the text without zebras was indexed
        states = {r.question_id: r.status for r in spark.read.schema(gather_evidence.QUESTIONS).parquet(f"{out}/found/questions").collect()}
        assert states == {1: "evidence", 2: "no_evidence", 3: "refused", 4: "refused", 5: "no_evidence", 6: "refused", 7: "evidence"}


def _documents():
    documents = {}
    out = brute(ROWS, LATER)[0]
    for rows in (ROWS, LATER):
        for i, text, *_ in rows:
            if i is not None and hashed(text) == out[i][0]:
                documents[i] = (*out[i], text or "")
    return documents


def test_settings_files(tmp_path):
    for job in (index_documents, gather_evidence):
        path = job.__file__.replace(".py", ".json")
        assert read_settings(path, job.Settings) == job.Settings()
        with open(path) as f:
            assert set(json.load(f)) == {f.name for f in fields(job.Settings)}
    (tmp_path / "bad.json").write_text('{"colour": 1}')
    with pytest.raises(ValueError, match="colour"):
        read_settings(str(tmp_path / "bad.json"), index_documents.Settings)
