import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
SECRET = re.compile(r"(?:token|password) = \"[a-z0-9]{12,}")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(5)
    top = str(tmp_path_factory.mktemp("sf"))
    vocabulary = [a + b for a in "ba ke li mo nu ra so ti vu we".split() for b in "lan mer tok sin ber dal fen gor".split()]

    def prose(n):
        return ". ".join(" ".join(rng.choices(vocabulary, k=10)).capitalize() for _ in range(n)) + "."

    items = [(i, prose(3)) for i in range(12)]
    docs, labels, kind = [], [], {}
    for i in range(400):
        text, what = prose(rng.randrange(4, 12)), "clean"
        if i % 9 == 1:
            text, what = text + " you awful clot, you clot", "toxic"
        elif i % 9 == 2:
            text, what = "BUY!! NOW!! " * 40 + text.upper(), "poor"
        elif i % 9 == 3 and i > 30:
            text, what = docs[i - 30][1] + " again.", "copy"
        elif i % 9 == 4:
            text, what = text + " " + items[i % 12][1] + " " + prose(2), "leak"
        elif i % 9 == 5:
            text, what = text + ' token = "abcdef1234567890" ' + prose(1), "secret"
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, int(what != "poor"), int(what == "toxic")))
        kind[i] = what
    docs += [(502, prose(4000), "en", "src1", 9), (503, prose(5), "en", None, 9), (500, None, None, None, None), (501, "", "en", "src0", 0), (0, docs[0][1], "en", "src0", 1), (None, "a row without any id at all, but clean", "en", None, 30)]
    extra = {"secret_spans": F.col("lang"), "component_id": F.lit(3), "leaked": F.lit(True), "label": F.lit(None).cast("int"), "score": F.lit("x")}
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumns(extra).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top, {d[0]: d for d in docs}, dict(items), kind


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_each_stage_on_its_own_input(spark, tables):
    top, docs, items, kind = tables
    now = spark.read.parquet(f"{top}/documents.parquet")
    columns = now.columns
    before = {r.doc_id: r for r in now.collect()}
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.stored(stage(spark, now, top), name)
        after = {r.doc_id: r for r in now.collect()}
        if name != "mixing":
            assert now.columns == columns
        gone = before.keys() - after.keys()
        if name == "toxicity":
            assert {i for i in gone} == {i for i, k in kind.items() if k == "toxic"} and {502, 503} <= after.keys()
        elif name == "near_duplicates":
            s = {i: shingles(r.text) for i, r in before.items() if r.text}
            want = {i for i in s for j in s if j is not None and (i is None or j < i) and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])}
            assert gone == want and want
            assert now.count() == len(after)
        elif name == "decontamination":
            assert gone == {i for i in before if kind.get(i) == "leak"}
        elif name == "secrets":
            assert not gone
            for i, r in after.items():
                assert (r.secret_spans, r.component_id, r.leaked, r.score) == (r.lang, 3, True, "x")
                assert not SECRET.search(r.text or "") and (r.text == before[i].text or "[assign]" in r.text)
                assert (r.text != before[i].text) == (kind.get(i) == "secret") and (r.text is None or r.n_chars == len(r.text))
        else:
            assert now.columns == [*columns, "rate", "copies"]
            assert {i for i in before if kind.get(i) in ("clean", "secret")} <= after.keys()
            poor = [r.rate for i, r in after.items() if kind.get(i) == "poor"]
            clean = [r.rate for i, r in after.items() if kind.get(i) == "clean"]
            assert sum(clean) / len(clean) > 1 and (not poor or sum(poor) / len(poor) < sum(clean) / len(clean))
        before = after


def test_run_and_empty_tables(spark, tables, tmp_path):
    top, *_ = tables
    assert corpus_pipeline.run(spark, top).count() > 100
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{top}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
