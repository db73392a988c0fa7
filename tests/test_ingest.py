import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweft.operators import dedup, events, recompute
from docweft.params import ChunkParams, GraphParams
from docweft.plans.ingest_queries import MARKDOWN, small_docx, small_pdf, uploads
from docweft.sources import files
from docweft.streaming import jobs


def test_extraction():
    docx = files.extract_docx(small_docx())
    assert docx.title == "Of Bees" and [b.section for b in docx.blocks] == ["Of Bees", "Hives", "Hives", "Hives > Frames", "Hives > Frames"]
    pdf = files.extract_pdf(small_pdf())
    assert pdf.title == "On Lamps" and pdf.pages == 1 and pdf.blocks[1].page == 1
    assert pdf.blocks[1].text == "Lamps give light in the evening and the night. Oil burns in them."
    assert not files.extract_pdf(b"%PDF-1.4 1 0 obj << /Type /Page >> endobj").blocks


def test_headings_of_a_pdf():
    span = files.Span
    body = [[span(10.0, False, "The body of the text is long enough to be its mass, with a stop at the end of it.")]]
    pages = [[[[span(20.0, False, "Top")]], body, [[span(10.0, True, "Bold line")]], [[span(15.0, False, "Second")], [span(15.0, False, "level")]], [[span(20.0, False, "Ends like a sentence.")]], [[span(10.0, True, "half"), span(10.0, False, " bold")]]], [[[span(9.0, True, "small bold")]]]]
    doc = files.classify(pages)
    assert [(b.text, b.heading, b.page) for b in doc.blocks if b.heading] == [("Top", 1, 1), ("Bold line", 3, 1), ("Second level", 2, 1)]
    assert doc.blocks[-1].page == 2 and doc.title == "Top" and doc.pages == 2


def test_objects_packed_into_a_stream():
    import zlib

    inner = b"<< /Type /Page /Contents 9 0 R >>"
    packed = zlib.compress(b"7 0 " + inner)
    text = b"BT /F1 12 Tf (Packed page) Tj ET"
    content = b"%PDF-1.5\n5 0 obj << /Type /ObjStm /N 1 /First 4 /Filter /FlateDecode >>\nstream\n" + packed + b"\nendstream\nendobj\n9 0 obj << /Length 1 >>\nstream\n" + text + b"\nendstream\nendobj\n"
    assert files.extract_pdf(content).text == "Packed page"


def test_uploads(spark):
    got = {r.filename: r.error for r in files.validated_uploads(uploads(spark)).collect()}
    assert got == {"a.txt": None, "b.md": None, "c.docx": None, "d.pdf": None, "e.docx": "zip_bomb", "f.txt": "empty_file", "g.pdf": "magic_mismatch", "h.docx": "unsupported_type"}
    assert files.validated_uploads(uploads(spark), limit=10).filter("error = 'too_large'").count() > 2


def newest(tables, path):
    return {r.path.rpartition("/")[2]: r for r in tables.documents().collect()}[path]


def test_job(spark, tmp_path):
    """A folder through all stages: duplicates, ids, events, refused and broken files, changes in place."""
    source, top = tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()
    (source / "a.md").write_text(MARKDOWN)
    (source / "bad.pdf").write_bytes(b"%PDF-1.4 nothing inside")
    (source / "blank.txt").write_text(" \n ")
    jobs.ingest(spark, str(source), top)
    tables = jobs.Tables(spark, top)
    assert newest(tables, "a.md").status == "done" and newest(tables, "bad.pdf").status == "failed" and "no PDF objects" in newest(tables, "bad.pdf").error
    assert newest(tables, "blank.txt").status == "done" and newest(tables, "blank.txt").chunk_count == 0
    chunks = tables.rows("chunks")
    n = chunks.count()
    assert n == newest(tables, "a.md").chunk_count > 2 and chunks.filter("is_duplicate").count() == 0
    assert sorted(r.vector_id for r in tables.rows("vectors").collect()) == list(range(n))
    trail = [(r.status, r.detail) for r in tables.events().filter(F.col("path").endswith("a.md")).orderBy("position").collect()]
    assert [s for s, _ in trail] == list(jobs.STAGES) and '"indexed_count"' in trail[-1][1]
    assert [r.status for r in tables.events().filter(F.col("path").endswith("bad.pdf")).orderBy("position").collect()] == ["queued", "parsing", "failed"]
    assert "empty_document" in tables.events().filter(F.col("path").endswith("blank.txt") & (F.col("status") == "done")).first().detail

    jobs.ingest(spark, str(source), top)  # nothing new
    assert tables.rows("chunks").count() == n

    (source / "twin.md").write_text(MARKDOWN)  # the same bytes under another name
    (source / "c.md").write_text("# Other\n\nMills turn.\n\n# Own\n\nSomething of its own stands here.")
    jobs.ingest(spark, str(source), top)
    assert newest(tables, "twin.md").error == "duplicate_document" and newest(tables, "twin.md").status == "failed"
    own = {r.section: r for r in tables.rows("chunks").filter(F.col("path").endswith("c.md")).collect()}
    ids = [r.vector_id for r in tables.rows("vectors").collect()]
    assert own["Own"].vector_id >= n and len(set(ids)) == len(ids)

    (source / "c.md").write_text("# Other\n\nAll of it is new now.")
    os.utime(source / "c.md", (time.time() + 60,) * 2)
    jobs.ingest(spark, str(source), top)
    assert [r.text for r in tables.rows("chunks").filter(F.col("path").endswith("c.md")).collect()] == ["# Other\n\nAll of it is new now."[2:]]
    assert tables.rows("vectors").filter(F.col("path").endswith("c.md")).count() == 1


def test_indexed_against_a_fold(spark):
    """Exact and near duplicates against what is known and within the batch, one chunk after the other."""
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(size=(40, 5)) * 0.3, axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hashes = [f"h{i % 31}" for i in range(40)]
    old, known = {100: x[3].tolist(), 101: [1.0, 0.0, 0.0, 0.0, 0.0]}, {"h7"}
    want, seen, kept = {}, set(known), [np.array(v) for v in old.values()]
    for i in range(40):
        near = any(k @ x[i] > 0.95 for k in kept)
        fresh = hashes[i] not in seen
        seen.add(hashes[i])
        want[i] = fresh and not near
        if want[i]:
            kept.append(x[i])
    vectors = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)], "chunk_id long, embedding array<double>")
    chunks = spark.createDataFrame([(i, h, f"t{i}") for i, h in enumerate(hashes)], "chunk_id long, content_hash string, text string")
    got = jobs.indexed(chunks, lambda df: df.join(vectors, "chunk_id"), ChunkParams(near_dup_cosine=0.95), spark.createDataFrame([(h,) for h in known], "content_hash string"), spark.createDataFrame(list(old.items()), "vector_id long, embedding array<double>")).collect()
    assert {r.chunk_id: not r.is_duplicate for r in got} == want
    assert [r.vector_id for r in sorted(got) if not r.is_duplicate] == list(range(102, 102 + sum(want.values())))


def test_chunks_are_cut_once(spark):
    """However often the stages after it read them: cutting texts is most of the work."""
    cut = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            cut.add(len(frame))
            yield frame

    rows = spark.createDataFrame([(i, f"h{i % 7}", f"t{i}") for i in range(20)], "chunk_id long, content_hash string, text string")
    got = jobs.indexed(rows.mapInPandas(counted, rows.schema), jobs.default_embedder, ChunkParams(near_dup_cosine=1.0)).collect()
    assert cut.value == 20
    assert sorted((r.chunk_id, r.is_duplicate, r.vector_id) for r in got) == [(i, i > 6, i if i < 7 else None) for i in range(20)]


def test_ids_of_rows_with_many_columns(spark):
    """Range partitions are bounded by a sample of the rows: ranks and sizes have to be of the same ones."""
    rows = spark.range(0, 40000, 1, 4).select(F.xxhash64("id").alias("chunk_id"), F.array(*(F.rand(i) for i in range(16))).alias("embedding"))
    got = dedup.vector_ids(rows, spark.range(3).withColumnRenamed("id", "vector_id")).select("chunk_id", "embedding", "vector_id").collect()
    assert [r.vector_id for r in sorted(got, key=lambda r: r.chunk_id)] == list(range(3, 40003))


def test_admitted():
    state, got = float("-inf"), []
    for now in (0.0, 0.0, 0.0, 0.25, 1000.0, 1000.0, 1000.0):
        state, passed, wait = events.admitted(state, now, 60, 2)
        got.append((passed, round(wait, 6)))
    assert got == [(True, 0.0), (True, 0.0), (False, 1.0), (False, 0.75), (True, 0.0), (True, 0.0), (False, 1.0)]


def test_rate_limit_as_state(spark, tmp_path):
    source = str(tmp_path / "req")
    rows = spark.createDataFrame([(i, i % 2, f"2024-01-01 00:00:0{i // 4}") for i in range(12)], "event_id long, user_id long, ts string").selectExpr("event_id", "user_id", "CAST(ts AS TIMESTAMP) AS ts")
    rows.coalesce(1).write.parquet(source)
    stream = jobs.rate_limited_stream(spark.readStream.schema(rows.schema).parquet(source), 60, 2)
    q = stream.writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    time.sleep(0.1)
    got = {r.event_id: r.allowed for r in spark.table("limited").collect()}
    batch = {r.event_id: r.allowed for r in events.rate_limited(rows, 60, 2, "user_id").collect()}
    assert got == batch and len(got) == 12 and got[0] and got[2] and not all(got.values())
    live = jobs.live_events(spark.readStream.schema(rows.schema).parquet(source), 5)
    assert live.isStreaming


def test_a_batch_that_runs_twice_leaves_the_same_tables(spark, tmp_path):
    top = f"file://{tmp_path}/out"
    rows = uploads(spark).withColumns({"modificationTime": F.timestamp_seconds(F.lit(0)), "length": F.length("content").cast("long")})
    seen = []
    for _ in range(2):
        jobs.process(spark, rows, top, 7)
        tables = jobs.Tables(spark, top)
        seen.append([sorted(map(str, tables.rows(name).drop("embedding").collect())) for name in ("chunks", "vectors")] + [sorted((r.path, r.status, r.chunk_count) for r in tables.documents().collect())])
    assert seen[0] == seen[1] and len(seen[0][0]) == len(seen[0][1]) > 5


def folder(tmp_path, names):
    source = tmp_path / "in"
    source.mkdir(exist_ok=True)
    for i, name in enumerate(names):
        (source / name).write_text(f"# Part {name}\n\nMills of {name} turn number {i}.\n\nThe same line stands everywhere.")
    return source, f"file://{tmp_path}/out"


def state(spark, top):
    """What counts: documents, chunks and vectors, without times and batch numbers."""
    tables = jobs.Tables(spark, top)
    short = lambda path: path.rsplit("/", 1)[1]
    documents = sorted((short(r.path), r.status, r.chunk_count, r.indexed_count) for r in tables.documents().collect())
    chunks = sorted((short(r.path), r.chunk_index, r.text, r.is_duplicate, r.vector_id) for r in tables.rows("chunks").collect())
    vectors = sorted((short(r.path), r.vector_id, tuple(r.embedding)) for r in tables.rows("vectors").collect())
    return documents, chunks, vectors


def test_a_crash_at_any_stage_leaves_what_no_crash_leaves(spark, tmp_path, monkeypatch):
    source, top = folder(tmp_path, ["a.md", "b.md"])
    jobs.ingest(spark, str(source), top)
    want, write, count = state(spark, top), jobs.Tables.write, []

    def crashing(self, rows, name, number, *below):
        count.append(name)
        if len(count) == stop:
            raise RuntimeError("the power went")
        return write(self, rows, name, number, *below)

    monkeypatch.setattr(jobs.Tables, "write", crashing)
    for stop in (2, 9, 14):
        own = f"file://{tmp_path}/out{stop}"
        count.clear()
        with pytest.raises(Exception, match="the power went"):
            jobs.ingest(spark, str(source), own)
        assert jobs.Tables(spark, own).documents() is None
        jobs.ingest(spark, str(source), own)
        assert state(spark, own) == want
    # the same of a batch of changed files, which no checkpoint remembers
    (source / "b.md").write_text("# Part b\n\nIt is all new.")
    os.utime(source / "b.md", (time.time() + 60,) * 2)
    stop = -1
    jobs.ingest(spark, str(source), top)
    want = state(spark, top)
    for number, stop in ((2, 3),):
        own = f"file://{tmp_path}/out{number}"
        count.clear()
        with pytest.raises(Exception, match="the power went"):
            jobs.ingest(spark, str(source), own)
        stop = -1
        jobs.ingest(spark, str(source), own)
        assert [s[0] for s in state(spark, own)[0]] == ["a.md", "b.md"] and [c[:4] for c in state(spark, own)[1]] == [c[:4] for c in want[1]]


def test_deletion_snapshots_and_the_graph(spark, tmp_path):
    source, top = folder(tmp_path, ["a.md", "b.md", "c.md"])
    p = GraphParams(semantic_floor=0.5, semantic_ceil=1.0, n_topics=2)
    jobs.ingest(spark, str(source), top, connect=p)
    first = recompute.Graph(spark, f"{top}/graph")
    assert first.analysis.count() == 3
    (source / "b.md").unlink()
    jobs.ingest(spark, str(source), top)  # a file that is gone is no reason to forget it
    assert len(state(spark, top)[0]) == 3
    jobs.ingest(spark, str(source), top, mirror=True, connect=p)
    after = state(spark, top)
    assert [d[0] for d in after[0]] == ["a.md", "c.md"] and {c[0] for c in after[1]} == {v[0] for v in after[2]} == {"a.md", "c.md"}
    second = recompute.Graph(spark, f"{top}/graph")
    assert second.version > first.version and second.analysis.count() == 2
    assert "deleted" in {r.status for r in jobs.Tables(spark, top).events().collect()}
    jobs.ingest(spark, str(source), top, connect=p)
    assert recompute.Graph(spark, f"{top}/graph").version == second.version  # nothing new, no run
    # what is read stays the same, however often a file is rewritten and whatever has been deleted
    read = []
    for i in range(3):
        (source / "c.md").write_text(f"# Part c\n\nVersion {i} of it.")
        os.utime(source / "c.md", (time.time() + 60 * (i + 1),) * 2)
        jobs.ingest(spark, str(source), top)
        before = state(spark, top)
        jobs.compact(spark, top)
        assert state(spark, top) == before
        read.append([jobs.Tables(spark, top).read(name).count() for name in ("documents", "chunks", "vectors")])
    assert read[0] == read[1] == read[2] and jobs.Tables(spark, top).batches("documents").count() > read[0][0]
    (source / "b.md").write_text("# Part b\n\nBack again.")
    os.utime(source / "b.md", (time.time() + 600,) * 2)
    assert jobs.delete(spark, top, spark.createDataFrame([("nowhere",)], "path string")) == 0


def test_lost_vectors_have_their_documents_taken_again(spark, tmp_path):
    source, top = folder(tmp_path, ["a.md", "b.md"])
    jobs.ingest(spark, str(source), top)
    want = state(spark, top)
    part = next((tmp_path / "out" / "vectors").glob("batch=*"))
    rows = spark.read.parquet(f"file://{part}").collect()
    spark.createDataFrame(rows[1:], spark.read.parquet(f"file://{part}").schema).write.mode("overwrite").parquet(f"file://{part}")
    assert len(state(spark, top)[2]) == len(want[2]) - 1
    jobs.ingest(spark, str(source), top)
    assert [c[:4] for c in state(spark, top)[1]] == [c[:4] for c in want[1]] and len(state(spark, top)[2]) == len(want[2])


def test_paths_with_characters_of_patterns(spark, tmp_path):
    source, top = folder(tmp_path, ["a[1].md", "b{x}.md"])
    jobs.ingest(spark, str(source), top)
    (source / "a[1].md").write_text("# Part\n\nNew words.")
    os.utime(source / "a[1].md", (time.time() + 60,) * 2)
    jobs.ingest(spark, str(source), top)
    assert [c[2] for c in state(spark, top)[1] if c[0] == "a[1].md"] == ["Part\n\nNew words."]
