"""Structured Streaming jobs: ingestion of files, live events after a replay, rate limits as state.

A queue of documents is a file stream: its checkpoint remembers what has been taken, a
restart goes on from there.  A micro-batch of files becomes one batch of rows in each table
below a folder - chunks, vectors, events, documents -, written under its number, so that a
batch that runs twice leaves the same tables.  ``documents`` is written last: only batches
that have it count, and of each path only the newest one does.  A file that is rewritten in
place is a new document of the old path; ``changed_paths`` finds it.  A document is deleted
by a batch in which its state is ``deleted``.

``compact`` writes what counts of all batches so far as a snapshot; from then on readers
take it and the batches since, so what a batch reads follows what is stored and not how many
batches and replaced documents there have been.  ``ingest`` first mends what a process
that died has left (``recover``), and with ``connect`` has the graph recomputed at its end.
"""

from __future__ import annotations

import itertools
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.functions.segments import chunk
from docweft.operators import dedup, retrieval
from docweft.operators.events import TERMINAL, admitted
from docweft.operators.recompute import recompute_serialised
from docweft.params import ChunkParams, GraphParams
from docweft.sources.files import CHUNK, chunk_rows, extract_document, validated_uploads
from docweft.sources.store import claimed, commit, committed, exists, glob_paths, kept, remove, scratch

#: States of a document in order (fixed values).
STAGES = ("queued", "parsing", "chunking", "embedding", "indexing", "done")
Embedder = Callable[[DataFrame], DataFrame]


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    return spark.readStream.format("binaryFile").schema(schema).load(path)


def chunk_files(files: DataFrame, p: ChunkParams = ChunkParams()) -> DataFrame:
    """(path, sha256, error, page_count, chunk fields) of validated uploads; a file that cannot be read, or has no chunk, gives one row."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("sha256", T.StringType()), T.StructField("error", T.StringType()), T.StructField("page_count", T.IntegerType()), *CHUNK.fields])
    blank = (None,) * len(CHUNK)

    def rows_of(r) -> list[tuple]:
        if r.error:
            return [(r.path, r.sha256, r.error, None, *blank)]
        try:
            doc = extract_document(bytes(r.content), r.file_type)
            return [(r.path, r.sha256, None, doc.pages or 0, *c) for c in chunk_rows(chunk(doc, p.target_tokens, p.overlap_ratio))] or [(r.path, r.sha256, None, doc.pages or 0, *blank)]
        except Exception as error:  # noqa: BLE001 - one poisoned document must not end the stream
            return [(r.path, r.sha256, f"{type(error).__name__}: {error}"[:500], None, *blank)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = [f.name for f in schema if f.dataType == T.IntegerType()]
        for frame in frames:
            yield pd.DataFrame([row for r in frame.itertuples() for row in rows_of(r)], columns=schema.names).astype(dict.fromkeys(whole, "Int32"))

    return files.select("path", "sha256", "error", "content", "file_type").mapInPandas(run, schema)


def indexed(chunks: DataFrame, embed: Embedder, p: ChunkParams = ChunkParams(), known: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """``chunks`` (chunk_id, content_hash, text, ...) with ``is_duplicate``, ``embedding`` and ``vector_id``.

    Chunks count in the order of their ids.  A hash that ``known`` (content_hash) or an
    earlier chunk has is an exact duplicate; of the others, one nearer than the threshold
    to one of ``vectors`` (vector_id, embedding) or to an earlier kept chunk is a near one.
    What is kept gets the ids after the largest of ``vectors``; the rest has none.
    """
    spark, chunks = chunks.sparkSession, kept(chunks, "drafts")  # cut once, however often they are read
    gone = kept(dedup.exact_duplicates(chunks.select("chunk_id", "content_hash"), known, "chunk_id").filter("is_duplicate").select("chunk_id"), "duplicates")
    fresh = kept(embed(chunks.join(gone, "chunk_id", "left_anti").select("chunk_id", "text")).select(F.col("chunk_id").alias("id"), "embedding"), "embedded")
    if p.near_dup_cosine < 1:
        old = None if vectors is None else vectors.select(F.col("vector_id").alias("id"), "embedding")
        own = dedup.near_duplicates(fresh, p.near_dup_cosine, old).filter("NOT is_near_dup").select("id")
        fresh = kept(fresh.join(own, "id", "left_semi"), "fresh")
    none = spark.range(0).withColumnRenamed("id", "vector_id")
    fresh = fresh.withColumnRenamed("id", "chunk_id")
    ids = dedup.vector_ids(fresh.select("chunk_id"), none if vectors is None else vectors.select("vector_id"), "chunk_id")
    numbered = fresh.join(ids.select("chunk_id", F.col("vector_id").cast("bigint").alias("vector_id")), "chunk_id")
    out = chunks.join(numbered, "chunk_id", "left")
    return out.select(*chunks.columns, F.col("vector_id").isNull().alias("is_duplicate"), "embedding", "vector_id")


class Tables:
    """What has been ingested below a folder: of each path the rows of its newest committed batch."""

    def __init__(self, spark: SparkSession, top: str):
        self.spark, self.top = spark, top.rstrip("/")

    def batches(self, name: str) -> DataFrame | None:
        """What all batches have written into a table."""
        return self.spark.read.parquet(f"{self.top}/{name}") if exists(self.spark, f"{self.top}/{name}/batch=*/{{_SUCCESS,stage=*/_SUCCESS}}") else None

    def read(self, name: str) -> DataFrame | None:
        """What the newest snapshot has of a table, and what batches have written since."""
        found, versions = self.batches(name), committed(self.spark, f"{self.top}/snapshots", "covered")
        if found is None or not versions:
            return found
        path = f"{self.top}/snapshots/version={versions[-1]}"
        stream, changed = self.spark.read.parquet(f"{path}/covered").first()
        since = ((F.col("batch") > stream) & (F.col("batch") < CHANGED)) | (F.col("batch") > changed)
        return self.spark.read.parquet(f"{path}/{name}").unionByName(found.filter(since))

    def documents(self) -> DataFrame | None:
        """The newest row of each path that is not deleted."""
        rows = self.read("documents")
        return None if rows is None else rows.groupBy("path").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "path")), "batch").alias("d")).select("path", "d.*").filter("status <> 'deleted'")

    def next_change(self) -> int:
        """The number of the next batch that does not come from the stream."""
        documents = self.batches("documents")
        last = documents.agg(F.max("batch")).first()[0] if documents is not None else None
        return max(CHANGED, -1 if last is None else last + 1)

    def rows(self, name: str) -> DataFrame | None:
        """Rows of ``chunks`` or ``vectors`` that belong to a document that is done."""
        found, documents = self.read(name), self.documents()
        if found is None or documents is None:
            return None
        return found.join(documents.filter("status = 'done'").select("path", "batch"), ["path", "batch"], "left_semi")

    def events(self) -> DataFrame | None:
        return self.batches("events")

    def write(self, rows: DataFrame, name: str, batch: int, *below: str) -> DataFrame:
        path = "/".join([f"{self.top}/{name}/batch={batch}", *below])
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path).withColumn("batch", F.lit(batch))


def default_embedder(chunks: DataFrame) -> DataFrame:
    return retrieval.embed(chunks)


def process(spark: SparkSession, files: DataFrame, top: str, number: int, embed: Embedder = default_embedder, p: ChunkParams = ChunkParams()) -> None:
    """Take one batch of files through all stages; each stage's events are written when its rows are.

    A file whose bytes another document has already, or an earlier file of the batch, is
    refused as a ``duplicate_document``.  A file that fails leaves no chunk.
    """
    with scratch(spark):
        _processed(spark, files, top, number, embed, p)


def _processed(spark: SparkSession, files: DataFrame, top: str, number: int, embed: Embedder, p: ChunkParams) -> None:
    tables, began = Tables(spark, top), time.time()
    older = tables.documents()
    older = None if older is None else older.filter(F.col("batch") != number)
    # the stream lists a file twice if its name is also a pattern that matches it
    uploads = tables.write(validated_uploads(files.dropDuplicates(["path"])).select("path", "modificationTime", "sha256", "error", "content", "file_type"), "uploads", number)
    valid = uploads.select("path", "modificationTime", "sha256", "error")
    first = valid.filter("error IS NULL").groupBy("sha256").agg(F.min(F.struct("modificationTime", "path")).alias("first"))
    seen = valid.join(first, "sha256", "left").withColumn("twice", F.col("error").isNull() & (F.struct("modificationTime", "path") > F.col("first")))
    if older is not None:
        had = older.filter("status = 'done'").groupBy("sha256").agg(F.min("path").alias("had"))
        seen = seen.join(had, "sha256", "left").withColumn("twice", F.col("twice") | (F.col("error").isNull() & F.col("had").isNotNull() & (F.col("had") != F.col("path"))))
    queue = tables.write(seen.withColumn("error", F.when(F.col("twice"), F.lit("duplicate_document")).otherwise(F.col("error"))).select(*valid.columns), "queue", number)
    marks: list[tuple[str, float]] = []

    def enter(status: str, rows: DataFrame, detail: dict[str, str]) -> None:
        """Events of (path, ...) rows: the state, and how long the batch was in the one before."""
        nonlocal began
        now = time.time()
        shown = F.to_json(F.struct(*(F.expr(e).alias(k) for k, e in detail.items()))) if detail else F.lit(None).cast("string")
        position = STAGES.index(status) if status in STAGES else len(STAGES)
        event = rows.select("path", F.lit(position).alias("position"), F.lit(status).alias("status"), shown.alias("detail"), F.lit(round(1000 * (now - began), 3) if marks else None).cast("double").alias("duration_ms"), F.timestamp_seconds(F.lit(now)).alias("ts"))
        tables.write(event, "events", number, f"stage={position}")
        marks.append((status, now))
        began = now

    enter("queued", queue, {})
    good = queue.filter("error IS NULL").select("path")
    enter("parsing", good, {})
    parsed = tables.write(chunk_files(uploads.join(good, "path", "left_semi"), p), "parsed", number)
    failed = parsed.filter("error IS NOT NULL").select("path", "error").unionByName(queue.filter("error IS NOT NULL").select("path", "error"))
    good = good.join(failed.select("path"), "path", "left_anti")
    enter("chunking", good, {})
    order = queue.select("path", "modificationTime").withColumn("document", F.struct(F.unix_micros("modificationTime").alias("at"), "path"))
    drafts = parsed.filter("error IS NULL AND chunk_index IS NOT NULL").join(order.select("path", "document"), "path")
    drafts = drafts.withColumn("chunk_id", F.concat(F.format_string("%020d", F.lit(number)), F.lit("/"), F.format_string("%020d", "document.at"), F.lit("/"), "path", F.lit("#"), F.format_string("%09d", "chunk_index"))).drop("document", "error", "batch", "page_count")
    enter("embedding", good, {})
    again = queue.select("path")
    known, vectors = (None if rows is None else rows.filter(F.col("batch") != number).join(again, "path", "left_anti") for rows in (tables.rows("chunks"), tables.rows("vectors")))
    known = None if known is None else known.filter("NOT is_duplicate").select("content_hash")
    rows = indexed(drafts, embed, p, known, vectors)
    final = tables.write(rows, "indexed", number)
    enter("indexing", good, {})
    tables.write(final.drop("embedding", "batch"), "chunks", number)
    tables.write(final.filter("NOT is_duplicate").select("vector_id", "chunk_id", "path", "embedding"), "vectors", number)
    counts = final.groupBy("path").agg(F.count("*").alias("chunk_count"), F.count_if(~F.col("is_duplicate")).alias("indexed_count"))
    total = 1000 * (time.time() - marks[0][1])
    state = queue.select("path", "modificationTime", "sha256").join(failed.groupBy("path").agg(F.max("error").alias("error")), "path", "left").join(counts, "path", "left").join(parsed.groupBy("path").agg(F.max("page_count").alias("page_count")), "path", "left")
    state = state.fillna(0, ["chunk_count", "indexed_count"]).withColumn("duplicate_count", F.col("chunk_count") - F.col("indexed_count")).withColumn("total_ms", F.lit(round(total, 3))).withColumn("status", F.when(F.col("error").isNull(), "done").otherwise("failed"))
    done = {"chunk_count": "chunk_count", "indexed_count": "indexed_count", "duplicate_count": "duplicate_count", "total_ms": "total_ms", "warning": "CASE WHEN chunk_count = 0 THEN 'empty_document' END"}
    enter("done", state.filter("status = 'done'"), done)
    enter("failed", state.filter("status = 'failed'"), {"error": "error"})
    tables.write(state, "documents", number)


def compact(spark: SparkSession, top: str) -> str | None:
    """Write the present documents, chunks and vectors as a snapshot; its version.  Nothing is deleted: readers of older versions go on."""
    tables = Tables(spark, top)
    batches = tables.batches("documents")
    if batches is None:
        return None
    numbers = batches.agg(F.max(F.when(F.col("batch") < CHANGED, F.col("batch"))), F.max(F.when(F.col("batch") >= CHANGED, F.col("batch")))).first()
    covered = spark.createDataFrame([(-1 if numbers[0] is None else numbers[0], CHANGED - 1 if numbers[1] is None else numbers[1])], "stream bigint, changed bigint")
    version = claimed(spark, f"{tables.top}/snapshots")
    found = {name: rows for name, rows in (("documents", tables.documents()), ("chunks", tables.rows("chunks")), ("vectors", tables.rows("vectors"))) if rows is not None}
    commit({**found, "covered": covered}, f"{tables.top}/snapshots", version, "covered")
    return version


def delete(spark: SparkSession, top: str, paths: DataFrame) -> int:
    """Delete the documents of ``paths`` (path) with their chunks and vectors: one batch of rows that say so; how many there were."""
    tables = Tables(spark, top)
    documents = tables.documents()
    if documents is None:
        return 0
    number = tables.next_change()
    with scratch(spark):
        gone = kept(documents.join(paths.select("path").distinct(), "path", "left_semi").drop("batch").withColumn("status", F.lit("deleted")), "gone")
        n = gone.count()
        if n:
            event = gone.select("path", F.lit(len(STAGES) + 1).alias("position"), F.lit("deleted").alias("status"), F.lit(None).cast("string").alias("detail"), F.lit(None).cast("double").alias("duration_ms"), F.current_timestamp().alias("ts"))
            tables.write(event, "events", number, f"stage={len(STAGES) + 1}")
            tables.write(gone, "documents", number)
    return n


def recover(spark: SparkSession, top: str) -> DataFrame | None:
    """Mend what a process that died has left; the (path) of documents to be taken again, None if there are none.

    Rows of batches without documents are wiped: a batch of the stream runs again by its
    checkpoint, any other is found again by the times of its files.  If the chunks that
    have a vector and the vectors are not as many, all done documents are to be taken again.
    """
    tables = Tables(spark, top)
    whole = {p.rstrip("/").split("batch=")[-1] for p in glob_paths(spark, f"{tables.top}/documents/batch=*/_SUCCESS", parent=True)}
    for name in ("uploads", "queue", "events", "parsed", "indexed", "chunks", "vectors", "documents"):
        for path in glob_paths(spark, f"{tables.top}/{name}/batch=*"):
            if path.rstrip("/").split("batch=")[-1] not in whole:
                remove(spark, path)
    chunks, vectors, documents = tables.rows("chunks"), tables.rows("vectors"), tables.documents()
    if chunks is None or vectors is None:
        return None
    again = to_reset(chunks, vectors, documents).select("path")
    return None if again.isEmpty() else again


def ingest(spark: SparkSession, source: str, top: str, embed: Embedder = default_embedder, p: ChunkParams = ChunkParams(), mirror: bool = False, connect: GraphParams | None = None) -> None:
    """Process all new files of a folder, then those that changed in place; to be run again for more.

    With ``mirror``, documents whose file is gone are deleted.  With ``connect``, the graph is recomputed
    once more if anything has changed, below ``graph`` in the folder of the tables.
    """

    def write(batch: DataFrame, number: int) -> None:
        process(batch.sparkSession, batch, top, number, embed, p)

    tables = Tables(spark, top)
    before = committed_batches(spark, top)
    again = recover(spark, top)
    if again is not None:
        _process_paths(spark, again, top, embed, p)
    stream = file_stream(spark, source).writeStream.foreachBatch(write).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    _process_paths(spark, changed_paths(spark, source, top), top, embed, p)
    if mirror and (documents := tables.documents()) is not None:
        delete(spark, top, documents.select("path").join(listed(spark, source), "path", "left_anti"))
    if connect is not None and committed_batches(spark, top) != before:
        recompute_serialised(spark, lambda: graph_input(spark, top), f"{top}/graph", connect)


def graph_input(spark: SparkSession, top: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, vectors) of the present documents, for the graph; a document's id is its path."""
    tables = Tables(spark, top)
    return tables.rows("chunks").withColumnRenamed("path", "doc_id"), tables.rows("vectors").withColumnRenamed("path", "doc_id")


def committed_batches(spark: SparkSession, top: str) -> int:
    return len(glob_paths(spark, f"{top.rstrip('/')}/documents/batch=*/_SUCCESS"))


#: Batches of files that do not come from the stream are numbered from here, those of the stream below.
CHANGED = 1 << 32
#: Files of such a batch at most: their paths are all that the driver holds.
FILES = 1000


def listed(spark: SparkSession, source: str) -> DataFrame:
    """(path, modificationTime) of a folder's files, without reading them."""
    return spark.read.format("binaryFile").load(source).select("path", "modificationTime")


def changed_paths(spark: SparkSession, source: str, top: str) -> DataFrame:
    """(path) of the files of a folder that are newer than what was ingested of them."""
    found, documents = listed(spark, source), Tables(spark, top).documents()
    if documents is None:
        return found.select("path").limit(0)
    had = documents.select(F.col("path").alias("had"), F.col("modificationTime").alias("then"))
    return found.join(had, (F.col("path") == F.col("had")) & (F.col("modificationTime") > F.col("then")), "left_semi").select("path")


def _process_paths(spark: SparkSession, paths: DataFrame, top: str, embed: Embedder, p: ChunkParams) -> None:
    """Take files again, ``FILES`` in a batch: only these are read."""
    with scratch(spark):
        rows = kept(paths, "paths").toLocalIterator()
        while block := [r.path for r in itertools.islice(rows, FILES)]:
            files = spark.read.format("binaryFile").load([quoted(path) for path in block])
            process(spark, files, top, Tables(spark, top).next_change(), embed, p)


def quoted(path: str) -> str:
    """A path that holds characters of glob patterns, as a pattern for itself."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def recovered(documents: DataFrame, events: DataFrame) -> DataFrame:
    """Documents whose last state is not terminal, oldest first: they start again."""
    last = events.groupBy("doc_id").agg(F.max_by("status", "event_id").alias("status"))
    return documents.join(last, "doc_id", "left").filter(F.col("status").isNull() | ~F.col("status").isin(*TERMINAL)).orderBy("created_at", "doc_id")


def wiped(rows: DataFrame, again: DataFrame) -> DataFrame:
    """Rows of a table without those of documents that start again: partial rows go before a document does."""
    return rows.join(again.select("doc_id"), "doc_id", "left_anti")


def to_reset(chunks: DataFrame, vectors: DataFrame, documents: DataFrame) -> DataFrame:
    """All done documents if the chunks that have a vector id and the stored vectors are not as many, else none."""
    counts = chunks.agg(F.count("vector_id").alias("c")).join(F.broadcast(vectors.agg(F.count("*").alias("v"))))
    return documents.filter("status = 'done'").join(F.broadcast(counts.filter("c != v")))


def live_events(stream: DataFrame, cursor: int) -> DataFrame:
    """Events of a stream after the cursor of a replay, each id once within the watermark."""
    return stream.filter(F.col("event_id") > cursor).withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["event_id"])


def rate_limited_stream(requests: DataFrame, rpm: float, capacity: float | None = None) -> DataFrame:
    """(event_id, user_id, allowed, retry_after) of a stream of (event_id, user_id, ts); a bucket's state is one number."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    size = float(rpm if capacity is None else capacity)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (empty,) = state.getOption or (float("-inf"),)
        for frame in frames:
            frame = frame.sort_values("event_id")
            found = []
            for now in frame["s"]:
                empty, allowed, wait = admitted(empty, now, rpm, size)
                found.append((allowed, wait))
            yield pd.DataFrame({"event_id": frame["event_id"], "user_id": key[0], "allowed": [f[0] for f in found], "retry_after": [f[1] for f in found]})
        state.update((empty,))

    keyed = requests.select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s")).groupBy("user_id")
    return keyed.applyInPandasWithState(fold, "event_id bigint, user_id bigint, allowed boolean, retry_after double", "empty double", "append", GroupStateTimeout.NoTimeout)
