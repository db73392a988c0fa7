"""Tables of the engine as Parquet: a vector store, keyed repositories, and marker-last commits."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweft.sources.lease import Folder

VECTOR = "vector_id bigint, chunk_id string, doc_id bigint, embedding array<float>"


class VectorStore:
    """Vectors (vector_id, chunk_id, doc_id, embedding) of one dimension; every write makes a new version."""

    def __init__(self, vectors: DataFrame, dim: int):
        self.vectors, self.dim = vectors, dim

    @classmethod
    def load(cls, spark: SparkSession, path: str, dim: int) -> VectorStore:
        vectors = spark.read.schema(VECTOR).parquet(path)
        bad = vectors.filter(F.size("embedding") != dim)
        if not bad.isEmpty():
            raise ValueError(f"the index holds vectors that do not have {dim} dimensions")
        return cls(vectors, dim)

    @classmethod
    def empty(cls, spark: SparkSession, dim: int) -> VectorStore:
        return cls(spark.createDataFrame([], VECTOR), dim)

    def upsert(self, vectors: DataFrame) -> VectorStore:
        """The new rows replace those with their ids."""
        return VectorStore(self.vectors.join(vectors.select("vector_id"), "vector_id", "left_anti").unionByName(vectors), self.dim)

    def delete_documents(self, doc_ids: DataFrame) -> VectorStore:
        return VectorStore(self.vectors.join(doc_ids, "doc_id", "left_anti"), self.dim)

    def reconstruct(self, ids: DataFrame) -> DataFrame:
        """Vectors of (ordinal, vector_id) rows, null where unknown."""
        return ids.join(self.vectors.select("vector_id", "embedding"), "vector_id", "left")

    def health(self) -> DataFrame:
        return self.vectors.agg(F.count("*").alias("vectors"), F.countDistinct("doc_id").alias("documents"), F.coalesce(F.max("vector_id"), F.lit(-1)).alias("max_vector_id"))

    def persist(self, path: str) -> None:
        """Write a new version; Spark's committer makes it visible as a whole."""
        self.vectors.write.mode("overwrite").parquet(path)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key: an append-only table read as a keyed one."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Delete then insert by key; of equal keys in ``new`` all are kept, so it has each once."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def commit(tables: dict[str, DataFrame], top: str, version: str, marker: str, check: Callable[[], None] | None = None) -> None:
    """Write all tables of a version, the marker table last: readers take versions whose marker exists.

    ``check`` is called before the marker is written, and raises if this writer has been replaced.
    """
    for name in [n for n in tables if n != marker] + [marker]:
        if name == marker and check is not None:
            check()
        tables[name].write.mode("overwrite").parquet(f"{top}/version={version}/{name}")


def committed(spark: SparkSession, top: str, marker: str) -> list[str]:
    """Versions that are complete, oldest first."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{top}/version=*/{marker}/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(s.getPath().getParent().getParent().getName().removeprefix("version=") for s in found)


def glob_paths(spark: SparkSession, pattern: str, parent: bool = False) -> list[str]:
    """The paths that match a glob pattern of the session's file systems, or their parents."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return [(s.getPath().getParent() if parent else s.getPath()).toString() for s in found]


def exists(spark: SparkSession, pattern: str) -> bool:
    return bool(glob_paths(spark, pattern))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all that it holds."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


_local: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: that of checkpoints, else the warehouse; of a local session a temporary one, deleted with it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if spark.sparkContext.applicationId not in _local:
        _local[spark.sparkContext.applicationId] = top = tempfile.mkdtemp(prefix="docweft-")
        atexit.register(shutil.rmtree, top, ignore_errors=True)
    return "file://" + _local[spark.sparkContext.applicationId]


class _Open(threading.local):
    """Paths written by ``kept`` inside each open ``scratch`` of a thread: streams run in threads of their own."""

    def __init__(self):
        self.lists: list[list[str]] = []


_open = _Open()


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: its lineage ends, and a lost executor costs a read."""
    path = f"{work_dir(df.sparkSession)}/docweft-kept-{name}-{uuid.uuid4().hex}"
    if _open.lists:
        _open.lists[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what ``kept`` writes inside: for jobs whose results are written elsewhere."""
    _open.lists.append([])
    try:
        yield
    finally:
        for path in _open.lists.pop():
            remove(spark, path)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Length and time of change of a table's folder: differs once its files do."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return f"{path}:{fs.getContentSummary(folder).getLength()}:{fs.getFileStatus(folder).getModificationTime()}"


def claimed(spark: SparkSession, top: str) -> str:
    """The next free version below a folder, claimed by creating its file: two writers never get the same."""
    folder = Folder(spark, f"{top}/claims")
    number = max([0, *(int(name) for name in folder.names() if name.isdigit())])
    while True:
        number += 1
        if folder.created(f"{number:012d}"):
            return f"{number:012d}"


class Keyed:
    """A table with a key, and what its writers may do: create, update, upsert, delete; every call gives a new table."""

    def __init__(self, rows: DataFrame, *keys: str):
        self.rows, self.keys = rows, list(keys)

    def created(self, new: DataFrame, *order: str) -> tuple[Keyed, DataFrame]:
        """With the new rows, and those refused: every new row is in one of the two.

        A row is refused if its key exists or is null, or if another new row with the key comes
        before it by the columns ``order`` (all other columns, if not given); of equal rows one is taken.
        """
        by = list(order) or [c for c in new.columns if c not in self.keys]
        old = self.rows.select(*self.keys).distinct().withColumn("_exists", F.lit(True))
        named = F.lit(True)
        for key in self.keys:
            named &= F.col(key).isNotNull()
        ranked = new.filter(named).withColumn("_turn", F.row_number().over(Window.partitionBy(*self.keys).orderBy(*(by or self.keys))))
        marked = ranked.join(old, self.keys, "left")
        good = F.col("_exists").isNull() & (F.col("_turn") == 1)
        refused = marked.filter(~good).select(*new.columns).unionByName(new.filter(~named))
        return Keyed(self.rows.unionByName(marked.filter(good).select(*new.columns)), *self.keys), refused

    def updated(self, changes: DataFrame, *order: str) -> Keyed:
        """Columns of ``changes`` replace those of the rows with its keys; other keys are ignored.

        Of several changes of a key the last by the columns ``order`` (all changed columns, if not given) holds.
        """
        fresh = [c for c in changes.columns if c not in self.keys and c in self.rows.columns]
        last = F.max_by(F.struct(*fresh), F.struct(*(order or fresh)))
        marked = changes.groupBy(*self.keys).agg(last.alias("_new"))
        both = self.rows.join(marked, self.keys, "left")
        return Keyed(both.select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in self.rows.columns)), *self.keys)

    def upserted(self, new: DataFrame) -> Keyed:
        return Keyed(upserted(self.rows, new, self.keys), *self.keys)

    def deleted(self, gone: DataFrame, *by: str) -> Keyed:
        """Without the rows whose columns ``by`` (the key, if not given) are among ``gone``."""
        on = list(by) or self.keys
        return Keyed(self.rows.join(gone.select(*on).distinct(), on, "left_anti"), *self.keys)


def appended(log: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """A log with new rows after its last: event ids go up by one in the given order."""
    from docweft.operators.dedup import vector_ids

    numbered = vector_ids(new, log.select(F.col("event_id").alias("vector_id")), order)
    return log.unionByName(numbered.withColumn("event_id", F.col("vector_id").cast("bigint")).select(*log.columns))
