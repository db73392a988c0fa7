"""Where intermediate tables go, and how a plan's lineage is cut.

Every intermediate result that is read more than once is written as Parquet below
the folder that the cluster names in ``spark.checkpoint.dir``, which all executors
and the driver share.  A lost executor therefore costs a re-read, never the result.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch at most.
BATCH_ROWS = 2048


def shared_dir(spark: SparkSession) -> str:
    """The shared folder.  Where the session names none, a local session gets a temporary one; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docweft-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Hand at most ``BATCH_ROWS`` rows at a time to Python, so that a task holds a few MB of texts beside its scratch arrays.

    The session keeps the setting: results are planned and run after their operator has returned.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


class _Open(threading.local):
    """Paths written inside each open ``scratch`` of a thread: streams run in threads of their own."""

    def __init__(self):
        self.lists: list[list[str]] = []


_open = _Open()


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder, with the writer's ``options``, and read it back: the lineage ends there."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/docweft-{name}-{uuid.uuid4().hex}"
    if _open.lists:
        _open.lists[-1].append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Delete at the end what ``stored`` writes inside; paths taken out of the list that it gives are left."""
    _open.lists.append([])
    try:
        yield _open.lists[-1]
    finally:
        for path in _open.lists.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, pattern: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(path) or []:
        fs.delete(status.getPath(), True)


def drop_stored(spark: SparkSession) -> None:
    """Delete every table that ``stored`` wrote into the shared folder of this session."""
    _delete(spark, f"{shared_dir(spark)}/docweft-*")


#: A key is hot if more than this part of all rows have it: there are fewer hot keys than that.
FREQUENT = 1000


def hot_keys(counts: DataFrame, key: str, count: str) -> DataFrame:
    """(key, count) of the hot keys of a (stored) table with the number of rows of each key; at most ``FREQUENT`` rows at any size."""
    total = counts.agg(F.sum(count).alias("_docweft_total"))
    return counts.join(F.broadcast(total)).filter(F.col(count) * FREQUENT > F.col("_docweft_total")).select(key, count)


def spread_join(rows: DataFrame, by_key: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``rows`` inner joined with a (stored) table of one row a key, without a task that has the rows of a hot key.

    What ``by_key`` has of the ``hot`` keys goes to all tasks; the rest is shuffled, and rows of
    hot keys are dealt over all partitions there.
    """
    names = [c for c in by_key.columns if c != key]
    held = F.struct(*names) if names else F.struct(F.lit(True).alias("_docweft_held"))
    known = by_key.join(F.broadcast(hot.select(key).withColumn("_docweft_hot", F.lit(True))), key, "left").withColumn("_docweft_row", held)
    sent = known.filter("_docweft_hot").select(key, F.col("_docweft_row").alias("_docweft_sent"))
    met = known.filter("_docweft_hot IS NULL").select(key, F.xxhash64(key).alias("_docweft_salt"), F.col("_docweft_row").alias("_docweft_met"))
    own = F.when(F.col("_docweft_sent").isNull(), F.xxhash64(key)).otherwise(F.xxhash64(*rows.columns))
    dealt = rows.join(F.broadcast(sent), key, "left").withColumn("_docweft_salt", own)
    joined = dealt.join(met, [key, "_docweft_salt"], "left").withColumn("_docweft_row", F.coalesce("_docweft_sent", "_docweft_met")).filter("_docweft_row IS NOT NULL")
    return joined.select(*rows.columns, *(F.col(f"_docweft_row.{c}").alias(c) for c in names))
