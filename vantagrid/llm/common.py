"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What goes to a Python worker at once, unless the session says otherwise: texts may be very long.
BATCH_BYTES = 4 << 20
#: A side smaller than this may be broadcast; larger sides are shuffled.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where ``spark.checkpoint.dir`` is unset on a single machine (tests) a local
    temporary folder is taken; a cluster without the setting is refused, as its executors share no such folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes in this session, where its user hasn't set the bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Return what a Python worker has freed to the system; workers live on between tasks, and an idle one would hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def frugal(run):
    """A function over batches that gives back its memory when a task's rows are through."""

    @wraps(run)
    def through(*batches):
        try:
            yield from run(*batches)
        finally:
            give_back()

    return through


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage: what is written survives lost executors.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = scratch(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Mark ``df`` for broadcast if its rows are counted to fit.

    Beyond ``BROADCAST_BYTES`` the frame is returned as it is, and the join
    that uses it is an ordinary shuffled one with the same result.
    """
    rows = df.count()
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def bounded(df: DataFrame, row_bytes: Column) -> DataFrame:
    """As ``small``, by the sum of what each row takes."""
    total = df.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def whole_text(name: str = "text") -> Column:
    """The column as a string, null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def unused_name(df: DataFrame, kind: str) -> str:
    """A column name that ``df`` doesn't have."""
    name = f"_{kind}"
    while name in (c.lower() for c in df.columns):
        name += "_"
    return name
