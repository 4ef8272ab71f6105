"""What the operators share: input tables, the shared folder, shipping code, and size-checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelab.shipping import ship

#: Rows below which a side of two or three longs may be broadcast (about 16 MB).
BROADCAST_ROWS = 200_000
#: Bytes below which a side with rows of any length may be broadcast.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder; a cluster must name one.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or getattr(context, "_passagelab_shared", None)
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = context._passagelab_shared = "file://" + tempfile.mkdtemp(prefix="passagelab-")
    return named if "://" in named or named.startswith("file:") else "file://" + os.path.abspath(named)


def new_folder(spark: SparkSession, label: str) -> str:
    """The path of a folder that does not exist yet, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/passagelab/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


#: Spark 4.1 removes the shuffle files of an execution at its end where this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written here leaves no shuffle files behind; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before or "false")


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, which survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again.written_to = path
    return again


def written_apart(df: DataFrame, label: str, chosen) -> tuple[DataFrame, DataFrame]:
    """The rows of df for which `chosen` holds, and the others, as two tables like those of written(), made in one pass."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.withColumn("apart", chosen).write.option("compression", "zstd").partitionBy("apart").parquet(path)
    out = []
    for value in ("true", "false"):
        place = f"{path}/apart={value}"
        if exists(spark, place):
            again = spark.read.schema(df.schema).parquet(place)
            again.written_to = place
        else:
            again = spark.createDataFrame([], df.schema)
        out.append(again)
    return out[0], out[1]


def free_name(df: DataFrame, label: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{label}"
    while name in taken:
        name = f"_{name}"
    return name


def forget(*frames: DataFrame) -> None:
    """Deletes tables made by written() that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "written_to", None):
            remove(df.sparkSession, path)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit, else unchanged (a shuffle join)."""
    return F.broadcast(df) if rows <= limit else df


def light(df: DataFrame, size: int) -> DataFrame:
    """df with a broadcast hint if its measured size in bytes is within BROADCAST_BYTES, else unchanged (a shuffle join)."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


ROWS_KEY, ROWS_DEFAULT, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with this package on the executors.

    Rows are whole texts, so a session that has Spark's default of 10,000 rows in a batch gets 1,000. Workers serve one
    task after another; each task gives its memory back at its end.
    """
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(ROWS_KEY, ROWS_DEFAULT) == ROWS_DEFAULT:
        spark.conf.set(ROWS_KEY, ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, most_rows: int = 256, most_chars: int = 1_000_000) -> Iterator[tuple[int, list]]:
    """(first row, values) of pieces of a batch that are bounded in rows and, but for single rows, in characters."""
    values = batch.column(column)
    start, chars, piece = 0, 0, []
    for value in values:
        value = value.as_py()
        n = len(value) if value is not None else 0
        if piece and (len(piece) >= most_rows or chars + n > most_chars):
            yield start, piece
            start, chars, piece = start + len(piece), 0, []
        piece.append(value)
        chars += n
    if piece:
        yield start, piece
