"""Work tables in the folder that all executors share, and broadcasts of a checked size."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import shared_dir

#: Bytes up to which a table is broadcast after it has been measured.
BROADCAST_BYTES = 32 << 20
#: Bytes that a row has at least in that measure.
ROW_BYTES = 16
#: Bytes of rows that an executor hands to a Python worker in one go.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEARED_AT_EXIT: set[str] = set()


def work_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    folder = work_folder(spark)
    if folder not in _CLEARED_AT_EXIT:
        _CLEARED_AT_EXIT.add(folder)
        atexit.register(_clear_quietly, spark)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or folder of any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Removes all work tables of this application. Frames that operators returned may read them: write those first."""
    remove(spark, work_folder(spark))


def _clear_quietly(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended already
        clear(spark)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: the lineage ends there, and lost executors cost no rework."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Removes what ``cut`` wrote, when nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have about ``BATCH_BYTES`` at most, unless they are set to be smaller. Spark's 64 MB a batch are buffers
    outside the heap, twice over while they grow and once more on the way back, and as much in the worker. No result depends on it."""
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(_BATCH, BATCH_BYTES)


@contextlib.contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """The same for what is run inside; the session is as before afterwards."""
    before = spark.conf.get(_BATCH)
    bound_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def _width(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            return F.aggregate(F.coalesce(column, F.array().cast(kind)), F.lit(0).cast("long"), lambda s, x: s + _width(x, kind.elementType) + 8)
        return F.coalesce(F.size(column), F.lit(0)).cast("long") * 8
    if isinstance(kind, T.StructType):
        return sum((_width(column[f.name], f.dataType) for f in kind.fields), F.lit(0).cast("long"))
    return F.lit(8).cast("long")


def fits(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the rows take at most ``most`` bytes. At most ``most`` / ROW_BYTES + 1 rows are looked at."""
    rows = most // ROW_BYTES
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(ROW_BYTES).cast("long"))
    n, size = df.select(width.alias("width")).limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum("width"), F.lit(0))).first()
    return n <= rows and size <= most


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """With a broadcast hint if the table has been measured to be small; as it is otherwise."""
    return F.broadcast(df) if fits(df, BROADCAST_BYTES if most is None else most) else df
