"""What several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.session import shared_dir, ship_package

#: Rows that a Python stage works on at a time at most (Spark bounds the bytes of the batches it sends).
BATCH_ROWS = 512


def prepared(spark: SparkSession) -> None:
    """Make Python stages ready: the package on the executors. No setting of the session is changed."""
    ship_package(spark)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files and driver state of what nothing refers to any more.

    Its cleaner follows the driver's garbage collection, which may be long in coming; behind a
    checkpoint all that led to it is garbage.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of the batches that Spark sends to Python stages while a table is written here: fewer than usual, for long texts.
SENT_ROWS = 2048


#: Of each session, how many writers are at work, and the setting that they found.
_WRITERS: dict[int, tuple[int, str]] = {}
_WRITERS_LOCK = threading.Lock()


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of ``SENT_ROWS`` at most for what is computed inside; behind the last of several threads the session's setting stands again."""
    key, own = "spark.sql.execution.arrow.maxRecordsPerBatch", id(spark)
    with _WRITERS_LOCK:
        n, before = _WRITERS.get(own, (0, spark.conf.get(key, "10000")))
        if not 0 < int(before) <= SENT_ROWS:
            spark.conf.set(key, str(SENT_ROWS))
        _WRITERS[own] = n + 1, before
    try:
        yield
    finally:
        with _WRITERS_LOCK:
            n, before = _WRITERS.pop(own)
            if n > 1:
                _WRITERS[own] = n - 1, before
            else:
                spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from a checkpoint in the shared folder, without their lineage."""
    shared_dir(df.sparkSession)
    with _small_batches(df.sparkSession):
        out = df.checkpoint(eager=True)
    release(df.sparkSession)
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows written as a Parquet table in the shared folder and read again (columns are pruned on each read)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quillgrid-{name}-{uuid.uuid4().hex}"
    with _small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, whatever the case of its letters."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


#: Rows of a few numbers each that are sent to every task; more are joined by a shuffle.
SENT_ROWS_AT_MOST = 500_000


def sent_if_few(df: DataFrame) -> DataFrame:
    """The rows, marked to be sent to all tasks where they are few; they are counted for it, so they should be written somewhere."""
    return F.broadcast(df) if df.count() <= SENT_ROWS_AT_MOST else df


def shuffled(df: DataFrame) -> DataFrame:
    """The rows, marked to be joined by a shuffle whatever Spark takes for their size.

    Rows that an explode or a Python stage has multiplied, or that were read from well compressed files, are
    many times what Spark takes them for, and would be sent to all tasks through the driver.
    """
    return df.hint("merge")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % parts


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A string column as Python strings, nulls as empty ones."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def replaced(batch: pa.RecordBatch, drop: str, **new: pa.Array) -> pa.RecordBatch:
    """The batch without one column and with new ones at its end."""
    keep = [f.name for f in batch.schema if f.name != drop]
    return pa.RecordBatch.from_arrays(
        [batch.column(batch.schema.get_field_index(n)) for n in keep] + list(new.values()), names=keep + list(new)
    )


Batches = Iterator[pa.RecordBatch]


def _hand_back() -> None:
    """Give memory that a Python worker has freed back to the system: workers live on between stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable[[Batches], Batches], rows: int = BATCH_ROWS) -> Callable[[Batches], Batches]:
    """A function for mapInArrow that works on ``rows`` rows at a time and hands freed memory back at the end of its task."""

    def tidy(batches: Batches) -> Batches:
        yield from run(b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows))
        _hand_back()

    return tidy
