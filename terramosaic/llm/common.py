"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from terramosaic import shipping

#: Text bytes that one numpy pass works on; bounds the scratch arrays of a worker.
CHUNK_BYTES = 4 << 20
#: Rows and bytes of a batch between Spark and a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Taken from ``spark.checkpoint.dir``. Only a local session may name none (a
    test) and gets a folder of its own; on a cluster that is an error.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_to = f"file://{tempfile.mkdtemp(prefix='terramosaic-')}"
        spark.conf.set("spark.checkpoint.dir", set_to)
    return set_to.rstrip("/")


def shared_path(spark: SparkSession, stem: str) -> str:
    return f"{shared_dir(spark)}/{stem}-{uuid.uuid4().hex}"


def written(df: DataFrame, stem: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage and survives lost executors, since the files belong to no
    executor.
    """
    path = shared_path(df.sparkSession, stem)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def remove_written(*tables: DataFrame) -> None:
    """Delete the files of tables made by written() that no later plan reads."""
    for table in tables:
        remove_dir(table.sparkSession, table._written)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a shared folder that no later plan reads."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes in a column; one narrow scan, used to size partitions."""
    from pyspark.sql import functions as F

    return int(df.agg(F.sum(F.octet_length(F.col(column))).alias("n")).first()["n"] or 0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without making Python strings; null is empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_string()).cast(pa.large_binary())
    offsets = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1 + arr.offset)[arr.offset :]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def doc_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together stay near ``limit`` bytes (one long text may exceed it)."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


Rows = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(rows: Rows, forget: Callable[[], None] | None = None) -> Rows:
    """A map of batches that leaves nothing behind in its worker process.

    Spark keeps workers for later tasks, those of other operators too. What a map
    with ``forget`` keeps serves its own next task and is dropped by it when a map
    without begins. Freed memory, which the allocators would hold, goes back to
    the system at the end of a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if forget is None:
            drop_kept()
        else:
            keep(forget)
        try:
            yield from rows(batches)
        finally:
            give_back()

    return run


#: In a worker: what drops the things kept for the next task.
_KEPT: list[Callable[[], None]] = []


def keep(forget: Callable[[], None]) -> None:
    if forget not in _KEPT:
        _KEPT.append(forget)


def drop_kept() -> None:
    while _KEPT:
        _KEPT.pop()()


def give_back() -> None:
    """Return freed memory of this process to the system, where its allocators can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def ship(spark: SparkSession) -> None:
    """Give the executors the sources, and bound what a Python worker holds at once.

    Rows travel in batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes,
    whatever the length of the texts.
    """
    shipping.ship(spark)
    for key, limit in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(key, str(limit))
