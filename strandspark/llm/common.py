"""Helpers shared by the training-data operators: shared storage, Arrow byte blocks, small numpy kernels."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD_BREAK = r"[\x20\x09-\x0D]+"

#: Bytes 0x20 and 0x09-0x0D, as a lookup table.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_gave_back = float("-inf")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark whatever store the path names."""
    small_batches(spark)
    short_plans(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a session with a local
    master gets a temporary one, and any other an error: its executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Have Spark delete the shuffle files of each execution within as soon as it ends, not when the driver collects
    garbage. For executions whose DataFrame is not executed again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet in the shared folder and return it reread. Survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandspark/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    give_back_driver(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def save_bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like :func:`save`, in buckets of `key`: later joins and groups by it do not shuffle the table again."""
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    path, view = f"{shared_dir(spark)}/strandspark/{name}-{mark}", f"strandspark_{mark}"
    with shuffles_dropped(spark):
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(shuffle_partitions(spark), key).saveAsTable(view)
    out = spark.table(view)
    out._saved_at, out._saved_as = path, view
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete tables made by :func:`save` or :func:`save_bucketed` that no later read needs."""
    for df in tables:
        path = getattr(df, "_saved_at", None)
        if path:
            spark = df.sparkSession
            if hasattr(df, "_saved_as"):
                spark.sql(f"DROP TABLE IF EXISTS {df._saved_as}")
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Have Spark send Python at most `rows` rows at once from now on: batches of long texts then stay small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > rows:
        spark.conf.set(name, str(rows))


def short_plans(spark: SparkSession, letters: int = 1 << 13) -> None:
    """Have Spark describe a plan by at most `letters` letters from now on. The driver keeps the descriptions of the last
    thousand executions, and those with a rank map are of some millions."""
    name = "spark.sql.maxPlanStringLength"
    if int(spark.conf.get(name, str((1 << 31) - 16))) > letters:
        spark.conf.set(name, str(letters))


def give_back() -> None:
    """Return freed memory to the system: Python workers wait for other tasks with what they have."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def give_back_driver(spark: SparkSession, every: float = 5) -> bool:
    """Return memory that the driver's JVM has freed outside its heap to the system, at most once in `every` seconds: Spark
    starts hundreds of threads there, and the C library keeps what each has freed. False if it was too soon, or if the
    JVM cannot do it (before 17.0.9, or without glibc)."""
    global _gave_back
    if time.monotonic() - _gave_back < every:
        return False
    _gave_back = time.monotonic()
    jvm = spark._jvm
    beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    # by reflection, as the server's class is not exported
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        invoke.invoke(beans, args)
    except Py4JJavaError:
        return False
    return True


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def words_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")).cast("long")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and its n + 1 offsets; nulls are empty."""
    arr = column.cast(pa.large_binary())
    if arr.null_count:
        arr = pc.fill_null(arr, b"")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_blocks(batches: Iterable[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut record batches into runs of rows of about `limit` text bytes (a longer text stands alone)."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            lo = offsets[at]
            yield batch.slice(at, end - at), data[lo : offsets[end]], offsets[at : end + 1] - lo
            at = end


def long_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(name).cast(pa.int64())


def union_labels(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of a[i] and b[i]; `parent` holds each node's smallest known member, flat on entry and exit."""
    while len(a):
        pa_, pb = parent[a], parent[b]
        open_ = pa_ != pb
        if not open_.any():
            return
        a, b, pa_, pb = a[open_], b[open_], pa_[open_], pb[open_]
        np.minimum.at(parent, np.maximum(pa_, pb), np.minimum(pa_, pb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up
