"""Moving packed blocks of integers through Spark's shuffle, and tables in the shared folder.

A map task packs what it found into one binary row for each reducer; a reducer
unpacks them with numpy. The number of reducers follows the input, so a block
stays small at any size, and a row costs no more than its integers.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwright.code import ship_code

#: Input bytes for each reducer, at most (by Spark's estimate of the input's size), however large the input is.
REDUCER_BYTES = 256 << 20
#: Whether Spark deletes a query's shuffle files at its end.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark gives tables of unknown size the largest long.
_UNKNOWN = 1 << 60
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch of whole texts that goes to a worker: it lies in the JVM, in the pipe and in the worker, for each task.
TEXT_BATCH = 8 << 20
_own_folder: list[str] = []


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int = TEXT_BATCH) -> Iterator[None]:
    """What is written in here sends workers batches of about `size` bytes (a larger row alone), not of thousands of texts of any length."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, size)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or else the context's checkpoint folder.

    Where both are unset, a local folder of this process serves in local mode, as in tests; a cluster raises, as its
    executors would write to disks of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="fieldwright-"))
    return f"file://{_own_folder[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def keep(frame: DataFrame, name: str) -> DataFrame:
    """Write the frame as a table in the shared folder and read it back: lineage ends there, and no executor's loss undoes it.

    What was shuffled for it is deleted when the table stands; else it would lie on the disks until the driver collects garbage.
    """
    spark, path = frame.sparkSession, new_path(frame.sparkSession, name)
    before = spark.conf.get(_DROP_SHUFFLES)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        frame.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    out = spark.read.schema(frame.schema).parquet(path)
    out.kept_at = path
    return out


def discard(frame: DataFrame) -> None:
    """Delete the table of a frame that `keep` gave and that nothing reads any more."""
    spark = frame.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(frame.kept_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def reducers(frame: DataFrame, each: int = REDUCER_BYTES) -> int:
    """The session's shuffle partitions, or one for `each` bytes where the tables read are large. Tables of unknown size don't count."""
    spark = frame.sparkSession
    leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < _UNKNOWN)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // each)


def _murmur(k: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's hash() of each int."""

    def turn(x: np.ndarray, n: int) -> np.ndarray:
        return (x << np.uint32(n)) | (x >> np.uint32(32 - n))

    k = turn(k.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = turn(np.uint32(seed) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def bucket_keys(n: int) -> np.ndarray:
    """For each of n partitions, an int that Spark's hash partitioning sends there."""
    out = np.full(n, -1, np.int64)
    k, step = 0, max(1024, 2 * n)
    while (out < 0).any():
        p = _murmur(np.arange(k, k + step)).astype(np.int64) % n
        part, first = np.unique(p, return_index=True)
        new = out[part] < 0
        out[part[new]] = k + first[new]
        k += step
    return out


def give_back() -> None:
    """Return freed memory to the system, where the C library can: workers are kept from task to task beside a full JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def arrow(frame: DataFrame, function: Callable, ddl: str) -> DataFrame:
    """mapInArrow, with this package at hand in the workers; what a task has freed is given back between batches."""
    ship_code(frame.sparkSession)

    def run(batches):
        yield from function(_one_by_one(batches))
        give_back()

    return frame.mapInArrow(run, ddl)


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch
        del batch
        give_back()


BLOCKS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.binary())])
BLOCKS_DDL = "bucket int, kind int, block binary"


def block_batches(rows: list[tuple[int, int, bytes]], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of (bucket, kind, block) rows, of about `most` bytes each."""
    lo, size = 0, 0
    for i, row in enumerate(rows):
        size += len(row[2])
        if size >= most or i == len(rows) - 1:
            b, k, x = zip(*rows[lo : i + 1], strict=True)
            yield pa.record_batch([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(x, pa.binary())], schema=BLOCKS)
            lo, size = i + 1, 0


def split_by(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that groups equal buckets, and where each bucket begins in it (n + 1 entries)."""
    small = bucket.astype(np.uint16) if n <= 65536 else bucket
    order = np.argsort(small, kind="stable")
    return order, np.searchsorted(small[order], np.arange(n + 1).astype(small.dtype) if n < 65536 else np.arange(n + 1))


def deal(blocks: DataFrame, n: int) -> DataFrame:
    """Blocks of one bucket meet in one task, in bucket order."""
    return blocks.repartition(n, F.col("bucket")).sortWithinPartitions("bucket")


def reduce_blocks(
    blocks: DataFrame, n: int, reducer: Callable[[list[tuple[int, bytes]]], Iterator[pa.RecordBatch]], ddl: str
) -> DataFrame:
    """Run `reducer` on the (kind, block) list of each bucket. Only one bucket is in memory at a time."""

    def run(batches):
        now, held = None, []
        for batch in batches:
            for b, k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if b != now:
                    if held:
                        yield from reducer(held)
                    now, held = b, []
                held.append((k, x.as_buffer()))
        if held:
            yield from reducer(held)

    return arrow(deal(blocks, n), run, ddl)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one block: their count, then for each its type, length and bytes."""
    out = [len(arrays).to_bytes(4, "little")]
    for a in arrays:
        a = np.ascontiguousarray(a)
        out += [a.dtype.str.encode().ljust(8), a.size.to_bytes(8, "little"), a.tobytes()]
    return b"".join(out)


def unpack(block) -> list[np.ndarray]:
    view = memoryview(block)
    n, at, out = int.from_bytes(view[:4], "little"), 4, []
    for _ in range(n):
        kind = np.dtype(bytes(view[at : at + 8]).strip().decode())
        size = int.from_bytes(view[at + 8 : at + 16], "little")
        out.append(np.frombuffer(view[at + 16 : at + 16 + size * kind.itemsize], kind))
        at += 16 + size * kind.itemsize
    return out


def squeeze(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The upper 48 bits of each hash, as two arrays of 32 and 16 bits."""
    return (h >> np.uint64(32)).astype(np.uint32), ((h >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.uint16)


def unsqueeze(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.uint64) << np.uint64(16)) | low.astype(np.uint64)
