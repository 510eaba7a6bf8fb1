"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one Arrow batch may bring to a Python worker (and eight times the bytes), and bytes that are worked on at once.
BATCH_ROWS, BATCH_BYTES = 2000, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, read from the session. Only in local mode, where the driver and its tasks share a disk,
    a folder of our own is set if there is none (tests); on a cluster that is an error. It is deleted when the application ends."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if folder is None and context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gridloom-"))
    folder = context._jsc.sc().getCheckpointDir().get()  # Spark's own for this application, inside the one that is set
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Spark's setting for queries that delete their shuffle files as they end.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, clean: bool = False) -> DataFrame:
    """df with its lineage cut by checkpoint() in the shared folder. clean: the shuffle files that it was made from go at once,
    and not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    shared_folder(spark)
    if not clean:
        return df.checkpoint()
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        return df.select("*").checkpoint()  # a plan of its own: one keeps the setting with which it was made
    finally:
        spark.conf.set(_CLEAN, before)


class Rounds:
    """Tables of an iteration: each is written to the shared folder and read again, and the one before is deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", 0

    def next(self, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.folder}/{self.n}")
        if self.n:
            remove(self.spark, f"{self.folder}/{self.n - 1}")
        self.n += 1
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.n - 1}")

    def drop(self) -> None:
        remove(self.spark, self.folder)


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of an Arrow batch to BATCH_ROWS and 8 * BATCH_BYTES; lower ones stay.

    Spark reads them when a plan runs and not when it is made, so they can't be put back before a lazy result is used.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", 8 * BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).removesuffix("b")
        now = int(now) if now.isdigit() else 0
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Return what a task has freed to the system. Workers outlive their tasks, and their allocators keep freed memory."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # other C libraries have none
    _TRIM = None


def arrow_map(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow over slices of a bounded number of bytes; each(batch) gives a batch of ``schema`` or None."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                if (out := each(part)) is not None:
                    yield out
        give_back()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of the batch of about ``most`` bytes, of one row at least."""
    n = batch.num_rows
    if n == 0:
        return
    pieces = min(n, ceil(batch.nbytes / most)) or 1
    step = ceil(n / pieces)
    for at in range(0, n, step):
        yield batch.slice(at, step)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def numbered(df: DataFrame, order: list[Column], group: list[str] | None = None, name: str = "_n") -> DataFrame:
    """df with the 0-based position of each row in ``order`` (within ``group``, whose columns must lead the order).

    Rows are range-partitioned and sorted, so that no key is gathered in one task; each row's place in its
    partition comes from monotonically_increasing_id(), and the partitions' offsets from a table of one row per
    partition (and group in it). Equal rows are dealt over partitions by the row's number in the scan.
    """
    group = group or []
    salt = F.monotonically_increasing_id().alias("_salt")
    dealt = df.select("*", salt)
    keys = [*order, F.col("_salt")]
    ordered = saved(dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).drop("_salt"))
    ordered = ordered.withColumn("_part", F.shiftright("_at", 33))
    counts = ordered.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    if group:
        same = F.col("a._part") == F.col("b._part")
        for g in group:
            same &= F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
        out = ordered.alias("a").join(offsets.alias("b"), same)
    else:  # a row for each shuffle partition: bounded whatever the input is
        out = ordered.alias("a").join(F.broadcast(offsets).alias("b"), F.col("a._part") == F.col("b._part"))
    own = [F.col(f"a.{c}") for c in ordered.columns if c not in ("_at", "_part")]
    return out.select(*own, (F.col("b._before") + F.col("a._at") - F.col("b._first")).alias(name))


def near_square(n: int) -> tuple[int, int]:
    """(a, b) with a * b >= n and a * b - n < a, both near the root of n."""
    a = max(1, isqrt(max(0, n - 1)) + 1) if n > 1 else 1
    return a, max(1, -(-n // a))


# Hashes of words, and of runs of words, of many texts at once.


def _powers(p: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        more = min(done, n - done)
        with np.errstate(over="ignore"):
            out[done : done + more] = out[:more] * (out[done - 1] * p)
        done += more
    return out


class Rolling:
    """Polynomial hashes modulo 2**64 of ranges of a sequence of 64-bit values."""

    def __init__(self, p: int):
        self.p = np.uint64(p | 1)
        self.inv = np.uint64(pow(int(self.p), -1, 1 << 64))
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n += n >> 2
            self.up, self.down = _powers(self.p, n), _powers(self.inv, n)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self.grow(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((prefix[end] - prefix[start]) * self.down[start])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def word_hashes(data: bytes, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of the byte ranges, which must not be empty: blocks of 8 bytes chained through ``mixed``, or BLAKE2b.

    Words of up to 8 bytes and of equal length never collide; streams of two seeds are independent.
    """
    data += bytes(8)
    blocks = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    size = end - start
    with np.errstate(over="ignore"):
        out = mixed(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        out = mixed(out ^ (blocks[start] & masks[np.minimum(size, 8)]))
        some = np.flatnonzero((size > 8) & (size <= LONG_WORD))
        at = 8
        while len(some):
            block = blocks[start[some] + at] & masks[np.minimum(size[some] - at, 8)]
            out[some] = mixed(out[some] * np.uint64(0xD6E8FEB86659FD93) + block)
            at += 8
            some = some[size[some] > at]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]], digest_size=8, key=seed.to_bytes(8, "little")).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of several texts: byte ranges in ``data``, each text's range of words, and for each seed
    the words' 64-bit hashes."""

    def __init__(self, texts: list[bytes], *seeds: int):
        self.data = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.data, np.uint8)
        gap = SPACE[raw]
        word = ~gap
        before = np.empty_like(gap)
        before[0], before[1:] = True, gap[:-1]
        self.start = np.flatnonzero(word & before)
        after = np.empty_like(gap)
        after[-1], after[:-1] = True, gap[1:]
        self.end = np.flatnonzero(word & after) + 1
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_end = np.cumsum(sizes)
        self.first = np.searchsorted(self.start, self.text_end - sizes)
        self.last = np.searchsorted(self.start, self.text_end)
        self.hashes = [word_hashes(self.data, self.start, self.end, s) for s in seeds]

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first)), self.last - self.first)
