"""What the operators of this package share: staging, Arrow batches, folds and skew-safe lookups."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.staging import fresh_path, shared_root, staged

__all__ = ["fresh_path", "shared_root", "staged"]

#: Text bytes that a worker handles at once; a longer document is a slice of its own.
SLICE_BYTES = 4 << 20
#: Rows that Spark sends to a worker in one Arrow batch.
BATCH_ROWS = 1500


def tune(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches by rows and bytes, for texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def write_frames(df: DataFrame, path: str, frame: str = "frame", **options: str) -> None:
    """Write the binary column `frame` row after row, each followed by one newline byte, a file a partition.

    Spark's own text writer does it, so any Hadoop file system and lost executors are covered.
    """
    writer = df.select(F.col(frame).cast("string").alias("value")).write.option("lineSep", "\n")
    writer.options(**options).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every data file below path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds about `limit` bytes of `column` at most, a row at least.

    What another stage's operator left in this worker is released first.
    """
    if _held and _held_for != _stage_id():
        _release()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        if ends[-1] <= limit:
            yield batch
            continue
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.StringArray:
    """The column with null as the empty text."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def as_batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def fold_of(ids: pa.Array, mod: int) -> np.ndarray:
    """crc32 of each id as decimal text, modulo mod; a null id counts as the empty text."""
    return np.fromiter((zlib.crc32(b"" if x is None else str(x).encode()) % mod for x in ids.to_pylist()), np.int64, len(ids))


def fold(column: str, mod: int) -> Column:
    """fold_of as an expression."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front until df has no such column."""
    while name in df.columns:
        name = f"_{name}"
    return name


def row_key(id_col: str, text_col: str) -> Column:
    """What tells rows apart whose id is null or repeated: the id and the text's hash."""
    return F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.xxhash64(text_col).cast("string"))


def lookup_join(left: DataFrame, totals: DataFrame, key: str, count: str, hot_rows: int = 20_000, hot_keys: int = 4096) -> DataFrame:
    """left outer join with `totals` (unique by key), whose column `count` tells how many rows of left have the key.

    Keys of over hot_rows rows are joined by broadcast, the hot_keys most frequent of them at most,
    which bounds the broadcast; all others share evenly dealt partitions.
    """
    hot = totals.filter(F.col(count) > hot_rows).orderBy(F.col(count).desc(), F.col(key)).limit(hot_keys)
    marked = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    extra = [c for c in totals.columns if c != key]
    done = marked.filter(F.col("_hot")).drop("_hot")
    rest = marked.filter(F.col("_hot").isNull()).drop("_hot", *extra)
    return done.unionByName(rest.join(totals, key, "left").select(*done.columns))


class TwoGenerations:
    """A bounded memo: what was not asked for during a whole generation is forgotten."""

    def __init__(self, cap: int):
        self.cap, self.young, self.old = cap, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.cap:
            self.old, self.young = self.young, {}
        self.young[key] = value


_held: dict = {}
_held_for: int | None = None


def _stage_id() -> int | None:
    context = TaskContext.get()
    return context.stageId() if context else None


def once(kind: str, key, make: Callable):
    """A worker process keeps one thing that is dear to build, from task to task of the stages that use it.

    Large memos make full garbage collections slow, so those become rare.
    """
    global _held_for
    _held_for = _stage_id()
    if (kind, key) not in _held:
        _release()
        gc.set_threshold(500_000, 50, 100)
        _held[kind, key] = make()
    return _held[kind, key]


def _release() -> None:
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can give memory back
        ctypes.CDLL(None).malloc_trim(0)
