"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode alone a temporary one is set where the session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lodestrand-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` stored as Parquet in the shared folder and read back: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sample_below(n: int | float, size: int) -> float:
    """The share of the unit interval below which ``n`` uniform hashes are expected to leave ``size`` and some to spare.

    A row is in a sample if its hash is below this, so no task and no driver orders all rows; the spare (over four
    standard deviations) is cut off afterwards, first in the order of the hash.
    """
    return 1.0 if n <= 0 else min(1.0, (size + 5 * size**0.5 + 10) / n)


def unit_hash(*columns) -> Column:
    """A hash of columns as a number from 0 to below 1."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def without(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add, so that names stay unique."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in columns))


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")


def flat_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text in one flat array, and the offsets of the texts in it (null: none)."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    lists = pc.fill_null(lists, pa.scalar([], lists.type)) if lists.null_count else lists
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        before = np.concatenate([[0], np.cumsum(full)])
        words, offsets = words.filter(pa.array(full)), before[offsets]
    return words, offsets


def one(column) -> pa.Array:
    """A chunked column as one array."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) and column.num_chunks != 1 else column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries do it on their own
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """For a function of batches: what a task has freed goes back to the machine, as Python workers outlive their tasks."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def tidy_group(run):
    """The same for a function of a whole group."""

    def wrapped(group):
        try:
            return run(group)
        finally:
            give_back()

    return wrapped


def tidy_pair(run):
    """The same for a function of two groups."""

    def wrapped(left, right):
        try:
            return run(left, right)
        finally:
            give_back()

    return wrapped


def slices(batch: pa.RecordBatch, column: int, most: int = 12 << 20):
    """The batch in runs of rows with about ``most`` bytes of text, one row at least."""
    size = pc.fill_null(pc.binary_length(one(batch.column(column))), 0).to_numpy(zero_copy_only=False)
    edge = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    i = 0
    while i < batch.num_rows:
        j = min(batch.num_rows, max(i + 1, int(np.searchsorted(edge, edge[i] + most, side="right")) - 1))
        yield batch.slice(i, j - i)
        i = j
