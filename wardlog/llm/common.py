"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.session import configure

#: White space and words of the contracts; both exclude Unicode spaces.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same white space as a table for `bytes.translate` and `str.translate`.
TO_BLANK = {c: " " for c in range(9, 14)}
#: Bytes at which a batch of rows for Python ends; one row may be larger.
ARROW_BYTES = 2 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the library, and batches that stay small when texts are very long: those that Parquet's reader
    fills lie in the executor's heap as few large arrays, which it grows by doubling. Batches for Python end at 500 rows or
    `ARROW_BYTES`, whichever comes first; else 500 long texts would stand in the executor and its worker at once."""
    configure(spark)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def shrink_heaps(spark: SparkSession) -> None:
    """Executors' heaps return what is free in them to the system, which a JVM does after a full collection at the earliest.

    There is a task per core, so that idle executors get some each; one that gets none keeps its heap as it is.
    """
    cores = spark.sparkContext.defaultParallelism
    collected = spark.range(0, cores, 1, cores).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("done"))
    collected.write.format("noop").mode("overwrite").save()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z alone, whatever the locale."""
    return F.translate(column, UPPER, LOWER)


def text_of(name: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def bucket_count(rows: int, per_bucket: int, least: int = 64) -> int:
    """A power of two of buckets that hold about `per_bucket` rows each; never fewer than `least`."""
    buckets = least
    while buckets * per_bucket < rows:
        buckets *= 2
    return buckets


def words_of(text: str) -> list[str]:
    """Words between ASCII white space; Unicode spaces belong to words."""
    return [w for w in text.translate(TO_BLANK).split(" ") if w] if text else []


def as_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


Batches = Iterator[pa.RecordBatch]


#: Stores that earlier tasks of this Python worker left filled.
_KEPT: set[Callable] = set()


def give_back() -> None:
    """Returns freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(*stores: Callable, kept: tuple[Callable, ...] = ()) -> Callable:
    """Empties the named stores and gives memory back to the system when a task ends.

    A Python worker serves many operators after each other; what one of them keeps would burden the others. Stores in
    `kept`, which are dear to fill, stay for further tasks of the operator and go when a task of another one begins,
    before that task takes memory of its own. Memory is also given back before each task, since functions on groups
    run in the same workers without this.
    """

    def around(work: Callable[..., Batches]) -> Callable[..., Batches]:
        @wraps(work)
        def run(*args) -> Batches:
            for other in _KEPT.difference(kept):
                other.cache_clear()
            give_back()
            _KEPT.clear()
            _KEPT.update(kept)
            try:
                yield from work(*args)
            finally:
                for store in stores:
                    store.cache_clear()
                give_back()

        return run

    return around
