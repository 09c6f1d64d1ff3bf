"""Helpers that every operator of this folder shares."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.lineage import cut, kept_until_done, release, staged  # noqa: F401  for the operators here
from lorekeep.workers import ship

#: The white space of every contract: space and U+0009 to U+000D, and nothing else.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark alone (the folder may be a remote store)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only.  Pure ASCII values take the cheap built-in way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


#: Rows and bytes of an Arrow batch on its way to a Python worker.  The defaults (10,000 rows, 64 MB) make
#: every task hold some hundred MB of whole texts outside the heap.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, unless the session says something else."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(most))


def trim() -> None:
    """Gives memory that this process no longer uses back to the system: idle workers stay alive."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow``, with this package on the workers, in small batches."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        trim()

    return df.mapInArrow(trimmed, schema)


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def bins_of(docs: DataFrame, bin_bytes: int) -> int:
    """As many as shuffles have partitions, and more for a large input, so that a bin stays small."""
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // bin_bytes, 1_000_000) if size < 1 << 60 else 0)


def answered_id(id_col: str, results: list[str]) -> str:
    """What a result calls the id column: its own name, or that with ``_id`` behind it as long as a column of the result has it."""
    while id_col in results:
        id_col += "_id"
    return id_col


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; a null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def in_blocks(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows whose texts hold about ``most_bytes``; a longer text is a block of its own."""
    for batch in batches:
        begin = size = 0
        lengths = pa.compute.binary_length(batch.column(column).cast(pa.binary())).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > most_bytes:
                yield batch.slice(begin, i - begin)
                begin, size = i, 0
            size += n
        if len(lengths) > begin:
            yield batch.slice(begin)
