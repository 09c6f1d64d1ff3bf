"""Cutting a plan's lineage: what an executor's loss or a long plan must not undo goes to the shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and goes on from there.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset (tests,
    single machines) a temporary folder stands in.
    """
    shared_folder(df.sparkSession)
    return bare(df.checkpoint(eager=True))


def pinned(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder and no more: for plans that must stay DataFrame operations only."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def bare(df: DataFrame) -> DataFrame:
    """The rows of a checkpointed frame without what the planner remembers of their origin.

    Constraints of an origin grow with every round of an iteration, its size estimates may be far
    off, and its partitioning would keep a later join from shuffling, and so from splitting, a hot key.
    """
    spark = df.sparkSession
    java = spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False)
    return DataFrame(java, spark)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.  A temporary folder stands in on a single machine only: on a
    cluster no other machine would see it."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lorekeep-"))
    return context._jsc.sc().getCheckpointDir().get()


def release(spark: SparkSession) -> None:
    """Lets go of what earlier plans left behind: Spark deletes shuffle files, checkpoints and broadcast
    blocks of plans that nobody refers to any more, but only after the driver has collected its garbage,
    which a driver with room to spare seldom does."""
    gc.collect()
    spark._jvm.System.gc()


def staged(df: DataFrame, **options: str) -> tuple[DataFrame, Callable[[], None]]:
    """Writes ``df`` as a table in the shared folder: the table, read column by column, and what deletes it.
    ``options`` are the writer's."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"

    def delete() -> None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    try:
        df.write.options(**options).parquet(path)
        return spark.read.schema(df.schema).parquet(path), delete
    except BaseException:
        delete()
        raise


@contextmanager
def kept_until_done(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """``staged`` for a block of code: its tables go when the block ends, whether it succeeds or not."""
    made: list[Callable[[], None]] = []

    def keep(df: DataFrame) -> DataFrame:
        rows, delete = staged(df)
        made.append(delete)
        return rows

    try:
        yield keep
    finally:
        for delete in made:
            delete()
        release(spark)
