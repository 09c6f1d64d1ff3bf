"""An inbox of batch files as a stream: each file is ingested once, in the order of arrival."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lorekeep.plans import engine


def watch(spark: SparkSession, folder: str, checkpoint: str, contract_path: str, address: str, *, on_result: Callable[[str, engine.Result], None] | None = None, available_now: bool = True, **options: object) -> StreamingQuery:
    """Starts a query that ingests new YAML files of ``folder``.

    There is one writer: a micro-batch's files are taken one after another on the driver.  A batch
    that is replayed after a failure finds its items unchanged, so nothing is written twice.
    """
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.yaml").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)

    def take(batch: DataFrame, epoch: int) -> None:
        for row in batch.select("path", "modificationTime").orderBy("modificationTime", "path").collect():
            path = row["path"].removeprefix("file:")
            result = engine.ingest(batch.sparkSession, path, contract_path, address, apply=True, **options)
            if on_result:
                on_result(path, result)

    writer = files.select("path", "modificationTime").writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
