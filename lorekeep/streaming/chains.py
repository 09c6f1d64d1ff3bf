"""Audit logs of any length from a stream of entries: each log's head is keyed state, carried over micro-batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorekeep.functions import lexicon as L

#: Lines that are objects of Python at once; all others of a micro-batch are held as Arrow's bytes.
AT_ONCE = 10_000
COMPACT = pa.schema([("line", pa.int64()), ("payload", pa.large_string())])

def continuing() -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """What continues one log by the lines of a micro-batch."""

    def extend(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        head, last = state.get if state.exists else (L.GENESIS, None)
        held = pa.Table.from_batches([pa.RecordBatch.from_pandas(f[["line", "payload"]], schema=COMPACT, preserve_index=False) for f in frames], COMPACT)
        lines = held.column("line").to_numpy()
        order = np.argsort(lines, kind="stable")
        for i in range(0, len(order), AT_ONCE):
            out = []
            for line, payload in zip(lines[order[i : i + AT_ONCE]].tolist(), held.column("payload").take(pa.array(order[i : i + AT_ONCE])).to_pylist(), strict=True):
                if last is not None and line <= last:
                    out.append((key[0], line, payload, None, None))
                    continue
                before, head = head, hashlib.sha256((head + payload).encode()).hexdigest()
                out.append((key[0], line, payload, before, head))
                last = line
            if i + AT_ONCE >= len(order):
                state.update((head, last))
            yield pd.DataFrame(out, columns=["log", "line", "payload", "prev_hash", "hash"])

    return extend


def chained(entries: DataFrame) -> DataFrame:
    """``log, line, payload, prev_hash, hash``: the entries (``log, line, payload``) of a stream, each continuing its log.

    Logs grow side by side, each in one task, by the lines of a micro-batch at a time, which the source's limits bound
    (``maxFilesPerTrigger``, ``maxBytesPerTrigger``), as their bytes and no objects; nothing else of a log is held but its head and last line.  Lines that
    their log has passed, whether they are delivered again or come too late, have no place in the chain: they come out with null
    hashes.
    """
    kind = entries.schema["log"].dataType.simpleString()

    given = entries.where("log is not null and line is not null").select("log", F.col("line").cast("bigint").alias("line"), F.coalesce("payload", F.lit("")).alias("payload"))
    return given.groupBy("log").applyInPandasWithState(continuing(), f"log {kind}, line bigint, payload string, prev_hash string, hash string", "head string, last bigint", "append", GroupStateTimeout.NoTimeout)
