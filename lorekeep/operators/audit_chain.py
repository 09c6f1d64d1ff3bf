"""The audit chain as rows: verification without walking it, and the integrity of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.functions import lexicon as L


def chain_hash(previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat(previous, payload), 256)


#: Line numbers that one task looks at in a row.
CHUNK = 100_000
UNREADABLE, UNCHAINED, DETACHED, ALTERED, INTACT = "the line is no JSON object", "the entry carries no hashes", "the entry does not continue the one before it", "the content is not what was hashed", "every entry continues the one before"


def previous_hash(lines: DataFrame, order_col: str, chain_cols: tuple[str, ...] = ()) -> DataFrame:
    """``lines`` with ``before``: the hash of the line before, null for a chain's first.

    A chain of any length is cut into runs of ``CHUNK`` line numbers.  Within a run it is the line
    before; a run's first line gets it from a table of one row a run.
    """
    chain, runs = list(chain_cols), lines.withColumn("__run", F.floor(F.col(order_col) / CHUNK))
    ends = runs.groupBy(*chain, "__run").agg(F.max_by(F.struct("hash"), order_col).alias("__last"))
    carried = ends.select(*chain, "__run", F.lag("__last").over(W.partitionBy(*chain).orderBy("__run")).alias("__carried"))
    own = F.lag(F.struct("hash")).over(W.partitionBy(*chain, "__run").orderBy(order_col))  # a struct, since a hash may be null itself
    joined = runs.withColumn("__own", own).join(carried, [*chain, "__run"])
    return joined.withColumn("before", F.coalesce("__own", "__carried")["hash"]).drop("__run", "__own", "__carried")


def breaks(lines: DataFrame, order_col: str = "line", chain_cols: tuple[str, ...] = ()) -> DataFrame:
    """The lines that don't follow from the one before: ``line`` and ``reason``, in any number.

    ``lines`` has ``line, prev_hash, hash, payload``: null hashes mark entries that lack them, a null
    payload what is no JSON.  The first break is where a walk would stop, since all before it is good.
    With ``chain_cols`` the rows are many logs, each a chain of its own.
    """
    reason = (
        F.when(F.col("payload").isNull(), UNREADABLE)
        .when(F.col("hash").isNull() | F.col("prev_hash").isNull(), UNCHAINED)
        .when(F.col("prev_hash") != F.coalesce("before", F.lit(L.GENESIS)), DETACHED)
        .when(chain_hash(F.col("prev_hash"), F.col("payload")) != F.col("hash"), ALTERED)
    )
    return previous_hash(lines, order_col, chain_cols).select(*chain_cols, F.col(order_col).alias("line"), reason.alias("reason")).where("reason is not null")


def verify(lines: DataFrame, chain_cols: tuple[str, ...] = ()) -> DataFrame:
    """One row a chain: ``ok, entries, broken_at, reason``; ``entries`` counts the good ones before the break."""
    chain = list(chain_cols)
    first = breaks(lines, chain_cols=chain_cols).groupBy(*chain).agg(F.min(F.struct("line", "reason")).alias("b"))
    joined = lines.join(first, chain, "left") if chain else lines.crossJoin(F.broadcast(first))  # one row
    counted = joined.groupBy(*chain).agg(F.count_if(F.col("b").isNull() | (F.col("line") < F.col("b.line"))).alias("entries"), F.first("b").alias("b"))
    return counted.select(*chain, F.col("b").isNull().alias("ok"), "entries", F.col("b.line").alias("broken_at"), F.coalesce("b.reason", F.lit(INTACT)).alias("reason"))


def last_hash(lines: DataFrame, chain_cols: tuple[str, ...] = ()) -> DataFrame:
    """One row a chain: ``head``, the hash that its next entry has to name."""
    readable = F.when(F.col("payload").isNotNull() & F.col("hash").isNotNull(), F.col("line"))
    return lines.groupBy(*chain_cols).agg(F.coalesce(F.max_by("hash", readable), F.lit(L.GENESIS)).alias("head"))


def run_index(lines: DataFrame) -> DataFrame:
    """``run_id, line`` and the entry's other columns: the first entry of each run."""
    rest = [c for c in lines.columns if c not in ("run_id", "line")]
    return lines.where("run_id <> ''").groupBy("run_id").agg(F.min("line").alias("line"), *[F.min_by(c, "line").alias(c) for c in rest])


def integrity_state(exists: Column, status: Column, run_id: Column, line: Column, broken_at: Column) -> Column:
    """verified, unverified or invalidated, by what is known of a node and of the chain."""
    return (
        F.when(~exists, "invalidated")
        .when(~F.coalesce(status, F.lit("active")).isin("active", "unmapped"), "invalidated")
        .when(F.coalesce(run_id, F.lit("")) == "", "unverified")
        .when(line.isNull(), "unverified")
        .when(broken_at.isNull(), "verified")
        .when(broken_at <= line, "invalidated")
        .otherwise("unverified")
    )


EXIT_CODES = {"verified": 0, "unverified": 4, "invalidated": 5}


def exit_code(state: Column) -> Column:
    """What a caller's shell is told: 0 verified, 4 unverified, 5 invalidated."""
    return F.create_map(*[F.lit(x) for pair in EXIT_CODES.items() for x in pair])[state]


def integrity_report(nodes: DataFrame, lines: DataFrame, chain_cols: tuple[str, ...] = ()) -> DataFrame:
    """``nodes`` with ``line`` and ``state``, all nodes at once.  With ``chain_cols`` the log is many logs, and a
    node's integrity is that of the log its run is in."""
    chain = list(chain_cols)
    verified = verify(lines.select(*chain, "line", "prev_hash", "hash", "payload"), chain_cols).select(*chain, "broken_at")
    joined = nodes.join(run_index(lines.select("run_id", "line", *chain)), "run_id", "left")
    joined = joined.join(verified, chain, "left") if chain else joined.crossJoin(F.broadcast(verified))  # one row
    return joined.withColumn("state", integrity_state(F.lit(True), F.col("status"), F.col("run_id"), F.col("line"), F.col("broken_at"))).drop("broken_at", *chain)
