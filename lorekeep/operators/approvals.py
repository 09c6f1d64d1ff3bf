"""Proposals and approvals as events, folded by key: which proposals a batch has, what clears its items, what tokens name.

``heads``: run_id, content_hash, schema_hash, created_ts, one row a proposal.  ``given``: run_id, id, ts, against_content,
against_schema, one row for each item that an approval names; what it was given against may be null or empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def matching(heads: DataFrame, contract: bool = True) -> DataFrame:
    """``heads`` with ``place``: 1 for the newest of each content (and contract), as approvals look them up."""
    by = ["content_hash", "schema_hash"] if contract else ["content_hash"]
    return heads.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.col("created_ts").desc(), F.col("run_id").desc())))


def approved(heads: DataFrame, given: DataFrame, compat: bool = False) -> DataFrame:
    """``content_hash, schema_hash, id``: what approvals clear.  An approval of other content or of another
    contract doesn't count.

    Those of all matching proposals count.  With ``compat`` only the newest's: its own, and what it took over when it
    was made.  A proposal takes over what its predecessor had by then, so an approval goes on for good unless the
    next proposal was there before it.
    """
    later = W.partitionBy("content_hash", "schema_hash").orderBy("created_ts", "run_id")
    proposals = heads.select("run_id", "content_hash", "schema_hash", F.lead("created_ts").over(later).alias("followed")) if compat else heads.select("run_id", "content_hash", "schema_hash")
    rows = proposals.join(given, "run_id")
    same = lambda c, of: (F.coalesce(F.col(c), F.lit("")) == "") | F.col(c).eqNullSafe(F.col(of))
    rows = rows.where(same("against_schema", "schema_hash") & same("against_content", "content_hash"))
    if compat:
        rows = rows.where(F.col("followed").isNull() | (F.col("ts") <= F.col("followed")))
    return rows.select("content_hash", "schema_hash", "id").distinct()


def items_now(items: DataFrame, given: DataFrame) -> DataFrame:
    """Proposals' ``items`` (run_id, id, approved, ...) with what was approved since they were made."""
    since = given.select("run_id", "id", F.lit(True).alias("since")).distinct()
    return items.join(since, ["run_id", "id"], "left").withColumn("approved", F.coalesce("approved", F.lit(False)) | F.col("since").isNotNull()).select(*items.columns)


def resolve_tokens(items: DataFrame, tokens: DataFrame) -> DataFrame:
    """``run_id, token, id, problem`` for each token: the held item that it names (by id, or by a key that only
    one held item has), or why it names none.

    ``items``: run_id, id, key, verdict of proposals; ``tokens``: run_id, token.
    """
    held = F.col("verdict") == "REQUIRE_APPROVAL"
    names = items.select("run_id", F.explode(F.array_distinct(F.array("id", "key"))).alias("token"), "id", held.alias("held"), F.col("id").alias("own"))
    facts = names.groupBy("run_id", "token").agg(
        F.max(F.when(F.col("held") & (F.col("token") == F.col("own")), F.col("id"))).alias("by_id"),
        F.array_sort(F.collect_set(F.when(F.col("held") & (F.col("token") != F.col("own")), F.col("id")))).alias("by_key"),
    )
    rows = tokens.join(facts, ["run_id", "token"], "left")
    found = F.when(F.col("by_id").isNotNull(), F.col("by_id")).when(F.size("by_key") == 1, F.get("by_key", F.lit(0)))
    problem = (
        F.when(F.col("by_key").isNull(), "no such item in this proposal")
        .when(F.col("by_id").isNotNull() | (F.size("by_key") == 1), F.lit(None).cast("string"))
        .when(F.size("by_key") > 1, F.concat(F.lit("ambiguous bare key: it matches "), F.array_join("by_key", ", ")))
        .otherwise("present in this proposal but not awaiting approval")
    )
    return rows.select("run_id", "token", found.alias("id"), problem.alias("problem"))


def status_after(items: DataFrame) -> DataFrame:
    """``run_id, status``: partial while a proposal still holds an item that nobody approved."""
    waiting = F.bool_or((F.col("verdict") == "REQUIRE_APPROVAL") & ~F.coalesce("approved", F.lit(False)))
    return items.groupBy("run_id").agg(F.when(waiting, "partial").otherwise("applied").alias("status"))
