"""From findings to one plan for each item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import lexicon as L


def verdict_name(verdict: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in L.VERDICTS]), verdict + 1)


def worst_verdicts(findings: DataFrame) -> DataFrame:
    """``target, verdict``: the worst of each target's findings."""
    return findings.groupBy("target").agg(F.max("verdict").alias("verdict"))


def run_floor(findings: DataFrame) -> DataFrame:
    """One row: the worst run-level verdict (a floor under every item), whether anything halts, and why."""
    own = F.col("target") == L.RUN
    return findings.agg(
        F.coalesce(F.max(F.when(own, F.col("verdict"))), F.lit(L.ALLOW)).alias("floor"),
        F.coalesce(F.bool_or(F.col("verdict") == L.HALT), F.lit(False)).alias("halts"),
        F.array_join(F.array_sort(F.collect_set(F.when(own & (F.col("verdict") >= L.REQUIRE_APPROVAL), F.col("message")))), "; ").alias("why"),
    )


def hints(findings: DataFrame) -> DataFrame:
    """``target, hint``: the action of the first finding, in order of checks, that suggests one."""
    suggesting = findings.where(F.col("data")["action"].isNotNull())
    return suggesting.groupBy("target").agg(F.min_by(F.col("data")["action"], F.struct("check_ord", "pos")).alias("hint"))


def action(verdict: Column, approved: Column, hint: Column, exists: Column, section: Column, compat: bool = False) -> Column:
    """What becomes of an item.

    With ``compat`` an approved item that asks to supersede stays unchanged when something else held
    it, as it once was; without, it supersedes.
    """
    granted = F.when(hint == "unmapped", "create_unmapped").when(hint == "conflict", "supersede")
    if not compat:
        granted = granted.when(hint == "supersede", "supersede")
    granted = granted.when(exists, "unchanged").otherwise("create")
    allowed = F.when(hint == "identical", "unchanged").when(hint == "supersede", "supersede").when(section == "unmapped", "create_unmapped").when(exists, "unchanged").otherwise("create")
    return F.when(verdict >= L.BLOCK, "blocked").when((verdict == L.REQUIRE_APPROVAL) & ~approved, "held").when(verdict == L.REQUIRE_APPROVAL, granted).otherwise(allowed)


def resolve_actions(items: DataFrame, findings: DataFrame, existing: DataFrame, approvals: DataFrame, approve_all: bool = False, compat: bool = False) -> DataFrame:
    """``items`` with ``verdict, approved, action, detail, renames``.

    ``approvals`` has a column ``id``.  ``renames`` maps deprecated terms' fields to their replacement,
    for items that approval lets through.
    """
    worst = worst_verdicts(findings).withColumnRenamed("target", "id").withColumnRenamed("verdict", "own_verdict")
    hint = hints(findings).withColumnRenamed("target", "id")
    renaming = findings.where((F.col("check") == "vocab_membership") & F.col("data")["new"].isNotNull() & (F.col("data")["new"] != F.col("data")["old"]))
    renames = renaming.groupBy(F.col("target").alias("id")).agg(F.map_from_entries(F.collect_set(F.struct(F.col("data")["field"], F.col("data")["new"]))).alias("renames"))
    there = existing.select("kind", "key", F.lit(True).alias("exists")).distinct()
    rows = (
        items.join(worst, "id", "left").join(hint, "id", "left").join(renames, "id", "left").join(there, ["kind", "key"], "left")
        .join(approvals.select("id", F.lit(True).alias("granted")).distinct(), "id", "left")
        .crossJoin(F.broadcast(run_floor(findings)))  # one row
    )
    own = F.coalesce("own_verdict", F.lit(L.ALLOW))
    rows = rows.withColumn("verdict", F.greatest(own, F.col("floor"))).withColumn("approved", F.lit(approve_all) | F.coalesce("granted", F.lit(False))).withColumn("exists", F.coalesce("exists", F.lit(False)))
    rows = rows.withColumn("action", action(F.col("verdict"), F.col("approved"), F.col("hint"), F.col("exists"), F.col("section"), compat))
    asked = F.col("verdict") == L.REQUIRE_APPROVAL
    rewritten = F.col("renames").isNotNull() & asked & F.col("approved") & (F.lit(compat) | (F.col("action") != "unchanged"))
    detail = (
        F.when(F.col("verdict") == L.HALT, "run HALT")
        .when((F.col("verdict") == L.BLOCK) & (own < L.BLOCK), F.concat(F.lit("blocked by a run-level check: "), F.col("why")))
        .when(F.col("verdict") == L.BLOCK, "failed a blocking check")
        .when(F.col("action") == "held", "awaiting approval")
        .when(asked, F.concat(F.lit("approved: "), F.col("action"), F.when(rewritten, " [deprecated term rewritten]").otherwise("")))
        .otherwise(F.when(F.col("action") == "unchanged", "already present").when(F.col("action") == "create", "new").otherwise(F.col("action")))
    )
    return rows.withColumn("detail", detail).withColumn("renames", F.when(rewritten, F.col("renames"))).select(*items.columns, "verdict", "approved", "action", "detail", "renames")


def landing_order(plans: DataFrame) -> DataFrame:
    """Plans that write something, with ``section_ord``, in the order in which they are applied."""
    order = F.create_map(*[F.lit(x) for pair in (("declare", 0), ("node", 1), ("unmapped", 2)) for x in pair])[F.col("section")]
    return plans.where(F.col("action").isin("create", "create_unmapped", "supersede")).withColumn("section_ord", order).orderBy("section_ord", "pos")


def action_counts(plans: DataFrame) -> DataFrame:
    """One row of counts by action."""
    names = {"create": "created", "supersede": "superseded", "create_unmapped": "unmapped", "unchanged": "unchanged", "held": "held", "blocked": "blocked"}
    return plans.agg(*[F.count_if(F.col("action") == a).alias(n) for a, n in names.items()])
