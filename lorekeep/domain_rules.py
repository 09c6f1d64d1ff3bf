"""Example rules for domain packs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import lexicon as L
from lorekeep.operators.checks import Batch, found, texts

# Fixed values.
AUTHORITATIVE = ("statute", "budget-doc", "official-policy", "publication", "filing")


def review_date_set(b: Batch) -> DataFrame:
    """Items other than declared ones need a ``review_after``; one that has passed is held."""
    given = F.col("fields")["review_after"]
    day = F.try_to_date(given, "y-M-d")
    rows = b.items.where("section <> 'declare'").withColumn("given", given).withColumn("day", day)
    rows = rows.where(F.col("day").isNull() | (F.col("day") <= F.lit(b.options["today"]).cast("date")))
    passed = F.col("day").isNotNull()
    said = F.when(passed, texts("review_after '", F.col("given"), "' has passed")).when(F.coalesce("given", F.lit("")) == "", F.lit("review_after is missing")).otherwise(texts("review_after '", F.col("given"), "' is no date"))
    return found(rows, "review_date_set", F.when(passed, L.REQUIRE_APPROVAL).otherwise(L.BLOCK), said)


def evidence_supports_tier(b: Batch, kind: str = "insight", authoritative: tuple[str, ...] = AUTHORITATIVE) -> DataFrame:
    """A ``verified`` evidence tier needs an authoritative kind of source."""
    rows = b.items.where((F.col("kind") == kind) & (F.col("fields")["evidence_tier"] == "verified") & ~F.coalesce(F.col("fields")["source_kind"].isin(*authoritative), F.lit(False)))
    return found(rows, "evidence_supports_tier", L.BLOCK, texts("tier 'verified' is not supported by source kind '", F.col("fields")["source_kind"], "'"))
