"""Gaps: what the vocabulary has no word for, with independent support."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import lexicon as L

OBSERVATION = "slug string, means string, kind string, key string, item_id string, scope string, source string, run_id string, observed_on string, recorded_ts string"
RESOLUTION = "slug string, status string, promoted_to string, note string, actor string, ts string"


def observations_from_plans(plans: DataFrame, scope: str, source: str, run_id: str, date: str, now: str) -> DataFrame:
    """One row for each item that lands without a home; held and blocked items don't vote."""
    from lorekeep.operators.checks import gap_slug
    from lorekeep.functions.text import strip

    landed = plans.where("action = 'create_unmapped'").withColumn("slug", gap_slug(F.col("fields"))).where("slug <> ''")
    return landed.select(
        "slug", strip(F.coalesce(F.col("fields")["unmapped_reason"], F.lit(""))).alias("means"), "kind", "key", F.col("id").alias("item_id"),
        F.lit(scope).alias("scope"), F.lit(source).alias("source"), F.lit(run_id).alias("run_id"), F.lit(date).alias("observed_on"), F.lit(now).alias("recorded_ts"),
    )


def new_observations(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose (slug, item, run) is not stored yet, once each."""
    keys = ["slug", "item_id", "run_id"]
    return rows.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def resolved(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Resolutions after ``rows``: one a slug, the new one where there is one."""
    return stored.join(rows.select("slug"), "slug", "left_anti").select(*stored.columns).unionByName(rows.select(*stored.columns))


def promotion_entries(gaps: DataFrame, floor: int = L.PROMOTION_FLOOR) -> DataFrame:
    """``slug, entry, evidence`` of every gap that can be promoted: what the vocabulary would gain, and why."""
    entry = F.struct(F.col("means").alias("definition"), F.lit("active").alias("status"), F.col("slug").alias("promoted_from_gap"))
    return promotable(gaps, floor).select("slug", entry.alias("entry"), F.struct(F.col("independent").alias("independent_scopes"), "scopes", "observations", "items").alias("evidence"))


#: Scopes, sources and items that a gap names as its evidence; all are counted.
MOST_EVIDENCE = 1000


def evidence(rows: DataFrame, most: int = MOST_EVIDENCE) -> DataFrame:
    """``slug``, and of its scopes, sources and items the first ``most`` in order and how many there are (``n_scopes``, ``n_sources``,
    ``n_items``).  Pairs of slug and value are made distinct first, so that however many rows one slug has, no task gets them
    all and no row grows with them."""
    parts = {"scopes": "scope", "sources": "source", "items": "item_id"}
    each = rows.select("slug", F.explode(F.array(*[F.struct(F.lit(name).alias("part"), F.col(c).alias("value")) for name, c in parts.items()])).alias("e")).select("slug", "e.part", "e.value")
    distinct = each.where("value <> ''").groupBy("slug", "part", "value").agg(F.lit(1).alias("one"))
    counts = distinct.groupBy("slug").agg(*[F.count(F.when(F.col("part") == name, 1)).cast("int").alias(f"n_{name}") for name in parts])
    first = distinct.withColumn("place", F.row_number().over(Window.partitionBy("slug", "part").orderBy("value"))).where(F.col("place") <= most)
    lists = first.groupBy("slug").agg(*[F.array_sort(F.collect_list(F.when(F.col("part") == name, F.col("value")))).alias(name) for name in parts])
    return counts.join(lists, "slug")


def aggregate(rows: DataFrame, resolutions: DataFrame | None = None, most: int = MOST_EVIDENCE) -> DataFrame:
    """Gaps by independent support: ``slug, means, observations, scopes, sources, items, n_scopes, n_sources, n_items, first_seen,
    last_seen, independent, status, promoted_to, note``.

    Empty scopes and sources don't count.  ``means`` is the last that is not empty.  Lists hold ``most`` values at most.
    """
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    ts = F.coalesce(blank("recorded_ts"), blank("observed_on"))
    gaps = rows.groupBy("slug").agg(
        F.coalesce(F.max_by("means", F.when(F.col("means") != "", F.struct(F.coalesce(ts, F.lit("")), "means"))), F.lit("")).alias("means"), F.count("*").alias("observations"),
        F.coalesce(F.min(ts), F.lit("")).alias("first_seen"), F.coalesce(F.max(ts), F.lit("")).alias("last_seen"),
    )
    none = {"scopes": F.array().cast("array<string>"), "sources": F.array().cast("array<string>"), "items": F.array().cast("array<string>"), "n_scopes": F.lit(0), "n_sources": F.lit(0), "n_items": F.lit(0)}
    gaps = gaps.join(evidence(rows, most), "slug", "left").withColumns({c: F.coalesce(c, v) for c, v in none.items()}).withColumn("independent", F.col("n_scopes"))
    if resolutions is not None:
        gaps = gaps.join(resolutions.select("slug", "status", "promoted_to", "note"), "slug", "left")
    else:
        gaps = gaps.withColumns({c: F.lit(None).cast("string") for c in ("status", "promoted_to", "note")})
    return gaps.withColumns({"status": F.coalesce("status", F.lit("open")), "promoted_to": F.coalesce("promoted_to", F.lit("")), "note": F.coalesce("note", F.lit(""))})


def ranked(gaps: DataFrame) -> DataFrame:
    return gaps.orderBy(F.col("independent").desc(), F.col("observations").desc(), "slug")


def promotable(gaps: DataFrame, floor: int = L.PROMOTION_FLOOR) -> DataFrame:
    return gaps.where((F.col("status") == "open") & (F.col("independent") >= floor))


def known_gaps(gaps: DataFrame, limit: int = 200, include_promoted: bool = False) -> DataFrame:
    """What to show a writer before a new slug is coined: the best supported, rejected ones left out."""
    shown = gaps.where("status <> 'rejected'" + ("" if include_promoted else " and status <> 'promoted'"))
    return ranked(shown).select("slug", "means", F.col("independent").alias("independent_scopes"), "promoted_to").limit(limit)


def promotion_block(gaps: DataFrame, slug: str, term: str, category: str, definition: str, since: str = "") -> dict:
    """The vocabulary entry that a gap becomes, with its evidence, for review."""
    row = gaps.where(F.col("slug") == slug).first()
    if row is None:
        raise ValueError(f"no gap '{slug}'")
    return {
        "term": term,
        "category": category,
        "entry": {"definition": definition, "status": "active", "since": since, "promoted_from_gap": slug},
        "evidence": {"independent_scopes": row["independent"], "scopes": list(row["scopes"]), "observations": row["observations"], "items": list(row["items"])},
    }
