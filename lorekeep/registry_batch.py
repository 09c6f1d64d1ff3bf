"""Queries of the checks over one large batch, made of orders and customers, against a graph of some of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep import domain_rules
from lorekeep.functions import lexicon as L
from lorekeep.operators import checks, verdicts
from lorekeep.operators.checks import Batch
from lorekeep.plans.contract import Contract, Kind, Term, Vocabulary
from lorekeep.registry import GRAMS_SQL, NORMAL_SQL, query, read
from lorekeep.sources import batches

PRIORITY = Vocabulary(
    "priority",
    {
        "2-HIGH": Term("2-HIGH"),
        "4-NOT SPECIFIED": Term("4-NOT SPECIFIED", synonyms=("5-LOW",)),
        "3-MEDIUM": Term("3-MEDIUM", status="deprecated", replaced_by="2-HIGH"),
    },
)
CONTRACT = Contract(
    "orders",
    {
        "order": Kind("order", required=["price", "status"], vocab_fields={"priority": "priority"}, content_fields=["price", "status"], refs={"customer": "customer"}),
        "pinned": Kind("pinned", content_fields=["price", "status"], supersedable=False, implicit_create=False),
        "customer": Kind("customer", content_fields=["segment"], implicit_create=False),
    },
    {"priority": PRIORITY},
)


def _fields(k, priority):  # noqa: ANN001, ANN202
    pick = lambda *cases: F.coalesce(*[F.when(when, F.lit(value) if isinstance(value, str) else value) for when, value in cases])
    status = F.when(k % 11 == 2, F.lit(None).cast("string")).when(k % 11 == 3, "").otherwise(F.col("o_orderstatus"))
    price = F.format_string("%.2f", F.col("o_totalprice") + F.when(k % 4 == 0, 1).otherwise(0))
    named = pick((k % 23 == 5, F.concat(F.lit("order:"), (k + 1).cast("string"))), (k % 23 == 6, F.concat(F.lit("order:"), k.cast("string"))), (k % 23 == 7, "order"), (k % 23 == 8, "order:none"))
    gap = pick((k % 4 == 1, "missing-flow"), (k % 4 == 2, "Bad"), (k % 4 == 3, "other-gap"))
    review = pick((k % 5 == 1, "2024-01-0x"), (k % 5 == 2, "2024-3-1"), (k % 5 == 3, "2099-03-01"))
    tier, source = F.when(k % 3 == 1, "verified").otherwise("claimed"), F.when(k % 2 == 0, "statute").otherwise("blog")
    columns = {"status": status, "price": price, "priority": priority, "customer": F.col("o_custkey").cast("string"), "contradicts": named, "unmapped_gap": gap, "review_after": review, "evidence_tier": tier, "source_kind": source}
    return F.create_map(*[x for name, value in columns.items() for x in (F.lit(name), value)])


def _batch(spark: SparkSession, sf_dir: str) -> Batch:
    k = F.col("o_orderkey")
    orders = read(spark, sf_dir, "orders")
    kind = F.when(k % 17 == 3, "ghost").when(k % 17 == 5, "pinned").otherwise("order")
    key = F.when(k % 19 == 4, F.lit(None).cast("string")).when(k % 19 == 5, "").otherwise(k.cast("string"))
    section = F.when(k % 7 == 0, "declare").when(k % 7 == 1, "unmapped").otherwise("node")
    own = orders.select(kind.alias("kind"), key.alias("key"), section.alias("section"), k.alias("pos"), _fields(k, F.when(k % 13 == 6, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority"))).alias("fields"), (k % 6 == 0).alias("supersede"))
    again = own.where("pos % 29 = 9").withColumn("pos", F.col("pos") + 10_000_000).withColumn("section", F.lit("node"))
    c = F.col("c_custkey")
    people = read(spark, sf_dir, "customer").where("c_custkey % 6 = 0").select(F.lit("customer").alias("kind"), c.cast("string").alias("key"), F.when(c % 5 == 0, "declare").otherwise("node").alias("section"), (c + 20_000_000).alias("pos"), F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("fields"), F.lit(False).alias("supersede"))
    items = own.unionByName(again).unionByName(people)
    truthy = F.map_keys(F.map_filter("fields", lambda _, v: F.coalesce(v, F.lit("")) != ""))
    items = items.select(
        "section", F.lit(0).alias("section_ord"), "pos", "kind", "key", F.concat("kind", F.lit(":"), F.when(F.coalesce("key", F.lit("")) != "", F.col("key")).otherwise("?")).alias("id"),
        F.to_json("fields").alias("props"), truthy.alias("truthy"), "supersede", F.lit(False).alias("protected"), "fields",
    )
    state = [F.lit("active").alias("status"), F.lit(1).alias("revision")]
    there = orders.where("o_orderkey % 3 = 0").select(kind.alias("kind"), k.cast("string").alias("key"), F.create_map(F.lit("price"), F.format_string("%.2f", "o_totalprice"), F.lit("status"), F.col("o_orderstatus")).alias("fields"), (k % 5 == 0).alias("is_protected"), F.when(k % 2 == 0, "team-a").otherwise("team-b").alias("owner"), *state)
    known = read(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.lit("customer").alias("kind"), c.cast("string").alias("key"), F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("fields"), F.lit(False).alias("is_protected"), F.lit("team-a").alias("owner"), *state)
    return Batch(spark, CONTRACT, items, there.unionByName(known), scope="north", source="s", date="2024-03-01", owner="team-a", run_id="r1", options={"today": "2024-06-01"})


_ITEMS_SQL = (
    "WITH o AS (SELECT o_orderkey AS k, CASE o_orderkey % 17 WHEN 3 THEN 'ghost' WHEN 5 THEN 'pinned' ELSE 'order' END AS kind, CASE o_orderkey % 19 WHEN 4 THEN NULL WHEN 5 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS key, "
    "CASE o_orderkey % 7 WHEN 0 THEN 'declare' WHEN 1 THEN 'unmapped' ELSE 'node' END AS section, o_orderkey AS pos, CASE o_orderkey % 11 WHEN 2 THEN NULL WHEN 3 THEN '' ELSE o_orderstatus END AS status, "
    "CASE WHEN o_orderkey % 13 <> 6 THEN o_orderpriority END AS priority, CAST(o_custkey AS VARCHAR) AS customer, "
    "CASE o_orderkey % 23 WHEN 5 THEN concat('order:', CAST(o_orderkey + 1 AS VARCHAR)) WHEN 6 THEN concat('order:', CAST(o_orderkey AS VARCHAR)) WHEN 7 THEN 'order' WHEN 8 THEN 'order:none' END AS named, "
    "CASE o_orderkey % 4 WHEN 1 THEN 'missing-flow' WHEN 2 THEN 'Bad' WHEN 3 THEN 'other-gap' ELSE '' END AS gap FROM orders), "
    "oo AS (SELECT * FROM o UNION ALL SELECT * REPLACE (pos + 10000000 AS pos, 'node' AS section) FROM o WHERE k % 29 = 9), "
    "it AS (SELECT * FROM oo UNION ALL SELECT c_custkey, 'customer', CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 5 = 0 THEN 'declare' ELSE 'node' END, c_custkey + 20000000, NULL, NULL, NULL, NULL, '' FROM customer WHERE c_custkey % 6 = 0), "
    "i AS (SELECT *, concat(kind, ':', CASE WHEN key <> '' THEN key ELSE '?' END) AS id FROM it), "
    "ex AS (SELECT CASE o_orderkey % 17 WHEN 3 THEN 'ghost' WHEN 5 THEN 'pinned' ELSE 'order' END AS kind, CAST(o_orderkey AS VARCHAR) AS key, o_orderkey % 5 = 0 AS guarded, CASE WHEN o_orderkey % 2 = 0 THEN 'team-a' ELSE 'team-b' END AS owner FROM orders WHERE o_orderkey % 3 = 0 "
    "UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), false, 'team-a' FROM customer WHERE c_custkey % 4 <> 0), "
    "pending AS (SELECT kind, key FROM ex UNION SELECT kind, key FROM i WHERE section = 'declare' AND key IS NOT NULL), "
    "new AS (SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.kind = i.kind AND ex.key = i.key)), "
    "met AS (SELECT i.*, ex.guarded, ex.owner, i.kind <> 'customer' AND (i.k % 4 = 0 OR i.k % 11 IN (2, 3)) AS changed FROM i JOIN ex ON i.kind = ex.kind AND i.key = ex.key WHERE i.kind <> 'ghost'), "
    "homeless AS (SELECT * FROM i WHERE section = 'unmapped' OR (section = 'node' AND kind = 'order' AND priority IS NULL)) "
)
_SLUGS = " ".join(f"WHEN '{slug}' THEN '{checks.SLUG_MESSAGES[code].replace(chr(39), chr(39) * 2)}'" for slug, code in (("Bad", "malformed"), ("other-gap", "names_nothing")))
#: Of each check: target, pos, verdict and what it says, by plain SQL.
_FOUND_SQL = {
    "unknown_kind": "SELECT id, pos, 2, concat('node kind ''', kind, ''' is not defined in the schema') FROM i WHERE kind = 'ghost'",
    "key_present": "SELECT concat(kind, ':?'), pos, 2, concat(section, ' ', kind, ' item is missing its key') FROM i WHERE coalesce(key, '') = ''",
    "required_fields": "SELECT id, pos, 2, concat('order ''', coalesce(key, ''), ''' is missing required field ''status''') FROM i WHERE kind = 'order' AND coalesce(status, '') = ''",
    "vocab_membership": "SELECT id, pos, CASE WHEN priority = '3-MEDIUM' THEN 1 ELSE 2 END, CASE WHEN priority = '3-MEDIUM' THEN 'priority=''3-MEDIUM'' is deprecated in ''priority'', replaced by ''2-HIGH''; approve to write the replacement' "
    "ELSE concat('priority=''', priority, ''' is not in vocabulary ''priority''; fix it, or set it to null and name the gap') END FROM i WHERE kind = 'order' AND priority IS NOT NULL AND priority NOT IN ('2-HIGH', '4-NOT SPECIFIED', '5-LOW')",
    "key_unique_in_file": "SELECT concat(kind, ':', key), max(pos), 2, concat('duplicate ', kind, ' key within the file: ', key) FROM i WHERE key <> '' GROUP BY kind, key HAVING count(*) > 1",
    "refs_exist": "SELECT id, pos, 2, concat('references customer ''', customer, ''' which doesn''t exist; declare it or fix the reference') FROM i WHERE kind = 'order' AND NOT EXISTS (SELECT 1 FROM pending p WHERE p.kind = 'customer' AND p.key = i.customer)",
    "contradicts_ref": "SELECT * FROM (SELECT i.id, i.pos, 2, CASE WHEN i.named = 'order' THEN 'contradicts ''order'' is not a composite id; use ''kind:key''' WHEN i.named = concat('order:', i.key) AND i.kind = 'order' THEN 'contradicts itself' "
    "WHEN p.key IS NULL THEN concat('contradicts ''', i.named, ''', which does not exist') END AS said FROM i LEFT JOIN pending p ON p.kind = 'order' AND concat('order:', p.key) = i.named WHERE i.named IS NOT NULL) WHERE said IS NOT NULL",
    "implicit_create_guard": "SELECT id, pos, 2, concat('kind ''', kind, ''' is closed; a new ''', coalesce(key, ''), ''' must be declared') FROM new WHERE section = 'node' AND kind IN ('pinned', 'customer')",
    "collision": "SELECT id, pos, CASE WHEN changed AND kind = 'pinned' THEN 2 WHEN changed AND k % 6 <> 0 THEN 1 ELSE 0 END, CASE WHEN NOT changed THEN concat('''', key, ''' is already present and unchanged') WHEN kind = 'pinned' THEN concat('''', key, ''' exists and kind ''pinned'' is not supersedable') "
    "WHEN k % 6 = 0 THEN concat('''', key, ''' changed; supersede:true will version the prior belief') ELSE concat('''', key, ''' exists with different content; set supersede:true or approve to version the prior belief') END FROM met",
    "protected_guard": "SELECT id, pos, 2, concat('''', key, ''' is protected and owned by ''team-b''; ''team-a'' may not overwrite it') FROM met WHERE changed AND guarded AND owner = 'team-b'",
    "unmapped_review": "SELECT id, pos, 1, concat('''', coalesce(key, ''), ''' has no controlled-vocabulary home', CASE WHEN gap <> '' THEN concat(': gap ''', gap, '''') ELSE '' END, '; held for human review') FROM homeless h WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.kind = h.kind AND ex.key = h.key)",
    "unmapped_gap_named": "SELECT id, pos, 2, CASE WHEN gap = '' THEN 'has no controlled-vocabulary home and no `unmapped_gap` slug; name the missing mechanic in 2-6 kebab-case words' ELSE concat('unmapped_gap ''', gap, ''': ', CASE gap " + _SLUGS + " END) END FROM homeless WHERE gap <> 'missing-flow'",
}


def _register(name: str) -> None:
    def batch_check(spark: SparkSession, sf_dir: str) -> DataFrame:
        return checks.CHECKS[name](_batch(spark, sf_dir)).select("target", F.col("pos").cast("bigint").alias("pos"), "verdict", "message")

    batch_check.__name__ = f"check_{name}"
    query(_ITEMS_SQL + f"SELECT target, CAST(pos AS BIGINT) AS pos, CAST(verdict AS INTEGER) AS verdict, message FROM ({_FOUND_SQL[name]}) AS f(target, pos, verdict, message)")(batch_check)


for _name in _FOUND_SQL:
    _register(_name)


#: Kinds that ask for near-duplicate keys at two thresholds, and one that doesn't.
KEYED = Contract("suppliers", {"k0": Kind("k0", near_duplicate_check=True), "k1": Kind("k1", near_duplicate_check=True, near_duplicate_threshold=0.9), "k2": Kind("k2")}, {})


def _keyed_batch(spark: SparkSession, sf_dir: str) -> Batch:
    """Every supplier as an item under its name, some twice; every fourth is in the graph already."""
    k = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier").select(F.concat(F.lit("k"), (F.col("s_nationkey") % 3).cast("string")).alias("kind"), F.col("s_name").alias("key"), k.alias("k"))
    items = rows.unionByName(rows.where("k % 5 = 1").withColumn("k", F.col("k") + 1_000_000))
    items = items.select(
        F.lit("node").alias("section"), F.lit(0).alias("section_ord"), F.col("k").alias("pos"), "kind", "key", F.concat("kind", F.lit(":"), "key").alias("id"), F.lit("{}").alias("props"), F.array().cast("array<string>").alias("truthy"), F.lit(False).alias("supersede"),
        F.lit(False).alias("protected"), F.create_map().cast("map<string,string>").alias("fields"),
    )
    there = rows.where("k % 4 = 0").select("kind", "key", F.create_map().cast("map<string,string>").alias("fields"), F.lit(False).alias("is_protected"), F.lit("o").alias("owner"), F.lit("active").alias("status"), F.lit(1).alias("revision"))
    return Batch(spark, KEYED, items, there, scope="north", source="s", date="2024-03-01", owner="o", run_id="r1")


@query(
    "WITH n AS (SELECT s_suppkey AS k, concat('k', CAST(s_nationkey % 3 AS VARCHAR)) AS kind, s_name AS key, " + NORMAL_SQL.format(c="s_name") + " AS normal FROM supplier), g AS (SELECT *, " + GRAMS_SQL.format(d="replace(normal, ' ', '')") + " AS grams FROM n), "
    "p AS (SELECT a.k, a.kind, a.key, b.key AS other, len(list_intersect(a.grams, b.grams)) / CAST(len(list_distinct(list_concat(a.grams, b.grams))) AS DOUBLE) AS score FROM g a JOIN g b ON a.kind = b.kind AND a.k % 4 <> 0 AND b.k % 4 = 0 AND substr(a.normal, 1, 4) = substr(b.normal, 1, 4) AND a.normal <> b.normal WHERE a.kind <> 'k2') "
    "SELECT concat(kind, ':', key) AS target, CAST(k AS BIGINT) AS pos, 1 AS verdict, concat('''', key, ''' is ', CAST(CAST(round(score * 100) AS INTEGER) AS VARCHAR), '% similar to existing ', kind, ' ''', other, '''; approve to create it apart, or reuse the existing key. Nothing is merged.') AS message FROM p WHERE score >= CASE WHEN kind = 'k0' THEN 0.75 ELSE 0.9 END"
)
def check_near_duplicate_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New keys against the graph's, each kind at its own threshold, as a run of all checks reports them."""
    found = checks.run_checks(_keyed_batch(spark, sf_dir))[1].where("check = 'near_duplicate_key'")
    return found.select("target", F.col("pos").cast("bigint").alias("pos"), "verdict", "message")


_COUNTS_SQL = " UNION ALL ".join(f"SELECT '{name}' AS check_name, CAST(verdict AS INTEGER) AS verdict FROM ({sql}) AS f(target, pos, verdict, message)" for name, sql in _FOUND_SQL.items())


@query(_ITEMS_SQL + f"SELECT check_name, verdict, count(*) AS findings FROM ({_COUNTS_SQL} UNION ALL SELECT 'vocab_synonym_folded', 0 FROM i WHERE kind = 'order' AND priority = '5-LOW') GROUP BY check_name, verdict")
def run_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of a run, by verdict, after synonyms are folded."""
    return checks.run_checks(_batch(spark, sf_dir))[1].groupBy(F.col("check").alias("check_name"), "verdict").agg(F.count("*").alias("findings"))


@query(_ITEMS_SQL + "SELECT CAST(pos AS BIGINT) AS pos, '4-NOT SPECIFIED' AS priority, customer FROM i WHERE kind = 'order' AND priority = '5-LOW'")
def fold_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose synonym was replaced in their documents, nothing else of which changes."""
    b = _batch(spark, sf_dir)
    rows = checks.changed_fields(checks.with_folds(b).where("changes is not null"), b.items.columns)
    return rows.select("pos", F.get_json_object("props", "$.priority").alias("priority"), F.get_json_object("props", "$.customer").alias("customer"))


@query(_ITEMS_SQL + ", r AS (SELECT id, pos, CASE k % 5 WHEN 1 THEN '2024-01-0x' WHEN 2 THEN '2024-3-1' WHEN 3 THEN '2099-03-01' END AS day FROM i WHERE section <> 'declare' AND kind <> 'customer' UNION ALL SELECT id, pos, NULL FROM i WHERE section <> 'declare' AND kind = 'customer') "
    "SELECT id AS target, CAST(pos AS BIGINT) AS pos, CASE WHEN day = '2024-3-1' THEN 1 ELSE 2 END AS verdict, CASE WHEN day IS NULL THEN 'review_after is missing' WHEN day = '2024-3-1' THEN 'review_after ''2024-3-1'' has passed' ELSE concat('review_after ''', day, ''' is no date') END AS message FROM r WHERE day IS NULL OR day <> '2099-03-01'")  # fmt: skip
def rule_review_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain_rules.review_date_set(_batch(spark, sf_dir)).select("target", F.col("pos").cast("bigint").alias("pos"), "verdict", "message")


@query(_ITEMS_SQL + "SELECT id AS target, CAST(pos AS BIGINT) AS pos, 2 AS verdict FROM i WHERE kind = 'order' AND k % 3 = 1 AND k % 2 = 1")
def rule_evidence_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain_rules.evidence_supports_tier(_batch(spark, sf_dir), "order").select("target", F.col("pos").cast("bigint").alias("pos"), "verdict")


@query(_ITEMS_SQL + ", w AS (SELECT target, max(verdict) AS verdict FROM (" + " UNION ALL ".join(f"SELECT target, verdict FROM ({sql}) AS f(target, pos, verdict, message)" for sql in _FOUND_SQL.values()) + ") GROUP BY target) "
    "SELECT CASE WHEN verdict >= 2 THEN 'blocked' WHEN verdict = 1 THEN 'held' ELSE 'lands' END AS outcome, count(*) AS items FROM (SELECT i.pos, coalesce(w.verdict, 0) AS verdict FROM i LEFT JOIN w ON i.id = w.target) GROUP BY 1")  # fmt: skip
def batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From items to plans: checks, verdicts, actions."""
    batch, findings = checks.run_checks(_batch(spark, sf_dir))
    plans = verdicts.resolve_actions(batch.items, findings, batch.existing, spark.createDataFrame([], "id string"))
    outcome = F.when(F.col("action").isin("blocked", "held"), F.col("action")).otherwise("lands")
    return plans.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("items"))


_HEADS_SQL = "WITH h AS (SELECT doc_id AS file, doc_id % 7 <> 3 AS mapping, CASE WHEN doc_id % 5 = 1 THEN NULL WHEN doc_id % 5 = 2 THEN '' ELSE source END AS source, CASE WHEN doc_id % 3 <> 1 THEN '2024-01-01' END AS date, doc_id % 11 <> 4 AS filled FROM documents) "


@query(
    _HEADS_SQL + f"SELECT file, 'parse' AS check, '{batches.NO_MAPPING}' AS message FROM h WHERE NOT mapping UNION ALL SELECT file, 'top_level_required', 'missing required top-level field: source' FROM h WHERE mapping AND coalesce(source, '') = '' "
    f"UNION ALL SELECT file, 'top_level_required', 'missing required top-level field: date' FROM h WHERE mapping AND date IS NULL UNION ALL SELECT file, 'top_level_required', '{batches.NOTHING}' FROM h WHERE mapping AND NOT filled"
)
def structural_halts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    source = F.when(d % 5 == 1, F.lit(None).cast("string")).when(d % 5 == 2, "").otherwise(F.col("source"))
    heads = read(spark, sf_dir, "documents").select(d.alias("file"), (d % 7 != 3).alias("mapping"), source.alias("source"), F.when(d % 3 != 1, "2024-01-01").alias("date"), (d % 11 != 4).alias("filled"))
    return batches.header_findings(heads)


assert L.BLOCK == 2 and L.REQUIRE_APPROVAL == 1  # the numbers in the SQL above
