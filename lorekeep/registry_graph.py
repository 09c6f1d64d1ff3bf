"""Queries of what writes and reads the graph: landing, the store, approvals, contradictions, gaps, dossiers, contracts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import lexicon as L
from lorekeep.functions import text as X
from lorekeep.lineage import kept_until_done, shared_folder
from lorekeep.operators import approvals, contradictions, explain, gaps, landing, verdicts
from lorekeep.plans import claim_index, contract_rules
from lorekeep.registry import _IN, _plans, query, read
from lorekeep.sources import documents, proposals
from lorekeep.sources.store import TABLES, ConcurrentCommit, Store, with_fields

_TODAY = "2024-05-01"


# ---------------------------------------------------------------- landing
def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node for every third order, in two scopes."""
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")
    return rows.select(
        F.concat(F.lit("scope-"), (k % 2).cast("string")).alias("scope"), F.lit("order").alias("kind"), k.cast("string").alias("key"), F.to_json(F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))).alias("props"),
        (k % 5 == 0).alias("is_protected"), F.lit("team-a").alias("owner"), F.when(k % 4 == 0, "unmapped").otherwise("active").alias("status"), (k % 4 + 1).cast("int").alias("revision"), F.concat(F.lit("run-"), (k % 50).cast("string")).alias("run_id"),
        F.lit("t0").alias("provenance_ts"), F.lit("2024-01-01").cast("date").alias("valid_from"), F.lit("").alias("slot"),
    )


def _landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second order lands anew, with a reference to its customer."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(
        F.concat(F.lit("scope-"), (k % 2).cast("string")).alias("scope"), F.lit("order").alias("kind"), k.cast("string").alias("key"), F.to_json(F.struct(F.col("o_orderpriority").alias("priority"), F.lit("new").alias("status"))).alias("props"),
        F.lit(False).alias("is_protected"), F.lit("team-b").alias("owner"), F.lit("active").alias("status"), F.lit(1).alias("revision"), F.lit("run-new").alias("run_id"), F.lit("t1").alias("provenance_ts"), F.lit(_TODAY).cast("date").alias("valid_from"), F.lit("").alias("slot"),
        F.create_map(F.lit("customers"), F.concat(F.lit('["'), F.col("o_custkey").cast("string"), F.lit('",{"key":"'), (F.col("o_custkey") % 7).cast("string"), F.lit('"}]'))).alias("fields"), k.alias("k"),
    )


def _refs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("order", "customers", "customer")], "kind string, field string, target_kind string")


@query("SELECT DISTINCT concat('scope-', CAST(o_orderkey % 2 AS VARCHAR)) AS scope, CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_orderkey % 2 = 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 37 = 0)")
def insert_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creates that meet a node, or come twice."""
    rows = _landing(spark, sf_dir)
    return landing.clashes(rows.unionByName(rows.where("k % 37 = 0")), _nodes(spark, sf_dir)).select("scope", "key")


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS key, CAST(o_orderkey % 4 + 2 AS INTEGER) AS revision, 'active' AS status, false AS is_protected, 'team-b' AS owner, 'run-new' AS run_id, DATE '{_TODAY}' AS valid_from FROM orders WHERE o_orderkey % 6 = 0")
def supersede_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.superseded(_nodes(spark, sf_dir), _landing(spark, sf_dir)).select("key", "revision", "status", "is_protected", "owner", "run_id", "valid_from")


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS key, CAST(o_orderkey % 4 + 1 AS INTEGER) AS revision, 'team-a' AS owner, DATE '{_TODAY}' AS valid_until, 'run-new' AS superseded_by_run, concat('run-', CAST(o_orderkey % 50 AS VARCHAR)) AS run_id FROM orders WHERE o_orderkey % 6 = 0")
def retired_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.retired(_nodes(spark, sf_dir), _landing(spark, sf_dir), "run-new", F.lit(_TODAY)).select("key", "revision", "owner", "valid_until", "superseded_by_run", "run_id")


_EDGES_SQL = "WITH e AS (SELECT DISTINCT concat('scope-', CAST(o_orderkey % 2 AS VARCHAR)) AS scope, CAST(o_orderkey AS VARCHAR) AS src_key, CAST(unnest([o_custkey, o_custkey % 7]) AS VARCHAR) AS dst_key, o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0) "


@query(_EDGES_SQL + "SELECT scope, 'order' AS src_kind, src_key, 'customers' AS field, 'customer' AS dst_kind, dst_key FROM e WHERE k % 10 <> 0")
def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of landing items that are not stored yet; those of every fifth are."""
    rows = _landing(spark, sf_dir)
    return landing.new_edges(landing.links(rows, _refs(spark)), landing.links(rows.where("k % 10 = 0"), _refs(spark)))


@query('SELECT event_id, concat(\'{"by":"me","k":\', json_extract_string(props, \'$.k\'), \',"kind":"\', event_type, \'"}\') AS props FROM events')
def provenance_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stamp goes under a document (whose own values win), a change over it, control keys away."""
    over = F.to_json(F.struct(F.col("event_type").alias("kind"), F.lit(True).alias("supersede")))
    under = F.lit('{"by":"me","k":"stamp"}')
    return read(spark, sf_dir, "events").select("event_id", documents.rewritten(F.col("props"), over, under, X.strings(L.CONTROL_FIELDS)).alias("props"))


@query("SELECT event_id, replace(props, ' ', '') AS canonical FROM events")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", documents.canonical_text(F.col("props")).alias("canonical"))


_LANDED_SQL = "CASE WHEN event_id % 31 = 0 THEN 'blocked' WHEN (event_type = 'error' OR event_id % 8 = 4) AND event_id % 3 <> 0 THEN 'held' WHEN event_id % 8 = 4 THEN 'supersede' WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'unchanged' WHEN event_type = 'error' THEN 'create' WHEN event_id % 8 = 0 THEN 'unchanged' WHEN event_id % 10 = 0 THEN 'create_unmapped' WHEN event_id % 4 = 0 THEN 'unchanged' ELSE 'create' END"


@query(f"SELECT CASE WHEN event_id % 10 = 0 THEN 2 ELSE 1 END AS section_ord, event_id AS pos, concat('event:', CAST(event_id AS VARCHAR)) AS id, action FROM (SELECT event_id, {_LANDED_SQL} AS action FROM events) WHERE action IN ('create', 'create_unmapped', 'supersede')")
def apply_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lands, in the order in which it is applied: declared items, then nodes, then unmapped ones."""
    plans = _plans(spark, sf_dir).withColumn("pos", X.id_key(F.col("id")).cast("bigint"))
    return verdicts.landing_order(plans).select("section_ord", "pos", "id", "action")


# ---------------------------------------------------------------- gaps
@query(f"SELECT concat('gap-', event_type) AS slug, concat('event:', CAST(event_id AS VARCHAR)) AS item_id, 'north' AS scope, 'r1' AS run_id FROM (SELECT event_id, event_type, {_LANDED_SQL} AS action FROM events) WHERE action = 'create_unmapped' AND event_type <> 'view'")
def gap_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that land without a home vote for their gap; those that are held or blocked don't."""
    types = read(spark, sf_dir, "events").select(X.composite_id(F.lit("event"), F.col("event_id").cast("string")).alias("id"), F.create_map(F.lit("unmapped_gap"), F.when(F.col("event_type") == "view", " ").otherwise(F.concat(F.lit("gap-"), "event_type")), F.lit("unmapped_reason"), F.lit("why")).alias("fields"))
    return gaps.observations_from_plans(_plans(spark, sf_dir).join(types, "id"), "north", "s", "r1", "2024-01-01", "t").select("slug", "item_id", "scope", "run_id")


@query("SELECT DISTINCT event_type AS slug, CAST(user_id AS VARCHAR) AS item_id, concat('r', CAST(event_id % 3 AS VARCHAR)) AS run_id FROM events EXCEPT SELECT event_type, CAST(user_id AS VARCHAR), concat('r', CAST(event_id % 3 AS VARCHAR)) FROM events WHERE event_id % 5 = 0")
def gap_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("slug"), F.col("user_id").cast("string").alias("item_id"), F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string")).alias("run_id"), "event_id")
    return gaps.new_observations(rows, rows.where("event_id % 5 = 0")).select("slug", "item_id", "run_id")


@query("SELECT concat('s', CAST(p_partkey AS VARCHAR)) AS slug, CASE WHEN p_partkey % 3 = 0 THEN 'promoted' ELSE 'rejected' END AS status FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def gap_resolution_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    slugs = read(spark, sf_dir, "part").select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("slug"), "p_partkey")
    row = lambda where, status: slugs.where(where).select("slug", F.lit(status).alias("status"), *[F.lit("").alias(c) for c in ("promoted_to", "note", "actor", "ts")])
    return gaps.resolved(row("p_partkey % 2 = 0", "rejected"), row("p_partkey % 3 = 0", "promoted")).select("slug", "status")


@query(
    "WITH o AS (SELECT event_type AS slug, concat('m', CAST(event_id AS VARCHAR)) AS means, CAST(user_id % 9 AS VARCHAR) AS scope, event_id FROM events WHERE event_type <> 'error'), g AS (SELECT slug, count(*) AS observations, CAST(count(DISTINCT scope) AS INTEGER) AS scopes, max_by(means, (lpad(CAST(event_id AS VARCHAR), 12, '0'), means)) AS means FROM o GROUP BY slug) "
    "SELECT slug, means AS definition, slug AS promoted_from_gap, 'active' AS status, scopes AS independent_scopes, observations FROM g WHERE scopes >= 2"
)
def gap_promotion_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id").cast("string")
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("slug"), F.concat(F.lit("m"), e).alias("means"), e.alias("item_id"), (F.col("user_id") % 9).cast("string").alias("scope"), F.lit("s").alias("source"), F.lpad(e, 12, "0").alias("recorded_ts"), F.lit("").alias("observed_on"))
    rejected = spark.createDataFrame([("error", "rejected", "", "")], "slug string, status string, promoted_to string, note string")
    found = gaps.promotion_entries(gaps.aggregate(rows, rejected))
    return found.select("slug", "entry.definition", "entry.promoted_from_gap", "entry.status", "evidence.independent_scopes", "evidence.observations")


# ---------------------------------------------------------------- proposals
def _proposals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each order is a proposal, eight of one content; its approvals, given after all were made, are good, of other
    content, or of another contract."""
    k = F.col("o_orderkey")
    content, contract = F.concat(F.lit("c"), F.floor(k / 8).cast("string")), F.concat(F.lit("k"), (k % 2).cast("string"))
    heads = read(spark, sf_dir, "orders").select(k.alias("k"), F.concat(F.lit("p"), k.cast("string")).alias("run_id"), content.alias("content_hash"), contract.alias("schema_hash"), F.format_string("t%09d", k % 5).alias("created_ts"))
    approval = lambda kind, schema, digest: F.struct(F.concat(F.lit(f"{kind}:"), F.col("k").cast("string")).alias("id"), schema.alias("against_schema"), digest.alias("against_content"))
    said = F.array(approval("good", F.col("schema_hash"), F.col("content_hash")), approval("unbound", F.lit(""), F.lit(None).cast("string")), approval("other", F.col("schema_hash"), F.lit("x")), approval("foreign", F.lit("x"), F.col("content_hash")))
    return heads.drop("k"), heads.select("run_id", F.lit("u").alias("ts"), F.inline(said))


_PROPOSALS_SQL = "WITH p AS (SELECT o_orderkey AS k, concat('p', CAST(o_orderkey AS VARCHAR)) AS run_id, concat('c', CAST(o_orderkey // 8 AS VARCHAR)) AS content_hash, concat('k', CAST(o_orderkey % 2 AS VARCHAR)) AS schema_hash FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY content_hash, schema_hash ORDER BY k % 5 DESC, run_id DESC) AS place FROM p) "


@query(_PROPOSALS_SQL + "SELECT run_id, content_hash, CAST(place AS INTEGER) AS place FROM r")
def proposals_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approvals.matching(_proposals(spark, sf_dir)[0]).select("run_id", "content_hash", "place")


@query(_PROPOSALS_SQL + "SELECT content_hash, schema_hash, concat(unnest(['good', 'unbound']), ':', CAST(k AS VARCHAR)) AS id FROM r")
def approved_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approvals.approved(*_proposals(spark, sf_dir))


@query(_PROPOSALS_SQL + "SELECT content_hash, schema_hash, concat(unnest(['good', 'unbound']), ':', CAST(k AS VARCHAR)) AS id FROM r WHERE place = 1")
def approved_ids_of_the_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approvals.approved(*_proposals(spark, sf_dir), compat=True)


@query(
    _PROPOSALS_SQL + ", n AS (SELECT *, lead(k % 5) OVER (PARTITION BY content_hash, schema_hash ORDER BY k % 5, run_id) AS followed FROM p) "
    "SELECT content_hash, schema_hash, concat(unnest(['good', 'unbound']), ':', CAST(k AS VARCHAR)) AS id FROM n WHERE followed IS NULL OR k % 3 <= followed"
)
def approvals_taken_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the newest proposals have when each took over its predecessor's approvals; some came too late for that."""
    heads, given = _proposals(spark, sf_dir)
    at = F.format_string("t%09d", F.substring("run_id", 2, 20).cast("bigint") % 3)
    return approvals.approved(heads, given.withColumn("ts", at), compat=True)


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of proposals: lines of an order, keyed by line number, some of them held."""
    run, line = F.col("l_orderkey").cast("string").alias("run_id"), F.col("l_linenumber").cast("string")
    verdict = F.when(F.col("l_linenumber") % 2 == 0, "REQUIRE_APPROVAL").otherwise("ALLOW")
    return read(spark, sf_dir, "lineitem").select(run, F.concat("l_returnflag", F.lit(":"), line).alias("id"), line.alias("key"), verdict.alias("verdict"), (F.col("l_discount") > 0.03).alias("approved")).distinct()


_HELD_SQL = "WITH l AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS run_id, concat(l_returnflag, ':', CAST(l_linenumber AS VARCHAR)) AS id, CAST(l_linenumber AS VARCHAR) AS key, l_linenumber % 2 = 0 AS held, l_discount > 0.03 AS approved FROM lineitem) "


@query(
    _HELD_SQL + ", o AS (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, unnest(['A:2', '4', '1', 'none']) AS token FROM orders), f AS (SELECT o.run_id, o.token, max(CASE WHEN l.held AND l.id = o.token THEN l.id END) AS by_id, list_sort(list_distinct(list(CASE WHEN l.held AND l.key = o.token THEN l.id END))) AS by_key, count(l.id) AS n "
    "FROM o LEFT JOIN l ON o.run_id = l.run_id AND (l.id = o.token OR l.key = o.token) GROUP BY o.run_id, o.token) "
    "SELECT run_id, token, CASE WHEN by_id IS NOT NULL THEN by_id WHEN len(by_key) = 1 THEN by_key[1] END AS id, CASE WHEN n = 0 THEN 'no such item in this proposal' WHEN by_id IS NOT NULL OR len(by_key) = 1 THEN NULL WHEN len(by_key) > 1 THEN concat('ambiguous bare key: it matches ', array_to_string(by_key, ', ')) ELSE 'present in this proposal but not awaiting approval' END AS problem FROM f"
)
def resolve_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), F.explode(X.strings(["A:2", "4", "1", "none"])).alias("token"))
    return approvals.resolve_tokens(_held(spark, sf_dir), tokens)


@query(_HELD_SQL + "SELECT run_id, CASE WHEN bool_or(held AND NOT approved) THEN 'partial' ELSE 'applied' END AS status FROM l GROUP BY run_id")
def proposal_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approvals.status_after(_held(spark, sf_dir))


@query(
    "WITH o AS (SELECT o_orderkey AS k, sha256(CAST(o_orderkey // 4 AS VARCHAR)) AS content, CASE o_orderkey % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS verdict FROM orders WHERE o_orderkey % 10 <> 3), "
    "i AS (SELECT content, k, verdict = 1 AS held, k % 12 = 1 AS granted, concat('order:', CAST(k AS VARCHAR)) AS id FROM o) "
    "SELECT content AS content_hash, concat('run-', content) AS run_id, CAST(count(*) AS BIGINT) AS items, CAST(count_if(held) AS BIGINT) AS held, CAST(count_if(granted) AS BIGINT) AS approved, "
    "CASE WHEN bool_or(held AND NOT granted) THEN 'partial' ELSE 'applied' END AS status, coalesce(string_agg(CASE WHEN granted THEN id END, ',' ORDER BY id), '') AS cleared FROM i GROUP BY content"
)
def proposal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as proposals of four, recorded, approved by item in a second commit, and folded: what a run would find.
    Items whose proposal has no head (a write that failed) don't count."""
    k = F.col("o_orderkey")
    content = F.sha2(F.floor(k / 4).cast("string"), 256)
    orders = read(spark, sf_dir, "orders").select(k.alias("o_orderkey"), content.alias("content_hash"), F.concat(F.lit("run-"), content).alias("run_id"), F.lit("k").alias("schema_hash"), F.lit("t1").alias("ts"))
    whole = orders.where("o_orderkey % 10 <> 3")
    folder = f"{shared_folder(spark)}/proposals-{uuid.uuid4().hex}"
    book = proposals.Proposals(spark, folder)
    item = {"id": F.concat(F.lit("order:"), k.cast("string")), "kind": F.lit("order"), "key": k.cast("string"), "approved": F.lit(False)}
    verdict = F.when(k % 6 == 0, "BLOCK").when(k % 6 == 1, "REQUIRE_APPROVAL").otherwise("ALLOW")
    book.append(proposals.events_of(whole, "item", verdict=verdict, **item))
    book.append(proposals.events_of(orders.where("o_orderkey % 10 = 3").withColumn("run_id", F.concat("run_id", F.lit("-failed"))), "item", verdict=verdict, **item))
    book.append(proposals.events_of(whole.select("run_id", "content_hash", "schema_hash", "ts").distinct(), "head"))
    granted = proposals.events_of(whole.where("o_orderkey % 12 = 1"), "approved", id=item["id"], ts=F.lit("t2"), against_content=F.col("content_hash"), against_schema=F.col("schema_hash"))
    book.append(granted)
    events = book.events()
    now = proposals.items(events)
    held = F.col("verdict") == "REQUIRE_APPROVAL"
    counts = now.groupBy("run_id").agg(F.count("*").alias("items"), F.count_if(held).alias("held"), F.count_if("approved").alias("approved"))  # four items at most
    cleared = approvals.approved(proposals.heads(events), proposals.given(events)).groupBy("content_hash").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("cleared"))
    folded = proposals.heads(events).select("run_id", "content_hash").join(counts, "run_id").join(approvals.status_after(now), "run_id").join(cleared, "content_hash", "left")
    return folded.select("content_hash", "run_id", "items", "held", "approved", "status", F.coalesce("cleared", F.lit("")).alias("cleared"))


# ---------------------------------------------------------------- contradictions
def _believed(spark: SparkSession, sf_dir: str, parts: DataFrame | None = None) -> DataFrame:
    """Parts that claim something of their brand and type; some deny it, some name others that they contradict."""
    k = F.col("p_partkey")
    claim = F.concat(F.lit("the "), "p_name", F.when(k % 3 == 0, " is not").otherwise(" is"), F.when(k % 4 == 0, " open").when(k % 4 == 1, " closed").otherwise(""), F.lit(" in depot "), (F.col("p_size") % 3).cast("string"))
    named = F.when(k % 11 == 0, F.concat(F.lit("part:"), (k + 1).cast("string"))).when(k % 11 == 1, F.concat(F.lit("part:"), k.cast("string")))
    return (read(spark, sf_dir, "part") if parts is None else parts).select(
        F.lit("part").alias("kind"), k.cast("string").alias("key"), F.create_map(F.lit("claim"), claim, F.lit("contradicts"), named, F.lit("source"), F.lit("s")).alias("fields"),
        F.when(k % 7 == 0, "").otherwise(F.concat_ws("/", "p_brand", "p_type")).alias("slot"), F.when(k % 13 == 0, "retired").otherwise("active").alias("status"), F.lit("me").alias("owner"), F.lit("r").alias("run_id"),
    )


_STOP = _IN(L.CLAIM_STOP_WORDS)
def _believed_sql(parts: str = "part") -> str:
    """Observations ``o`` of the nodes ``n`` that ``_believed`` makes of some parts."""
    return (
        "WITH n AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS key, concat('part:', CAST(p_partkey AS VARCHAR)) AS id, concat('the ', p_name, CASE WHEN p_partkey % 3 = 0 THEN ' is not' ELSE ' is' END, CASE p_partkey % 4 WHEN 0 THEN ' open' WHEN 1 THEN ' closed' ELSE '' END, ' in depot ', CAST(p_size % 3 AS VARCHAR)) AS claim, "
        f"CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat(p_brand, '/', p_type) END AS slot, p_partkey % 13 <> 0 AS current, CASE p_partkey % 11 WHEN 0 THEN concat('part:', CAST(p_partkey + 1 AS VARCHAR)) WHEN 1 THEN concat('part:', CAST(p_partkey AS VARCHAR)) END AS named FROM {parts} part), "
        "t AS (SELECT *, list_filter(regexp_split_to_array(lower(claim), '[^a-z0-9]+'), lambda x: x <> '') AS toks FROM n), "
        f"w AS (SELECT *, list_distinct(list_filter(toks, lambda x: length(x) > 1 AND x NOT IN ({_STOP}))) AS words, list_contains(toks, 'not') AS neg FROM t), "
        "p AS (SELECT a.id AS left_id, b.id AS right_id, a.slot, a.neg AS na, b.neg AS nb, a.words AS wa, b.words AS wb, len(list_intersect(a.words, b.words)) / CAST(len(list_distinct(list_concat(a.words, b.words))) AS DOUBLE) AS overlap FROM w a JOIN w b ON a.slot = b.slot AND a.key < b.key WHERE a.slot <> '' AND a.current AND b.current), "
        "lex AS (SELECT left_id, right_id, slot, overlap, CASE WHEN na <> nb THEN 'negation_mismatch' WHEN (list_contains(wa, 'open') AND list_contains(wb, 'closed')) OR (list_contains(wa, 'closed') AND list_contains(wb, 'open')) THEN 'antonym_pair' END AS detector FROM p WHERE overlap >= 0.35), "
        "dec AS (SELECT a.id AS left_id, b.id AS right_id, CASE WHEN a.slot <> '' THEN a.slot ELSE b.slot END AS slot, NULL AS overlap, 'declared' AS detector FROM n a JOIN n b ON a.named = b.id AND a.id <> b.id), "
        "u AS (SELECT *, 0 AS rank FROM lex WHERE detector IS NOT NULL UNION ALL SELECT *, 1 FROM dec), "
        "q AS (SELECT *, concat(least(left_id, right_id), '|', greatest(left_id, right_id), '|', slot) AS pair_key FROM u), "
        "o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_key ORDER BY rank, left_id) AS place FROM q) WHERE place = 1) "
    )


_BELIEVED_SQL = _believed_sql()


def _claiming(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("part", "claim", ["brand"])], "kind string, claim_field string, claim_slot array<string>")


def _observed(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    return contradictions.observations(_believed(spark, sf_dir), _claiming(spark), together)


@query(_BELIEVED_SQL + "SELECT pair_key, left_id, right_id, slot, detector, round(overlap, 6) AS overlap FROM o")
def contradiction_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found by words and declared by writers, each pair once."""
    return _observed(spark, sf_dir).select("pair_key", "left_id", "right_id", "slot", "detector", F.round("overlap", 6).alias("overlap"))


def _ledger(observed: DataFrame) -> DataFrame:
    """Observations of the scope north, some resolved, and two rows of another scope."""
    rows = observed.withColumn("__k", X.id_key(F.col("left_id")).cast("bigint"))
    stored = rows.select(F.lit("north").alias("scope"), *[x.split()[0] for x in contradictions.OBSERVATION.split(", ")], F.when(F.col("__k") % 5 == 0, "resolved").otherwise("active").alias("state"), *[F.lit(v).alias(c) for c, v in (("detected_run_id", "r0"), ("detected_ts", "t0"), ("resolved_ts", ""), ("resolution", ""))], "__k")
    return stored.unionByName(stored.where("__k % 9 = 0").withColumn("scope", F.lit("south")))


@query(
    _BELIEVED_SQL + ", s AS (SELECT pair_key, CAST(split_part(left_id, ':', 2) AS BIGINT) AS k FROM o) "
    "SELECT 'north' AS scope, pair_key, CASE WHEN k % 4 = 0 THEN 'resolved' ELSE 'active' END AS state, CASE WHEN k % 4 <> 0 AND (k % 5 = 0 OR k % 6 = 0) THEN 'r1' ELSE 'r0' END AS detected_run_id FROM s WHERE k % 6 <> 0 OR k % 4 <> 0 UNION ALL SELECT 'south', pair_key, CASE WHEN k % 5 = 0 THEN 'resolved' ELSE 'active' END, 'r0' FROM s WHERE k % 9 = 0 AND k % 6 <> 0"
)
def ledger_after_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after a run: what is gone is resolved, what came back is active, other scopes stay."""
    observed = _observed(spark, sf_dir, together=True)
    stored = _ledger(observed).where("__k % 6 <> 0").drop("__k")
    found = observed.where(X.id_key(F.col("left_id")).cast("bigint") % 4 != 0)
    after, _ = contradictions.reconcile(found, stored, "north", "r1", "t1")
    return after.select("scope", "pair_key", "state", "detected_run_id")


#: What the third of three commits makes of the parts: other depots, other brands, other denials.
_LATER = {"p_name": "CASE WHEN p_partkey % 15 = 0 THEN concat('not ', p_name) ELSE p_name END", "p_size": "CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END", "p_brand": "CASE WHEN p_partkey % 20 = 0 THEN 'Brand#11' ELSE p_brand END"}
_STAGES_SQL = ", ".join(
    f"o{i} AS ({_believed_sql(parts)} SELECT o.pair_key, x.claim AS l, y.claim AS r FROM o JOIN n x ON o.left_id = x.id JOIN n y ON o.right_id = y.id)"
    for i, parts in enumerate(("(SELECT * FROM part WHERE p_partkey % 3 <> 1)", "part", f"(SELECT * REPLACE ({', '.join(f'{sql} AS {c}' for c, sql in _LATER.items())}) FROM part)"), 1)
)


@query(
    f"WITH {_STAGES_SQL}, a AS (SELECT pair_key FROM o1 UNION SELECT pair_key FROM o2 UNION SELECT pair_key FROM o3) "
    "SELECT 'north' AS scope, a.pair_key, CASE WHEN o3.pair_key IS NULL THEN 'resolved' ELSE 'active' END AS state, "
    "CASE WHEN o3.pair_key IS NOT NULL AND (o2.pair_key IS NULL OR o2.l <> o3.l OR o2.r <> o3.r) THEN 'r3' WHEN o1.pair_key IS NULL OR o1.l <> o2.l OR o1.r <> o2.r THEN 'r2' ELSE 'r1' END AS detected_run_id "
    "FROM a LEFT JOIN o1 ON a.pair_key = o1.pair_key LEFT JOIN o2 ON a.pair_key = o2.pair_key LEFT JOIN o3 ON a.pair_key = o3.pair_key"
)
def ledger_of_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger that three commits leave, each folded in by the index of claims: two thirds of the parts, the others, and some anew."""
    store, kinds, every = Store(spark, f"{shared_folder(spark)}/claims-{uuid.uuid4().hex}"), _claiming(spark), read(spark, sf_dir, "part")
    k = "p_partkey"
    for revision, run, parts in ((1, "r1", every.where(f"{k} % 3 <> 1")), (1, "r2", every.where(f"{k} % 3 = 1")), (2, "r3", every.withColumns({c: F.expr(sql) for c, sql in _LATER.items()}).where(f"{k} % 5 = 0"))):
        nodes = _believed(spark, sf_dir, parts).select(
            F.lit("north").alias("scope"), "kind", "key", F.to_json("fields").alias("props"), F.lit(False).alias("is_protected"), "owner", "status", F.lit(revision).alias("revision"), "run_id",
            F.lit("t").alias("provenance_ts"), F.lit(_TODAY).cast("date").alias("valid_from"), "slot",
        )
        base = store.manifest()
        with kept_until_done(spark) as keep:
            folded = claim_index.fold(store, base, nodes, kinds, "north", True, run, "t", keep)
            store.commit(base, {"nodes": nodes, **folded.tables}, folded.notes, folded.renewed)
    return store.read("contradictions").select("scope", "pair_key", "state", "detected_run_id")


@query(_BELIEVED_SQL + "SELECT left_id AS id, right_id AS with_id, detector, x.claim AS this_side, y.claim AS other_side FROM o JOIN n x ON o.left_id = x.id JOIN n y ON o.right_id = y.id UNION ALL SELECT right_id, left_id, detector, y.claim, x.claim FROM o JOIN n x ON o.left_id = x.id JOIN n y ON o.right_id = y.id")
def contradiction_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contradiction as either node sees it."""
    return explain.both_sides(_ledger(_observed(spark, sf_dir)).where("scope = 'north'")).select("id", F.col("with").alias("with_id"), "detector", "this_side", "other_side")


# ---------------------------------------------------------------- the store
_STORES: dict[tuple[str, str], str] = {}


def _store(spark: SparkSession, sf_dir: str, ledger: bool = False) -> Store:
    """A store of two commits in the shared folder, made once a session: nodes, then half of them superseded.  The ledger is a commit
    of its own, made when a query first reads it."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _STORES:
        store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
        nodes, rows = _nodes(spark, sf_dir), _landing(spark, sf_dir)
        replacing = rows.join(nodes.select(*landing.KEY), landing.KEY, "left_semi")
        created = rows.join(nodes.select(*landing.KEY), landing.KEY, "left_anti")
        store.commit(store.manifest(), {"nodes": nodes, "edges": landing.new_edges(landing.links(rows.where("k % 10 = 0"), _refs(spark)), spark.createDataFrame([], TABLES["edges"]))})
        base = store.manifest()
        changed = {
            "nodes": created.select(*nodes.columns).unionByName(landing.superseded(nodes, replacing)), "node_revisions": landing.retired(nodes, replacing, "run-new", F.lit(_TODAY)),
            "edges": landing.new_edges(landing.links(rows, _refs(spark)), store.read("edges", base)),
        }
        store.commit(base, changed)
        _STORES[at] = store.path
    store = Store(spark, _STORES[at])
    base = store.manifest()
    if ledger and "contradictions" not in base["tables"]:
        store.commit(base, {"contradictions": _ledger(_observed(spark, sf_dir)).drop("__k")})
    return store


_STORED_SQL = "WITH s AS (SELECT o_orderkey AS k, concat('scope-', CAST(o_orderkey % 2 AS VARCHAR)) AS scope, CAST(o_orderkey AS VARCHAR) AS key, o_orderkey % 2 = 0 AS landed, o_orderkey % 3 = 0 AS was, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderstatus END AS status_field FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0) "


@query(_STORED_SQL + "SELECT scope, key, CAST(CASE WHEN landed AND was THEN k % 4 + 2 WHEN landed THEN 1 ELSE k % 4 + 1 END AS INTEGER) AS revision, CASE WHEN landed THEN 'run-new' ELSE concat('run-', CAST(k % 50 AS VARCHAR)) END AS run_id, status_field FROM s")
def store_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes after both commits, later segments over earlier ones."""
    return _store(spark, sf_dir).existing("*", False).select("scope", "key", "revision", "run_id", F.col("fields")["status"].alias("status_field"))


@query(_STORED_SQL + "SELECT key, status_field FROM s WHERE scope = 'scope-1'")
def store_nodes_of_a_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).existing("scope-1", True).select("key", F.col("fields")["status"].alias("status_field"))


@query(_STORED_SQL + "SELECT key, CAST(k % 4 + 2 AS INTEGER) AS revision, status_field FROM s WHERE k = 6")
def store_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).node("order", "6", "scope-0").select("key", "revision", F.col("fields")["status"].alias("status_field"))


@query(_STORED_SQL + "SELECT scope, key, CAST(CASE WHEN landed AND was THEN k % 4 + 2 WHEN landed THEN 1 ELSE k % 4 + 1 END AS INTEGER) AS revision, status_field FROM s WHERE k IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 5)")
def store_bulk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of many keys at once: the orders of five lines and more."""
    keys = read(spark, sf_dir, "lineitem").where("l_linenumber = 5").select(F.lit("order").alias("kind"), F.col("l_orderkey").cast("string").alias("key"))
    return with_fields(_store(spark, sf_dir).lookup_many("nodes", keys)).select("scope", "key", "revision", F.col("fields")["status"].alias("status_field"))


def _plain_nodes(spark: SparkSession, sf_dir: str, where: str, run: str) -> DataFrame:
    """A node for each order that ``where`` takes."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").where(where).select(
        F.lit("s").alias("scope"), F.lit("order").alias("kind"), k.cast("string").alias("key"), F.to_json(F.struct(F.col("o_orderstatus").alias("status"))).alias("props"), F.lit(False).alias("is_protected"), F.lit("o").alias("owner"), F.lit("active").alias("status"),
        (k % 4 + 1).cast("int").alias("revision"), F.lit(run).alias("run_id"), F.lit("t").alias("provenance_ts"), F.lit(_TODAY).cast("date").alias("valid_from"), F.lit("").alias("slot"),
    )


@query(
    "SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE o_orderkey % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE 'last' END AS run_id, CAST(3 AS BIGINT) AS version FROM orders WHERE o_orderkey % 3 <> 2 OR o_orderkey % 4 = 0"
)
def store_interleaved_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of four commits to one base, the first is written, the second follows it since their keys are apart, the third meets keys
    of the first and leaves nothing, and the last follows both."""
    store = Store(spark, f"{shared_folder(spark)}/interleaved-{uuid.uuid4().hex}")
    base = store.manifest()
    for run, where in (("first", "o_orderkey % 3 = 0"), ("second", "o_orderkey % 3 = 1"), ("third", "o_orderkey % 6 < 4"), ("last", "o_orderkey % 3 = 2 and o_orderkey % 4 = 0")):
        try:
            store.commit(base, {"nodes": _plain_nodes(spark, sf_dir, where, run)})
        except ConcurrentCommit:
            if run != "third":
                raise
    after = store.manifest()
    return store.read("nodes", after).select("key", "run_id", F.lit(after["version"]).cast("bigint").alias("version"))


@query(
    "SELECT CAST(o_orderkey AS VARCHAR) AS key, CAST(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 4 + 1 END AS BIGINT) AS revision, CASE WHEN o_orderkey % 3 <> 1 THEN 'o' END AS owner, CASE WHEN o_orderkey % 3 = 2 THEN o_totalprice END AS weight FROM orders"
)
def store_widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three segments of three schemas, read as the last: revisions widen, columns come and go."""
    where = f"{shared_folder(spark)}/widened-{uuid.uuid4().hex}"
    plain = [f"{c} {kind}" for c, kind in (x.split(" ", 1) for x in TABLES["nodes"].split(", ")) if c not in ("revision", "owner")]
    now = [*plain, "revision bigint", "owner string", "weight double"]
    weight = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_totalprice").cast("double").alias("weight"))
    for rest, columns in enumerate(([*plain, "owner string", "gone string"], [*plain, "revision int"], now)):
        store = Store(spark, where, {"nodes": ", ".join(columns)})
        rows = _plain_nodes(spark, sf_dir, f"o_orderkey % 3 = {rest}", "r").withColumn("gone", F.lit("x"))
        rows = rows.withColumn("revision", F.col("revision").cast("bigint")).join(weight, "key") if rest == 2 else rows
        store.commit(store.manifest(), {"nodes": rows})
    return Store(spark, where, {"nodes": ", ".join(now)}).read("nodes").select("key", "revision", "owner", "weight")


@query(_STORED_SQL + f"SELECT key, CAST(k % 4 + 1 AS INTEGER) AS revision, DATE '{_TODAY}' AS valid_until FROM s WHERE k = 12 AND landed AND was")
def store_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).revisions("order", "12", "scope-0", 20).select("key", "revision", "valid_until")


@query(_EDGES_SQL + "SELECT 'customers' AS field, 'customer' AS dst_kind, dst_key FROM e WHERE k = 12")
def store_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).edges("order", "12", "scope-0")


@query(_BELIEVED_SQL + ", s AS (SELECT pair_key, CAST(split_part(left_id, ':', 2) AS BIGINT) AS k FROM o) SELECT 'north' AS scope, pair_key FROM s WHERE k % 5 <> 0 UNION ALL SELECT 'south', pair_key FROM s WHERE k % 5 <> 0 AND k % 9 = 0")
def store_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir, ledger=True).ledger("active", newest_first=False).select("scope", "pair_key")


@query(
    _STORED_SQL + ", l AS (SELECT k, count(DISTINCT d) AS links FROM (SELECT o_orderkey AS k, unnest([o_custkey, o_custkey % 7]) AS d FROM orders WHERE o_orderkey % 2 = 0) GROUP BY k) "
    "SELECT s.key, CAST(CASE WHEN landed AND was THEN 1 ELSE 0 END AS BIGINT) AS versions, false AS versions_truncated, CAST(coalesce(l.links, 0) AS BIGINT) AS links, CAST(0 AS BIGINT) AS contradicted_by, CASE WHEN NOT landed AND s.k % 4 = 0 THEN '' END AS gap FROM s LEFT JOIN l ON s.k = l.k"
)
def dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir, ledger=True)
    found = explain.dossiers(*(store.read(t) for t in ("nodes", "node_revisions", "edges", "contradictions")))
    return found.select(X.id_key(F.col("id")).alias("key"), "versions", "versions_truncated", "links", "contradicted_by", "gap")


@query(
    _BELIEVED_SQL + ", v AS (SELECT CAST(l_partkey AS VARCHAR) AS key, l_orderkey * 10 + l_linenumber AS rev, max(l_shipdate) AS until FROM lineitem GROUP BY ALL), "
    "vv AS (SELECT key, count(*) > 4 AS more, array_to_string(list(concat(CAST(rev AS VARCHAR), '@', CAST(CAST(until AS DATE) AS VARCHAR)) ORDER BY rev DESC)[1:4], ',') AS shown FROM v GROUP BY key), "
    "e AS (SELECT CAST(l_partkey AS VARCHAR) AS key, CAST(l_suppkey AS VARCHAR) AS dst FROM lineitem GROUP BY ALL), ee AS (SELECT key, count(*) > 3 AS more, array_to_string(list(dst ORDER BY dst)[1:3], ',') AS shown FROM e GROUP BY key), "
    "c AS (SELECT left_id AS id, right_id AS other, pair_key, detector FROM o UNION ALL SELECT right_id, left_id, pair_key, detector FROM o), cc AS (SELECT id, count(*) > 3 AS more, array_to_string(list(concat(other, '/', detector) ORDER BY pair_key, other)[1:3], ',') AS shown FROM c GROUP BY id) "
    "SELECT n.id, n.claim, coalesce(vv.shown, '') AS versions, coalesce(vv.more, false) AS versions_truncated, coalesce(ee.shown, '') AS links, coalesce(ee.more, false) AS links_truncated, coalesce(cc.shown, '') AS contradictions, coalesce(cc.more, false) AS contradictions_truncated "
    "FROM n LEFT JOIN vv ON n.key = vv.key LEFT JOIN ee ON n.key = ee.key LEFT JOIN cc ON n.id = cc.id"
)
def dossier_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of every part: its newest versions (made of its lines), suppliers, and both sides of its contradictions."""
    lines, null = read(spark, sf_dir, "lineitem"), F.lit(None).cast("string")
    key = F.col("l_partkey").cast("string").alias("key")
    nodes = _believed(spark, sf_dir).select(
        F.lit("north").alias("scope"), "kind", "key", F.to_json("fields").alias("props"), F.lit(False).alias("is_protected"), "owner", "status", F.lit(1).alias("revision"), "run_id", null.alias("provenance_ts"), null.cast("date").alias("valid_from"), "slot"
    )
    number = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint")
    last = lines.groupBy(key, number.alias("revision")).agg(F.max(F.col("l_shipdate").cast("date")).alias("valid_until"))
    revisions = last.select(F.lit("north").alias("scope"), F.lit("part").alias("kind"), "key", null.alias("props"), "revision", null.alias("owner"), "valid_until", null.alias("superseded_by_run"))
    edges = lines.select(F.lit("north").alias("scope"), F.lit("part").alias("src_kind"), F.col("l_partkey").cast("string").alias("src_key"), F.lit("suppliers").alias("field"), F.lit("supplier").alias("dst_kind"), F.col("l_suppkey").cast("string").alias("dst_key")).distinct()
    ledger = _observed(spark, sf_dir, together=True).withColumns({"scope": F.lit("north"), "state": F.lit("active"), "detected_ts": F.lit("t"), "resolved_ts": F.lit("")})
    found = explain.contents(nodes, revisions, edges, ledger, version_limit=4, most=3)
    shown = lambda name, of: F.array_join(F.transform(name, of), ",").alias(name)
    return found.select(
        "id", F.get_json_object("node.props", "$.claim").alias("claim"), shown("versions", lambda x: F.concat(x["revision"].cast("string"), F.lit("@"), x["valid_until"].cast("string"))), "versions_truncated",
        shown("links", lambda x: x["dst_key"]), "links_truncated", shown("contradictions", lambda x: F.concat(x["with"], F.lit("/"), x["detector"])), "contradictions_truncated",
    )


# ---------------------------------------------------------------- contracts as rows
def _contracts(spark: SparkSession, sf_dir: str) -> contract_rules.Tables:
    """A contract for each nation, with faults at fixed places; its kinds come from suppliers, its terms from customers."""
    n, s, c = F.col("n_nationkey"), F.col("s_suppkey"), F.col("c_custkey")
    of = lambda col: F.concat(F.lit("n"), col.cast("string")).alias("contract")
    name = F.concat(F.when(s % 10 == 3, "a:b").otherwise("kind"), s.cast("string"))
    claims = F.when(s % 7 == 1, "other").when(s % 7 == 2, "").otherwise("text")
    kinds = read(spark, sf_dir, "supplier").select(
        of(F.col("s_nationkey")), name.alias("kind"), F.when(s % 10 == 4, "").otherwise("key").alias("key_field"), F.array(F.when(s % 10 == 5, "protected").otherwise("text")).alias("required"), F.array(F.lit("text")).alias("content_fields"),
        claims.alias("claim_field"), F.array(F.lit("topic")).alias("claim_slot"), F.when(s % 10 == 6, 1.5).otherwise(0.75).alias("near_duplicate_threshold"), F.lit("field").alias("field"), F.when(s % 10 == 7, "nowhere").otherwise("terms").alias("vocab"), F.when(s % 10 == 8, "nothing").otherwise(name).alias("target_kind"),
    )
    term = F.concat(F.lit("t"), c.cast("string"))
    terms = read(spark, sf_dir, "customer").select(
        of(F.col("c_nationkey")), F.lit("terms").alias("vocab"), term.alias("term"), F.when(c % 9 == 1, "deprecated").when(c % 9 == 2, "odd").otherwise("active").alias("status"),
        F.when(c % 18 == 1, "gone").when(c % 18 == 10, term).otherwise("").alias("replaced_by"), F.array(F.when(c % 9 == 3, term).otherwise(F.concat(term, F.lit("x")))).alias("synonyms"),
    )
    nations = read(spark, sf_dir, "nation").select(of(n), F.when(n % 5 == 1, "local").otherwise("global").alias("identity"))
    vocabularies = nations.select("contract", F.explode(X.strings(["terms", "empty"])).alias("vocab")).where("vocab = 'terms' or contract in ('n1', 'n2')")
    return contract_rules.Tables(nations, kinds.drop("field", "vocab", "target_kind"), kinds.select("contract", "kind", "field", "vocab"), kinds.select("contract", "kind", "field", "target_kind"), vocabularies, terms)


_RULES = contract_rules.RULES


@query(
    "WITH k AS (SELECT s_suppkey AS s, concat('n', CAST(s_nationkey AS VARCHAR)) AS contract, concat(CASE WHEN s_suppkey % 10 = 3 THEN 'a:b' ELSE 'kind' END, CAST(s_suppkey AS VARCHAR)) AS kind FROM supplier), "
    "t AS (SELECT c_custkey AS c, concat('n', CAST(c_nationkey AS VARCHAR)) AS contract, concat('t', CAST(c_custkey AS VARCHAR)) AS term FROM customer), n AS (SELECT n_nationkey AS n, concat('n', CAST(n_nationkey AS VARCHAR)) AS contract FROM nation) "
    "SELECT contract, 'identity' AS rule, 'local' AS subject FROM n WHERE n % 5 = 1 UNION ALL SELECT contract, 'no_kinds', contract FROM n WHERE contract NOT IN (SELECT contract FROM k) "
    "UNION ALL SELECT contract, 'kind_name', kind FROM k WHERE s % 10 = 3 UNION ALL SELECT contract, 'key_field', kind FROM k WHERE s % 10 = 4 UNION ALL SELECT contract, 'reserved_field', kind FROM k WHERE s % 10 = 5 "
    "UNION ALL SELECT contract, 'claim_field', kind FROM k WHERE s % 7 = 1 UNION ALL SELECT contract, 'claim_slot', kind FROM k WHERE s % 7 = 2 UNION ALL SELECT contract, 'threshold', kind FROM k WHERE s % 10 = 6 "
    "UNION ALL SELECT contract, 'unknown_vocabulary', concat(kind, '.field') FROM k WHERE s % 10 = 7 OR contract NOT IN (SELECT contract FROM n) UNION ALL SELECT contract, 'unknown_target', concat(kind, '.field') FROM k WHERE s % 10 = 8 "
    "UNION ALL SELECT n.contract, 'no_terms', 'terms' FROM n WHERE contract NOT IN (SELECT contract FROM t) UNION ALL SELECT contract, 'no_terms', 'empty' FROM n WHERE contract IN ('n1', 'n2') "
    "UNION ALL SELECT contract, 'alias_is_term', concat('terms.', term) FROM t WHERE c % 9 = 3 UNION ALL SELECT contract, 'replacement', concat('terms.', term) FROM t WHERE c % 18 = 1 UNION ALL SELECT contract, 'term_status', concat('terms.', term) FROM t WHERE c % 9 = 2"
)
def contract_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules on contracts, over all contracts of a catalogue at once."""
    return contract_rules.problems(_contracts(spark, sf_dir))
