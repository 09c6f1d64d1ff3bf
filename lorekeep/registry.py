"""All queries of the engine's own operators over the shared tables, with their SQL.

Both sides embed one fixed contract.  Each query applies the operator that the write and read paths
use to whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import lexicon as L
from lorekeep.functions import text as X
from lorekeep.lineage import shared_folder
from lorekeep.operators import audit_chain, checks, contradictions, gaps, similarity, verdicts
from lorekeep.plans.contract import Contract
from lorekeep.sources import batches
from lorekeep.streaming import chains

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


LOOKUP = [("event", "click", "click", "exact"), ("event", "view", "view", "exact"), ("event", "purchase", "purchase", "exact"), ("event", "registration", "registration", "exact"), ("event", "signup", "registration", "synonym"), ("event", "error", "failure", "deprecated"), ("event", "failure", "failure", "exact")]
_LOOKUP_SQL = "(VALUES " + ", ".join(f"('{v}', '{c}', '{h}')" for _, v, c, h in LOOKUP) + ") AS l(value, canonical, how)"


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookup = spark.createDataFrame(LOOKUP, "vocab string, value string, canonical string, how string")
    return checks.resolve_terms(read(spark, sf_dir, "events").select("event_id", "event_type"), F.col("event_type"), F.lit("event"), lookup)


_RESOLVED_SQL = f"resolved AS (SELECT e.event_id, e.event_type, l.canonical, CASE WHEN e.event_type IS NOT NULL THEN coalesce(l.how, 'unknown') END AS how FROM events e LEFT JOIN {_LOOKUP_SQL} ON e.event_type = l.value)"


@query(f"WITH {_RESOLVED_SQL} SELECT event_id, event_type, canonical, how FROM resolved WHERE how IN ('unknown', 'deprecated')")
def vocab_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).where("how in ('unknown', 'deprecated')").select("event_id", "event_type", "canonical", "how")


@query(f"WITH {_RESOLVED_SQL} SELECT event_id, event_type AS old, canonical AS new FROM resolved WHERE how = 'synonym'")
def synonym_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).where("how = 'synonym'").select("event_id", F.col("event_type").alias("old"), F.col("canonical").alias("new"))


@query(f"WITH {_RESOLVED_SQL} SELECT how, canonical, CAST(count(*) AS BIGINT) AS held FROM resolved WHERE how = 'deprecated' GROUP BY how, canonical")
def deprecated_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).where("how = 'deprecated'").groupBy("how", "canonical").agg(F.count("*").alias("held"))


@query("SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def key_unique_in_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.repeated_keys(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def refs_exist(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey")
    declared = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return checks.missing_references(refs, declared, ["o_orderkey"]).withColumnRenamed("o_orderkey", "l_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def implicit_create_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer")
    return checks.missing_references(customers.select("c_custkey", "c_name"), customers.where("c_custkey % 2 = 0"), ["c_custkey"])


def _proposed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order proposed anew, the price of each third one changed."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"))
    fields = lambda price: F.create_map(F.lit("price"), F.format_string("%.2f", price), F.lit("status"), F.col("o_orderstatus"))
    price = F.when(F.col("o_orderkey") % 3 == 0, F.col("price") + 1).otherwise(F.col("price"))
    key = F.col("o_orderkey").cast("string")
    items = orders.select(F.lit("order").alias("kind"), key.alias("key"), fields(price).alias("fields"), X.strings(["price", "status"]).alias("content_fields"), (F.col("o_orderkey") % 2 == 0).alias("supersede"), (F.col("o_orderstatus") != "P").alias("supersedable"))
    existing = orders.select(F.lit("order").alias("kind"), key.alias("key"), fields(F.col("price")).alias("fields"), (F.col("o_orderkey") % 5 == 0).alias("is_protected"), F.when(F.col("o_orderkey") % 7 == 0, "team-a").otherwise("team-b").alias("owner"))
    return checks.against_existing(items, existing)


_ORDER_CLASS = "CASE WHEN o_orderkey % 3 <> 0 THEN 'identical' WHEN o_orderstatus = 'P' THEN 'blocked' WHEN o_orderkey % 2 = 0 THEN 'supersede' ELSE 'conflict' END"


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS key, {_ORDER_CLASS} AS class FROM orders")
def collision_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _proposed_orders(spark, sf_dir).select("key", checks.collision_class(F.col("changed"), F.col("supersedable"), F.col("supersede")).alias("class"))


GRAMS_SQL = "list_distinct(list_transform(generate_series(1, greatest(length({d}) - 2, 1)), lambda i: substr({d}, i, 3)))"
NORMAL_SQL = r"trim(regexp_replace(regexp_replace(lower({c}), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(
    "WITH n AS (SELECT DISTINCT s_name AS key, " + NORMAL_SQL.format(c="s_name") + " AS normal FROM supplier), g AS (SELECT *, " + GRAMS_SQL.format(d="replace(normal, ' ', '')") + " AS grams, substr(normal, 1, 4) AS block FROM n WHERE length(normal) >= 6) "
    "SELECT a.key, b.key AS other, round(len(list_intersect(a.grams, b.grams)) / CAST(len(list_distinct(list_concat(a.grams, b.grams))) AS DOUBLE), 6) AS score FROM g a JOIN g b ON a.block = b.block AND a.key < b.key AND a.normal <> b.normal "
    "WHERE len(list_intersect(a.grams, b.grams)) / CAST(len(list_distinct(list_concat(a.grams, b.grams))) AS DOUBLE) >= 0.75"
)
def near_duplicate_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("key"))
    return similarity.near_duplicates(names, names).select("key", "other", F.round("score", 6).alias("score"))


@query(
    "WITH p AS (SELECT DISTINCT p_name FROM part), c AS (SELECT p_name, unnest(string_split(replace(" + NORMAL_SQL.format(c="p_name") + ", ' ', ''), '')) AS ch FROM p), f AS (SELECT p_name, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ALL), "
    "t AS (SELECT p_name, sum(n) AS total FROM f GROUP BY p_name) SELECT f.p_name, round(-sum(n / total * log2(n / total)), 6) AS entropy FROM f JOIN t ON f.p_name = t.p_name GROUP BY f.p_name"
)
def key_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_name").distinct().select("p_name", F.round(X.key_entropy(X.normal_key(F.col("p_name"))), 6).alias("entropy"))


@query(
    "WITH n AS (SELECT DISTINCT p_brand AS brand, p_type AS type FROM part), g AS (SELECT *, " + GRAMS_SQL.format(d="replace(lower(type), ' ', '')") + " AS a, " + GRAMS_SQL.format(d="regexp_replace(lower(brand), '[^a-z0-9_]', '', 'g')") + " AS b FROM n) "
    "SELECT brand, type, CAST(len(a) AS INTEGER) AS grams, round(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 6) AS score FROM g"
)
def trigram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type")).distinct()
    a, b = X.trigrams(X.normal_key(F.col("type"))), X.trigrams(X.normal_key(F.col("brand")))
    return pairs.select("brand", "type", F.size(a).alias("grams"), F.round(X.jaccard(a, b), 6).alias("score"))


def _slug() -> Column:
    e = F.col("event_id") % 6
    return F.when(e == 0, F.lit("other-gap")).when(e == 1, F.concat("event_type", F.lit("-flow-"), F.col("user_id").cast("string"))).when(e == 2, F.concat("event_type", F.lit("_Path"))).when(e == 3, F.concat("event_type", F.lit("-northwind-region"))).when(e == 4, F.lit("new-item-gap")).otherwise(F.col("event_type"))


_SLUG_SQL = "CASE event_id % 6 WHEN 0 THEN 'other-gap' WHEN 1 THEN concat(event_type, '-flow-', CAST(user_id AS VARCHAR)) WHEN 2 THEN concat(event_type, '_Path') WHEN 3 THEN concat(event_type, '-northwind-region') WHEN 4 THEN 'new-item-gap' ELSE event_type END"
_IN = lambda words: ", ".join(f"'{w}'" for w in words)


@query(
    f"WITH s AS (SELECT event_id, {_SLUG_SQL} AS slug FROM events), p AS (SELECT event_id, slug, regexp_matches(slug, '{L.GAP_SLUG}') AS formed, string_split(slug, '-') AS w FROM s), "
    f"u AS (SELECT event_id, slug, 'malformed' AS problem FROM p WHERE NOT formed UNION ALL SELECT event_id, slug, 'names_nothing' FROM p WHERE formed AND slug IN ({_IN(L.NON_NAMING_SLUGS)}) "
    f"UNION ALL SELECT event_id, slug, 'filler' FROM p WHERE formed AND slug NOT IN ({_IN(L.NON_NAMING_SLUGS)}) AND len(list_filter(w, lambda x: x NOT IN ({_IN(L.SLUG_FILLER)}))) = 0 "
    "UNION ALL SELECT event_id, slug, 'names_scope' FROM p WHERE formed AND list_has_any(w, ['northwind', 'traders'])) SELECT event_id, slug, problem FROM u"
)
def gap_slug_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", _slug().alias("slug"))
    return rows.select("event_id", "slug", F.explode(X.slug_problems(F.col("slug"), F.lit("Northwind Traders"))).alias("problem"))


@query("SELECT CAST(event_id AS VARCHAR) AS key, event_type AS gap FROM events WHERE event_type IN ('error', 'signup') AND event_id % 4 <> 0")
def unmapped_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").where("event_type in ('error', 'signup')").select(F.col("event_id").cast("string").alias("key"), "event_id", F.create_map(F.lit("unmapped_gap"), F.col("event_type")).alias("fields"))
    rows = checks.missing_references(events, events.where("event_id % 4 = 0"), ["key"])
    return rows.select("key", checks.gap_slug(F.col("fields")).alias("gap"))


def _gap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("slug"), F.concat(F.lit("seen as "), F.col("event_id").cast("string")).alias("means"), F.col("event_id").cast("string").alias("item_id"),
        F.when(F.col("user_id") % 10 == 0, "").otherwise(F.col("user_id").cast("string")).alias("scope"), F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")).alias("source"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("recorded_ts"), F.lit("").alias("observed_on"),
    )


def _resolutions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("error", "rejected", "", "noise"), ("purchase", "promoted", "buy", "")], "slug string, status string, promoted_to string, note string")


_GAPS_SQL = (
    "WITH o AS (SELECT event_type AS slug, concat('seen as ', CAST(event_id AS VARCHAR)) AS means, CASE WHEN user_id % 10 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS scope, concat('s', CAST(user_id % 7 AS VARCHAR)) AS source, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS recorded FROM events), "
    "r AS (SELECT * FROM (VALUES ('error', 'rejected', ''), ('purchase', 'promoted', 'buy')) AS r(slug, status, promoted_to)), "
    "g AS (SELECT slug, CAST(count(*) AS BIGINT) AS observations, CAST(count(DISTINCT nullif(scope, '')) AS INTEGER) AS independent, CAST(count(DISTINCT source) AS INTEGER) AS n_sources, max_by(means, (recorded, means)) AS means, min(recorded) AS first_seen, max(recorded) AS last_seen FROM o GROUP BY slug), "
    "k AS (SELECT g.*, coalesce(r.status, 'open') AS status, coalesce(r.promoted_to, '') AS promoted_to FROM g LEFT JOIN r ON g.slug = r.slug) "
)


@query(_GAPS_SQL + "SELECT slug, observations, independent, n_sources, means, first_seen, last_seen, status, promoted_to FROM k")
def gap_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gaps.aggregate(_gap_rows(spark, sf_dir), _resolutions(spark))
    return found.select("slug", "observations", "independent", "n_sources", "means", "first_seen", "last_seen", "status", "promoted_to")


@query(
    _GAPS_SQL + ", p AS (SELECT DISTINCT slug, scope FROM o WHERE scope <> ''), q AS (SELECT slug, CAST(count(*) AS INTEGER) AS n_scopes, array_to_string(list(scope ORDER BY scope)[1:5], ',') AS scopes FROM p GROUP BY slug), "
    "t AS (SELECT slug, CAST(count(DISTINCT event_id) AS INTEGER) AS n_items, array_to_string(list(DISTINCT CAST(event_id AS VARCHAR) ORDER BY CAST(event_id AS VARCHAR))[1:5], ',') AS items FROM (SELECT event_type AS slug, event_id FROM events) GROUP BY slug) "
    "SELECT q.slug, n_scopes, scopes, n_items, items FROM q JOIN t ON q.slug = t.slug"
)
def gap_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands behind a gap: everything is counted, the first five are named."""
    named = lambda c: F.array_join(c, ",").alias(c)
    return gaps.evidence(_gap_rows(spark, sf_dir), 5).select("slug", "n_scopes", named("scopes"), "n_items", named("items"))


@query(_GAPS_SQL + "SELECT slug, independent FROM k WHERE status = 'open' AND independent >= 2")
def gap_promotable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.promotable(gaps.aggregate(_gap_rows(spark, sf_dir), _resolutions(spark))).select("slug", "independent")


@query(_GAPS_SQL + "SELECT slug, means, independent AS independent_scopes, promoted_to FROM k WHERE status <> 'rejected' ORDER BY independent DESC, observations DESC, slug LIMIT 200")
def known_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.known_gaps(gaps.aggregate(_gap_rows(spark, sf_dir), _resolutions(spark)), include_promoted=True)


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    claim = F.concat(F.when(F.col("doc_id") % 2 == 0, "not ").otherwise(""), F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, " open").when(F.col("doc_id") % 3 == 1, " closed").otherwise(""))
    return contradictions.claim_features(read(spark, sf_dir, "documents").select(F.col("lang").alias("slot"), F.col("doc_id").alias("key"), claim.alias("claim")).where("slot is not null")).drop("claim")


#: Pairs come from an inverted index of words, which counts what two claims share.
_CLAIMS_SQL = (
    "WITH c AS (SELECT lang AS slot, doc_id AS key, list_filter(regexp_split_to_array(lower(concat(CASE WHEN doc_id % 2 = 0 THEN 'not ' ELSE '' END, coalesce(text, ''), CASE doc_id % 3 WHEN 0 THEN ' open' WHEN 1 THEN ' closed' ELSE '' END)), '[^a-z0-9]+'), lambda t: t <> '') AS toks FROM documents WHERE lang IS NOT NULL), "
    f"f AS (SELECT slot, key, list_filter(list_distinct(toks), lambda t: length(t) > 1 AND t NOT IN ({_IN(L.CLAIM_STOP_WORDS)})) AS words, len(list_filter(toks, lambda t: t IN ({_IN(L.NEGATORS)}))) > 0 AS neg FROM c), "
    "w AS (SELECT slot, key, len(words) AS n, neg, unnest(words) AS word FROM f), "
    "p AS (SELECT a.slot, a.key AS left_key, b.key AS right_key, any_value(a.n) AS na, any_value(b.n) AS nb, any_value(a.neg) AS nega, any_value(b.neg) AS negb, count(*) AS common FROM w a JOIN w b ON a.slot = b.slot AND a.word = b.word AND a.key < b.key AND least(a.n, b.n) >= 0.35 * greatest(a.n, b.n) - 0.000001 GROUP BY a.slot, a.key, b.key), "
    f"o AS (SELECT *, common / CAST(na + nb - common AS DOUBLE) AS overlap FROM p WHERE common / CAST(na + nb - common AS DOUBLE) >= {L.OVERLAP_FLOOR}), "
    f"ant AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{x}{chr(39)}, {chr(39)}{y}{chr(39)})' for a, b in L.ANTONYMS for x, y in ((a, b), (b, a)))}) AS t(word, other)), "
    "h AS (SELECT DISTINCT o.slot, o.left_key, o.right_key FROM o JOIN f a ON o.slot = a.slot AND o.left_key = a.key JOIN f b ON o.slot = b.slot AND o.right_key = b.key JOIN ant ON list_contains(a.words, ant.word) AND NOT list_contains(b.words, ant.word) AND list_contains(b.words, ant.other)) "
)


@query(_CLAIMS_SQL + "SELECT o.slot, o.left_key, o.right_key, round(o.overlap, 6) AS overlap, CASE WHEN nega <> negb THEN 'negation_mismatch' ELSE 'antonym_pair' END AS detector FROM o LEFT JOIN h ON o.slot = h.slot AND o.left_key = h.left_key AND o.right_key = h.right_key WHERE nega <> negb OR h.left_key IS NOT NULL")
def contradiction_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contradictions.scan(_claims(spark, sf_dir), ("slot",))
    return found.select("slot", F.col("key_a").alias("left_key"), F.col("key_b").alias("right_key"), F.round("overlap", 6).alias("overlap"), "detector")


@query(
    "WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN (" + _IN(L.CLAIM_STOP_WORDS) + "))) AS w FROM conversations) "
    "SELECT a.conv_id, a.turn, round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(list_concat(a.w, b.w))) AS DOUBLE) END, 6) AS overlap FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"
)
def claim_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = contradictions.claim_features(read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text").select("conv_id", "turn", "words")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("words").alias("after"))
    return turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(X.overlap(F.col("words"), F.col("after")), 6).alias("overlap"))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("snap"), "lang")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("snap").alias("next"))
    pairs = docs.join(after, "doc_id").select(X.pair_key(F.concat(F.lit("document:"), F.col("doc_id").cast("string")), F.concat(F.lit("document:"), (F.col("doc_id") + 1).cast("string")), F.col("lang")).alias("pair_key"), F.col("snap").alias("left_snapshot"), F.col("next").alias("right_snapshot"), "doc_id")
    stored = pairs.where("doc_id % 3 <> 0").withColumn("state", F.when(F.col("doc_id") % 4 == 0, "resolved").otherwise("active")).withColumn("left_snapshot", F.when(F.col("doc_id") % 5 == 0, "changed").otherwise(F.col("left_snapshot")))
    return pairs.where("doc_id % 7 <> 0"), stored


_PAIRS_SQL = "WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS snap, lang FROM documents), p AS (SELECT a.doc_id, concat(least(concat('document:', CAST(a.doc_id AS VARCHAR)), concat('document:', CAST(a.doc_id + 1 AS VARCHAR))), '|', greatest(concat('document:', CAST(a.doc_id AS VARCHAR)), concat('document:', CAST(a.doc_id + 1 AS VARCHAR))), '|', coalesce(a.lang, '')) AS pair_key FROM d a JOIN d b ON b.doc_id = a.doc_id + 1) "


@query(_PAIRS_SQL + "SELECT pair_key FROM p WHERE doc_id % 7 <> 0")
def declared_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshots(spark, sf_dir)[0].select("pair_key")


@query(
    _PAIRS_SQL + "SELECT pair_key, CASE WHEN doc_id % 7 = 0 THEN 'resolve' WHEN doc_id % 3 = 0 THEN 'upsert' WHEN doc_id % 4 = 0 THEN 'reactivate' ELSE 'upsert' END AS change FROM p "
    "WHERE CASE WHEN doc_id % 7 = 0 THEN doc_id % 3 <> 0 AND doc_id % 4 <> 0 ELSE doc_id % 3 = 0 OR doc_id % 4 = 0 OR doc_id % 5 = 0 END"
)
def ledger_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contradictions.ledger_changes(*_snapshots(spark, sf_dir))


#: Entries of a log; runs in it.
_ENTRIES, _RUN = 40, 10


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as logs of forty entries, each a true chain of hashes."""
    payload = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props")
    entries = read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / _ENTRIES).alias("log"), F.struct(F.col("event_id").alias("line"), payload.alias("payload")).alias("e"))
    logs = entries.groupBy("log").agg(F.array_sort(F.collect_list("e")).alias("entries"))  # forty at most
    hashes = F.aggregate("entries", F.array(F.lit(L.GENESIS)), lambda known, e: F.concat(known, F.array(audit_chain.chain_hash(F.element_at(known, -1), e["payload"]))))
    rows = logs.withColumn("hashes", hashes).select("log", "hashes", F.posexplode("entries").alias("pos", "e"))
    run = F.concat(F.lit("run-"), F.floor(F.col("e.line") / _RUN).cast("string"))
    return rows.select("log", "e.line", "e.payload", F.col("hashes")[F.col("pos")].alias("prev_hash"), F.col("hashes")[F.col("pos") + 1].alias("hash"), run.alias("run_id"))


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after damage: some lines are gone, some contents edited, some unreadable.  Most logs are intact."""
    line = F.col("line")
    altered = F.when(line % 1499 == 300, F.lit(None).cast("string")).when(line % 997 == 500, F.concat("payload", F.lit("!"))).otherwise(F.col("payload"))
    return _chains(spark, sf_dir).where(line % 1103 != 7).withColumn("payload", altered)


_CHAINS_SQL = (
    f"WITH l AS (SELECT event_id // {_ENTRIES} AS log, list(event_id ORDER BY event_id) AS ids, list(concat_ws('|', CAST(event_id AS VARCHAR), event_type, props) ORDER BY event_id) AS payloads FROM events GROUP BY 1), "
    "h AS (SELECT log, ids, list_reduce(list_prepend([repeat('0', 64)], list_transform(payloads, lambda p: [p])), lambda known, x: list_append(known, sha256(concat(known[-1], x[1])))) AS hashes FROM l), "
    "c AS (SELECT log, ids[i] AS line, hashes[i + 1] AS hash FROM (SELECT *, unnest(generate_series(1, len(ids))) AS i FROM h)) "
)
_BREAKS_SQL = (
    f"WITH d AS (SELECT event_id AS line, event_id // {_ENTRIES} AS log, event_id // {_RUN} AS run FROM events WHERE event_id % 1103 <> 7), "
    f"b AS (SELECT log, line, CASE WHEN line % 1499 = 300 THEN '{audit_chain.UNREADABLE}' WHEN (line - 1) % 1103 = 7 AND (line - 1) // {_ENTRIES} = log THEN '{audit_chain.DETACHED}' WHEN line % 997 = 500 THEN '{audit_chain.ALTERED}' END AS reason FROM d), "
    f"v AS (SELECT d.log, f.line AS broken_at, f.reason, count(*) FILTER (WHERE f.line IS NULL OR d.line < f.line) AS entries FROM d LEFT JOIN (SELECT log, min(line) AS line, arg_min(reason, line) AS reason FROM b WHERE reason IS NOT NULL GROUP BY log) f ON d.log = f.log GROUP BY d.log, f.line, f.reason) "
)


@query(_CHAINS_SQL + "SELECT line AS event_id, hash FROM c")
def audit_row_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chains(spark, sf_dir).select(F.col("line").alias("event_id"), audit_chain.chain_hash(F.col("prev_hash"), F.col("payload")).alias("hash"))


@query(_BREAKS_SQL + "SELECT log, line, reason FROM b WHERE reason IS NOT NULL")
def audit_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_chain.breaks(_logs(spark, sf_dir), chain_cols=("log",))


@query(_BREAKS_SQL + f"SELECT log, broken_at IS NULL AS ok, CAST(entries AS BIGINT) AS entries, broken_at, coalesce(reason, '{audit_chain.INTACT}') AS reason FROM v")
def audit_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_chain.verify(_logs(spark, sf_dir), ("log",))


@query(_CHAINS_SQL + "SELECT log, arg_max(hash, line) AS head FROM c WHERE line % 1103 <> 7 AND line % 1499 <> 300 GROUP BY log")
def audit_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_chain.last_hash(_logs(spark, sf_dir), ("log",))


#: Logs that the events are streamed into, and the micro-batches that they come in.
_STREAMED, _BATCHES = 5, 3


@query(
    f"WITH l AS (SELECT user_id % {_STREAMED} AS log, count(*) AS n, list(concat_ws('|', CAST(event_id AS VARCHAR), event_type, props) ORDER BY event_id) AS payloads FROM events GROUP BY 1) "
    "SELECT log, CAST(n AS BIGINT) AS entries, true AS ok, list_reduce(list_prepend(repeat('0', 64), payloads), lambda h, p: sha256(concat(h, p))) AS head FROM l"
)
def audit_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events streamed into a few long logs over several micro-batches; each log's head, and whether its chain holds."""
    where = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    payload = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props")
    entries = read(spark, sf_dir, "events").select((F.col("user_id") % _STREAMED).cast("bigint").alias("log"), F.col("event_id").cast("bigint").alias("line"), payload.alias("payload"))
    most = entries.agg(F.max("line")).first()[0] or 0
    for i in range(_BATCHES):  # files in the order of their lines
        step = most // _BATCHES + 1
        entries.where(F.col("line").between(i * step, (i + 1) * step - 1)).coalesce(1).write.mode("append").parquet(f"{where}/in")
    stream = chains.chained(spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in"))
    stream.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    logs = spark.read.parquet(f"{where}/out")
    held = audit_chain.verify(logs, ("log",)).join(audit_chain.last_hash(logs, ("log",)), "log")
    return held.select("log", "entries", "ok", "head")


@query(f"SELECT concat('run-', CAST(event_id // {_RUN} AS VARCHAR)) AS run_id, min(event_id) AS line FROM events WHERE event_id % 1103 <> 7 GROUP BY 1")
def audit_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_chain.run_index(_logs(spark, sf_dir).select("run_id", "line"))


def _integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    nodes = read(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 13 == 0, "").otherwise(F.concat(F.lit("run-"), (key % 1300).cast("string"))).alias("run_id"), F.when(key % 17 == 0, "retired").when(key % 2 == 0, "active").otherwise("unmapped").alias("status"))
    return audit_chain.integrity_report(nodes, _logs(spark, sf_dir), ("log",))


_INTEGRITY_SQL = (
    _BREAKS_SQL + ", x AS (SELECT run, min(line) AS line, any_value(log) AS log FROM d GROUP BY run), "
    "n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 1300 END AS run, o_orderkey % 17 = 0 AS retired FROM orders), "
    "s AS (SELECT n.o_orderkey, CASE WHEN retired THEN 'invalidated' WHEN x.line IS NULL THEN 'unverified' WHEN v.broken_at IS NULL THEN 'verified' WHEN v.broken_at <= x.line THEN 'invalidated' ELSE 'unverified' END AS state FROM n LEFT JOIN x ON n.run = x.run LEFT JOIN v ON x.log = v.log) "
)


@query(_INTEGRITY_SQL + "SELECT o_orderkey, state FROM s")
def integrity_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _integrity(spark, sf_dir).select("o_orderkey", "state")


@query(_INTEGRITY_SQL + "SELECT o_orderkey, CAST(CASE state WHEN 'verified' THEN 0 WHEN 'unverified' THEN 4 ELSE 5 END AS INTEGER) AS exit_code FROM s")
def explain_exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _integrity(spark, sf_dir).select("o_orderkey", audit_chain.exit_code(F.col("state")).alias("exit_code"))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on events: their terms, and a block on each thirty-first."""
    how = F.col("how")
    terms = _resolved(spark, sf_dir).withColumn("id", X.composite_id(F.lit("event"), F.col("event_id").cast("string"))).withColumn("pos", F.col("event_id").cast("int"))
    a = checks.found(terms.where("how <> 'exact'"), "vocab_membership", F.when(how == "unknown", L.BLOCK).when(how == "deprecated", L.REQUIRE_APPROVAL).otherwise(L.ALLOW), F.lit("term"), "warn", F.when(how == "deprecated", checks.data_of(field=F.lit("event_type"), old=F.col("event_type"), new=F.col("canonical"))).otherwise(F.create_map().cast("map<string,string>")))
    b = checks.found(terms.where("event_id % 31 = 0"), "required_fields", L.BLOCK, F.lit("missing"))
    c = checks.found(terms.where("event_id % 4 = 0"), "collision", F.when(F.col("event_id") % 8 == 0, L.ALLOW).otherwise(L.REQUIRE_APPROVAL), F.lit("exists"), "info", checks.data_of(action=F.when(F.col("event_id") % 8 == 0, "identical").otherwise("conflict")))
    return a.unionByName(b).unionByName(c)


def _event_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    items = read(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("event_id").cast("string").alias("key"), X.composite_id(F.lit("event"), F.col("event_id").cast("string")).alias("id"), F.when(F.col("event_id") % 10 == 0, "unmapped").otherwise("node").alias("section"), "event_id")
    return items.drop("event_id"), items.where("event_id % 4 = 0").select("kind", "key"), items.where("event_id % 3 = 0").select("id")


_VERDICT_SQL = "CASE WHEN event_id % 31 = 0 THEN 2 WHEN event_type = 'error' OR event_id % 8 = 4 THEN 1 ELSE 0 END"
_ACTION_SQL = (
    "WITH f AS (SELECT event_id, event_type, " + _VERDICT_SQL + " AS verdict, CASE WHEN event_id % 8 = 0 THEN 'identical' WHEN event_id % 8 = 4 THEN 'conflict' END AS hint, event_id % 3 = 0 AS approved FROM events), "
    "a AS (SELECT concat('event:', CAST(event_id AS VARCHAR)) AS id, verdict, approved, CASE WHEN verdict >= 2 THEN 'blocked' WHEN verdict = 1 AND NOT approved THEN 'held' WHEN verdict = 1 AND hint = 'conflict' THEN 'supersede' WHEN verdict = 1 AND event_id % 4 = 0 THEN 'unchanged' WHEN verdict = 1 THEN 'create' WHEN hint = 'identical' THEN 'unchanged' WHEN event_id % 10 = 0 THEN 'create_unmapped' WHEN event_id % 4 = 0 THEN 'unchanged' ELSE 'create' END AS action FROM f) "
)


@query("SELECT concat('event:', CAST(event_id AS VARCHAR)) AS target, CAST(" + _VERDICT_SQL + " AS INTEGER) AS verdict FROM events WHERE event_id % 31 = 0 OR event_id % 4 = 0 OR event_type IN ('error', 'signup')")
def verdict_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.worst_verdicts(_findings(spark, sf_dir))


def _run_findings(spark: SparkSession, sf_dir: str, date: str) -> DataFrame:
    run = checks.Batch(spark, Contract("shared", {}), None, None, date=date)
    return _findings(spark, sf_dir).unionByName(checks.date_format(run))


@query("SELECT 2 AS floor, false AS halts, 'the date must be YYYY-MM-DD, not ''2024-02-30''' AS why")
def run_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.run_floor(_run_findings(spark, sf_dir, "2024-02-30"))


@query("SELECT 0 AS floor, false AS halts, '' AS why")
def run_floor_of_a_good_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.run_floor(_run_findings(spark, sf_dir, "2024-2-9"))


@query("SELECT 0 AS floor, count(*) > 0 AS halts, '' AS why FROM events WHERE event_type = 'error'")
def run_halts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item that halts stops the run."""
    halting = checks.found(read(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").cast("string").alias("id"), F.col("event_id").cast("int").alias("pos")), "key_present", L.HALT, F.lit("halts"))
    return verdicts.run_floor(_findings(spark, sf_dir).unionByName(halting))


@query("SELECT concat('event:', CAST(event_id AS VARCHAR)) AS id, 2 AS verdict, 'blocked' AS action, CASE WHEN event_id % 31 = 0 THEN 'failed a blocking check' ELSE 'blocked by a run-level check: the date must be YYYY-MM-DD, not ''2024-02-30''' END AS detail FROM events")
def run_floor_blocks_every_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, existing, approvals = _event_items(spark, sf_dir)
    return verdicts.resolve_actions(items, _run_findings(spark, sf_dir, "2024-02-30"), existing, approvals).select("id", "verdict", "action", "detail")


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, existing, approvals = _event_items(spark, sf_dir)
    return verdicts.resolve_actions(items, _findings(spark, sf_dir), existing, approvals)


@query(_ACTION_SQL + "SELECT id, CAST(verdict AS INTEGER) AS verdict, approved, action FROM a")
def resolve_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plans(spark, sf_dir).select("id", "verdict", "approved", "action")


@query(_ACTION_SQL.replace("SELECT concat('event:'", "SELECT event_type, concat('event:'") + "SELECT id, 'failure' AS to_term, concat('approved: ', action, ' [deprecated term rewritten]') AS detail FROM a WHERE verdict = 1 AND approved AND action <> 'unchanged' AND event_type = 'error'")
def deferred_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plans(spark, sf_dir).where("renames is not null").select("id", F.col("renames")["event_type"].alias("to_term"), "detail")


@query(_ACTION_SQL + "SELECT " + ", ".join(f"CAST(count(*) FILTER (WHERE action = '{a}') AS BIGINT) AS {n}" for a, n in (("create", "created"), ("supersede", "superseded"), ("create_unmapped", "unmapped"), ("unchanged", "unchanged"), ("held", "held"), ("blocked", "blocked"))) + " FROM a")
def apply_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.action_counts(_plans(spark, sf_dir))


@query("SELECT doc_id, concat('lang=', coalesce(lang, ''), '&source=', coalesce(source, '')) AS slot FROM documents")
def slot_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", X.slot_value(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")), X.strings(["lang", "source"])).alias("slot"))


@query("SELECT page_id, concat('page:', url) AS id, 'page' AS kind, url AS key FROM pages")
def composite_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", X.composite_id(F.lit("page"), F.col("url")).alias("id"))
    return pages.select("page_id", "id", X.id_kind(F.col("id")).alias("kind"), X.id_key(F.col("id")).alias("key"))


@query("SELECT event_id, sha256(props) AS content_hash FROM events")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", batches.content_digest(F.col("props")).alias("content_hash"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>")["k"].cast("bigint").alias("k"))


@query("SELECT event_id, strftime(ts, '%Y-%-m-%-d') AS date, event_id % 3 <> 0 AS good FROM events")
def date_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format("ts", "y-M-d")
    rows = read(spark, sf_dir, "events").select("event_id", text.alias("date"), F.when(F.col("event_id") % 3 == 0, F.concat(text, F.lit("T00"))).otherwise(text).alias("given"))
    return rows.select("event_id", "date", checks.is_date(F.col("given")).alias("good"))


def queries() -> dict[str, Query]:
    from lorekeep import registry_batch, registry_graph  # noqa: F401  they register theirs here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: controlled terms of all events, findings, verdicts, and what becomes of each event."""
    return resolve_actions(spark, sf_dir)
