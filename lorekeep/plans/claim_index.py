"""The ledger of contradictions, kept up with each commit by an inverted index of claims.

The store keeps a row of every node's claim (``claims``), the rarer words of each claim inverted (``claim_postings``, in folders by
bucket of kind and slot), the order of words that these go by (``claim_words``) and who names whom as contradicting
(``claim_links``).  A commit turns its own nodes into claims, meets the postings of their slots alone, looks up the
claims it has met by key, compares them by classes of the same words, and folds what it finds about its own nodes into their rows of the ledger.

The order of words is that of the last building.  Any one order gives the same pairs, an old one only longer lists, so everything is
built anew when the claims have doubled since, or when the contract reads claims from other fields.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text as X
from lorekeep.functions.lexicon import OVERLAP_FLOOR
from lorekeep.operators import contradictions, packs
from lorekeep.operators.similarity import rare_first
from lorekeep.sources.store import INDEX, REPLACED_NODES, Store

BUCKETS = 16
#: So many slots are named in the scan of the postings; more are told by their buckets, and by a join.
NAMED_SLOTS = 200
#: Claims, beyond twice those of the last building, that the order of words may not know.
SLACK = 10_000
TABLES = tuple(INDEX)


@dataclass
class Folded:
    """What a commit adds to the store besides its nodes, and how many rows of the ledger changed in which way."""

    tables: dict[str, DataFrame]
    counts: dict[str, int]
    notes: dict
    renewed: tuple[str, ...] = ()


def bucket(kind: Column | str = "kind", slot: Column | str = "slot") -> Column:
    return F.pmod(F.xxhash64(kind, slot), F.lit(BUCKETS)).cast("int")


def claims_of(nodes: DataFrame, kinds: DataFrame) -> DataFrame:
    """The rows of ``claims``: one a node, with words where the node can be compared with others of its slot."""
    rows = contradictions.with_sources(contradictions.node_claims(nodes, kinds)).withColumn("lexical", contradictions.comparable())
    told = contradictions.with_marks(contradictions.claim_features(rows.withColumn("__claim", F.when(F.col("lexical"), F.col("claim"))), "__claim"))
    named = F.filter(F.coalesce(X.as_list(F.col("fields")["contradicts"]), X.strings([]).cast("array<string>")), lambda x: x != F.col("id"))
    return told.withColumn("contradicts", named).select(*[x.split(" ")[0] for x in INDEX["claims"].split(", ")])


def postings_of(claims: DataFrame, order: DataFrame) -> DataFrame:
    worded = claims.where("lexical and size(words) > 0").drop("bucket")
    found = rare_first(worded, ["kind", "slot"], "codes", ["scope", "key", "revision", *contradictions.MARKS], OVERLAP_FLOOR, order=order)
    return found.withColumn("bucket", bucket()).select(*[x.split(" ")[0] for x in INDEX["claim_postings"].split(", ")])


def links_of(claims: DataFrame) -> DataFrame:
    return claims.select("scope", F.explode("contradicts").alias("target"), "kind", "key", "revision").distinct()


def words_of(claims: DataFrame) -> DataFrame:
    """How many claims of a slot hold each word; what one alone holds is as rare as what nobody has seen."""
    return claims.where("lexical").select("kind", "slot", F.explode("codes").alias("item")).groupBy("kind", "slot", "item").agg(F.count("*").alias("held")).where("held > 1")


def fingerprint(kinds: DataFrame) -> str:
    """Of what the contract says about claims (a contract's size)."""
    rows = sorted((r["kind"], r["claim_field"] or "", list(r["claim_slot"] or [])) for r in kinds.select("kind", "claim_field", "claim_slot").collect())
    return hashlib.sha256(json.dumps(rows).encode()).hexdigest()


def slots_met(store: Store, base: dict, claims: DataFrame, scope: str | None) -> DataFrame:
    """The stored postings of the slots of ``claims``, and no others."""
    slots = claims.where("lexical").select("kind", "slot").distinct()
    some = slots.limit(NAMED_SLOTS + 1).collect()
    buckets = [r[0] for r in slots.select(bucket()).distinct().collect()]  # BUCKETS at most
    if not some:
        return store.spark.createDataFrame([], INDEX["claim_postings"])
    where = F.col("bucket").isin(buckets)
    if len(some) <= NAMED_SLOTS:
        where = where & F.col("slot").isin(sorted({r["slot"] for r in some})) & F.col("kind").isin(sorted({r["kind"] for r in some}))
    return store.read("claim_postings", base, scope, where).join(slots, ["kind", "slot"], "left_semi")


def delta(store: Store, base: dict, new: DataFrame, postings: DataFrame, scope: str | None, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every observation that concerns one of the claims ``new`` (a table), whose postings are ``postings`` (a table).

    Postings only say which stored claims share a rarer word with a new one that they can oppose.  Those are looked up, and claims are then
    compared by classes, as in ``contradictions.scan``: what is stored on the way grows with claims, not with their pairs."""
    node, on = ["scope", "kind", "key"], ["kind", "slot", "item"]
    own = new.select(*node)
    met = slots_met(store, base, new, scope).join(own, node, "left_anti")
    asked = postings.select(*[F.col(c).alias(f"{c}_new") for c in (*on, *contradictions.MARKS)]).distinct()
    shared = [F.col(c) == F.col(f"{c}_new") for c in on]
    opposed = (F.col("denied") != F.col("denied_new")) | (F.col("has").bitwiseAND(F.col("wants_new")) != 0)
    wanted = met.join(asked, [*shared, opposed], "left_semi").select("kind", "key")
    named = new.select(F.explode("contradicts").alias("id"))
    namers = store.lookup_many("claim_links", new.select(F.col("id").alias("target")), scope, base)
    others = named.select(X.id_kind(F.col("id")).alias("kind"), X.id_key(F.col("id")).alias("key")).unionByName(namers.select("kind", "key"))
    keys = keep(wanted.unionByName(others).distinct())
    stored = store.lookup_many("claims", keys, scope, base).join(own, node, "left_anti")
    claims = keep(new.select(*stored.columns, F.lit(True).alias("own")).unionByName(stored.withColumn("own", F.lit(False))))
    return contradictions.of_claims(claims, either="own")


def fold(store: Store, base: dict, changed: DataFrame, kinds: DataFrame, partition: str, scoped: bool, run_id: str, now: str, keep: Callable[[DataFrame], DataFrame]) -> Folded:
    """What follows from the nodes that a commit to ``base`` writes: the index's own rows, and the ledger's.  The tables stand
    as long as ``keep`` keeps them."""
    scope = partition if scoped else None
    kinds_now, notes = fingerprint(kinds), base.get("notes", {})
    new = keep(claims_of(changed.withColumn("fields", F.from_json("props", "map<string,string>")), kinds))
    size = new.agg(F.count("*").alias("rows"), F.count_if("lexical").alias("lexical"), F.count_if(F.size("contradicts") > 0).alias("stating")).first()
    held = sum(x["rows"] for x in base["tables"].get("claims", [])) + size["rows"]
    whole = notes.get("claim_kinds") != kinds_now or held > 2 * notes.get("claims_built", 0) + SLACK
    if not whole and not size["lexical"] and not size["stating"] and not base["tables"].get("claim_links") and not base["tables"].get("contradictions"):
        return Folded({"claims": new}, {}, {})  # nothing to compare, nothing said of these nodes before
    if whole:
        key = ["scope", "kind", "key"]
        before = store.read("nodes", base).join(changed.select(*key), key, "left_anti")
        claims = keep(claims_of(before.withColumn("fields", F.from_json("props", "map<string,string>")), kinds).unionByName(new))
        order = keep(words_of(claims))
        seen = claims if scope is None else claims.where(F.col("scope") == scope)
        found = contradictions.of_claims(seen)
        tables = {"claims": claims, "claim_postings": postings_of(claims, order), "claim_words": order, "claim_links": links_of(claims)}
        notes, renewed = {"claim_kinds": kinds_now, "claims_built": claims.count()}, TABLES
    else:
        slots = new.where("lexical").select("kind", "slot").distinct()
        order = store.lookup_many("claim_words", slots, None, base)
        postings = keep(postings_of(new, order))
        found = delta(store, base, new, postings, scope, keep)
        tables, notes, renewed = {"claims": new, "claim_postings": postings, "claim_links": links_of(new)}, {}, ()
    # Pairs are as many as nothing else here: what is found is made of classes wherever it is read, and met with the ledger only where that names the commit's nodes.
    ledger, ids = store.read("contradictions", base, partition).where(F.col("scope") == partition), new.select(F.lit(partition).alias("scope"), "id")
    own = ledger if whole else contradictions.naming(ledger, ids, size["rows"])
    if own.isEmpty():
        rows = contradictions.begun(found, partition, run_id, now)
        counts = {change: n for change, n in {"upsert": rows.count()}.items() if n}
        tables[REPLACED_NODES] = None
    else:
        rows = contradictions.reconciled(found, own, partition, run_id, now)
        rows, counts = packs.held(rows.where("change is not null") if whole else rows, "pair_key", keep, "change")
        tables |= {} if whole else {REPLACED_NODES: ids}
    if counts:
        tables["contradictions"] = rows.drop("change")
    return Folded(tables, counts, notes, renewed)
