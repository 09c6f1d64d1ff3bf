"""Competing claims: the pair scan, declared contradictions, and the ledger."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text as X
from lorekeep.functions.lexicon import OVERLAP_FLOOR
from lorekeep.lineage import cut, kept_until_done
from lorekeep.operators import cells, crowds, packs
from lorekeep.operators.crowds import MARKS
from lorekeep.operators.similarity import may_reach, rare_first

OBSERVATION = "pair_key string, left_id string, right_id string, slot string, detector string, left_snapshot string, right_snapshot string, left_owner string, right_owner string, left_source string, right_source string, left_run_id string, right_run_id string, overlap double"
LEDGER = f"scope string, {OBSERVATION}, state string, detected_run_id string, detected_ts string, resolved_ts string, resolution string"


def codes_of(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def claim_features(claims: DataFrame, text_col: str = "claim") -> DataFrame:
    """``claims`` with content words, their hashes and the number of negations, worked out once a row, before any join."""
    return claims.withColumn("__tokens", X.claim_tokens(F.col(text_col))).withColumn("words", X.content_tokens(F.col("__tokens"))).withColumn("codes", codes_of("words")).withColumn("negated", X.negations(F.col("__tokens"))).drop("__tokens")


def with_marks(claims: DataFrame) -> DataFrame:
    return claims.withColumns({"denied": F.col("negated") > 0, "has": X.antonym_bits(F.col("words")), "wants": X.antonym_bits(F.col("words"), partners=True)})


def opposed_pairs(one: DataFrame, other: DataFrame, by: list[str], key_col: str) -> DataFrame:
    """Pairs of rows (``row_a``, ``row_b``, the smaller row first) of two sets of postings that may overlap enough and can oppose
    each other.  Postings: ``by, item, key_col, row, n, pos`` and marks; only those are shuffled."""
    told = dict.fromkeys(("row", key_col, "n", "pos", *MARKS))
    sides = [rows.select(*by, "item", *[F.col(c).alias(f"{c}_{n}") for c in told]) for rows, n in ((one, "a"), (other, "b"))]
    opposed = (F.col("denied_a") != F.col("denied_b")) | (F.col("has_a").bitwiseAND(F.col("wants_b")) != 0)
    met = sides[0].join(sides[1], [*by, "item"]).where((F.col(f"{key_col}_a") != F.col(f"{key_col}_b")) & opposed & may_reach(OVERLAP_FLOOR))
    return met.select(F.least("row_a", "row_b").alias("row_a"), F.greatest("row_a", "row_b").alias("row_b")).distinct()


def opposing(near: DataFrame, claims: DataFrame, by: list[str], key_col: str) -> DataFrame:
    """``near`` (``row_a, row_b, overlap``) with both claims' columns, the smaller key left, ``hit`` and ``detector``: those that do disagree."""
    rest = [c for c in claims.columns if c not in (*by, "codes", "row", "n", *MARKS)]
    for n in ("a", "b"):
        near = near.join(claims.select(F.col("row").alias(f"row_{n}"), *([] if n == "b" else by), *[F.col(c).alias(f"{c}_{n}") for c in rest]), f"row_{n}")
    turned = F.col(f"{key_col}_a") > F.col(f"{key_col}_b")
    sides = [F.when(turned, F.col(f"{c}_{m}")).otherwise(F.col(f"{c}_{n}")).alias(f"{c}_{n}") for n, m in (("a", "b"), ("b", "a")) for c in rest]
    scored = near.select(*by, "overlap", *sides).withColumn("hit", X.antonym_hit(F.col("words_a"), F.col("words_b")))
    return scored.withColumn("detector", X.detector(F.col("overlap"), F.col("negated_a"), F.col("negated_b"), F.col("hit"))).where("detector is not null")


#: Members of a class that come in one row; classes that make a slot crowded.
AT_ONCE, CROWD = 1024, 1000
#: Pairs of claims of a slot that one task writes out.
TASK_PAIRS = 1_000_000


def class_key(by: list[str]) -> Column:
    """Claims of one slot with the same words, both denied or neither, are a class: each disagrees with what the others disagree with, and
    with none of them."""
    return F.unhex(F.md5(F.to_json(F.struct(*by, (F.col("negated") > 0).alias("denied"), F.sort_array("words").alias("words")))))


def scan(claims: DataFrame, slot_cols: tuple[str, ...] = ("kind", "slot"), key_col: str = "key", together: bool = False, either: str | None = None) -> DataFrame:
    """Pairs of one slot (left key smaller) whose texts disagree: ``detector``, ``overlap``, ``hit`` and both claims' other columns.

    ``claims`` comes from ``claim_features``; a key comes once in its slot.  Claims of the same words are one class, and classes
    are compared.  Those that overlap enough share one of their rarer words, so their numbers meet there, and only where
    one of two is negated or they hold antonyms; in slots of ``CROWD`` classes and more they meet by ``crowds`` instead.  The pairs
    that the filters leave are compared by cells, to each of which a class's words go once.  Pairs of claims are written out of
    pairs of classes last, and are neither shuffled nor stored here, so that disk grows with claims and classes alone.
    With ``together`` the pairs of a slot come out of one task, as far as they are no more than ``TASK_PAIRS``.  With ``either`` one of the two
    must have that flag, which tells classes apart, so that pairs of classes without it never meet.
    """
    by, spark, flag = list(slot_cols), claims.sparkSession, [either] if either else []
    rest = [c for c in claims.columns if c not in (*by, *flag, "words", "codes", "negated")]
    worded = claims.where(F.size("words") > 0).dropna(subset=by).withColumn("class", class_key([*by, *flag]))
    with kept_until_done(spark) as keep:
        # Texts are taken to words once; from here on a claim is its words' codes, and of the words those that have antonyms.
        worded = keep(with_marks(worded.withColumn("codes", codes_of("words"))).withColumn("said", X.antonym_words(F.col("words"))).select(*by, "class", "codes", "said", *MARKS, *flag, *rest))
        told = worded.groupBy(*by, "class").agg(*[F.first(c).alias(c) for c in ("codes", "said", *MARKS)], F.count("*").alias("members"), *[F.first(c).cast("long").alias("flag") for c in flag])
        number = F.monotonically_increasing_id()
        classes = keep(told.withColumn("row", 2 * number + F.col("flag") if flag else number))  # odd rows have the flag
        crowded = F.broadcast(classes.groupBy(*by).count().where(F.col("count") >= CROWD).select(*by))  # by ``CROWD`` fewer than classes
        postings = keep(rare_first(classes.join(crowded, by, "left_anti"), by, "codes", ["row", *MARKS], OVERLAP_FLOOR))
        pairs = opposed_pairs(postings.where("row % 2 = 1" if flag else "denied or has <> 0"), postings, by, "row")
        met = crowds.pairs(classes.join(crowded, by, "left_semi"), by, OVERLAP_FLOOR)
        pairs = keep(pairs.unionByName(met.where("row_a % 2 = 1 or row_b % 2 = 1") if flag else met))
        near = cells.similar(pairs, classes, OVERLAP_FLOOR)
        for n in ("a", "b"):
            near = near.join(classes.select(*(by if n == "a" else []), *[F.col(c).alias(f"{c}_{n}") for c in ("row", "class", "said", "denied", "members")]), f"row_{n}")
        judged = near.select(
            *by, "overlap", *[F.col(f"{c}_{n}") for c in ("class", "members") for n in ("a", "b")], (F.col("denied_a") != F.col("denied_b")).alias("mismatch"),
            X.antonym_hit(F.col("said_a"), F.col("said_b")).alias("hit_ab"), X.antonym_hit(F.col("said_b"), F.col("said_a")).alias("hit_ba"),
        )
        judged = cut(judged.where("mismatch or hit_ab is not null or hit_ba is not null"))
        held = worded.join(classes.select("class", "members"), "class").withColumn("part", F.pmod(F.xxhash64(key_col, F.lit(1)), parts("members")))
        lists = held.groupBy("class", "part").agg(F.collect_list(F.struct(*rest)).alias("all"))
        lists = cut(lists.select("class", "part", F.size("all").alias("size"), *[F.col("all")[c].alias(c) for c in rest]))
    return written_out(judged, lists, by, rest, key_col, together)


def parts(members: str) -> Column:
    return F.ceil(F.col(members) / F.lit(AT_ONCE))


def written_out(judged: DataFrame, lists: DataFrame, by: list[str], rest: list[str], key_col: str, together: bool = False) -> DataFrame:
    """The pairs of claims that pairs of classes stand for.  ``lists`` has the members of a class in parts, a column's values in an array; arrays
    that nobody reads are pruned."""
    most = judged.agg(F.sum(F.col("members_a") * F.col("members_b"))).first()[0] or 0
    met = judged
    for n in ("a", "b"):
        part = F.explode(F.sequence(F.lit(0).cast("bigint"), parts(f"members_{n}") - 1)).alias(f"part_{n}")
        met = met.select("*", part).repartition(max(1, min(2000, most // 1_000_000 + 1)), f"class_{n}", f"part_{n}")
        met = met.join(lists.select(*[F.col(c).alias(f"{c}_{n}") for c in ("class", "part", "size", *rest)]), [f"class_{n}", f"part_{n}"])
    if together:
        held = F.col("members_a") * F.col("members_b")
        large = judged.groupBy(*by).agg(F.ceil(F.sum(held) / TASK_PAIRS).alias("tasks")).where("tasks > 1")  # no more than pairs / TASK_PAIRS
        met = met.join(F.broadcast(large), by, "left").withColumn("deal", F.pmod(F.xxhash64("class_a", "class_b", "part_a", "part_b"), F.coalesce("tasks", F.lit(1))))
        met = met.repartition(int(max(1, min(2000, most // (TASK_PAIRS // 4) + 1))), *by, "deal")
    for n in ("a", "b"):
        met = met.select("*", F.explode(F.sequence(F.lit(0), F.col(f"size_{n}") - 1)).alias(f"at_{n}"))
    of = lambda c, n: F.get(F.col(f"{c}_{n}"), F.col(f"at_{n}"))
    turned = of(key_col, "a") > of(key_col, "b")
    sides = [F.when(turned, of(c, m)).otherwise(of(c, n)).alias(f"{c}_{n}") for n, m in (("a", "b"), ("b", "a")) for c in rest]
    hit = F.when(turned, F.col("hit_ba")).otherwise(F.col("hit_ab"))
    detector = F.when(F.col("mismatch"), "negation_mismatch").when(hit.isNotNull(), "antonym_pair")
    return met.where((of(key_col, "a") != of(key_col, "b")) & detector.isNotNull()).select(*by, "overlap", *sides, hit.alias("hit"), detector.alias("detector"))


def node_claims(nodes: DataFrame, kinds: DataFrame) -> DataFrame:
    """Nodes with ``id``, ``claim`` (the kind's claim field) and ``slot``."""
    rows = nodes.join(F.broadcast(kinds.select("kind", "claim_field", F.size("claim_slot").alias("slot_size"))), "kind", "left")
    claim = F.when(F.coalesce("claim_field", F.lit("")) != "", F.coalesce(F.col("fields")[F.col("claim_field")], F.lit(""))).otherwise("")
    return rows.withColumn("id", X.composite_id(F.col("kind"), F.col("key"))).withColumn("claim", claim)


#: What an observation records of each side, and what it is called there.
SIDE = {"id": "id", "claim": "snapshot", "owner": "owner", "source": "source", "run_id": "run_id"}


def with_sources(claims: DataFrame) -> DataFrame:
    return claims.withColumn("source", F.coalesce(F.col("fields")["source"], F.lit(""))).withColumn("slot", F.coalesce("slot", F.lit("")))


def comparable() -> Column:
    """Whether a node of ``node_claims`` is compared with others of its slot."""
    return F.coalesce(F.expr("(status is null or status in ('', 'active', 'unmapped')) and slot <> '' and claim_field <> '' and slot_size > 0"), F.lit(False))


def _sides() -> list[Column]:
    return [F.col(f"{c}_{n}").alias(f"{side}_{name}") for n, side in (("a", "left"), ("b", "right")) for c, name in SIDE.items()]


def stated(naming: DataFrame, named: DataFrame, either: str | None = None, worded: bool = False) -> DataFrame:
    """What writers declare: ``naming`` has the ids it ``contradicts``.  With ``either`` one of the two must have that flag; with ``worded``
    pairs go that ``scan`` finds among the rows that are ``lexical``."""
    more = [*([either] if either else []), *(["lexical", "kind", "key"] if worded else [])]
    says = naming.select("slot", *[F.col(c).alias(f"{c}_a") for c in (*SIDE, *more)], F.explode("contradicts").alias("to")).where("to <> id_a")
    others = named.select(*[F.col(c).alias(f"{c}_b") for c in (*SIDE, *more)], F.col("slot").alias("slot_b"))
    both = says.join(others, F.col("to") == F.col("id_b"))
    both = both.where(F.col(f"{either}_a") | F.col(f"{either}_b")) if either else both
    both = both.where(~_found_by_words()) if worded else both
    slot = F.when(F.col("slot") != "", F.col("slot")).otherwise(F.col("slot_b"))
    return both.select(slot.alias("slot"), F.lit("declared").alias("detector"), F.lit(None).cast("double").alias("overlap"), *_sides(), F.lit(1).alias("rank"))


def _found_by_words() -> Column:
    """Whether ``scan`` finds a declared pair, from its own texts."""
    tokens = {n: X.claim_tokens(F.col(f"claim_{n}")) for n in ("a", "b")}
    words = {n: X.content_tokens(t) for n, t in tokens.items()}
    met = F.expr("lexical_a and lexical_b and kind_a = kind_b and slot = slot_b and key_a <> key_b")
    hit = F.when(F.col("key_a") > F.col("key_b"), X.antonym_hit(words["b"], words["a"])).otherwise(X.antonym_hit(words["a"], words["b"]))
    disagree = X.detector(X.overlap(words["a"], words["b"]), X.negations(tokens["a"]), X.negations(tokens["b"]), hit).isNotNull()
    return F.coalesce(met & disagree, F.lit(False))


def told_apart(claims: DataFrame) -> bool:
    """Whether no two pairs of ``lexical`` rows can have one pair key: a key comes once in its slot, and no id holds what the pair key is joined with."""
    own = claims.where("lexical").groupBy("kind", "slot", "key").agg(F.count("*").alias("times"), F.max(F.contains("id", F.lit("|"))).alias("joined"))
    return own.where("times > 1 or joined").isEmpty()


def assembled(lexical: DataFrame, declared: DataFrame, apart: bool = False) -> DataFrame:
    """Observations, each pair once: as found by words, or else as declared.  With ``apart`` pairs found by words have keys of
    their own, and none of them is declared: then only what is declared is shuffled."""
    found = lexical.select("slot", "detector", "overlap", *_sides(), F.lit(0).alias("rank"))
    keyed = (declared if apart else found.unionByName(declared)).withColumn("pair_key", X.pair_key(F.col("left_id"), F.col("right_id"), F.col("slot")))
    rest = [c for c in keyed.columns if c != "pair_key"]
    first = keyed.groupBy("pair_key").agg(F.min_by(F.struct(*rest), F.struct("rank", "left_id")).alias("o")).select("pair_key", "o.*")
    if apart:
        first = found.withColumn("pair_key", X.pair_key(F.col("left_id"), F.col("right_id"), F.col("slot"))).unionByName(first)
    return first.drop("rank").selectExpr(*[x.split()[0] for x in OBSERVATION.split(", ")])


def of_claims(claims: DataFrame, either: str | None = None) -> DataFrame:
    """``observations`` of rows that have been taken to words: ``lexical``, ``words``, ``codes``, ``negated``, ``contradicts``.  With ``either`` one
    of the two must have that flag."""
    apart = told_apart(claims)
    lexical = scan(claims.where("lexical").select("kind", "slot", "key", "words", "codes", "negated", *SIDE, *([either] if either else [])), either=either)
    return assembled(lexical, stated(claims.where("size(contradicts) > 0"), claims, either=either, worded=apart), apart)


def observations(nodes: DataFrame, kinds: DataFrame, together: bool = False) -> DataFrame:
    """Every disagreement among the nodes: found by words, and declared by writers where not found so.

    ``nodes``: kind, key, fields, slot, status, owner, run_id.  ``together`` as in ``scan``: then what is reduced by node is reduced before it is shuffled.
    """
    claims = with_sources(node_claims(nodes, kinds)).withColumn("lexical", comparable())
    apart = told_apart(claims)
    lexical = scan(claim_features(claims.where("lexical").select("kind", "slot", "key", *SIDE)), together=together)
    return assembled(lexical, stated(claims.withColumn("contradicts", X.as_list(F.col("fields")["contradicts"])), claims, worded=apart), apart)


def ledger_changes(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Full outer join of what is found with what is stored: ``pair_key, change``.

    upsert (new, or the same pair with other texts), reactivate (was resolved), resolve (active and
    no longer found).  Pairs that need nothing do not appear.
    """
    f = found.select("pair_key", F.col("left_snapshot").alias("new_left"), F.col("right_snapshot").alias("new_right"), F.lit(True).alias("now"))
    s = stored.select("pair_key", F.col("left_snapshot").alias("old_left"), F.col("right_snapshot").alias("old_right"), "state")
    both = f.join(s, "pair_key", "full")
    same = F.col("new_left").eqNullSafe(F.col("old_left")) & F.col("new_right").eqNullSafe(F.col("old_right"))
    change = (
        F.when(F.col("now").isNotNull() & F.col("state").isNull(), "upsert")
        .when(F.col("now").isNotNull() & (F.col("state") == "resolved"), "reactivate")
        .when(F.col("now").isNotNull() & ~same, "upsert")
        .when(F.col("now").isNull() & (F.col("state") == "active"), "resolve")
    )
    return both.select("pair_key", change.alias("change")).where("change is not null")


#: What becomes of a row of the ledger that is found no more.
GONE = "one side changed, was superseded, or no longer conflicts"


def fold_rows(found: pa.Table, own: pa.Table, scope: str, run_id: str, now: str) -> pa.Table:
    """Rows of the ledger after ``found`` has met those of one scope, and their ``change`` as in ``ledger_changes``."""
    keys = pa.chunked_array([*found.column("pair_key").chunks, *own.column("pair_key").chunks], pa.string()).dictionary_encode().combine_chunks()
    place = keys.indices.to_numpy() if len(keys) else np.empty(0, np.int64)
    at = np.full(len(keys.dictionary), -1)
    at[place[found.num_rows :]] = np.arange(own.num_rows)
    met = at[place[: found.num_rows]]  # of each row found, its row of the ledger
    both = np.flatnonzero(met >= 0)
    before = own.take(pa.array(met[both]))
    state, flag = before.column("state"), lambda x: pc.fill_null(x, False).to_numpy().astype(bool)
    changed = np.zeros(len(both), bool)
    for c in ("left_snapshot", "right_snapshot"):
        x, y = found.column(c).take(pa.array(both)), before.column(c)
        changed |= ~(flag(pc.equal(x, y)) | flag(pc.and_(pc.is_null(x), pc.is_null(y))))
    change = np.full(found.num_rows, "upsert", object)
    change[both] = np.select([flag(pc.equal(state, "resolved")), changed | flag(pc.is_null(state))], ["reactivate", "upsert"], "").astype(object)
    write, kept = change != "", np.ones(own.num_rows, bool)
    kept[met[(met >= 0) & write]] = False
    missed = np.ones(own.num_rows, bool)
    missed[met[both]] = False
    gone = missed & flag(pc.equal(own.column("state"), "active"))

    def with_values(rows: pa.Table, change: pa.Array, **values: str) -> pa.Table:
        for c, value in values.items():
            rows = rows.set_column(rows.column_names.index(c), c, pa.array([value], pa.string()).take(pa.array(np.zeros(rows.num_rows, np.int64))))
        return rows.append_column("change", change)

    nothing = lambda rows: pa.nulls(rows.num_rows, pa.string())
    new, old, stay = found.filter(pa.array(write)), own.filter(pa.array(gone)), own.filter(pa.array(kept & ~gone))
    return pa.concat_tables([
        with_values(new, pa.array(change[write], pa.string()), scope=scope, state="active", detected_run_id=run_id, detected_ts=now, resolved_ts="", resolution=""),
        with_values(old, pa.array(["resolve"] * old.num_rows, pa.string()), state="resolved", resolved_ts=now, resolution=GONE),
        stay.append_column("change", nothing(stay)),
    ])


#: Nodes that go to each task; more are met by a shuffle.
FEW_NODES = 1_000_000


def naming(ledger: DataFrame, ids: DataFrame, count: int, without: bool = False) -> DataFrame:
    """Rows of a ledger that name one of ``ids`` (``scope, id``; ``count`` of them), or, ``without``, none of them."""
    ids = ids.select("scope", "id").distinct()
    ids, columns = F.broadcast(ids) if count <= FEW_NODES else ids, ledger.columns
    for n in ("left", "right"):
        ledger = ledger.join(ids.select("scope", F.col("id").alias(f"{n}_id"), F.lit(True).alias(f"__{n}")), ["scope", f"{n}_id"], "left")
    return ledger.where("coalesce(__left, __right) is null" if without else "coalesce(__left, __right)").select(*columns)


def _slot() -> Column:
    return F.substring_index("pair_key", "|", -1)


def _first() -> Column:
    return F.substring_index("pair_key", "|", 1)


def begun(found: DataFrame, scope: str, run_id: str, now: str) -> DataFrame:
    """Rows of the ledger, with ``change``, of what is found and in no row yet."""
    values = {"scope": scope, "state": "active", "detected_run_id": run_id, "detected_ts": now, "resolved_ts": "", "resolution": "", "change": "upsert"}
    return found.withColumns({c: F.lit(v) for c, v in values.items()}).select(*[x.split()[0] for x in LEDGER.split(", ")], "change")


def latest(segments: list[DataFrame]) -> DataFrame:
    """The ledger that segments of it make, a later one's rows instead of an earlier one's."""
    return packs.latest(segments, ["scope", "pair_key"], "pair_key", LEDGER, _slot(), _first())


def reconciled(found: DataFrame, own: DataFrame, scope: str, run_id: str, now: str) -> DataFrame:
    """The rows of one scope's ledger after folding in ``found``, with ``change`` (null where there is none).  A pair comes once in either.

    The two meet in packs, by slot and then by the node that a pair key begins with, so that disk holds a few bytes of a pair."""

    blank = {c: F.lit(None).cast("string") for c in ("scope", "state", "detected_run_id", "detected_ts", "resolved_ts", "resolution")}
    columns = [x.split()[0] for x in LEDGER.split(", ")]
    fold = lambda new, old: fold_rows(new, old, scope, run_id, now)
    return packs.folded(found.withColumns(blank).select(*columns), own.select(*columns), "pair_key", fold, f"{LEDGER}, change string", _slot(), _first())


def reconcile(found: DataFrame, ledger: DataFrame, scope: str, run_id: str, now: str) -> tuple[DataFrame, DataFrame]:
    """The ledger after folding in ``found``, and the changes.  Other scopes' rows stay as they are; nothing
    changes when nothing has changed."""
    own, others = ledger.where(F.col("scope") == scope), ledger.where(F.col("scope") != scope)
    rows = reconciled(found, own, scope, run_id, now)
    return others.select(*ledger.columns).unionByName(rows.select(*ledger.columns)), rows.where("change is not null").select("pair_key", "change")
