"""Contradictions among many copies: classes are compared, pairs of claims are written out last."""

from __future__ import annotations

import random
from contextlib import contextmanager

from pyspark.sql import functions as F

from lorekeep import registry_graph
from lorekeep.operators import cells, contradictions, crowds, packs

KINDS = [("note", "claim", ["topic"])]


def nodes_of(spark, claims):
    """Nodes of (key, slot, claim, contradicts)."""
    rows = [("note", key, {"claim": claim, "contradicts": named, "source": "s"} if named else {"claim": claim}, slot, "active", "o", "r") for key, slot, claim, named in claims]
    return spark.createDataFrame(rows, "kind string, key string, fields map<string,string>, slot string, status string, owner string, run_id string")


def test_copies_are_compared_once(spark, monkeypatch):
    monkeypatch.setattr(contradictions, "AT_ONCE", 7)
    compared = []
    similar = cells.similar
    monkeypatch.setattr(cells, "similar", lambda pairs, sets, threshold: compared.append((pairs.count(), sets.count())) or similar(pairs, sets, threshold))
    texts = ["the gate is open now", "the gate is not open now", "gate now closed"]
    claims = [(f"{text}-{i:02}", "x", texts[text] + "!" * i, "note:0-01" if text == 1 and i == 2 else "note:2-30" if text == 2 and i == 3 else None) for text in range(3) for i in range(40)]
    found = contradictions.observations(nodes_of(spark, claims), spark.createDataFrame(KINDS, "kind string, claim_field string, claim_slot array<string>"))
    rows = found.select("left_id", "right_id", "detector", "left_snapshot").collect()
    between = {(f"note:{a}-{i:02}", f"note:{b}-{j:02}", "negation_mismatch" if 1 in (a, b) else "antonym_pair") for a, b in ((0, 1), (0, 2), (1, 2)) for i in range(40) for j in range(40)}
    assert {tuple(r)[:3] for r in rows} == between | {("note:2-03", "note:2-30", "declared")} and len(rows) == len(between) + 1
    assert all(r["left_snapshot"] == next(c for k, _, c, _ in claims if f"note:{k}" == r["left_id"]) for r in rows)
    assert compared == [(3, 3)]


def test_keys_that_pair_keys_do_not_tell_apart(spark):
    kinds = spark.createDataFrame(KINDS, "kind string, claim_field string, claim_slot array<string>")
    claims = [("a|b", "x", "the gate is open", None), ("c", "x", "the gate is not open", "note:a|b"), ("d", "x", "gate open", None)]
    rows = contradictions.observations(nodes_of(spark, claims), kinds).select("left_id", "right_id", "detector").collect()
    assert {tuple(r) for r in rows} == {("note:a|b", "note:c", "negation_mismatch"), ("note:c", "note:d", "negation_mismatch")} and len(rows) == 2


def test_nodes_are_stored_without_comparing_claims(spark, sf_dir, monkeypatch):
    def compared(*_):
        raise AssertionError("claims were compared")

    monkeypatch.setattr(registry_graph, "_STORES", {})
    monkeypatch.setattr(contradictions, "scan", compared)
    assert registry_graph._store(spark, sf_dir).manifest()["version"] == 2


def test_crowded_slots_meet_by_sketches(spark, monkeypatch):
    """What plain words give, with blocks, groups and matrices small enough that all of them are met; nothing is met by lists of words."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [r.sample(words, r.choice((2, 5, 9, 30))) + r.choice(([], ["not"], ["open"], ["closed"])) for _ in range(150)]
    texts += [t[:-1] + [r.choice(("not", "open", "closed", "w99"))] for t in texts[:60]]
    claims = spark.createDataFrame([("x", f"{i:03}", " ".join(t)) for i, t in enumerate(texts)], "slot string, key string, claim string")
    scanned = lambda: {tuple(x) for x in contradictions.scan(contradictions.claim_features(claims), ("slot",)).select("key_a", "key_b", "detector", F.round("overlap", 9)).collect()}
    plain, listed = scanned(), []
    opposed = contradictions.opposed_pairs
    monkeypatch.setattr(contradictions, "opposed_pairs", lambda *a: listed.append(opposed(*a).count()) or opposed(*a))
    for name, value in (("BLOCK_WORDS", 300), ("AT_ONCE", 1 << 12), ("PLACES", 1 << 9), ("TASK_PAIRS", 500)):
        monkeypatch.setattr(crowds, name, value)
    monkeypatch.setattr(contradictions, "CROWD", 10)
    assert scanned() == plain and len(plain) > 50
    assert listed == [0]


def test_pairs_of_a_slot_come_out_of_one_task(spark, monkeypatch):
    monkeypatch.setattr(contradictions, "TASK_PAIRS", 60)
    texts = ["the gate is open now", "the gate is not open now", "gate now closed"]
    claims = spark.createDataFrame([(f"s{s}", f"{i:02}", texts[i % 3]) for s in range(6) for i in range(30 if s == 0 else 12)], "slot string, key string, claim string")
    found = contradictions.scan(contradictions.claim_features(claims), ("slot",), together=True).select("slot", "key_a", "key_b", F.spark_partition_id().alias("task")).collect()
    assert len({r[:3] for r in found}) == len(found) == 3 * 10 * 10 + 5 * 3 * 4 * 4
    tasks = {s: {r["task"] for r in found if r["slot"] == s} for s in {r["slot"] for r in found}}
    assert all(len(t) == 1 for s, t in tasks.items() if s != "s0") and len(tasks["s0"]) > 1 and len(set.union(*tasks.values())) > 3


def test_a_ledger_is_folded_in_packs(spark, monkeypatch):
    """Pairs are neither shuffled one by one nor as they are, whatever falls in a part."""
    monkeypatch.setattr(packs, "PART_ROWS", 3_000)
    k = F.col("id")
    left, right = F.concat(F.lit("part:"), F.format_string("%06d", F.floor(k / 100))), F.concat(F.lit("part:"), F.format_string("%06d", 1_000 + k % 100))
    fixed = [F.lit(v).alias(c) for c, v in (("slot", "a/b"), ("detector", "antonym_pair"), ("left_snapshot", "the gate is open"), ("right_snapshot", "the gate is closed"), ("left_owner", "me"), ("right_owner", "me"), ("left_source", "s"), ("right_source", "s"), ("left_run_id", "r"), ("right_run_id", "r"))]
    rows = spark.range(0, 20_000, 1, 2).select("id", F.concat_ws("|", left, right, F.lit("a/b")).alias("pair_key"), left.alias("left_id"), right.alias("right_id"), *fixed, F.lit(0.5).alias("overlap"))
    state = F.when(k % 5 == 0, "resolved").when(k % 5 == 1, F.lit(None)).otherwise("active")
    stored = rows.where("id % 3 <> 0").select(F.lit("north").alias("scope"), "*", state.alias("state"), *[F.lit(v).alias(c) for c, v in (("detected_run_id", "r0"), ("detected_ts", "t0"), ("resolved_ts", ""), ("resolution", ""))])
    stored = stored.withColumn("left_snapshot", F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, "other").otherwise(F.col("left_snapshot"))).drop("id")
    found = rows.where("id % 4 <> 0").drop("id")
    after, changes = contradictions.reconcile(found, stored.unionByName(stored.limit(5).withColumn("scope", F.lit("south"))), "north", "r1", "t1")
    assert "hashpartitioning(pair_key" not in after._jdf.queryExecution().toString()
    plain = contradictions.ledger_changes(found, stored)
    assert sorted(map(tuple, changes.collect())) == sorted(map(tuple, plain.collect())) and plain.count() > 5_000
    told = {(r["scope"], r["pair_key"]): r for r in after.collect()}
    assert len(told) == after.count() == 5 + rows.where("id % 3 <> 0 or id % 4 <> 0").count()
    for key, change in map(tuple, plain.collect()):
        r = told["north", key]
        assert (r["state"], r["detected_run_id"], r["resolved_ts"]) == (("resolved", "r0", "t1") if change == "resolve" else ("active", "r1", ""))
        assert change == "resolve" or r["left_snapshot"] == "the gate is open"
    batch = found.withColumns({"__part": F.lit(0), "__side": F.lit(0)}).toArrow().to_batches()
    size = sum(len(b.as_py()) for some in packs.pack(iter(batch), "pair_key") for b in some.column("blob"))
    assert size < 4 * found.count()


def test_pairs_meet_no_more_of_a_claim_than_its_words_with_antonyms(spark, monkeypatch):
    """Whole texts go neither to the classes of claims nor to each of their pairs."""
    long = " ".join(f"word{i}" for i in range(200))
    rows = [("s", i, f"{long} {end}") for i, end in enumerate(("open more", "closed less", "closed open", "not open", "won lost"))]
    claims, kept = contradictions.claim_features(spark.createDataFrame(rows, "slot string, key int, claim string")).drop("claim"), []
    staged = contradictions.kept_until_done

    @contextmanager
    def watched(session):
        with staged(session) as keep:
            yield lambda df: kept.append(df.columns) or keep(df)

    monkeypatch.setattr(contradictions, "kept_until_done", watched)
    found = {(r["key_a"], r["key_b"]): (r["detector"], r["hit"] and tuple(r["hit"])) for r in contradictions.scan(claims, ("slot",)).collect()}
    assert kept and not any("words" in columns for columns in kept)
    assert found[0, 1] == ("antonym_pair", ("more", "less")) and found[0, 3][0] == "negation_mismatch" and (0, 4) not in found
    assert found[1, 3] == ("negation_mismatch", ("closed", "open"))
