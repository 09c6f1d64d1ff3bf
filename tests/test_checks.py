"""Items without keys against the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep import registry_batch
from lorekeep.operators import checks, similarity
from lorekeep.operators.checks import Batch


def test_items_without_keys_are_dealt_out(spark):
    items = spark.createDataFrame([("a" if i % 2 else "b", None if i % 3 == 0 else "" if i % 3 == 1 else str(i), i) for i in range(120)], "kind string, key string, pos int")
    ids = spark.createDataFrame([("a", ""), ("a", "5"), ("b", "8"), ("b", None), ("c", "2")], "kind string, key string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = checks.absent(items, ids).select("kind", "key", "pos", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = {i for i in range(120) if not (i % 2 and i % 3 == 1) and i not in (5, 8)}
    assert {r["pos"] for r in rows} == want and len(rows) == len(want)
    assert len({r["task"] for r in rows if r["kind"] == "b" and r["key"] is None}) > 1


def test_near_duplicate_keys_meet_in_many_tasks(spark, monkeypatch):
    """A trigram that all keys hold is dealt out on both sides, and every pair of keys is still met once."""
    keys = spark.range(0, 60, 1, 2).select(F.concat(F.lit("supplier "), F.format_string("%03d", F.col("id") * 7)).alias("key"))
    pairs = lambda: sorted(map(tuple, similarity.near_duplicates(keys, keys).collect()))
    plain = pairs()
    monkeypatch.setattr(similarity, "TASK_MEETINGS", 300)
    assert pairs() == plain and len(plain) > 10
    rows = spark.range(0, 100, 1, 2)
    sides = [rows.where(where).select(F.lit("x").alias("item"), F.col("id").alias(f"key_{n}")) for where, n in (("id < 60", "a"), ("id >= 10", "b"))]
    left, right, tasks = similarity.dealt(*sides, ["item"])
    met = left.join(right, ["item", "deal"])
    assert met.count() == met.select("key_a", "key_b").distinct().count() == 60 * 90
    assert tasks == 60 * 90 // 300 and met.groupBy("deal").count().agg(F.max("count")).first()[0] <= 2 * 300


def test_items_meet_existing_nodes_once(spark, sf_dir, monkeypatch):
    met = []
    against = checks.against_existing
    monkeypatch.setattr(checks, "against_existing", lambda *a: met.append(1) or against(*a))
    checks.run_checks(registry_batch._batch(spark, sf_dir))
    assert met == [1]


def test_synonyms_are_folded_where_items_share_a_position(spark):
    """Files that were put together number their items alike: each item is folded by its own values, and once."""
    rows = [("order", 7, {"priority": "5-LOW", "status": "F"}), ("order", 7, {"priority": "5-LOW", "status": "O"}), ("order", 7, {"priority": "2-HIGH"}), ("customer", 7, {"priority": "5-LOW"}), ("ghost", 8, {"priority": None})]
    items = spark.createDataFrame(rows, "kind string, pos int, fields map<string,string>").withColumn("props", F.to_json("fields")).withColumn("id", F.lit("x:?"))
    folded, report = checks.fold_synonyms(Batch(spark, registry_batch.CONTRACT, items, items))
    told = sorted((r["kind"], r["fields"]["priority"] or "", r["fields"].get("status", ""), r["props"]) for r in folded.select("kind", "fields", "props").collect())
    low = "4-NOT SPECIFIED"
    assert [x[:3] for x in told] == [("customer", "5-LOW", ""), ("ghost", "", ""), ("order", "2-HIGH", ""), ("order", low, "F"), ("order", low, "O")]
    assert [low in x[3] for x in told] == [False, False, False, True, True] and report.count() == 2
