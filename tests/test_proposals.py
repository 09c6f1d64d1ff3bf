"""Proposals as events: approvals by run and by file, several contracts, failed writes, documents for people."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.plans import engine
from lorekeep.sources.batches import content_hash
from lorekeep.sources.proposals import Proposals, events_of, new_run_id


def proposed(spark, book, run, content, contract, ts="t1", head=True):
    bound = {"run_id": F.lit(run), "content_hash": F.lit(content), "schema_hash": F.lit(contract), "ts": F.lit(ts)}
    rows = spark.createDataFrame([(0, "a:1", "a", "1", "REQUIRE_APPROVAL", False), (1, "b:1", "b", "1", "REQUIRE_APPROVAL", False), (2, "a:2", "a", "2", "ALLOW", False)], "pos int, id string, kind string, key string, verdict string, approved boolean")
    book.append(events_of(rows, "item", **bound))
    if head:
        book.append(events_of(spark.range(1).select(), "head", body=F.lit('{"owner": "me"}'), **bound))


def test_approvals_by_run_and_file(spark, tmp_path):
    file = tmp_path / "batch.yaml"
    file.write_text("source: x\n")
    content, book, log = content_hash(file), Proposals(spark, f"{tmp_path}/p"), f"{tmp_path}/audit.jsonl"
    assert engine.approve(spark, book.folder, log, file=str(file))["found"] is False
    first, other, failed = (new_run_id(str(file)) for _ in range(3))
    proposed(spark, book, first, content, "k1")
    proposed(spark, book, failed, content, "k1", "t2", head=False)
    got = engine.approve(spark, book.folder, log, file=str(file), items=["a:1", "1", "2", "zz"], approver="r", note="n")
    assert got["run_id"] == first and got["granted"] == ["a:1"] and [t for t, _ in got["unmatched"]] == ["1", "2", "zz"]
    assert [r["id"] for r in book.approved(content, "k1").collect()] == ["a:1"] and not book.approved(content, "k2").collect()
    proposed(spark, book, other, content, "k2", "t3")
    assert engine.approve(spark, book.folder, log, file=str(file), everything=True)["ambiguous"]
    assert engine.approve(spark, book.folder, log, run_id=failed)["found"] is False
    book.mark_applied(first, content, "k1", {"created": 1})
    shown = book.load(first)
    assert (shown["status"], shown["owner"], [i["approved"] for i in shown["items"]]) == ("partial", "me", [True, False, False])
    assert [(a["items"], a["approver"], a["note"]) for a in shown["approvals"]] == [(["a:1"], "r", "n")]
    assert engine.approve(spark, book.folder, log, run_id=other, everything=True)["granted"] == ["a:1", "b:1"]
    assert book.load(failed) is None
