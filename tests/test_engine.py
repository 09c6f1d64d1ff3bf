from __future__ import annotations

import json
import sqlite3

import pytest
import yaml

from lorekeep import cli
from lorekeep.operators.explain import explain
from lorekeep.plans import contract_rules, engine
from lorekeep.plans.contract import Contract, Kind, Term, Vocabulary
from lorekeep.plugins import PackError, load_pack
from lorekeep.sources import audit_log
from lorekeep.sources import store as store_module
from lorekeep.sources.batches import scan_items
from lorekeep.sources.sqlite_graph import copy_graph
from lorekeep.sources.store import ConcurrentCommit, DuplicateNode, ReadSurfaceMissing, open_store
from lorekeep.streaming import inbox
from tests.cases import CONTRACT, VOCABULARY, batch, report


@pytest.fixture
def place(tmp_path):
    (tmp_path / "contract.yaml").write_text(yaml.safe_dump(CONTRACT, sort_keys=False))
    (tmp_path / "topics.yaml").write_text(yaml.safe_dump(VOCABULARY))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/batch.yaml").write_text(yaml.safe_dump(batch({"report": [report("r1", "Anna waits", tags={"deep": [1, "x"]})]})))
    return tmp_path


def options(place):
    return {"proposal_dir": f"{place}/proposals", "audit_path": f"{place}/audit.jsonl", "owner": "me"}


def test_store_commits_all_or_nothing(spark, place):
    store = open_store(spark, f"parquet:{place}/store")
    base = store.manifest()
    row = ("*", "k", "a", "{}", False, "me", "active", 1, "r", "t", None, "")
    nodes = spark.createDataFrame([row], store.read("nodes").schema)
    store.commit(base, {"nodes": nodes})
    with pytest.raises(ConcurrentCommit):
        store.commit(base, {"nodes": nodes})
    with pytest.raises(DuplicateNode):
        store.commit(store.manifest(), {"nodes": nodes.unionByName(nodes)})
    assert store.manifest()["version"] == 1 and store.read("nodes").count() == 1
    assert len([p for p in (place / "store").iterdir() if p.is_dir()]) == 1
    with pytest.raises(ValueError, match="no store"):
        open_store(spark, "other:x")


def test_segments_and_scopes(spark, place, monkeypatch):
    monkeypatch.setattr(store_module, "MOST_SEGMENTS", 2)
    store = open_store(spark, f"parquet:{place}/store")
    row = lambda scope, key, revision: (scope, "k", key, "{}", False, "me", "active", revision, "r", "t", None, "")
    frame = lambda *rows: spark.createDataFrame(list(rows), store.read("nodes").schema)
    store.commit(store.manifest(), {"nodes": frame(row("a", "x", 1), row("b", "x", 1), row("", "x", 1))})
    for revision in range(2, 5):  # more than a table keeps as segments
        store.commit(store.manifest(), {"nodes": frame(row("a", "x", revision))})
    assert sorted((r["scope"], r["revision"]) for r in store.read("nodes").collect()) == [("", 1), ("a", 4), ("b", 1)]
    assert len(store.manifest()["tables"]["nodes"]) <= 2
    assert [r["revision"] for r in store.existing("a", True).collect()] == [4]
    edge = spark.createDataFrame([("a", "k", "x", "f", "k", "y")], store.read("edges").schema)
    store.commit(store.manifest(), {"edges": edge})
    with pytest.raises(DuplicateNode):
        store.commit(store.manifest(), {"edges": edge})


def test_sqlite_graph(spark, place):
    with sqlite3.connect(place / "old.db") as db:
        db.execute("CREATE TABLE nodes (scope TEXT, kind TEXT, key TEXT, props TEXT, is_protected INTEGER, owner TEXT, status TEXT, revision INTEGER, ingest_run_id TEXT, valid_from TEXT)")
        db.execute("INSERT INTO nodes VALUES ('*', 'report', 'r1', '{\"statement\":\"x\"}', 1, 'me', 'active', 3, 'run-1', '2024-01-02')")
    old = open_store(spark, f"sqlite:{place}/old.db")
    with pytest.raises(ReadSurfaceMissing):
        old.read("edges")
    assert not explain(old, engine.Contract.load(place / "contract.yaml"), "report:r1", audit_path=f"{place}/audit.jsonl")["read_surface"]
    new = open_store(spark, f"parquet:{place}/store")
    copy_graph(old, new)
    node = new.node("report", "r1", "*").first()
    assert (node["is_protected"], node["revision"], node["run_id"], str(node["valid_from"]), node["fields"]["statement"]) == (True, 3, "run-1", "2024-01-02", "x")
    with pytest.raises(ReadSurfaceMissing):
        old.commit(old.manifest(), {})


def test_audit_log_is_appended_to(spark, place):
    path = f"{place}/audit.jsonl"
    for i in range(5):
        audit_log.append(spark, path, {"n": i}, "t")
    before = (place / "audit.jsonl").read_text()
    with open(path, "a") as log:
        log.write("\nnot json")
    audit_log.append(spark, path, {"n": 5}, "t")
    assert (place / "audit.jsonl").read_text().startswith(before)
    assert sorted(r["line"] for r in audit_log.lines(spark, path).collect()) == [1, 2, 3, 4, 5, 7, 8]
    found = audit_log.verify(spark, path)
    assert (found["ok"], found["broken_at"], found["entries"]) == (False, 7, 5)


def test_contract_rules_as_rows(spark):
    """The same faults, in words for one contract and as rows for many."""
    bad = Contract(
        "bad",
        {
            "a:b": Kind("a:b", key="", required=["protected"], vocab_fields={"f": "none"}, refs={"g": "nothing"}, claim_field="x", near_duplicate_threshold=0),
            "c": Kind("c", claim_slot=["z"]),
        },
        {"v": Vocabulary("v", {"t": Term("t", synonyms=("u",)), "u": Term("u", status="deprecated", replaced_by="gone"), "w": Term("w", status="odd")}), "e": Vocabulary("e", {})},
        identity="local",
    )
    rows = contract_rules.problems(contract_rules.tables_of(spark, [bad, Contract("good", {"k": Kind("k")}), Contract("empty", {})])).collect()
    assert sorted(r["rule"] for r in rows if r["contract"] == "bad") == sorted(set(contract_rules.RULES) - {"no_kinds"}) and len(bad.problems()) == len(contract_rules.RULES) - 1
    assert [(r["rule"], r["subject"]) for r in rows if r["contract"] != "bad"] == [("no_kinds", "empty")]


def test_ingest_keeps_documents(spark, place, capsys):
    command = ["ingest", f"{place}/in/batch.yaml", "--schema", f"{place}/contract.yaml", "--store", f"parquet:{place}/store", "--audit-log", f"{place}/audit.jsonl", "--proposals", f"{place}/proposals", "--owner", "me"]
    assert cli.main([*command, "--apply"], spark) == 0
    props = json.loads(open_store(spark, f"parquet:{place}/store").read("nodes").first()["props"])
    assert props["tags"] == {"deep": [1, "x"]} and props["ingested_by"] == "me" and props["source"] == "log-a"
    assert cli.main(["explain", "report:r1", *command[2:8]], spark) == 0
    assert "verified" in capsys.readouterr().out
    assert audit_log.tail(spark, f"{place}/audit.jsonl")[0]["summary"]["created"] == 1
    head = open_store(spark, f"parquet:{place}/store").manifest()["audit_head"]
    (place / "audit.jsonl").write_text("")
    assert not audit_log.verify(spark, f"{place}/audit.jsonl", head)["ok"]


def test_inbox_and_scan(spark, place):
    seen = []
    for _ in range(2):
        inbox.watch(spark, f"{place}/in", f"{place}/cp", f"{place}/contract.yaml", f"parquet:{place}/store", on_result=lambda p, r: seen.append(r.applied["created"]), **options(place)).awaitTermination()
    assert seen == [1]
    (place / "in/empty.yaml").write_text("source: x\n")
    rows = scan_items(spark, f"{place}/in", engine.Contract.load(place / "contract.yaml")).collect()
    assert sorted((r["id"] or "", bool(r["halt"])) for r in rows) == [("", True), ("report:r1", False)]


def test_packs_are_checked(tmp_path):
    (tmp_path / "p.py").write_text("A = 1\nB = [('x', 2)]\nC = [('', print)]\nD = [('ok', print)]\n")
    for spec in ("p.py", "none.py:A", "p.py:A", "p.py:B", "p.py:C", "no.such.module:X"):
        with pytest.raises(PackError):
            load_pack(spec, str(tmp_path))
    assert load_pack("p.py:D", str(tmp_path))[0][0] == "ok"
