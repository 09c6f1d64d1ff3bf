"""Streamed audit logs against a plain walk."""

from __future__ import annotations

import hashlib

import pandas as pd

from lorekeep.functions import lexicon as L
from lorekeep.operators import audit_chain
from lorekeep.streaming import chains

SCHEMA = "log string, line bigint, payload string, hash string"


def test_heads_carry_over_batches_and_passed_lines_have_no_place(spark, tmp_path):
    batches = [
        [("a", 3, "three", "x"), ("a", 1, "one", None), ("b", 7, None, None), (None, 1, "no log", None), ("a", None, "no line", None)],
        [("a", 1, "one", None), ("a", 5, "five", None), ("a", 2, "too late", None)],
        [("b", 8, "eight", None), ("c", 1, "first", None), ("c", 1, "again", None)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = chains.chained(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    rows = sorted((r["log"], r["line"], r["payload"], r["hash"]) for r in got.where("hash is not null").collect())
    want = []
    for log, entries in (("a", [(1, "one"), (3, "three"), (5, "five")]), ("b", [(7, ""), (8, "eight")]), ("c", [(1, "first")])):
        head = L.GENESIS
        for line, payload in entries:
            head = hashlib.sha256((head + payload).encode()).hexdigest()
            want.append((log, line, payload, head))
    assert rows == want
    assert sorted((r["log"], r["line"], r["payload"]) for r in got.where("hash is null").collect()) == [("a", 1, "one"), ("a", 2, "too late"), ("c", 1, "again")]
    assert all(r["ok"] for r in audit_chain.verify(got.where("hash is not null"), ("log",)).collect())


class _Head:
    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_lines_are_objects_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr(chains, "AT_ONCE", 7)
    lines, state = [(i * 13) % 50 for i in range(50)], _Head()
    frames = (pd.DataFrame({"log": "a", "line": lines[i : i + 20], "payload": [str(x) for x in lines[i : i + 20]]}) for i in (0, 20, 40))
    out = list(chains.continuing()(("a",), frames, state))
    assert max(map(len, out)) == 7
    head = L.GENESIS
    for line, row in enumerate(pd.concat(out).itertuples()):
        before, head = head, hashlib.sha256((head + str(line)).encode()).hexdigest()
        assert (row.line, row.prev_hash, row.hash) == (line, before, head)
    assert state.get == (head, 49)
