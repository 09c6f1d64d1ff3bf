"""Proposals: what runs would do and who approved what, as a table of events that is only appended to.

A proposal is the rows of its items and findings and then a head, bound to content and contract; without its head, as
after a failed write, it isn't there.  Approvals and applications are later events; what holds now is folded from all by key
(``operators.approvals``).  Files are partitioned by the content's first digit and sorted by content, so that
a batch's history is read from the row groups that can hold it.
"""

from __future__ import annotations

import json
import secrets
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import lexicon as L
from lorekeep.operators import approvals
from lorekeep.operators.verdicts import verdict_name
from lorekeep.sources.batches import content_hash
from lorekeep.sources.files import Files

EVENT = (
    "event string, content_hash string, schema_hash string, run_id string, ts string, pos int, id string, kind string, key string, verdict string, action string, detail string, approved boolean, "
    "check_ord int, severity string, data map<string,string>, approver string, note string, against_content string, against_schema string, body string, part string"
)


def now_text() -> str:
    return datetime.now(UTC).isoformat()


def new_run_id(path: str) -> str:
    """Unique for each run, also of one file within one second."""
    return f"{Path(path).stem}-{datetime.now(UTC).strftime('%Y%m%dT%H%M%S.%fZ')}-{content_hash(path)[:8]}-{secrets.token_hex(2)}"


def events_of(rows: DataFrame, event: str, **columns: Column) -> DataFrame:
    """``rows`` as events: columns of the same names, and those given; the others null."""
    columns = {c: F.col(c) for c in rows.columns} | columns | {"event": F.lit(event), "part": F.substring(columns.get("content_hash", F.col("content_hash")), 1, 1)}
    names = [x.rsplit(" ", 1) for x in EVENT.split(", ")]
    return rows.select(*[columns[n].cast(t).alias(n) if n in columns else F.lit(None).cast(t).alias(n) for n, t in names])


class Proposals:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def append(self, events: DataFrame) -> None:
        dealt = events.hint("rebalance", "part").sortWithinPartitions("part", "content_hash")  # else every task would write a file for every part; a large part is split
        dealt.write.mode("append").partitionBy("part").parquet(self.folder)

    def events(self, content: str | None = None) -> DataFrame:
        """All events, or those of one content."""
        if not Files(self.spark).exists(self.folder):
            return self.spark.createDataFrame([], EVENT)
        rows = self.spark.read.schema(EVENT).parquet(self.folder)
        return rows if content is None else rows.where((F.col("part") == content[:1]) & (F.col("content_hash") == content))

    def of_run(self, run_id: str) -> DataFrame:
        """Events of one run, whose id names its content."""
        return self.events().where((F.col("part") == run_id.split("-")[-2:][0][:1]) & (F.col("run_id") == run_id))

    def record(self, plans: DataFrame, findings: DataFrame, head: dict) -> None:
        """A proposal: its items and findings, then its head."""
        bound = {c: F.lit(head[c]) for c in ("run_id", "content_hash", "schema_hash")} | {"ts": F.lit(head["created_ts"])}
        items = events_of(plans.select("pos", "id", "kind", "key", "verdict", "action", "detail", "approved"), "item", verdict=verdict_name(F.col("verdict")), key=F.coalesce("key", F.lit("?")), **bound)
        found = findings.select("pos", "check_ord", "severity", "data", F.col("target").alias("id"), F.col("check").alias("key"), "verdict", F.col("message").alias("detail"))
        said = events_of(found, "finding", verdict=verdict_name(F.col("verdict")), **bound)
        self.append(items.unionByName(said))
        self.append(events_of(self.spark.range(1).select(), "head", body=F.lit(json.dumps(head, default=str)), **bound))

    def approved(self, content: str, contract: str, compat: bool = False) -> DataFrame:
        """``id``: items of this content under this contract that approvals clear."""
        rows = self.events(content)
        found = approvals.approved(heads(rows), given(rows), compat)
        return found.where((F.col("content_hash") == content) & (F.col("schema_hash") == contract)).select("id")

    def approve(self, head: Row, ids: DataFrame, approver: str, note: str) -> None:
        """Appends an approval: a row for each of ``ids`` (id)."""
        bound = {"run_id": head["run_id"], "content_hash": head["content_hash"], "schema_hash": head["schema_hash"], "ts": now_text(), "approver": approver, "note": note, "against_content": head["content_hash"], "against_schema": head["schema_hash"]}
        self.append(events_of(ids, "approved", **{k: F.lit(v) for k, v in bound.items()}))

    def mark_applied(self, run_id: str, content: str, contract: str, counts: dict) -> None:
        """Appends that a run was applied: wholly, or in part while items are held."""
        status = approvals.status_after(items(self.of_run(run_id)))
        applied = events_of(status, "applied", content_hash=F.lit(content), schema_hash=F.lit(contract), ts=F.lit(now_text()), action=F.col("status"), body=F.lit(json.dumps(counts)))
        self.append(applied)

    def load(self, run_id: str) -> dict | None:
        """A proposal as a document, for people: of the size of one batch."""
        rows = self.of_run(run_id)
        head = rows.where("event = 'head'").first()
        if head is None:
            return None
        said: dict[str, list[dict]] = {}
        for f in rows.where("event = 'finding'").orderBy("check_ord", "pos").collect():
            said.setdefault(f["id"], []).append({"check": f["key"], "target": f["id"], "verdict": f["verdict"], "message": f["detail"], "severity": f["severity"], "data": f["data"]})
        listed = [{c: i[c] for c in ("id", "kind", "key", "verdict", "action", "detail", "approved")} | {"findings": said.get(i["id"], [])} for i in items(rows).orderBy("pos").collect()]
        approvals_of = rows.where("event = 'approved'").groupBy("ts", "approver", "note", F.col("against_schema").alias("schema_hash"), F.col("against_content").alias("content_hash")).agg(F.sort_array(F.collect_list("id")).alias("items")).orderBy("ts")
        applied = rows.where("event = 'applied'").orderBy(F.desc("ts")).first()
        return json.loads(head["body"]) | {
            "status": applied["action"] if applied else "pending", "run_findings": said.get(L.RUN, []), "items": listed, "approvals": [a.asDict() for a in approvals_of.collect()],
            "applied": {"ts": applied["ts"], **json.loads(applied["body"])} if applied else None,
        }


# ---------------------------------------------------------------- kinds of events, as the operators read them
def heads(events: DataFrame) -> DataFrame:
    return events.where("event = 'head'").select("run_id", "content_hash", "schema_hash", F.col("ts").alias("created_ts"))


def given(events: DataFrame) -> DataFrame:
    return events.where("event = 'approved'").select("run_id", "id", "ts", "against_content", "against_schema")


def items(events: DataFrame) -> DataFrame:
    """Items with what was approved since, of proposals that have their head."""
    proposed = events.where("event = 'item'").select("run_id", "pos", "id", "kind", "key", "verdict", "action", "detail", "approved")
    return approvals.items_now(proposed.join(heads(events).select("run_id").distinct(), "run_id", "left_semi"), given(events))
