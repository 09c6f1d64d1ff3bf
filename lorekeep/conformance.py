"""Conformance cases: steps with expected outcomes, run against a throwaway store.

A case is a mapping with ``case, guarantee, title, files, steps``; each step has one verb and
``expect``.  A run returns what did not hold.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import explain as reading
from lorekeep.operators import gaps
from lorekeep.plans import engine
from lorekeep.plans.contract import Contract
from lorekeep.sources import audit_log
from lorekeep.sources.batches import canonical
from lorekeep.sources.store import open_store


@dataclass
class Outcome:
    case: str
    guarantee: str
    failures: list[str] = field(default_factory=list)

    @property
    def passed(self) -> bool:
        return not self.failures


class Runner:
    def __init__(self, spark: SparkSession, case: dict) -> None:
        for name in ("guarantee", "title", "steps"):
            if not case.get(name):
                raise ValueError(f"a case needs '{name}'")
        self.spark, self.case = spark, case
        self.outcome = Outcome(case.get("case", case["title"]), case["guarantee"])

    def run(self) -> Outcome:
        with tempfile.TemporaryDirectory() as folder:
            self.root = Path(folder)
            for name, text in (self.case.get("files") or {}).items():
                path = self.root / (name if Path(name).suffix else f"{name}.yaml")
                path.write_text(text if isinstance(text, str) else yaml.safe_dump(text, sort_keys=False))
            self.address, self.log, self.proposals = f"parquet:{self.root}/store", f"{self.root}/audit.jsonl", f"{self.root}/proposals"
            for i, step in enumerate(self.case["steps"], 1):
                verb = next(v for v in step if v not in ("expect", "note"))
                arguments = step[verb] if isinstance(step[verb], dict) else {}
                got = getattr(self, f"do_{verb}")(**arguments)
                for key, wanted in (step.get("expect") or {}).items():
                    self.compare(f"step {i} ({verb}): {key}", key, wanted, got)
        return self.outcome

    def compare(self, where: str, key: str, wanted: object, got: dict) -> None:
        if key.endswith("_contains"):
            have = got.get(key.removesuffix("_contains"))
            texts = [have] if isinstance(have, str) else list(have or ())
            good = all(any(str(w).lower() in str(t).lower() for t in texts) for w in (wanted if isinstance(wanted, list) else [wanted]))
        elif isinstance(wanted, dict):
            have = got.get(key) or {}
            good = all(have.get(k) == v for k, v in wanted.items())
        else:
            have = got.get(key)
            good = have == wanted
        if not good:
            self.outcome.failures.append(f"{where}: wanted {wanted!r}, got {have!r}")

    def path(self, name: str) -> str:
        return str(self.root / (name if Path(name).suffix else f"{name}.yaml"))

    def contract(self, name: str | None) -> str:
        return self.path(name or "contract")

    def do_ingest(self, file: str = "batch", schema: str | None = None, apply: bool = False, owner: str = "tester", approve_all: bool = False, **more: object) -> dict:
        result = engine.ingest(self.spark, self.path(file), self.contract(schema), self.address, apply=apply, owner=owner, approve_all=approve_all, proposal_dir=self.proposals, audit_path=self.log, **more)
        proposal = result.proposal or {}
        items = proposal.get("items", [])
        said = [f for i in items for f in i["findings"]] + proposal.get("run_findings", [])
        return {
            "schema_invalid": bool(result.schema_errors), "schema_errors": result.schema_errors, "halted": result.halted, "halt_reason": [m for _, m in result.halt_findings],
            "items": {i["id"]: i["action"] for i in items}, "checks_fired": sorted({f["check"] for f in said}), "message": [f["message"] for f in said], "detail": [i["detail"] for i in items],
            "applied": result.applied, "gap_slugs": (result.gaps or {}).get("slugs"), "contradictions": result.contradictions,
        }

    def do_approve(self, file: str | None = None, schema: str | None = None, bind_schema: bool = False, items: Iterable[str] = (), all: bool = False, approver: str = "reviewer") -> dict:  # noqa: A002
        got = engine.approve(self.spark, self.proposals, self.log, file=self.path(file or "batch"), contract_path=self.contract(schema) if bind_schema or schema else None, items=list(items), everything=all, approver=approver)
        return {"ambiguous": got["ambiguous"], "proposal_found": got["found"], "granted": sorted(got.get("granted", [])), "unmatched": [t for t, _ in got.get("unmatched", [])]}

    def do_tamper(self, how: str, line: int = 1) -> dict:
        path = Path(self.log)
        lines = path.read_text().splitlines()
        if how == "edit_payload":
            lines[line - 1] = json.dumps(json.loads(lines[line - 1]) | {"owner": "someone else"})
        elif how == "drop":
            del lines[line - 1]
        elif how == "reorder":
            lines[line - 1], lines[line] = lines[line], lines[line - 1]
        elif how == "append_forged":
            lines.append(canonical({"event": "apply", "run_id": "forged", "prev_hash": "0" * 64, "hash": "0" * 64}))
        path.write_text("\n".join(lines) + "\n")
        return {}

    def do_verify_audit(self) -> dict:
        return audit_log.verify(self.spark, self.log)

    def do_explain(self, id: str, schema: str | None = None, scope: str = "", version_limit: int = 20) -> dict:  # noqa: A002
        x = reading.explain(open_store(self.spark, self.address), Contract.load(self.contract(schema)), id, scope, self.log, version_limit)
        return {
            "integrity": x["integrity"]["state"], "integrity_reason": x["integrity"]["reason"], "exists": x["current"] is not None, "revision": x["current"] and x["current"]["revision"], "versions": len(x["versions"]),
            "versions_truncated": x["traversal"]["versions_truncated"], "prior_claims": [v["claim"] for v in x["versions"]], "contradictions_active": sum(c["state"] == "active" for c in x["contradictions"]),
            "contradicts_with": sorted(c["with"] for c in x["contradictions"]), "audit_entry_found": bool(x["audit"]["entry"]), "gap_slug": (x["gap"] or {}).get("slug"), "edges": len(x["edges"]), "status": x["current"] and x["current"]["status"],
        }

    def do_contradictions(self, state: str = "all") -> dict:
        rows = open_store(self.spark, self.address).ledger(state).collect()
        return {"count": len(rows), "detectors": sorted({r["detector"] for r in rows}), "pairs": sorted(sorted([r["left_id"], r["right_id"]]) for r in rows), "states": sorted({r["state"] for r in rows}), "snapshots_retained": all(r["left_snapshot"] and r["right_snapshot"] for r in rows)}

    def do_gaps(self, floor: int = 2) -> dict:
        store = open_store(self.spark, self.address)
        found = gaps.aggregate(store.read("gap_observations"), store.read("gap_resolutions"))
        rows = gaps.ranked(found).collect()
        return {"count": len(rows), "slugs": sorted(r["slug"] for r in rows), "promotable": sorted(r["slug"] for r in gaps.promotable(found, floor).collect()), "independent_scopes": {r["slug"]: r["independent"] for r in rows}, "known_gaps_slugs": sorted(r["slug"] for r in gaps.known_gaps(found).collect())}

    def do_validate_schema(self, schema: str | None = None) -> dict:
        errors = Contract.load(self.contract(schema)).problems()
        return {"valid": not errors, "errors": errors}


def run_cases(spark: SparkSession, cases: Iterable[dict]) -> list[Outcome]:
    return [Runner(spark, case).run() for case in cases]


def load_cases(folder: str) -> list[dict]:
    return [{"case": p.stem} | yaml.safe_load(p.read_text()) for p in sorted(Path(folder).glob("*.yaml"))]


def by_guarantee(spark: SparkSession, outcomes: list[Outcome]) -> list[dict]:
    """Passed and total cases of each guarantee."""
    rows = spark.createDataFrame([(o.guarantee, o.passed) for o in outcomes], "guarantee string, passed boolean")
    return [r.asDict() for r in rows.groupBy("guarantee").agg(F.count_if("passed").alias("passed"), F.count("*").alias("cases")).orderBy("guarantee").collect()]
