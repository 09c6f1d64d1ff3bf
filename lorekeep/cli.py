"""Command line: ``python -m lorekeep.cli <command>``.

Exit codes: 2 for a halt, 3 for an invalid contract, 1 for approvals that match nothing or a broken
log; explain ends with 0 (verified), 4 (unverified) or 5 (invalidated).
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from lorekeep import conformance, render
from lorekeep.operators import audit_chain, gaps
from lorekeep.operators import explain as reading
from lorekeep.plans import engine
from lorekeep.plans.contract import Contract
from lorekeep.sources import audit_log
from lorekeep.sources.proposals import now_text
from lorekeep.sources.store import open_store


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lorekeep")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: str) -> argparse.ArgumentParser:
        made = commands.add_parser(name)
        common = {
            "schema": dict(required=name not in ("approve",)), "store": dict(default="parquet:./store"), "audit-log": dict(default="./audit.jsonl"), "proposals": dict(default="./proposals"), "owner": dict(default=""),
            "scope": dict(default=""), "json": dict(action="store_true"),
        }
        for o in options:
            made.add_argument(f"--{o}", **common[o])
        return made

    c = command("ingest", "schema", "store", "audit-log", "proposals", "owner", "json")
    c.add_argument("file")
    c.add_argument("--apply", action="store_true")
    c.add_argument("--approve-all", action="store_true")
    c = command("approve", "schema", "audit-log", "proposals")
    c.add_argument("run_id", nargs="?")
    c.add_argument("--file")
    c.add_argument("--items", nargs="*", default=[])
    c.add_argument("--all", action="store_true")
    c.add_argument("--approver", default="")
    c.add_argument("--note", default="")
    command("validate-schema", "schema", "json")
    c = command("explain", "schema", "store", "audit-log", "scope", "json")
    c.add_argument("id")
    c.add_argument("--versions", type=int, default=reading.VERSIONS_SHOWN)
    c = command("contradictions", "store", "json")
    c.add_argument("--state", choices=("all", "active", "resolved"), default="all")
    c = command("gaps", "store", "json")
    c.add_argument("what", choices=("list", "known", "promote", "reject"))
    c.add_argument("slug", nargs="?")
    c.add_argument("--floor", type=int, default=2)
    for name in ("term", "category", "definition", "note", "actor"):
        c.add_argument(f"--{name}", default="")
    c.add_argument("--apply", action="store_true")
    c = command("conformance", "json")
    c.add_argument("folder")
    command("verify-audit", "audit-log", "json")
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0].endswith((".yaml", ".yml")):  # a bare file is to be ingested
        argv = ["ingest", *argv]
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lorekeep").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return globals()[f"_{a.command.replace('-', '_')}"](spark, a)


def _ingest(spark: SparkSession, a: argparse.Namespace) -> int:
    result = engine.ingest(spark, a.file, a.schema, a.store, apply=a.apply, owner=a.owner, approve_all=a.approve_all, proposal_dir=a.proposals, audit_path=a.audit_log)
    print(render.as_json(result.proposal or {"halted": result.halted, "reasons": result.halt_findings, "errors": result.schema_errors}) if a.json else render.plan(result))
    return 2 if result.halted else 3 if result.schema_errors else 0


def _approve(spark: SparkSession, a: argparse.Namespace) -> int:
    got = engine.approve(spark, a.proposals, a.audit_log, run_id=a.run_id, file=a.file, contract_path=a.schema, items=a.items, everything=a.all, approver=a.approver, note=a.note)
    print(render.as_json(got))
    return 0 if got["found"] and not got["unmatched"] else 1


def _validate_schema(spark: SparkSession, a: argparse.Namespace) -> int:
    contract = Contract.load(a.schema)
    errors = contract.problems()
    terms = {v.name: {"terms": len(v.terms), "synonyms": len(v.aliases), "deprecated": sum(t.status == "deprecated" for t in v.terms.values())} for v in contract.vocabularies.values()}
    print(render.as_json({"valid": not errors, "errors": errors, "fingerprint": contract.fingerprint(), "kinds": sorted(contract.kinds), "vocabularies": terms}))
    return 3 if errors else 0


def _explain(spark: SparkSession, a: argparse.Namespace) -> int:
    x = reading.explain(open_store(spark, a.store), Contract.load(a.schema), a.id, a.scope, a.audit_log, a.versions)
    print(render.as_json(x) if a.json else render.explanation(x))
    return audit_chain.EXIT_CODES[x["integrity"]["state"]]


def _contradictions(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = [r.asDict() for r in open_store(spark, a.store).ledger(a.state).collect()]
    print(render.as_json(rows) if a.json else render.table([{k: r[k] for k in ("state", "detector", "left_id", "right_id", "slot")} for r in rows]))
    return 0


def _gaps(spark: SparkSession, a: argparse.Namespace) -> int:
    store = open_store(spark, a.store)
    found = gaps.aggregate(store.read("gap_observations"), store.read("gap_resolutions"))
    if a.what in ("list", "known"):
        rows = [r.asDict() for r in (gaps.ranked(found) if a.what == "list" else gaps.known_gaps(found)).collect()]
        print(render.as_json(rows) if a.json else render.table(rows))
        return 0
    row = found.where(found["slug"] == (a.slug or "")).first()
    if row is None:
        print(f"no gap '{a.slug}'")
        return 1
    if a.what == "promote":
        if row["independent"] < a.floor:
            print(f"'{a.slug}' has {row['independent']} independent scopes; {a.floor} are needed")
            return 1
        print(render.as_json(gaps.promotion_block(found, a.slug, a.term or a.slug, a.category, a.definition)))
    if a.apply:
        store.resolve_gap(a.slug, "promoted" if a.what == "promote" else "rejected", a.term, a.note, a.actor, now_text())
    else:
        print("nothing was written; use --apply")
    return 0


def _conformance(spark: SparkSession, a: argparse.Namespace) -> int:
    outcomes = conformance.run_cases(spark, conformance.load_cases(a.folder))
    rows = conformance.by_guarantee(spark, outcomes)
    print(render.as_json({"guarantees": rows, "failures": {o.case: o.failures for o in outcomes if o.failures}}) if a.json else render.table(rows, markdown=True))
    for o in outcomes:
        for f in o.failures:
            print(f"{o.case}: {f}")
    return 0 if all(o.passed for o in outcomes) else 1


def _verify_audit(spark: SparkSession, a: argparse.Namespace) -> int:
    got = audit_log.verify(spark, a.audit_log)
    print(render.as_json(got))
    return 0 if got["ok"] else 1


if __name__ == "__main__":
    sys.exit(main())
