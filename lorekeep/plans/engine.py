"""The governed write path: a batch in, a proposal and at most one commit out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import lexicon as L
from lorekeep.functions import text as X
from lorekeep.lineage import cut, kept_until_done
from lorekeep.operators import approvals, checks, gaps, verdicts
from lorekeep.operators.landing import clashes, links, new_edges, retired, superseded
from lorekeep.plans import claim_index
from lorekeep.plans.contract import Contract
from lorekeep.plugins import load_packs
from lorekeep.sources import audit_log, batches, proposals
from lorekeep.sources.documents import rewritten
from lorekeep.sources.store import DuplicateNode, Store, open_store


@dataclass
class Result:
    run_id: str
    halted: bool = False
    schema_errors: list[str] = field(default_factory=list)
    findings: DataFrame | None = None
    plans: DataFrame | None = None
    book: proposals.Proposals | None = None
    applied: dict | None = None
    gaps: dict | None = None
    contradictions: dict | None = None
    audit_entry: dict | None = None
    halt_findings: list[tuple[str, str]] = field(default_factory=list)

    @property
    def proposal(self) -> dict | None:
        """The proposal as it stands, read when asked for."""
        return self.book.load(self.run_id) if self.book else None


def writes(store: Store, base: dict, batch: checks.Batch, plans: DataFrame, now: str, today: str) -> dict[str, DataFrame]:
    """What the plans add to the graph's tables, without the ledger and the gaps.

    Creates must meet no existing node; superseded nodes go to the revisions; references become
    edges once.  Nodes replace those of the same key.
    """
    spark, contract, partition = batch.spark, batch.contract, batch.contract.partition(batch.scope)
    fields = F.col("fields")
    changes = plans.where("renames is not null").select("pos", F.col("renames").alias("changes"))
    landing = plans.where("action in ('create', 'create_unmapped', 'supersede')")
    landing = checks.replace_fields(landing, changes)
    stamp = F.to_json(F.create_map(*[F.lit(x) for k, v in {"source": batch.source, "ingested_by": batch.owner, "ingest_run_id": batch.run_id, "provenance_ts": now}.items() for x in (k, v)]))
    kinds = F.broadcast(contract.kind_rows(spark).select("kind", "claim_slot"))
    landing = landing.join(kinds, "kind", "left").select(
        F.lit(partition).alias("scope"), "kind", "key", rewritten(F.col("props"), F.lit(None).cast("string"), stamp, X.strings(L.CONTROL_FIELDS)).alias("props"),
        F.col("protected").alias("is_protected"), F.lit(batch.owner).alias("owner"), F.when(F.col("action") == "create_unmapped", "unmapped").otherwise("active").alias("status"),
        F.lit(1).alias("revision"), F.lit(batch.run_id).alias("run_id"), F.lit(now).alias("provenance_ts"), F.lit(today).cast("date").alias("valid_from"),
        F.coalesce(X.slot_value(fields, F.col("claim_slot")), F.lit("")).alias("slot"), "action", "fields", "pos",
    )
    landing = cut(landing)
    nodes, edges = (store.read(t, base) for t in ("nodes", "edges"))
    created, replacing = landing.where("action <> 'supersede'"), landing.where("action = 'supersede'")
    if not clashes(created, nodes).isEmpty():
        raise DuplicateNode("a node to create exists already")
    return {
        "nodes": created.select(*nodes.columns).unionByName(superseded(nodes, replacing)),
        "node_revisions": retired(nodes, replacing, batch.run_id, F.lit(today)),
        "edges": new_edges(links(landing, contract.ref_rows(spark)), edges),
    }


def ingest(
    spark: SparkSession, file: str, contract_path: str, address: str, *, apply: bool = False, owner: str = "", approve_all: bool = False, proposal_dir: str = "./proposals", audit_path: str = "./audit.jsonl",
    compat: bool = False, today: str | None = None, options: dict | None = None,
) -> Result:
    """Checks a batch file, records a proposal and, with ``apply``, writes what may be written.

    A structural halt comes before the contract is read, a faulty contract before the store is opened.
    """
    run_id, now = proposals.new_run_id(file), proposals.now_text()
    data = batches.read_yaml(file)
    if problems := batches.structural_problems(data):
        return Result(run_id, halted=True, halt_findings=problems)
    contract = Contract.load(contract_path)
    if errors := contract.problems():
        return Result(run_id, schema_errors=errors)
    packs = load_packs(contract.check_packs, contract.base_dir)
    store = open_store(spark, address)
    base, scope = store.manifest(), batches.scope_of(data, contract)
    partition = contract.partition(scope)
    existing = store.existing(partition, contract.scoped, base)
    batch = checks.Batch(spark, contract, batches.items(spark, data, contract), existing, scope, str(data.get("source", "")), str(data.get("date", "")), owner, run_id, (options or {}) | {"today": today or now[:10]})
    batch, findings = checks.run_checks(batch, packs)
    findings = cut(findings)  # read several times below, and a long plan
    content, bound = batches.content_hash(file), contract.fingerprint()
    book = proposals.Proposals(spark, proposal_dir)
    approved = book.approved(content, bound, compat)
    plans = verdicts.resolve_actions(batch.items, findings, existing, approved, approve_all, compat)
    plans = cut(plans)
    book.record(plans, findings, {"run_id": run_id, "file": file, "content_hash": content, "schema_hash": bound, "identity": contract.identity, "domain_checks": [n for n, _ in packs], "created_ts": now, "owner": owner, "scope": scope})
    result = Result(run_id, findings=findings, plans=plans, book=book, halted=bool(verdicts.run_floor(findings).first()["halts"]))
    if result.halted or not apply:
        return result

    changed = writes(store, base, batch, plans, now, today or now[:10])
    seen = gaps.observations_from_plans(plans, scope, batch.source, run_id, batch.date, now)
    fresh = cut(gaps.new_observations(seen, store.read("gap_observations", base)))
    slugs = sorted(r["slug"] for r in fresh.select("slug").distinct().collect())
    if slugs:
        changed["gap_observations"] = fresh
    with kept_until_done(spark) as keep:
        changed["nodes"] = keep(changed["nodes"])
        folded = claim_index.fold(store, base, changed["nodes"], contract.kind_rows(spark), partition, contract.scoped, run_id, now, keep)
        store.commit(base, changed | folded.tables, folded.notes, folded.renewed)
    counts = folded.counts
    # The log follows the commit: a write that failed leaves no entry.
    result.applied = verdicts.action_counts(plans).first().asDict()
    result.gaps = {"recorded": fresh.count(), "slugs": slugs}
    result.contradictions = {k: counts.get(k, 0) for k in ("upsert", "reactivate", "resolve")}
    done = verdicts.landing_order(plans).select("action", "id").collect()  # of one batch file
    result.audit_entry = audit_log.append(
        spark, audit_path,
        {"event": "apply", "run_id": run_id, "file": file, "owner": owner, "scope": scope, "identity": contract.identity, "content_hash": content, "schema_hash": bound, "summary": result.applied,
         "gaps": result.gaps, "contradictions": result.contradictions, "actions": [{"action": p["action"], "id": p["id"]} for p in done]}, now,
    )
    store.set_audit_head(result.audit_entry["hash"])
    book.mark_applied(run_id, content, bound, result.applied)
    return result


def approve(spark: SparkSession, proposal_dir: str, audit_path: str, *, run_id: str | None = None, file: str | None = None, contract_path: str | None = None, items: list[str] = (), everything: bool = False, approver: str = "", note: str = "") -> dict:
    """Records an approval of held items of one proposal, named by run or by file.

    ``found`` is False and ``reason`` says why if no proposal matches, if it was made under another
    contract, or if proposals of several contracts match.
    """
    bound = Contract.load(contract_path).fingerprint() if contract_path else None
    book = proposals.Proposals(spark, proposal_dir)
    if run_id:
        rows = book.of_run(run_id)
        head = proposals.heads(rows).first()
        if head and bound and head["schema_hash"] != bound:
            return {"found": False, "ambiguous": False, "reason": "the proposal was made under another contract"}
    else:
        rows = book.events(batches.content_hash(file))
        known = proposals.heads(rows).where(F.lit(bound).isNull() | (F.col("schema_hash") == F.lit(bound)))
        if known.select("schema_hash").distinct().limit(2).count() > 1:
            return {"found": False, "ambiguous": True, "reason": "proposals under several contracts match; name the contract or the run"}
        head = approvals.matching(known).where("place = 1").first()
    if head is None:
        return {"found": False, "ambiguous": False, "reason": "no such proposal"}
    listed = proposals.items(rows).where(F.col("run_id") == head["run_id"])
    if everything:
        named = listed.where("verdict = 'REQUIRE_APPROVAL'").select(F.col("id").alias("token"), "id", F.lit(None).cast("string").alias("problem"))
    else:
        named = approvals.resolve_tokens(listed, spark.createDataFrame([(head["run_id"], t) for t in dict.fromkeys(items)], "run_id string, token string"))
    named = cut(named)
    book.approve(head, named.where("problem is null").select("id").distinct(), approver, note)
    answers = {r["token"]: r for r in named.collect()}  # what the approver named, as the audit entry has it
    order = sorted(answers) if everything else list(dict.fromkeys(items))
    granted = list(dict.fromkeys(answers[t]["id"] for t in order if answers[t]["problem"] is None))
    unmatched = [(t, answers[t]["problem"]) for t in order if answers[t]["problem"] is not None]
    audit_log.append(
        spark, audit_path,
        {"event": "approve", "run_id": head["run_id"], "approver": approver, "items": granted, "note": note, "schema_hash": head["schema_hash"], "content_hash": head["content_hash"], "unmatched": [list(u) for u in unmatched]},
        proposals.now_text(),
    )
    return {"found": True, "ambiguous": False, "run_id": head["run_id"], "granted": granted, "unmatched": unmatched}
