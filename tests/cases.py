"""Conformance cases of our own: contract, batches and expected outcomes, one or two for each guarantee."""

from __future__ import annotations

VOCABULARY = {
    "version": 2,
    "categories": {
        "Harbour": {
            "berth.delay": {"definition": "A ship waits for its berth.", "synonyms": ["late_berth"]},
            "berth.clear": {"definition": "A berth is free."},
            "crane.fault": {"definition": "A crane stands still.", "status": "deprecated", "replaced_by": "crane.outage"},
            "crane.outage": {"definition": "A crane is out of service."},
        }
    },
}
CONTRACT = {
    "name": "harbour",
    "vocabularies": {"topics": "topics.yaml"},
    "node_kinds": {
        "report": {"required": ["statement"], "vocab_fields": {"topic": "topics"}, "content_fields": ["statement", "topic"], "refs": {"ships": "ship"}, "claim_field": "statement", "claim_slot": ["ships", "topic"]},
        "ship": {"content_fields": ["flag"], "implicit_create": False, "near_duplicate_check": True},
        "pilot": {"content_fields": ["rank"], "supersedable": False},
    },
}
SCOPED = CONTRACT | {"identity": "scoped", "scope_label": "port"}


def batch(nodes=None, declare=None, unmapped=None, **head):
    made = {"source": "log-a", "date": "2026-03-01", "scope": "north"} | head
    made |= {k: v for k, v in (("nodes", nodes), ("declare", declare), ("unmapped_for_review", unmapped)) if v}
    return made


def report(key, statement, **more):
    return {"key": key, "statement": statement, "topic": "berth.delay"} | more


def case(name, guarantee, files, steps, contract=CONTRACT):
    return {"case": name, "guarantee": guarantee, "title": name.replace("-", " "), "files": {"contract": contract, "topics": VOCABULARY} | files, "steps": steps}


ANNA, ANNA_CHANGED = batch({"report": [report("r1", "Anna waits at pier four")]}), batch({"report": [report("r1", "Anna has left pier four")]})
APPLY = lambda file="batch", **expect: {"ingest": {"file": file, "apply": True}, "expect": expect}

CASES = [
    case(
        "taxonomy-drift", "taxonomy-drift",
        {"batch": batch({"report": [report("a", "x one", topic="berth.nonsense"), report("b", "x two", topic="late_berth"), report("c", "x three", topic="crane.fault")]})},
        [
            APPLY(items={"report:a": "blocked", "report:b": "create", "report:c": "held"}, checks_fired=["vocab_membership", "vocab_synonym_folded"]),
            {"approve": {"items": ["report:c"]}, "expect": {"granted": ["report:c"], "proposal_found": True}},
            APPLY(items={"report:c": "create", "report:b": "unchanged"}, detail_contains="deprecated term rewritten"),
        ],
    ),
    case(
        "phantom-nodes", "phantom-nodes",
        {"batch": batch({"report": [report("a", "x", ships=["ghost"]), report("b", "x", ships=["anna"])], "ship": [{"key": "bella", "flag": "se"}]}, {"ship": [{"key": "anna", "flag": "no"}]})},
        [APPLY(items={"report:a": "blocked", "report:b": "create", "ship:bella": "blocked", "ship:anna": "create"}), {"explain": {"id": "report:b"}, "expect": {"edges": 1, "integrity": "verified"}}],
    ),
    case(
        "near-duplicate-keys", "near-duplicate-keys",
        {"batch": batch(declare={"ship": [{"key": "Nordic Carrier"}, {"key": "Lisboa, PT"}, {"key": "ORCA"}]}), "second": batch(declare={"ship": [{"key": "Nordic Carrier, Inc."}, {"key": "Lisboa, BR"}, {"key": "ORCAS"}]})},
        [APPLY(items={"ship:Nordic Carrier": "create"}), APPLY("second", items={"ship:Nordic Carrier, Inc.": "held", "ship:Lisboa, BR": "create", "ship:ORCAS": "create"}, checks_fired=["near_duplicate_key"]), {"approve": {"file": "second", "items": ["Nordic Carrier, Inc."]}, "expect": {"granted": ["ship:Nordic Carrier, Inc."]}}, APPLY("second", items={"ship:Nordic Carrier, Inc.": "create", "ship:Lisboa, BR": "unchanged"})],
    ),
    case(
        "silent-overwrite", "silent-overwrite", {"batch": ANNA, "changed": ANNA_CHANGED},
        [APPLY(applied={"created": 1}), APPLY(items={"report:r1": "unchanged"}), APPLY("changed", items={"report:r1": "held"}), {"approve": {"file": "changed", "all": True}, "expect": {"granted": ["report:r1"]}}, APPLY("changed", items={"report:r1": "supersede"}), {"explain": {"id": "report:r1"}, "expect": {"revision": 2, "versions": 1, "prior_claims": ["Anna waits at pier four"]}}, APPLY("changed", items={"report:r1": "unchanged"})],
    ),
    case(
        "contradiction-ledger", "contradiction-ledger",
        {"batch": batch({"report": [report("a", "The northern lock gate opens before noon"), report("b", "The northern lock gate never opens before noon"), report("c", "Pilots eat fish")]})},
        [APPLY(applied={"created": 3}), {"contradictions": {}, "expect": {"count": 1, "detectors": ["negation_mismatch"], "states": ["active"], "pairs": [["report:a", "report:b"]]}}, APPLY(contradictions={"upsert": 0, "resolve": 0}), {"explain": {"id": "report:b"}, "expect": {"contradictions_active": 1, "contradicts_with": ["report:a"]}}],
    ),
    case(
        "contradiction-resolution", "contradiction-ledger",
        {"batch": batch({"report": [report("a", "The lock gate is open today"), report("b", "The lock gate is closed today")]}), "changed": batch({"report": [report("b", "Pilots eat fish", supersede=True)]})},
        [APPLY(applied={"created": 2}), {"contradictions": {"state": "active"}, "expect": {"count": 1, "detectors": ["antonym_pair"]}}, APPLY("changed", items={"report:b": "supersede"}), {"contradictions": {}, "expect": {"count": 1, "states": ["resolved"], "snapshots_retained": True}}],
    ),
    case("declared-contradiction", "contradiction-ledger", {"batch": batch({"report": [report("a", "Fog"), report("b", "Sun")]}), "second": batch({"report": [report("c", "Wind", contradicts=["report:a", "report:none", "bare"]), report("d", "Rain", contradicts="report:a")]})}, [APPLY(applied={"created": 2}), APPLY("second", items={"report:c": "blocked", "report:d": "create"}, message_contains=["does not exist", "composite id"]), {"contradictions": {}, "expect": {"count": 1, "detectors": ["declared"]}}]),
    case("provenance", "provenance", {"batch": ANNA}, [APPLY(applied={"created": 1}), {"explain": {"id": "report:r1"}, "expect": {"integrity": "verified", "audit_entry_found": True}}, {"tamper": {"how": "edit_payload", "line": 1}}, {"explain": {"id": "report:r1"}, "expect": {"integrity": "invalidated", "integrity_reason_contains": "line 1"}}]),
    case(
        "held-for-approval", "held-for-approval", {"batch": batch(unmapped=[{"kind": "report", "key": "u", "statement": "Seals on the slipway", "unmapped_gap": "slipway-wildlife", "unmapped_reason": "no topic"}])},
        [APPLY(items={"report:u": "held"}, applied={"created": 0, "unmapped": 0}), {"explain": {"id": "report:u"}, "expect": {"exists": False}}, {"approve": {"all": True}, "expect": {"granted": ["report:u"]}}, APPLY(items={"report:u": "create_unmapped"}, gap_slugs=["slipway-wildlife"]), APPLY(items={"report:u": "unchanged"}), {"explain": {"id": "report:u"}, "expect": {"gap_slug": "slipway-wildlife", "status": "unmapped"}}],
    ),
    case(
        "gap-join-key", "gap-promotion",
        {"batch": batch(unmapped=[{"kind": "report", "key": k, "statement": "s", "unmapped_gap": g} for k, g in (("a", "Bad_Slug"), ("b", "no-tag"), ("c", "the-thing"), ("d", "north-quay-noise"), ("e", ""), ("f", "tide-clock-drift"))])},
        [APPLY(items={"report:a": "blocked", "report:b": "blocked", "report:c": "blocked", "report:d": "blocked", "report:e": "blocked", "report:f": "held"}, checks_fired=["unmapped_gap_named", "unmapped_review"])],
    ),
    case(
        "gap-promotion", "gap-promotion",
        {n: batch(unmapped=[{"kind": "report", "key": f"{n}{i}", "statement": "s", "unmapped_gap": "tide-clock-drift"} for i in range(k)], scope=s) for n, k, s in (("batch", 3, "north"), ("second", 1, "south"))},
        [{"ingest": {"file": "batch", "apply": True, "approve_all": True}}, {"gaps": {}, "expect": {"count": 1, "promotable": [], "independent_scopes": {"tide-clock-drift": 1}}}, {"ingest": {"file": "second", "apply": True, "approve_all": True}}, {"gaps": {}, "expect": {"promotable": ["tide-clock-drift"], "known_gaps_slugs": ["tide-clock-drift"]}}],
    ),
    case(
        "graded-verdicts", "graded-verdicts",
        {"batch": batch({"report": [report("a", "one"), report("b", ""), report("a2", "three", topic="nope")], "kraken": [{"key": "k"}]}), "undated": batch({"report": [report("z", "z")]}, date="1 March"), "sourceless": {"date": "2026-03-01", "nodes": {"report": [report("z", "z")]}}},
        [APPLY(items={"report:a": "create", "report:b": "blocked", "report:a2": "blocked", "kraken:k": "blocked"}), APPLY("undated", items={"report:z": "blocked"}, detail_contains="run-level"), APPLY("sourceless", halted=True, halt_reason_contains="source")],
    ),
    case("audit-chain", "audit-chain", {"batch": ANNA, "second": ANNA | {"date": "2026-03-02"}}, [APPLY(), APPLY("second"), APPLY(), {"verify_audit": None, "expect": {"ok": True, "entries": 3}}, {"tamper": {"how": "edit_payload", "line": 2}}, {"verify_audit": None, "expect": {"ok": False, "broken_at": 2, "reason_contains": "not what was hashed"}}]),
    case("audit-chain-structural", "audit-chain", {"batch": ANNA}, [APPLY(), APPLY(), APPLY(), {"tamper": {"how": "drop", "line": 2}}, {"verify_audit": None, "expect": {"ok": False, "broken_at": 2, "reason_contains": "does not continue"}}]),
    case("read-integrity", "read-integrity", {"batch": ANNA}, [APPLY(), {"explain": {"id": "report:r1"}, "expect": {"integrity": "verified"}}, {"explain": {"id": "report:none"}, "expect": {"integrity": "invalidated", "exists": False}}, {"tamper": {"how": "append_forged"}}, {"explain": {"id": "report:r1"}, "expect": {"integrity": "unverified", "integrity_reason_contains": "still verifies"}}]),
    case(
        "approvals-bound-to-policy", "approvals-bound-to-policy", {"batch": ANNA_CHANGED, "first": ANNA, "other": CONTRACT | {"name": "stricter", "require_gap_slug": False}},
        [APPLY("first"), APPLY(items={"report:r1": "held"}), {"ingest": {"file": "batch", "schema": "other"}, "expect": {"items": {"report:r1": "held"}}}, {"approve": {"all": True}, "expect": {"ambiguous": True}}, {"approve": {"all": True, "schema": "contract", "bind_schema": True}, "expect": {"granted": ["report:r1"]}}, {"ingest": {"file": "batch", "schema": "other", "apply": True}, "expect": {"items": {"report:r1": "held"}}}, APPLY(items={"report:r1": "supersede"})],
    ),
    case("approval-partial", "approvals-bound-to-policy", {"batch": batch({"report": [report("a", "x", topic="crane.fault"), report("b", "y")], "pilot": [{"key": "p"}]})}, [APPLY(items={"report:a": "held", "report:b": "create"}), {"approve": {"items": ["a", "b", "zz"]}, "expect": {"granted": ["report:a"], "unmatched": ["b", "zz"]}}]),
    case("composite-identity", "composite-identity", {"batch": batch({"report": [report("same", "x")], "pilot": [{"key": "same", "rank": "first"}]}), "changed": batch({"pilot": [{"key": "same", "rank": "second"}]})}, [APPLY(applied={"created": 2}), APPLY("changed", items={"pilot:same": "blocked"}, message_contains="not supersedable"), {"explain": {"id": "report:same"}, "expect": {"revision": 1, "versions": 0}}]),
    case("scoped-identity", "composite-identity", {"batch": ANNA | {"port": "north"}, "second": ANNA_CHANGED | {"scope": "south"}}, [APPLY(applied={"created": 1}), APPLY("second", items={"report:r1": "create"}), {"explain": {"id": "report:r1", "scope": "south"}, "expect": {"revision": 1, "exists": True}}], SCOPED),
    case("protected-nodes", "protected-nodes", {"batch": batch({"report": [report("r1", "Anna waits", protected=True)]}), "changed": batch({"report": [report("r1", "Anna left", supersede=True)]})}, [APPLY(), {"ingest": {"file": "changed", "apply": True, "owner": "stranger"}, "expect": {"items": {"report:r1": "blocked"}, "message_contains": "protected"}}, APPLY("changed", items={"report:r1": "supersede"})]),
    case(
        "schema-validation", "schema-validation", {"a": CONTRACT | {"identity": "none"}, "b": CONTRACT | {"node_kinds": {"report": {"vocab_fields": {"t": "absent"}, "refs": {"x": "ghost"}}}}, "c": CONTRACT | {"node_kinds": {"report": {"content_fields": ["supersede"], "claim_slot": ["x"], "near_duplicate_threshold": 2}}}, "d": CONTRACT | {"node_kinds": {}}},
        [{"validate_schema": {}, "expect": {"valid": True}}, {"validate_schema": {"schema": "a"}, "expect": {"valid": False, "errors_contains": "identity"}}, {"validate_schema": {"schema": "b"}, "expect": {"valid": False, "errors_contains": ["unknown vocabulary", "unknown target kind"]}}, {"validate_schema": {"schema": "c"}, "expect": {"valid": False, "errors_contains": ["reserved", "claim_field", "near_duplicate_threshold"]}}, {"validate_schema": {"schema": "d"}, "expect": {"valid": False}}],
    ),
    case(
        "domain-checks", "domain-checks",
        {"contract": CONTRACT | {"checks": ["pack.py:RULES"]}, "shadow": CONTRACT | {"checks": ["pack.py:SHADOW"]}, "missing": CONTRACT | {"checks": ["nowhere.py:RULES"]}, "batch": batch({"report": [report("a", "x"), report("b", "y", review_after="2026-01-01"), report("c", "z", review_after="2027-01-01")]}),
         "pack.py": "from lorekeep.domain_rules import review_date_set\nRULES = [('review_date_set', review_date_set)]\nSHADOW = [('collision', review_date_set)]\n"},
        [{"ingest": {"file": "batch", "today": "2026-06-01"}, "expect": {"items": {"report:a": "blocked", "report:b": "held", "report:c": "create"}, "checks_fired": ["review_date_set"]}}, {"validate_schema": {"schema": "shadow"}, "expect": {"valid": False, "errors_contains": "shadow"}}, {"validate_schema": {"schema": "missing"}, "expect": {"valid": False, "errors_contains": "no file"}}],
    ),
]
