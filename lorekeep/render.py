"""Text, JSON and Markdown for people."""

from __future__ import annotations

import json

from lorekeep.plans.engine import Result

GLYPHS = {"verified": "+", "unverified": "?", "invalidated": "x"}


def plan(result: Result) -> str:
    proposal = result.proposal
    if result.halted and not proposal:
        return "\n".join(["HALT: nothing was read further", *[f"  {check}: {message}" for check, message in result.halt_findings]])
    if result.schema_errors:
        return "\n".join(["the contract is invalid", *[f"  {e}" for e in result.schema_errors]])
    out = [f"run {result.run_id}"]
    groups: dict[str, list[dict]] = {}
    for item in proposal["items"]:
        groups.setdefault(item["action"], []).append(item)
    for finding in proposal["run_findings"]:
        out.append(f"  {finding['verdict']} {finding['check']}: {finding['message']}")
    for action in sorted(groups):
        out.append(f"{action} ({len(groups[action])})")
        for item in groups[action]:
            out.append(f"  {item['id']}: {item['detail']}")
            out += [f"    {f['verdict']} {f['check']}: {f['message']}" for f in item["findings"]]
    if result.applied is not None:
        out.append("applied: " + ", ".join(f"{k} {v}" for k, v in result.applied.items()))
    return "\n".join(out)


def explanation(x: dict) -> str:
    state = x["integrity"]["state"]
    out = [f"{GLYPHS[state]} {x['id']}  [{state}] {x['integrity']['reason']}"]
    if x["current"]:
        c = x["current"]
        out += [f"  revision {c['revision']}, status {c['status']}, owner {c['owner']}, since {c['valid_from']}", f"  claim: {c['claim']}"] + ([f"  note: {c['status_note']}"] if "status_note" in c else [])
        out += [f"  was (revision {v['revision']}, until {v['valid_until']}): {v['claim']}" for v in x["versions"]]
        if x["traversal"]["versions_truncated"]:
            out.append(f"  older revisions are not shown (limit {x['traversal']['version_limit']})")
        out += [f"  {e['field']} -> {e['dst_kind']}:{e['dst_key']}" for e in x["edges"]]
        out += [f"  {c['state']} {c['detector']} with {c['with']}: {c['other_side']}" for c in x["contradictions"]]
        if x["gap"]:
            out.append(f"  gap {x['gap']['slug']}: {x['gap']['reason']}")
    return "\n".join(out)


def as_json(x: object) -> str:
    return json.dumps(x, indent=2, default=str)


def table(rows: list[dict], markdown: bool = False) -> str:
    """Rows of the same keys, aligned or as a Markdown table."""
    if not rows:
        return "(none)"
    names = list(rows[0])
    cells = [[str(r[n]).replace("|", "\\|") if markdown else str(r[n]) for n in names] for r in rows]
    widths = [max(len(n), *(len(c[i]) for c in cells)) for i, n in enumerate(names)]
    line = lambda c: ("| " + " | ".join(c) + " |") if markdown else "  ".join(x.ljust(w) for x, w in zip(c, widths, strict=True)).rstrip()
    return "\n".join([line(names), line(["-" * w for w in widths] if not markdown else ["---"] * len(names)), *map(line, cells)])
