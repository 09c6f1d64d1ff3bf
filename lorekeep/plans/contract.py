"""The governance contract: kinds, controlled vocabularies, and the rules on the contract itself."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lorekeep.functions import lexicon as L


@dataclass
class Term:
    name: str
    definition: str = ""
    synonyms: tuple[str, ...] = ()
    status: str = "active"
    replaced_by: str = ""
    category: str = ""
    since: str = ""
    promoted_from_gap: str = ""


@dataclass
class Vocabulary:
    """Terms of one controlled list, by name."""

    name: str
    terms: dict[str, Term]
    version: str = ""
    updated: str = ""

    @property
    def aliases(self) -> dict[str, str]:
        return {alias: t.name for t in self.terms.values() for alias in t.synonyms}

    def resolve(self, value: str) -> tuple[str | None, str]:
        """Canonical term, and how it was found: exact, synonym, deprecated or unknown."""
        term = self.terms.get(value)
        if term:
            return (term.replaced_by or value, "deprecated") if term.status == "deprecated" else (value, "exact")
        alias = self.aliases.get(value)
        return (alias, "synonym") if alias else (None, "unknown")

    def lookup(self) -> list[tuple[str, str, str, str]]:
        """Rows (vocab, value, canonical, how); a term wins over an alias of the same name."""
        rows = {alias: (self.name, alias, term, "synonym") for alias, term in self.aliases.items()}
        for name in self.terms:
            rows[name] = (self.name, name, *self.resolve(name))
        return list(rows.values())

    @staticmethod
    def parse(name: str, data: dict | None) -> Vocabulary:
        """Nested (``categories``: category to terms) or flat (``terms``, or terms at the top level)."""
        data = data or {}
        if "categories" in data:
            entries = [(c, t, spec) for c, terms in (data["categories"] or {}).items() for t, spec in (terms or {}).items()]
        else:
            flat = data.get("terms", data)
            entries = [("", t, spec) for t, spec in (flat.items() if isinstance(flat, dict) else ()) if t not in ("version", "updated")]
        text = lambda spec, key, default="": str(spec.get(key) or default)
        terms = {}
        for category, term, spec in entries:
            if isinstance(spec, dict):
                terms[term] = Term(term, text(spec, "definition"), tuple(spec.get("synonyms") or ()), text(spec, "status", "active"), text(spec, "replaced_by"), category, text(spec, "since"), text(spec, "promoted_from_gap"))
            else:
                terms[term] = Term(term, str(spec or ""), category=category)
        return Vocabulary(name, terms, str(data.get("version") or ""), str(data.get("updated") or ""))


@dataclass
class Kind:
    name: str
    key: str = "key"
    required: list[str] = field(default_factory=list)
    vocab_fields: dict[str, str] = field(default_factory=dict)
    content_fields: list[str] = field(default_factory=list)
    refs: dict[str, str] = field(default_factory=dict)
    supersedable: bool = True
    implicit_create: bool = True
    claim_field: str = ""
    claim_slot: list[str] = field(default_factory=list)
    near_duplicate_check: bool = False
    near_duplicate_threshold: float = L.SIMILARITY_FLOOR

    @staticmethod
    def parse(name: str, spec: dict | None) -> Kind:
        spec = spec or {}
        slot = spec.get("claim_slot") or []
        return Kind(
            name, spec.get("key", "key"), list(spec.get("required", [])), dict(spec.get("vocab_fields", {})), list(spec.get("content_fields", [])), dict(spec.get("refs", {})),
            bool(spec.get("supersedable", True)), bool(spec.get("implicit_create", True)), str(spec.get("claim_field") or ""), slot if isinstance(slot, list) else [slot],
            bool(spec.get("near_duplicate_check", False)), float(spec.get("near_duplicate_threshold", L.SIMILARITY_FLOOR)),
        )


@dataclass
class Contract:
    name: str
    kinds: dict[str, Kind]
    vocabularies: dict[str, Vocabulary] = field(default_factory=dict)
    scope_label: str = "scope"
    identity: str = "global"
    check_packs: tuple[str, ...] = ()
    require_gap_slug: bool = True
    base_dir: str = "."
    paths: tuple[str, ...] = ()

    @property
    def scoped(self) -> bool:
        return self.identity == "scoped"

    def partition(self, scope: str) -> str:
        """Where nodes of a scope live: their own partition, or one for all."""
        return scope if self.scoped else "*"

    @property
    def default_kind(self) -> str:
        """The kind of an unmapped item that names none: the first with a controlled field."""
        return next((k.name for k in self.kinds.values() if k.vocab_fields), next(iter(self.kinds), "node"))

    @staticmethod
    def load(path: str | Path) -> Contract:
        import yaml  # an optional part of the environment: only files need it

        path = Path(path)
        data = yaml.safe_load(path.read_text()) or {}
        places = {name: path.parent / where for name, where in (data.get("vocabularies") or {}).items()}
        return Contract(
            data.get("name", path.stem),
            {k: Kind.parse(k, spec) for k, spec in (data.get("node_kinds") or {}).items()},
            {name: Vocabulary.parse(name, yaml.safe_load(p.read_text())) for name, p in places.items()},
            data.get("scope_label", "scope"),
            str(data.get("identity", "global")),
            tuple(data.get("checks") or ()),
            bool(data.get("require_gap_slug", True)),
            str(path.parent),
            (str(path), *sorted(map(str, places.values()))),
        )

    def fingerprint(self) -> str:
        """SHA-256 over the contract's and its vocabularies' bytes: what approvals are bound to."""
        digest = hashlib.sha256()
        for path in self.paths:
            digest.update(Path(path).read_bytes() if Path(path).exists() else path.encode())
        return digest.hexdigest()

    def problems(self, load_packs: bool = True) -> list[str]:
        """What is wrong with the contract itself; empty if it can govern."""
        out = []
        if self.identity not in ("global", "scoped"):
            out.append(f"identity is {self.identity!r}; it must be 'global' or 'scoped'")
        if not self.kinds:
            out.append("no node_kinds are defined")
        for kind in self.kinds.values():
            at = f"kind '{kind.name}'"
            if ":" in kind.name:
                out.append(f"{at}: a kind name must not contain ':'")
            if not kind.key:
                out.append(f"{at}: no key field")
            out += [f"{at}: vocab_field '{f}' names the unknown vocabulary '{v}'" for f, v in kind.vocab_fields.items() if v not in self.vocabularies]
            out += [f"{at}: ref '{f}' names the unknown target kind '{t}'" for f, t in kind.refs.items() if t not in self.kinds]
            taken = sorted(set(L.RESERVED_FIELDS) & {*kind.required, *kind.content_fields})
            if taken:
                out.append(f"{at}: reserved control field names are used: {taken}")
            if kind.claim_field and kind.claim_field not in kind.content_fields:
                out.append(f"{at}: claim_field '{kind.claim_field}' is not in content_fields, so a change of it would never be seen")
            if kind.claim_slot and not kind.claim_field:
                out.append(f"{at}: a claim_slot needs a claim_field to compare")
            if not 0 < kind.near_duplicate_threshold <= 1:
                out.append(f"{at}: near_duplicate_threshold must be in (0, 1], not {kind.near_duplicate_threshold}")
        for vocabulary in self.vocabularies.values():
            at = f"vocabulary '{vocabulary.name}'"
            if not vocabulary.terms:
                out.append(f"{at}: it has no terms")
            out += [f"{at}: '{a}' is a canonical term and also a synonym of '{t}'" for a, t in vocabulary.aliases.items() if a in vocabulary.terms]
            for term in vocabulary.terms.values():
                if term.status == "deprecated" and term.replaced_by and term.replaced_by not in vocabulary.terms:
                    out.append(f"{at}: '{term.name}' is replaced_by '{term.replaced_by}', which is no term of it")
                if term.status not in ("active", "deprecated"):
                    out.append(f"{at}: '{term.name}' has the unknown status '{term.status}'")
        if load_packs and self.check_packs:
            from lorekeep.plugins import load_packs as load

            try:
                load(self.check_packs, self.base_dir)
            except Exception as problem:  # whatever a pack raises makes the contract unusable
                out.append(f"checks: {problem}")
        return out

    # ---------------------------------------------------------------- as small tables
    def kind_rows(self, spark: SparkSession) -> DataFrame:
        """One row a kind, with everything a check needs to know of it."""
        rows = [
            (k.name, k.key, k.required, k.content_fields, sorted(k.vocab_fields), k.supersedable, k.implicit_create, k.claim_field, k.claim_slot, k.near_duplicate_check, k.near_duplicate_threshold)
            for k in self.kinds.values()
        ]
        return spark.createDataFrame(
            rows,
            "kind string, key_field string, required array<string>, content_fields array<string>, vocab_fields array<string>, supersedable boolean, implicit_create boolean, claim_field string, claim_slot array<string>, near_duplicate_check boolean, near_duplicate_threshold double",
        )

    def vocab_field_rows(self, spark: SparkSession) -> DataFrame:
        rows = [(k.name, f, v) for k in self.kinds.values() for f, v in k.vocab_fields.items() if v in self.vocabularies]
        return spark.createDataFrame(rows, "kind string, field string, vocab string")

    def ref_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k.name, f, t) for k in self.kinds.values() for f, t in k.refs.items()], "kind string, field string, target_kind string")

    def lookup_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([r for v in self.vocabularies.values() for r in v.lookup()], "vocab string, value string, canonical string, how string")
