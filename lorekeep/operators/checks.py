"""The checks: queries from items, contract and the existing graph to findings.

Each check is one DataFrame of findings; a run's findings are their union.  ``check_ord`` keeps the
order in which checks count, since the first finding that suggests an action decides the hint.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import lexicon as L
from lorekeep.functions import text as X
from lorekeep.lineage import cut
from lorekeep.operators.similarity import near_duplicates
from lorekeep.plans.contract import Contract
from lorekeep.workers import ship

FINDING = "check_ord int, check string, target string, verdict int, message string, severity string, data map<string,string>, pos int"
CORE_CHECKS = (
    "date_format", "unknown_kind", "key_present", "required_fields", "vocab_membership", "key_unique_in_file", "refs_exist", "near_duplicate_key", "contradicts_ref", "implicit_create_guard",
    "collision", "protected_guard", "unmapped_review", "unmapped_gap_named",
)


@dataclass
class Batch:
    """What checks read: items (with ``fields``), the nodes that exist, the contract, and the run."""

    spark: SparkSession
    contract: Contract
    items: DataFrame
    existing: DataFrame  # kind, key, fields, is_protected, owner, status, revision
    scope: str = ""
    source: str = ""
    date: str = ""
    owner: str = ""
    run_id: str = ""
    options: dict = field(default_factory=dict)
    graph: DataFrame | None = None  # all nodes, where ``existing`` are those alone that the batch names
    met: DataFrame | None = None  # what ``collisions`` gives, where it has been worked out

    def kinds(self) -> DataFrame:
        return F.broadcast(self.contract.kind_rows(self.spark))  # a contract's size

    def known(self) -> DataFrame:
        """Items of kinds that the contract has, with that kind's row."""
        return self.items.join(self.kinds(), "kind")

    def ids(self) -> DataFrame:
        return self.existing.select("kind", "key").distinct()

    def collisions(self) -> DataFrame:
        """Items that exist, with what the checks of them read: one join, and one comparison of contents."""
        if self.met is not None:
            return self.met
        return against_existing(self.known(), self.existing).select("id", "kind", "key", "pos", "supersede", "supersedable", "changed", "old_protected", "old_owner")

    def all_ids(self) -> DataFrame:
        """Every key of the graph, for what is compared with keys that the batch doesn't name."""
        return (self.existing if self.graph is None else self.graph).select("kind", "key").distinct()

    def named(self) -> DataFrame:
        """The keys that items have, refer to, or contradict."""
        own = self.items.select("kind", "key")
        to = self.items.select(F.explode(X.as_list(F.col("fields")["contradicts"])).alias("to")).select(X.id_kind(F.col("to")).alias("kind"), X.id_key(F.col("to")).alias("key"))
        return own.unionByName(reference_rows(self).select(F.col("target_kind").alias("kind"), F.col("ref").alias("key"))).unionByName(to).distinct()

    def pending(self) -> DataFrame:
        """What a reference may point to: nodes that exist and items declared here."""
        return self.ids().unionByName(self.items.where("section = 'declare' and key is not null").select("kind", "key")).distinct()

    def unmapped(self) -> DataFrame:
        """Items without a home in the vocabulary: listed as such, or nodes with a null controlled field."""
        listed = self.items.where("section = 'unmapped'")
        null_field = F.exists("vocab_fields", lambda f: F.col("fields")[f].isNull())
        nodes = self.known().where((F.col("section") == "node") & null_field).select(*listed.columns)
        return listed.unionByName(nodes)


def found(rows: DataFrame, name: str, verdict: int | Column, message: Column, severity: str | Column | None = None, data: Column | None = None, target: Column | None = None) -> DataFrame:
    """Findings of the check ``name``, one for each row."""
    order = CORE_CHECKS.index(name) + 1 if name in CORE_CHECKS else 0 if name == "vocab_synonym_folded" else len(CORE_CHECKS) + 1
    verdict = F.lit(verdict) if isinstance(verdict, int) else verdict
    severity = F.lit(severity or "error") if not isinstance(severity, Column) else severity
    return rows.select(
        F.lit(order).alias("check_ord"), F.lit(name).alias("check"), (F.col("id") if target is None else target).alias("target"), verdict.cast("int").alias("verdict"),
        message.alias("message"), severity.alias("severity"), (F.create_map().cast("map<string,string>") if data is None else data).alias("data"), F.col("pos").cast("int").alias("pos"),
    )


def texts(*parts: str | Column) -> Column:
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])


def data_of(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


# ---------------------------------------------------------------- vocabulary
def resolve_terms(rows: DataFrame, value: Column, vocab: Column, lookup: DataFrame) -> DataFrame:
    """``rows`` with ``canonical`` and ``how`` (exact, synonym, deprecated, unknown; null for a null value)."""
    lookup = F.broadcast(lookup.select(F.col("vocab").alias("__vocab"), F.col("value").alias("__value"), "canonical", "how"))
    joined = rows.join(lookup, (vocab == F.col("__vocab")) & (value == F.col("__value")), "left")
    return joined.withColumn("how", F.when(value.isNotNull(), F.coalesce("how", F.lit("unknown")))).drop("__vocab", "__value")


def controlled_values(batch: Batch) -> DataFrame:
    """One row for each item and controlled field that has a value, resolved."""
    pairs = batch.items.join(F.broadcast(batch.contract.vocab_field_rows(batch.spark)), "kind").withColumn("value", F.col("fields")[F.col("field")]).where("value is not null")
    return resolve_terms(pairs, F.col("value"), F.col("vocab"), batch.contract.lookup_rows(batch.spark))


def synonym_rows(batch: Batch) -> DataFrame:
    """``kind, terms``: the terms that each field's synonyms stand for (a contract's size)."""
    lookup = batch.contract.lookup_rows(batch.spark).where("how = 'synonym'").select("vocab", "value", "canonical")
    named = batch.contract.vocab_field_rows(batch.spark).join(F.broadcast(lookup), "vocab")
    terms = named.groupBy("kind", "field").agg(F.map_from_entries(F.collect_list(F.struct("value", "canonical"))).alias("terms"))
    return terms.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("field", "terms"))).alias("terms"))


def with_folds(batch: Batch) -> DataFrame:
    """Items with ``changes``, the fields whose value is a synonym and their terms, or null.  Worked out row by row: neither ``pos`` nor a key
    need tell items apart."""
    terms = F.transform_values("terms", lambda f, of: of[F.col("fields")[f]])
    changes = F.map_filter(terms, lambda _, term: term.isNotNull())
    items = batch.items.join(F.broadcast(synonym_rows(batch)), "kind", "left").withColumn("changes", changes)
    return items.withColumn("changes", F.when(F.size("changes") > 0, F.col("changes"))).drop("terms")


def fold_synonyms(batch: Batch) -> tuple[DataFrame, DataFrame]:
    """Items with declared synonyms replaced by their terms, before any check; and the report of it."""
    folds = controlled_values(batch).where("how = 'synonym'")
    report = found(folds, "vocab_synonym_folded", L.ALLOW, texts(F.col("field"), "='", F.col("value"), "' folded onto the declared term '", F.col("canonical"), "' of '", F.col("vocab"), "'"), "info", data_of(field=F.col("field"), old=F.col("value"), new=F.col("canonical")))
    return changed_fields(with_folds(batch), batch.items.columns), report


def replace_fields(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Items with the string fields of ``changes`` (pos, changes: map) replaced, in ``fields`` and ``props``."""
    return changed_fields(items.join(changes, "pos", "left"), items.columns)


def changed_fields(joined: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of items with the fields of their own ``changes`` (null: none) replaced."""
    from lorekeep.sources.documents import rewritten

    ship(joined.sparkSession)
    merged = F.map_concat(F.map_filter("fields", lambda k, v: ~F.array_contains(F.map_keys("changes"), k)), F.col("changes"))
    some = F.col("changes").isNotNull()
    joined = joined.withColumn("props", rewritten(F.col("props"), F.when(some, F.to_json("changes")), F.lit(None).cast("string"), F.array().cast("array<string>")))
    return joined.withColumn("fields", F.when(some, merged).otherwise(F.col("fields"))).select(*columns)


def vocab_membership(b: Batch) -> DataFrame:
    rows = controlled_values(b).where("how in ('unknown', 'deprecated')")
    unknown = F.col("how") == "unknown"
    said = F.when(unknown, texts(F.col("field"), "='", F.col("value"), "' is not in vocabulary '", F.col("vocab"), "'; fix it, or set it to null and name the gap")).otherwise(
        texts(F.col("field"), "='", F.col("value"), "' is deprecated in '", F.col("vocab"), "', replaced by '", F.col("canonical"), "'; approve to write the replacement")
    )
    data = F.when(unknown, F.create_map().cast("map<string,string>")).otherwise(data_of(field=F.col("field"), old=F.col("value"), new=F.col("canonical")))
    return found(rows, "vocab_membership", F.when(unknown, L.BLOCK).otherwise(L.REQUIRE_APPROVAL), said, F.when(unknown, "error").otherwise("warn"), data)


# ---------------------------------------------------------------- the file's own shape
def is_date(text: Column) -> Column:
    """``YYYY-MM-DD``, one-digit months and days accepted."""
    return F.rlike(text, F.lit(r"^\d{4}-\d{1,2}-\d{1,2}$")) & F.try_to_date(text, "y-M-d").isNotNull()


def date_format(b: Batch) -> DataFrame:
    """A run whose date is none is blocked as a whole."""
    run = b.spark.createDataFrame([(b.date, 0)], "date string, pos int").where("date <> ''")
    return found(run.where(~F.coalesce(is_date(F.col("date")), F.lit(False))), "date_format", L.BLOCK, texts("the date must be YYYY-MM-DD, not '", F.col("date"), "'"), target=F.lit(L.RUN))


def unknown_kind(b: Batch) -> DataFrame:
    return found(b.items.join(b.kinds(), "kind", "left_anti"), "unknown_kind", L.BLOCK, texts("node kind '", F.col("kind"), "' is not defined in the schema"))


def key_present(b: Batch) -> DataFrame:
    return found(b.items.where("key is null or key = ''"), "key_present", L.BLOCK, texts(F.col("section"), " ", F.col("kind"), " item is missing its key"), target=F.concat("kind", F.lit(":?")))


def required_fields(b: Batch) -> DataFrame:
    rows = b.known().select("*", F.explode(F.array_except("required", "truthy")).alias("missing"))
    return found(rows, "required_fields", L.BLOCK, texts(F.col("kind"), " '", F.col("key"), "' is missing required field '", F.col("missing"), "'"))


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of two or more rows with the same non-null keys, and their number."""
    return rows.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def key_unique_in_file(b: Batch) -> DataFrame:
    rows = b.items.where("key <> ''").groupBy("kind", "key").agg(F.count("*").alias("copies"), F.max("pos").alias("pos"), F.first("id").alias("id")).where("copies > 1")
    return found(rows, "key_unique_in_file", L.BLOCK, texts("duplicate ", F.col("kind"), " key within the file: ", F.col("key")))


# ---------------------------------------------------------------- against the graph
def missing_references(refs: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """References (rows of ``refs``) whose ``on`` columns name nothing in ``targets``; one shuffled anti join."""
    return refs.join(targets.select(*on).distinct(), on, "left_anti")


#: Tasks that items without a key are dealt to.
SPREAD = 64


def absent(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Items whose ``kind`` and ``key`` are not among ``ids``.  Items whose key is null or empty are alike to a join, so they are dealt out by ``pos``;
    an id with an empty key is met by all of them."""
    deal = F.when(F.coalesce("key", F.lit("")) == "", F.pmod(F.xxhash64("pos"), F.lit(SPREAD)).cast("int")).otherwise(0)
    there = ids.select("kind", "key", F.explode(F.when(F.col("key") == "", F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))).alias("__deal"))
    return rows.withColumn("__deal", deal).join(there, ["kind", "key", "__deal"], "left_anti").select(*rows.columns)


def reference_rows(b: Batch) -> DataFrame:
    values = b.items.join(F.broadcast(b.contract.ref_rows(b.spark)), "kind")
    return values.select("*", F.explode(X.as_list(F.col("fields")[F.col("field")])).alias("ref"))


def refs_exist(b: Batch) -> DataFrame:
    targets = b.pending().select(F.col("kind").alias("target_kind"), F.col("key").alias("ref"))
    rows = missing_references(reference_rows(b), targets, ["target_kind", "ref"])
    return found(rows, "refs_exist", L.BLOCK, texts("references ", F.col("target_kind"), " '", F.col("ref"), "' which doesn't exist; declare it or fix the reference"))


def contradicts_ref(b: Batch) -> DataFrame:
    rows = b.items.select("*", F.explode(X.as_list(F.col("fields")["contradicts"])).alias("named"))
    rows = rows.withColumn("to_kind", X.id_kind(F.col("named"))).withColumn("to_key", X.id_key(F.col("named")))
    targets = b.pending().select(F.col("kind").alias("to_kind"), F.col("key").alias("to_key"), F.lit(True).alias("there"))
    rows = rows.join(targets, ["to_kind", "to_key"], "left")
    bare, own = F.col("to_key") == "", (F.col("to_kind") == F.col("kind")) & F.col("to_key").eqNullSafe(F.col("key"))
    said = F.when(bare, texts("contradicts '", F.col("named"), "' is not a composite id; use 'kind:key'")).when(own, F.lit("contradicts itself")).when(F.col("there").isNull(), texts("contradicts '", F.col("named"), "', which does not exist"))
    return found(rows.withColumn("said", said).where("said is not null"), "contradicts_ref", L.BLOCK, F.col("said"))


def implicit_create_guard(b: Batch) -> DataFrame:
    rows = absent(b.known().where("section = 'node' and not implicit_create"), b.ids())
    return found(rows, "implicit_create_guard", L.BLOCK, texts("kind '", F.col("kind"), "' is closed; a new '", F.col("key"), "' must be declared"))


def near_duplicate_key(b: Batch) -> DataFrame:
    """New keys of kinds that ask for it, against existing keys of the kind; held, never merged."""
    kinds = b.kinds().where("near_duplicate_check").select("kind", F.col("near_duplicate_threshold").alias("threshold"))
    new = b.items.where(F.col("key").isNotNull()).join(F.broadcast(kinds), "kind").join(b.ids(), ["kind", "key"], "left_anti")
    pairs = near_duplicates(new, b.all_ids().join(F.broadcast(kinds), "kind"), group_cols=("kind", "threshold"), threshold="threshold")
    rows = pairs.withColumn("id", X.composite_id(F.col("kind"), F.col("key"))).join(new.groupBy("id").agg(F.min("pos").alias("pos")), "id")
    said = texts("'", F.col("key"), "' is ", F.round(F.col("score") * 100).cast("int"), "% similar to existing ", F.col("kind"), " '", F.col("other"), "'; approve to create it apart, or reuse the existing key. Nothing is merged.")
    return found(rows, "near_duplicate_key", L.REQUIRE_APPROVAL, said, "warn", data_of(near_duplicate_of=F.col("other"), score=F.round("score", 4)))


def against_existing(items: DataFrame, existing: DataFrame) -> DataFrame:
    """Items that exist (with their kind's columns), and ``changed`` by content fields."""
    old = existing.select("kind", "key", F.col("fields").alias("old_fields"), F.col("is_protected").alias("old_protected"), F.col("owner").alias("old_owner"))
    return items.join(old, ["kind", "key"]).withColumn("changed", X.content_changed(F.col("fields"), F.col("old_fields"), F.col("content_fields")))


def collision_class(changed: Column, supersedable: Column, supersede: Column) -> Column:
    """identical, blocked, supersede or conflict."""
    return F.when(~changed, "identical").when(~supersedable, "blocked").when(supersede, "supersede").otherwise("conflict")


def collision(b: Batch) -> DataFrame:
    rows = b.collisions().withColumn("class", collision_class(F.col("changed"), F.col("supersedable"), F.col("supersede")))
    c = F.col("class")
    said = (
        F.when(c == "identical", texts("'", F.col("key"), "' is already present and unchanged"))
        .when(c == "blocked", texts("'", F.col("key"), "' exists and kind '", F.col("kind"), "' is not supersedable"))
        .when(c == "supersede", texts("'", F.col("key"), "' changed; supersede:true will version the prior belief"))
        .otherwise(texts("'", F.col("key"), "' exists with different content; set supersede:true or approve to version the prior belief"))
    )
    verdict = F.when(c == "blocked", L.BLOCK).when(c == "conflict", L.REQUIRE_APPROVAL).otherwise(L.ALLOW)
    severity = F.when(c == "identical", "info").when(c == "blocked", "error").otherwise("warn")
    data = F.when(c == "blocked", F.create_map().cast("map<string,string>")).otherwise(data_of(action=c))
    return found(rows, "collision", verdict, said, severity, data)


def protected_guard(b: Batch) -> DataFrame:
    rows = b.collisions().where((F.col("old_protected") & F.col("changed") & (F.col("old_owner") != "")) & (F.col("old_owner") != b.owner))
    return found(rows, "protected_guard", L.BLOCK, texts("'", F.col("key"), "' is protected and owned by '", F.col("old_owner"), f"'; '{b.owner}' may not overwrite it"))


# ---------------------------------------------------------------- gaps
def gap_slug(fields: Column) -> Column:
    return X.strip(F.coalesce(fields["unmapped_gap"], F.lit("")))


def unmapped_review(b: Batch) -> DataFrame:
    rows = absent(b.unmapped(), b.ids()).withColumn("gap", gap_slug(F.col("fields")))
    said = texts("'", F.col("key"), "' has no controlled-vocabulary home", F.when(F.col("gap") != "", texts(": gap '", F.col("gap"), "'")).otherwise(""), "; held for human review")
    return found(rows, "unmapped_review", L.REQUIRE_APPROVAL, said, "warn", data_of(action=F.lit("unmapped"), gap=F.col("gap")))


SLUG_MESSAGES = {
    "malformed": "must be 2-6 lowercase kebab-case words",
    "names_nothing": "names the writer's state, not the missing mechanic",
    "filler": "is made entirely of filler words and names no mechanic",
    "names_scope": "names the scope it came from, so that no second writer can reach it",
}


def unmapped_gap_named(b: Batch) -> DataFrame:
    rows = b.unmapped().withColumn("gap", gap_slug(F.col("fields")))
    problems = F.when(F.col("gap") == "", F.array(F.lit("absent"))).otherwise(X.slug_problems(F.col("gap"), F.lit(b.scope)))
    rows = rows.select("*", F.explode(problems).alias("problem"))
    messages = F.create_map(*[F.lit(x) for pair in SLUG_MESSAGES.items() for x in pair])
    said = F.when(F.col("problem") == "absent", "has no controlled-vocabulary home and no `unmapped_gap` slug; name the missing mechanic in 2-6 kebab-case words").otherwise(texts("unmapped_gap '", F.col("gap"), "': ", messages[F.col("problem")]))
    return found(rows if b.contract.require_gap_slug else rows.limit(0), "unmapped_gap_named", L.BLOCK, said)


def normalized_key_collision(b: Batch) -> DataFrame:
    """Opt-in (``options``): new keys that equal an existing key once both are normalised, which neither
    collision nor near_duplicate_key reports."""
    new = b.items.where("key is not null").join(b.ids(), ["kind", "key"], "left_anti").withColumn("normal", X.normal_key(F.col("key")))
    old = b.all_ids().select("kind", F.col("key").alias("other"), X.normal_key(F.col("key")).alias("normal"))
    return found(new.join(old, ["kind", "normal"]), "normalized_key_collision", L.REQUIRE_APPROVAL, texts("'", F.col("key"), "' is existing '", F.col("other"), "' but for case and punctuation"), "warn", data_of(near_duplicate_of=F.col("other")))


CHECKS: dict[str, Callable[[Batch], DataFrame]] = {name: globals()[name] for name in CORE_CHECKS}


def run_checks(batch: Batch, packs: list[tuple[str, Callable[[Batch], DataFrame]]] = ()) -> tuple[Batch, DataFrame]:
    """The batch with synonyms folded, and all findings; checks of domain packs come last.

    The graph is met once: what the checks read of it are the nodes that the batch names, no more rows than the batch
    has keys and references.  Only kinds that ask for near-duplicate keys are compared with keys of the whole graph, and
    packs see all of it.
    """
    items, report = fold_synonyms(batch)
    items = cut(items)  # every check reads them
    folded = replace(batch, items=items)
    state = cut(batch.existing.join(folded.named(), ["kind", "key"], "left_semi").select("kind", "key", "fields", "is_protected", "owner"))
    near = replace(folded, existing=state, graph=batch.existing)
    near = replace(near, met=cut(near.collisions()))  # two checks read it
    asked = any(k.near_duplicate_check for k in batch.contract.kinds.values())
    findings = report
    for name, check in CHECKS.items():
        if asked or name != "near_duplicate_key":
            findings = findings.unionByName(check(near))
    if batch.options.get("normalized_key_collision"):
        findings = findings.unionByName(normalized_key_collision(near))
    for i, (name, check) in enumerate(packs):
        findings = findings.unionByName(check(folded).withColumn("check_ord", F.lit(len(CORE_CHECKS) + 1 + i)).withColumn("check", F.lit(name)))
    return folded, findings
