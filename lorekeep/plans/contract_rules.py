"""The rules on contracts as joins and predicates, over any number of contracts; ``Contract.problems`` says the
same of one contract in words."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import lexicon as L
from lorekeep.functions import text as X
from lorekeep.plans.contract import Contract

RULES = (
    "identity", "no_kinds", "kind_name", "key_field", "unknown_vocabulary", "unknown_target", "reserved_field", "claim_field", "claim_slot", "threshold",
    "no_terms", "alias_is_term", "replacement", "term_status",
)


@dataclass
class Tables:
    """Contracts by name: ``contract`` is the first column of each."""

    contracts: DataFrame  # identity
    kinds: DataFrame  # kind, key_field, required, content_fields, claim_field, claim_slot, near_duplicate_threshold
    vocab_fields: DataFrame  # kind, field, vocab
    refs: DataFrame  # kind, field, target_kind
    vocabularies: DataFrame  # vocab
    terms: DataFrame  # vocab, term, status, replaced_by, synonyms


def tables_of(spark: SparkSession, contracts: list[Contract]) -> Tables:
    make = lambda rows, schema: spark.createDataFrame([r for c in contracts for r in rows(c)], f"contract string, {schema}")
    return Tables(
        make(lambda c: [(c.name, c.identity)], "identity string"),
        make(lambda c: [(c.name, k.name, k.key, k.required, k.content_fields, k.claim_field, k.claim_slot, float(k.near_duplicate_threshold)) for k in c.kinds.values()], "kind string, key_field string, required array<string>, content_fields array<string>, claim_field string, claim_slot array<string>, near_duplicate_threshold double"),
        make(lambda c: [(c.name, k.name, f, v) for k in c.kinds.values() for f, v in k.vocab_fields.items()], "kind string, field string, vocab string"),
        make(lambda c: [(c.name, k.name, f, t) for k in c.kinds.values() for f, t in k.refs.items()], "kind string, field string, target_kind string"),
        make(lambda c: [(c.name, v) for v in c.vocabularies], "vocab string"),
        make(lambda c: [(c.name, v.name, t.name, t.status, t.replaced_by, list(t.synonyms)) for v in c.vocabularies.values() for t in v.terms.values()], "vocab string, term string, status string, replaced_by string, synonyms array<string>"),
    )


def problems(t: Tables) -> DataFrame:
    """``contract, rule, subject``: what is wrong with which contract."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    claim = F.coalesce("claim_field", F.lit(""))
    of_kinds = {
        "kind_name": F.contains("kind", F.lit(":")),
        "key_field": blank("key_field"),
        "reserved_field": F.arrays_overlap(X.strings(L.RESERVED_FIELDS), F.concat("required", "content_fields")),
        "claim_field": (claim != "") & ~F.array_contains("content_fields", claim),
        "claim_slot": (F.size("claim_slot") > 0) & (claim == ""),
        "threshold": ~F.coalesce((F.col("near_duplicate_threshold") > 0) & (F.col("near_duplicate_threshold") <= 1), F.lit(False)),
    }
    of_terms = {"term_status": ~F.col("status").isin("active", "deprecated")}
    rows = _broken(t.kinds, of_kinds, F.col("kind")).unionByName(_broken(t.terms, of_terms, F.concat_ws(".", "vocab", "term")))
    rows = rows.unionByName(_broken(t.contracts, {"identity": ~F.col("identity").isin("global", "scoped")}, F.col("identity")))

    def missing(rule: str, asked: DataFrame, there: DataFrame, on: list[str], subject: Column) -> DataFrame:
        return asked.join(there.select(*on).distinct(), on, "left_anti").select("contract", F.lit(rule).alias("rule"), subject.alias("subject"))

    field, word = F.concat_ws(".", "kind", "field"), F.concat_ws(".", "vocab", "owner")
    terms = t.terms.select("contract", "vocab", "term")
    aliases = t.terms.select("contract", "vocab", F.col("term").alias("owner"), F.explode("synonyms").alias("term"))
    replaced = t.terms.where("status = 'deprecated' and replaced_by <> ''").select("contract", "vocab", F.col("term").alias("owner"), F.col("replaced_by").alias("term"))
    on = ["contract", "vocab", "term"]
    for found in (
        missing("no_kinds", t.contracts, t.kinds, ["contract"], F.col("contract")),
        missing("unknown_vocabulary", t.vocab_fields, t.vocabularies, ["contract", "vocab"], field),
        missing("unknown_target", t.refs, t.kinds.withColumnRenamed("kind", "target_kind"), ["contract", "target_kind"], field),
        missing("no_terms", t.vocabularies, terms, ["contract", "vocab"], F.col("vocab")),
        missing("replacement", replaced, terms, on, word),
        aliases.join(terms, on, "left_semi").select("contract", F.lit("alias_is_term").alias("rule"), word.alias("subject")),
    ):
        rows = rows.unionByName(found)
    return rows


def _broken(rows: DataFrame, rules: dict[str, Column], subject: Column) -> DataFrame:
    said = F.array_compact(F.array(*[F.when(broken, F.lit(rule)) for rule, broken in rules.items()]))
    return rows.select("contract", F.explode(said).alias("rule"), subject.alias("subject"))
