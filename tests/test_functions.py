from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import text as X
from lorekeep.operators import approvals, audit_chain, gaps, similarity
from lorekeep.plans.contract import Vocabulary
from lorekeep.sources.audit_log import entry_hash
from lorekeep.sources.batches import canonical


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b", "score"), [("Acme Robotics", "Acme Robotics, Inc.", 0.7692), ("Northwind Analytics", "Northwind Analytic", 0.9375), ("Portland, OR", "Portland, ME", 0.6), ("Q3 Report", "Q4 Report", 0.5), ("Globex", "Globex Corporation", 0.2667)])
def test_published_similarities(spark, a, b, score):
    na, nb = (X.normal_key(F.lit(x)) for x in (a, b))
    assert round(one(spark, X.similarity(na, nb, X.trigrams(na), X.trigrams(nb))), 4) == score


@pytest.mark.parametrize(("key", "good"), [("ACME", False), ("Q3", False), ("US", False), ("aaaaaa", False), ("ab", False), ("", False), ("Q3 Report", True), ("Straße 12", True), ("Nordic", True)])
def test_comparable(spark, key, good):
    assert one(spark, X.is_comparable(X.normal_key(F.lit(key)))) is good


def test_keys(spark):
    assert one(spark, X.normal_key(F.lit("  Élan—Vital,  Inc. "))) == "élan vital inc"
    assert abs(one(spark, X.key_entropy(F.lit("acme robotics"))) - 3.2516) < 1e-4 and one(spark, X.key_entropy(F.lit("aabc"))) == 1.5
    assert one(spark, X.id_key(F.lit("kind:a:b"))) == "a:b" and one(spark, X.id_key(F.lit("bare"))) == ""


@pytest.mark.parametrize(
    ("slug", "problems"),
    [("effective-size-proxy", []), ("a-b", []), ("Bad_Slug", ["malformed"]), ("one", ["malformed"]), ("a-b-c-d-e-f-g", ["malformed"]), ("no-tag", ["names_nothing"]), ("the-thing", ["filler"]), ("north-quay-noise", ["names_scope"])],
)
def test_slugs(spark, slug, problems):
    assert one(spark, X.slug_problems(F.lit(slug), F.lit("North Port"))) == problems


@pytest.mark.parametrize(
    ("a", "b", "found"),
    [
        ("The buyer has budget this year", "The buyer has no budget this year", "negation_mismatch"),
        ("the buyer has no budget", "procurement runs through a co-op", None),
        ("The gate is open today", "The gate is closed today", "antonym_pair"),
        ("The gate is open today", "The gate is open today", None),
        ("", "no", None),
    ],
)
def test_detector(spark, a, b, found):
    ta, tb = X.claim_tokens(F.lit(a)), X.claim_tokens(F.lit(b))
    ca, cb = X.content_tokens(ta), X.content_tokens(tb)
    assert one(spark, X.detector(X.overlap(ca, cb), X.negations(ta), X.negations(tb), X.antonym_hit(ca, cb))) == found


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(2)
    stems = ["nordic carrier", "harbour pilot", "northern light", "lisboa trade"]
    keys = sorted({f"{r.choice(stems)}{r.choice(['', ' inc', ' ltd', 's', ' one', ' two'])}{r.choice(['', '.', ' x1', ' x2'])}" for _ in range(80)})

    def grams(k):
        n = " ".join("".join(c if c.isalnum() else " " for c in k).split())
        return n, {n.replace(" ", "")[i : i + 3] for i in range(len(n.replace(" ", "")) - 2)}

    wanted = set()
    for i, a in enumerate(keys):
        for b in keys[:i]:
            (na, ga), (nb, gb) = grams(a), grams(b)
            if na != nb and na[:4] == nb[:4] and len(ga & gb) / len(ga | gb) >= 0.75:
                wanted.add((min(a, b), max(a, b)))
    frame = spark.createDataFrame([(k,) for k in keys], "key string")
    assert {(x["key"], x["other"]) for x in similarity.near_duplicates(frame, frame).collect()} == wanted and wanted


def test_vocabulary():
    v = Vocabulary.parse("t", {"terms": {"a": "first", "b": {"synonyms": ["c"], "status": "deprecated", "replaced_by": "a"}, "version": 1}})
    assert [v.resolve(x) for x in "abcd"] == [("a", "exact"), ("a", "deprecated"), ("b", "synonym"), (None, "unknown")]
    assert set(v.lookup()) == {("t", "a", "a", "exact"), ("t", "b", "a", "deprecated"), ("t", "c", "b", "synonym")}


def test_chain_breaks_like_a_walk(spark):
    r = random.Random(4)
    for _ in range(4):
        previous, rows = "0" * 64, []
        for line in range(1, 12):
            payload = canonical({"n": line, "t": "é"})
            rows.append([line, previous, entry_hash(previous, {"n": line, "t": "é"}), payload])
            previous = rows[-1][2]
        for _ in range(r.randint(0, 2)):
            row, what = r.choice(rows), r.randint(1, 3)
            row[what] = r.choice([None, "x"])
        walked, before = None, "0" * 64
        for line, prev, own, payload in rows:
            if payload is None or own is None or prev is None or prev != before or one(spark, F.sha2(F.lit(prev + payload), 256)) != own:
                walked = line
                break
            before = own
        got = audit_chain.verify(spark.createDataFrame(rows, "line bigint, prev_hash string, hash string, payload string")).first()
        assert (got["broken_at"], got["entries"]) == (walked, (walked or 12) - 1)


def test_gap_support(spark):
    row = lambda slug, scope, item, means="": (slug, means, "k", item, item, scope, "s", "r", "2026-01-01", f"t{item}")
    rows = spark.createDataFrame([row("a-b", "x", str(i), f"m{i}") for i in range(9)] + [row("c-d", "x", "1"), row("c-d", "y", "2"), row("e-f", "", "1"), row("e-f", "z", "2")], gaps.OBSERVATION)
    found = gaps.aggregate(rows)
    assert {r["slug"]: (r["independent"], r["observations"], r["means"]) for r in found.collect()} == {"a-b": (1, 9, "m8"), "c-d": (2, 2, ""), "e-f": (1, 2, "")}
    assert [r["slug"] for r in gaps.promotable(found).collect()] == ["c-d"] and gaps.ranked(found).first()["slug"] == "c-d"
    resolved = spark.createDataFrame([("c-d", "promoted", "t", "", "", "")], gaps.RESOLUTION)
    assert [r["slug"] for r in gaps.known_gaps(gaps.aggregate(rows, resolved)).collect()] == ["a-b", "e-f"]


def test_approvals(spark):
    heads = spark.createDataFrame([("p1", "c", "s", "t1"), ("p2", "c", "s", "t3")], "run_id string, content_hash string, schema_hash string, created_ts string")
    rows = [("p1", "a", "t2", "c", "s"), ("p1", "b", "t2", None, "other"), ("p1", "d", "t2", None, None), ("p1", "late", "t4", "c", "s"), ("p2", "e", "t4", "", "")]
    given = spark.createDataFrame(rows, "run_id string, id string, ts string, against_content string, against_schema string")
    ids = lambda found: {r["id"] for r in found.collect()}
    assert ids(approvals.approved(heads, given)) == {"a", "d", "late", "e"} and ids(approvals.approved(heads, given, compat=True)) == {"a", "d", "e"}
    assert ids(approvals.approved(heads.where("run_id = 'none'"), given, compat=True)) == set()
    items = spark.createDataFrame([("r", "x:1", "1", "REQUIRE_APPROVAL"), ("r", "y:1", "1", "REQUIRE_APPROVAL"), ("r", "x:2", "2", "ALLOW")], "run_id string, id string, key string, verdict string")
    named = {r["token"]: r for r in approvals.resolve_tokens(items, spark.createDataFrame([("r", t) for t in ("x:1", "1", "2", "zz")], "run_id string, token string")).collect()}
    assert named["x:1"]["id"] == "x:1" and [t for t in ("x:1", "1", "2", "zz") if named[t]["problem"]] == ["1", "2", "zz"]


def test_entropy_formula(spark):
    for key in ("mississippi", "nordic carrier 12", "zz"):
        n = Counter(key.replace(" ", ""))
        assert abs(one(spark, X.key_entropy(F.lit(key))) + sum(c / n.total() * math.log2(c / n.total()) for c in n.values())) < 1e-9


def test_casefold_of_every_character(spark):
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(points[i : i + 2000]) for i in range(0, len(points), 2000)] + ["\ufb01ne", "STRASSE Stra\u00dfe \u1e9e", "\u03a3\u0391\u03a3 \u03c3\u03b1\u03c2", "\u0130stanbul", "PLAIN"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.casefold(F.col("t")).alias("f")).collect()
    for r in got:
        assert r["f"] == texts[r["i"]].casefold(), r["i"]


def test_gaps_with_nearly_all_rows_in_one_slug(spark):
    rows = [("hot" if i % 10 else f"cold-{i % 3}", f"m{i}", f"i{i:04}", f"s{i % 400}" if i % 5 else "", "", f"t{i:04}", "") for i in range(2000)]
    frame = spark.createDataFrame(rows + rows[:50], "slug string, means string, item_id string, scope string, source string, recorded_ts string, observed_on string")
    found = {r["slug"]: r for r in gaps.aggregate(frame, most=20).collect()}
    every = rows + rows[:50]
    for slug, r in found.items():
        own = [x for x in every if x[0] == slug]
        items, scopes = sorted({x[2] for x in own}), sorted({x[3] for x in own} - {""})
        assert (r["observations"], r["n_items"], r["items"], r["n_scopes"], r["independent"], r["scopes"]) == (len(own), len(items), items[:20], len(scopes), len(scopes), scopes[:20])
        assert r["sources"] == [] and r["n_sources"] == 0 and r["means"] == max(own, key=lambda x: x[5])[1]
