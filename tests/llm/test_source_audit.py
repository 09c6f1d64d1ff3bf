"""The source audit against a plain evaluation of every term for every pair."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from lorekeep.llm import source_audit

PATTERN = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows: list[tuple], least: int = 3, top: int = 200) -> set[tuple]:
    """rows: (text, lang, source)."""
    within, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = [t.translate(LOWER) for t in PATTERN.findall(text or "")]
        within[lang].update(set(found))
        counts[lang, source].update(found)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in within[lang].items() if n >= least]

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 1) // (total + len(kept)) for t in kept}

        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        of = {s: shares(counts[lang, s]) for s in sources}
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pairs = [(o, sum(f(of[s][t], of[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(of[s][t], whole[t])) for t in kept if counts[lang, s][t] and of[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return set(out)


def check(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, "clash", "clash") for r in rows], "text string, lang string, source string, n int, term string, value string").repartition(3)
    got = source_audit.audit(docs, **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    have = [tuple(r) for r in got.collect()]
    assert len(have) == len(set(have)) and set(have) == plain(rows, options.get("least_docs", 3), options.get("top_terms", 200))
    return have


def test_odd_rows(spark, rows):
    """Null and empty texts, languages and sources, repeated rows, very long texts."""
    found = check(spark, [(r[1], r[2], r[3]) for r in rows])
    assert {r[2] for r in found} == {"pair", "term"} and "" in {r[0] for r in found}


def test_many_sources_and_equal_columns(spark):
    r = random.Random(5)
    words = [f"{a}{b}" for a in "abcdefghij" for b in ("x", "Y", "é", "ß", "😀")]
    rows = [(" ".join(r.choice(words) for _ in range(r.choice((0, 3, 30)))), r.choice("dé"), f"s{min(r.randrange(30), 12)}") for _ in range(400)]
    rows += [("twin1 twin2", "d", s) for s in ("s1", "s2", "s3")]  # one column of counts
    check(spark, rows)
    check(spark, rows, least_docs=1, top_terms=3)


def test_no_kept_terms_and_one_source(spark):
    have = check(spark, [("only once", "en", "b"), ("other", "en", "a"), (None, None, None), ("x " * 9, "fr", "c"), ("x", "fr", "c"), ("x", "fr", "c")])
    assert ("en", "a", "pair", "b", 0, 1) in have
    check(spark, [("1 2 3", "en", "a"), (" \n", "en", "b")])
    assert check(spark, []) == []


def test_a_language_whose_sources_share_nothing(spark):
    check(spark, [(f"{w} {w}", "en", s) for w, s in (("aa", "1"), ("bb", "2"), ("cc", "3")) for _ in range(4)] + [("", "en", "4")])


def test_long_texts_are_taken_piece_by_piece():
    text = "Ab,é  c" * 1000 + "x" * 5000 + " end"
    assert [t for some in source_audit.terms_of(text.encode(), 100) for t in some] == [t.translate(LOWER).encode() for t in PATTERN.findall(text)]


def test_held_terms_are_flushed(spark):
    rows = [(f"t{chr(97 + i % 26)}{chr(97 + i // 26)} shared", "en", f"s{i % 2}") for i in range(200)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    few = source_audit.term_counts(docs, "text", "lang", "source", kept_terms=7)
    assert sorted(map(tuple, few.collect()), key=str) == sorted(map(tuple, source_audit.term_counts(docs, "text", "lang", "source").collect()), key=str)
