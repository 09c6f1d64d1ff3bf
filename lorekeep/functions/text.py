"""Column functions over keys, claims and slugs.  All run inside code generation; none is a UDF."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep.functions import lexicon as L


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def composite_id(kind: Column, key: Column) -> Column:
    return F.concat(kind, F.lit(":"), key)


def id_kind(composite: Column) -> Column:
    """Up to the first colon; keys may hold more of them."""
    return F.substring_index(composite, ":", 1)


def id_key(composite: Column) -> Column:
    return F.substr(composite, F.length(id_kind(composite)) + 2)


# ---------------------------------------------------------------- keys
@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Unicode's full case folding, from Python's own data: characters that fold to one other, what to, and those that fold to several."""
    found = {chr(c): chr(c).casefold() for c in range(0x110000) if not 0xD800 <= c < 0xE000}
    found = {c: f for c, f in found.items() if c != f}
    single = {c: f for c, f in found.items() if len(f) == 1}
    return "".join(single), "".join(single.values()), {c: f for c, f in found.items() if len(f) > 1}


def casefold(text: Column) -> Column:
    """Full case folding.  Texts of ASCII alone take the cheap way, and only those with a character that expands the long one."""
    one, to, expanding = _folds()
    folded = F.translate(text, one, to)
    pairs = F.array(*[F.struct(F.lit(c).alias("of"), F.lit(f).alias("to")) for c, f in expanding.items()])
    spread = F.aggregate(pairs, folded, lambda x, p: F.replace(x, p["of"], p["to"]))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).when(F.rlike(text, F.lit(f"[{''.join(expanding)}]")), spread).otherwise(folded)


def normal_key(key: Column) -> Column:
    """Case folded, punctuation to spaces, single spaces, stripped."""
    folded = casefold(F.coalesce(key, F.lit("")))
    return strip(F.regexp_replace(F.regexp_replace(folded, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def key_entropy(normal: Column) -> Column:
    """Shannon entropy in bits of the characters other than spaces; 0 for none."""
    chars = F.replace(normal, F.lit(" "), F.lit(""))
    each = F.split(chars, "", -1)
    letters = F.filter(each, lambda c: c != "")
    total = F.size(letters).cast("double")
    share = lambda c: F.size(F.filter(letters, lambda x: x == c)) / total
    bits = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return F.when(F.length(chars) == 0, F.lit(0.0)).otherwise(bits)


def is_comparable(normal: Column) -> Column:
    """Whether a key says enough for similarity to mean anything."""
    words = F.size(F.split(normal, " "))
    short = (F.length(normal) < L.LEAST_KEY_CHARS) & (words < L.LEAST_KEY_WORDS)
    return (normal != "") & ~short & (key_entropy(normal) >= L.LEAST_KEY_ENTROPY)


def trigrams(normal: Column) -> Column:
    """Distinct trigrams of the key without spaces; a shorter key is its own only element."""
    dense = F.replace(normal, F.lit(" "), F.lit(""))
    n = F.length(dense)
    long = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substr(dense, i, F.lit(3))))
    return F.when(n >= 3, long).when(n > 0, F.array(dense)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two sets (arrays without repeats); null where both are empty."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def similarity(normal_a: Column, normal_b: Column, grams_a: Column, grams_b: Column) -> Column:
    empty = (F.size(grams_a) == 0) | (F.size(grams_b) == 0)
    return F.when(empty, (normal_a == normal_b).cast("double")).otherwise(jaccard(grams_a, grams_b))


def block_key(normal: Column) -> Column:
    return F.substring(normal, 1, L.BLOCK_CHARS)


# ---------------------------------------------------------------- claims
def claim_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def content_tokens(tokens: Column) -> Column:
    return F.filter(F.array_except(F.array_distinct(tokens), strings(L.CLAIM_STOP_WORDS)), lambda t: F.length(t) > 1)


def overlap(content_a: Column, content_b: Column) -> Column:
    empty = (F.size(content_a) == 0) | (F.size(content_b) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(jaccard(content_a, content_b))


def negations(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(L.NEGATORS)))


def antonyms_map() -> Column:
    index: dict[str, list[str]] = {}
    for a, b in L.ANTONYMS:
        index.setdefault(a, []).append(b)
        index.setdefault(b, []).append(a)
    return F.create_map(*[x for word, others in index.items() for x in (F.lit(word), strings(sorted(others)))])


def antonym_hit(content_a: Column, content_b: Column) -> Column:
    """The first word (in order) of a but not b with an antonym in b, and the first such antonym; null if none."""
    index = antonyms_map()
    hits = F.transform(
        F.array_sort(F.array_except(content_a, content_b)),
        lambda t: F.struct(t.alias("word"), F.array_min(F.array_intersect(F.coalesce(index[t], F.array().cast("array<string>")), content_b)).alias("antonym")),
    )
    return F.get(F.filter(hits, lambda h: h["antonym"].isNotNull()), F.lit(0))


def antonym_words(content: Column) -> Column:
    """Those words that have an antonym: ``antonym_hit`` of two claims reads no others."""
    return F.filter(content, lambda w: w.isin(sorted({w for pair in L.ANTONYMS for w in pair})))


def antonym_bits(content: Column, partners: bool = False) -> Column:
    """One bit for each side of an antonym pair that a claim holds (or, with ``partners``, that the words it
    holds are antonyms of): two claims can only oppose each other if one's bits meet the other's partner bits."""
    bits: dict[str, int] = {}
    for i, (a, b) in enumerate(L.ANTONYMS):
        for word, own in ((a, 2 * i), (b, 2 * i + 1)):
            bits[word] = bits.get(word, 0) | 1 << (own ^ 1 if partners else own)
    index = F.create_map(*[x for word, mask in bits.items() for x in (F.lit(word), F.lit(mask).cast("bigint"))])
    return F.aggregate(F.filter(content, lambda w: w.isin(list(bits))), F.lit(0).cast("bigint"), lambda seen, w: seen.bitwiseOR(index[w]))


def detector(overlapping: Column, negated_a: Column, negated_b: Column, hit: Column) -> Column:
    """``negation_mismatch``, ``antonym_pair`` or null; claims must overlap first."""
    return F.when(overlapping < L.OVERLAP_FLOOR, F.lit(None)).when((negated_a > 0) != (negated_b > 0), F.lit("negation_mismatch")).when(hit.isNotNull(), F.lit("antonym_pair"))


def pair_key(left: Column, right: Column, slot: Column) -> Column:
    return F.concat_ws("|", F.least(left, right), F.greatest(left, right), F.coalesce(slot, F.lit("")))


# ---------------------------------------------------------------- gap slugs
def slug_problems(slug: Column, scope: Column) -> Column:
    """Codes of what is wrong with a gap slug; empty if it can be used as a join key.

    malformed (then nothing else), names_nothing or filler, names_scope.
    """
    words = F.split(slug, "-")
    scope_words = F.filter(F.split(F.lower(F.coalesce(scope, F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) > 2)
    naming = F.when(slug.isin(*L.NON_NAMING_SLUGS), F.lit("names_nothing")).when(F.forall(words, lambda w: F.array_contains(strings(L.SLUG_FILLER), w)), F.lit("filler"))
    found = F.array(naming, F.when(F.arrays_overlap(scope_words, words), F.lit("names_scope")))
    return F.when(~F.rlike(slug, F.lit(L.GAP_SLUG)), F.array(F.lit("malformed"))).otherwise(F.array_compact(found))


# ---------------------------------------------------------------- items
def as_list(value: Column) -> Column:
    """A JSON list as its elements, anything else as one; elements that are objects give their ``key``."""
    parsed = F.when(F.startswith(value, F.lit("[")), F.from_json(value, "array<string>"))
    elements = F.coalesce(parsed, F.array(value))
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.transform(elements, lambda x: F.when(F.startswith(x, F.lit("{")), F.get_json_object(x, "$.key")).otherwise(x)))


def slot_value(fields: Column, slot_fields: Column) -> Column:
    """``field=value`` joined by ``&``; lists sorted and joined by ``|``; empty for null."""
    one = lambda f: F.concat(f, F.lit("="), F.coalesce(F.array_join(F.array_sort(as_list(fields[f])), "|"), F.lit("")))
    return F.when(F.size(slot_fields) > 0, F.array_join(F.transform(slot_fields, one), "&")).otherwise(F.lit(""))


def content_changed(new: Column, old: Column, content_fields: Column) -> Column:
    """Whether any content field differs, white space at the ends apart; null and empty are alike."""
    clean = lambda m, f: strip(F.coalesce(m[f], F.lit("")))
    return F.exists(content_fields, lambda f: clean(new, f) != clean(old, f))
