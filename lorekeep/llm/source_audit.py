"""How far the sources of each language diverge in the terms that they use.

A language keeps the terms of at least three of its documents.  A group is a source within a language, and a
kept term's share in a group of N term occurrences, with V kept terms, is
``p = 1 + floor(1000000000 * (count + 1) / (N + V))``; ``f(p, q) = floor((p - q) * (p - q) / q)``.

Terms whose counts agree in every source are one column of counts.  A column is named by an order-free
128-bit digest of its (source, count) entries, so that none is ever collected, and stands with its number of
terms.  A pair of sources is evaluated once for each distinct column that both occur in; what a column adds
where one of the two, or neither, occurs depends on one count at most, and comes from the histogram of counts
of each group:

    sum over terms of f = sum over columns with both of m * [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)]
                        + sum over counts of group 1 of m * f(p, q0) + sum over counts of group 2 of m * f(p0, q)
                        + (V - terms of group 1 - terms of group 2) * f(p0, q0)

with p0 and q0 the shares of a count of 0.  Everything is integers, and exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import cut, kept_until_done, map_arrow, raw_texts

#: ASCII bytes outside of terms become spaces, A-Z become a-z; bytes of other characters stay.
TO_TERMS = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))


def terms_of(text: bytes, most_bytes: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists from about ``most_bytes`` of text each."""
    plain, begin = text.translate(TO_TERMS), 0
    while len(plain) - begin > most_bytes and (end := plain.find(b" ", begin + most_bytes)) >= 0:
        yield plain[begin:end].split()
        begin = end
    yield plain[begin:].split()


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str, kept_terms: int = 200_000) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term, added up within tasks; and a
    row without term for every group.  A task holds about ``kept_terms`` terms at a time."""
    names = ["lang", "source", "term", "n", "docs"]

    def flushed(held: dict[tuple[bytes, bytes], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (found, within) in held.items():
            terms = list(found)
            for i in range(0, len(terms) + 1, 20_000):
                some = terms[i : i + 20_000]
                group = lambda x: pa.array([x], pa.binary()).cast(pa.string()).take(pa.array([0] * (len(some) + (i == 0)), pa.int32()))  # noqa: E731, B023
                none = [None] if i == 0 else []
                columns = [pa.array(some + none, pa.binary()).cast(pa.string()), pa.array([found[t] for t in some] + [0] * len(none), pa.int64()), pa.array([within[t] for t in some] + [0] * len(none), pa.int64())]
                yield pa.RecordBatch.from_arrays([group(lang), group(source), *columns], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
        new = 0
        for batch in batches:
            for text, lang, source in zip(*(raw_texts(batch.column(i)) for i in range(3)), strict=True):
                found, within = held.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(found), set()
                for terms in terms_of(text):
                    found.update(terms)
                    own.update(terms)
                within.update(own)
                new += len(found) - before
                if new > kept_terms:
                    yield from flushed(held)
                    held, new = {}, 0
        yield from flushed(held)

    partial = map_arrow(docs.select(F.col(text_col), F.col(lang_col), F.col(source_col)), work, "lang string, source string, term string, n bigint, docs bigint")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(1000000000 * (count + 1) / (total + kept)), in decimals, which hold any count."""
    return F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(1_000_000_000), (total + kept).cast("decimal(20,0)")) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every (lang, source) group that occurs.

    Part ``pair``: the other sources of the language, by the divergence of the group from them, all ranks.
    Part ``term``: the kept terms that the group uses more than its language does, by their divergence, the
    first ``top_terms`` ranks.  Of equal values the item of smaller bytes comes first.  Null texts,
    languages and sources count as empty; a document is a row, so repeated rows count as often as they occur;
    a language without kept terms has pairs of value 0; an empty table gives no rows.  Other columns are
    not read.  Values fit a long up to about 10^9 kept terms a language.
    """
    with kept_until_done(docs.sparkSession) as keep:
        counts = keep(term_counts(docs, text_col, lang_col, source_col))
        term, order = Window.partitionBy("lang", "term"), Window.partitionBy("lang", "source")
        digests = [F.bit_xor(F.xxhash64(F.lit(seed), "source", "n")).over(term).alias(f"digest_{seed}") for seed in (1, 2)]
        entries = counts.where("term is not null").select("lang", "term", "source", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("total"), (F.min("source").over(term) == F.col("source")).alias("leads"), *digests)
        entries = keep(entries.where(F.col("docs") >= least_docs).drop("docs"))
        column = ["lang", "digest_1", "digest_2", "total"]
        columns = entries.groupBy(*column, "source").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("m"), F.max("leads").alias("leads"))
        columns = keep(columns)

        used = columns.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("words"), F.sum("m").alias("terms"))
        by_lang = columns.groupBy("lang").agg(F.sum(F.col("n") * F.col("m")).alias("lang_words"), F.sum(F.when(F.col("leads"), F.col("m")).otherwise(0)).alias("kept"))
        groups = counts.where("term is null").select("lang", "source").join(used, ["lang", "source"], "left").join(by_lang, "lang", "left")
        groups = keep(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("words", "terms", "lang_words", "kept")]))

        shared = groups.where("kept > 0").withColumn("p0", share(F.lit(0), F.col("words"), F.col("kept")))
        sized = columns.join(shared, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("words"), F.col("kept")))
        left = sized.select(*column, F.col("source").alias("one"), "m", "p", "p0")
        right = sized.select(*column, F.col("source").alias("two"), F.col("p").alias("q"), F.col("p0").alias("q0"))
        f = lambda x, y: divergence(F.col(x), F.col(y))
        both = left.join(right, column).where("one <> two").groupBy("lang", "one", "two").agg(F.sum(F.col("m") * (f("p", "q") - f("p", "q0") - f("p0", "q") + f("p0", "q0"))).alias("value"))
        counted = sized.groupBy("lang", "source", "p", "p0").agg(F.sum("m").alias("m"))
        other = shared.select("lang", F.col("source").alias("other"), F.col("p0").alias("other0"))
        met = counted.join(other, "lang").where("source <> other")
        first = met.groupBy("lang", F.col("source").alias("one"), F.col("other").alias("two")).agg(F.sum(F.col("m") * f("p", "other0")).alias("value"))
        second = met.groupBy("lang", F.col("other").alias("one"), F.col("source").alias("two")).agg(F.sum(F.col("m") * f("other0", "p")).alias("value"))
        sides = groups.select("lang", F.col("source").alias("one"), "kept", "terms", "words"), groups.select("lang", F.col("source").alias("two"), F.col("terms").alias("other_terms"), F.col("words").alias("other_words"))
        pairs = sides[0].join(sides[1], "lang").where("one <> two")
        none = divergence(share(F.lit(0), F.col("words"), F.col("kept")), share(F.lit(0), F.col("other_words"), F.col("kept")))
        neither = pairs.select("lang", "one", "two", F.when(F.col("kept") > 0, (F.col("kept") - F.col("terms") - F.col("other_terms")) * none).otherwise(0).alias("value"))
        summed = both.unionByName(first).unionByName(second).unionByName(neither).groupBy("lang", F.col("one").alias("source"), F.col("two").alias("item"))
        summed = summed.agg(F.sum(F.col("value").cast("decimal(20,0)")).cast("bigint").alias("value"))
        by_value = order.orderBy(F.desc("value"), F.asc("item"))
        ranked = summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))

        whole = entries.join(shared.select("lang", "source", "words", "lang_words", "kept"), ["lang", "source"])
        valued = whole.select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("words"), F.col("kept")).alias("p"), share(F.col("total"), F.col("lang_words"), F.col("kept")).alias("q")).where("p > q")
        terms = valued.select("lang", "source", F.lit("term").alias("part"), "item", f("p", "q").alias("value")).withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top_terms)
        return cut(ranked.unionByName(terms.select(*ranked.columns)))
