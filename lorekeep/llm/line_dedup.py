"""Line dedup with keep bitmaps, in DataFrame operations only.

Line digests are range-partitioned by digest and document with a secondary sort by position, so that
even a line that every document holds is dealt over many partitions.  A window over that order, which
needs no other, streams through it and flags the first occurrence in each document; per digest only
the number of those and the largest id are gathered, partition by partition.  What goes back to the
documents is a run-length compressed bitmap of the lines to keep, never their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.lineage import pinned
from lorekeep.llm.common import SPACE_CHARS, ascii_lower, kept_until_done


def lines_of(text: Column) -> Column:
    """The text's lines; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """``id, text_key, gone``: the sorted positions of lines to drop, for documents that lose any.

    Rows that share id and text share one entry.  A null id counts as one document, smaller than
    every other.
    """
    lines = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("text_key"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    with kept_until_done(docs.sparkSession) as keep:
        # Lower-casing A-Z keeps the length, so short lines go before any of that work.
        keyed = keep(  # else the sampling for the ranges reads all texts once more
            lines.withColumn("key", F.btrim("line", F.lit(SPACE_CHARS)))
            .where(F.char_length("key") >= least_chars)
            .select(F.unhex(F.md5(ascii_lower(F.col("key")))).alias("digest"), "id", "text_key", "pos")
        )
        ranged = keyed.repartitionByRange("digest", "id").sortWithinPartitions("digest", "id", "pos")
        first = F.row_number().over(W.partitionBy("digest", "id").orderBy("pos")) == 1
        occurrences = ranged.withColumn("first", first).where("first")
        repeated = keep(  # written, so that the join below shuffles both sides and splits a line that most documents hold
            occurrences.groupBy("digest").agg(F.count("*").alias("documents"), F.max("id").alias("largest")).where(F.col("documents") >= least_docs).select("digest", "largest")
        )
        losing = keyed.join(repeated, "digest").where(~F.col("id").eqNullSafe(F.col("largest")))
        return pinned(losing.groupBy("id", "text_key").agg(F.array_sort(F.collect_set("pos")).alias("gone")))


def kept_runs(gone: Column, n_lines: Column) -> Column:
    """The bitmap of kept lines as runs (start, length), from the sorted positions of dropped ones."""
    edges = F.concat(F.array(F.lit(-1)), gone, F.array(n_lines))
    runs = F.transform(
        F.sequence(F.lit(1), F.size(edges) - 1),
        lambda i: F.struct((F.get(edges, i - 1) + 1).alias("start"), (F.get(edges, i) - F.get(edges, i - 1) - 1).alias("length")),
    )
    return F.filter(runs, lambda run: run["length"] > 0)


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3, prefix: str = "lines_") -> DataFrame:
    """``docs`` with ``<prefix>total``, ``<prefix>dropped`` and ``<prefix>keep_runs``.

    A line's key is the line without outer white space and with A-Z lower-cased.  Keys of at least
    ``least_chars`` code points that ``least_docs`` different ids hold lose their lines everywhere
    but in the largest id.  Repeats inside one document stay together.  Null or empty text is one
    empty line, which is too short to go.  All columns of ``docs`` stay, but for those with the names
    of new ones, and so does every row.
    """
    new = {f"{prefix}{x}" for x in ("total", "dropped", "keep_runs")}
    docs = docs.select(*[c for c in docs.columns if c not in new])
    gone = dropped_lines(docs, id_col, text_col, least_chars, least_docs)
    names = {c: f"__gone_{c}" for c in gone.columns}
    gone = gone.withColumnsRenamed(names)
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone["__gone_id"]) & (text_key(docs[text_col]) == gone["__gone_text_key"]), "left")
    total = F.size(lines_of(docs[text_col]))
    return joined.select(
        *[docs[c] for c in docs.columns],
        total.cast("bigint").alias(f"{prefix}total"),
        F.coalesce(F.size(gone["__gone_gone"]), F.lit(0)).cast("bigint").alias(f"{prefix}dropped"),
        F.when(gone["__gone_gone"].isNotNull(), kept_runs(gone["__gone_gone"], total)).alias(f"{prefix}keep_runs"),
    )


def kept_text(text: Column, keep_runs: Column) -> Column:
    """The kept lines joined by newlines; without a bitmap (null) the text as it is."""
    lines = lines_of(text)
    kept = F.flatten(F.transform(keep_runs, lambda run: F.slice(lines, run["start"] + 1, run["length"])))
    return F.when(keep_runs.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n"))
