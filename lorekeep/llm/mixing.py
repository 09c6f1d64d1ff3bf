"""Mixing sources to target weights.

Tokens are counted per source; the targets follow in closed form from one sorted pass over the
sources; each document is then taken floor(rate) times plus once more with the probability of the
fraction, decided by a hash of its own content, so that reruns and retried tasks agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.llm.common import WORD_PATTERN, cut

#: Bytes of sources and targets sent to every task.
MOST_BROADCAST = 8 << 20


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most_repeats: float = 3) -> DataFrame:
    """``source, source_size, target`` from rows of (source, size).

    Sources in code-point order, null last, weigh ``weights`` in turn.  Targets share the total by
    weight but stop at ``most_repeats`` times the source's size; the excess is shared anew until
    none is above.  A source is full once a level L (tokens per unit of weight) reaches
    ``most_repeats * size / weight``, so one pass in order of that bound finds the final level.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(x)) for x in weights]), rank % len(weights))
    full = F.col("source_size") * float(most_repeats)
    ranked = by_source.withColumn("weight", weight).withColumn("full", full).withColumn("bound", F.col("full") / F.col("weight"))
    before = W.orderBy("bound", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levelled = ranked.withColumn("level", rest / weight_left)
    final = F.min_by("level", F.when(F.col("level") <= F.col("bound"), F.col("bound"))).over(whole)
    target = F.least(F.col("full"), F.coalesce(final, F.lit(float("inf"))) * F.col("weight"))
    return levelled.select("source", "source_size", target.alias("target"))


def draw(seed: str, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from a hash of seed, id and text: 48 bits of an MD5."""
    content = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(content), 1, 12), 16, 10).cast("bigint") / F.lit(float(2**48))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), most_repeats: float = 3, seed: str = "mix", prefix: str = "mix_"
) -> DataFrame:
    """``docs`` with ``<prefix>size``, ``<prefix>source_size``, ``<prefix>target`` and ``<prefix>copies``.

    Every row stays, with the number of copies that the mix takes of it (0 to ``most_repeats``).
    Null texts have size 0; null is a source of its own; a mix without any words takes no copies.
    Repeated rows draw alike.  Columns of ``docs`` with the names of new ones go.  An empty table gives
    an empty result.
    """
    new = {f"{prefix}{x}" for x in ("size", "source_size", "target", "copies")}
    sized = docs.select(*[c for c in docs.columns if c not in new]).withColumn(f"{prefix}size", token_count(F.col(text_col)))
    targets = cut(source_targets(sized.select(F.col(source_col).alias("source"), F.col(f"{prefix}size").alias("size")), weights, most_repeats))
    if (targets.agg(F.sum(F.lit(40) + F.coalesce(F.octet_length("source"), F.lit(0)))).first()[0] or 0) <= MOST_BROADCAST:  # else a shuffled join, whose hot sources adaptive execution splits
        targets = F.broadcast(targets)
    targets = targets.withColumnsRenamed({c: f"__targets_{c}" for c in targets.columns})
    joined = sized.join(targets, sized[source_col].eqNullSafe(targets["__targets_source"]))
    rate = F.when(F.col("__targets_source_size") > 0, F.least(F.col("__targets_target") / F.col("__targets_source_size"), F.lit(float(most_repeats)))).otherwise(0.0)
    extra = draw(seed, F.col(id_col), F.col(text_col)) < rate - F.floor(rate)
    return joined.select(
        *[sized[c] for c in sized.columns],
        F.col("__targets_source_size").alias(f"{prefix}source_size"),
        F.col("__targets_target").alias(f"{prefix}target"),
        (F.floor(rate) + extra.cast("bigint")).alias(f"{prefix}copies"),
    )


def emit(mixed: DataFrame, columns: list[str], prefix: str = "mix_") -> DataFrame:
    """The mix itself: each row as many times as it is taken."""
    copies = F.col(f"{prefix}copies").cast("int")
    return mixed.where(copies > 0).select(*columns, F.explode(F.array_repeat(F.lit(True), copies)).alias("__copy")).drop("__copy")
