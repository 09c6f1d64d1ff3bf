"""Near-duplicate keys: a similarity join within blocks, by rare-first prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import lexicon as L
from lorekeep.functions import text as X


def prepare_keys(keys: DataFrame, key_col: str, group_cols: list[str]) -> DataFrame:
    """Distinct keys with normal form, trigrams and block; keys that say too little go."""
    normal = keys.select(*group_cols, F.col(key_col).alias("key")).distinct().withColumn("normal", X.normal_key(F.col("key")))
    return normal.where(X.is_comparable(F.col("normal"))).withColumn("grams", X.trigrams(F.col("normal"))).withColumn("block", X.block_key(F.col("normal")))


def _column(threshold: float | Column) -> Column:
    return threshold if isinstance(threshold, Column) else F.lit(threshold)


def rare_first(rows: DataFrame, by: list[str], set_col: str, key_cols: list[str], threshold: float | Column, counted: DataFrame | None = None, order: DataFrame | None = None) -> DataFrame:
    """``by, key_cols, item, pos, n``: the elements of each row's set that a similar set must share one of.

    Elements are in one order for all rows of a group (``by``): those that few rows of ``counted``
    (``rows`` themselves if None) hold come first.  ``order`` (``by, item, held``), if given, says how many instead; what it doesn't hold comes first.  Two sets whose Jaccard similarity reaches
    ``threshold`` share one of the first ``n - ceil(threshold n) + 1`` of each.  Only keys and single
    elements are shuffled.
    """
    items = rows.select(*by, *key_cols, F.size(set_col).alias("n"), F.explode(set_col).alias("item"))
    if order is None:
        order = (items if counted is None else counted.select(*by, F.explode(set_col).alias("item"))).groupBy(*by, "item").agg(F.count("*").alias("held"))
    ranked = items.join(order, [*by, "item"], "left").withColumn("held", F.coalesce("held", F.lit(0))).groupBy(*by, *key_cols, "n").agg(F.array_sort(F.collect_list(F.struct("held", "item"))).alias("sorted"))
    most = F.col("n") - F.ceil(F.col("n") * _column(threshold) - F.lit(1e-9)).cast("int") + 1
    return ranked.select(*by, *key_cols, "n", F.posexplode(F.slice("sorted", F.lit(1), most)).alias("pos", "__item")).select(*by, *key_cols, "n", "pos", F.col("__item.item").alias("item"))


def may_reach(threshold: float | Column) -> Column:
    """Length filter, and positional filter at the first element that (n_a, pos_a) and (n_b, pos_b) share."""
    n_a, n_b, t = F.col("n_a"), F.col("n_b"), _column(threshold)
    common = F.least(n_a - F.col("pos_a"), n_b - F.col("pos_b"))
    return (F.least(n_a, n_b) >= F.greatest(n_a, n_b) * t - F.lit(1e-9)) & (common * (t + 1) >= (n_a + n_b) * t - F.lit(1e-9))


#: Meetings of two keys in one task, about.
TASK_MEETINGS = 1_000_000


def dealt(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """Two sets of postings with a ``deal``, such that a join by ``on`` and ``deal`` has at most ``TASK_MEETINGS`` pairs of rows for one value, and the number
    of tasks for that join.  Both sides of a value that many share are dealt out, in a grid, by ``key_a`` and ``key_b``."""
    held = [rows.groupBy(*on).agg(F.count("*").alias(f"held_{n}")) for rows, n in ((left, "a"), (right, "b"))]
    met = held[0].join(held[1], on).withColumn("met", F.col("held_a") * F.col("held_b"))
    tasks = int(max(1, min(2000, -(-(met.agg(F.sum("met")).first()[0] or 0) // TASK_MEETINGS))))
    grid = F.broadcast(met.select(*on, F.ceil(F.sqrt(F.col("met") / TASK_MEETINGS)).cast("int").alias("grid")).where("grid > 1"))  # no more than meetings / TASK_MEETINGS
    n = F.coalesce("grid", F.lit(1))
    at = lambda key: F.pmod(F.xxhash64(key), n).cast("int")
    along, across = F.sequence(at("key_a") * n, at("key_a") * n + n - 1), F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * n + at("key_b"))
    sides = [rows.join(grid, on, "left").select(*rows.columns, F.explode(deal).alias("deal")) for rows, deal in ((left, along), (right, across))]
    return *[rows.repartition(tasks, *on, "deal") for rows in sides], tasks


def near_duplicates(incoming: DataFrame, existing: DataFrame, key_col: str = "key", group_cols: tuple[str, ...] = (), threshold: float | str = L.SIMILARITY_FLOOR) -> DataFrame:
    """``key, other, score`` (with ``group_cols``) for pairs of different normal form at ``threshold`` or more.

    ``threshold`` may be the name of one of ``group_cols``.  Every unordered pair comes once.  Pairs meet on their block's first characters and, within it, on
    shared trigrams of a rare-first prefix that any similar pair must share, so a block that most keys
    fall into is dealt out by its trigrams, and a trigram that very many hold by keys.  Only keys meet; what is left after the filters is compared once.
    """
    groups = list(group_cols)
    left, right = prepare_keys(incoming, key_col, groups), prepare_keys(existing, key_col, groups)
    by, both = [*groups, "block"], left.unionByName(right)
    if isinstance(threshold, str):  # one of the groups' columns
        threshold = F.col(threshold)
    sides = [rare_first(rows, by, "grams", ["key"], threshold, both).withColumnsRenamed({c: f"{c}_{name}" for c in ("key", "n", "pos")}) for rows, name in ((left, "a"), (right, "b"))]
    left_side, right_side, tasks = dealt(*sides, [*by, "item"])
    met = left_side.join(right_side, [*by, "item", "deal"]).where((F.col("key_a") != F.col("key_b")) & may_reach(threshold))
    pairs = met.groupBy(*groups, F.least("key_a", "key_b").alias("lo"), F.greatest("key_a", "key_b").alias("hi")).agg(F.min(F.struct(F.col("key_a").alias("key"), F.col("key_b").alias("other"))).alias("p"))
    pairs = pairs.select(*groups, "p.key", "p.other")
    for rows, key, name in ((left, "key", "a"), (right, "other", "b")):
        pairs = pairs.repartition(tasks, *groups, key).join(rows.select(*groups, F.col("key").alias(key), F.col("normal").alias(f"normal_{name}"), F.col("grams").alias(f"grams_{name}")), [*groups, key])
    scored = pairs.where("normal_a <> normal_b").withColumn("score", X.similarity(F.col("normal_a"), F.col("normal_b"), F.col("grams_a"), F.col("grams_b")))
    return scored.where(F.col("score") >= threshold).select(*groups, "key", "other", "score")
