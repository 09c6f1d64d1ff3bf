"""N-gram Jaccard join with prefix filtering.

Texts become sets of five-word shingles (as 64-bit hashes); texts with equal sets are one class.
Shingles are put in one order for all, rare ones first.  Two sets that are similar enough share a
shingle among the first ``n - ceil(t n) + 1`` of each, so classes meet in the lists of their prefix
shingles and nowhere else.  Length, positional and suffix filters drop pairs before each that is left
is verified once; so does a bitmap of fixed size for each class, before any set is sent anywhere.

How many texts hold a shingle is counted exactly: tasks deal packed runs of shingles to bins, a bin
counts its own, and what is in one text alone (most are) goes no further.  A block of texts gets back
its shared shingles with their counts, which is all that its prefixes need.

Lists can be long (a large group of near copies shares its shingles), and all pairs of a list are
never made.  A list's members are first compared with a hub; then, as long as that closes lists, what
is still apart from a list's largest component is compared with a few members of it, others in each
list and round.  Lists whose members are all in one component are done, since no link between them
can change a component.  What is left at last is compared pair by pair.

Comparisons go by cells of a grid over (hash of one class, hash of the other): a class's set is sent
once to each cell that needs it, not once a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lorekeep.llm.common import answered_id, bins_of, cut, kept_until_done, map_arrow, raw_texts, release, small_batches, trim, type_of
from lorekeep.llm.graph import components

WORDS = 5
#: Bits of a shingle's hash that its list and its place in the order go by.  A rare collision costs a comparison.
LIST_BITS = 48
#: Bits of a class's bitmap.
BITS = 1024
#: Bytes of ids sent to every task, instead of shuffling the texts to join with them.
MOST_BROADCAST = 32 << 20
#: Bytes of input that a bin of counted shingles stands for, and of sets on each side of a cell of comparisons.
BIN_BYTES, CELL_BYTES = 32 << 20, 4 << 20
#: Shingles gathered before a task deals them out.
DEALT_AT_ONCE = 1_000_000
#: Of a shingle that so many texts of one deal share, the bin gets the number alone.
HOT = 256
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) > 200_000:
                self.clear()
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_set(raw: bytes, hashes: _Hashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingles; a text of fewer words is one shingle; without words there is none."""
    found = raw.lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    k = min(words, len(w))
    total = np.full(len(w) - k + 1, np.uint64(k * 0x1000193), np.uint64)
    for i in range(k):
        total += _mixed(w[i : len(w) - k + 1 + i]) * _MULTIPLIERS[i % 5]
    return np.unique(_mixed(total))


def class_of(shingles: np.ndarray) -> bytes:
    """Equal for equal sets: 128 bits, so that different sets do not meet by chance however many there are."""
    sums = [_mixed(shingles * by).sum(dtype=np.uint64) for by in _MULTIPLIERS[:2]]
    return np.array(sums, np.uint64).tobytes()


def bitmap_of(shingles: np.ndarray) -> bytes:
    """For each bit, whether an odd number of shingles falls on it.  Bits that differ between two sets
    are at most as many as the shingles that only one of them has."""
    return np.packbits(np.bincount((shingles & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).tobytes()


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _packed(values: np.ndarray) -> bytes:
    """Integers by byte planes, compressed."""
    return zstandard.compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


# ---------------------------------------------------------------- passes over the texts
def _sorted_packed(values: np.ndarray) -> bytes:
    return _packed(np.diff(values, prepend=np.uint64(0)))


def _sorted_unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.uint64), dtype=np.uint64)


def _classes_and_postings(docs: DataFrame, id_col: str, text_col: str, percent: int, bins: int, most_rows: int, at_once: int) -> DataFrame:
    """Rows of (id, key, n, class, bits) for each document, and rows of (list, class, n, pos) for the
    prefix shingles that another text shares."""
    id_type, id_kind = type_of(docs, id_col), to_arrow_type(docs.schema[id_col].dataType)
    dealt = f"bin int, block bigint, shingles binary, counts binary, places binary, ids array<{id_type}>, keys binary, classes binary, sizes binary, bits binary"
    kinds = dict(zip([x.split()[0] for x in dealt.split(", ")], [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(id_kind), *[pa.binary()] * 4], strict=True))

    def table(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], k) for c, k in kinds.items()], names=list(kinds))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, part, deals = _Hashes(), TaskContext.get().partitionId(), 0
        ids: list = []
        keys: list[int] = []
        sets: list[np.ndarray] = []
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            """A run for each bin; the texts' own row, and what its bins were not sent, go around them."""
            block, around = part << 32 | deals, -1 - (part + deals) % bins
            classes = [class_of(s) for s in sets]
            yield table([{"bin": around, "block": block, "ids": ids, "keys": np.array(keys, np.uint64).tobytes(), "classes": b"".join(classes), "sizes": _packed(np.array([len(s) for s in sets], np.uint32)), "bits": b"".join(bitmap_of(s) for s in sets)}])
            first = {c: i for i, c in reversed(list(enumerate(classes))) if len(sets[i])}  # equal texts of a deal go once
            chosen = sorted(first.values())
            if not chosen:
                return
            lengths = np.array([len(sets[i]) for i in chosen])
            shingles = np.concatenate([sets[i] for i in chosen]) >> np.uint64(64 - LIST_BITS)
            place = np.repeat(np.array(chosen, np.uint32), lengths)
            order = np.argsort(shingles, kind="stable")
            shingles, place = shingles[order], place[order]
            starts = np.flatnonzero(np.concatenate([[True], shingles[1:] != shingles[:-1]]))
            lengths = np.diff(np.append(starts, len(shingles)))
            hot = np.repeat(lengths > most_rows, lengths)
            counts = np.ones(len(shingles), np.uint32)
            sent = ~hot
            sent[starts] = True
            counts[starts[lengths > most_rows]] = lengths[lengths > most_rows]
            if hot.any():
                yield table([{"bin": around, "block": block, "shingles": _sorted_packed(shingles[hot]), "places": _packed(place[hot])}])
            shingles, place, counts = shingles[sent], place[sent], counts[sent]
            bin_ = (shingles % np.uint64(bins)).astype(np.int64)
            order = np.argsort(bin_, kind="stable")
            edges = np.searchsorted(bin_[order], np.arange(bins + 1))
            rows = []
            for b in np.flatnonzero(np.diff(edges)).tolist():
                own = order[edges[b] : edges[b + 1]]
                rows.append({"bin": b, "block": block, "shingles": _sorted_packed(shingles[own]), "counts": _packed(counts[own]), "places": _packed(place[own])})
            yield table(rows)

        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                ids.append(i)
                keys.append(xxhash.xxh64_intdigest(raw, seed=42))
                sets.append(shingle_set(raw, hashes))
                held += len(sets[-1]) + 20
                if held >= at_once:
                    yield from out()
                    ids, keys, sets, held, deals = [], [], [], 0, deals + 1
        if ids:
            yield from out()

    def count(group: pa.Table) -> pa.Table:
        """What of each run is in more than one text, with the number of texts.  Rows that go around bins pass."""
        if group["bin"][0].as_py() < 0:
            return group
        rows = group.select(["block", "shingles", "counts", "places"]).to_pylist()
        runs = [_sorted_unpacked(r["shingles"]) for r in rows]
        sizes = [len(r) for r in runs]
        shingles, counts = np.concatenate(runs), np.concatenate([_unpacked(r["counts"], np.uint32) for r in rows])
        order = np.argsort(shingles, kind="stable")
        first = np.concatenate([[True], shingles[order][1:] != shingles[order][:-1]])
        totals = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(first))
        of_each = np.empty(len(order), np.int64)
        of_each[order] = totals[np.cumsum(first) - 1]
        out, at = [], 0
        for row, run, n in zip(rows, runs, sizes, strict=True):
            total = of_each[at : at + n]
            at += n
            many = total > 1
            if many.any():
                out.append({"bin": 0, "block": row["block"], "shingles": _sorted_packed(run[many]), "counts": _packed(np.minimum(total[many], 2**32 - 1).astype(np.uint32)), "places": _packed(_unpacked(row["places"], np.uint32)[many])})
        trim()
        return pa.Table.from_batches([table(out)]) if out else group.slice(0, 0)

    def prefixes(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        own = next(r for r in rows if r["classes"] is not None)
        ids, n = own["ids"], _unpacked(own["sizes"], np.uint32).astype(np.int64)
        classes = pa.array([own["classes"][i : i + 16] for i in range(0, len(own["classes"]), 16)], pa.binary())
        bits = np.frombuffer(own["bits"], np.int64).reshape(-1, BITS // 64).tolist()
        counted = [r for r in rows if r["counts"] is not None]
        empty = np.zeros(0, np.uint64)
        shingles = np.concatenate([empty, *(_sorted_unpacked(r["shingles"]) for r in counted)])
        totals = np.concatenate([empty, *(_unpacked(r["counts"], np.uint32) for r in counted)]).astype(np.int64)
        places = np.concatenate([empty, *(_unpacked(r["places"], np.uint32) for r in counted)]).astype(np.int64)
        if around := [r for r in rows if r["shingles"] is not None and r["counts"] is None]:
            hot, hot_places = np.concatenate([_sorted_unpacked(r["shingles"]) for r in around]), np.concatenate([_unpacked(r["places"], np.uint32) for r in around]).astype(np.int64)
            known = np.argsort(shingles, kind="stable")
            at = known[np.searchsorted(shingles[known], hot)]  # each hot shingle has come back once
            totals_of_hot, returned = totals[at], np.unique(at)
            keep = np.ones(len(shingles), bool)
            keep[returned] = False
            shingles, totals, places = np.concatenate([shingles[keep], hot]), np.concatenate([totals[keep], totals_of_hot]), np.concatenate([places[keep], hot_places])
        order = np.lexsort((shingles, totals, places))
        shingles, places = shingles[order], places[order]
        shared = np.bincount(places, minlength=len(n))
        # Shingles of one text alone are the rarest: they take the first positions, and need no list.
        pos = np.arange(len(places)) - np.repeat(np.cumsum(shared) - shared, shared) + np.repeat(n - shared, shared)
        wanted = pos < (n - -(-percent * n // 100) + 1)[places]
        shingles, places, pos = shingles[wanted], places[wanted], pos[wanted]
        there, k = n > 0, len(pos)
        column = lambda values: pa.concat_arrays([values, pa.nulls(k, values.type)])
        posted = lambda values: pa.concat_arrays([pa.nulls(len(n), pa.int64()), pa.array(values.astype(np.int64))])
        trim()
        return pa.table(
            {
                "id": column(pa.array(ids, id_kind)),
                "key": column(pa.array(np.frombuffer(own["keys"], np.int64))),
                "n": pa.array(np.concatenate([n, n[places]])),
                "class": pa.concat_arrays([pa.compute.if_else(pa.array(there), classes, pa.scalar(None, pa.binary())), classes.take(pa.array(places))]),
                "bits": column(pa.array([b if t else None for b, t in zip(bits, there, strict=True)], pa.list_(pa.int64()))),
                "list": posted(shingles),
                "pos": posted(pos),
            }
        )

    counted = map_arrow(docs.select(id_col, text_col), deal, dealt).groupBy("bin").applyInArrow(count, dealt)
    return counted.groupBy("block").applyInArrow(prefixes, f"id {id_type}, key bigint, n bigint, class binary, bits array<bigint>, list bigint, pos bigint")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``node, shingles`` for the classes of ``wanted`` (node, class, id, key), each from one of its documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            sets = [shingle_set(raw, hashes) for raw in raw_texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([class_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "wanted", "class", "shingles"])

    size = wanted.agg(F.sum(F.lit(48) + F.coalesce(F.octet_length(F.col("id").cast("string")), F.lit(0)))).first()[0] or 0
    wanted = wanted.withColumnsRenamed({"id": "__id", "key": "__key"})
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    met = texts.join(F.broadcast(wanted) if size <= MOST_BROADCAST else wanted, (F.col("key") == F.col("__key")) & F.col("id").eqNullSafe(F.col("__id")))
    # Rows that repeat id and text bring a set more than once; another text of the same key isn't meant.
    return map_arrow(met.select("text", "node", "class"), work, "node bigint, wanted binary, class binary, shingles binary").where("wanted = class").select("node", "shingles").dropDuplicates(["node"])


# ---------------------------------------------------------------- pairs
def _may_be_similar(percent: int) -> Column:
    """Length filter, and positional filter at the first shared shingle: nothing that two texts share stands
    before it in either, so they share no more than what is left of the shorter rest.  A similar pair passes
    at its first shared shingle; whether it passes at later ones doesn't matter."""
    length = F.greatest("n_a", "n_b") * percent <= F.least("n_a", "n_b") * 100
    at_most = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    return length & (at_most * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Suffix filter on eight parts of the order, then the exact comparison."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) > 64:
        edges = np.arange(1, 8) * len(a) // 8
        others = np.searchsorted(b, a[edges])
        at_most = np.minimum(np.diff(edges, prepend=0, append=len(a)), np.diff(others, prepend=0, append=len(b))).sum()
        if at_most * (100 + percent) < (len(a) + len(b)) * percent:
            return False
    place = np.searchsorted(b, a)
    common = int((b[np.minimum(place, len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _bits_allow(percent: int) -> Column:
    """Whether the bitmaps of (n_a, bits_a) and (n_b, bits_b) leave a link possible: bits that differ are
    shingles that only one of them has."""
    apart = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, n: total + n)
    both = F.col("n_a") + F.col("n_b")
    return both - apart >= F.ceil(both * percent / (100 + percent)) * 2


def _verified(pairs: DataFrame, docs: DataFrame, named: DataFrame, percent: int, id_col: str, text_col: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``a, b`` of those pairs of classes that link.  Bitmaps are looked up first; what they leave is compared by cells."""
    pairs = keep(pairs)
    sides = [named.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in ("a", "b")]
    likely = keep(pairs.join(sides[0], "a").join(sides[1], "b").where(_bits_allow(percent)).select("a", "b", "n_a", "n_b"))
    met = keep(likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct().join(named.drop("bits"), "node"))
    total, count = met.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = max(-(-total * 8 // CELL_BYTES), min(int(np.sqrt(tasks)) + 1, -(-count // 500)), 1)
    part = lambda c: F.pmod(F.xxhash64(F.lit(7), c), F.lit(side))
    likely = likely.select((part("a") * side + part("b")).alias("cell"), "a", "b")
    needed = likely.select("cell", F.explode(F.array("a", "b")).alias("node")).distinct()
    sent = needed.join(_sets(docs, met.select("node", "class", "id", "key"), id_col, text_col), "node").select(F.col("cell").alias("to"), "node", "shingles")

    def work(asked: pa.Table, given: pa.Table) -> pa.Table:
        sets = {node: np.frombuffer(x, np.uint64) for node, x in zip(given["node"].to_pylist(), given["shingles"].to_pylist(), strict=True)}
        linked = [(a, b) for a, b in zip(asked["a"].to_pylist(), asked["b"].to_pylist(), strict=True) if _linked(sets[a], sets[b], percent)]
        return pa.table({"a": pa.array([a for a, _ in linked], pa.int64()), "b": pa.array([b for _, b in linked], pa.int64())})

    return keep(likely.groupBy("cell").cogroup(sent.groupBy("to")).applyInArrow(work, "a bigint, b bigint"))


def _pairs_of(met: DataFrame, percent: int) -> DataFrame:
    """``a, b`` (a smaller) once each, of rows with the columns of both that the filters need."""
    return met.where(_may_be_similar(percent)).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _side(members: DataFrame, name: str) -> list[Column]:
    return [F.col(x).alias(f"{x}_{name}") for x in ("node", "n", "pos", "root")]


def _hub_pairs(members: DataFrame, most: DataFrame, turn: int, hubs: int, percent: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs of hubs with members of other components of their list.  First one hub a list; later ``hubs`` of
    its largest component, others in each list and turn, so that a member meets many."""
    me = F.struct("node", "n", "pos", "root")
    if turn == 0:  # a text with few shingles of its own lies in the middle of its list
        chosen = members.groupBy("list").agg(F.min_by(me, F.struct(F.col("pos") / F.col("n"), "n", "node")).alias("hub"))
    else:
        lot = F.xxhash64(F.lit(turn), "list", "node")
        inside = members.join(most, "list").where("root = most")
        chosen = inside.groupBy("list", F.pmod(lot, F.lit(hubs)).alias("slot")).agg(F.min_by(me, F.struct(lot, "node")).alias("hub"))
    chosen = keep(chosen.select("list", *[F.col(f"hub.{x}").alias(f"{x}_b") for x in ("node", "n", "pos", "root")]))
    return _pairs_of(members.select("list", *_side(members, "a")).join(chosen, "list").where("root_a <> root_b"), percent)


def _other_pairs(members: DataFrame, most: DataFrame, percent: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All pairs of different components in each list that the filters leave; those within its largest
    component never meet."""
    marked = keep(members.join(most, "list").withColumn("minor", F.col("root") != F.col("most")))
    one, two = marked.where("minor").select("list", *_side(marked, "a")), marked.select("list", "minor", *_side(marked, "b"))
    return _pairs_of(one.join(two, "list").where(F.expr("root_a <> root_b and (not minor or node_a < node_b)")), percent)


def _mixed_lists(postings: DataFrame, roots: DataFrame | None, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Members, with their roots, of lists that still hold more than one component."""
    if roots is None:
        members = postings.withColumn("root", F.col("node"))
    else:
        members = postings.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = keep(members.groupBy("list").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("list"))
    return keep(members.join(open_, "list"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, hub_rounds: int = 6, hubs: int = 4, most_rows: int = HOT, at_once: int = DEALT_AT_ONCE, keys: bool = False) -> DataFrame:
    """``id_col, n_shingles, component_id`` for every row; with ``keys`` also ``text_key`` (``xxhash64`` of the text)
    and ``group``, which tells components apart that have no id.

    Two texts link when 100 * intersection >= percent * union of their shingle sets; the component
    is the smallest id reachable by links.  Null and empty texts link with nothing.  Repeated rows
    and equal texts are one class.  A row without id links like any other but can't be named: a
    component of such rows alone has a null id.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(id_col, text_col)
    small_batches(spark)
    with kept_until_done(spark) as keep:
        found = keep(_classes_and_postings(docs, id_col, text_col, percent, bins_of(docs, BIN_BYTES), most_rows, at_once))
        rows = found.where("list is null").select("id", "key", "n", "class", "bits")
        of_class = rows.where("class is not null").groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("without"), "id", "key")).alias("one"), F.first("n").alias("n"), F.first("bits").alias("bits"))
        named = keep(of_class.select(F.monotonically_increasing_id().alias("node"), "class", "one.id", "one.key", "n", "bits"))
        postings = found.where("list is not null").select("list", "class", "n", "pos").distinct()
        postings = keep(postings.join(named.select("class", "node"), "class").drop("class"))
        roots = links = before = None
        for turn in range(hub_rounds + 1):
            members = _mixed_lists(postings, roots, keep)
            postings = members.drop("root")  # lists that are done stay done
            by_root = keep(members.groupBy("list", "root").count())
            sizes = by_root.groupBy("list").agg(F.sum("count").alias("m"), F.sum(F.col("count") * F.col("count")).alias("own"))
            left, size = sizes.agg(F.coalesce(F.sum((F.col("m") * F.col("m") - F.col("own")) / 2), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
            if not left:
                break
            # Hubs while they save work; then every pair that is left.
            last = turn > 0 and (turn == hub_rounds or left <= 8 * size or left > 0.8 * before)
            before = left
            most = keep(by_root.groupBy("list").agg(F.max_by("root", F.struct("count", "root")).alias("most")))
            pairs = _other_pairs(members, most, percent, keep) if last else _hub_pairs(members, most, turn, hubs, percent, keep)
            linked = _verified(pairs, docs, named, percent, id_col, text_col, keep)
            links = linked if links is None else links.unionByName(linked)
            roots = keep(components(links))
            release(spark)
            if last:
                break
        by_class = named.select("class", "node", "id")
        by_class = by_class.withColumn("root", F.col("node")) if roots is None else by_class.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        smallest = keep(by_class.groupBy("root").agg(F.min("id").alias("component_id")))
        answer = keep(by_class.join(smallest, "root").select("class", "component_id", "root"))
        alone = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
        more = [F.col("key").alias("text_key"), F.col("root").alias("group")] if keys else []
        return cut(rows.join(answer, "class", "left").select(F.col("id").alias(answered_id(id_col, ["n_shingles", "component_id", "group", "text_key"])), F.col("n").alias("n_shingles"), alone.alias("component_id"), *more))
