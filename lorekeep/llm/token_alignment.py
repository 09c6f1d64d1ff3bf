"""Alignment of two tokenizers over a corpus, each distinct segment tokenized and aligned once.

A text (with a space before it) is split before runs of white space, where neither vocabulary can merge across:
every token of both is looked at for white space behind something else, the characters found so (a carriage return,
for one) cut nothing, and the pattern that A splits words by ends a word before any white space.  Blocks of texts are reduced to their distinct segments, and each text
to its segments' numbers within the block.  A segment's rows of all blocks meet once; the two tokenizers then
segment runs of distinct segments, whose ends cut the tokens apart again.  Ends that both tokenizers share cut the
bytes into groups; a link is a token of A and one of B that overlap, one for each end of either.

How often an id pair is linked is counted over distinct segments by their occurrences.  The counts go back to each
part of the segments for the pairs that it holds; the aligned segments go back to the blocks, where the texts are
put together again by number.  Between these steps stand tables in the shared folder, so that each step's shuffle
can go before the next one's comes.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import SPACE_CHARS, answered_id, cut, map_arrow, release, small_batches, staged, trim, type_of

#: Any white space, by whichever definition: a text is cut only behind what none of them counts as such.
ANY_SPACE = r"\s᠎"
_SPACE = re.compile(f"[{ANY_SPACE}]")
MARK = "▁"
#: Bytes of text whose distinct segments are numbered together, rows of segments of a part, characters that are tokenized at once.
BLOCK_BYTES, PART_ROWS, RUN_CHARS = 32 << 20, 200_000, 1 << 16
#: Pairs that a task adds up before it lets go of them.
MOST_PAIRS = 2_000_000


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the others
    follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def merged_across(tokens: Iterable[str]) -> set[str]:
    """The characters of white space that a token holds behind something else."""
    return {t[i] for t in tokens for i in range(1, len(t)) if t[i] in SPACE_CHARS and not _SPACE.match(t[i - 1])}


def segment_pattern(uncut: Iterable[str]) -> re.Pattern:
    """What a text falls into if it is cut before runs of white space, other than those that begin with one of ``uncut``
    or with white space beyond ASCII."""
    joins = "".join(c for c in map(chr, range(0x3001)) if _SPACE.match(c) and (c not in SPACE_CHARS or c in uncut))
    return re.compile(f"[{ANY_SPACE}]*[^{ANY_SPACE}]+(?:[{joins}][{ANY_SPACE}]*[^{ANY_SPACE}]*)*|[{ANY_SPACE}]+")


class TwoTokenizers:
    """A: a byte-level BPE file of the ``tokenizers`` library.  B: a SentencePiece model."""

    def __init__(self, a_json: str, b_model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        rules = json.loads(a_json)
        letters, vocabulary = byte_letters(), rules["model"]["vocab"]
        special = {t["id"] for t in rules["added_tokens"]}
        self.a_bytes = [b""] * (1 + max(*vocabulary.values(), *special, 0))
        for token, i in vocabulary.items():
            if i not in special:
                self.a_bytes[i] = bytes(letters[c] for c in token)
        b = self.b
        self.b_bytes = []
        for i in range(b.get_piece_size()):
            piece = b.id_to_piece(i)
            none = b.is_control(i) or b.is_unknown(i) or b.is_unused(i)
            self.b_bytes.append(b"" if none else bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace(MARK, " ").encode())
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in xs]) for xs in (self.a_bytes, self.b_bytes))
        self.head = b.encode("\n")
        numbers = max(len(self.a_bytes), len(self.b_bytes))
        self.shown = [f"{i}{mark}" for i in range(numbers) for mark in ",|.;"]
        self.shown_lengths = np.array([len(x) for x in self.shown])
        self._verify(rules)

    def _verify(self, rules: dict) -> None:
        splits = rules["pre_tokenizer"] or {}
        if splits.get("type") != "ByteLevel" or splits.get("add_prefix_space") or not splits.get("use_regex") or rules["normalizer"]:
            raise ValueError("A must split words by the byte-level pattern, and neither add spaces nor normalise")
        if len(self.head) != 2 or any(b"\n" in x[1:] or x[:1] == b"\n" and len(x) > 1 for x in self.b_bytes) or self.b.normalize("a  b ") != f"{MARK}a{MARK}{MARK}b{MARK}":
            raise ValueError("B must add one space, keep all others, and merge line feeds with nothing")
        uncut = merged_across(x.decode("utf-8", "replace") for xs in (self.a_bytes, self.b_bytes) for x in xs)
        if " " in uncut:
            raise ValueError("a token holds a space behind something else: segments can't be cut there")
        self.segment = segment_pattern(uncut)

    def align(self, segments: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """For each segment its groups: ids of A with commas between and a bar behind, ids of B with dots between and a
        semicolon behind, so that counting marks counts tokens.  Then the links of all, coded as
        ``A id << 32 | B id``, and how many of them each segment has."""
        groups, links, linked = [""] * len(segments), [], np.zeros(len(segments), np.int64)
        run: list[int] = []
        size = 0

        def tokenized(numbers: list[int]) -> None:
            strings, codes, lengths = self._run([segments[i] for i in numbers])
            for i, s in zip(numbers, strings, strict=True):
                groups[i] = s
            linked[numbers] = lengths
            links.append((numbers, codes, lengths))

        for i, segment in enumerate(segments):
            if _SPACE.match(segment[-1]):
                tokenized([i])  # white space behind it would join what is at its end
                continue
            run.append(i)
            size += len(segment)
            if size > RUN_CHARS:
                tokenized(run)
                run, size = [], 0
        if run:
            tokenized(run)
        ordered = np.empty(int(linked.sum()), np.int64)
        begins = np.concatenate([[0], np.cumsum(linked)])
        for numbers, codes, lengths in links:
            at = np.repeat(begins[numbers] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(len(codes))
            ordered[at] = codes
        return groups, ordered, linked

    def _run(self, segments: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        text = "".join(segments)
        raw = text.encode()
        a = np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)
        b = np.array(self.b.encode("\n" + text)[2:], np.int64)  # behind a line feed, which merges with nothing, no space is added
        if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
            raise ValueError("tokens don't spell the text; texts that B changes must be left out beforehand")
        a_ends, b_ends = np.cumsum(self.a_lengths[a]), np.cumsum(self.b_lengths[b])
        shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
        own = np.cumsum([len(s.encode()) for s in segments])
        if not np.isin(own, shared, assume_unique=True).all():
            raise ValueError("a token crosses the end of a segment")
        every = np.union1d(a_ends, b_ends)
        codes = a[np.searchsorted(a_ends, every)] << 32 | b[np.searchsorted(b_ends, every)]
        of = lambda ends: np.bincount(np.searchsorted(own, ends), minlength=len(segments))
        # Within a group the tokens of A, then those of B; the last of each side ends the side.
        order = np.argsort(np.concatenate([2 * np.searchsorted(shared, a_ends), 2 * np.searchsorted(shared, b_ends) + 1]), kind="stable")
        last = lambda ends: np.isin(ends, shared, assume_unique=True)
        shown = np.concatenate([4 * a + last(a_ends), 4 * b + 2 + last(b_ends)])[order]
        line = "".join(map(self.shown.__getitem__, shown.tolist()))
        ends = np.cumsum(self.shown_lengths[shown])[np.cumsum(of(a_ends) + of(b_ends)) - 1].tolist()
        return [line[i:j] for i, j in zip([0, *ends], ends, strict=False)], codes, of(every)


def _numbers(places: bytes) -> np.ndarray:
    """The inverse of ``_packed``."""
    if not places:
        return np.empty(0, np.int64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(places), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def _packed(numbers: np.ndarray, tool: zstandard.ZstdCompressor) -> bytes:
    """Numbers as four planes of bytes, of which the upper ones are mostly zero."""
    return tool.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()) if len(numbers) else b""


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, segment: re.Pattern) -> DataFrame:
    """Two kinds of rows: ``block, id, places`` of each text, and ``block, number, segment, n`` of each distinct
    segment of a block.  Texts without tokens have no places."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId(), 0
        known: dict[str, int] = {}
        ids: list[pa.Array] = []
        texts: list[np.ndarray] = []
        size = 0
        tool = zstandard.ZstdCompressor(level=1)

        def flushed() -> Iterator[pa.RecordBatch]:
            block = task << 32 | done
            counts = np.bincount(np.concatenate([*texts, np.empty(0, np.int32)]), minlength=len(known))
            rank = np.empty(len(known), np.int64)
            rank[np.argsort(-counts, kind="stable")] = np.arange(len(known))
            places = [_packed(rank[x], tool) for x in texts]
            kinds = (pa.int64(), id_type, pa.binary(), pa.int32(), pa.string(), pa.int64())
            row = 0
            for some in ids:  # a batch's texts at a time
                k = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([block] * k, kinds[0]), some, pa.array(places[row : row + k], kinds[2]), *[pa.nulls(k, t) for t in kinds[3:]]], names=names)
                row += k
            segments = sorted(known)  # neighbours are alike, and take less room
            for i in range(0, len(segments), 50_000):
                some = segments[i : i + 50_000]
                k, at = len(some), np.array([known[s] for s in some])
                yield pa.RecordBatch.from_arrays([pa.array([block] * k, kinds[0]), pa.nulls(k, id_type), pa.nulls(k, kinds[2]), pa.array(rank[at], kinds[3]), pa.array(some, kinds[4]), pa.array(counts[at], kinds[5])], names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            begin = 0
            for row, text in enumerate(batch.column(1).to_pylist()):
                parts = segment.findall(" " + text) if text and MARK not in text else []
                texts.append(np.array([known.setdefault(s, len(known)) for s in parts], np.int32))
                size += len(text or "")
                if size > block_bytes:
                    ids.append(batch.column(0).slice(begin, row + 1 - begin))
                    yield from flushed()
                    begin, size, done = row + 1, 0, done + 1
                    known, ids, texts = {}, [], []
            if begin < batch.num_rows:
                ids.append(batch.column(0).slice(begin))
        if ids:
            yield from flushed()

    names = ["block", "id", "places", "number", "segment", "n"]
    return map_arrow(docs.select(F.col(id_col), F.col(text_col)), work, f"block bigint, id {type_of(docs, id_col)}, places binary, number int, segment string, n bigint")


def _aligned(rows: DataFrame, shared) -> DataFrame:  # noqa: ANN001  a broadcast variable
    """``rows`` hold all rows of a segment in a row.  Three kinds of rows: a segment, numbered within its task, with its
    groups and links; where in which block it stands; and an id pair with the number of its links in the corpus's
    occurrences of the task's segments."""
    names = ["part", "local", "groups", "links", "block", "number", "pair", "linked"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def made(count: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(count, t) for c, t in zip(names, kinds, strict=True)], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, part = TwoTokenizers(*shared.value), TaskContext.get().partitionId()
        pairs, linked = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        done, last, last_links = 0, None, np.empty(0, np.int64)

        def added_up() -> None:
            every, at = np.unique(np.concatenate(pairs), return_inverse=True)
            total = np.zeros(len(every), np.int64)
            np.add.at(total, at, np.concatenate(linked))
            pairs[:], linked[:] = [every], [total]

        def pair_rows() -> Iterator[pa.RecordBatch]:
            added_up()
            for i in range(0, len(pairs[0]), 100_000):
                some, many = pairs[0][i : i + 100_000], linked[0][i : i + 100_000]
                yield made(len(some), part=pa.array([part] * len(some), kinds[0]), pair=pa.array(some), linked=pa.array(many))
            pairs[:], linked[:] = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

        for batch in batches:
            runs = pa.compute.run_end_encode(batch.column(2))
            segments, ends = runs.values.to_pylist(), runs.run_ends.to_numpy()
            begins = np.concatenate([[0], ends[:-1]])
            n = np.add.reduceat(batch.column(3).to_numpy(), begins)
            goes_on = bool(segments) and segments[0] == last  # the last batch's last segment
            if goes_on:
                pairs.append(last_links)
                linked.append(np.full(len(last_links), n[0]))
            groups, links, lengths = two.align(segments[goes_on:])
            pairs.append(links)
            linked.append(np.repeat(n[goes_on:], lengths))
            local = np.repeat(np.arange(done - goes_on, done - goes_on + len(segments)), ends - begins)
            k = batch.num_rows
            yield made(k, part=pa.array([part] * k, kinds[0]), local=pa.array(local, kinds[1]), block=batch.column(0), number=batch.column(1))
            if k := len(groups):
                at = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
                yield made(k, part=pa.array([part] * k, kinds[0]), local=pa.array(np.arange(done, done + k), kinds[1]), groups=pa.array(groups, kinds[2]), links=pa.ListArray.from_arrays(at, pa.array(links)))
                last, last_links, done = segments[-1], links[len(links) - lengths[-1] :], done + k
            if sum(map(len, pairs)) > 2 * MOST_PAIRS:
                added_up()
                if len(pairs[0]) > MOST_PAIRS:
                    yield from pair_rows()
        yield from pair_rows()

    return map_arrow(rows.select("block", "number", "segment", "n"), work, "part bigint, local int, groups string, links array<bigint>, block bigint, number int, pair bigint, linked bigint")


def _weighed(key: tuple, rows: pa.Table, pairs: pa.Table) -> pa.Table:
    """A part's segments, wherever they stand, with the sum of their links' counts, and the number of links that are
    their B id's best."""
    code, first = np.unique(pairs.column("pair").to_numpy(), return_index=True)
    count, best = pairs.column("count").to_numpy()[first], pairs.column("best").to_numpy()[first]
    is_segment = pa.compute.is_valid(rows.column("groups"))
    segments, places = rows.filter(is_segment).combine_chunks(), rows.filter(pa.compute.invert(is_segment))
    links = segments.column("links").combine_chunks()
    at = np.searchsorted(code, links.flatten().to_numpy(zero_copy_only=False))
    begins = np.concatenate([[0], np.cumsum(links.value_lengths().to_numpy(zero_copy_only=False))])[:-1].astype(np.int64)
    sums = [np.add.reduceat(x[at].astype(np.int64), begins) if len(begins) else np.empty(0, np.int64) for x in (best, count)]
    order = np.empty(len(segments), np.int64)
    order[segments.column("local").to_numpy()] = np.arange(len(segments))
    own = order[places.column("local").to_numpy()]
    return pa.table([places.column("block"), places.column("number"), segments.column("groups").take(pa.array(own)), pa.array(sums[0][own]), pa.array(sums[1][own])], names=["block", "number", "groups", "n_best", "count_sum"])


def align(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, block_bytes: int = BLOCK_BYTES, part_rows: int = PART_ROWS
) -> DataFrame:
    """``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` of every row; with ``digests`` the SHA-256 of
    ``groups``, named ``groups_sha256``, instead.

    A encodes a space and the text, B the text; ``groups`` are ``a1,a2|b1;a3|b2`` by the ends that both share.  A
    link is a pair of tokens whose bytes overlap; its count is how many links of the corpus hold the two ids;
    it is best if no A id has a higher count with its B id.  Null and empty texts, and those with the mark
    that B writes for a space (which B's tokens don't spell), have no tokens: zeros, and the empty string
    for groups and digest.  Rows may repeat and ids be null; an empty table gives no rows.  Other columns are not
    read; an id column of the name of a result has ``_id`` behind its name.
    """
    spark = docs.sparkSession
    out = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256" if digests else "groups"]
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        files = f.read(), g.read()
    segment = TwoTokenizers(*files).segment
    shared = spark.sparkContext.broadcast(files)  # two vocabulary files: their size doesn't depend on the data
    id_type = type_of(docs, id_col)

    def composed(key: tuple, texts: pa.Table, segments: pa.Table) -> pa.Table:
        order = np.argsort(segments.column("number").to_numpy())
        groups = segments.column("groups").take(pa.array(order)).to_pylist()
        counts = np.zeros((5, len(order)), np.int64)
        for row, marks in enumerate((",|", ".;", ";")):
            for mark in marks:
                counts[row] += np.array([g.count(mark) for g in groups], np.int64)
        counts[3:] = [segments.column(c).to_numpy()[order] for c in ("n_best", "count_sum")]
        sums, shown = [], []
        for places in texts.column("places").to_pylist():
            numbers = _numbers(places)
            sums.append(counts[:, numbers].sum(axis=1))
            lines = ("".join([groups[k] for k in numbers[i : i + 100_000].tolist()]).replace(".", ",") for i in range(0, len(numbers), 100_000))
            if not digests:
                shown.append("".join(lines)[:-1])
                continue
            hashed, rest = hashlib.sha256(), ""
            for line in lines:
                hashed.update((rest + line[:-1]).encode())
                rest = ";"
            shown.append(hashed.hexdigest() if len(numbers) else "")
        n_a, n_b, n_groups, n_best, count_sum = np.stack(sums, axis=1) if sums else np.zeros((5, 0), np.int64)
        columns = [texts.column("id"), *map(pa.array, (n_a, n_b, n_groups, n_a + n_b - n_groups, n_best, count_sum)), pa.array(shown, pa.string())]
        made = pa.Table.from_arrays(columns, names=["id", *out])
        trim()
        return made

    small_batches(spark)
    deletes: list[Callable[[], None]] = []

    def keep(df: DataFrame) -> DataFrame:
        """A table in the shared folder; shuffles behind it go."""
        table, delete = staged(df, compression="zstd")
        deletes.append(delete)
        release(spark)
        return table

    try:
        blocks = keep(_blocks(docs, id_col, text_col, block_bytes, segment))
        rows = blocks.where("segment is not null").select("block", "number", "segment", "n")
        # One row of a block has the number 0.  Neither parts nor blocks share a task where there are more of them than shuffles have partitions.
        size = blocks.agg(F.count("segment").alias("rows"), F.count(F.when(F.col("number") == 0, 1)).alias("blocks")).first()
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        parts, dealt = max(least, size["rows"] // part_rows + 1), max(least, size["blocks"])
        aligned = keep(_aligned(rows.repartition(parts, "segment").sortWithinPartitions("segment"), shared))
        texts = keep(blocks.where("places is not null").select("block", "id", "places"))
        deletes.pop(0)()  # the blocks' segments
        pairs = aligned.where("pair is not null").select("part", "pair", "linked")
        of_b = Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF))  # no more rows than A has ids
        counted = pairs.groupBy("pair").agg(F.sum("linked").alias("count")).withColumn("best", F.col("count") == F.max("count").over(of_b))
        back = pairs.select(F.col("part").alias("of_part"), "pair").join(counted, "pair")
        segments = aligned.where("pair is null").select("part", "local", "groups", "links", "block", "number")
        found = keep(segments.repartition(parts, "part").groupBy("part").cogroup(back.repartition(parts, "of_part").groupBy("of_part")).applyInArrow(_weighed, "block bigint, number int, groups string, n_best bigint, count_sum bigint"))
        deletes.pop(0)()  # the aligned segments, which are all in what was found
        kinds = ", ".join(f"{c} {'string' if c.startswith('groups') else 'bigint'}" for c in out)
        found = found.withColumnRenamed("block", "of_block").repartition(dealt, "of_block")
        made = texts.repartition(dealt, "block").groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(composed, f"id {id_type}, {kinds}")
        return cut(made).withColumnRenamed("id", answered_id(id_col, out))
    finally:
        for delete in deletes:
            delete()
        release(spark)
