"""Dedup, lines, mixing, counts and encoding against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.llm import exact_dedup, line_dedup, mixing, piece_encoding, token_counts
from lorekeep.llm.queries import vocabulary_path, word_pieces

SPACE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MODEL = vocabulary_path("piece_bpe_32k.model")


def bag(frame, *columns):
    return Counter(tuple(r[c] for c in columns) for r in frame.select(*columns).collect())


def test_exact_dedup(spark, docs, rows, empty):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[hashlib.sha256(SPACE.sub("", text or "").encode()).hexdigest()].append((doc_id, len(text or "")))
    wanted = Counter()
    for sha, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        left = Counter({keep: 1})
        for m in members:
            wanted[(m[0], keep[0], len(members), bool(left[m]), sha)] += 1
            left[m] = 0
    got = exact_dedup.dedupe_once(docs, "t_index", 4)
    assert bag(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == wanted
    assert exact_dedup.dedupe_once(empty, "t_index", 4).count() == 0


def test_exact_dedup_of_other_ids(spark):
    rows = [("d9", "a b"), ("d10", "a  b"), (None, "a  b"), ("x", "c"), ("x", "c")]
    docs = spark.createDataFrame(rows, "name string, body string")
    got = exact_dedup.dedupe_once(docs, "t_text_ids", 4, "name", "body")
    assert bag(got, "name", "keep_id", "group_size", "kept") == Counter({("d9", "d10", 3, False): 1, ("d10", "d10", 3, True): 1, (None, "d10", 3, False): 1, ("x", "x", 2, True): 1, ("x", "x", 2, False): 1})
    with pytest.raises(Exception, match="no_such|UNRESOLVED"):
        exact_dedup.dedupe_once(docs, "t_text_ids", 4, "name", "no_such")
    assert not spark.catalog.tableExists("t_text_ids")


def test_digest_index_is_kept(spark):
    batch = lambda *x: spark.createDataFrame(list(x), "doc_id bigint, text string")
    index = exact_dedup.DigestIndex(spark, "t_persistent", 4).create()
    try:
        assert bag(index.ingest(batch((1, "a b"), (2, "ab"), (3, "c"))), "doc_id", "keep_id", "kept") == Counter({(1, 1, True): 1, (2, 1, False): 1, (3, 3, True): 1})
        assert bag(index.ingest(batch((4, "a  b"), (5, "d"))), "doc_id", "keep_id", "kept") == Counter({(4, 1, False): 1, (5, 5, True): 1})
        assert index.rows().count() == 3
    finally:
        index.drop()


def brute_lines(rows, least_docs=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = defaultdict(set)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(doc_id)
    gone = {k: max((d for d in ids if d is not None), default=None) for k, ids in held.items() if len(k) >= 20 and len(ids) >= least_docs}
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == doc_id]
        yield doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_line_dedup(docs, rows, empty):
    marked = line_dedup.mark(docs)
    got = marked.select("doc_id", "lines_total", "lines_dropped", F.sha2(line_dedup.kept_text(F.col("text"), F.col("lines_keep_runs")), 256).alias("sha"))
    assert bag(got, "doc_id", "lines_total", "lines_dropped", "sha") == Counter(brute_lines(rows))
    assert sum(r[2] for r in brute_lines(rows)) >= 5
    assert line_dedup.mark(empty).count() == 0
    clash = docs.withColumn("lines_total", F.lit("clash")).withColumn("lines_keep_runs", F.lit(1))
    assert Counter(line_dedup.mark(clash).columns) == Counter(marked.columns)
    assert bag(line_dedup.mark(clash), "doc_id", "lines_total", "lines_dropped") == bag(marked, "doc_id", "lines_total", "lines_dropped")


def test_line_dedup_streams_the_range_order(spark):
    """The window over ranged lines needs neither a shuffle nor a sort of its own."""
    lines = spark.range(20).selectExpr("md5(string(id % 3)) as digest", "id", "int(id % 2) as pos")
    ranged = lines.repartitionByRange(2, "digest", "id").sortWithinPartitions("digest", "id", "pos")
    first = ranged.withColumn("first", F.row_number().over(W.partitionBy("digest", "id").orderBy("pos")))
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and "Window" in plan


def test_mixing(spark, docs, rows, empty):
    size = lambda t: len(WORD.findall(t or ""))
    sources = defaultdict(int)
    for x in rows:
        sources[x[3]] += size(x[1])
    weights = dict(zip(sorted(sources, key=lambda s: (s is None, s or "")), (5, 2, 1) * 9, strict=False))
    targets, left, full = {}, float(sum(sources.values())), set()
    while True:  # share, cap, share again
        open_ = [s for s in sources if s not in full]
        level = left / sum(weights[s] for s in open_)
        over = [s for s in open_ if level * weights[s] > 3 * sources[s]]
        if not over:
            targets |= {s: level * weights[s] for s in open_}
            break
        for s in over:
            targets[s] = 3.0 * sources[s]
            left -= targets[s]
            full.add(s)
    mixed = mixing.mix(docs)
    for r in mixed.collect():
        assert r["mix_size"] == size(r["text"]) and r["mix_source_size"] == sources[r["source"]]
        assert abs(r["mix_target"] - targets[r["source"]]) < 1e-6 * max(1, targets[r["source"]]) and 0 <= r["mix_copies"] <= 3
    assert abs(sum(targets.values()) - sum(sources.values())) < 1e-6
    assert bag(mixing.mix(docs.repartition(5)), "doc_id", "mix_copies") == bag(mixed, "doc_id", "mix_copies")
    emitted = mixing.emit(mixed, docs.columns)
    assert emitted.columns == docs.columns and emitted.count() == mixed.agg(F.sum("mix_copies")).first()[0]
    clash = docs.withColumn("mix_size", F.lit("clash")).withColumn("mix_copies", F.lit(7))
    assert Counter(mixing.mix(clash).columns) == Counter(mixed.columns) and bag(mixing.mix(clash), "doc_id", "mix_size", "mix_copies") == bag(mixed, "doc_id", "mix_size", "mix_copies")
    assert mixing.mix(empty).count() == 0 and mixing.mix(spark.createDataFrame([(1, None, "a")], "doc_id bigint, text string, source string")).first()["mix_copies"] == 0


def test_mixing_reaches_targets(spark):
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 97 == 0, "c").otherwise("b").alias("source"))
    for r in mixing.mix(many).groupBy("source").agg(F.sum(F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.first("mix_target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) < 0.05 * r["target"]


def greedy(word, first, rest, longest=99):
    pieces, at = 0, 0
    while at < len(word):
        table = rest if at else first
        n = next((n for n in range(min(longest, len(word) - at), 0, -1) if word[at : at + n] in table), 0)
        if not n:
            if at or "" not in first:
                return -1
        at, pieces = at + n, pieces + 1
    return pieces


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=4), min_size=1, max_size=14), st.lists(st.text("abc", min_size=1, max_size=4), max_size=14), st.text("abc", max_size=12))
def test_automaton_is_greedy(first, rest, word):
    automaton = token_counts.PieceAutomaton([f"▁{p}" for p in first] + rest)
    assert automaton.count(word) == (greedy(word, set(first), set(rest)) if word else 0)


def test_piece_counts(docs, rows, empty):
    pieces = word_pieces(MODEL)
    first, rest = {p[1:] for p in pieces if p.startswith("▁") and len(p) > 1}, {p for p in pieces if not p.startswith("▁")}
    longest, wanted = max(map(len, first | rest)), Counter()
    for doc_id, text, *_ in rows:
        found = [greedy(w, first, rest, longest) for w in WORD.findall(text or "")]
        wanted[(doc_id, len(found), sum(1 if n < 0 else n for n in found), found.count(-1))] += 1
    got = bag(token_counts.piece_counts(docs, pieces), "doc_id", "n_words", "n_tokens", "n_unknown")
    assert got == wanted
    assert token_counts.piece_counts(empty, pieces).count() == 0


TABLE = piece_encoding.ChunkTable(MODEL, 1000)  # so small that its generations come and go


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁\nabcdeé😀\t "), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_chunks_encode_like_the_library(text):
    ids = TABLE.library.encode(text, add_eos=True)
    assert TABLE.encode([text]) == [(" ".join(map(str, ids)), TABLE.library.decode(ids), len(ids))]


def test_only_chunks_that_do_not_spell_their_pieces_are_decoded(monkeypatch):
    table, library = piece_encoding.ChunkTable(MODEL, 2000), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    decoded = []
    monkeypatch.setattr(table.library, "decode", lambda ids: decoded.append(ids) or library.decode(ids))
    plain = " ".join(f"word{i} naïve" for i in range(200))
    # Marks of the text itself are decoded to spaces, also by entries that have been in both generations.
    texts = [plain, *[f"▁marked ▁ {i} 😀\n<0x0A> {plain[:300]}" for i in range(40)]]
    for text in texts:
        ids = library.encode(text, add_eos=True)
        assert table.encode([text]) == [(" ".join(map(str, ids)), library.decode(ids), len(ids))]
        assert text != plain or not decoded
    assert len(table.unlike) <= len(table.young) + len(table.old)


def test_piece_encoding(docs, rows, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    wanted = Counter()
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_eos=True)
        wanted[(doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())] += 1
    assert bag(piece_encoding.encode(docs, MODEL, digests=True), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == wanted
    whole = piece_encoding.decode(piece_encoding.encode(docs, MODEL), MODEL, out_col="again").collect()
    assert all(r["decoded"] == r["again"] and len(r["ids"]) == r["n_tokens"] for r in whole)
    assert piece_encoding.encode(empty, MODEL).count() == 0
