"""Token alignment against a plain evaluation of whole texts, one at a time."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from lorekeep.llm import token_alignment
from lorekeep.llm.queries import vocabulary_path
from lorekeep.llm.token_alignment import TwoTokenizers

A_PATH, B_PATH = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(vocabulary_path(A_PATH))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(B_PATH))
    letters = token_alignment.byte_letters()

    def tokens(text):
        if not text:
            return None
        one = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        whole = (" " + text).encode()
        return None if b"".join(x[1] for x in one) != whole or b"".join(x[1] for x in two) != whole else (one, two)

    def work(texts):
        aligned, counts = [], Counter()
        for text in texts:
            if (found := tokens(text)) is None:
                aligned.append(None)
                continue
            spans = []
            for side in found:
                at, out = 0, []
                for i, x in side:
                    out.append((at, at + len(x), i))
                    at += len(x)
                spans.append(out)
            links, j = [], 0
            for start, end, i in spans[0]:
                while spans[1][j][1] <= start:
                    j += 1
                k = j
                while k < len(spans[1]) and spans[1][k][0] < end:
                    links.append((i, spans[1][k][2]))
                    k += 1
            ends = sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]})
            groups, begin = [], 0
            iters = [iter(s) for s in spans]
            for end in ends:
                sides = []
                for it in iters:
                    ids = []
                    for span in it:
                        ids.append(str(span[2]))
                        if span[1] == end:
                            break
                    sides.append(",".join(ids))
                groups.append("|".join(sides))
                begin = end
            assert begin == spans[0][-1][1]
            counts.update(links)
            aligned.append((len(spans[0]), len(spans[1]), links, groups))
        best: dict[int, int] = {}
        for (_, second), n in counts.items():
            best[second] = max(best.get(second, 0), n)
        out = []
        for x in aligned:
            if x is None:
                out.append((0, 0, 0, 0, 0, 0, ""))
            else:
                out.append((x[0], x[1], len(x[3]), len(x[2]), sum(counts[p] == best[p[1]] for p in x[2]), sum(counts[p] for p in x[2]), ";".join(x[3])))
        return out

    return work


ODD = [
    "a  b", "a  b", "a \n b", "x y  　 z", " lead", "  two", "\n\nstart", "trail  ", "trail ", "trail \n\t ", "\t", " ", " ", "don't  we'll I'm",
    "<|endoftext|> <s></s> <unk><0x0A> <0x41>", "\x00 nul\x00", "\x1c x\x1d y", "a᠎ b ​ c", "日本語 テキスト、ελληνικά", "😀 👩‍👩‍👧  é́", "1234567 89,0.1", "a▁b", "▁", "tab\tseparated\r\nlines\x0b\x0cend",
    "\x85next", "ﬁ ﷺ", "....  !!!  ???", "CamelCase snake_case", "   \n   \n indented\n        code = [1, 2]", "� ﻿ bom",
]


@pytest.mark.parametrize("digests", [False, True])
def test_equals_plain(spark, rows, plain, digests):
    texts = [r[1] for r in rows] + ODD + ODD[:5]
    docs = spark.createDataFrame([(i if i % 4 else None, t, "x", 1, "y") for i, t in enumerate(texts)], "doc_id int, text string, groups string, block int, segment string").repartition(4)
    got = token_alignment.align(docs, vocabulary_path(A_PATH), vocabulary_path(B_PATH), digests=digests, block_bytes=20_000, part_rows=300)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256" if digests else "groups"]
    shown = (lambda g: hashlib.sha256(g.encode()).hexdigest() if g else "") if digests else (lambda g: g)
    want = [(i if i % 4 else None, *x[:6], shown(x[6])) for i, x in enumerate(plain(texts))]
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_random_strings_are_cut_where_nothing_merges(plain):
    two, r = TwoTokenizers(open(vocabulary_path(A_PATH), encoding="utf-8").read(), open(vocabulary_path(B_PATH), "rb").read()), random.Random(4)
    letters = [" ", " ", "  ", "\n", "\t", " ", "　", "\x1c", "\r", ";\r\n", "the", "ing", "'s", "é", "日", "😀", "1", "23", ".", "--", "A", "\x00", "x" * 30]
    for _ in range(300):
        text = "".join(r.choice(letters) for _ in range(r.randint(1, 40)))
        segments = two.segment.findall(" " + text)
        assert "".join(segments) == " " + text
        groups, links, linked = two.align(segments)
        (want,) = plain([text])
        line = "".join(groups)
        assert line[:-1].replace(".", ",") == want[6]
        assert (line.count(",") + line.count("|"), line.count(".") + line.count(";"), line.count(";")) == want[:3] and len(links) == linked.sum() == want[3]


def test_empty_tables_and_refusals(spark):
    paths = vocabulary_path(A_PATH), vocabulary_path(B_PATH)
    assert token_alignment.align(spark.createDataFrame([], "doc_id string, text string"), *paths).collect() == []
    none = token_alignment.align(spark.createDataFrame([("a", None), ("b", ""), ("c", "▁")], "doc_id string, text string"), *paths, digests=True)
    assert sorted(map(tuple, none.collect())) == [(x, 0, 0, 0, 0, 0, 0, "") for x in "abc"]
    assert token_alignment.align(spark.createDataFrame([], "n_a string, text string"), *paths, id_col="n_a").columns[0] == "n_a_id"
    assert token_alignment.merged_across(["a b", ";\r", "    a", "\xa0 "]) == {" ", "\r"}


def test_pairs_beyond_a_tasks_bound(spark, plain, monkeypatch):
    monkeypatch.setattr(token_alignment, "MOST_PAIRS", 10)
    texts = [f"words number {i} of the text {i % 7}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = token_alignment.align(docs, vocabulary_path(A_PATH), vocabulary_path(B_PATH), block_bytes=300, part_rows=20)
    assert sorted(map(tuple, got.collect())) == [(i, *x) for i, x in enumerate(plain(texts))]
