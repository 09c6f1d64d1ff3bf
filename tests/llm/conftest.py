from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, n int, digest string, class string, size int, word string"


def fixture_texts(seed: int = 3) -> list[str | None]:
    """Odd, equal, near-equal and very long texts."""
    r = random.Random(seed)
    words = ["Tide", "quay", "crane", "berth", "Çelik", "naïve", "ship's", "x", "the", "of"] + [f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = prose(120), "A passage that many documents hold, word for word, again and again"
    near = lambda k: " ".join(w if r.random() > k else r.choice(words) for w in base.split())
    texts: list[str | None] = [None, "", " \t\n", "one", "one two three", "ONE  two\tthree", "a\n\nb", "\x0b\x0c", "▁ marked ▁text", "É À  wide", "emoji 😀 here", "\x00nul", "ﬁ é́"]
    texts += [base, base, base.upper(), base.replace(" ", "\n"), *[near(0.02) for _ in range(6)], *[near(0.2) for _ in range(3)]]
    texts += [f"{prose(20)}\n  {passage} \n{prose(15)}" for _ in range(5)] + [f"{passage}\n{passage.upper()}", passage]
    texts += [prose(n) for n in (3, 4, 5, 6, 9, 40, 200)] + [prose(6000), "same " * 3000, "longword" * 2000]
    return texts


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text) with a null id, repeated rows and extra columns of names that operators use inside."""
    texts = fixture_texts()
    out = [(i * 7 % 1000, t, "en" if i % 3 else None, [None, "b", "a", "ä", ""][i % 5], len(t or "")) for i, t in enumerate(texts)]
    out += [out[15], (None, "without an id", "en", "a", 13), (None, None, None, None, None)]
    return [(*x, "clash", 1, "clash", "clash", 2, "clash") for x in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
