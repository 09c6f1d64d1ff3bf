"""Scoring, quality, pages, media and the similarity join."""

from __future__ import annotations

import hashlib
import html
import math
import os
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from lorekeep.llm import graph, html_blocks, jaccard_join, lm_scoring, motion_jpeg, quality
from lorekeep.llm.queries import vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- language model
def test_base_scores(docs, rows, empty):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    counts: Counter = Counter()
    for doc_id, text, *_ in rows:
        if not held(doc_id):
            counts.update([*words(text), None])
    total, types = counts.total(), len(counts)
    wanted: Counter = Counter()
    for doc_id, text, *_ in rows:
        tokens = [*words(text), None]
        base = sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in tokens)
        wanted[(doc_id, held(doc_id), len(tokens), sum(counts[w] > 0 for w in tokens), total, round(base, 4))] += 1
    got = lm_scoring.score(docs, vocabulary_path("piece_bpe_32k.model")).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == wanted
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm_scoring.score(empty, vocabulary_path("piece_bpe_32k.model")).count() == 0


def test_base_scores_of_small_blocks(spark):
    """Blocks of one text: many bins give it the same number of words and the same sum."""
    texts = [" ".join(f"{chr(97 + i % 26)}{i}x{k}" for i in range(60)) for k in range(4)]
    one = [(2, texts[0])]
    many = [(i + 10, t) for i, t in enumerate(texts)] + [(10, texts[0])]
    for rows in (one, many):
        held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
        counts = Counter(w for i, t in rows if not held(i) for w in [*t.split(), None])
        total, types = counts.total(), len(counts)
        assert total
        frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id bigint, text string")
        got = lm_scoring.score(frame, vocabulary_path("piece_bpe_32k.model")).collect()
        wanted = Counter((i, sum(counts[w] > 0 for w in [*t.split(), None]), round(sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in [*t.split(), None]), 4)) for i, t in rows)
        assert Counter((r["doc_id"], r["n_known"], round(r["base_score"], 4)) for r in got) == wanted


def test_every_training_window_is_trained_on_once():
    numbers = np.arange(5000)
    rounds = [numbers[lm_scoring.in_round(numbers, turn)] for turn in range(lm_scoring.ROUNDS)]
    assert sorted(np.concatenate(rounds)) == list(numbers) and min(map(len, rounds)) > 1000
    assert lm_scoring.CLASSES >= 128


def random_model(seed=0, size=60):
    r = np.random.default_rng(seed)
    classes = r.integers(0, lm_scoring.CLASSES, size)
    share = r.random(size)
    total = np.bincount(classes, weights=share, minlength=lm_scoring.CLASSES)
    normal = lambda *s: r.standard_normal(s).astype(np.float32)
    return lm_scoring.Model(classes, np.log(share / total[classes]).astype(np.float32), normal(size + 2, lm_scoring.WIDTH), normal(size + 2, lm_scoring.CLASSES), lm_scoring.first_weights(seed), 2), total


def test_scores_are_probabilities():
    model, total = random_model()
    present = (total > 0).nonzero()[0]
    keys, _, _ = next(lm_scoring.windows(np.arange(16), np.array([16]), model.start, model.pad))
    chances = np.array([np.exp(lm_scoring.Scorer(model).log_probs(keys, np.full((1, 16), i)))[0] for i in range(60)]).sum(axis=0)
    assert len(present) < lm_scoring.CLASSES and (chances <= 1 + 1e-4).all()  # classes without ids take the rest


def test_every_id_is_scored_once_from_what_is_before():
    ids, lengths = np.arange(100) % 50, np.array([1, 16, 17, 40, 26])
    seen = Counter()
    for keys, targets, text in lm_scoring.windows(ids, lengths, 60, 61, 2):
        for k, t, x in zip(keys, targets, text, strict=True):
            own = ids[lengths[:x].sum() : lengths[: x + 1].sum()]
            for j in np.flatnonzero(t >= 0):
                seen[(x, int(t[j]))] += 1
                before = [int(i) for i in k[: j + lm_scoring.KEYS - lm_scoring.SCORED + 1] if i < 60]
                place = next(p for p in range(len(own)) if own[p] == t[j] and list(own[max(0, p - len(before)) : p]) == before)
                assert len(before) >= min(place, lm_scoring.KEYS - lm_scoring.SCORED)
    assert set(seen.values()) == {1} and len(seen) == 100


def test_later_ids_change_nothing():
    model, _ = random_model()
    scorer = lm_scoring.Scorer(model)
    keys = np.random.default_rng(1).integers(0, 60, (1, lm_scoring.KEYS))
    targets = np.zeros((1, lm_scoring.SCORED), int)
    changed = keys.copy()
    changed[0, -1] = 5
    a, b = scorer.log_probs(keys, targets), scorer.log_probs(changed, targets)
    assert np.allclose(a[:, :-1], b[:, :-1]) and not np.allclose(a[:, -1], b[:, -1])


def test_gradients():
    model, _ = random_model()
    r = np.random.default_rng(2)
    w = {k: v.astype(float) for k, v in model.weights.items()}
    keys, classes = r.integers(0, 62, (3, lm_scoring.KEYS)), r.integers(-1, lm_scoring.CLASSES, (3, lm_scoring.SCORED))
    follow = model.follow.astype(float)
    args = (lm_scoring.with_mask(model.embed.astype(float), model.pad), lm_scoring.group_logits(follow), follow.reshape(-1, lm_scoring.MEMBERS), keys, classes, True)
    _, g = lm_scoring.gradients(w, *args)
    for name, x in [(k, v) for k, v in w.items() for _ in range(4)]:
        i = tuple(r.integers(0, n) for n in x.shape)
        both = []
        for sign in (1, -1):
            moved = {k: v.copy() for k, v in w.items()}
            moved[name][i] += sign * 1e-5
            both.append(lm_scoring.gradients(moved, *args)[0])
        assert abs((both[0] - both[1]) / 2e-5 - g[name][i]) < 1e-5


def test_scorer_follows_the_plain_formula():
    model, _ = random_model()
    r = np.random.default_rng(4)
    w = {k: v + 0.2 * r.standard_normal(v.shape) for k, v in model.weights.items()}
    model.weights = {k: v.astype(np.float32) for k, v in w.items()}
    lengths = np.array([1, 7, 16, 17, 40])
    ids = r.integers(0, 60, lengths.sum())
    keys, targets, _ = next(lm_scoring.windows(ids, lengths, model.start, model.pad))
    got = lm_scoring.Scorer(model).log_probs(keys, targets)
    ones = np.array([lm_scoring.Scorer(model).log_probs(keys[i : i + 1], targets[i : i + 1])[0] for i in range(len(keys))])
    e, groups = model.embed.astype(float), lm_scoring.group_logits(model.follow.astype(float))
    ln_softmax = lambda x: x - np.log(np.exp(x).sum())
    for i, j in np.argwhere(targets >= 0):
        here = j + lm_scoring.KEYS - lm_scoring.SCORED
        seen = [n for n in range(here + 1) if keys[i, n] != model.pad]
        last, before = keys[i, here], e[keys[i, seen]]
        a = np.exp(ln_softmax(before @ (e[last] @ w["qk"]) / np.sqrt(lm_scoring.WIDTH) + w["near"][j, seen]))
        x = e[last] + a @ before @ w["vo"]
        x = np.append(x + np.maximum(x @ w["h"] + w["hb"], 0) @ w["u"], 1)
        g, c = divmod(model.classes[targets[i, j]], lm_scoring.MEMBERS)
        own = model.follow[last, g * lm_scoring.MEMBERS : (g + 1) * lm_scoring.MEMBERS]
        wanted = ln_softmax(x @ w["g"] + groups[last])[g] + ln_softmax(x @ w["c"][g] + own)[c] + model.log_share[targets[i, j]]
        assert abs(got[i, j] - wanted) < 1e-3 and abs(ones[i, j] - wanted) < 1e-3
    assert (got[targets < 0] == 0).all()


def test_gradients_of_windows_add_up():
    model, _ = random_model()
    r = np.random.default_rng(3)
    keys, classes = r.integers(0, 62, (5, lm_scoring.KEYS)), r.integers(0, lm_scoring.CLASSES, (5, lm_scoring.SCORED))
    args = lm_scoring.with_mask(model.embed, model.pad), model.groups, model.follow.reshape(-1, lm_scoring.MEMBERS)
    whole = lm_scoring.gradients(model.weights, *args, keys, classes)[1]
    single = [lm_scoring.gradients(model.weights, *args, keys[i : i + 1], classes[i : i + 1])[1] for i in range(5)]
    assert all(np.allclose(x, np.mean([g[k] for g in single], axis=0), atol=1e-5) for k, x in whole.items())


@pytest.mark.parametrize("rows", [0, 1, 31, 32, 33, 100])
@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_operations_on_long_runs(rows, kind):
    """The cheap forms of minimum, maximum and adding a row."""
    x = (np.random.default_rng(rows).standard_normal((rows, 16)) * 60).astype(kind)
    row = np.arange(16).astype(kind)
    for cheap, plain in ((lm_scoring._cap, np.minimum(x, 50)), (lm_scoring._cut_negative, np.maximum(x, 0)), (lambda y: lm_scoring._add_row(y, row), x + row)):
        y = x.copy()
        cheap(y)
        assert y.dtype == kind and (y == plain).all()


def test_words_keep_their_places():
    with open(vocabulary_path("piece_bpe_32k.model"), "rb") as f:
        words = lm_scoring.Words(f.read(), most_bytes=900)
    for _ in range(2):
        for many in (["tide", "quay", "tide"], [], ["quay", "\x85", "\u2028x", "▁", "😀", "\x1c", "tide"], ["new", "quay", "new"]):
            places = words.places([w.encode() for w in many])
            run, lengths = words.id_run(places)
            wanted = [words.library.encode(w) for w in many]
            assert run.tolist() == sum(wanted, []) and lengths.tolist() == [len(x) for x in wanted]
            assert len(words.hashes) == len(words.lengths) == len(words.known)


def test_score_beats_the_base_on_held_out_texts(spark):
    """Texts of a Markov chain: what comes next depends on the word before, and on one further back."""
    r = np.random.default_rng(9)
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    pieces = [library.id_to_piece(i) for i in range(3000, 9000)]
    words = [p[1:] for p in pieces if len(p) > 5 and p[0] == "▁" and p[1:].isascii() and p[1:].isalpha() and p[1:].islower()][:120]
    rows = []
    for i in range(500):
        at, text = int(r.integers(120)), []
        for _ in range(80):
            at = int((at * 7 + 13 + r.integers(4)) % 120)
            text.append(words[at])
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = lm_scoring.score(docs, vocabulary_path("piece_bpe_32k.model")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] / got[2] > got[1] / got[2] + 0.3, got


# ---------------------------------------------------------------- quality
def test_quality_learns_held_out_labels(spark, empty):
    r = np.random.default_rng(5)
    rows = []
    for i in range(900):
        bad = i % 5 == 0
        words = [("".join(r.choice(list("abcdefgh"), 5)) + ("$$$" if bad and r.random() < 0.7 else "")) for _ in range(60)]
        rows.append((i, " ".join(words), "en", "spam" if bad and i % 2 else "web", 400, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, q int")
    labels = docs.where("doc_id < 600").select("doc_id", F.col("q").alias("quality"))
    model = quality.fit(docs, labels, rounds=1)
    scored = quality.score(docs, model).where("doc_id >= 600")
    assert scored.where("quality_keep <> (q = 1)").count() <= 6
    assert quality.score(docs, model).columns[:6] == docs.columns
    nothing = quality.fit(docs, labels.where("false"))
    assert quality.score(docs, nothing).where("not quality_keep").count() == 0
    assert quality.score(empty, model).count() == 0


def test_quality_threshold_stands_mislabelled_rows():
    r = np.random.default_rng(6)
    labels = (np.arange(2000) % 5 > 0).astype(int)
    views = [(r.standard_normal((2000, n)) * 0.3 + (labels[:, None] * 2 - 1)).astype(np.float32) for n in (6, 4)]
    seen = labels.copy()
    seen[np.flatnonzero((labels == 0) & (np.arange(2000) % 4 == 3))[:5]] = 1  # in the calibration rows
    model = quality.co_train(*views, seen)
    keep = model.scores(*views)[2] >= model.threshold
    assert keep[labels == 1].mean() > 0.99 and keep[labels == 0].mean() < 0.02


def test_quality_of_held_out_labels(spark):
    """Fitted on four fifths of the labels of sf0.01; text ids."""
    folder = "/root/testdata/sf0.01"
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(name, "text", "lang", "source", "n_chars")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select(name, "quality").where("quality is not null")
    held = F.crc32("name") % 5 == 0
    model = quality.fit(docs, labels.where(~held), "name")
    got = quality.score(docs, model, ["name"]).join(labels.where(held), "name").select("quality", "quality_keep", "quality_text", "quality_meta").collect()
    good, bad = ([r for r in got if r["quality"] == q] for q in (1, 0))
    assert len(bad) >= 10 and sum(r["quality_keep"] for r in good) >= 0.98 * len(good) and sum(not r["quality_keep"] for r in bad) >= 0.9 * len(bad)
    assert len({r["quality_meta"] for r in got}) > 5  # the metadata view says something of its own


def test_packed_features():
    r = np.random.default_rng(1)
    rows = np.where(r.random((7, 40)) < 0.3, r.random((7, 40)), 0).astype(np.float16).astype(np.float32)
    rows[3] = 0
    packed, w = [quality.pack_row(x) for x in rows], r.standard_normal(41).astype(np.float32)
    assert (quality.unpack_rows(packed, 40) == rows).all() and np.allclose(quality.packed_logits(packed, w), quality.logit(rows, w), atol=1e-5)


def test_quality_takes_odd_rows(docs, rows, empty):
    labels = docs.select("doc_id", F.lit(None).cast("int").alias("quality"))
    assert quality.score(docs, quality.fit(docs, labels)).count() == len(rows)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality")).where("doc_id is not null").distinct()
    both = quality.fit_and_score(docs, labels, rounds=1)
    assert both.columns == ["doc_id", "quality_text", "quality_meta", "quality_score", "quality_keep"] and both.count() == len(rows)
    assert quality.fit_and_score(empty, labels).count() == 0
    clash = docs.withColumn("quality_score", F.lit("clash"))
    assert Counter(quality.score(clash, quality.Model()).columns) == Counter(quality.score(docs, quality.Model()).columns)
    assert quality.score(docs, quality.Model(), ["doc_id", "size"]).columns == ["doc_id", "size", "quality_text", "quality_meta", "quality_score", "quality_keep"]


# ---------------------------------------------------------------- pages
PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body><header><h1>Site name</h1></header>
<nav><ul><li><a href=/a>Home</a><li><a href='/b>c'>More</a></ul></nav><div class="cookie-notice">We use cookies for all of the many good reasons</div><!-- <p>no</p> -->
<article><h1>Tide &amp; time</h1><p>First&nbsp;line<br>goes
 on &lt;here&gt; &#233;.<p>Short.<div class="share">Share this</div><ul class="related"><li><a href=x>Other story</a></ul><p>Last one, with <a href=z>a link</a>.</p></article>
<aside>Side words that nobody reads</aside><section id="comments"><p>Reader says something long enough to be text</p></section><form><p>Sign up here for the letter</p></form><footer>&copy; all</footer></body></html>"""


def test_main_text():
    tree = html_blocks.train_tree()
    assert html_blocks.main_text(PAGE, tree) == "Tide & time\nFirst line goes on <here> é.\nShort.\nLast one, with a link."
    for broken in ("", "<", "<p", "a < b", "<div><p>x", "</p></div>", "<a href='", "<!--", "<script>", "&", "&amp", "<p class=>" * 50, "<b>" * 3000):
        html_blocks.main_text(broken, tree)
    plain = "<body><div>" + "".join(f"<p>{'some running words here ' * 8}{i}</p>" for i in range(4)) + "</div></body>"
    assert html_blocks.main_text(plain, tree).count("\n") == 3


def test_raw_elements_end_at_their_own_tag():
    tree = html_blocks.train_tree()
    body = "<article><h1>Tide tables</h1><p>Text after the script.</p></article>"
    for raw in (
        "<script>for(var i=0;i<n;i++){f();}</script>",
        "<script>if(a<b){document.write('<p>no</p>')}</SCRIPT >",
        "<script><!-- x = '<b'</script>",
        "<style>a:after{content:'<b'}</style>",
        "<textarea>a <b or <!-- c</textarea>",
        "<noscript><style>x<y</style></noscript>",
    ):
        assert html_blocks.main_text(f"<html><head><title>a <b c</title>{raw}</head><body>{raw}{body}</body></html>", tree) == "Tide tables\nText after the script.", raw
    assert html_blocks.main_text(f"<title>Open<body>{body}", tree) == "Tide tables\nText after the script."


def test_open_paragraphs_end_before_blocks():
    tree = html_blocks.train_tree()
    body = "<h2>Part one</h2><p>Text of the article.</p>"
    for page in (
        f"<body><article><p class='meta'>By me<div>{body}</div></article></body>",
        f"<body><article><p class='share'>Share{body}</article></body>",
        f"<body><article><ul><li><p class='meta'>x<ul><li>y</ul></ul>{body}</article></body>",
    ):
        assert html_blocks.main_text(page, tree).endswith("Part one\nText of the article."), page


#: Pages of other makes, by what of them is article text (in <x>) and what isn't.
LABELLED_PAGES = [
    "<body><nav><a href=a>News</a> <a href=b>Sport</a></nav><div id=content><h1><x>Harbour reopens</x></h1><p class=byline>By A. Writer</p><p><x>The harbour was opened again on Monday after two weeks of storms and repairs to the quay.</x></p>"
    "<p class=legal><x>The port authority says in a notice that ships of every size may enter from today, at their own risk, until the light is mended.</x></p><div class='share-box'>Share this</div></div><footer>All rights</footer></body>",
    "<body><main><article><h2><x>Why tides differ</x></h2><blockquote class=reply><x>The moon does most of it, the sun does the rest, and the shape of the coast decides what we see of both.</x></blockquote><p><x>So said the keeper.</x></p>"
    "<section class=comments><p>I was there when the keeper said it and can confirm every single word of it, and more.</p></section></article></main><aside>Most read</aside></body>",
    "<body><header><h1>The Daily Quay</h1></header><div class=cookie-banner>We use cookies to make this page better for you and for our many partners.</div><div class=post><p><x>A crane fell over last night near berth nine; nobody was hurt, says the harbour master in a statement.</x></p>"
    "<p><x>Work goes on.</x></p><ul class=related><li><a href=a>Crane fell last year too</a></ul></div><form><p>Get our letter</p></form></body>",
    "<body><table><tr><td><a href=1>One</a><td><a href=2>Two</a></table><p><x>This page marks nothing at all but has a paragraph of running text that is long enough to be read.</x></p><p><x>And another of the same kind follows it, which says as much again in other words than the first.</x></p><p>Top</p></body>",
]


def test_other_pages_by_precision_and_recall():
    tree, kept, right, wanted = html_blocks.train_tree(), 0, 0, 0
    for page in LABELLED_PAGES:
        truth = Counter(re.sub(r"<[^>]*>", "", x).strip() for x in re.findall(r"<x>(.*?)</x>", page, re.S))
        got = Counter(html_blocks.main_text(page.replace("<x>", "").replace("</x>", ""), tree).split("\n"))
        kept, right, wanted = kept + got.total(), right + (got & truth).total(), wanted + truth.total()
    assert right / kept >= 0.9 and right / wanted >= 0.95, (kept, right, wanted)


def test_shared_pages(sf_dir):
    """Against the article element of every shared page, cut out by hand: no word lost, none added."""
    import pyarrow.parquet as pq

    tree = html_blocks.train_tree()
    for page in pq.read_table(f"{sf_dir}/pages.parquet")["html"].to_pylist():
        article = re.search(r"<article>(.*)</article>", page or "", re.S)
        wanted = html.unescape(re.sub(r"<[^>]*>", " ", article[1])).split() if article else []
        assert html_blocks.main_text(page or "", tree).split() == wanted


def test_wrappers_named_for_their_layout():
    tree = html_blocks.train_tree()
    inner = "<h1>Tide tables</h1><p>Short text.</p>"
    for names in ("has-sidebar", "content with-sidebar", "page layout-sidebar-right", "no-comments"):
        page = f"<body><div class='{names}'><article>{inner}</article><div class=sidebar><p>No text of the page</p></div></div></body>"
        assert html_blocks.main_text(page, tree) == "Tide tables\nShort text.", names
    for element in ("div", "header"):
        page = f"<body><div class=post><{element} class='entry-header'><h1>Tide tables</h1></{element}><p>Short text.</p></div></body>"
        assert html_blocks.main_text(page, tree) == "Tide tables\nShort text.", element
    assert html_blocks.main_text(f"<body><div class='content-sidebar-wrap'><p>Menu of the site</p><main>{inner}</main><p>No text here</p></div></body>", tree) == "Tide tables\nShort text."
    for wrapper in ("<div id=comments>", "<div class=related>", "<div class='sidebar has-children'>", "<header class=site-header>", "<div hidden><main>"):
        assert html_blocks.main_text(f"<body>{wrapper}<article><p>{'words of a reader ' * 9}</p></article></body>", tree) == "", wrapper


def test_tree_knows_its_table():
    tree = html_blocks.train_tree()
    assert all(round(tree.predict(x[:-1])) == x[-1] for x in html_blocks.LABELLED)


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (2, None, None, None), (None, "v", "", "x")], "page_id bigint, url string, html string, text string")
    got = html_blocks.extract(pages).collect()
    wanted = html_blocks.main_text(PAGE, html_blocks.train_tree())
    assert Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got) == Counter({(1, "u", wanted, len(wanted)): 2, (2, None, "", 0): 1, (None, "v", "", 0): 1})
    assert html_blocks.extract(pages.where("false")).count() == 0


# ---------------------------------------------------------------- media
@pytest.mark.parametrize("raw", [b"", b"x", os.urandom(3000), b"\xff" * 1200, b"\xff\x00" * 900, bytes(range(256)) * 9])
def test_media_keeps_every_byte(raw):
    payload = motion_jpeg.padded(raw)
    media = motion_jpeg.store(payload)
    assert motion_jpeg.read_back(media) == payload
    at, size = motion_jpeg.parse_avi(media).frames[0]
    plane = motion_jpeg.decode_frame(media[at : at + size])  # the plain decoder agrees, pixel by pixel
    assert (plane == np.kron(np.frombuffer(payload[:576], np.uint8).reshape(24, 24), np.ones((8, 8), np.uint8))).all()
    assert motion_jpeg.parse_avi(media.replace(b"idx1", b"junk")).frames == motion_jpeg.parse_avi(media).frames


def test_shots():
    media = motion_jpeg.store(motion_jpeg.padded(b"a" * 5760 + b"Zq9 " * 1440 + b"a" * 5760))
    assert [c[1:3] for c in motion_jpeg.clips(media)] == [(0, 10), (10, 10), (20, 10)]
    steady = motion_jpeg.store(motion_jpeg.padded(b"tide and time " * 3000))
    assert len(motion_jpeg.clips(steady)) == 1
    with pytest.raises(ValueError, match="AVI"):
        motion_jpeg.parse_avi(b"nothing")


def test_media_features(docs, rows, empty):
    got = motion_jpeg.media_features(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["payload_bytes"] % 576 == 0 and r["payload_bytes"] >= max(576, r["n_bytes"])
    by_text = dict(zip([(x[0], len((x[1] or "").encode())) for x in rows], [x[1] for x in rows], strict=True))
    for r in got:
        payload = motion_jpeg.padded((by_text[r["doc_id"], r["n_bytes"]] or "").encode())
        assert r["tail_crc32"] == zlib.crc32(payload[-32:]) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        media = motion_jpeg.store(payload)
        assert r["media_bytes"] == len(media) and r["media_sha256"] == hashlib.sha256(media).hexdigest()
        assert [(c["start_s"], c["end_s"]) for c in r["clips"]] == [c[3:] for c in motion_jpeg.clips(media)]
    clips = motion_jpeg.clip_rows(motion_jpeg.to_media(docs))
    assert clips.agg(F.sum("frames")).first()[0] == sum(r["payload_bytes"] for r in got) // 576
    assert motion_jpeg.media_features(empty).count() == 0


# ---------------------------------------------------------------- similarity
def brute_groups(rows):
    sets = []
    for doc_id, text, *_ in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append((doc_id, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()))
    root = list(range(len(sets)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, (a, s) in enumerate(sets):
        for j, (b, t) in enumerate(sets[:i]):
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(sets):
        groups.setdefault(find(i), []).append(d)
    for i, (d, s) in enumerate(sets):
        named = [x for x in groups[find(i)] if x is not None]
        yield d, len(s), (min(named) if named else None) if s else d


def test_similar_groups(docs, rows, empty):
    got = jaccard_join.similar_groups(docs)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == Counter(brute_groups(rows))
    assert jaccard_join.similar_groups(empty).count() == 0


def test_hot_groups(spark):
    """A large group of near copies, dealt in many small deals, with shingles that count as hot."""
    r = np.random.default_rng(8)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(i % 6):
            words[int(r.integers(60))] = f"u{int(r.integers(1000))}"
        rows.append((i, " ".join(words)))
    got = jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), most_rows=3, at_once=2000)
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got.collect()) == Counter(brute_groups(rows))


def test_linked_is_exact():
    r = np.random.default_rng(4)
    for _ in range(300):
        pool = np.unique(r.integers(0, 2**63, 200, dtype=np.uint64))
        a, b = (np.sort(r.choice(pool, int(r.integers(1, 190)), replace=False)) for _ in range(2))
        common = len(np.intersect1d(a, b))
        assert jaccard_join._linked(a, b, 75) == (100 * common >= 75 * (len(a) + len(b) - common))
        bits = [np.frombuffer(jaccard_join.bitmap_of(x), np.uint64) for x in (a, b)]
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(a) + len(b) - 2 * common


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}


# ---------------------------------------------------------------- bounds and names
def test_long_words_do_not_stay_in_memory():
    """5,000 words of 40 kB, in a process of its own: its peak stays far below their 200 MB."""
    import subprocess
    import sys

    code = """
import resource, sys
sys.path.insert(0, sys.argv[1])
from lorekeep.llm.lm_scoring import Words
words = Words(open(sys.argv[2], "rb").read())
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for i in range(500):
    words.places([f"{i}-{k}-".encode() + b"x" * 40_000 for k in range(10)])
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    root = str(Path(lm_scoring.__file__).parents[2])
    grown = int(subprocess.run([sys.executable, "-c", code, root, vocabulary_path("piece_bpe_32k.model")], capture_output=True, text=True, check=True).stdout)
    assert grown < 300_000, f"{grown} kB"


@pytest.mark.parametrize("name", ["key", "score", "n_tokens"])
def test_ids_of_any_name(spark, name):
    docs = spark.createDataFrame([(1, "tide and time"), (2, "tide"), (None, None)], f"{name} bigint, text string")
    got = lm_scoring.score(docs, vocabulary_path("piece_bpe_32k.model"), id_col=name)
    assert got.columns[0] == (name if name == "key" else f"{name}_id") and len(set(got.columns)) == len(got.columns)
    assert {r[0] for r in got.collect()} == {1, 2, None}


def test_windows_are_what_they_are_by_definition():
    r = np.random.default_rng(3)
    lengths = np.concatenate([np.arange(1, 41), r.integers(1, 60, 20)])
    ids, start, pad, keys, scored = r.integers(0, 900, int(lengths.sum())).astype(np.uint16), 900, 901, lm_scoring.KEYS, lm_scoring.SCORED
    plain, at = [], 0
    for text, n in enumerate(lengths.tolist()):
        own = [start, *ids[at : at + n].tolist()]
        for base in range(0, n, scored):
            seen = [own[i] if 0 <= i < len(own) else pad for i in range(base - keys + scored, base + scored)]
            plain.append((seen, [own[i + 1] if i + 1 < len(own) else -1 for i in range(base, base + scored)], text))
        at += n
    for only in (None, r.permutation(len(plain))[:50]):
        found = [x for run in lm_scoring.windows(ids, lengths, start, pad, 16, only) for x in zip(*(y.tolist() for y in run), strict=True)]
        assert found == [plain[i] for i in (range(len(plain)) if only is None else only.tolist())]
