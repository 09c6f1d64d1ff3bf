"""Scoring texts with a causal self-attention language model, trained here in numpy.

Texts are words (A-Z lower-cased, ASCII white space parts them) as subword ids of a public
tokenizer, and an end.  The model predicts the class of the next id by one layer of causal
self-attention over a window, and the id within its class by its share of the corpus.  Classes stand
in groups of equal size, so that a class is two choices of a few instead of one of many:

    p(id | before) = softmax(g(x) + bias(last id))[group] * softmax(c(x, group) + bias(last id, group))[class] * count(id) / count(class)

where x is the last id's embedding and what attention over the window adds to it.

Counts of ids and of their neighbours are gathered from every training text; classes, embeddings and
the bias (the logarithm of which class follows the last id how often) come from them.  The attention's
weights are trained by tasks over every window of the training texts, in rounds of local steps whose
results are averaged; each window belongs to one round.  For scoring, windows overlap, each id is
scored once, and all windows of a block go through batched masked attention.

Beside it stands a unigram base over whole words.  Word counts are exact: tasks deal packed runs of
(word hash, count, where it occurs) to bins, a bin adds up its words and returns sums by document.
Words that make up a noticeable share of the corpus (a bounded number) are counted the same way but
looked up from a table when scoring.

Texts are read once.  That pass writes blocks of encoded texts, a few MB of text each, to the shared
folder as a table; training, counting and scoring go on from there, each reading the columns it needs.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lorekeep.llm.common import answered_id, bins_of, cut, map_arrow, raw_texts, staged, type_of

#: Keys of a window, and its last positions, which are the ones it scores: each sees 9 to 24 ids.
KEYS, SCORED = 24, 16
WIDTH, HIDDEN, NEIGHBOURS = 16, 16, 64
#: Classes of ids, in groups of equal size: the next group is predicted, then the class within it.
GROUPS, MEMBERS = 16, 16
CLASSES = GROUPS * MEMBERS
#: Held-out documents: crc32 of the id modulo FOLDS is HELD.
FOLDS, HELD = 7, 2
#: A word is looked up from a table, not in its bin, if it is at least this share of all tokens.
FREQUENT = 1 / 20_000
#: Rounds of training; together they take every window of the training texts once.
ROUNDS = 2
#: Windows of a training step.
AT_ONCE = 128
BLOCK_BYTES = 4 << 20


def is_held_out(doc_id: object) -> bool:
    """A row without id is for training."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


# ---------------------------------------------------------------- words and ids
class Words:
    """Places of words in arrays of their ids and hashes; new words are encoded by the library, all at once.  What is kept takes
    ``most_bytes`` at most, and what one block needs."""

    def __init__(self, model: bytes, most_bytes: int = 48 << 20) -> None:
        import sentencepiece

        self.library, self.most = sentencepiece.SentencePieceProcessor(model_proto=model), most_bytes
        self.reset()

    def reset(self) -> None:
        self.known: dict[bytes, int] = defaultdict(count().__next__)  # a new word gets the next number
        self.starts, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)
        self.hashes = np.zeros(0, np.uint64)
        self.held = 0

    def places(self, words: list[bytes]) -> np.ndarray:
        """Valid until the next call."""
        if self.held > self.most:
            self.reset()
        before = len(self.known)
        at = np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))
        if len(self.known) > before:
            new = list(islice(self.known, before, None))
            # A word holds no line feed, so that all can be decoded in one go.
            encoded = self.library.encode(b"\n".join(new).decode("utf-8", "replace").split("\n"), num_threads=1)
            lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(encoded), np.uint16, int(lengths.sum()))])
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))])
            self.held += 150 * len(new) + sum(map(len, new)) + 2 * int(lengths.sum())  # a place in the table, the word, its ids
        return at

    def id_run(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a run of words, and how many each has."""
        lengths = self.lengths[places]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[places] - ends + lengths, lengths)
        return self.ids[at], lengths


def block_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All words of some texts in one list, and the number of each text's."""
    split = [t.lower().split() for t in texts]
    return [w for x in split for w in x], np.fromiter(map(len, split), np.int64, len(split))


def sequences(words: Words, places: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each text with its end id; lengths by text."""
    ids, lengths = words.id_run(places)
    ends = np.cumsum(counts)
    summed = np.concatenate([[0], np.cumsum(lengths)])
    per_text = summed[ends] - summed[ends - counts]
    out = np.full(len(ids) + len(counts), end, np.uint16)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(per_text + 1) - 1] = False
    out[keep] = ids
    return out, per_text + 1


def in_token_blocks(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[tuple[list, list[bytes]]]:
    ids: list = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= most_bytes:
                yield ids, texts
                ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


# ---------------------------------------------------------------- the model
@dataclass
class Model:
    """``embed`` has a row for each id, one for the start and one for padding.  Class ``c`` is number
    ``c % MEMBERS`` of group ``c // MEMBERS``."""

    classes: np.ndarray  # class of each id
    log_share: np.ndarray  # ln of each id's share of its class
    embed: np.ndarray
    follow: np.ndarray  # logits of the class that comes next, by last id
    weights: dict[str, np.ndarray]
    end: int
    groups: np.ndarray | None = None  # logits of its group

    def __post_init__(self) -> None:
        if self.groups is None:
            self.groups = group_logits(self.follow)

    @property
    def start(self) -> int:
        return len(self.embed) - 2

    @property
    def pad(self) -> int:
        return len(self.embed) - 1


def pack(model: Model) -> tuple:
    """All but the trained weights, small enough to go to every task: sizes are the vocabulary's."""
    halves = [_squeeze(x, np.float16) for x in (model.embed, model.follow, model.groups)]
    return _squeeze(model.classes, np.uint8), _squeeze(model.log_share, np.float32), *halves, model.end


#: The model that this process unpacked last: every task of a worker asks for the same one.
_UNPACKED: dict[bytes, tuple] = {}


def unpack(data: tuple, weights: dict[str, np.ndarray]) -> Model:
    name = xxhash.xxh3_128_digest(data[0]) + xxhash.xxh3_128_digest(data[3])
    if name not in _UNPACKED:
        classes, log_share, *halves, end = data
        embed, follow, groups = (_restore(x, np.float16).astype(np.float32) for x in halves)
        _UNPACKED.clear()
        _UNPACKED[name] = _restore(classes, np.uint8).astype(np.int64), _restore(log_share, np.float32), embed.reshape(-1, WIDTH), follow.reshape(-1, CLASSES), end, groups.reshape(-1, GROUPS)
    classes, log_share, embed, follow, end, groups = _UNPACKED[name]
    return Model(classes, log_share, embed, follow, weights, end, groups)


def first_weights(seed: int = 1) -> dict[str, np.ndarray]:
    """``qk`` is the product of the query and key projections, ``vo`` that of values and output: embeddings
    are not trained, so that only these products count."""
    r = np.random.default_rng(seed)
    make = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
    biased = lambda x: np.concatenate([x, np.zeros_like(x[..., :1, :])], axis=-2)  # noqa: E731  the last row meets a column of ones
    return {
        "near": np.zeros((SCORED, KEYS), np.float32), "qk": make(WIDTH, WIDTH), "vo": make(WIDTH, WIDTH) * np.float32(0.3),
        "h": make(WIDTH, HIDDEN), "hb": np.zeros(HIDDEN, np.float32), "u": make(HIDDEN, WIDTH) * np.float32(0.3),
        "g": biased(make(WIDTH, GROUPS) * np.float32(0.1)), "c": biased(make(GROUPS, WIDTH, MEMBERS) * np.float32(0.1)),
    }


def group_logits(follow: np.ndarray) -> np.ndarray:
    """Logits of the next group, by last id: the sums of its classes' shares."""
    by_group = follow.reshape(len(follow), GROUPS, MEMBERS)
    top = by_group.max(axis=2)
    return top + np.log(np.exp(by_group - top[:, :, None]).sum(axis=2))


#: Positions of a window after the query are masked; the query is one of the last SCORED keys.
_LATER = np.where(np.arange(KEYS)[None, :] > np.arange(SCORED)[:, None] + KEYS - SCORED, np.float32(-1e4), np.float32(0))


def windows(ids: np.ndarray, lengths: np.ndarray, start: int, pad: int, at_once: int | None = None, only: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys (windows, KEYS), targets (windows, SCORED; -1 beyond the text) and the text of each window.

    Inputs of a text are the start and all its ids but the last; every id is the target of one
    position of one window.  Comes in runs of ``at_once`` windows; ``only`` names those to make.
    """
    n_windows = -(-lengths // SCORED)
    all_texts = np.repeat(np.arange(len(lengths)), n_windows)
    # Each text as it is read: padding, the start, its ids, and padding to the end of its last window.  A window is a run of that.
    before = KEYS - SCORED + 1
    sizes = n_windows * SCORED + before
    begins, first = np.cumsum(sizes) - sizes, np.cumsum(n_windows) - n_windows
    stream = np.full(int(sizes.sum()), pad, np.int32)
    stream[begins + before - 1] = start
    stream[np.arange(len(ids)) + np.repeat(begins + before - (np.cumsum(lengths) - lengths), lengths)] = ids
    where = np.repeat(begins - first * SCORED, n_windows) + np.arange(len(all_texts)) * SCORED
    runs = np.lib.stride_tricks.sliding_window_view(stream, KEYS + 1) if len(stream) else np.empty((0, KEYS + 1), np.int32)
    numbers = np.arange(len(all_texts)) if only is None else only
    for run in range(0, len(numbers), at_once or max(1, len(numbers))):
        number = numbers[run : run + at_once] if at_once else numbers
        found = runs[where[number]]
        targets = found[:, before:]
        yield found[:, :KEYS], np.where(targets == pad, -1, targets), all_texts[number]


def _by_group(classes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Places of classes that are not -1, equal groups together; and (group, begin, end) of those that occur."""
    groups = (classes // MEMBERS).astype(np.int8)
    order = np.argsort(groups, kind="stable")
    edges = np.cumsum(np.bincount(groups + 1, minlength=GROUPS + 1)).tolist()
    first = edges[0]  # before them comes what has no class
    return order[first:], [(g, edges[g] - first, edges[g + 1] - first) for g in range(GROUPS) if edges[g] < edges[g + 1]]


#: Arrays of one number.  numpy compares with an array several times faster than with the number itself.
_FULL: dict[tuple, np.ndarray] = {}


def _flat_and_full(x: np.ndarray, value: int) -> tuple[np.ndarray, np.ndarray]:
    flat, name = x.reshape(-1), (value, x.dtype)
    if name not in _FULL or len(_FULL[name]) < len(flat):
        _FULL[name] = np.full(len(flat), value, x.dtype)
    return flat, _FULL[name][: len(flat)]


def _cap(x: np.ndarray) -> None:
    """Values at most 50, in place."""
    flat, most = _flat_and_full(x, 50)
    np.minimum(flat, most, out=flat)


def _cut_negative(x: np.ndarray) -> None:
    flat, least = _flat_and_full(x, 0)
    np.maximum(flat, least, out=flat)


def _add_row(x: np.ndarray, row: np.ndarray, at_once: int = 32) -> None:
    """``x += row``, in longer runs than a row."""
    n = len(x) // at_once * at_once
    many = x[:n].reshape(-1, at_once * len(row))
    many += np.tile(row, at_once)
    x[n:] += row


def _wide(x: np.ndarray) -> np.ndarray:
    """``x`` and a column of zeros, so that products with it have room for a column of ones."""
    return np.concatenate([x, np.zeros_like(x[:, :1])], axis=1)


class Scorer:
    """The model with its projections of every embedding worked out, for inference."""

    def __init__(self, model: Model) -> None:
        w, e = model.weights, model.embed
        self.model = model
        self.q = e @ w["qk"] * np.float32(1 / np.sqrt(WIDTH))
        self.near, self.class_of = w["near"] + _LATER, np.append(model.classes, -1)  # the target -1 has the class -1
        self.group_bias, self.class_bias = model.groups + w["g"][WIDTH], model.follow.reshape(-1, MEMBERS)
        self.own_bias = np.ascontiguousarray(w["c"][:, WIDTH])

    def log_probs(self, keys: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """ln p of each target; 0 where there is none."""
        w, m = self.model.weights, self.model
        n, last = len(keys), keys[:, KEYS - SCORED :]
        k = m.embed.take(keys, axis=0)
        z = np.matmul(self.q.take(last, axis=0), k.transpose(0, 2, 1))
        z += self.near
        padding = keys == m.pad
        if len(padded := np.flatnonzero(padding.any(axis=1))):  # only where a text begins or ends
            z[padded] += np.where(padding[padded], np.float32(-1e4), np.float32(0))[:, None, :]
        _cap(z)
        np.exp(z, out=z)
        weight, met = z.reshape(-1, KEYS) @ _ONES[:KEYS], np.matmul(z, k).reshape(-1, WIDTH)
        flat, last = targets.ravel(), last.ravel()
        wanted = self.class_of.take(flat)
        at, runs = _by_group(wanted)
        last, wanted = last.take(at), wanted.take(at)
        x = met.take(at, axis=0) @ w["vo"]
        x /= weight.take(at)[:, None]
        x += m.embed.take(last, axis=0)
        hidden = x @ w["h"]
        _add_row(hidden, w["hb"])
        _cut_negative(hidden)
        x += hidden @ w["u"]
        groups, members, begins = wanted // MEMBERS, wanted % MEMBERS, np.arange(len(at))
        logits = x @ w["g"][:WIDTH]
        logits += self.group_bias.take(last, axis=0)
        own = np.empty((len(at), MEMBERS), np.float32)
        for g, begin, end in runs:
            np.matmul(x[begin:end], w["c"][g, :WIDTH], out=own[begin:end])
        own += self.class_bias.take(last * GROUPS + groups, axis=0)
        own += self.own_bias.take(groups, axis=0)
        total = m.log_share.take(flat.take(at))
        for values, chosen in ((logits, groups), (own, members)):
            _cap(values)
            total += values.reshape(-1).take(begins * values.shape[1] + chosen)
            np.exp(values, out=values)
            total -= np.log(values @ _ONES[: values.shape[1]])
        out = np.zeros(n * SCORED, np.float32)
        out[at] = total
        return out.reshape(n, SCORED)

    def text_scores(self, ids: np.ndarray, lengths: np.ndarray, at_once: int = 256) -> np.ndarray:
        """log10 p of each text."""
        sums = np.zeros(len(lengths))
        for many_keys, many_targets, many_texts in windows(ids, lengths, self.model.start, self.model.pad, 32 * at_once):
            for at in range(0, len(many_texts), at_once):
                values = self.log_probs(many_keys[at : at + at_once], many_targets[at : at + at_once]).sum(axis=1, dtype=np.float64)
                sums += np.bincount(many_texts[at : at + at_once], weights=values, minlength=len(lengths))
        return sums / np.log(10)


_ONES = np.ones(max(GROUPS, MEMBERS, KEYS), np.float32)


def _softmax(logits: np.ndarray) -> None:
    _cap(logits)
    np.exp(logits, out=logits)
    logits /= (logits @ np.ones(logits.shape[1], logits.dtype))[:, None] + np.float32(1e-30)


def with_mask(embed: np.ndarray, pad: int) -> np.ndarray:
    """Embeddings with one more dimension, which a query with a one there adds to its logits: it masks the padding."""
    mask = np.zeros((len(embed), 1), embed.dtype)
    mask[pad] = -1e4
    return np.hstack([embed, mask])


def gradients(w: dict[str, np.ndarray], masked: np.ndarray, group_bias: np.ndarray, class_bias: np.ndarray, keys: np.ndarray, classes: np.ndarray, with_loss: bool = False) -> tuple[float | None, dict[str, np.ndarray]]:
    """Mean loss over the classes that are given (others -1), if asked for, and its gradients.  ``masked`` as of ``with_mask``."""
    n, scale, kind = len(keys), np.float32(1 / np.sqrt(WIDTH)), masked.dtype
    windowed = lambda t: t.reshape(n, -1, t.shape[-1])  # noqa: E731  one product of all rows is faster than one a window
    last = keys[:, KEYS - SCORED :].ravel()
    x = masked.take(keys, axis=0)
    xq = x[:, KEYS - SCORED :].copy().reshape(-1, WIDTH + 1)
    xq[:, WIDTH] = 1
    turned = np.ascontiguousarray(x.transpose(0, 2, 1))
    project = np.eye(WIDTH + 1, dtype=kind)  # the ones stay
    project[:WIDTH, :WIDTH] = w["qk"] * scale
    a = np.matmul(windowed(xq @ project), turned)
    a += w["near"] + _LATER
    _cap(a)
    np.exp(a, out=a)
    by_key = a.reshape(-1, KEYS)
    by_key /= (by_key @ np.ones(KEYS, kind))[:, None] + np.float32(1e-30)
    met = np.matmul(a, x[:, :, :WIDTH]).reshape(-1, WIDTH)
    # What has no class takes no part from here on; the rest is put in order of groups.
    wanted = classes.ravel()
    at, runs = _by_group(wanted)
    total, wanted, last, met = max(1, len(at)), wanted.take(at), last.take(at), met.take(at, axis=0)
    groups, members, begins = wanted // MEMBERS, wanted % MEMBERS, np.arange(len(at))
    x1 = met @ _wide(w["vo"])
    x1 += xq.take(at, axis=0)
    hidden = x1 @ np.concatenate([w["h"], w["hb"][None]])
    _cut_negative(hidden)
    x2 = hidden @ _wide(w["u"])
    x2 += x1
    dg = x2 @ w["g"]
    dg += group_bias.take(last, axis=0)
    dc = np.empty((len(at), MEMBERS), kind)
    for g, begin, end in runs:
        np.matmul(x2[begin:end], w["c"][g], out=dc[begin:end])
    dc += class_bias.take(last * GROUPS + groups, axis=0)
    _softmax(dg)
    _softmax(dc)
    chosen = [(y.reshape(-1), begins * y.shape[1] + of) for y, of in ((dg, groups), (dc, members))]
    loss = -float(np.log(np.maximum(np.prod([y.take(i) for y, i in chosen], axis=0), 1e-30)).sum()) / total if with_loss else None
    for y, i in chosen:
        y[i] = y.take(i) - 1
    grad = {"g": x2.T @ dg, "c": np.zeros_like(w["c"])}
    d2 = np.empty((len(at), WIDTH), kind)
    for g, begin, end in runs:
        own = dc[begin:end]
        np.matmul(x2[begin:end].T, own, out=grad["c"][g])
        np.matmul(own, w["c"][g, :WIDTH].T, out=d2[begin:end])
    d2 += dg @ w["g"][:WIDTH].T
    grad["u"] = hidden.T @ d2
    dh = d2 @ w["u"].T
    dh *= hidden > 0
    both = x1.T @ dh
    grad["h"], grad["hb"] = both[:WIDTH], both[WIDTH]
    d2 += dh @ w["h"].T
    grad["vo"] = met.T @ d2
    dmet = d2 @ _wide(w["vo"].T)
    dmet[:, WIDTH] = (dmet[:, :WIDTH] * met) @ np.ones(WIDTH, kind)  # the mean of what each key gets
    back = np.zeros((n * SCORED, WIDTH + 1), kind)
    back[at] = dmet
    turned[:, WIDTH] = -1  # takes off the mean
    da = np.matmul(windowed(back), turned)
    da *= a
    grad["near"] = da.sum(axis=0)
    grad["qk"] = (xq.T @ np.matmul(da, x[:, :, :WIDTH]).reshape(-1, WIDTH))[:WIDTH] * scale
    return loss, {k: g * np.float32(1 / total) for k, g in grad.items()}  # sums so far


class Adam:
    """All weights are views of one vector, so that a step is a few operations."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float) -> None:
        self.rate, self.t, self.names = rate, 0, list(weights)
        self.all = np.concatenate([x.ravel() for x in weights.values()])
        self.m, self.v = np.zeros_like(self.all), np.zeros_like(self.all)
        ends = np.cumsum([x.size for x in weights.values()])
        self.w = {k: self.all[end - x.size : end].reshape(x.shape) for (k, x), end in zip(weights.items(), ends, strict=True)}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        x = np.concatenate([g[k].ravel() for k in self.names])
        self.m += 0.1 * (x - self.m)
        self.v += 0.01 * (x * x - self.v)
        self.all -= (self.rate / (1 - 0.9**self.t)) * self.m / (np.sqrt(self.v * (1 / (1 - 0.99**self.t))) + 1e-8)


# ---------------------------------------------------------------- what is gathered from the corpus
def _neighbour(ids: np.ndarray) -> np.ndarray:
    return (ids.astype(np.uint32) * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64) % NEIGHBOURS


def _squeeze(x: np.ndarray, kind: type) -> bytes:
    """Numbers as byte planes, compressed."""
    x = np.ascontiguousarray(x, kind)
    bits = x.view(f"u{x.itemsize}")
    return zstandard.compress(b"".join([(bits >> bits.dtype.type(8 * i)).astype(np.uint8).tobytes() for i in range(x.itemsize)]), 1)


def _restore(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    out = np.empty(planes.shape[1], kind)
    for i, plane in enumerate(planes):
        out.view(np.uint8)[i :: out.itemsize] = plane
    return out


class Tally:
    """How often each of ``size`` codes comes in a task; codes are kept until there are enough to be worth a pass over the counts."""

    def __init__(self, size: int, most: int = 4_000_000) -> None:
        self.counts, self.most, self.held, self.waiting = np.zeros(size, np.uint32), most, 0, []

    def add(self, codes: np.ndarray) -> None:
        self.waiting.append(codes.astype(np.int32))
        self.held += len(codes)
        if self.held >= self.most:
            self.total()

    def total(self) -> np.ndarray:
        if self.held:
            codes, step = np.sort(np.concatenate(self.waiting)), 1 << 20  # a slice of the counts at a time
            edges = np.searchsorted(codes, np.arange(0, len(self.counts) + step, step))
            for i, begin in enumerate(range(0, len(self.counts), step)):
                at = slice(begin, min(begin + step, len(self.counts)))
                self.counts[at] += np.bincount(codes[edges[i] : edges[i + 1]] - begin, minlength=at.stop - begin).astype(np.uint32)
            self.held, self.waiting = 0, []
        return self.counts


def _summed(rows: DataFrame, by: str, parts: int, add: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Adds up what map tasks answer for each of a few ``parts``, in two levels: some tasks' answers first, so that
    no task gets those of all."""
    some = max(1, int(math.sqrt(rows.count() / max(1, parts))))
    return map_arrow(map_arrow(rows.repartition(some), add, schema).repartition(parts, by), add, schema)


def _row_key(doc_id: object, raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw, seed=zlib.crc32(repr(doc_id).encode()))


#: Bytes of input that a bin of words stands for.
BIN_BYTES = 32 << 20
#: Columns of a block of encoded texts, with the type of their numbers.
BLOCK = {"held": np.uint8, "keys": np.uint64, "tokens": np.uint32, "run": np.uint16, "lengths": np.uint32, "hashes": np.uint64, "trained": np.uint32, "pair_word": np.uint32, "pair_doc": np.uint32, "times": np.uint32}


def _encoded(docs: DataFrame, tokenizer: object, vocabulary: int, end: int, id_type: str, id_kind: pa.DataType) -> DataFrame:
    """Three kinds of rows: blocks of encoded texts (``ids`` and the columns of BLOCK); parts of the
    counts of neighbours over training texts; words that may be frequent."""
    size, parts = vocabulary + 1, 16  # the start has counts too
    step, wide = -(-size // parts) * NEIGHBOURS, size * NEIGHBOURS
    schema = f"ids array<{id_type}>, {', '.join(f'{c} binary' for c in BLOCK)}, part int, after binary, before binary, texts bigint, words bigint, word bigint"
    kinds = dict(zip([x.split()[0] for x in schema.split(", ")], [pa.list_(id_kind), *[pa.binary()] * len(BLOCK), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()], strict=True))

    def rows(n: int, **columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in kinds.items()], names=list(kinds))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, neighbour = Words(tokenizer.value), _neighbour(np.arange(size)).astype(np.int32)
        after, before, texts, total = Tally(wide), Tally(wide), 0, 0
        for doc_ids, raw in in_token_blocks(batches, BLOCK_BYTES):
            found, counts = block_words(raw)
            places = words.places(found)
            run, lengths = sequences(words, places, counts, end)
            held = np.array([is_held_out(i) for i in doc_ids])
            doc = np.repeat(np.arange(len(raw)), counts)
            used = np.flatnonzero(np.bincount(places, minlength=len(words.hashes)))
            rank = np.zeros(len(words.hashes), np.int64)
            rank[used] = np.arange(len(used))
            local = rank[places]
            trained = np.bincount(local[~held[doc]], minlength=len(used))
            pairs, times = np.unique(local * np.int64(len(raw)) + doc, return_counts=True)
            own = int(trained.sum())
            often = np.flatnonzero(trained >= max(2, FREQUENT * own / 2))
            if len(often):
                yield rows(len(often), words=trained[often].tolist(), word=words.hashes[used[often]].view(np.int64).tolist())
            block = (held, [_row_key(i, t) for i, t in zip(doc_ids, raw, strict=True)], counts + 1, run, lengths, words.hashes[used], trained, pairs // len(raw), pairs % len(raw), times)
            yield rows(1, ids=[doc_ids], **{c: [_squeeze(np.asarray(x, k), k)] for (c, k), x in zip(BLOCK.items(), block, strict=True)})
            learnt = np.repeat(~held, lengths)
            previous = np.empty(len(run), np.int32)
            previous[1:] = run[:-1]
            previous[np.cumsum(lengths) - lengths] = vocabulary  # the start
            run, previous = run[learnt].astype(np.int32), previous[learnt]
            after.add(previous * NEIGHBOURS + neighbour[run])
            before.add(run * NEIGHBOURS + neighbour[previous])
            texts, total = texts + int((~held).sum()), total + own
        followed, preceded = after.total(), before.total()
        for i in range(parts):
            at = slice(i * step, (i + 1) * step)
            yield rows(1, part=[i], after=[_squeeze(followed[at], np.int64)], before=[_squeeze(preceded[at], np.int64)], texts=[texts * (i == 0)], words=[total * (i == 0)])

    return map_arrow(docs, work, schema)


def _corpus_counts(encoded: DataFrame, vocabulary: int) -> tuple[np.ndarray, np.ndarray, int, set[int]]:
    """Counts of the neighbour slots after and before each id, number of training texts, hashes of words
    that may be frequent."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for part, *both in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                got = [_restore(x, np.int64) for x in both]
                sums[part] = [x + y for x, y in zip(sums[part], got, strict=True)] if part in sums else got
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *(pa.array([_squeeze(x[i], np.int64) for x in sums.values()], pa.binary()) for i in (0, 1))], names=["part", "after", "before"])

    counts = encoded.where("part is not null")
    summed = _summed(counts.select("part", "after", "before"), "part", 16, add, "part int, after binary, before binary").collect()
    after, before = np.zeros((2, (vocabulary + 1) * NEIGHBOURS))
    step = max((len(_restore(r["after"], np.int64)) for r in summed), default=0)
    for r in summed:  # of fixed size: the vocabulary's
        for total, part in ((after, _restore(r["after"], np.int64)), (before, _restore(r["before"], np.int64))):
            total[r["part"] * step : r["part"] * step + len(part)] += part
    texts, words = counts.agg(F.coalesce(F.sum("texts"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    # At most 2 / FREQUENT words can pass, whatever the corpus.
    passing = encoded.where("word is not null").groupBy("word").agg(F.sum("words").alias("n")).where(F.col("n") >= FREQUENT * words / 2).select("word").collect()
    return after.reshape(-1, NEIGHBOURS), before.reshape(-1, NEIGHBOURS)[:vocabulary], int(texts), {int(r["word"]) for r in passing}


def _cluster(counts: np.ndarray, before: np.ndarray, begins: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Classes of ids by what stands before them (k-means on square roots of shares, weighted by count)."""
    share = np.sqrt((before + 0.01 * before.sum(axis=0) / max(1, before.sum())) / (before.sum(axis=1, keepdims=True) + 0.01))
    x = np.hstack([share, begins[:, None] * 0.5]).astype(np.float32)
    order = np.argsort(-counts, kind="stable")
    centres = x[order[:CLASSES]].copy()
    weight = np.sqrt(counts + 0.1)
    for _ in range(rounds):
        nearest = np.argmin((centres**2).sum(axis=1) - 2 * (x @ centres.T), axis=1)
        for k in range(CLASSES):
            if (mine := nearest == k).any():
                centres[k] = np.average(x[mine], axis=0, weights=weight[mine])
    return _in_groups(centres)[nearest]


def _in_groups(centres: np.ndarray) -> np.ndarray:
    """New numbers of classes: like ones share a group.  Halved along the leading direction until groups have their size."""
    parts = [np.arange(len(centres))]
    while len(parts) < GROUPS:
        halves = []
        for part in parts:
            centred = centres[part] - centres[part].mean(axis=0)
            order = np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")
            halves += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
        parts = halves
    number = np.empty(len(centres), np.int64)
    number[np.concatenate(parts)] = np.arange(len(centres))
    return number


def _embeddings(after: np.ndarray) -> np.ndarray:
    """Ids by what follows them: leading directions of the square roots of shares."""
    total = after.sum(axis=1, keepdims=True)
    x = np.sqrt((after + 5 * after.sum(axis=0) / max(1, after.sum())) / (total + 5))
    weight = np.sqrt(total[:, 0] + 0.1)
    centred = x - np.average(x, axis=0, weights=weight)
    _, vectors = np.linalg.eigh((centred * weight[:, None]).T @ centred)
    out = centred @ vectors[:, ::-1][:, :WIDTH]
    spread = np.sqrt(np.average(out**2, axis=0, weights=weight)) + 1e-6
    return np.vstack([out / spread, np.zeros((1, WIDTH))]).astype(np.float32)  # last, the padding


def _follow(blocks: DataFrame, classes: np.ndarray, vocabulary: int) -> np.ndarray:
    """ln of the share of each class behind each id (and the start), over all training texts; a row of
    zeros for padding."""
    shared, size, parts = blocks.sparkSession.sparkContext.broadcast(classes), vocabulary + 1, 16
    step = -(-size // parts) * CLASSES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(size * CLASSES)
        for batch in batches:
            for block in batch.to_pylist():
                run, lengths, keep = _restore(block["run"], np.uint16).astype(np.int32), _restore(block["lengths"], np.uint32), _restore(block["held"], np.uint8) == 0
                previous = np.empty_like(run)
                previous[1:] = run[:-1]
                previous[np.cumsum(lengths) - lengths] = vocabulary
                learnt = np.repeat(keep, lengths)
                tally.add(previous[learnt] * CLASSES + shared.value[run[learnt]].astype(np.int32))
        counts = tally.total()
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([_squeeze(counts[i * step : (i + 1) * step], np.int64) for i in range(parts)], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums[part] + _restore(x, np.int64) if part in sums else _restore(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_squeeze(x, np.int64) for x in sums.values()], pa.binary())], names=["part", "counts"])

    schema = "part int, counts binary"
    counts = np.zeros(size * CLASSES)
    tasks, delete = staged(map_arrow(blocks.select("run", "lengths", "held"), work, schema))
    summed = _summed(tasks, "part", parts, add, schema).collect()  # of fixed size
    delete()
    for r in summed:
        part = _restore(r["counts"], np.int64)
        counts[r["part"] * step : r["part"] * step + len(part)] += part
    counts = counts.reshape(-1, CLASSES)
    share = (counts.sum(axis=0) + 1) / (counts.sum() + CLASSES)
    logits = np.log((counts + 5 * share) / (counts.sum(axis=1, keepdims=True) + 5))
    return np.vstack([logits, np.zeros((1, CLASSES))]).astype(np.float32)


def in_round(number: np.ndarray, turn: int) -> np.ndarray:
    """Which windows of a block a round trains on."""
    return (number * 2654435761 >> 7) % ROUNDS == turn


def _train(blocks: DataFrame, packed: object, weights: dict[str, np.ndarray], turn: int) -> dict[str, np.ndarray]:
    """One round: every task takes local steps from the same weights; the results are averaged by ids seen."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = unpack(packed.value, weights)
        masked, group_bias, class_bias = with_mask(m.embed, m.pad), m.groups, m.follow.reshape(-1, MEMBERS)
        adam, seen, class_of = Adam(weights, 0.01 if turn == 0 else 0.004), 0, np.append(m.classes, -1)
        for batch in batches:
            for block in batch.to_pylist():
                run, lengths, keep = _restore(block["run"], np.uint16), _restore(block["lengths"], np.uint32).astype(np.int64), _restore(block["held"], np.uint8) == 0
                run, lengths = run[np.repeat(keep, lengths)], lengths[keep]
                number = np.arange(int((-(-lengths // SCORED)).sum()))
                chosen = np.random.default_rng(len(number)).permutation(number[in_round(number, turn)])
                for keys, targets, _ in windows(run, lengths, m.start, m.pad, AT_ONCE, chosen):
                    _, g = gradients(adam.w, masked, group_bias, class_bias, keys, class_of.take(targets))
                    adam.step(g)
                    seen += int((targets >= 0).sum())
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(adam.w)), pa.array([(x * np.float64(seen)).tobytes() for x in adam.w.values()], pa.binary()), pa.array([seen] * len(adam.w), pa.int64())], names=["name", "sums", "seen"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in batches:
            for name, x, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                values = np.frombuffer(x, np.float64)
                sums[name] = [sums[name][0] + values, sums[name][1] + n] if name in sums else [values, n]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x[0].tobytes() for x in sums.values()], pa.binary()), pa.array([x[1] for x in sums.values()], pa.int64())], names=["name", "sums", "seen"])

    schema = "name string, sums binary, seen bigint"
    tasks, delete = staged(map_arrow(blocks.select("run", "lengths", "held"), work, schema))
    rows = _summed(tasks, "name", len(weights), add, schema).collect()  # one row a weight matrix
    delete()
    found = {r["name"]: (np.frombuffer(r["sums"], np.float64) / r["seen"]).astype(np.float32).reshape(weights[r["name"]].shape) for r in rows}
    return weights | found


# ---------------------------------------------------------------- the unigram base
def _base_sums(blocks: DataFrame, frequent: object, bins: int) -> DataFrame:
    """``key, word, part, known, tokens, types``: by document key the sums over its rarer words; with a
    word (hash) the count of a frequent one; with neither, training words and distinct ones of a bin."""
    dealt = "bin int, block string, hashes binary, trained binary, places binary, docs binary, times binary, keys binary"
    names = [x.split()[0] for x in dealt.split(", ")]
    needed = ["keys", "hashes", "trained", "pair_word", "pair_doc", "times"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.array(sorted(frequent.value), np.int64).view(np.uint64)
        for batch in batches:
            for row in batch.to_pylist():
                keys, hashes, trained, pair_word, pair_doc, times = (_restore(row[c], BLOCK[c]) for c in needed)
                block = xxhash.xxh3_128_hexdigest(row["keys"])  # by content, so that retried tasks agree; blocks of equal texts have equal sums
                rare = ~np.isin(hashes, often)[pair_word]
                pair_word, pair_doc, times = pair_word[rare], pair_doc[rare], times[rare]
                bin_ = (hashes % np.uint64(bins)).astype(np.int64)
                by_word, by_pair = np.argsort(bin_, kind="stable"), np.argsort(bin_[pair_word], kind="stable")
                word_edges = np.searchsorted(bin_[by_word], np.arange(bins + 1))
                pair_edges = np.searchsorted(bin_[pair_word][by_pair], np.arange(bins + 1))
                rank = np.empty(len(hashes), np.int64)
                rank[by_word] = np.arange(len(hashes))
                # negative bins go around: the keys of the block's texts
                out = [(-1 - int(block[:6], 16) % bins, block, None, None, None, None, None, keys.tobytes())]
                for b in range(bins):
                    w, p = by_word[word_edges[b] : word_edges[b + 1]], by_pair[pair_edges[b] : pair_edges[b + 1]]
                    if len(w):
                        out.append((b, block, hashes[w].tobytes(), _squeeze(trained[w], np.uint32), _squeeze(rank[pair_word[p]] - word_edges[b], np.uint32), _squeeze(pair_doc[p], np.uint32), _squeeze(times[p], np.uint32), None))
                kinds = [pa.int32(), pa.string(), *[pa.binary()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    answers = "block string, bin int, docs binary, part binary, known binary, keys binary, word bigint, tokens bigint, types bigint"
    kinds = dict(zip([x.split()[0] for x in answers.split(", ")], [pa.string(), pa.int32(), *[pa.binary()] * 4, *[pa.int64()] * 3], strict=True))

    def table(n: int, **columns: list) -> pa.Table:
        return pa.table({c: pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in kinds.items()})

    def meet(group: pa.Table) -> pa.Table:
        """The counts of a bin's words; for each block the sums of its texts over them, packed."""
        rows = group.to_pylist()
        if rows[0]["bin"] < 0:
            return table(len(rows), block=[r["block"] for r in rows], keys=[r["keys"] for r in rows])
        hashes = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows])
        trained = np.concatenate([_restore(r["trained"], np.uint32) for r in rows])
        distinct, where = np.unique(hashes, return_inverse=True)
        count = np.bincount(where, weights=trained, minlength=len(distinct))
        logs, at, sums = np.log10(count + 1), 0, []
        for r in rows:
            n = len(r["hashes"]) // 8
            own = where[at : at + n]
            at += n
            word, doc, times = own[_restore(r["places"], np.uint32)], _restore(r["docs"], np.uint32).astype(np.int64), _restore(r["times"], np.uint32)
            part = np.bincount(doc, weights=times * logs[word])
            known = np.bincount(doc, weights=times * (count[word] > 0))
            there = np.flatnonzero(np.bincount(doc))
            sums.append((r["block"], r["bin"], _squeeze(there, np.uint32), part[there].tobytes(), _squeeze(known[there], np.uint32)))
        often = np.flatnonzero(np.isin(distinct, np.array(sorted(frequent.value), np.int64).view(np.uint64)))
        found = table(len(sums), **dict(zip(("block", "bin", "docs", "part", "known"), zip(*sums, strict=True), strict=True)))
        words = table(len(often), word=distinct[often].view(np.int64).tolist(), tokens=count[often].astype(np.int64).tolist())
        total = table(1, tokens=[int(count.sum())], types=[int((count > 0).sum())])
        return pa.concat_tables([found, words, total])

    def gather(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        keys = np.frombuffer(next(r["keys"] for r in rows if r["keys"] is not None), np.uint64)
        part, known, seen = np.zeros(len(keys)), np.zeros(len(keys), np.int64), set()
        for r in rows:
            # a bin answers once for a block; where the same block comes twice, its answers say the same
            if r["docs"] is not None and r["bin"] not in seen:
                seen.add(r["bin"])
                doc = _restore(r["docs"], np.uint32)
                part[doc] += np.frombuffer(r["part"])
                known[doc] += _restore(r["known"], np.uint32)
        keys, first = np.unique(keys, return_index=True)  # repeated rows
        return pa.table({"key": pa.array(keys.view(np.int64)), "part": pa.array(part[first]), "known": pa.array(known[first])})

    met, delete = staged(map_arrow(blocks.select(*needed), deal, dealt).groupBy("bin").applyInArrow(meet, answers))
    sums = met.where("block is not null").select("block", "bin", "docs", "part", "known", "keys").groupBy("block").applyInArrow(gather, "key bigint, part double, known bigint")
    sums = sums.groupBy("key").agg(F.max("part").alias("part"), F.max("known").alias("known"))  # equal rows of several blocks have equal sums
    none = F.lit(None).cast("bigint")
    both = sums.select("key", none.alias("word"), "part", "known", none.alias("tokens"), none.alias("types")).unionByName(
        met.where("block is null").select(none.alias("key"), "word", F.lit(None).cast("double").alias("part"), none.alias("known"), "tokens", "types")
    )
    result = cut(both)
    delete()
    return result


# ---------------------------------------------------------------- scoring
def score(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row; an id column of the name of another of these
    has ``_id`` behind its name.

    Learns from the documents outside the held-out fold and scores all.  Null and empty texts are
    the end alone.  A row without id is for training.  Repeated rows count as often as they occur in
    training and score alike.  Without any training text base counts are 0 and the model is uniform
    over classes and ids.
    """
    import sentencepiece

    spark = docs.sparkSession
    context = spark.sparkContext
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    vocabulary, end = library.get_piece_size(), library.eos_id()
    tokenizer = context.broadcast(data)  # a model file: its size doesn't depend on the data
    id_type, id_kind = type_of(docs, id_col), to_arrow_type(docs.schema[id_col].dataType)
    docs = docs.select(id_col, text_col)

    encoded, delete = staged(_encoded(docs, tokenizer, vocabulary, end, id_type, id_kind))
    blocks = encoded.where("run is not null").select("ids", *BLOCK)
    after, before, train_texts, frequent_words = _corpus_counts(encoded, vocabulary)
    counts = before.sum(axis=1)
    begins = np.array([library.id_to_piece(i).startswith("▁") for i in range(vocabulary)], np.float32)
    classes = _cluster(counts, before, begins)
    in_class = np.bincount(classes, weights=counts + 0.5, minlength=CLASSES)
    log_share = np.log((counts + 0.5) / in_class[classes]).astype(np.float32)
    follow = _follow(blocks, classes, vocabulary)
    model = Model(classes, log_share, _embeddings(after), follow, first_weights(), end)
    packed, weights = context.broadcast(pack(model)), model.weights
    for turn in range(ROUNDS):
        weights = _train(blocks, packed, weights, turn)

    sums = _base_sums(blocks, context.broadcast(frequent_words), bins_of(docs, BIN_BYTES))
    totals = sums.where("key is null and word is null").agg(F.sum("tokens"), F.sum("types")).first()
    words_total, types = int(totals[0] or 0), int(totals[1] or 0)
    train_tokens, types = words_total + train_texts, types + (train_texts > 0)
    often = context.broadcast({r["word"]: r["tokens"] for r in sums.where("word is not null").select("word", "tokens").collect()})  # bounded by FREQUENT
    schema = f"__id {id_type}, held_out boolean, n_tokens bigint, key bigint, often_part double, often_known bigint, score double"
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, table = Scorer(unpack(packed.value, weights)), often.value
        hashes = np.array(sorted(table), np.int64)
        counts_of = np.array([table[h] for h in hashes.tolist()], float)
        for batch in batches:
            for block in batch.to_pylist():
                held, keys, tokens, run, lengths, own, _, pair_word, pair_doc, times = (_restore(block[c], k) for c, k in BLOCK.items())
                n, c = len(keys), np.full(len(own), -1.0)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, own.view(np.int64)), len(hashes) - 1)
                    c = np.where(hashes[at] == own.view(np.int64), counts_of[at], -1.0)
                often_here = c[pair_word] >= 0
                pair_word, pair_doc, times = pair_word[often_here], pair_doc[often_here], times[often_here]
                part = np.bincount(pair_doc, weights=times * np.log10(c[pair_word] + 1), minlength=n)
                known = np.bincount(pair_doc, weights=times * (c[pair_word] > 0), minlength=n).astype(np.int64)
                scores = scorer.text_scores(run, lengths.astype(np.int64))
                arrays = [pa.array(block["ids"], id_kind), pa.array(held > 0, pa.bool_()), pa.array(tokens.astype(np.int64)), pa.array(keys.view(np.int64)), pa.array(part, pa.float64()), pa.array(known), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    scored = map_arrow(blocks, work, schema)
    by_key = sums.where("key is not null").select("key", "part", "known")
    end_part, end_known = float(np.log10(train_texts + 1)), int(train_texts > 0)
    log_total = float(np.log10(train_tokens + types + 1))
    answer = cut(
        scored.join(by_key, "key", "left").select(
            F.col("__id").alias(answered_id(id_col, ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])),
            "held_out",
            "n_tokens",
            (F.coalesce("known", F.lit(0)) + F.col("often_known") + end_known).cast("bigint").alias("n_known"),
            F.lit(train_tokens).cast("bigint").alias("train_tokens"),
            (F.coalesce("part", F.lit(0.0)) + F.col("often_part") + end_part - F.col("n_tokens") * log_total).alias("base_score"),
            "score",
        )
    )
    delete()
    return answer
