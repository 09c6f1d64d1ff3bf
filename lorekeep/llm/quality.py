"""Quality by co-training.

Two classifiers see a document in two ways that share nothing: one its text content (words, word
shapes, lines, characters), the other its page metadata (language, source, stated size).  Over rounds
each labels, for the other, the documents of the corpus that it is surest of.  Both are then
calibrated on labelled rows that neither was trained on, their calibrated views are combined, and
every document is scored.

The features of all documents are worked out once and written to the shared folder.  Every round
scores all unlabelled documents with them and takes the surest ones by a distributed top-k; the
driver sees the labelled sample (``labelled_rows``, the smallest of a hash of the id) and the rows
that rounds add (``added_rows`` each), nothing else.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.llm.common import cut, kept_until_done, map_arrow, raw_texts

WORD_SLOTS, SHAPE_SLOTS, LANG_SLOTS, SOURCE_SLOTS, SIZE_SLOTS = 1024, 256, 16, 64, 16
TEXT_SIZE = WORD_SLOTS + SHAPE_SLOTS + 15
META_SIZE = LANG_SLOTS + SOURCE_SLOTS + SIZE_SLOTS + 4
_CLASSES = np.zeros(256, np.int64)  # 0 others, 1 lower, 2 upper, 3 digit, 4 white space, 5 punctuation, 6 beyond ASCII
for _i in range(256):
    _c = chr(_i)
    _CLASSES[_i] = 6 if _i > 127 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c.isspace() else 5 if _i > 32 else 0


class _Words(dict):
    """Word to CRC-32 and slot of its shape (letters and digits as classes, runs at most three long)."""

    def __missing__(self, word: bytes) -> int:
        shape, last, run = bytearray(), -1, 0
        for x in word[:64]:
            kind = b"?aA9_?w"[_CLASSES[x]] if _CLASSES[x] != 5 else x
            run = run + 1 if kind == last else 1
            last = kind
            if run <= (3 if _CLASSES[x] == 5 else 1):
                shape.append(kind)
        code = zlib.crc32(bytes(shape)) % SHAPE_SLOTS << 32 | zlib.crc32(word)
        if len(word) <= 64:
            if len(self) > 100_000:
                self.clear()
            self[word] = code
        return code


def text_view(raw: bytes, words: _Words) -> np.ndarray:
    out = np.zeros(TEXT_SIZE, np.float32)
    lines = raw.split(b"\n")
    out[-11:-7] = np.log10(len(lines)) / 3, np.log10(1 + len(raw) / len(lines)) / 4, sum(len(x) < 20 for x in lines) / len(lines), len(set(lines)) / len(lines)
    out[-7:] = np.sqrt(np.bincount(_CLASSES[np.frombuffer(raw, np.uint8)], minlength=7) / max(1, len(raw)))
    found = raw.split()
    if found:
        codes = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
        crc = codes & 0xFFFFFFFF
        n = len(found)
        out[:WORD_SLOTS] = np.sqrt(np.bincount(crc % WORD_SLOTS, minlength=WORD_SLOTS) / n)
        out[WORD_SLOTS : WORD_SLOTS + SHAPE_SLOTS] = np.sqrt(np.bincount(codes >> 32, minlength=SHAPE_SLOTS) / n)
        _, counts = np.unique(crc, return_counts=True)
        out[-15:-11] = np.log10(n) / 4, len(counts) / n, counts.max() / n, (crc[1:] == crc[:-1]).mean() if n > 1 else 0
    return out


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Slots of language, source and size (by powers of two), and what is missing.  Nothing of the text."""
    out = np.zeros(META_SIZE, np.float32)
    size = max(0, n_chars or 0)
    out[zlib.crc32((lang or "").encode()) % LANG_SLOTS] = 1
    out[LANG_SLOTS + zlib.crc32((source or "").encode()) % SOURCE_SLOTS] = 1
    out[LANG_SLOTS + SOURCE_SLOTS + min(SIZE_SLOTS - 1, size.bit_length())] = 1
    out[-4:] = np.log10(1 + size) / 5, lang is None, source is None, n_chars is None
    return out


# ---------------------------------------------------------------- features, packed
def pack_row(row: np.ndarray) -> bytes:
    """Places and values of what isn't zero."""
    at = np.flatnonzero(row)
    return at.astype(np.uint16).tobytes() + row[at].astype(np.float16).tobytes()


def unpack_rows(packed: list[bytes], size: int) -> np.ndarray:
    out = np.zeros((len(packed), size), np.float32)
    for row, data in zip(out, packed, strict=True):
        half = len(data) // 2
        row[np.frombuffer(data[:half], np.uint16)] = np.frombuffer(data[half:], np.float16)
    return out


def packed_logits(packed: list[bytes], weights: np.ndarray) -> np.ndarray:
    """``logit`` of packed rows, without unfolding them."""
    halves = [len(x) // 2 for x in packed]
    places = np.frombuffer(b"".join([x[:h] for x, h in zip(packed, halves, strict=True)]), np.uint16)
    values = np.frombuffer(b"".join([x[h:] for x, h in zip(packed, halves, strict=True)]), np.float16).astype(np.float32)
    row = np.repeat(np.arange(len(packed)), np.array(halves, np.int64) // 2)
    return np.bincount(row, weights=values * weights[places], minlength=len(packed)) + weights[-1]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 120, rate: float = 0.1) -> np.ndarray:
    """Weights and, last, the bias of a logistic regression, by Adam on all rows at once."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    keep = np.full(x.shape[1], ridge, np.float32)
    keep[-1] = 0
    for i in range(1, steps + 1):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y) / len(y) + keep * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return w


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class Model:
    """Weights of both views and of their combination; scores are probabilities of good quality."""

    text: np.ndarray | None = None
    meta: np.ndarray | None = None
    #: slope and offset of each view's calibration, then weights of the combination
    calibration: list[np.ndarray] = field(default_factory=list)
    threshold: float = 0.0

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None:
            return (np.ones(len(text)),) * 3
        return self.of_logits(logit(text, self.text), logit(meta, self.meta))

    def of_logits(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        views = [x * c[0] + c[1] for x, c in zip((text, meta), self.calibration, strict=False)]
        both = logit(np.stack(views, axis=1), self.calibration[2])
        return tuple(1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (*views, both))


#: What gives a round its rows: (text weights, metadata weights, {(view, good): at most}) to the features, in both views,
#: of the unlabelled documents that each view is surest of, good and bad, and has not given before.
Pool = Callable[[np.ndarray, np.ndarray, dict[tuple[int, bool], int]], dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]]]


def co_train(text: np.ndarray, meta: np.ndarray, labels: np.ndarray, pool: Pool | None = None, rounds: int = 3, added_rows: int = 300, most_lost: float = 0.002, floor: float = 0.2) -> Model:
    """Fits both views.  Every fourth labelled row is kept for calibration.

    In each round a view gives the other at most ``added_rows`` rows with its labels, of both classes
    by their share among the labelled.  ``most_lost`` bounds the share of good calibration rows under
    the threshold, which is 0.5 at most, and ``floor`` at least: a few odd or mislabelled good rows
    must not let bad documents through.  With fewer than 20 rows of either class nothing is fitted
    and every document is kept.
    """
    if min((labels == 0).sum(), (labels == 1).sum()) < 20:
        return Model()
    held, views, ridge = np.arange(len(labels)) % 4 == 3, (text, meta), 1e-4
    x, y = [v[~held] for v in views], [labels[~held].astype(np.float32)] * 2
    weights = [logistic(x[k], y[k], ridge) for k in (0, 1)]
    for _ in range(rounds if pool else 0):
        most = {(k, good): max(1, int(added_rows * rate)) for k in (0, 1) for good, rate in ((True, labels.mean()), (False, 1 - labels.mean()))}
        for (k, good), found in sorted(pool(*weights, most).items()):
            other = 1 - k
            x[other], y[other] = np.vstack([x[other], found[other]]), np.concatenate([y[other], np.full(len(found[other]), good, np.float32)])
        weights = [logistic(x[k], y[k], ridge) for k in (0, 1)]
    truth = labels[held].astype(np.float32)
    calibration, calibrated = [], []
    for k in (0, 1):
        raw = logit(views[k][held], weights[k])
        scale = max(1e-6, float(np.abs(raw).mean()))
        c = logistic(raw[:, None] / scale, truth, 1e-3, 300) / np.array([scale, 1], np.float32)
        calibration.append(c)
        calibrated.append(raw * c[0] + c[1])
    calibration.append(logistic(np.stack(calibrated, axis=1), truth, 1e-3, 300))
    model = Model(weights[0], weights[1], calibration)
    score = model.scores(views[0][held], views[1][held])[2]
    good = np.sort(score[truth == 1])
    model.threshold = float(np.clip(good[int(most_lost * len(good))], floor, 0.5)) if len(good) else 0.5
    return model


def _views(batch: pa.RecordBatch, words: _Words, text: str, lang: str, source: str, n_chars: str) -> tuple[np.ndarray, np.ndarray]:
    a = np.array([text_view(x, words) for x in raw_texts(batch.column(text))], np.float32).reshape(-1, TEXT_SIZE)
    others = [batch.column(c).to_pylist() for c in (lang, source, n_chars)]
    b = np.array([meta_view(*m) for m in zip(*others, strict=True)], np.float32).reshape(-1, META_SIZE)
    return a, b


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def row_key(text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars") -> Column:
    """What a score depends on, as one number: with the id it tells rows apart that score differently."""
    return F.xxhash64(text_col, lang_col, source_col, chars_col)


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """``id, a, b, key``: the packed features of every row in both views, and its ``row_key``."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("key", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in _slices(batches):
            a, b = _views(batch, words, text_col, lang_col, source_col, chars_col)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([pack_row(x) for x in v], pa.binary()) for v in (a, b)), batch.column(1)], names=["id", "a", "b", "key"])

    rows = docs.select(F.col(id_col).alias("__id"), row_key(text_col, lang_col, source_col, chars_col).alias("__key"), *dict.fromkeys([text_col, lang_col, source_col, chars_col]))
    return map_arrow(rows, work, schema)


def _labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """One label an id: of several the largest; null ids, and labels that are neither 0 nor 1, don't count."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    return known.groupBy("id").agg(F.max("label").cast("int").alias("label"))


def _fit(features: DataFrame, labels: DataFrame, keep: Callable[[DataFrame], DataFrame], labelled_rows: int, added_rows: int, sure: float, rounds: int) -> Model:
    """``features`` as of ``featured``, ``labels`` as of ``_labelled``."""
    order = F.xxhash64(F.lit(9), F.col("id"))
    labels = keep(labels)
    here = features.select("id").distinct()
    sample = keep(labels.join(here, "id", "left_semi").orderBy(order, "id").limit(labelled_rows))

    def of(ids: DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
        """Features of a bounded number of ids (with other columns), in an order that reruns repeat; the first of repeated ids."""
        rows = features.join(F.broadcast(ids), "id").groupBy(*ids.columns).agg(F.min(F.struct("a", "b")).alias("x")).select(*ids.columns, "x.*").toArrow()
        table = sorted(rows.to_pylist(), key=lambda r: (zlib.crc32(str(r["id"]).encode()), str(r["id"])))
        return table, unpack_rows([r["a"] for r in table], TEXT_SIZE), unpack_rows([r["b"] for r in table], META_SIZE)

    known, text, meta = of(sample)
    given: list[DataFrame] = []

    def pool(text_weights: np.ndarray, meta_weights: np.ndarray, most: dict[tuple[int, bool], int]) -> dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]]:
        weights = (text_weights, meta_weights)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                logits = [packed_logits(batch.column(i + 1).to_pylist(), w) for i, w in enumerate(weights)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.float64()) for x in logits)], names=["id", "t", "m"])

        schema = T.StructType([features.schema["id"], T.StructField("t", T.DoubleType()), T.StructField("m", T.DoubleType())])
        sure_enough = float(np.log(sure / (1 - sure)))
        rows = map_arrow(features.where("id is not null").select("id", "a", "b"), work, schema).where((F.abs("t") >= sure_enough) | (F.abs("m") >= sure_enough))
        scored = keep(rows.join(labels, "id", "left_anti").groupBy("id").agg(F.max("t").alias("t"), F.max("m").alias("m")))
        chosen = None
        for (view, good), k in most.items():
            certainty = F.col("tm"[view]) if good else -F.col("tm"[view])
            surest = scored.where(certainty >= sure_enough)
            for earlier in given:
                surest = surest.join(F.broadcast(earlier.where(F.col("view") == view).select("id")), "id", "left_anti")
            top = surest.orderBy(certainty.desc(), order, "id").limit(k).select("id", F.lit(view).alias("view"), F.lit(good).alias("good"))
            chosen = top if chosen is None else chosen.unionByName(top)
        given.append(keep(chosen))
        table, text, meta = of(given[-1])
        at = {key: np.array([(r["view"], r["good"]) == key for r in table], bool) for key in most}
        return {key: (text[rows], meta[rows]) for key, rows in at.items()}

    return co_train(text, meta, np.array([r["label"] for r in known], int), pool, rounds, added_rows)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars", label_col: str = "quality", labelled_rows: int = 6000, added_rows: int = 300, sure: float = 0.95, rounds: int = 3) -> Model:
    """Fits on at most ``labelled_rows`` labelled documents, and on those of all others that a view is
    ``sure`` of: ``added_rows`` a round and view, the surest.

    Ids may be of any type.  Labels that are null or neither 0 nor 1, and rows without an id, are
    not used; of several labels of one id the largest counts.
    """
    with kept_until_done(docs.sparkSession) as keep:
        features = keep(featured(docs, id_col, text_col, lang_col, source_col, chars_col))
        return _fit(features, _labelled(labels, id_col, label_col), keep, labelled_rows, added_rows, sure, rounds)


def _score_columns(scores: tuple, threshold: float) -> list[pa.Array]:
    return [pa.array(x, pa.float64()) for x in scores] + [pa.array(scores[2] >= threshold, pa.bool_())]


def _score_fields(prefix: str) -> list[T.StructField]:
    return [T.StructField(f"{prefix}{x}", T.DoubleType()) for x in ("text", "meta", "score")] + [T.StructField(f"{prefix}keep", T.BooleanType())]


def score(docs: DataFrame, model: Model, carry: list[str] | None = None, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars", prefix: str = "quality_") -> DataFrame:
    """``carry`` (all columns of ``docs`` if None) with ``<prefix>text``, ``<prefix>meta``, ``<prefix>score`` and ``<prefix>keep``.

    One row a row.  Null texts count as empty, null metadata as empty values; an empty text is
    scored like any other.  Without enough labels every score is 1 and every row is kept.  Columns
    of ``docs`` with the names of new ones are not carried.
    """
    fields = _score_fields(prefix)
    carry = [c for c in (docs.columns if carry is None else carry) if c not in {f.name for f in fields}]
    needed = list(dict.fromkeys([*carry, text_col, lang_col, source_col, chars_col]))
    schema = T.StructType([docs.schema[c] for c in carry] + fields)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two vectors of weights

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, words = shared.value, _Words()
        for batch in _slices(batches):
            scores = fitted.scores(*_views(batch, words, text_col, lang_col, source_col, chars_col))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + _score_columns(scores, fitted.threshold), names=[f.name for f in schema])

    return map_arrow(docs.select(*needed), work, schema)


def fit_and_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars", label_col: str = "quality", labelled_rows: int = 6000, added_rows: int = 300, sure: float = 0.95, rounds: int = 3, prefix: str = "quality_", keys: bool = False) -> DataFrame:
    """``id_col`` and the columns that ``score`` adds (with ``keys`` also ``<prefix>key``, the row's ``row_key``), for
    every row: as ``fit`` and then ``score`` do, reading the texts once."""
    fields = _score_fields(prefix) + [T.StructField(f"{prefix}key", T.LongType())] * keys
    with kept_until_done(docs.sparkSession) as keep:
        features = keep(featured(docs, id_col, text_col, lang_col, source_col, chars_col))
        model = _fit(features, _labelled(labels, id_col, label_col), keep, labelled_rows, added_rows, sure, rounds)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if model.text is None:
                    scores = model.scores(np.zeros(batch.num_rows), np.zeros(batch.num_rows))
                else:
                    scores = model.of_logits(packed_logits(batch.column(1).to_pylist(), model.text), packed_logits(batch.column(2).to_pylist(), model.meta))
                yield pa.RecordBatch.from_arrays([batch.column(0), *_score_columns(scores, model.threshold), *[batch.column(3)] * keys], names=[id_col, *(f.name for f in fields)])

        return cut(map_arrow(features, work, T.StructType([T.StructField(id_col, features.schema["id"].dataType), *fields])))
