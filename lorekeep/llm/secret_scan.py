"""Secrets in texts: three fixed patterns, and formats that probabilistic automata learn.

What the patterns find stays.  Beyond that, formats are inferred from labelled credentials: made examples of
known formats, and what the patterns find in the corpus (a bounded sample of distinct values, those of
smallest hash).  The credentials of a label form a prefix tree over classes of characters; its states are
merged where ends and next symbols agree within Hoeffding's bound, which gives a probabilistic automaton for
each label.  Ordinary runs (made ones, and a bounded sample of runs that no pattern touches) give another.
Every candidate, a run of at least ``least_chars`` characters of credentials, is scored by the log of its
likelihood under the likeliest label against that under the ordinary automaton, and is a secret if that
outweighs the odds against.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import answered_id, kept_until_done, map_arrow, type_of
from lorekeep.workers import ship

ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: A run that is too short holds no run that isn't: the least length may stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
BASE_KINDS = ("assign", "access", "hex")
LEAST_ASSIGNED = 12

#: Classes of characters: what a symbol of the automata is.
CLASSES = ["0123456789", "ae", "bcdf", "iou", "ghjklmnpqrstvwxyz", "AE", "BCDF", "IOU", "GHJKLMNPQRSTVWXYZ", "+", "/", "_", ".", "=", "-"]
SYMBOLS = len(CLASSES)
_CLASS_OF = bytearray(b"\xff" * 256)
for _i, _letters in enumerate(CLASSES):
    for _c in _letters:
        _CLASS_OF[ord(_c)] = _i
CLASS_OF = bytes(_CLASS_OF)

DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
ALNUM = DIGITS + LOWER + UPPER
URL_SAFE = ALNUM + "_-"
#: Formats of credentials that their issuers document, as literals and (alphabet, length).
FORMATS: dict[str, list[list[str | tuple[str, int]]]] = {
    "cloud_key": [["AKIA", (UPPER + DIGITS, 16)], ["ASIA", (UPPER + DIGITS, 16)]],
    "host_token": [["ghp_", (ALNUM, 36)], ["gho_", (ALNUM, 36)], ["glpat-", (URL_SAFE, 20)]],
    "chat_token": [["xoxb-", (DIGITS, 11), "-", (DIGITS, 12), "-", (ALNUM, 24)]],
    "payment_key": [["sk_live_", (ALNUM, 24)], ["rk_live_", (ALNUM, 24)]],
    "service_key": [["AIza", (URL_SAFE, 35)]],
    "web_token": [["eyJ", (URL_SAFE, 33), ".eyJ", (URL_SAFE, 60), ".", (URL_SAFE, 43)]],
    "base64": [[(ALNUM + "+/", 40)], [(ALNUM + "+/", 43), "="], [(ALNUM + "+/", 22), "=="]],
    "hex": [[("0123456789abcdef", 32)], [("0123456789abcdef", 40)], [("0123456789abcdef", 64)]],
}
ORDINARY = "ordinary"


def made_credentials(label: str, n: int, seed: int = 1) -> list[str]:
    """``n`` examples of a format, the same for the same seed."""
    r = random.Random(f"{label}:{seed}")
    draw = lambda part: part if isinstance(part, str) else "".join(r.choice(part[0]) for _ in range(part[1]))
    return ["".join(map(draw, FORMATS[label][i % len(FORMATS[label])])) for i in range(n)]


def made_ordinary(n: int, seed: int = 1) -> list[str]:
    """Ordinary runs: long words, names in code, paths, hosts, dates, numbers, identifiers, rules of one character."""
    r = random.Random(f"ordinary:{seed}")
    syllable = lambda: r.choice("bcdfghjklmnprstvw") + r.choice("aeiou") + r.choice(["", "", "n", "r", "st", "l", "ng"])
    word = lambda: "".join(syllable() for _ in range(r.randint(1, 4)))
    digits = lambda k: "".join(r.choice(DIGITS) for _ in range(k))
    makes = [
        lambda: "".join(syllable() for _ in range(r.randint(7, 14))),
        lambda: "_".join(word() for _ in range(r.randint(3, 6))),
        lambda: "-".join(word() for _ in range(r.randint(3, 6))),
        lambda: word() + "".join(word().title() for _ in range(r.randint(2, 5))),
        lambda: "_".join(word().upper() for _ in range(r.randint(3, 6))),
        lambda: "/" + "/".join(word() for _ in range(r.randint(3, 6))) + r.choice(["", ".html", ".py", "/index.php"]),
        lambda: "www." + word() + word() + r.choice([".com/", ".org/", ".net/"]) + "/".join(word() for _ in range(r.randint(1, 3))),
        lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{digits(2)}.{digits(2)}.{digits(2)}",
        lambda: ".".join(digits(r.randint(1, 3)) for _ in range(r.randint(5, 8))),
        lambda: "-".join(digits(4) for _ in range(r.randint(4, 6))),
        lambda: digits(r.randint(16, 24)),
        lambda: r.choice("-=_.") * r.randint(16, 60),
        lambda: f"{word()}_{word()}-{r.randint(1, 30)}.{r.randint(0, 20)}.{r.randint(0, 9)}.{r.choice(['tar', 'zip', 'whl'])}",
        lambda: f"{word().title()}-{word().title()}/{word()}{digits(4)}",
    ]
    return [makes[i % len(makes)]() for i in range(n)]


@dataclass
class Tree:
    """A prefix tree of strings of symbols, or what merging has made of it."""

    arrived: list[int] = field(default_factory=lambda: [0])
    ended: list[int] = field(default_factory=lambda: [0])
    counts: list[dict[int, int]] = field(default_factory=lambda: [{}])
    targets: list[dict[int, int]] = field(default_factory=lambda: [{}])

    def add(self, symbols: bytes) -> None:
        at = 0
        self.arrived[0] += 1
        for s in symbols:
            self.counts[at][s] = self.counts[at].get(s, 0) + 1
            if s not in self.targets[at]:
                self.targets[at][s] = len(self.arrived)
                self.arrived.append(0)
                self.ended.append(0)
                self.counts.append({})
                self.targets.append({})
            at = self.targets[at][s]
            self.arrived[at] += 1
        self.ended[at] += 1

    def compatible(self, one: int, other: int, width: float) -> bool:
        """Whether ends and next symbols of two states, and of all that follows both, agree within the bound."""
        open_pairs = [(one, other)]
        while open_pairs:
            a, b = open_pairs.pop()
            n, m = self.arrived[a], self.arrived[b]
            bound = width * (n**-0.5 + m**-0.5)
            if abs(self.ended[a] / n - self.ended[b] / m) > bound:
                return False
            x, y = self.counts[a], self.counts[b]
            if any(abs(x.get(s, 0) / n - y.get(s, 0) / m) > bound for s in x.keys() | y.keys()):
                return False
            open_pairs += [(self.targets[a][s], self.targets[b][s]) for s in x.keys() & y.keys()]
        return True

    def fold(self, into: int, other: int) -> None:
        """Adds a subtree to a state; the edge that led to it has been turned already."""
        open_pairs = [(into, other)]
        while open_pairs:
            a, b = open_pairs.pop()
            self.arrived[a] += self.arrived[b]
            self.ended[a] += self.ended[b]
            for s, n in self.counts[b].items():
                self.counts[a][s] = self.counts[a].get(s, 0) + n
                if s in self.targets[a]:
                    open_pairs.append((self.targets[a][s], self.targets[b][s]))
                else:
                    self.targets[a][s] = self.targets[b][s]


@dataclass
class Automaton:
    """Log probabilities of symbols (the last column: of the end) by state, and where they lead.  The last state
    is where strings go on that the examples don't know."""

    label: str
    steps: np.ndarray
    logs: np.ndarray


def infer(label: str, examples: Iterable[str], confidence: float = 0.01) -> Automaton:
    """Merges the states of the examples' prefix tree, those of most arrivals first, each with the first settled
    state that it is compatible with, or else settles it.  No examples give the automaton that knows nothing."""
    tree = Tree()
    for example in examples:
        tree.add(example.encode().translate(CLASS_OF))
    width = math.sqrt(0.5 * math.log(2 / confidence))
    settled = [0]
    known = {0}
    while True:
        edges = [(tree.arrived[t], -i, s, t) for i, state in enumerate(settled) for s, t in tree.targets[state].items() if t not in known]
        if not edges:
            break
        _, i, s, state = max(edges)
        for other in settled:
            if tree.compatible(other, state, width):
                tree.targets[settled[-i]][s] = other
                tree.fold(other, state)
                break
        else:
            settled.append(state)
            known.add(state)
    place = {state: i for i, state in enumerate(settled)}
    unknown = len(settled)
    steps = np.full((unknown + 1, SYMBOLS), unknown, np.int32)
    logs = np.full((unknown + 1, SYMBOLS + 1), -math.log(SYMBOLS + 1))
    for state, i in place.items():
        seen = np.zeros(SYMBOLS + 1)
        for s, n in tree.counts[state].items():
            seen[s] = n
            steps[i, s] = place[tree.targets[state][s]]
        seen[SYMBOLS] = tree.ended[state]
        logs[i] = np.log((seen + 0.1) / (seen.sum() + 0.1 * len(seen)))
    return Automaton(label, steps, logs)


class Scorer:
    """Log likelihoods of many strings under several automata at once."""

    def __init__(self, automata: list[Automaton], most_cells: int = 1 << 20) -> None:
        self.labels = [a.label for a in automata]
        begins = np.cumsum([0] + [len(a.steps) for a in automata])
        self.begins = begins[:-1]
        self.steps = np.concatenate([a.steps + b for a, b in zip(automata, self.begins, strict=True)])
        self.logs = np.concatenate([a.logs for a in automata])
        self.most = most_cells

    def logs_of(self, strings: list[str]) -> np.ndarray:
        """One row a string, one column an automaton."""
        out = np.empty((len(strings), len(self.labels)))
        order = sorted(range(len(strings)), key=lambda i: -len(strings[i]))
        begin = 0
        while begin < len(order):
            longest = max(1, len(strings[order[begin]]))
            some = order[begin : begin + max(1, self.most // longest)]
            out[some] = self._block([strings[i] for i in some])
            begin += len(some)
        return out

    def _block(self, strings: list[str]) -> np.ndarray:
        """Strings from long to short; those that have ended are behind those that go on."""
        lengths = np.array([len(s) for s in strings])
        symbols = np.frombuffer("".join(strings).encode().translate(CLASS_OF), np.uint8)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        states = np.tile(self.begins, (len(strings), 1))
        total = np.zeros(states.shape)
        for i in range(lengths[0] if len(lengths) else 0):
            going = int(np.searchsorted(-lengths, -i, "left"))  # longer than i
            s = symbols[starts[:going] + i][:, None]
            at = states[:going]
            total[:going] += self.logs[at, s]
            states[:going] = self.steps[at, s]
        return total + self.logs[states, SYMBOLS]

    def best(self, strings: list[str]) -> tuple[np.ndarray, list[str]]:
        """The log likelihood ratio of each string's likeliest label against ordinary, and the label."""
        if not strings:
            return np.zeros(0), []
        logs = self.logs_of(strings)
        ordinary = self.labels.index(ORDINARY)
        rest = [i for i in range(len(self.labels)) if i != ordinary]
        first = logs[:, rest].argmax(axis=1)
        return logs[:, rest].max(axis=1) - logs[:, ordinary], [self.labels[rest[i]] for i in first]


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, place of the kind, end, value) of what the three patterns find, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    found.sort()
    return found


class Candidates:
    """Runs of credentials' characters: padding at the end alone, no dots or dashes at either end."""

    def __init__(self, least_chars: int) -> None:
        self.least = least_chars
        self.runs = re.compile(r"[A-Za-z0-9+/_.-]{%d,}={0,2}" % max(1, least_chars - 2))

    def of(self, text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int]]:
        """Those that share no character with a span of the patterns."""
        out, k = [], 0
        covered: list[list[int]] = []
        for start, _, end, _ in base:
            if covered and start <= covered[-1][1]:
                covered[-1][1] = max(covered[-1][1], end)
            else:
                covered.append([start, end])
        for m in self.runs.finditer(text):
            run = m[0]
            start, end = m.start() + len(run) - len(run.lstrip(".-")), m.end() - len(run) + len(run.rstrip(".-"))
            if end - start < self.least:
                continue
            while k < len(covered) and covered[k][1] <= start:
                k += 1
            if k == len(covered) or covered[k][0] >= end:
                out.append((start, end))
        return out


def labelled_values(docs: DataFrame, text_col: str, labelled_rows: int, ordinary_rows: int, least_chars: int, most_chars: int = 256) -> DataFrame:
    """``label, value``: distinct values that the patterns find (by kind) and ordinary runs, of each label those of
    smallest hash, as many as the two bounds say.  Longer values than ``most_chars`` teach nothing."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, kept = Candidates(least_chars), {}

        def offer(label: str, value: str) -> None:
            if len(value) > most_chars:
                return
            most = ordinary_rows if label == ORDINARY else labelled_rows
            heap, have = kept.setdefault(label, ([], set()))
            if value in have:
                return
            key = (-int.from_bytes(hashlib.blake2b(value.encode(), digest_size=7).digest(), "big"), value)
            if len(heap) < most:
                heapq.heappush(heap, key)
            elif key > heap[0]:
                have.discard(heapq.heappushpop(heap, key)[1])
            else:
                return
            have.add(value)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                base = base_spans(text or "")
                for _, kind, _, value in base:
                    offer(BASE_KINDS[kind], value)
                for start, end in finder.of(text or "", base):
                    offer(ORDINARY, text[start:end])
        rows = [(label, value, -negative) for label, (heap, _) in kept.items() for negative, value in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["label", "value", "hash"])

    found = map_arrow(docs.select(F.col(text_col)), work, "label string, value string, hash bigint").groupBy("label", "value").agg(F.min("hash").alias("hash"))
    most = F.when(F.col("label") == ORDINARY, ordinary_rows).otherwise(labelled_rows)
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("hash", "value"))).where(F.col("place") <= max(labelled_rows, ordinary_rows))
    return ranked.where(F.col("place") <= most).select("label", "value")


def automata(spark: SparkSession, labelled: DataFrame, made: int = 300) -> list[Automaton]:
    """One automaton a label, each inferred by a task of its own from the label's bounded examples."""
    examples = [(label, value) for label in FORMATS for value in made_credentials(label, made)] + [(ORDINARY, value) for value in made_ordinary(5 * made)]
    every = spark.createDataFrame(examples, "label string, value string").unionByName(labelled)

    def learn(rows: pa.Table) -> pa.Table:
        label = rows.column("label")[0].as_py()
        made = infer(label, sorted(rows.column("value").to_pylist()))
        return pa.table([[label], [made.steps.tobytes()], [made.logs.tobytes()]], names=["label", "steps", "logs"])

    ship(spark)
    learned = every.groupBy("label").applyInArrow(learn, "label string, steps binary, logs binary").collect()
    return [Automaton(r.label, np.frombuffer(r.steps, np.int32).reshape(-1, SYMBOLS), np.frombuffer(r.logs).reshape(-1, SYMBOLS + 1)) for r in sorted(learned)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled_rows: int = 500, ordinary_rows: int = 2_000, least_chars: int = 16, odds_against: float = 1e5) -> DataFrame:
    """``id_col`` (``secrets_id`` if that is called ``secrets``) and ``secrets`` of every row: ``(kind, start, end, score)`` by start, then kind.

    Kinds are those of the patterns, ``assign``, ``access`` and ``hex``, whose spans stand whatever their
    score, then ``like_<label>`` for candidates beyond them.  Places are code points, the end exclusive.
    The score is the log of the likelihood ratio of the value.  Null and empty texts have no secrets;
    rows may repeat and ids be null; an empty table gives no rows.  Other columns are not read.  The automata
    learn from ``labelled_rows`` values a label and ``ordinary_rows`` ordinary ones at most; every candidate of
    every text is scored.
    """
    spark = docs.sparkSession
    id_name = answered_id(id_col, ["secrets"])
    with kept_until_done(spark) as keep:
        labelled = keep(labelled_values(docs, text_col, labelled_rows, ordinary_rows, least_chars))
        learned = automata(spark, labelled)
    shared = spark.sparkContext.broadcast(learned)  # a few hundred states, by the bounds of their examples
    least_score = math.log(odds_against)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    schema = f"`{id_name}` {type_of(docs, id_col)}, secrets array<struct<kind:string,start:bigint,end:bigint,score:double>>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, finder = Scorer(shared.value), Candidates(least_chars)
        for batch in batches:
            found = []  # (row, start, place of the kind, end, value)
            for row, text in enumerate(batch.column(1).to_pylist()):
                base = base_spans(text or "")
                found += [(row, *x) for x in base]
                found += [(row, start, 3, end, text[start:end]) for start, end in finder.of(text or "", base)]
            values = list({x[4] for x in found})
            scores, labels = scorer.best(values)
            of = {v: (float(s), label) for v, s, label in zip(values, scores, labels, strict=True)}
            secrets: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for row, start, place, end, value in sorted(found):
                score, label = of[value]
                if place < 3 or score >= least_score:
                    secrets[row].append({"kind": BASE_KINDS[place] if place < 3 else f"like_{label}", "start": start, "end": end, "score": score})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(secrets, kind)], names=[id_name, "secrets"])

    return map_arrow(docs.select(F.col(id_col), F.col(text_col)), work, schema)
