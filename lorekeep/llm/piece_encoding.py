"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the vocabulary holds a word mark behind another character, so no merge crosses the
place before a mark, and a text's segmentation is that of its marked words, one after another.
Each distinct marked word is segmented once by the library; the ids are joined back by position.
Line feeds that no piece holds are cut points too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from sys import getsizeof

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import answered_id, in_blocks, map_arrow, type_of

MARK = "▁"
#: A run of marks (or spaces, which the library turns into marks) with what follows it up to the next one or a
#: line feed; or what follows a line feed; or line feeds.
CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}\n]*|[^ {MARK}\n]+|\n+")


class ChunkTable:
    """Ids of chunks, and the decoded text of those that don't decode to themselves.

    What is kept takes ``most_bytes`` at most, in two generations: a full young one becomes the old one,
    whose chunks move back as they are met again, so that frequent chunks are segmented once a task.
    """

    def __init__(self, model_path: str | bytes, most_bytes: int = 16 << 20) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model_path) if isinstance(model_path, bytes) else sentencepiece.SentencePieceProcessor(model_file=model_path)
        library = self.library
        numbers = range(library.get_piece_size())
        pieces = [library.id_to_piece(i) for i in numbers]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
            raise ValueError("pieces of this model cross word marks or line feeds; chunks can't be segmented alone")
        self.head = library.encode("\n")
        if len(self.head) != 2 or library.normalize("a  b ") != f"{MARK}a{MARK}{MARK}b{MARK}":
            raise ValueError("this model normalises white space; chunks can't be segmented alone")
        special = lambda i: library.is_control(i) or library.is_unknown(i) or library.is_byte(i)
        #: The text of each piece; that of special ones can be part of no chunk.
        self.texts = ["\0\n" if special(i) else p.replace(MARK, " ") for i, p in zip(numbers, pieces, strict=True)]
        self.shown = [f"{i} " for i in numbers]
        self.end, self.most = str(library.eos_id()), most_bytes
        self.young: dict[str, str] = {}  # each decimal id with a space behind it
        self.old: dict[str, str] = {}
        self.unlike: dict[str, str] = {}  # of chunks of either generation
        self.held = 0

    def learn(self, chunks: list[list[str]]) -> None:
        """Afterwards all of ``chunks`` are young."""
        if self.held > self.most:
            self.old, self.young, self.held = self.young, {}, 0
            self.unlike = {c: x for c, x in self.unlike.items() if c in self.old}
        new = []
        for chunk in set().union(*chunks).difference(self.young):
            if (known := self.old.get(chunk)) is None:
                new.append(chunk)
            else:
                self._keep(chunk, known)
        text_of, shown_as = self.texts.__getitem__, self.shown.__getitem__
        # Behind a line feed no mark is added, and nothing merges with it.
        for chunk, ids in zip(new, self.library.encode(["\n" + c for c in new], num_threads=1), strict=True):
            ids = ids[2:]
            # Pieces that spell the chunk decode to it; only others need the library's word.
            if "".join(map(text_of, ids)) != chunk and (decoded := self.library.decode([*self.head, *ids])[1:]) != chunk:
                self.unlike[chunk] = decoded
            self._keep(chunk, "".join(map(shown_as, ids)))

    def _keep(self, chunk: str, ids: str) -> None:
        self.young[chunk] = ids
        self.held += 40 + getsizeof(chunk) + getsizeof(ids) + getsizeof(self.unlike.get(chunk))  # a place in the table, and what stands there

    def encode(self, texts: list[str]) -> list[tuple[str, str, int]]:
        """For each text: its decimal ids joined by a space (the end id last), decoded text, number of ids."""
        chunked = [CHUNK.findall(" " + t) if t else [] for t in texts]
        self.learn(chunked)
        ids_of, out = self.young.__getitem__, []
        for text, chunks in zip(texts, chunked, strict=True):
            ids = "".join(map(ids_of, chunks)) + self.end
            decoded = text if not self.unlike or self.unlike.keys().isdisjoint(chunks) else "".join([self.unlike.get(c, c) for c in chunks])[1:]
            out.append((ids, decoded, ids.count(" ") + 1))
        return out


def encode(docs: DataFrame, model: str | bytes, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, kept_bytes: int = 16 << 20, block_bytes: int = 1 << 20) -> DataFrame:
    """``id_col, n_tokens, ids, decoded`` for every row; with ``digests`` SHA-256 of both instead.

    ``ids`` are those of the library with an end id and no sampling.  Null and empty texts have
    the end id alone and decode to the empty text.  Ids may be null or repeated; other columns are
    not read.  The chunk table of a task takes twice ``kept_bytes`` and what one block needs at most.
    """
    kind = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    id_name = answered_id(id_col, ["n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"])
    schema = f"{id_name} {type_of(docs, id_col)}, n_tokens bigint, {kind}"
    names = [x.split()[0] for x in schema.split(", ")]
    if isinstance(model, str):
        with open(model, "rb") as f:
            model = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a model file: its size doesn't depend on the data

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(shared.value, kept_bytes)
        for batch in in_blocks(batches, text_col, block_bytes):
            found = table.encode([x or "" for x in batch.column(1).to_pylist()])
            if digests:
                sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
                last = [pa.array([sha(x[0]) for x in found], pa.string()), pa.array([sha(x[1]) for x in found], pa.string())]
            else:
                last = [pa.array([list(map(int, x[0].split())) for x in found], pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[2] for x in found], pa.int64()), *last], names=names)

    return map_arrow(docs.select(id_col, F.col(text_col)), work, schema)


def decode(encoded: DataFrame, model: str | bytes, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the library's text of ``ids_col``; null ids give null."""
    if isinstance(model, str):
        with open(model, "rb") as f:
            model = f.read()
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def text_of(ids):  # noqa: ANN001, ANN202
        import pandas as pd
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        return pd.Series([None if x is None else library.decode([int(i) for i in x]) for x in ids])

    return encoded.withColumn(out_col, text_of(ids_col))
