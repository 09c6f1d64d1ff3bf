"""Media columns: AVI with motion JPEG.

Writes bytes as flat 8x8 tiles of baseline gray JPEG frames in an AVI file, parses RIFF indexes,
decodes intra frames, and finds shots where histograms of neighbouring frames differ by more than
an adaptive threshold.  Clips come out as timed rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lorekeep.llm.common import answered_id, in_blocks, map_arrow, raw_texts, type_of

#: A frame holds 24 x 24 tiles, each of one payload byte.
SIDE = 24
FRAME_BYTES = SIDE * SIDE
PAD = 255
FRAMES_PER_SECOND = 25
#: Frames that are encoded, decoded or compared at once; bounds the memory for very long payloads.
FRAMES_AT_ONCE = 4096


# ---------------------------------------------------------------- JPEG tables
# A flat tile has a DC coefficient alone.  Code lengths are chosen so that a DC difference of s bits
# has a code of 9 - s bits: each tile takes 9 bits, and one more for the end of its block.  That is
# a plain Huffman table to any decoder, and lets ours read all tiles of a frame at once.
DC_BITS, TILE_BITS = 9, 10
FRAME_CODE_BYTES = FRAME_BYTES * TILE_BITS // 8


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(1)
def frame_header() -> bytes:
    pixels = SIDE * 8
    dc = bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
    ac = bytes([1] + [0] * 15) + b"\0"
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\0" + bytes([8] * 64))
        + _segment(0xC0, struct.pack(">BHHB", 8, pixels, pixels, 1) + bytes([1, 0x11, 0]))
        + _segment(0xC4, b"\x00" + dc)
        + _segment(0xC4, b"\x10" + ac)
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


@lru_cache(1)
def _codes() -> np.ndarray:
    """Ten bits for each DC difference from -255 to 255."""
    out = np.zeros(511, np.uint64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = (1 << (DC_BITS - s)) - 2  # ones, then a zero
        extra = d if d >= 0 else d + (1 << s) - 1
        out[d + 255] = (code << s | extra) << 1
    return out


def encode_frames(payload: bytes) -> list[bytes]:
    """JPEG frames of a payload of whole frames."""
    head, frames = frame_header(), []
    for at in range(0, len(payload), FRAME_BYTES * FRAMES_AT_ONCE):
        tiles = np.frombuffer(payload[at : at + FRAME_BYTES * FRAMES_AT_ONCE], np.uint8).reshape(-1, FRAME_BYTES).astype(np.int16)
        steps = np.diff(tiles, axis=1, prepend=np.int16(128))
        codes = _codes()[steps + 255].reshape(-1, 4)
        packed = codes[:, 0] << np.uint64(30) | codes[:, 1] << np.uint64(20) | codes[:, 2] << np.uint64(10) | codes[:, 3]
        data = packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].reshape(len(tiles), FRAME_CODE_BYTES)
        frames += [head + row.tobytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9" for row in data]
    return frames


# ---------------------------------------------------------------- AVI
def write_avi(frames: list[bytes], width: int = SIDE * 8, height: int = SIDE * 8, fps: int = FRAMES_PER_SECOND) -> bytes:
    """An AVI file with one motion-JPEG stream and an index."""
    largest = max(map(len, frames), default=0)
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    listed = lambda kind, body: chunk(b"LIST", kind + body)
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    header = listed(b"hdrl", chunk(b"avih", avih) + listed(b"strl", chunk(b"strh", strh) + chunk(b"strf", strf)))
    at, index, parts = 4, [], []
    for frame in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        parts.append(chunk(b"00dc", frame))
        at += len(parts[-1])
    body = b"".join([header, listed(b"movi", b"".join(parts)), chunk(b"idx1", b"".join(index))])
    return chunk(b"RIFF", b"AVI " + body)


@dataclass
class Avi:
    fps: float
    #: (offset, size) of each video frame, in the order of the index
    frames: list[tuple[int, int]]


def parse_avi(data: bytes) -> Avi:
    """Reads the RIFF structure and its index; without an index the frames are found by walking the ``movi`` list."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    fps, movi, index, walked = float(FRAMES_PER_SECOND), 0, [], []
    ends = [(12, min(len(data), 8 + int.from_bytes(data[4:8], "little")))]
    while ends:
        at, end = ends.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            body = at + 8
            if name == b"LIST":
                if data[body : body + 4] == b"movi":
                    movi = body
                ends.append((body + size + size % 2, end))
                at, end = body + 4, min(end, body + size)
                continue
            if name == b"strh" and data[body : body + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", data, body + 20)
                fps = rate / scale if scale and rate else fps
            elif name == b"idx1":
                index = [x for x in struct.iter_unpack("<4sIII", data[body : body + size - size % 16]) if x[0][2:] in (b"dc", b"db")]
            elif name[2:] in (b"dc", b"db") and movi:
                walked.append((body, size))
            if movi and index:
                break
            at = body + size + size % 2
    if index:
        # offsets count from the list's type, or from the start of the file
        base = movi if data[movi + index[0][2] : movi + index[0][2] + 4] == index[0][0] else 0
        return Avi(fps, [(base + at + 8, size) for _, _, at, size in index])
    return Avi(fps, walked)


# ---------------------------------------------------------------- JPEG decoding
@lru_cache(64)
def _parse_header(head: bytes) -> dict:
    """Tables and sizes from the segments before a frame's entropy-coded data."""
    out: dict = {"quant": {}, "huff": {}, "restart": 0}
    at = 2
    while at + 4 <= len(head):
        marker, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
        body = head[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                table = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(float)
                out["quant"][body[0] & 15], body = table, body[1 + 64 * (1 + wide) :]
        elif marker in (0xC0, 0xC1):
            _, height, width, n = struct.unpack_from(">BHHB", body)
            out |= {"width": width, "height": height, "parts": [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]}
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline JPEG frames are decoded")
        elif marker == 0xC4:
            while body:
                lengths = body[1:17]
                values, code, table = body[17 : 17 + sum(lengths)], 0, {}
                k = 0
                for bits, n in enumerate(lengths, 1):
                    for _ in range(n):
                        table[bits, code] = values[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                out["huff"][body[0]], body = table, body[17 + sum(lengths) :]
        elif marker == 0xDD:
            out["restart"] = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            out["scan"] = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
        at += 2 + size
    return out


def _split(frame: bytes) -> tuple[bytes, bytes]:
    """Header with the scan's segment, entropy-coded data."""
    at = 2
    while frame[at + 1] != 0xDA:
        at += 2 + int.from_bytes(frame[at + 2 : at + 4], "big")
    at += 2 + int.from_bytes(frame[at + 2 : at + 4], "big")
    end = frame.rfind(b"\xff\xd9")
    return frame[:at], frame[at : end if end >= at else len(frame)]


#: The zigzag order of JPEG: diagonals, walked in turn up and down.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


@lru_cache(1)
def _cosines() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(8)
    return np.where(k == 0, np.sqrt(1 / 8), 0.5 * np.cos((2 * x + 1) * k * np.pi / 16))


def decode_frame(frame: bytes) -> np.ndarray:
    """The luma plane of a baseline JPEG frame, with any tables, sampling and restarts, bit by bit."""
    head, data = _split(frame)
    t = _parse_header(head)
    across, down = max(p[1] for p in t["parts"]), max(p[2] for p in t["parts"])
    mcus_x, mcus_y = -(-t["width"] // (8 * across)), -(-t["height"] // (8 * down))
    tables = {p: (t["huff"][dc], t["huff"][16 + ac]) for p, dc, ac in t["scan"]}
    _, h0, v0, q0 = t["parts"][0]
    alone = len(t["parts"]) == 1
    if alone:
        mcus_x, mcus_y, h0, v0 = -(-t["width"] // 8), -(-t["height"] // 8), 1, 1
    plane = np.zeros((mcus_y * v0 * 8, mcus_x * h0 * 8))
    runs, begin = [], 0
    for i in range(len(data) - 1):
        if data[i] == 0xFF and 0xD0 <= data[i + 1] <= 0xD7:
            runs.append(data[begin:i])
            begin = i + 2
    runs.append(data[begin:])
    mcu, total = 0, mcus_x * mcus_y
    for run in runs:
        run = run.replace(b"\xff\0", b"\xff")
        bits = np.unpackbits(np.frombuffer(run, np.uint8)).tolist() + [1] * 64
        at, last = 0, dict.fromkeys(tables, 0)
        for _ in range(t["restart"] or total):
            if mcu >= total:
                break
            for p, h, v, q in t["parts"]:
                for block in range(1 if alone else h * v):
                    coefficients, k = np.zeros(64), 0
                    while k < 64:
                        code, n, table = 0, 0, tables[p][k > 0]
                        while (n, code) not in table:
                            code, at, n = code << 1 | bits[at], at + 1, n + 1
                            if n > 16:
                                raise ValueError("no such Huffman code")
                        skip, size = table[n, code] >> 4, table[n, code] & 15
                        if k and not size:
                            if skip != 15:
                                break
                            k += 16
                            continue
                        k += skip if k else 0
                        value = 0
                        for bit in bits[at : at + size]:
                            value = value << 1 | bit
                        at += size
                        if size and value < 1 << (size - 1):
                            value -= (1 << size) - 1
                        if k == 0:
                            last[p] = value = last[p] + value
                        coefficients[ZIGZAG[k]] = value * t["quant"][q][k]
                        k += 1
                    if p == t["parts"][0][0]:
                        tile = _cosines().T @ coefficients.reshape(8, 8) @ _cosines()
                        y = (mcu // mcus_x * v0 + block // h0) * 8
                        x = (mcu % mcus_x * h0 + block % h0) * 8
                        plane[y : y + 8, x : x + 8] = tile
            mcu += 1
    return np.clip(np.round(plane[: t["height"], : t["width"]] + 128), 0, 255).astype(np.uint8)


@lru_cache(1)
def _steps() -> np.ndarray:
    """The DC difference of each ten bits."""
    out = np.zeros(1 << TILE_BITS, np.int16)
    out[_codes().astype(np.int64)] = np.arange(-255, 256)
    return out


def decode_tiles(data: bytes, frames: list[tuple[int, int]]) -> np.ndarray:
    """One sample for each 8x8 tile of each frame, as rows of uint8.

    Frames with our own tables are read all at once; any other baseline frame goes through the
    plain decoder, and its tiles are their rounded means.
    """
    head = frame_header()
    codes = [data[at + len(head) : at + size - 2].replace(b"\xff\0", b"\xff") if data[at : at + len(head)] == head else None for at, size in frames]
    if all(c is not None and len(c) == FRAME_CODE_BYTES for c in codes):
        five = np.frombuffer(b"".join(codes), np.uint8).reshape(-1, 5)
        wide = np.zeros((len(five), 8), np.uint8)
        wide[:, 3:] = five
        packed = wide.view(">u8").astype(np.uint64)
        parts = np.concatenate([packed >> np.uint64(x) & np.uint64(1023) for x in (30, 20, 10, 0)], axis=1)
        steps = _steps()[parts.astype(np.int64)].reshape(len(frames), FRAME_BYTES)
        return (np.cumsum(steps, axis=1, dtype=np.int16) + 128).astype(np.uint8)
    planes = [decode_frame(data[at : at + size]).astype(float) for at, size in frames]
    cropped = [p[: p.shape[0] // 8 * 8, : p.shape[1] // 8 * 8] for p in planes]
    return np.array([np.round(p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).mean(axis=(1, 3))).astype(np.uint8).ravel() for p in cropped])


# ---------------------------------------------------------------- shots
@dataclass
class Shots:
    first: list[int]  # first frame of each shot
    frames: int
    mean: float  # of all samples
    change: float  # mean difference of neighbouring frames


def histograms(tiles: np.ndarray, bins: int = 16) -> np.ndarray:
    n = len(tiles)
    index = (tiles.astype(np.int64) * bins >> 8) + np.arange(n)[:, None] * bins
    return np.bincount(index.ravel(), minlength=n * bins).reshape(n, bins)


def find_shots(data: bytes, avi: Avi, window: int = 12, spread: float = 3.0, least: float = 0.12) -> Shots:
    """A shot begins where the histogram difference exceeds both ``least`` and the mean of the
    ``window`` differences before it by ``spread`` deviations (and half that mean)."""
    differences, total, last, samples = [], 0, None, 0
    for at in range(0, len(avi.frames), FRAMES_AT_ONCE):
        tiles = decode_tiles(data, avi.frames[at : at + FRAMES_AT_ONCE])
        total += int(tiles.sum(dtype=np.int64))
        samples += tiles.size
        h = histograms(tiles)
        rows = h if last is None else np.vstack([last, h])
        differences.append(np.abs(np.diff(rows, axis=0)).sum(axis=1) / (2 * tiles.shape[1]))
        last = h[-1]
    d = np.concatenate(differences) if differences else np.zeros(0)
    first = [0] if avi.frames else []
    if len(d):
        sums, squares = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
        i = np.arange(len(d))
        low = np.maximum(0, i - window)
        n = np.maximum(1, i - low)
        mean = (sums[i] - sums[low]) / n
        deviation = np.sqrt(np.maximum(0, (squares[i] - squares[low]) / n - mean**2))
        first += (np.flatnonzero((d > least) & (d > mean + spread * deviation) & (d > 1.5 * mean)) + 1).tolist()
    return Shots(first, len(avi.frames), total / max(1, samples), float(d.mean()) if len(d) else 0.0)


def clips(data: bytes) -> list[tuple[int, int, int, float, float]]:
    """Timed clips of an AVI: number, first frame, frames, start and end in seconds."""
    avi = parse_avi(data)
    return _timed(find_shots(data, avi), avi.fps)


def _timed(shots: Shots, fps: float) -> list[tuple[int, int, int, float, float]]:
    ends = [*shots.first[1:], shots.frames]
    return [(i, a, b - a, a / fps, b / fps) for i, (a, b) in enumerate(zip(shots.first, ends, strict=True))]


def clip_rows(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row a clip of each AVI in ``media_col``; null media gives none."""
    schema = f"{id_col} {type_of(media, id_col)}, clip int, first_frame int, frames int, start_s double, end_s double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *c) for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if x for c in clips(x)]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [batch.column(0).type, pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[id_col, "clip", "first_frame", "frames", "start_s", "end_s"])

    return map_arrow(media.select(id_col, media_col), work, schema)


# ---------------------------------------------------------------- texts as media
def padded(raw: bytes) -> bytes:
    """The bytes with 255s up to a positive multiple of a frame."""
    return raw + bytes([PAD]) * (max(1, -(-len(raw) // FRAME_BYTES)) * FRAME_BYTES - len(raw))


def store(payload: bytes) -> bytes:
    return write_avi(encode_frames(payload))


def read_back(data: bytes) -> bytes:
    frames = parse_avi(data).frames
    return b"".join(decode_tiles(data, frames[at : at + FRAMES_AT_ONCE]).tobytes() for at in range(0, len(frames), FRAMES_AT_ONCE))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, media``: each text as an AVI file."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches, text_col, 16 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([store(padded(x)) for x in raw_texts(batch.column(1))], pa.binary())], names=[id_col, "media"])

    return map_arrow(docs.select(id_col, text_col), work, f"{id_col} {type_of(docs, id_col)}, media binary")


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as AVI, reads the stored bytes back and describes them, one row a text.

    Null and empty texts are one frame of padding.  The feature is ``frames|shots|longest
    shot|mean sample|mean change``, from the decoded frames; ``clips`` are the times of the shots.  Repeated rows give repeated results.
    """
    id_name = answered_id(id_col, ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"])
    schema = f"{id_name} {type_of(docs, id_col)}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, clips array<struct<start_s:double,end_s:double>>"
    names = [x.split()[0] for x in schema.split(", ")]

    def described(raw: bytes) -> tuple:
        media = store(padded(raw))
        avi = parse_avi(media)
        payload, tail = hashlib.sha256(), b""
        size = 0
        for at in range(0, len(avi.frames), FRAMES_AT_ONCE):
            part = decode_tiles(media, avi.frames[at : at + FRAMES_AT_ONCE]).tobytes()
            payload.update(part)
            size, tail = size + len(part), (tail + part)[-32:]
        shots = find_shots(media, avi)
        longest = max(np.diff([*shots.first, shots.frames]).tolist(), default=0)
        feature = f"{shots.frames}|{len(shots.first)}|{longest}|{shots.mean:.4f}|{shots.change:.6f}"
        return len(raw), size, payload.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature, [{"start_s": c[3], "end_s": c[4]} for c in _timed(shots, avi.fps)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [described(x) for x in raw_texts(batch.column(1))]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))]
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return map_arrow(docs.select(id_col, text_col), work, schema)
