"""Media columns: motion-JPEG in AVI.

A payload is stored as grey frames of WIDTH x HEIGHT samples, one byte a sample. Each frame is a lossless JPEG (SOF3,
predictor 1: the sample to the left, or above at the start of a line, 128 at first) with a Huffman table in which code
and extra bits of every difference take nine bits. Frames are `00dc` chunks of a RIFF AVI file with an `idx1` index.
The reader follows the index, decodes all frames of a batch in step (any Huffman table that fits in 16 bits), and finds
shots: a frame opens a shot if the histogram difference to the frame before exceeds the mean of the last SPAN
differences by DEVIATIONS standard deviations and FLOOR. Shots become timed clip rows.

Defined results: null counts as empty; an empty text is one frame of spaces; equal texts give equal files; null doc_ids
stay; an empty table gives an empty result; other columns are ignored. A file that is not such an AVI raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import words

WIDTH, HEIGHT, RATE = 16, 12, 25
FRAME = WIDTH * HEIGHT
SPAN, DEVIATIONS, FLOOR = 8, 3.0, 0.1
_LENGTHS = bytes([1] * 9 + [0] * 7)  # one code of each length from 1 to 9 ...
_SYMBOLS = bytes(range(8, -1, -1))  # ... for the categories 8 down to 0


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_JPEG_HEAD = b"\xff\xd8" + _segment(0xC3, struct.pack(">BHHBBBB", 8, HEIGHT, WIDTH, 1, 1, 0x11, 0)) + _segment(0xC4, b"\x00" + _LENGTHS + _SYMBOLS) + _segment(0xDA, b"\x01\x01\x00\x01\x00\x00")


def _code_words() -> np.ndarray:
    """The nine bits of each difference from -255 to 255, as a row of bits."""
    out = np.zeros((511, 9), np.uint8)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << s) - 1
        value = ((1 << (8 - s)) - 1) << (s + 1) | extra
        out[d + 255] = [value >> k & 1 for k in range(8, -1, -1)]
    return out


_CODE = _code_words()


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """One JPEG for each row of FRAME samples."""
    x = samples.reshape(-1, HEIGHT, WIDTH).astype(np.int16)
    d = x.copy()
    d[:, :, 1:] -= x[:, :, :-1]
    d[:, 1:, 0] -= x[:, :-1, 0]
    d[:, 0, 0] -= 128
    scans = np.packbits(_CODE[d.reshape(len(x), FRAME) + 255].reshape(len(x), -1), axis=1)
    size, raw = scans.shape[1], scans.tobytes()
    return [_JPEG_HEAD + raw[i : i + size].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for i in range(0, len(raw), size)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(frames: list[bytes], n_bytes: int) -> bytes:
    """The AVI file of the frames; the payload's unpadded size stands in its INFO list."""
    largest, n = max(map(len, frames)), len(frames)
    avih = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, n, 0, 1, largest, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, RATE, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"bytes=%d" % n_bytes))
    movi = b"movi" + b"".join(b"00dc" + struct.pack("<I", len(f)) + f + (b"\0" if len(f) & 1 else b"") for f in frames)
    size = np.array([len(f) for f in frames], np.int64)
    at = 4 + np.concatenate([[0], np.cumsum(size + (size & 1) + 8)[:-1]])
    index = np.zeros((n, 4), "<u4")
    index[:, 0], index[:, 1], index[:, 2], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, at, size
    body = b"AVI " + hdrl + info + _chunk(b"LIST", movi) + _chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse(data: bytes) -> tuple[list[bytes], int]:
    """The frames that the index names, and the payload's unpadded size."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index, n_bytes = 12, 0, b"", -1
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"LIST" and data[at + 8 : at + 12] == b"INFO":
            comment = data[at + 20 : at + 20 + int.from_bytes(data[at + 16 : at + 20], "little")]
            n_bytes = int(comment.partition(b"bytes=")[2] or -1)
        elif name == b"idx1":
            index = data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if not movi or not index:
        raise ValueError("no frames or no index")
    rows = np.frombuffer(index, "<u4").reshape(-1, 4)[:, 2:].tolist()
    return [data[movi + a + 8 : movi + a + 8 + n] for a, n in rows], n_bytes


def _scan(jpeg: bytes) -> tuple[bytes, bytes]:
    """The tables of a frame (everything before the scan's data) and the data without stuffing."""
    if jpeg.startswith(_JPEG_HEAD):
        return _JPEG_HEAD, jpeg[len(_JPEG_HEAD) : -2].replace(b"\xff\x00", b"\xff")
    at = 2
    while jpeg[at : at + 2] != b"\xff\xda":
        if at + 4 > len(jpeg) or jpeg[at] != 0xFF:
            raise ValueError("not a JPEG frame")
        at += 2 + int.from_bytes(jpeg[at + 2 : at + 4], "big")
    at += 2 + int.from_bytes(jpeg[at + 2 : at + 4], "big")
    return jpeg[:at], jpeg[at:-2].replace(b"\xff\x00", b"\xff")


def _tables(head: bytes) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Height, width, and for every 16-bit look-ahead the code's length and its category."""
    at, height, width, length, category = 2, 0, 0, np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    while at < len(head):
        marker, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
        body = head[at + 4 : at + 2 + size]
        if marker == 0xC3:
            depth, height, width, parts = struct.unpack(">BHHB", body[:6])
            if depth != 8 or parts != 1:
                raise ValueError("one component of 8 bits is expected")
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only lossless frames (SOF3) are read")
        elif marker == 0xC4:
            code, k = 0, 17
            for bits, n in enumerate(body[1:17], 1):
                for _ in range(n):
                    here = slice(code << (16 - bits), (code + 1) << (16 - bits))
                    length[here], category[here] = bits, body[k]
                    code, k = code + 1, k + 1
                code <<= 1
        elif marker == 0xDA and body[3] != 1:
            raise ValueError("only predictor 1 is read")
        at += 2 + size
    return height, width, length, category


def decode_frames(jpegs: list[bytes]) -> np.ndarray:
    """The samples of frames that share their tables, a row for each; all frames are decoded in step."""
    parts = [_scan(j) for j in jpegs]
    if len({h for h, _ in parts}) > 1:
        raise ValueError("frames with differing tables")
    height, width, length, category = _tables(parts[0][0])
    stride = max(len(s) for _, s in parts) + 8
    flat = np.frombuffer(b"".join(s.ljust(stride, b"\xff") for _, s in parts), np.uint8).astype(np.uint32)
    ahead = np.zeros(len(flat), np.uint32)
    for k in range(4):
        ahead[: len(flat) - 3] |= flat[k : len(flat) - 3 + k] << np.uint32(24 - 8 * k)
    at = np.arange(len(parts), dtype=np.int64) * stride * 8
    d = np.empty((height * width, len(parts)), np.int64)
    for i in range(height * width):
        look = (ahead[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(16)
        at += length[look]
        s = category[look]
        extra = (ahead[at >> 3] << (at & 7).astype(np.uint32)).astype(np.int64) >> (32 - s)
        at += s
        d[i] = np.where(extra >> np.maximum(s - 1, 0) != 0, extra, extra - (1 << s) + 1)
    x = d.reshape(height, width, -1)
    x[0, 0] += 128
    x[:, 0] = np.cumsum(x[:, 0], axis=0)
    return np.cumsum(x, axis=1).astype(np.uint8).reshape(height * width, -1).T


def shots(samples: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which frames open a shot. samples: a row a frame; first: number of frames before each video (one entry more)."""
    n = len(samples)
    bins = np.bincount((np.arange(n)[:, None] * 16 + (samples >> 4)).ravel(), minlength=16 * n).reshape(n, 16)
    diff = np.zeros(n)
    diff[1:] = np.abs(np.diff(bins, axis=0)).sum(1) / (2 * samples.shape[1])
    counts = np.diff(first)
    place = np.arange(n) - np.repeat(first[:-1], counts)  # frame number in its video
    diff[place == 0] = 0
    total, square = (np.concatenate([[0], np.cumsum(np.round(v * 2**20).astype(np.int64))]) for v in (diff, diff * diff))  # in integers, so that a video's place in a batch changes nothing
    low = np.arange(n) - np.minimum(np.maximum(place - 1, 0), SPAN)
    held = np.maximum(np.arange(n) - low, 1)
    mean, mean2 = ((t[np.arange(n)] - t[low]) / held / 2**20 for t in (total, square))
    return (place == 0) | (place > 1) & (diff > mean + DEVIATIONS * np.sqrt(np.maximum(mean2 - mean * mean, 0)) + FLOOR)


def payload_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's bytes padded with spaces to a positive multiple of FRAME, and the frames before each."""
    size = np.diff(off)
    frames = np.maximum(1, -(-size // FRAME))
    first = np.concatenate([[0], np.cumsum(frames)])
    out = np.full(first[-1] * FRAME, 32, np.uint8)
    out[np.arange(len(raw)) + np.repeat(first[:-1] * FRAME - off[:-1], size)] = raw
    return out.reshape(-1, FRAME), first


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, buf, off in words.slices(batches):
        samples, first = payload_of(buf, off)
        frames = encode_frames(samples)
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([avi(frames[a:b], int(n)) for a, b, n in zip(first[:-1], first[1:], np.diff(off), strict=True)], pa.binary())], ["doc_id", "media"])


def media(docs: DataFrame) -> DataFrame:
    """doc_id and media: every whole text as an AVI file."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encode, "doc_id bigint, media binary")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes], list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, files, sizes, samples, frames before each file and shot openings, by runs of rows."""
    for rows, _, _ in words.slices(batches, "media"):
        files = rows.column(1).to_pylist()
        parsed = [parse(f) for f in files]
        first = np.concatenate([[0], np.cumsum([len(p) for p, _ in parsed])])
        samples = decode_frames([f for p, _ in parsed for f in p])
        yield rows.column(0), files, [n for _, n in parsed], samples, first, shots(samples, first)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, files, sizes, samples, first, opens in _decoded(batches):
        raw = memoryview(np.ascontiguousarray(samples).tobytes())
        payloads = [raw[FRAME * a : FRAME * b] for a, b in zip(first[:-1], first[1:], strict=True)]
        feature = [f"{b - a} frames; shots at " + " ".join(map(str, np.flatnonzero(opens[a:b]).tolist())) for a, b in zip(first[:-1], first[1:], strict=True)]
        sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(map(len, payloads), pa.int64()), sha(payloads), pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()), pa.array(map(len, files), pa.int64()), sha(files), pa.array(feature, pa.string())], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def features(videos: DataFrame) -> DataFrame:
    """Digests of media(doc_id, media): read back, decoded, with the shots as a feature."""
    return videos.mapInArrow(_features, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, _, _, _, first, opens in _decoded(batches):
        start = np.flatnonzero(opens)
        of = np.searchsorted(first, start, "right") - 1
        end = np.append(start[1:], first[-1])
        base = first[of]
        nth = np.arange(len(start)) - np.searchsorted(start, first[:-1])[of]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), pa.array(nth.astype(np.int32)), pa.array((start - base) / RATE), pa.array((end - base) / RATE), pa.array((end - start).astype(np.int64))], ["doc_id", "clip", "start_s", "end_s", "n_frames"])


def clips(videos: DataFrame) -> DataFrame:
    """A row for each shot of media(doc_id, media): doc_id, clip, start_s, end_s, n_frames."""
    return videos.mapInArrow(_clips, "doc_id bigint, clip int, start_s double, end_s double, n_frames bigint")


def digest(docs: DataFrame) -> DataFrame:
    return features(media(docs))
