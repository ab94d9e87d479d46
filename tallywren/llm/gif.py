"""Operator 3: GIF media columns.

``decode`` reads any GIF87a/89a stream: colour tables, interlacing, LZW code streams of
growing width (with deferred clears), and renders timed frames under the disposal and
transparency rules. ``encode`` writes 8-bit samples as frames of a grey palette, so that a
payload comes back byte for byte through the rendering. ``frames`` stores one row for each timed
frame with colour-histogram columns.

The width of a code depends only on its number since the last clear code, so all codes up
to the next one are cut out of the stream at once, and only the strings are built one by one.

Frames are rendered one at a time, so that only the canvas and one frame are held beside the stream.

Defined cases: a null or empty text is an empty payload of 64 zero bytes; a text of any length is stored whole, in as many frames as it fills; broken streams raise
``ValueError`` in ``decode`` and give no frames in ``frames``; a frame that runs short is padded
with its first colour; equal and repeated texts give equal media; nothing is ranked, so there are no ties; an empty table gives an empty result; other columns are passed by, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import as_bytes, cut

WIDTH, FRAME_ROWS, DELAY = 64, 1024, 10
BINS = 16
FULL = 4096


class Frame(NamedTuple):
    left: int
    top: int
    width: int
    height: int
    delay: int  # hundredths of a second
    disposal: int
    pixels: np.ndarray  # the canvas as shown: height x width x RGBA
    samples: np.ndarray  # the frame's own indices: height x width


_WIDTHS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _schedule(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths and bit offsets of the codes after a clear code, until the table is full."""
    if bits not in _WIDTHS:
        n = FULL - (1 << bits) - 2 + 1
        entries = (1 << bits) + 2 + np.maximum(np.arange(n) - 1, 0)  # entries that a reader has as it reads code i
        width = np.full(n, bits + 1)
        for w in range(bits + 2, 13):
            width[entries >= 1 << (w - 1)] = w
        _WIDTHS[bits] = width, np.concatenate([[0], np.cumsum(width)])
    return _WIDTHS[bits]


def _codes_at(data: np.ndarray, offsets: np.ndarray, widths: np.ndarray) -> np.ndarray:
    at = offsets >> 3
    word = data[at] | data[at + 1] << 8 | data[at + 2] << 16
    return word >> (offsets & 7) & ((1 << widths) - 1)


def lzw_decode(stream: bytes, bits: int, size: int) -> bytes:
    """At most ``size`` samples of an LZW code stream."""
    clear, end = 1 << bits, (1 << bits) + 1
    data = np.frombuffer(stream + b"\0" * 4, np.uint8).astype(np.int64)
    total = len(stream) * 8
    widths, ends = _schedule(bits)
    literals = [bytes([v]) for v in range(clear)] + [b""] * 2
    out: list[bytes] = []
    at = got = 0
    while at + bits + 1 <= total and got < size:
        n = int(np.searchsorted(ends, total - at, "right")) - 1
        codes = _codes_at(data, at + ends[:n], widths[:n])
        stop = np.flatnonzero((codes == clear) | (codes == end))
        k = int(stop[0]) if len(stop) else n
        table = literals.copy()
        got += _emit(out, codes[:k].tolist(), table)
        at += int(ends[k + bool(len(stop))])
        if not len(stop) and n == len(widths):  # a full table stays until it is cleared
            while not len(stop) and at + 12 <= total and got < size:
                m = min(FULL, (total - at) // 12)
                codes = _codes_at(data, at + 12 * np.arange(m), np.full(m, 12))
                stop = np.flatnonzero((codes == clear) | (codes == end))
                k = int(stop[0]) if len(stop) else m
                part = [table[c] for c in codes[:k].tolist()]
                out += part
                got += sum(map(len, part))
                at += 12 * (k + bool(len(stop)))
        if len(stop) and codes[k] == end:
            break
    return b"".join(out)[:size]


def _emit(out: list[bytes], codes: list[int], table: list[bytes]) -> int:
    """Appends the strings of the codes after a clear code and fills the table; their length in all."""
    if not codes:
        return 0
    if codes[0] >= len(table) - 2:
        raise ValueError("LZW code beyond the table")
    first = len(out)
    last = table[codes[0]]
    out.append(last)
    add, put = table.append, out.append
    for c in codes[1:]:
        try:
            now = table[c]
        except IndexError:
            if c > len(table):
                raise ValueError("LZW code beyond the table") from None
            now = last + last[:1]
        add(last + now[:1])
        put(now)
        last = now
    if len(table) > FULL:
        del table[FULL:]
    return sum(map(len, out[first:]))


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """The LZW code stream of the samples; the table is cleared when it is full."""
    clear, end = 1 << bits, (1 << bits) + 1
    runs: list[list[int]] = []
    codes: list[int] = []
    free, room = end + 1, FULL - 1
    own = -1  # beside the samples, each node of the trie holds its code
    roots: list[dict] = [{own: v} for v in range(clear)]
    node: dict | None = roots[samples[0]] if samples else None
    for b in samples[1:]:
        nxt = node.get(b)
        if nxt is not None:
            node = nxt
            continue
        codes.append(node[own])
        if free == room:
            codes.append(clear)
            runs.append(codes)
            codes, free = [], end + 1
            roots = [{own: v} for v in range(clear)]
        else:
            node[b] = {own: free}
            free += 1
        node = roots[b]
    if node is not None:
        codes.append(node[own])
    codes.append(end)
    runs.append(codes)
    widths, _ = _schedule(bits)
    flat = np.array([clear, *(c for r in runs for c in r)], np.uint16)
    width = np.concatenate([[bits + 1], *(widths[: len(r)] for r in runs)])
    shifts = np.arange(12, dtype=np.uint16)
    grid = (flat[:, None] >> shifts & 1).astype(np.uint8)
    return np.packbits(grid[shifts < width[:, None]], bitorder="little").tobytes()


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


GREY = bytes(v for v in range(256) for _ in range(3))


def encode(payload: bytes, width: int = WIDTH, rows: int = FRAME_ROWS, delay: int = DELAY) -> bytes:
    """A GIF whose frames hold the payload's bytes as grey samples, ``width`` to a row."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must be a positive multiple of the width")
    lines = len(payload) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, lines), 0xF7, 0, 0), GREY, b"!\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for top in range(0, lines, rows):
        part = payload[top * width : (top + rows) * width]
        out += [b"!\xf9\x04", struct.pack("<BHB", 1 << 2, delay, 0), b"\0,", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join([*out, b";"])


def _unlace(pixels: np.ndarray) -> np.ndarray:
    out, at = np.empty_like(pixels), 0
    for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)):
        n = len(range(first, len(pixels), step))
        out[first::step] = pixels[at : at + n]
        at += n
    return out


def decode(data: bytes) -> list[Frame]:
    """All frames, rendered in order."""
    return list(rendered(data))


def rendered(data: bytes) -> Iterator[Frame]:
    """The frames one by one."""
    try:
        yield from _decode(data)
    except (IndexError, struct.error) as e:
        raise ValueError(f"broken GIF: {e}") from e


def _decode(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF header")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        shared, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear_index = 0, 0, None

    def chunks() -> bytes:
        nonlocal at
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        at += 1
        return b"".join(parts)

    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            label, at = data[at + 1], at + 2
            body = chunks()
            if label == 0xF9:
                packed, delay, index = struct.unpack("<BHB", body[:4])
                disposal, clear_index = packed >> 2 & 7, index if packed & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind:#x}")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = shared
        if packed & 0x80:
            n = 3 << ((packed & 7) + 1)
            palette, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
        if palette is None:
            raise ValueError("no colour table")
        bits, at = data[at], at + 1
        if not 1 < bits < 9:
            raise ValueError("bad code size")
        raw = lzw_decode(chunks(), bits, w * h)
        samples = np.zeros(w * h, np.uint8)
        samples[: len(raw)] = np.frombuffer(raw, np.uint8)
        samples = samples.reshape(h, w)
        if packed & 0x40:
            samples = _unlace(samples)
        before = canvas.copy() if disposal == 3 else None
        region = canvas[top : top + h, left : left + w]
        own = samples[: region.shape[0], : region.shape[1]]
        table = np.zeros((256, 3), np.uint8)
        table[: len(palette)] = palette
        if clear_index is None:
            region[..., :3], region[..., 3] = table[own], 255
        else:
            shown = own != clear_index
            region[shown, :3], region[shown, 3] = table[own[shown]], 255
        yield Frame(left, top, w, h, delay, disposal, canvas.copy(), samples)
        if disposal == 2:
            region[:] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, clear_index = 0, 0, None


def grey_of(f: Frame) -> np.ndarray:
    """The frame's own pixels as shown, of a grey palette."""
    return f.pixels[f.top : f.top + f.height, f.left : f.left + f.width, 0]


def payload_of(frames: list[Frame]) -> bytes:
    """The bytes that ``encode`` stored, from the pixels as shown."""
    return b"".join(grey_of(f).tobytes() for f in frames)


def histogram(pixels: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Counts of the shown pixels' red, green and blue in ``bins`` equal ranges: 3 x bins."""
    shown = pixels[pixels[..., 3] > 0]
    return np.stack([np.bincount(shown[:, c] // (256 // bins), minlength=bins) for c in range(3)])


def padded(text: bytes, unit: int = WIDTH) -> bytes:
    return text + b"\0" * (-len(text) % unit or (0 if text else unit))


def frames(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """One row for each timed frame of a GIF column: place, times, and histogram columns."""
    key_type = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, 64):
            rows = []
            for k, data in zip(batch["k"].to_pylist(), batch["m"].to_pylist()):
                start, own = 0, []
                try:
                    for i, f in enumerate(rendered(data) if data else ()):
                        own.append((k, i, start, f.delay * 10, f.width, f.height, f.disposal, *histogram(f.pixels).tolist()))
                        start += f.delay * 10
                except ValueError:
                    continue
                rows += own
            cols = list(zip(*rows)) or [[]] * 10
            kinds = [batch["k"].type, pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [key, "frame", "start_ms", "delay_ms", "width", "height", "disposal", "hist_red", "hist_green", "hist_blue"])

    schema = f"`{key}` {key_type}, frame int, start_ms long, delay_ms long, width int, height int, disposal int, hist_red array<long>, hist_green array<long>, hist_blue array<long>"
    return df.selectExpr(f"`{key}` as k", f"`{media}` as m").mapInArrow(run, schema)


def media_column(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: the text's bytes, padded, as a GIF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, 256):
            texts = batch["text"].to_pylist()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return as_bytes(docs, "doc_id", text=text).mapInArrow(run, "doc_id long, n_bytes long, media binary")


FIELDS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_ms long"


def report(docs: DataFrame) -> DataFrame:
    """Each stored GIF read back: digests of payload and media, and a feature string of the grey
    histogram of all frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, 256):
            rows = []
            for doc_id, n, media in zip(*(batch[c].to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                size, count, time, tail = 0, 0, 0, b""
                sha, grey = hashlib.sha256(), np.zeros(BINS, np.int64)
                for f in rendered(media):
                    part = grey_of(f)
                    raw = part.tobytes()
                    sha.update(raw)
                    grey += np.bincount(part.ravel() // (256 // BINS), minlength=BINS)
                    size, count, time, tail = size + len(raw), count + 1, time + f.delay * 10, (tail + raw)[-WIDTH:]
                rows.append((doc_id, n, size, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), ",".join(map(str, grey.tolist())), count, time))
            cols, kinds = list(zip(*rows)) or [[]] * 10, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [f.split()[0] for f in FIELDS.split(", ")])

    return media_column(docs).mapInArrow(run, FIELDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
