"""GIF as a media column: LZW code streams, palettes, disposal and transparency, timed frames with colour histograms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import id_text, map_arrow, texts

ROW = 192
#: Rows in a frame of a stored payload.
FRAME_ROWS = 256
#: 3-3-2 colour cube: the palette that payloads are stored with.
PALETTE = np.array([((i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 85) for i in range(256)], dtype=np.uint8)
DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
FRAMES = "id long, frame int, start_cs long, delay_cs int, width int, height int, disposal int, histogram array<long>"


def _widths(low: int) -> np.ndarray:
    """Bits of the n-th code after a clear code, as long as the table grows."""
    n = (1 << 12) - (1 << low) - 2
    table = (1 << low) + 2 + np.maximum(0, np.arange(n + 1) - 1)
    return np.clip(np.frexp(table.astype(float))[1], low + 1, 12).astype(np.int64)


_WIDTHS = {low: _widths(low) for low in range(2, 9)}


def lzw_encode(data: bytes) -> bytes:
    """8-bit samples to a GIF code stream; a clear code whenever the table is full."""
    known: dict[int, int] = {}
    codes = [256]
    put, new = codes.append, 258
    it = iter(data)
    now = next(it, None)
    if now is not None:
        for b in it:
            key = now << 8 | b
            if key in known:
                now = known[key]
            else:
                put(now)
                known[key] = new
                new += 1
                now = b
                if new == 4096:
                    put(256)
                    known.clear()
                    new = 258
        put(now)
    put(257)
    out = np.array(codes, dtype=np.int64)
    fresh = np.flatnonzero(out == 256)
    since = np.arange(len(out)) - fresh[np.searchsorted(fresh, np.arange(len(out)), side="left") - 1] - 1
    since[0] = 0
    bits = _WIDTHS[8][since]
    spread = (out[:, None] >> np.arange(12) & 1).astype(np.uint8)
    return np.packbits(spread[np.arange(12) < bits[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, low: int, n_samples: int) -> bytes:
    """A GIF code stream to samples; stops at the end code, at n_samples or where the stream ends."""
    clear, end = 1 << low, (1 << low) + 1
    raw = np.frombuffer(stream + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
    total = len(stream) * 8
    growing = _WIDTHS[low]
    at, out, size = 0, [], 0
    singles = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, last, read = singles.copy(), None, 0
    while at < total and size < n_samples:
        bits = growing[read : read + 4096] if read < len(growing) else np.full(4096, 12)
        ends = at + np.cumsum(bits)
        ends = ends[ends <= total]
        if not len(ends):
            break
        bits = bits[: len(ends)]
        starts = ends - bits
        b = starts >> 3
        codes = (raw[b] | raw[b + 1] << 8 | raw[b + 2] << 16) >> (starts & 7).astype(np.uint32) & ((1 << bits) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stops[0]) if len(stops) else len(codes)
        for code in codes[:n].tolist():
            if code < len(table):
                entry = table[code]
                if last is not None and len(table) < 4096:
                    table.append(last + entry[:1])
            elif last is None or code > len(table):
                raise ValueError("broken LZW stream")
            else:
                entry = last + last[:1]
                if len(table) < 4096:
                    table.append(entry)
            out.append(entry)
            last = entry
        size = sum(map(len, out)) if n else size
        out = [b"".join(out)] if len(out) > 1 else out
        if not len(stops):
            at, read = int(ends[-1]), read + len(codes)
            continue
        at = int(ends[n])
        if codes[n] == end:
            break
        table, last, read = singles.copy(), None, 0
    return b"".join(out)[:n_samples]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def gif_of(payload: bytes, row: int = ROW, frame_rows: int = FRAME_ROWS, delay_cs: int = 10) -> bytes:
    """payload (whole rows) as palette indices of an animated GIF, frame_rows rows a frame."""
    rows = len(payload) // row
    height = min(rows, frame_rows)
    out = [b"GIF89a", struct.pack("<HHBBB", row, height, 0xF7, 0, 0), PALETTE.tobytes()]
    for top in range(0, rows, frame_rows):
        part = payload[top * row : (top + frame_rows) * row]
        out += [b"\x21\xf9\x04\x04", struct.pack("<H", delay_cs), b"\0\0", b"\x2c", struct.pack("<HHHHB", 0, 0, row, len(part) // row, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    indices: np.ndarray  # height x width palette indices, as stored
    canvas: np.ndarray  # screen of 0xRRGGBB after drawing, -1 where nothing is
    delay_cs: int
    disposal: int


def _deinterlaced(rows: np.ndarray) -> np.ndarray:
    n = len(rows)
    order = [i for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for i in range(first, n, step)]
    out = np.empty_like(rows)
    out[order] = rows
    return out


def decode_gif(data: bytes) -> list[Frame]:
    """All frames; raises ValueError on anything that isn't a whole GIF up to its last frame.

    Rules: a local palette replaces the global one; the transparent index leaves what is below; disposal 2 clears the
    frame's rectangle, 3 brings back what was there before, others leave the frame.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    try:
        width, height, flags = struct.unpack_from("<HHB", data, 6)
        at = 13

        def palette(flag: int) -> np.ndarray:
            nonlocal at
            n = 2 << (flag & 7)
            rgb = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3).astype(np.int32)
            at += 3 * n
            return np.concatenate([rgb[:, 0] << 16 | rgb[:, 1] << 8 | rgb[:, 2], np.zeros(256 - n, np.int32)])

        def blocks() -> bytes:
            nonlocal at
            parts = []
            while n := data[at]:
                parts.append(data[at + 1 : at + 1 + n])
                at += n + 1
            at += 1
            return b"".join(parts)

        shared = palette(flags) if flags & 0x80 else np.zeros(256, np.int32)
        canvas = np.full((height, width), -1, dtype=np.int32)
        delay, disposal, see_through = 0, 0, -1
        frames: list[Frame] = []
        while data[at] != 0x3B:
            kind = data[at]
            at += 1
            if kind == 0x21:
                label = data[at]
                at += 1
                body = blocks()
                if label == 0xF9:
                    disposal, delay = body[0] >> 2 & 7, struct.unpack_from("<H", body, 1)[0]
                    see_through = body[3] if body[0] & 1 else -1
                continue
            if kind != 0x2C:
                raise ValueError("not a block of a GIF")
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
            at += 9
            colours = palette(flags) if flags & 0x80 else shared
            low = data[at]
            at += 1
            samples = lzw_decode(blocks(), low, w * h)
            if len(samples) < w * h:
                raise ValueError("a frame ends early")
            indices = np.frombuffer(samples, dtype=np.uint8).reshape(h, w)
            if flags & 0x40:
                indices = _deinterlaced(indices)
            before = canvas.copy() if disposal == 3 else None
            place = canvas[top : top + h, left : left + w]
            seen = indices[: place.shape[0], : place.shape[1]]
            place[:] = np.where(seen == see_through, place, colours[seen]) if see_through >= 0 else colours[seen]
            frames.append(Frame(left, top, w, h, indices, canvas.copy(), delay, disposal))
            if disposal == 2:
                place[:] = -1
            elif before is not None:
                canvas = before
            delay, disposal, see_through = 0, 0, -1
        return frames
    except (IndexError, struct.error) as e:
        raise ValueError("a GIF that ends early") from e


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels in each of 64 colours (two bits of red, green and blue); empty pixels don't count."""
    c = canvas.reshape(-1)
    c = c[c >= 0] if (c < 0).any() else c
    return np.bincount((c >> 18 & 48) | (c >> 12 & 12) | (c >> 6 & 3), minlength=64)


def frames_table(media: DataFrame, id_col: str, gif_col: str) -> DataFrame:
    """One row per frame of each GIF (see FRAMES), timed from the first; null or broken files have no frames."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(8)]
        for key, data in zip(batch.column("id").to_pylist(), batch.column("gif").to_pylist()):
            try:
                frames = decode_gif(data or b"")
            except ValueError:
                continue
            start = 0
            for k, f in enumerate(frames):
                for col, value in zip(cols, (key, k, start, f.delay_cs, f.width, f.height, f.disposal, histogram(f.canvas).tolist())):
                    col.append(value)
                start += f.delay_cs
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "frame", "start_cs", "delay_cs", "width", "height", "disposal", "histogram"])

    return map_arrow(media.select(F.col(id_col).cast("long").alias("id"), F.col(gif_col).cast("binary").alias("gif")), run, FRAMES)


def payload_of(text: bytes, row: int = ROW) -> bytes:
    """text with spaces behind it, up to a positive multiple of row."""
    return text + b" " * (-len(text) % row if text else row)


def encode_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, gif: each whole text stored as a GIF. Null counts as empty (one row of spaces)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = texts(batch)
        return pa.record_batch([batch.column("doc_id"), pa.array([len(t) for t in own], pa.int64()), pa.array([gif_of(payload_of(t)) for t in own], pa.binary())], ["doc_id", "n_bytes", "gif"])

    return map_arrow(id_text(docs, id_col, text_col), run, "doc_id long, n_bytes long, gif binary")


def digests(media: DataFrame) -> DataFrame:
    """What encode_table() stored, read back: see DIGESTS. feature: frames, seconds/100 and the 64 colours' counts over all frames."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(6)]
        for data in batch.column("gif").to_pylist():
            frames = decode_gif(data)
            payload = b"".join(f.indices.tobytes() for f in frames)
            # a frame's own part of the screen: each payload byte counts once
            counts = sum(histogram(f.canvas[f.top : f.top + f.height, f.left : f.left + f.width]) for f in frames)
            feature = f"frames={len(frames)};cs={sum(f.delay_cs for f in frames)};colours={','.join(map(str, counts.tolist()))}"
            for col, value in zip(cols, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature)):
                col.append(value)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds))], [x.split()[0] for x in DIGESTS.split(", ")])

    return map_arrow(media, run, DIGESTS)


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text through a GIF and back (see DIGESTS). Repeated rows come back as often; an empty table gives an empty result."""
    return digests(encode_table(docs, id_col, text_col))
