import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from lattica.llm import gif


def slow_lzw(stream: bytes, low: int) -> bytes:
    """Code by code, from the bits."""
    bits = "".join(f"{b:08b}"[::-1] for b in stream)
    clear, end = 1 << low, (1 << low) + 1
    at, width, table, last, out = 0, low + 1, {}, None, b""
    while True:
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == clear:
            table, width, last = {i: bytes([i]) for i in range(clear)} | {clear: b"", end: b""}, low + 1, None
            continue
        if code == end:
            return out
        entry = table[code] if code in table else last + last[:1]
        if last is not None and len(table) < 4096:
            table[len(table)] = last + entry[:1]
        if len(table) == 1 << width and width < 12:
            width += 1
        out += entry
        last = entry


@pytest.mark.parametrize("n", [0, 1, 2, 191, 5000, 40_000])
def test_lzw(n):
    rng = random.Random(n)
    for data in (rng.randbytes(n), bytes(rng.choice(b"ab c") for _ in range(n)), b"a" * n):
        stream = gif.lzw_encode(data)
        assert slow_lzw(stream, 8) == data == gif.lzw_decode(stream, 8, n)


def animation() -> bytes:
    """Three frames on 4 x 2: a local palette, transparency, disposal 2 and 3, interlace."""

    def image(left, top, w, h, samples, flags=0, palette=b"", control=(0, 5, 0)):
        low, codes = 2, [4]
        for s in samples:
            codes += [s, 4]  # a clear code behind each sample keeps all codes three bits wide
        bits = "".join(f"{c:03b}"[::-1] for c in [*codes[:-1], 5])
        raw = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
        gce = b"\x21\xf9\x04" + bytes([control[0]]) + struct.pack("<H", control[1]) + bytes([control[2]]) + b"\0"
        return gce + b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + palette + bytes([low]) + bytes([len(raw)]) + raw + b"\0"

    shared = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    local = bytes([9, 9, 9, 255, 255, 255, 1, 1, 1, 2, 2, 2])
    out = b"GIF89a" + struct.pack("<HHBBB", 4, 2, 0x81, 0, 0) + shared
    out += b"\x21\xfe\x02hi\0"
    out += image(0, 0, 4, 2, [1] * 8, control=(1 << 2, 5, 0))
    out += image(1, 0, 2, 2, [2, 0, 0, 2], control=(3 << 2 | 1, 7, 0))  # 0 is transparent; what was before comes back
    out += image(0, 0, 1, 2, [1, 0], 0x81, local, control=(2 << 2, 9, 0))  # local palette; cleared afterwards
    out += image(3, 0, 1, 2, [3, 2], 0x40, control=(0, 1, 0))  # interlaced
    return out + b"\x3b"


def test_disposal_transparency_and_palettes():
    frames = gif.decode_gif(animation())
    red, green, blue = 0xFF0000, 0x00FF00, 0x0000FF
    assert [f.delay_cs for f in frames] == [5, 7, 9, 1]
    assert frames[0].canvas.tolist() == [[red] * 4] * 2
    assert frames[1].canvas.tolist() == [[red, green, red, red], [red, red, green, red]]
    assert frames[2].canvas.tolist() == [[0xFFFFFF, red, red, red], [0x090909, red, red, red]]
    assert frames[3].canvas.tolist() == [[-1, red, red, blue], [-1, red, red, green]]
    assert gif.histogram(frames[3].canvas).sum() == 6
    assert gif._deinterlaced(np.array([0, 8, 4, 2, 6, 1, 3, 5, 7, 9])[:, None])[:, 0].tolist() == list(range(10))


@pytest.mark.parametrize("cut", [3, 20, 60, 100])
def test_broken_files(cut):
    whole = gif.gif_of(gif.payload_of(b"hello " * 99))
    with pytest.raises(ValueError):
        gif.decode_gif(whole[:cut])
    with pytest.raises(ValueError):
        gif.decode_gif(b"JFIF" + whole)


def test_table(docs, empty, spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    rows = gif.store_and_read(docs).collect()
    assert len(rows) == docs.count()
    by_text = {}
    for r in rows:
        text = texts[r["doc_id"]]
        payload = text + b" " * (-len(text) % 192 or (0 if text else 192))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(text), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert by_text.setdefault(text, tuple(r)[1:]) == tuple(r)[1:]
    assert gif.store_and_read(empty).count() == 0
    media = spark.createDataFrame([(1, bytearray(animation())), (2, None), (3, bytearray(b"no"))], "k long, g binary")
    frames = gif.frames_table(media, "k", "g").orderBy("frame").collect()
    assert [(f["id"], f["start_cs"], f["delay_cs"], f["disposal"]) for f in frames] == [(1, 0, 5, 1), (1, 5, 7, 3), (1, 12, 9, 2), (1, 21, 1, 0)]


def test_many_frames():
    payload = gif.payload_of(random.Random(1).randbytes(192 * 600))
    frames = gif.decode_gif(gif.gif_of(payload))
    assert len(frames) == 3 and b"".join(f.indices.tobytes() for f in frames) == payload
