"""Photos as arrays: portable maps and PNG in plain Python, anything else if an image library is there."""

from __future__ import annotations

import io
import re
import struct
import zlib

import numpy as np

_MAP_HEAD = re.compile(rb"\AP([56])(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s")
_PNG = b"\x89PNG\r\n\x1a\n"
#: Values a pixel by PNG colour type: gray, RGB, palette, gray and alpha, RGB and alpha.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def encode_png(image: np.ndarray) -> bytes:
    """A gray (h, w) or colour (h, w, 3) image of bytes."""
    image = np.asarray(image, np.uint8)
    h, w = image.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.hstack((np.zeros((h, 1), np.uint8), image.reshape(h, -1)))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def _decode_png(content: bytes) -> np.ndarray:
    at, data, palette = 8, b"", None
    while at < len(content):
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    if depth != 8 or interlaced:
        raise ValueError("only plain 8-bit PNG files are read without an image library")
    k = _CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * k)
    out = np.zeros((h + 1, (w + 1) * k), np.int64)  # a row above and a pixel to the left, both 0
    for y in range(h):
        line, kind = raw[y, 1:].astype(np.int64), raw[y, 0]
        above = out[y]
        if kind in (0, 2):
            out[y + 1, k:] = line + (above[k:] if kind == 2 else 0) & 255
            continue
        row = out[y + 1]
        for x in range(k, len(row)):
            a, b, c = row[x - k], above[x], above[x - k]
            if kind == 1:
                guess = a
            elif kind == 3:
                guess = (a + b) // 2
            else:
                p = a + b - c
                guess = min((a, b, c), key=lambda v, p=p: abs(p - v))
            row[x] = line[x - k] + guess & 255
    image = out[1:, k:].astype(np.uint8).reshape(h, w, k)
    if colour == 3:
        image = palette[image[..., 0]]
    return image[..., 0] if colour in (0, 4) else image[..., :3]


def decode(content: bytes) -> np.ndarray:
    """Bytes (h, w), or (h, w, 3) in the order red, green, blue."""
    if m := _MAP_HEAD.match(content):
        kind, w, h, top = (int(x) for x in m.groups())
        if top > 255:
            raise ValueError("16-bit maps aren't supported")
        flat = np.frombuffer(content, np.uint8, w * h * (3 if kind == 6 else 1), m.end())
        return flat.reshape((h, w, 3) if kind == 6 else (h, w))
    if content.startswith(_PNG):
        return _decode_png(content)
    try:
        from PIL import Image
    except ImportError:
        raise ValueError("this photo's format needs an image library that isn't installed") from None
    return np.asarray(Image.open(io.BytesIO(content)).convert("RGB"))


def gray(image: np.ndarray) -> np.ndarray:
    """Brightness in [0, 1]."""
    a = np.asarray(image, np.float64) / 255
    return a @ np.array([0.299, 0.587, 0.114]) if a.ndim == 3 else a


def size(head: bytes) -> tuple[int, int] | None:
    """Width and height from the first bytes of a photo (PGM, PPM, PNG, BMP, JPEG); None if they don't tell."""
    if m := _MAP_HEAD.match(head):
        return int(m[2]), int(m[3])
    if head.startswith(_PNG) and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    if head.startswith(b"BM") and len(head) >= 26:
        w, h = struct.unpack("<ii", head[18:26])
        return w, abs(h)
    at = 2 if head.startswith(b"\xff\xd8") else len(head)
    while at + 9 <= len(head) and head[at] == 0xFF:  # segments up to the frame's
        if 0xC0 <= head[at + 1] <= 0xCF and head[at + 1] not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", head[at + 5 : at + 9])
            return w, h
        at += 2 + int.from_bytes(head[at + 2 : at + 4], "big")
    return None
