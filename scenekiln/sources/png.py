"""PNG and npy payloads without an image library: gray, BGR and BGRA arrays of 8 bits, and arrays of points.

All PNG of the format are read: any depth, palettes, transparency of palettes, interlaced or not. Samples of fewer bits are
spread over 0 to 255; of 16-bit samples the high byte is kept.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np

_MAGIC = b"\x89PNG\r\n\x1a\n"
#: Colour type of the format, with its number of channels and its depths.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: First column and row, and steps between columns and rows, of each pass of an interlaced image.
_PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(image: np.ndarray) -> bytes:
    """(H, W), (H, W, 3) BGR or (H, W, 4) BGRA of uint8."""
    if image.dtype != np.uint8 or image.ndim not in (2, 3) or (image.ndim == 3 and image.shape[2] not in (3, 4)) or 0 in image.shape:
        raise ValueError("only 8-bit gray, BGR and BGRA images are written")
    rows = image if image.ndim == 2 else image[:, :, [2, 1, 0, *range(3, image.shape[2])]]
    kind = {1: 0, 3: 2, 4: 6}[1 if image.ndim == 2 else image.shape[2]]
    flat = rows.reshape(image.shape[0], -1)
    data = np.hstack([np.zeros((len(flat), 1), np.uint8), flat]).tobytes()
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, kind, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(data, 6)) + _chunk(b"IEND", b"")


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows with their filter byte to plain rows; `step`: bytes of a pixel."""
    out = np.zeros((len(raw), raw.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for y, row in enumerate(raw):
        kind, line = row[0], row[1:]
        if kind == 0:
            out[y] = line
        elif kind == 1:
            out[y] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            out[y] = line + above
        elif kind in (3, 4):
            now = [0] * (len(line) + step)
            up, src = above.tolist(), line.tolist()
            for i, v in enumerate(src):
                a, b = now[i], up[i]
                if kind == 3:
                    now[i + step] = (v + (a + b) // 2) & 255
                else:
                    c = up[i - step] if i >= step else 0
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    now[i + step] = (v + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
            out[y] = now[step:]
        else:
            raise ValueError("unknown row filter")
        above = out[y]
    return out


def _samples(rows: np.ndarray, width: int, n: int, depth: int) -> np.ndarray:
    """Plain rows of bytes to (rows, width, n) samples of one byte."""
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1)[:, : width * n * depth]
        rows = bits.reshape(len(rows), -1, depth) @ (1 << np.arange(depth)[::-1])
    return rows.reshape(len(rows), width, n).astype(np.uint8)


def _pixels(data: bytes, width: int, height: int, n: int, depth: int, interlaced: bool) -> np.ndarray:
    """(height, width, n) samples of the inflated data."""
    out, at = np.zeros((height, width, n), np.uint8), 0
    for x, y, dx, dy in _PASSES if interlaced else [(0, 0, 1, 1)]:
        part = out[y::dy, x::dx]
        if not part.size:
            continue
        line = 1 + (part.shape[1] * n * depth + 7) // 8
        raw = np.frombuffer(data, np.uint8, line * part.shape[0], at).reshape(part.shape[0], line)
        out[y::dy, x::dx] = _samples(_unfiltered(raw, max(1, n * depth // 8)), part.shape[1], n, depth)
        at += raw.size
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Gray (H, W), BGR or BGRA of 8 bits. What is no whole PNG is a ValueError."""
    if data[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, body, palette, alpha, head = 8, [], None, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        own = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", own)
        elif kind == b"PLTE":
            palette = np.frombuffer(own, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = own
        elif kind == b"IDAT":
            body.append(own)
        elif kind == b"IEND":
            break
    if head is None or head[2] not in _DEPTHS.get(head[3], ()) or head[6] > 1 or (head[3] == 3 and palette is None):
        raise ValueError("no PNG that the format knows")
    width, height, depth, kind = head[:4]
    n = _CHANNELS[kind]
    try:
        rows = _pixels(zlib.decompress(b"".join(body)), width, height, n, depth, head[6] == 1)
    except zlib.error as error:
        raise ValueError("the image data of a PNG is broken") from error
    if kind == 3:
        colours = palette[:, ::-1]
        if alpha:
            full = np.full(len(palette), 255, np.uint8)
            full[: len(alpha)] = np.frombuffer(alpha, np.uint8)
            colours = np.hstack([colours, full[:, None]])
        if rows.size and rows.max() >= len(colours):
            raise ValueError("a pixel names a colour that the palette lacks")
        return colours[rows[:, :, 0]]
    if depth < 8:
        rows = rows * np.uint8(255 // ((1 << depth) - 1))
    if n == 1:
        return rows[:, :, 0]
    if n == 2:
        return np.dstack([rows[:, :, 0]] * 3 + [rows[:, :, 1]])
    return np.ascontiguousarray(rows[:, :, [2, 1, 0, *range(3, n)]])


def encode_npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def decode_npy(data: bytes) -> np.ndarray:
    """Integers of either width come as int64."""
    return np.load(io.BytesIO(data), allow_pickle=False).astype(np.int64)
