"""What the headers of JPEG and PNG files say, and the grey values of PNG files, read without an image library: for workers that have none."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

PNG, JPEG = b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff"
#: Fixed values of the formats: bytes of a value of each EXIF type, pointers to further tables, weights of red, green and blue in grey (of 65536).
EXIF_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
EXIF_TABLE, GPS_TABLE = 0x8769, 0x8825
GREY = (19595, 38470, 7471)
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


class Unreadable(ValueError):
    """Bytes that are no image, or one of another format than these."""


@dataclass
class Header:
    width: int
    height: int
    tags: dict[int, bytes] = field(default_factory=dict)  # of the main table and of the EXIF table
    gps: bool = False


def _exif(data: bytes, header: Header) -> None:
    """Reads the tables of an EXIF block; one that breaks off has the tags before the break."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        return

    def table(at: int) -> dict[int, bytes]:
        out: dict[int, bytes] = {}
        if at + 2 > len(data):
            return out
        for k in range(struct.unpack_from(order + "H", data, at)[0]):
            entry = at + 2 + 12 * k
            if entry + 12 > len(data):
                break
            tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
            size = EXIF_BYTES.get(kind, 1) * count
            place = entry + 8 if size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
            out[tag] = data[place : place + size]
        return out

    def pointer(tags: dict[int, bytes], tag: int) -> int | None:
        value = tags.get(tag, b"")
        return struct.unpack(order + "I", value)[0] if len(value) == 4 else None

    header.tags = table(struct.unpack_from(order + "I", data, 4)[0]) if len(data) >= 8 else {}
    if (at := pointer(header.tags, GPS_TABLE)) is not None:
        header.gps = bool(table(at))
    if (at := pointer(header.tags, EXIF_TABLE)) is not None:
        header.tags = table(at) | header.tags


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(PNG)
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        yield kind, data[at + 8 : at + 8 + size]
        at += size + 12


def read_header(data: bytes) -> Header:
    if data.startswith(PNG) and data[12:16] == b"IHDR" and len(data) >= 24:
        header = Header(*struct.unpack_from(">II", data, 16))
        for kind, body in _chunks(data):
            if kind == b"eXIf":
                _exif(body, header)
        return header
    if not data.startswith(JPEG):
        raise Unreadable("neither PNG nor JPEG")
    at, exif, size = 2, b"", None
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        length = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + length]
        if mark == 0xE1 and body.startswith(b"Exif\0\0"):
            exif = body[6:]
        # frames; 0xC4, 0xC8 and 0xCC are tables
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
            size = struct.unpack_from(">HH", body, 1)[::-1]
        if mark == 0xDA:
            break
        at += 2 + length
    if size is None:
        raise Unreadable("a JPEG file without a frame")
    header = Header(*size)
    _exif(exif, header)
    return header


def png_grey(data: bytes) -> np.ndarray:
    """The grey values of a PNG file of 8 bits a channel that isn't interlaced."""
    if not data.startswith(PNG) or len(data) < 33:
        raise Unreadable("no PNG")
    width, height, depth, colour, _, _, interlaced = struct.unpack_from(">IIBBBBB", data, 16)
    if depth != 8 or colour not in CHANNELS or interlaced:
        raise Unreadable("a PNG of another kind")
    n = CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(body for kind, body in _chunks(data) if kind == b"IDAT")), np.uint8).reshape(height, 1 + width * n)
    rows = np.zeros((height + 1, width, n), np.uint8)
    for y in range(height):
        rows[y + 1] = _unfiltered(int(raw[y, 0]), raw[y, 1:].reshape(width, n), rows[y])
    pixels = rows[1:].astype(np.int64)
    if n < 3:
        return pixels[:, :, 0].astype(np.uint8)
    return ((pixels[:, :, :3] @ np.array(GREY) + 0x8000) >> 16).astype(np.uint8)


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    out, left, corner = np.zeros_like(row), np.zeros(row.shape[1], np.int64), np.zeros(row.shape[1], np.int64)
    if kind == 1:
        return np.cumsum(row, axis=0, dtype=np.uint8)
    for x in range(len(row)):
        up = above[x].astype(np.int64)
        if kind == 3:
            guess = (left + up) >> 1
        else:
            p = left + up - corner
            a, b, c = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        out[x] = (row[x] + guess) & 255
        left, corner = out[x].astype(np.int64), up
    return out


def _weights(size: int, to: int) -> np.ndarray:
    """The share that each of ``size`` values has in each of ``to``, by a Lanczos window of three lobes, as wide as an output value is."""
    scale = max(1.0, size / to)
    centre = (np.arange(to) + 0.5) * size / to
    x = np.arange(size)
    away = (x[None, :] + 0.5 - centre[:, None]) / scale
    lo, hi = np.maximum(0, np.floor(centre - 3 * scale + 0.5)), np.minimum(size, np.floor(centre + 3 * scale + 0.5))
    inside = (x[None, :] >= lo[:, None]) & (x[None, :] < hi[:, None]) & (np.abs(away) < 3)
    w = np.where(inside, np.sinc(away) * np.sinc(away / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def shrunk(grey: np.ndarray, width: int, height: int) -> np.ndarray:
    """Resampled, first along rows and then along columns, rounded to whole grey values after each."""
    whole = lambda x: np.clip(np.floor(x + 0.5), 0, 255)
    out = grey.astype(np.float64)
    if grey.shape[1] != width:
        out = whole(out @ _weights(grey.shape[1], width).T)
    if grey.shape[0] != height:
        out = whole(_weights(grey.shape[0], height) @ out)
    return out.astype(np.int64)
