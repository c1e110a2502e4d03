"""Headers and grey values of pictures without an image library."""

from __future__ import annotations

import math
import random
import struct
import zlib

import numpy as np
import pytest

from roundforge.functions import pictures
from roundforge.operators import assets, screening
from roundforge.plans.files import _exif, _jpeg, _png


def filtered(rows, kinds):
    """Lines of a PNG file by the five filters of its format, value by value."""
    out, height, width, n = b"", *rows.shape
    for y in range(height):
        out += bytes([kinds[y]])
        for x in range(width):
            for c in range(n):
                left = int(rows[y, x - 1, c]) if x else 0
                up = int(rows[y - 1, x, c]) if y else 0
                corner = int(rows[y - 1, x - 1, c]) if x and y else 0
                p = left + up - corner
                paeth = min((left, up, corner), key=lambda v: abs(p - v))
                out += bytes([(int(rows[y, x, c]) - (0, left, up, (left + up) // 2, paeth)[kinds[y]]) % 256])
    return out


@pytest.mark.parametrize(("colour", "n"), [(0, 1), (4, 2), (2, 3), (6, 4)])
def test_png_of_all_filters(colour, n):
    rng = np.random.default_rng(n)
    rows = rng.integers(0, 256, (11, 7, n), dtype=np.uint8)
    data = _png(7, 11, filtered(rows, [y % 5 for y in range(11)]))
    data = data[:25] + bytes([colour]) + data[26:]
    want = rows[:, :, 0] if n < 3 else [[(19595 * int(r) + 38470 * int(g) + 7471 * int(b) + 32768) >> 16 for r, g, b in line[:, :3]] for line in rows]
    assert np.array_equal(pictures.png_grey(data), np.array(want))
    for bad in (b"", data[:40], data[:28] + b"\x01" + data[29:], b"x" + data):
        with pytest.raises((pictures.Unreadable, zlib.error, ValueError, struct.error)):
            pictures.png_grey(bad)


def test_shrinking_by_the_definition():
    rng = np.random.default_rng(5)
    grey = rng.integers(0, 256, (37, 50), dtype=np.uint8)

    def lanczos(x):
        return 0.0 if abs(x) >= 3 else 1.0 if x == 0 else 3 * math.sin(math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x) ** 2

    def line(values, to):
        scale, out = max(1.0, len(values) / to), []
        for i in range(to):
            centre = (i + 0.5) * len(values) / to
            w = [lanczos((x + 0.5 - centre) / scale) for x in range(len(values))]
            out.append(min(255, max(0, math.floor(sum(a * b for a, b in zip(w, values, strict=True)) / sum(w) + 0.5))))
        return out

    across = [line([float(v) for v in row], 9) for row in grey]
    want = np.array([line([float(r[x]) for r in across], 8) for x in range(9)]).T
    assert np.abs(pictures.shrunk(grey, 9, 8) - want).max() <= 1  # the window's ends are cut to whole values
    assert np.array_equal(pictures.shrunk(grey[:8, :9], 9, 8), grey[:8, :9])
    flat = pictures.shrunk(np.full((300, 200), 77, np.uint8), 9, 8)
    assert (flat == 77).all()


def test_headers(spark):
    full = pictures.read_header(_jpeg(640, 480, _exif(">", True, True, True)))
    assert (full.width, full.height, full.gps, full.tags[315], full.tags[37510]) == (640, 480, True, b"Ann Lee\0", b"note")
    rng = random.Random(2)
    for data in (_jpeg(640, 480, _exif("<", True, True, True)), _png(3, 4, b"", _exif(">", True, True, True))):
        for _ in range(300):  # cut and broken files are told as unreadable, or read as far as they go
            broken = bytearray(data[: rng.randint(0, len(data))])
            for _ in range(rng.randint(0, 4)):
                if broken:
                    broken[rng.randrange(len(broken))] = rng.randrange(256)
            assert screening._header_flags(bytes(broken)) is not None
    rows = spark.createDataFrame([("a", b"no image"), ("b", None), ("c", _jpeg(100, 900))], "path string, content binary")
    got = {r["path"]: [f["name"] for f in r["flags"]] for r in screening.image_flags(rows).collect()}
    assert got == {"a": ["image_unreadable"], "b": ["image_unreadable"], "c": ["very_small_image", "extreme_aspect_ratio"]}
    assert {r["path"]: r["dhash"] for r in assets.dhash(rows).collect()} == {"a": None, "b": None, "c": None}
