"""One array of a JSON file as rows, read by many tasks.

The file is cut into byte ranges. A byte's meaning depends on what is before it: whether it is inside a string, and how deep. So a
first pass takes each range by itself and tells, for either beginning (inside a string or not), how many quotes it has and how deep it
goes; summed up in order, one small row for each range, these give the state at every range's begin. A second pass finds the top-level arrays and counts the objects
that begin in each range; a third one reads them, a range's last object beyond its end if need be. Backslashes need no state: how many stand before a range
is looked up there.

The array's elements are objects; anything else between them is left out. Files are opened through the file system of their URI."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from roundforge.sources import stores

RANGE_BYTES = 8_000_000
_QUOTE, _BACK = ord('"'), ord("\\")
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
#: Bytes that are read at once before a range, for what stands there.
LOOK = 4096


def _bytes(store: fs.FileSystem, path: str, lo: int, hi: int) -> bytes:
    with store.open_input_file(path) as f:
        return f.read_at(max(0, hi - lo), lo)


def _backslashes(store: fs.FileSystem, path: str, at: int) -> int:
    """Backslashes just before a place."""
    n = 0
    while n < at:
        before = _bytes(store, path, max(0, at - n - LOOK), at - n)
        kept = len(before) - len(before.rstrip(b"\\"))
        n += kept
        if kept < len(before):
            break
    return n


def marks(raw: np.ndarray, backslashes: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a piece of JSON: the places of quotes that no backslash hides; of brackets; and the quotes before each bracket."""
    quotes, brackets = np.flatnonzero(raw == _QUOTE), np.flatnonzero(_STEP[raw])
    back = raw == _BACK
    if backslashes or back.any():
        plain = np.maximum.accumulate(np.where(back, -1, np.arange(len(raw)))) if len(raw) else np.zeros(0, np.int64)
        last = np.where(quotes > 0, plain[np.maximum(quotes - 1, 0)], -1)
        run = quotes - 1 - last + np.where(last < 0, backslashes, 0)
        quotes = quotes[run % 2 == 0]
    return quotes, brackets, np.searchsorted(quotes, brackets)


def _key(store: fs.FileSystem, path: str, at: int) -> str | None:
    """The key of the value that begins at a place."""
    size = LOOK
    while True:
        lo = max(0, at - size)
        before = _bytes(store, path, lo, at).rstrip()
        if before.endswith(b":"):
            text = before[:-1].rstrip()
            raw = np.frombuffer(text, np.uint8)
            quotes = marks(raw, _backslashes(store, path, lo))[0]
            if len(quotes) > 1 and quotes[-1] == len(raw) - 1:
                return json.loads(text[quotes[-2] :])
        elif before:
            return None
        if lo == 0:
            return None
        size *= 8


def read(spark: SparkSession, path: str, key: str, range_bytes: int = RANGE_BYTES) -> DataFrame | None:
    """pos (from 0) and value (JSON text) of the objects in the array that the file's top-level object has under a key; None if it has no such
    array."""
    store, at = stores.opened(path)
    size = stores.size(store, at)
    if size is None:
        raise FileNotFoundError(path)
    n = max(1, -(-size // range_bytes))
    ranges = spark.range(0, n, 1, n).withColumnRenamed("id", "k")

    def piece(k: int, more: int = 0) -> tuple[fs.FileSystem, str, np.ndarray, int]:
        own, name = stores.opened(path)
        lo, hi = k * range_bytes, min(size, (k + 1) * range_bytes + more)
        return own, name, np.frombuffer(_bytes(own, name, lo, hi), np.uint8), _backslashes(own, name, lo)

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k in b["k"]:
                *_, raw, back = piece(k)
                quotes, brackets, before = marks(raw, back)
                step = _STEP[raw[brackets]].astype(np.int64)
                out.append((k, len(quotes), int(step[before % 2 == 0].sum()), int(step[before % 2 == 1].sum())))
            yield pd.DataFrame(out, columns=["k", "quotes", "outside", "inside"])

    told = ranges.mapInPandas(states, "k long, quotes long, outside long, inside long").toPandas().sort_values("k")  # a row for each range
    inside = (np.cumsum(told["quotes"]) - told["quotes"]).to_numpy() % 2
    depth = np.where(inside == 0, told["outside"], told["inside"])
    depth = np.cumsum(depth) - depth
    begin = {int(k): (int(i), int(d)) for k, i, d in zip(told["k"], inside, depth, strict=True)}
    state = spark.createDataFrame(pd.DataFrame({"k": told["k"], "inside": inside.astype(np.int64), "depth": depth.astype(np.int64)})) if n > 1 else None

    def seen(raw: np.ndarray, back: int, inside: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Brackets outside of strings, their steps, and the depth before each."""
        _, brackets, before = marks(raw, back)
        out = brackets[before % 2 == inside]
        step = _STEP[raw[out]].astype(np.int64)
        return out, step, depth + np.cumsum(step) - step

    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Ends of arrays at depth 1 and the objects before each of them: (k, where, key, objects since the last end or the range's begin)."""
        for b in batches:
            out = []
            for k, i, d in zip(b["k"], b["inside"], b["depth"], strict=True):
                own, name, raw, back = piece(k)
                at, step, before = seen(raw, back, i, d)
                objects = np.flatnonzero((step > 0) & (before == 2) & (raw[at] == ord("{")))
                borders = np.flatnonzero(((step > 0) & (before == 1) & (raw[at] == ord("["))) | ((step < 0) & (before == 2) & (raw[at] == ord("]"))))
                last = 0
                for x in borders.tolist():
                    upto = int(np.searchsorted(objects, x))
                    place = k * range_bytes + int(at[x])
                    out.append((k, place, upto - last, (_key(own, name, place) or "") if step[x] > 0 else None, bool(step[x] > 0)))
                    last = upto
                out.append((k, (k + 1) * range_bytes, len(objects) - last, None, None))
            yield pd.DataFrame(out, columns=["k", "place", "objects", "key", "opens"])

    if state is None:
        state = spark.createDataFrame([(0, *begin[0])], "k long, inside long, depth long")
    found = state.repartition(n, "k").mapInPandas(arrays, "k long, place long, objects long, key string, opens boolean").toPandas().sort_values(["k", "place"])  # a few rows for each range
    now, rows, total, there = None, [], 0, False
    for k, place, objects, name, opens in found.itertuples(index=False):
        if now is not None:
            if objects:
                rows.append((int(k), *begin[int(k)], now, None if opens is None else int(place), total, int(objects)))
            total += int(objects)
        if opens is not None and not (isinstance(opens, float) and np.isnan(opens)):
            now = int(place) if opens and name == key else None
            if now is not None:
                rows, total, there = [], 0, True  # of equal keys the last one counts
    if not there:
        return None

    def objects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, i, d, lo, hi, first, many in b.itertuples(index=False):
                more = LOOK
                while True:
                    *_, raw, back = piece(k, more)
                    at, step, before = seen(raw, back, i, d)
                    where = k * range_bytes + at
                    opened = np.flatnonzero((step > 0) & (before == 2) & (raw[at] == ord("{")) & (where > lo) & (where < (k + 1) * range_bytes))[:many]
                    closed = np.flatnonzero((step < 0) & (before == 3))
                    ends = np.searchsorted(closed, opened)
                    if not len(opened) or ends[-1] < len(closed):
                        break
                    more *= 8
                values = [raw[at[x] : at[closed[e]] + 1].tobytes().decode("utf-8") for x, e in zip(opened.tolist(), ends.tolist(), strict=True)]
                for j in range(0, len(values), 4096):
                    yield pd.DataFrame({"pos": np.arange(first + j, first + min(len(values), j + 4096)), "value": values[j : j + 4096]})

    where = spark.createDataFrame(rows, "k long, inside long, depth long, lo long, hi long, first long, many long")
    return where.repartition(max(1, len(rows)), "k").mapInPandas(objects, "pos long, value string")
