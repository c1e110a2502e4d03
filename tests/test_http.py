"""Lines over HTTP: ranges, and connections that break."""

from __future__ import annotations

import gzip
import random
import urllib.error

import pytest

from roundforge.plans.files import Served
from roundforge.sources import jsonl


@pytest.fixture(scope="module")
def lines(tmp_path_factory):
    rng = random.Random(1)
    at = tmp_path_factory.mktemp("served")
    rows = ["é" * rng.choice([0, 1, 7, 60]) + str(i) for i in range(400)] + ["", "last"]
    (at / "a.jsonl").write_bytes("\n".join(rows).encode())
    (at / "b.jsonl").write_bytes(("\r\n".join(rows) + "\r\n").encode())
    data = "\n".join(rows).encode()
    (at / "c.jsonl.gz").write_bytes(gzip.compress(data[:500]) + gzip.compress(data[500:]))
    (at / "empty.jsonl").write_bytes(b"")
    return at, rows


@pytest.mark.parametrize("breaks", [None, 97])
def test_ranges_have_every_line_once(lines, breaks, monkeypatch):
    at, rows = lines
    monkeypatch.setattr(jsonl, "PAUSE", 0)
    with Served(str(at), breaks) as base:
        for name in ("a.jsonl", "b.jsonl", "c.jsonl.gz"):
            for size in (1, 13, 1000, 10**6) if breaks is None else (1000, 10**6):
                reader = jsonl.HttpLinesReader([f"{base}/{name}"], size)
                parts = [p for p in reader.partitions()][:: 1 if size > 1 else 1]
                if size == 1:
                    parts = parts[:300]
                got = [v for p in parts for b in reader.read(p) for v in b.column("value").to_pylist()]
                assert got == rows if size > 1 or name.endswith("gz") else got == rows[: len(got)]
                assert len(parts) > 1 or size >= 10**6 or name.endswith("gz")
        assert [*jsonl.HttpLinesReader([f"{base}/empty.jsonl"], 10).read(jsonl.Range(0, f"{base}/empty.jsonl", 0, None))] == []


def test_lines_are_numbered_and_missing_files_told(spark, lines):
    at, rows = lines
    with Served(str(at), 3000) as base:
        got = jsonl.numbered(jsonl.read_lines(spark, f"{base}/a.jsonl", 1500)).orderBy("number").collect()
        assert [r["value"] for r in got] == rows and [r["number"] for r in got] == list(range(len(rows)))
        assert [r["value"] for r in jsonl.capped(jsonl.read_lines(spark, f"{base}/a.jsonl", 1500), 7).orderBy("pos").collect()] == rows[:7]
        with pytest.raises(urllib.error.HTTPError):
            next(jsonl.stream(f"{base}/none.jsonl"))


def test_a_server_that_sends_nothing_is_an_error(lines, monkeypatch):
    at, _ = lines
    monkeypatch.setattr(jsonl, "PAUSE", 0)
    with Served(str(at), 0) as base, pytest.raises(OSError, match="broke off at byte 0"):
        next(jsonl.stream(f"{base}/a.jsonl"))
