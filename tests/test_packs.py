"""Packs: one JSON array read and written by many tasks."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest

from roundforge.sinks import writers
from roundforge.sources import jsonarray, packs

TEXTS = ["plain", 'quo"te', "back\\", '\\"', "[{", "}]", '"rounds":[', "é漢𝄞", "", "\\\\\\", "{" * 20, "tab\tnew\n"]


def test_marks_by_a_plain_parser():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice('"\\{}[]a') for _ in range(rng.randint(0, 40)))
        cut = rng.randint(0, len(text))
        back = len(text[:cut]) - len(text[:cut].rstrip("\\"))
        want, hidden = [], False
        for i, c in enumerate(text):
            if c == '"' and not hidden and i >= cut:
                want.append(i - cut)
            hidden = c == "\\" and not hidden
        quotes, brackets, before = jsonarray.marks(np.frombuffer(text[cut:].encode(), np.uint8), back)
        assert quotes.tolist() == want and brackets.tolist() == [i for i, c in enumerate(text[cut:]) if c in "{}[]"]
        assert before.tolist() == [sum(q < b for q in want) for b in brackets.tolist()]


@pytest.mark.parametrize("size", [60, 999, 10**6])
@pytest.mark.parametrize("indent", [None, 3])
def test_one_array_by_many_tasks(spark, tmp_path, size, indent):
    rng = random.Random(size)
    row = lambda i: {"id": i, "text": rng.choice(TEXTS), "deep": [{"rounds": [{"x": rng.choice(TEXTS)}]}, [[]]], rng.choice(TEXTS) + "k": None}
    rows = [row(i) for i in range(6 if size < 100 else 60)]
    pack = {"name": rng.choice(TEXTS), "index": [row(-1), row(-2)], "deep": {"rounds": [row(-3)]}, "empty": [], "rounds": rows, "after": [row(-4), 'x"rounds":['], "last": "]"}
    at = tmp_path / "pack.json"
    at.write_text(json.dumps(pack, indent=indent, ensure_ascii=rng.random() < 0.5))
    got = jsonarray.read(spark, str(at), "rounds", size).collect()
    assert [json.loads(r["value"]) for r in sorted(got)] == rows and sorted(r["pos"] for r in got) == list(range(len(rows)))
    assert sorted(json.loads(r["value"])["id"] for r in jsonarray.read(spark, str(at), "index", size).collect()) == [-2, -1]
    assert jsonarray.read(spark, str(at), "empty", size).count() == 0 and jsonarray.read(spark, str(at), "name", size) is None


def test_pack_in_parts(spark, tmp_path):
    rows = [(i, f"r{i}", [t]) for i, t in enumerate(TEXTS * 20)]
    df = spark.createDataFrame(rows, "pos long, id string, choices array<string>").repartition(7)
    at = str(tmp_path / "out" / "rounds.json")
    writers.write_pack(df, {"version": 2}, at)
    want = {"version": 2, "rounds": [{"id": i, "choices": c} for _, i, c in rows]}
    with open(at, encoding="utf-8") as f:
        assert f.read() == json.dumps(want, ensure_ascii=False, separators=(",", ":"))
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["rounds.json"]
    got = packs.read_inline(spark, at, 100)
    assert got.rdd.getNumPartitions() > 20
    assert [(r["pos"], r["id"], r["choices"]) for r in got.orderBy("pos").collect()] == rows
    writers.write_pack(df.limit(0), {}, at)
    with open(at, encoding="utf-8") as f:
        assert f.read() == '{"rounds":[]}'
    with pytest.raises(packs.PackError):
        (tmp_path / "none.json").write_text('{"rounds": 3}')
        packs.read_inline(spark, str(tmp_path / "none.json"))
