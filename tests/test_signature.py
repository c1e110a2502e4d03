from __future__ import annotations

import random

import pytest

from roundforge.operators.signature import signatures


def fnv(ids):
    h = 2166136261
    for unit in memoryview("|".join(sorted(ids)).encode("utf-16-le")).cast("H"):
        h = ((h ^ unit) * 16777619) & 0xFFFFFFFF
    return f"{h:x}"


@pytest.mark.parametrize("part", [7, 10**6])
def test_parts_are_folded_in_order(spark, part):
    rng = random.Random(part)
    name = lambda: "".join(rng.choice("abcé𝄞z09") for _ in range(rng.randint(0, 6)))
    rows = [("big", name()) for _ in range(60)] + [(g, name()) for g in ("a", "b", None) for _ in range(5)] + [("one", None), ("same", "x"), ("same", "x")]
    df = spark.createDataFrame(rows, "g string, id string").repartition(3)
    got = {r["g"]: r["signature"] for r in signatures(df, "id", "g", part_ids=part).collect()}
    assert got == {g: fnv([i or "" for k, i in rows if k == g]) for g in {g for g, _ in rows}}
    ascii_ = df.filter("id rlike '^[a-z0-9]*$'")
    ids = [r["id"] for r in ascii_.collect()]
    assert [r["signature"] for r in signatures(ascii_, "id", part_ids=part).collect()] == [fnv(ids)]
    assert [r["signature"] for r in signatures(df.limit(0), "id").collect()] == [fnv([])] and signatures(df.limit(0), "id", "g").count() == 0


def test_no_part_waits_for_another(spark):
    """2000 parts take as many jobs as one: the passes go by bits of the state, not by parts."""
    ids = [f"{i:05x}" for i in range(20_000)]
    df = spark.createDataFrame([(i,) for i in ids], "id string").repartition(3)
    spark.sparkContext.setJobGroup("signature-parts", "signatures of many parts")
    try:
        assert [r["signature"] for r in signatures(df, "id", part_ids=10).collect()] == [fnv(ids)]
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("signature-parts")
    finally:
        spark.sparkContext.setJobGroup("others", "")
    assert len(jobs) < 60
