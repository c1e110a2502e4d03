"""Ingest, packs, shards, workspaces and clean-up on files of their own."""

from __future__ import annotations

import gzip
import json
import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from roundforge.operators import curation, sharding, workspace
from roundforge.sinks import writers
from roundforge.sources import jsonl, packs
from roundforge.streaming import events as ev

REVIEWS = [
    {"images": [{"small_image_url": "http://x/s.jpg", "large_image_url": "ftp://no"}, {"large_image_url": "https://x/l.jpg"}], "parent_asin": "P1", "rating": 4, "title": " ok ", "text": "a  b", "timestamp": 5, "helpful_vote": "3"},
    {"images": {"large_image_url": [None, "https://x/2.jpg"]}, "parent_asin": "P2", "rating": True, "verified_purchase": True, "helpful_vote": 2},
    {"images": [], "asin": 7, "parent_asin": "P3"},
]
PRODUCTS = [
    {"parent_asin": "P1", "title": "One thing", "categories": ["Home", "home", 5, "Lamp"], "price": "$1,299.50", "images": [{"variant": "PT01", "large": "https://x/a.jpg"}, {"variant": "MAIN", "large": "https://x/m.jpg"}]},
    {"parent_asin": "P2", "title": "Two things", "main_category": " Pets ", "price": 3, "images": {"variant": ["PT01", "MAIN"], "hi_res": [None, None], "large": ["https://x/p.jpg", "https://x/q.jpg"]}},
    {"parent_asin": "P3", "title": "x"},
]


def test_jsonl_reviews_and_products(spark, tmp_path):
    lines = [json.dumps(REVIEWS[0]), "", "[1, 2]", "3", json.dumps(REVIEWS[1]), json.dumps(REVIEWS[2])]
    with gzip.open(tmp_path / "r.jsonl.gz", "wt") as f:
        f.write("\n".join(lines) + "\n")
    rows = jsonl.reviews(jsonl.decode(jsonl.read_lines(spark, str(tmp_path / "r.jsonl.gz")))).orderBy("pos").collect()
    assert [r["review_image"] for r in rows] == ["http://x/s.jpg", "https://x/2.jpg", None]
    assert [(r["rating"], r["review_title"], r["helpful_vote"], r["verified_purchase"], r["asin"]) for r in rows] == [(4.0, "Customer review", 0, False, None), (1.0, "Customer review", 2, True, None), (None, "Customer review", 0, False, None)]
    assert rows[0]["review_text"] == "a b" and rows[0]["timestamp"] == 5
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, PRODUCTS)))
    p = {r["parent_asin"]: r for r in jsonl.products(jsonl.decode(jsonl.read_lines(spark, str(tmp_path / "m.jsonl")))).collect()}
    assert sorted(p) == ["P1", "P2"]
    assert (p["P1"]["category"], p["P1"]["category_path"], p["P1"]["leaf_category"], p["P1"]["price"], p["P1"]["product_image"]) == ("Home", ["Home", "Lamp"], "Lamp", 1299.5, "https://x/m.jpg")
    assert (p["P2"]["category"], p["P2"]["price"], p["P2"]["product_image"]) == ("Pets", 3.0, "https://x/q.jpg")


def test_bad_line_and_cap(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 2}\n')
    lines = jsonl.read_lines(spark, str(tmp_path / "b.jsonl"))
    with pytest.raises(Exception, match="invalid JSON"):
        jsonl.decode(lines).collect()
    assert jsonl.decode(lines, strict=False).count() == 2
    assert jsonl.decode(jsonl.capped(lines, 2)).count() == 1
    with pytest.raises(FileNotFoundError):
        jsonl.category_sources("none", tmp_path)


def pack(n=10):
    return [{"id": f"r{i}", "source_category": "ab"[i % 2], "review_image": f"assets/reviews/{i}.jpg", "product": {"title": f"t{i}", "parent_asin": f"P{i}", "category": "c"}, "choices": [f"t{i}", "x", "y", "z"]} for i in range(n)]


def test_shards_round_trip(spark, tmp_path):
    (tmp_path / "rounds.json").write_text(json.dumps({"rounds": pack()}))
    rounds = packs.open_pack(spark, str(tmp_path))
    assert rounds.count() == 10
    flat = rounds.withColumn("category", F.col("product.category"))
    placed = sharding.assign(flat, 4, 7).withColumn("json", F.to_json(F.struct(*[c for c in rounds.columns if c != "pos"])))
    header = {"version": 2, "format": "shard", "dataset_signature": "s1"}
    listed = writers.write_shards(placed, str(tmp_path), header).checkpoint()
    assert sorted((r["id"], r["round_count"]) for r in listed.collect()) == [("0001", 4), ("0002", 4), ("0003", 2)]
    index = [{"id": r["id"], "shard": r["shard"]} for r in placed.select("id", "shard").collect()]
    manifest = {"version": 1, "format": "sharded", "dataset_signature": "s1", "shards": [r.asDict() for r in listed.collect()], "index": index}
    (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    assert packs.open_pack(spark, str(tmp_path)).count() == 10
    got = packs.lookup(spark, str(tmp_path / "manifest.json"), ["r7", "r2"])
    assert [r["id"] for r in got.collect()] == ["r7", "r2"]
    shards = {e["shard"] for e in index if e["id"] in ("r7", "r2")}
    read = packs.read_manifest(spark, str(tmp_path / "manifest.json"))
    packs.write_index(read, str(tmp_path / "index"))
    for s in manifest["shards"]:
        if s["id"] not in shards:
            (tmp_path / s["path"]).unlink()  # only the files that are asked for are opened
    for table in (None, str(tmp_path / "index")):
        assert [r["id"] for r in packs.lookup(spark, read, ["r7", "r2"], table).collect()] == ["r7", "r2"]
        with pytest.raises(packs.PackError):
            packs.lookup(spark, read, ["nope"], table)
    manifest["shards"][0]["path"] = "../x.json"
    (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    with pytest.raises(packs.PackError):
        packs.open_pack(spark, str(tmp_path))


def test_shard_errors(spark):
    cats = "map<string,bigint>"
    listed = spark.createDataFrame([("1", "a/1.json", 2, "h", {"a": 2}), ("2", "../2.json", 1, "h", {"a": 1}), ("3", "a/3.json", 1, "h", {"a": 1})], f"id string, path string, round_count long, sha256 string, categories {cats}")
    actual = spark.createDataFrame([("1", 2, "x", {"a": 1, "b": 1}), ("2", 1, "h", {"a": 1})], f"id string, round_count long, sha256 string, categories {cats}")
    got = {(r["error"], r["id"]) for r in sharding.shard_errors(listed, actual).collect()}
    assert got == {("sha256 differs", "1"), ("categories differ", "1"), ("unsafe path", "2"), ("missing file", "3")}
    twice = spark.createDataFrame([("a",), ("a",)], "id string")
    assert [r["error"] for r in sharding.check_rounds(twice, 5).collect()] == ["ids are not unique"]


def test_decisions(spark, tmp_path):
    at = tmp_path / "d.json"
    at.write_text(json.dumps({"dataset_signature": "s", "kept_ids": ["a"], "rejected_ids": ["b"]}))
    d = packs.read_decisions(spark, str(at), "s")
    assert {(r["id"], r["decision"]) for r in d.collect()} == {("a", "keep"), ("b", "reject")}
    with pytest.raises(packs.PackError):
        packs.read_decisions(spark, str(at), "other")
    for bad in ({"kept_ids": ["a"], "rejected_ids": ["a"]}, {"kept_ids": "a"}, {"kept_ids": ["a", 3]}, {"rejected_ids": {"a": 1}}):
        at.write_text(json.dumps(bad))
        with pytest.raises(packs.PackError):
            packs.read_decisions(spark, str(at))
    own = spark.createDataFrame([("b", "keep"), ('a"\\é', "keep"), ("z", "reject"), ("y", None)], "id string, decision string").repartition(3)
    writers.write_decisions(own, "s", str(at))
    assert json.loads(at.read_text()) == {"version": 1, "dataset_signature": "s", "kept_ids": ['a"\\é', "b"], "rejected_ids": ["z"]}
    assert {(r["id"], r["decision"]) for r in packs.read_decisions(spark, str(at), "s").collect()} == {('a"\\é', "keep"), ("b", "keep"), ("z", "reject")}
    writers.write_decisions(own.limit(0), "s", str(at))
    assert packs.read_decisions(spark, str(at), "s").count() == 0
    changes = spark.createDataFrame([("a", None, 2), ("c", "keep", 1), ("a", "reject", 1)], "id string, decision string, pos long")
    assert {(r["id"], r["decision"]) for r in curation.upsert(d, changes).collect()} == {("b", "reject"), ("c", "keep")}


def test_prune_and_assets(spark, tmp_path):
    images = spark.createDataFrame([("u1", b"abc", ".jpg"), ("u2", b"abc", ".jpg")], "url string, content binary, extension string").coalesce(1)
    got = writers.write_assets(images, str(tmp_path / "c")).collect()
    assert sorted(r["bytes_written"] for r in got) == [0, 3] and len({r["name"] for r in got}) == 1
    (tmp_path / "c" / "sub").mkdir()
    (tmp_path / "c" / "sub" / "o.jpg").write_bytes(b"12345")
    (tmp_path / "c" / "link.jpg").symlink_to(tmp_path / "c" / "sub" / "o.jpg")
    files = packs.read_files(spark, str(tmp_path / "c"))
    assert {r["path"] for r in files.collect()} == {got[0]["name"], "sub/o.jpg"}
    orphans = files.filter("path like 'sub/%'")
    assert writers.prune(orphans, str(tmp_path / "c")) == {"files": 1, "bytes": 5, "deleted": False}
    assert (tmp_path / "c" / "sub" / "o.jpg").exists()
    writers.prune(orphans, str(tmp_path / "c"), delete=True)
    assert not (tmp_path / "c" / "sub").exists()


def test_workspace_store(spark, tmp_path):
    store = workspace.Store(spark, str(tmp_path / "log"))
    a = store.save("s", 0, {"decisions": {"x": "keep", "y": "keep"}}, " Ann ")
    assert a["ok"] and a["revision"] == 1
    b = store.save("s", 1, {"decisions": {"x": "keep"}}, "Bob")  # the base is the head: y is deleted
    assert b["workspace"] == {"decisions": {"x": "keep"}}
    c = store.save("s", 1, {"decisions": {"x": "reject", "y": "keep"}}, "Cy")
    assert c["ok"] and c["workspace"] == {"decisions": {"x": "reject"}}
    d = store.save("s", 1, {"decisions": {"x": "maybe"}}, "Di")
    assert d["conflict"] and d["revision"] == 3
    e = store.save("s", 1, {"decisions": {"x": "maybe"}}, "Di", "prefer_remote")
    assert not e["changed"]
    with pytest.raises(ValueError):
        store.save("s", 9, {}, "Ed")
    assert [r["actor"] for r in workspace.history(store.read(), "s").collect()] == ["Cy", "Bob", "Ann"]


def test_streams(spark, small, tmp_path):
    spark.read.parquet(f"{small}/events.parquet").write.parquet(str(tmp_path / "in"))
    stream = ev.read_stream(spark, str(tmp_path / "in"))
    runs = {"w": ev.tumbling(stream), "s": ev.running_streaks(ev.outcomes(stream)), "d": ev.distinct_events(stream).select("event_id")}
    for name, df in runs.items():
        mode = {"w": "complete", "s": "update", "d": "append"}[name]
        df.writeStream.format("memory").queryName(f"q_{name}").outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    batch = spark.read.parquet(f"{small}/events.parquet")
    assert sorted(map(tuple, spark.table("q_w").collect())) == sorted(map(tuple, ev.tumbling(batch).collect()))
    assert spark.table("q_d").count() == batch.count()
    from roundforge.operators import game

    scored = game.results(game.streak_scores(ev.outcomes(batch), order=("ts", "event_id")))
    assert {(r["user_id"], r["score"]) for r in spark.table("q_s").collect()} == {(r["user_id"], r["score"]) for r in scored.collect()}


RACE = """
import sys
from roundforge.operators.workspace import Store
store, won = Store(None, sys.argv[1]), []
for n in range(1, 301):
    if store.append("s", n, {"decisions": {str(n): sys.argv[2]}}, sys.argv[2]):
        won.append(n)
print(*won)
"""


def test_of_two_processes_one_makes_a_revision(spark, tmp_path):
    at = str(tmp_path / "log")
    both = [subprocess.Popen([sys.executable, "-c", RACE, at, name], stdout=subprocess.PIPE, text=True, cwd=Path(__file__).resolve().parent.parent) for name in ("Ann", "Bob")]
    won = {name: set(map(int, p.communicate(timeout=120)[0].split())) for name, p in zip(("Ann", "Bob"), both, strict=True)}
    assert not won["Ann"] & won["Bob"] and won["Ann"] | won["Bob"] == set(range(1, 301))
    store = workspace.Store(spark, at)
    assert store.newest("s") == 300 and store.newest("other") == 0
    assert {(r["revision"], r["actor"]) for r in store.read().collect()} == {(n, name) for name, ns in won.items() for n in ns}
    assert store.revision("s", 7) == {"decisions": {"7": "Ann" if 7 in won["Ann"] else "Bob"}}


def test_saves_at_the_same_time_lose_nothing(spark, tmp_path):
    at = str(tmp_path / "log")

    def writer(name):
        store = workspace.Store(spark, at)
        return [store.save("s", 0, {"decisions": {f"{name}{k}": "keep"}}, name)["ok"] for k in range(4)]

    with ThreadPoolExecutor(3) as pool:
        assert all(all(x) for x in pool.map(writer, "abc"))
    number, now = workspace.Store(spark, at).current("s")
    assert number == 12 and now == {"decisions": {f"{n}{k}": "keep" for n in "abc" for k in range(4)}}
