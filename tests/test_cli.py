"""The command line from raw lines to verified shards."""

from __future__ import annotations

import json

from roundforge.cli import main
from roundforge.sources import images


def raw(folder, category, n):
    with open(folder / f"{category}.jsonl", "w") as f:
        for i in range(3 * n):
            f.write(json.dumps({"images": [{"large_image_url": f"https://x/{category}{i}.jpg"}], "parent_asin": f"{category}{i % n}", "asin": f"A{i}", "rating": 1 + i % 5, "title": f"Review {i}", "text": f"Nice thing {i}, call 415-555-0132" if i % 7 == 0 else f"Nice thing number {i} and more of it"}) + "\n")
    with open(folder / f"meta_{category}.jsonl", "w") as f:
        for i in range(n):
            f.write(json.dumps({"parent_asin": f"{category}{i}", "title": f"{category} lamp model{i} kind{i % 4} colour{i % 5}", "main_category": category, "categories": [category, f"leaf{i % 3}"], "price": "$9.50"}) + "\n")


def test_from_raw_lines_to_shards(spark, tmp_path, capsys):
    for c in ("Pet", "Home"):
        raw(tmp_path, c, 30)
    p = lambda n: str(tmp_path / n)
    assert main(["build-pack", str(tmp_path), p("pack.json"), "Pet", "Home", "--limit", "40"], spark) == 0
    pack = json.loads((tmp_path / "pack.json").read_text())
    assert len(pack["rounds"]) == 40
    for r in pack["rounds"]:
        assert len(set(r["choices"])) == 4 and r["product"]["title"] in r["choices"] and r["source_category"] in ("Pet", "Home")
    assert len({r["product"]["parent_asin"] for r in pack["rounds"]}) == 40
    assert main(["validate", p("pack.json")], spark) == 0
    assert main(["score", p("pack.json"), p("scored.json")], spark) == 0
    assert main(["audit", p("scored.json"), "--output", p("audit.json")], spark) == 0
    assert main(["screen", p("scored.json"), p("screened.json"), "--exclude-high"], spark) == 0
    screened = json.loads((tmp_path / "screened.json").read_text())["rounds"]
    assert 0 < len(screened) < 40 and all("415" not in r["review_text"] for r in screened)
    ids = [r["id"] for r in screened]
    (tmp_path / "d.json").write_text(json.dumps({"kept_ids": ids[:3], "rejected_ids": ids[3:5]}))
    assert main(["apply-curation", p("screened.json"), p("d.json"), p("curated.json")], spark) == 0
    assert len(json.loads((tmp_path / "curated.json").read_text())["rounds"]) == len(ids) - 2
    assert main(["shard", p("curated.json"), p("out"), "--size", "7"], spark) == 0
    assert main(["validate-shards", p("out/manifest.json")], spark) == 0
    first = next((tmp_path / "out" / "shards").glob("*.json"))
    first.write_bytes(first.read_bytes().replace(b"Nice", b"Fine"))
    capsys.readouterr()
    assert main(["validate-shards", p("out/manifest.json")], spark) == 1
    assert "sha256 differs" in capsys.readouterr().out
    assert main(["publish-plan", p("out"), "site", "--report", p("plan.json")], spark) == 0
    assert not json.loads((tmp_path / "plan.json").read_text())["truncated"]


def test_local_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n....")
    rows = spark.createDataFrame([("a.png",), ("a.png",), ("../x",), ("gone.png",)], "review_image string")
    got = {r["url"]: r for r in images.fetch(rows, str(tmp_path)).collect()}
    assert len(got) == 3 and got["a.png"]["content_type"] == "image/png" and got["../x"]["error"] == "outside of the root" and got["gone.png"]["error"]
    assert images.live(rows, probe=lambda u: u == "a.png").count() == 2


def test_images_are_cached_and_uploaded(spark, tmp_path, capsys):
    import argparse
    from functools import partial

    import pytest

    from roundforge import cli

    class Client:
        """Takes uploads into a folder, under their keys."""

        def __init__(self, folder):
            self.folder = folder

        def upload_file(self, path, bucket, key, ExtraArgs):
            to = self.folder / bucket / key
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_bytes(open(path, "rb").read() + ExtraArgs["CacheControl"].encode())

    for name, data in (("a.png", b"\x89PNG\r\n\x1a\none"), ("b.png", b"\x89PNG\r\n\x1a\none"), ("c.jpg", b"\xff\xd8\xfftwo")):
        (tmp_path / name).write_bytes(data)
    rounds = [{"id": f"r{i}", "review_image": n, "product": {"title": "t"}, "choices": []} for i, n in enumerate(["a.png", "b.png", "c.jpg", "gone.png", "a.png"])]
    (tmp_path / "pack.json").write_text(json.dumps({"rounds": rounds}))
    p = lambda n: str(tmp_path / n)
    assert main(["cache-images", p("pack.json"), p("cache"), p("cached.json"), "--root", str(tmp_path), "--prefix", "assets/reviews"], spark) == 0
    cached = json.loads((tmp_path / "cached.json").read_text())
    assert [r["id"] for r in cached["rounds"]] == ["r0", "r2"] and cached["image_cache"]["failed"] == 1 and cached["image_cache"]["exact_duplicates"] == 2
    assert all((tmp_path / "cache" / r["review_image"].removeprefix("assets/reviews/")).exists() for r in cached["rounds"])
    assert main(["cache-images", p("pack.json"), p("cache"), p("all.json"), "--root", str(tmp_path), "--keep-failed", "--keep-exact-duplicates"], spark) == 0
    again = json.loads((tmp_path / "all.json").read_text())
    assert len(again["rounds"]) == 5 and again["image_cache"]["bytes_written"] == 0
    (tmp_path / "manifest.json").write_text("{}")
    a = argparse.Namespace(folder=p("cache"), bucket="b", key_prefix="img", endpoint=None, manifest=p("manifest.json"), prefix="assets/reviews", base_url="https://cdn")
    assert cli.upload(spark, a, partial(Client, tmp_path / "store")) == 0
    assert len(list((tmp_path / "store" / "b" / "img").iterdir())) == 2
    assert json.loads((tmp_path / "manifest.json").read_text())["asset_delivery"]["review_images"]["base_url"] == "https://cdn/"
    with pytest.raises(Exception, match="PIL|between|must be 0 to 16"):
        main(["cache-images", p("pack.json"), p("cache"), p("x.json"), "--root", str(tmp_path), "--perceptual-threshold", "4"], spark)
