"""Writers. Files of a shard or an asset are written by tasks, through the file system of their folder's URI, under names that make a repeated
write harmless. Reports and manifests are written by the driver."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundforge.functions import text
from roundforge.session import checkpointed
from roundforge.sources import stores
from roundforge.sources.packs import PackError, safe_relative


def canonical_json(value: object) -> bytes:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode("utf-8")


def replace_file(path: Path | str, data: bytes) -> None:
    """Written beside and renamed, so that no reader sees half a file. path: a URI or a local path."""
    store, at = stores.opened(str(path))
    stores.replace(store, at, data)


def write_json(fields: dict[str, object], path: str) -> None:
    """One JSON object in one file. A field that is a DataFrame (pos and others) is an array of its rows in order of pos, or of plain values where the only other column is
    named value. Tasks write the rows of a range of
    pos each into a part beside the file, and one task joins the parts' bytes, so the driver holds a row for each part. A part's name has its
    task's attempt, only those of tasks that ended well are joined."""
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    pieces: list[tuple[bool, str]] = []  # text, or the name of a part
    spark = None

    def writer(field: int):
        def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            task = TaskContext.get()
            name = f"{field}-{task.partitionId():08d}-{task.taskAttemptId()}"
            store, root = stores.opened(parts)
            batches = (b for b in batches if len(b))
            first = next(batches, None)
            if first is None:
                return
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(",".join(first["j"]).encode())
                for b in batches:
                    out.write(("," + ",".join(b["j"])).encode())
            yield pd.DataFrame({"part": [task.partitionId()], "name": [name]})

        return write

    for k, (key, value) in enumerate(fields.items()):
        pieces.append((False, ("," if k else "{") + json.dumps(key, ensure_ascii=False) + ":"))
        if not isinstance(value, DataFrame):
            pieces.append((False, json.dumps(value, ensure_ascii=False, separators=(",", ":"))))
            continue
        spark = value.sparkSession
        rows = value.repartitionByRange("pos").sortWithinPartitions("pos").drop("pos")
        one = F.to_json(F.array("value")) if rows.columns == ["value"] else F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
        rows = rows.select((F.substr(one, F.lit(2), F.length(one) - 2) if rows.columns == ["value"] else one).alias("j"))
        names = [r["name"] for r in sorted(rows.mapInPandas(writer(k), "part int, name string").collect())]
        pieces.append((False, "["))
        for i, name in enumerate(names):
            pieces += [(False, ",")] * (i > 0) + [(True, name)]
        pieces.append((False, "]"))
    pieces.append((False, "}"))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = stores.opened(parts)

        def joined() -> Iterator[bytes]:
            for is_part, piece in pieces:
                if not is_part:
                    yield piece.encode("utf-8")
                    continue
                with store.open_input_stream(f"{root}/{piece}") as f:
                    while data := f.read(4_000_000):
                        yield bytes(data)

        for b in batches:
            stores.replace_by(store, stores.opened(path)[1], joined())
            yield b

    if spark is None:
        raise ValueError("no field is a DataFrame")
    spark.range(0, 1, 1, 1).mapInPandas(join, "id long").collect()
    store, root = stores.opened(parts)
    if any(is_part for is_part, _ in pieces):
        store.delete_dir(root)


def write_pack(rounds: DataFrame, header: dict, path: str) -> None:
    """A pack as one JSON file, rounds in order of pos."""
    write_json(header | {"rounds": rounds}, path)


def write_decisions(decisions: DataFrame, signature: str, path: str) -> None:
    """A decisions file of version 1: sorted ids that are kept, and that are rejected."""
    ids = lambda what: decisions.filter(F.col("decision") == what).select(F.col("id").alias("pos"), F.col("id").alias("value"))
    write_json({"version": 1, "dataset_signature": signature, "kept_ids": ids("keep"), "rejected_ids": ids("reject")}, path)


def write_shards(rounds: DataFrame, folder: str, header: dict, prefix: str = "shards/rounds") -> DataFrame:
    """Writes a canonical JSON file for each shard (rounds: shard, place, json) below ``folder``, a URI or a local path; returns id,
    path, round_count, sha256. A task holds one shard at a time. A shard's number, from 1, is its id's."""
    safe_relative(prefix)
    count = rounds.select("shard").distinct().count()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        now = None

        def done() -> pd.DataFrame:
            data = canonical_json(header | {"shard": {"id": now, "index": int(now), "count": count}, "rounds": [json.loads(j) for j in held]})
            path = f"{prefix}-{now}.json"
            store, root = stores.opened(folder)
            stores.replace(store, f"{root.rstrip('/')}/{path}", data)
            return pd.DataFrame([(now, path, len(held), hashlib.sha256(data).hexdigest())], columns=["id", "path", "round_count", "sha256"])

        for b in batches:
            for shard, j in zip(b["shard"], b["json"], strict=True):
                if now is not None and shard != now:
                    yield done()
                    held = []
                now = shard
                held.append(j)
        if held:
            yield done()

    return rounds.select("shard", "place", "json").repartition("shard").sortWithinPartitions("shard", "place").mapInPandas(run, "id string, path string, round_count long, sha256 string")


def write_assets(images: DataFrame, folder: str) -> DataFrame:
    """Stores contents (url, content, extension) under their digest; returns url, name, sha256 and the bytes written, 0 if the file was there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = stores.opened(folder)
        for b in batches:
            out = []
            for url, content, extension in zip(b["url"], b["content"], b["extension"], strict=True):
                digest = hashlib.sha256(content).hexdigest()
                name = f"{digest[:24]}{extension}"
                path = f"{root.rstrip('/')}/{name}"
                new = stores.size(store, path) is None
                if new:
                    stores.replace(store, path, bytes(content))
                out.append((url, name, digest, len(content) if new else 0))
            yield pd.DataFrame(out, columns=["url", "name", "sha256", "bytes_written"])

    return images.select("url", "content", "extension").mapInPandas(run, "url string, name string, sha256 string, bytes_written long")


def write_report(report: DataFrame, path: str, sample: int | None = None) -> dict:
    """A bounded report as JSON; with ``sample``, its first rows and whether there are more."""
    rows = report.limit(sample + 1).collect() if sample else report.collect()
    payload = {"rows": [r.asDict(True) for r in rows[:sample]], "truncated": bool(sample and len(rows) > sample)}
    replace_file(path, json.dumps(payload, ensure_ascii=False, indent=2, default=str).encode("utf-8"))
    return payload


def upload(plan: DataFrame, client: Callable[[], object], bucket: str) -> None:
    """Puts files (path, object_key, content_type) through a client made once in each task, to be cached for ever."""

    def run(rows: Iterator) -> None:
        own = client()
        for r in rows:
            own.upload_file(r["path"], bucket, r["object_key"], ExtraArgs={"ContentType": r["content_type"], "CacheControl": "public, max-age=31536000, immutable"})

    plan.foreachPartition(run)


def patch_manifest(path: str, prefix: str, base_url: str) -> None:
    """Tells the manifest where its images are, after all uploads."""
    manifest = json.loads(stores.text(path))
    manifest["asset_delivery"] = {"review_images": {"path_prefix": prefix.strip("/") + "/", "base_url": base_url.rstrip("/") + "/"}}
    replace_file(path, json.dumps(manifest, ensure_ascii=False, separators=(",", ":")).encode("utf-8"))


def prune(orphans: DataFrame, folder: str, delete: bool = False) -> dict:
    """Deletes orphaned files and folders left empty; by default only tells what it would do. Tasks delete, and a file that is gone is no error, so
    a task may be repeated; folders are taken away from the deepest level up."""
    checked = orphans.select("path", "length").distinct()
    if unsafe := checked.filter(~text.safe_path(F.col("path"))).first():
        raise PackError(f"unsafe path {unsafe['path']!r}")

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = stores.opened(folder)
        for b in batches:
            for path in b["path"]:
                at = f"{root.rstrip('/')}/{path}"
                link = store.type_name == "local" and os.path.islink(at)
                if not link and stores.size(store, at) is not None:
                    store.delete_file(at)
            yield pd.DataFrame({"dir": [p.rpartition("/")[0] for p in b["path"]]})

    def folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = stores.opened(folder)
        for b in batches:
            above = []
            for d in b["dir"]:
                at = f"{root.rstrip('/')}/{d}"
                if store.get_file_info(at).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(at)):
                    store.delete_dir(at)
                    above.append(d.rpartition("/")[0])
            yield pd.DataFrame({"dir": above}, dtype=object)

    told = checked.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes")).first()
    if delete:
        level = checkpointed(checked.mapInPandas(files, "dir string").distinct().filter("dir != ''"))
        while not level.isEmpty():
            # the deepest first, as a folder may hold others that are still to go
            depth = F.size(F.split("dir", "/"))
            deepest = level.agg(F.max(depth)).first()[0]
            gone = level.filter(depth == deepest).mapInPandas(folders, "dir string").filter("dir != ''")
            level = checkpointed(level.filter(depth < deepest).union(gone).distinct())
    return {"files": told["files"], "bytes": told["bytes"], "deleted": delete}
