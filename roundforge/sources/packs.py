"""Packs: inline, sharded, lazily read, decisions; files of a cache."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice
from pathlib import PurePosixPath

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundforge.functions import text
from roundforge.session import checkpointed
from roundforge.sources import jsonarray, stores

PRODUCT = "struct<title:string,category:string,category_path:array<string>,leaf_category:string,price:double,product_image:string,store:string,asin:string,parent_asin:string,source_url:string>"
ANALYSIS = "struct<difficulty_score:int,curation_priority:int,flags:array<string>,choice_similarity_max:double,choice_similarity_mean:double,review_title_leak_ratio:double,image_host:string>"
SCREENING = "struct<risk_score:int,needs_review:boolean,high_risk:boolean,flags:array<struct<name:string,severity:string,source:string>>,severity_counts:map<string,int>>"
ROUND = f"struct<id:string,source_category:string,review_image:string,rating:double,review_title:string,review_text:string,helpful_vote:bigint,verified_purchase:boolean,timestamp:bigint,product:{PRODUCT},choices:array<string>,analysis:{ANALYSIS},screening:{SCREENING}>"


class PackError(ValueError):
    """A pack that can't be used."""


def safe_relative(path: str) -> PurePosixPath:
    p = PurePosixPath(path)
    if not path or p.is_absolute() or "\\" in path or any(x in ("", ".", "..") for x in path.split("/")):
        raise PackError(f"unsafe path {path!r}")
    return p


def read_inline(spark: SparkSession, path: str, range_bytes: int = jsonarray.RANGE_BYTES) -> DataFrame:
    """The rounds of a JSON file, with pos. Many tasks read one file, a range of its bytes each."""
    rows = jsonarray.read(spark, path, "rounds", range_bytes)
    if rows is None:
        raise PackError("the pack has no rounds array")
    return rows.select("pos", F.from_json("value", ROUND).alias("r")).select("pos", "r.*")


SHARD = "struct<id:string,path:string,round_count:bigint,sha256:string,categories:map<string,bigint>>"
INDEX = "struct<id:string,category:string,shard:string>"


@dataclass(frozen=True)
class Manifest:
    """A sharded pack's manifest: what is large in it, the list of shards and the index, are tables that tasks read."""

    root: str
    signature: str | None
    shards: DataFrame
    index: DataFrame


def read_manifest(spark: SparkSession, path: str, format_name: str | None = None) -> Manifest:
    head = spark.read.schema("dataset_signature string, format string").json(path, multiLine=True).first()
    shards, index = (jsonarray.read(spark, path, key) for key in ("shards", "index"))
    if shards is None or index is None:
        raise PackError("not a sharded pack's manifest")
    if format_name and head["format"] != format_name:
        raise PackError("the manifest has another format")
    listed = shards.select(F.from_json("value", SHARD).alias("s")).select("s.*")
    if unsafe := listed.filter(~text.safe_path(F.coalesce("path", F.lit("")))).first():
        raise PackError(f"unsafe path {unsafe['path']!r}")
    return Manifest(path.rpartition("/")[0] or ".", head["dataset_signature"], listed, index.select("pos", F.from_json("value", INDEX).alias("i")).select("pos", "i.*"))


def read_texts(listed: DataFrame, root: str) -> DataFrame:
    """``listed`` (path and others) with the text of each file (content), opened by tasks below a folder."""
    kept = listed.columns

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(len(b)):
                yield b.iloc[i : i + 1].assign(content=stores.text(f"{root}/{b['path'].iloc[i]}"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema) + ", content string"
    return listed.repartition("path").mapInPandas(opened, schema).select(*kept, "content")


def read_shards(spark: SparkSession, manifest: str | Manifest, shards: DataFrame | None = None) -> DataFrame:
    """The rounds of a sharded pack, or of some of its shards (column shard): only their files are opened. Each file must name the pack's signature and its own shard."""
    m = manifest if isinstance(manifest, Manifest) else read_manifest(spark, manifest)
    listed = m.shards.select(F.col("id").alias("shard"), "path")
    if shards is not None:
        listed = listed.join(shards.select("shard").distinct(), "shard", "left_semi")
    file = F.from_json("content", f"struct<dataset_signature:string,shard:struct<id:string>,rounds:array<{ROUND}>>")
    files = read_texts(listed, m.root).select("shard", file.alias("f"))
    right = (F.col("f.dataset_signature") == m.signature) & (F.col("f.shard.id") == F.col("shard"))
    checked = files.withColumn("__ok", F.assert_true(F.coalesce(right, F.lit(False)), F.lit("a shard's signature or id differs"))).filter("__ok is null")
    return checked.select("shard", F.explode("f.rounds").alias("r")).select("shard", "r.*")


#: Buckets of an index table.
BUCKETS = 64


def _bucket(name: str = "id"):
    return F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int")


def write_index(manifest: Manifest, folder: str) -> None:
    """The index as a table that is partitioned by a hash of the id, for look-ups that read a part of it only."""
    manifest.index.select("id", "shard", _bucket().alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)


def lookup(spark: SparkSession, manifest: str | Manifest, ids: list[str] | DataFrame, index: str | None = None) -> DataFrame:
    """The rounds of the given ids (a list, or a table of pos and id), in their order, from the shards that hold them. index: a table of write_index(), of which the
    ids' buckets alone are read; without one the manifest's own index is."""
    m = manifest if isinstance(manifest, Manifest) else read_manifest(spark, manifest)
    wanted = ids if isinstance(ids, DataFrame) else spark.createDataFrame(list(enumerate(ids)), "pos long, id string")
    table = m.index.select("id", "shard")
    if index is not None:
        buckets = [r["b"] for r in wanted.select(_bucket().alias("b")).distinct().collect()]  # BUCKETS at most
        table = spark.read.schema("id string, shard string, bucket int").parquet(index).filter(F.col("bucket").isin(buckets)).select("id", "shard")
    where = checkpointed(wanted.join(table, "id", "left"))
    if missing := where.filter("shard is null").first():
        raise PackError(f"no round {missing['id']}")
    return wanted.join(read_shards(spark, m, where), "id", "left").orderBy("pos")


def open_pack(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest's pack; only where there is none, rounds.json, then demo.json. A manifest that is invalid is an error."""
    there = lambda name: stores.kind(f"{folder}/{name}") is fs.FileType.File
    if there("manifest.json"):
        return read_shards(spark, f"{folder}/manifest.json")
    for name in ("rounds.json", "demo.json"):
        if there(name):
            return read_inline(spark, f"{folder}/{name}")
    raise PackError(f"no pack in {folder}")


def read_decisions(spark: SparkSession, path: str, signature: str | None = None) -> DataFrame:
    """id and decision of a decisions file, after checks of its types, its signature, and that no id is both kept and rejected. One task
    reads the file, which is one curator's; the driver is told what the checks need, and no ids."""
    file = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    part = lambda name: F.try_variant_get("v", f"$.{name}", "variant")
    told = file.select(F.schema_of_variant(part("kept_ids")).alias("kept"), F.schema_of_variant(part("rejected_ids")).alias("rejected"), F.try_variant_get("v", "$.dataset_signature", "string").alias("signature")).first()
    if not all(told[k] in (None, "ARRAY<STRING>", "ARRAY<VOID>") for k in ("kept", "rejected")):
        raise PackError("ids must be lists of strings")
    ids = lambda name: file.select(F.explode(F.try_variant_get("v", f"$.{name}", "array<string>")).alias("id"))
    kept, rejected = ids("kept_ids"), ids("rejected_ids")
    if kept.join(rejected, "id", "left_semi").first():
        raise PackError("an id is both kept and rejected")
    if signature is not None and told["signature"] not in (None, signature):
        raise PackError("the decisions are for another pack")
    # cut loose from the file, which may be written anew
    return checkpointed(kept.withColumn("decision", F.lit("keep")).union(rejected.withColumn("decision", F.lit("reject"))))


def _entries(store: fs.FileSystem, at: str) -> Iterator[tuple[str, bool, int]]:
    """name, whether it is a folder, and length of what a folder holds; links are left out."""
    if store.type_name == "local":
        with os.scandir(at) as found:
            for e in found:
                if not e.is_symlink():
                    yield e.name, e.is_dir(), 0 if e.is_dir() else e.stat().st_size
        return
    for e in store.get_file_info(fs.FileSelector(at)):
        yield e.base_name, e.type == fs.FileType.Directory, e.size or 0


def read_files(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """path (relative) and length of the files below a folder, a path or a URI, links and what they lead to left out; with content only if asked for.

    Tasks list folders, one level after the other, so the driver sees no names."""
    if stores.kind(folder) is not fs.FileType.Directory:
        raise FileNotFoundError(folder)

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = stores.opened(folder)
        for b in batches:
            for d in b["dir"]:
                found = _entries(store, f"{root.rstrip('/')}/{d}")
                while some := list(islice(found, 10_000)):
                    yield pd.DataFrame([(f"{d}/{name}" if d else name, is_dir, length) for name, is_dir, length in some], columns=["path", "is_dir", "length"])

    level, files = spark.createDataFrame([("",)], "dir string"), []
    while True:
        listed = checkpointed(level.repartition("dir").mapInPandas(entries, "path string, is_dir boolean, length long"))
        files.append(listed.filter("not is_dir").select("path", "length"))
        level = listed.filter("is_dir").select(F.col("path").alias("dir"))
        if level.isEmpty():
            break
    out = reduce(DataFrame.unionByName, files)
    if not content:
        return out

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = stores.opened(folder)
        for b in batches:
            for path, length in zip(b["path"], b["length"], strict=True):
                with store.open_input_stream(f"{root.rstrip('/')}/{path}") as f:
                    yield pd.DataFrame({"path": [path], "length": [length], "content": [bytes(f.read())]})

    return out.repartition("path").mapInPandas(opened, "path string, length long, content binary")
