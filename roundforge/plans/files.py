"""Queries over sources and sinks: files made of the test tables are written, read back by the operators, and compared with SQL over the tables.

The files lie in a new folder below the shared one. ``saved`` cuts a result loose from its files where those don't outlast the query."""

from __future__ import annotations

import json
import os
import struct
import threading
import uuid
import zlib
from functools import partial
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundforge.functions import hashing, text
from roundforge.operators import assets, build, curation, game, quality, rerank, screening, sharding, workspace
from roundforge.operators.signature import signatures
from roundforge.plans import sqltext as q
from roundforge.plans import views
from roundforge.plans.catalogue import _BANK, _BITS, _SCORED, _SCREENED, _SHARDED, SEED, _scored, query, r6
from roundforge.plans.views import table, with_views
from roundforge.session import checkpointed, placed, shared_folder
from roundforge.sinks import writers
from roundforge.sources import images, jsonl, packs, stores


def folder(spark: SparkSession, name: str) -> str:
    """The URI of a new folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/files/{name}-{uuid.uuid4().hex}"


saved = checkpointed


class Served:
    """A folder's files over HTTP while the block runs, ranges too; names that end in .gone are missing, .jpg are images. breaks: bytes after which a
    connection is closed, whatever it still owes."""

    def __init__(self, root: str, breaks: int | None = None) -> None:
        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:  # noqa: N802
                store, base = stores.opened(root)
                path = f"{base}/{self.path.lstrip('/')}"
                size = stores.size(store, path)
                if size is None:
                    self.send_error(404)
                    return
                start = int((self.headers.get("Range") or "bytes=0-")[6:].split("-")[0])
                if start >= size > 0:
                    self.send_error(416)
                    return
                self.send_response(206 if self.headers.get("Range") else 200)
                self.send_header("Content-Type", "image/jpeg" if path.endswith(".jpg") else "text/plain")
                self.send_header("Content-Length", str(size - start))
                self.send_header("Accept-Ranges", "bytes")
                self.end_headers()
                if self.command == "GET":
                    with store.open_input_file(path) as f:
                        self.wfile.write(f.read_at(min(size - start, size if breaks is None else breaks), start))

            do_HEAD = do_GET  # noqa: N815

            def log_message(self, *args) -> None:
                return

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)

    def __enter__(self) -> str:
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return f"http://127.0.0.1:{self.server.server_port}"

    def __exit__(self, *args) -> None:
        self.server.shutdown()


# --- JSON lines --------------------------------------------------------------------------------


def _review_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review for each part as a JSON object, images in all their shapes, and lines that hold none: blank ones, lists, numbers."""
    p = F.col("p_partkey")
    s = p.cast("string")
    image = (
        F.when(p % 4 == 0, F.concat(F.lit('[{"small_image_url":"http://i/s'), s, F.lit('.jpg","large_image_url":"ftp://no"},{"large_image_url":"https://i/l'), s, F.lit('.jpg"}]')))
        .when(p % 4 == 1, F.concat(F.lit('{"large_image_url":[null,"https://i/d'), s, F.lit('.jpg"]}')))
        .when(p % 4 == 2, "[]")
        .otherwise(F.concat(F.lit('{"medium_image_url":["https://i/m'), s, F.lit('.jpg"],"large_image_url":["HTTP://i/no.jpg"]}')))
    )
    votes = F.when(p % 3 == 0, '"3"').otherwise((p % 7).cast("string"))
    line = F.concat(F.lit('{"images":'), image, F.lit(',"parent_asin":"P'), s, F.lit('","rating":'), (1 + p % 5).cast("string"), F.lit(',"title":"'), F.replace("p_name", F.lit(" "), F.lit("  ")), F.lit('","text":" '), F.col("p_type"), F.lit(' ","verified_purchase":'), (p % 2 == 0).cast("string"), F.lit(',"helpful_vote":'), votes, F.lit(',"timestamp":'), s, F.lit("}"))
    other = F.when(p % 50 == 0, "").when(p % 50 == 1, "[1, 2]").when(p % 50 == 2, "3")
    return table(spark, sf_dir, "part").select(F.explode(F.array_compact(F.array(line, other))).alias("value"))


_REVIEW_SQL = """SELECT 'P' || p_partkey::VARCHAR AS parent_asin, CASE p_partkey % 4 WHEN 0 THEN 'http://i/s' || p_partkey || '.jpg' WHEN 1 THEN 'https://i/d' || p_partkey || '.jpg' WHEN 3 THEN 'https://i/m' || p_partkey || '.jpg' END AS review_image,
 (1 + p_partkey % 5)::DOUBLE AS rating, p_name AS review_title, p_type AS review_text, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 7 END::BIGINT AS helpful_vote, p_partkey % 2 = 0 AS verified_purchase, p_partkey::BIGINT AS "timestamp" FROM part"""
_REVIEW_COLUMNS = ["parent_asin", "review_image", "rating", "review_title", "review_text", "helpful_vote", "verified_purchase", "timestamp"]


@query(_REVIEW_SQL)
def q_read_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-01, SRC-04, PRJ-01, PRJ-02: reviews from a local file of JSON lines."""
    at = folder(spark, "reviews")
    _review_lines(spark, sf_dir).write.text(at)
    return jsonl.reviews(jsonl.decode(jsonl.read_lines(spark, at))).select(*_REVIEW_COLUMNS)


@query(_REVIEW_SQL)
def q_read_http(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-03: the same over HTTP, gzipped. One file, as one address is one stream."""
    at = folder(spark, "http")
    _review_lines(spark, sf_dir).coalesce(1).write.text(at, compression="gzip")
    name = next(x for x in stores.names(at) if x.endswith(".gz"))
    with Served(at) as base:
        return saved(jsonl.reviews(jsonl.decode(jsonl.read_lines(spark, f"{base}/{name}"))).select(*_REVIEW_COLUMNS))


@query(_REVIEW_SQL)
def q_read_http_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-03: the same, not gzipped: one file is read by many tasks, a range each, from a server that closes each connection too soon."""
    at = folder(spark, "http")
    _review_lines(spark, sf_dir).coalesce(1).write.text(at)
    name = next(x for x in stores.names(at) if x.endswith(".txt"))
    with Served(at, breaks=100_000) as base:
        return saved(jsonl.reviews(jsonl.decode(jsonl.read_lines(spark, f"{base}/{name}", 250_000))).select(*_REVIEW_COLUMNS))


@query("""SELECT 'P' || p_partkey::VARCHAR AS parent_asin, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS category, p_type || '|' || p_brand AS category_path, p_brand AS leaf_category,
 CASE p_partkey % 3 WHEN 0 THEN 1299.5 WHEN 1 THEN p_retailprice END::DOUBLE AS price, CASE p_partkey % 3 WHEN 0 THEN 'https://x/m' WHEN 1 THEN 'https://x/q' ELSE 'https://x/t' END || p_partkey AS product_image, p_brand AS store FROM part""")
def q_read_jsonl_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-02, PRJ-03, PRJ-07: products from gzipped JSON lines. Gzipped files can't be split, so rows are dealt out anew."""
    p = F.col("p_partkey")
    s = p.cast("string")
    image = (
        F.when(p % 3 == 0, F.concat(F.lit('[{"variant":"PT01","large":"https://x/a"},{"variant":"MAIN","large":"https://x/m'), s, F.lit('"}]')))
        .when(p % 3 == 1, F.concat(F.lit('{"variant":["PT01","MAIN"],"hi_res":[null,null],"large":["https://x/p","https://x/q'), s, F.lit('"]}')))
        .otherwise(F.concat(F.lit('[{"variant":"PT01","thumb":"https://x/t'), s, F.lit('"}]')))
    )
    price = F.when(p % 3 == 0, '"$1,299.50"').when(p % 3 == 1, F.col("p_retailprice").cast("string")).otherwise('"None"')
    main = F.when(p % 2 == 0, F.concat(F.lit('" '), F.col("p_brand"), F.lit(' "'))).otherwise("null")
    line = F.concat(F.lit('{"parent_asin":"P'), s, F.lit('","title":"'), F.col("p_name"), F.lit('","main_category":'), main, F.lit(',"categories":["'), F.col("p_type"), F.lit('","'), F.lower("p_type"), F.lit('",5,"'), F.col("p_brand"), F.lit('"],"price":'), price, F.lit(',"store":"'), F.col("p_brand"), F.lit('","images":'), image, F.lit("}"))
    at = folder(spark, "products")
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(at, compression="gzip")
    rows = jsonl.products(jsonl.decode(jsonl.read_lines(spark, at)).repartition("pos"))
    return rows.select("parent_asin", "title", "category", F.array_join("category_path", "|").alias("category_path"), "leaf_category", "price", "product_image", "store")


@query("SELECT part FROM (SELECT p_partkey::BIGINT AS part, row_number() OVER o - 1 + coalesce(sum(CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM part WINDOW o AS (ORDER BY p_partkey)) WHERE line < 120")
def q_scan_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-05: the first 120 physical lines, the blank ones after each fifth included; the cap is the feature."""
    p = F.col("p_partkey")
    at = folder(spark, "capped")
    lines = table(spark, sf_dir, "part").select(p, F.posexplode(F.array_compact(F.array(F.concat(F.lit('{"part":'), p.cast("string"), F.lit("}")), F.when(p % 5 == 0, "")))).alias("k", "value"))
    lines.coalesce(1).sortWithinPartitions("p_partkey", "k").select("value").write.text(at)
    rows = jsonl.decode(jsonl.capped(jsonl.read_lines(spark, at), 120))
    return rows.select(F.try_variant_get("doc", "$.part", "long").alias("part"))


@query("SELECT r_name AS category, r_name || CASE WHEN r_regionkey % 2 = 0 THEN '.jsonl.gz' ELSE '.jsonl' END AS reviews, 'meta_' || r_name || '.jsonl' AS meta, 'https://h/r/' || r_name || '.jsonl' AS remote_reviews, 'https://h/m/meta_' || r_name || '.jsonl' AS remote_meta FROM region")
def q_category_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-06: a category's files, gzipped first, and its addresses."""
    at = folder(spark, "raw")
    out = []
    for r in table(spark, sf_dir, "region").collect():  # five rows
        name = r["r_name"]
        for suffix in ["meta_{}.jsonl", "{}.jsonl", *["{}.jsonl.gz"] * (r["r_regionkey"] % 2 == 0)]:
            writers.replace_file(f"{at}/{suffix.format(name)}", b"")
        local, remote = jsonl.category_sources(name, at), jsonl.category_sources(name, None, "https://h/r", "https://h/m")
        out.append((name, *[x.rpartition('/')[2] for x in local], *remote))
    return spark.createDataFrame(out, "category string, reviews string, meta string, remote_reviews string, remote_meta string")


@query(with_views("rounds", "SELECT source_category, id FROM rounds WHERE source_category <> ''"))
def q_union_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-01: the categories' rounds, one after the other."""
    r = views.rounds(spark, sf_dir).select("source_category", "id").filter("source_category != ''")
    names = [x["source_category"] for x in r.select("source_category").distinct().orderBy("source_category").collect()]  # a bounded vocabulary
    return build.union_all([r.filter(F.col("source_category") == n) for n in names])


# --- packs and shards --------------------------------------------------------------------------


def _pack_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.rounds(spark, sf_dir)
    return r.select("pos", "id", "source_category", "review_image", "rating", F.struct("title", "category", "category_path", "leaf_category", "price", "parent_asin").alias("product"), "choices")


_PACK_SQL = with_views("rounds", "SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, id, title, array_to_string(choices, '|') AS choices, rating FROM rounds")


def _opened(rounds: DataFrame) -> DataFrame:
    return rounds.select("pos", "id", "product.title", F.array_join("choices", "|").alias("choices"), "rating")


@query(_PACK_SQL)
def q_inline_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-07, SNK-01: a pack written as one JSON file and read back."""
    at = folder(spark, "pack")
    writers.write_pack(_pack_rounds(spark, sf_dir), {"version": 2, "name": "pack"}, f"{at}/rounds.json")
    return _opened(packs.read_inline(spark, f"{at}/rounds.json"))


@query(_PACK_SQL)
def q_open_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10: without a manifest and a pack, the demo is opened."""
    at = folder(spark, "demo")
    writers.write_pack(_pack_rounds(spark, sf_dir), {}, f"{at}/demo.json")
    return _opened(packs.open_pack(spark, at))


def _write_sharded(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame, str]:
    """A sharded pack of the rounds: its manifest's path, what was written, and the signature."""
    at = folder(spark, "sharded")
    r = sharding.assign(views.rounds(spark, sf_dir), 250, 7)
    placed = checkpointed(r.withColumn("json", F.to_json(F.struct("id", F.struct("title").alias("product")))))
    signature = signatures(placed, "id").first()["signature"]
    listed = checkpointed(writers.write_shards(placed, at, {"format": "shard", "dataset_signature": signature}))
    fields = {"format": "pack", "dataset_signature": signature, "shards": listed.withColumn("pos", F.col("id")), "index": placed.select(F.col("place").alias("pos"), "id", "shard")}
    writers.write_json(fields, f"{at}/manifest.json")
    return f"{at}/manifest.json", listed, signature


@query(with_views("rounds", "SELECT id, shard, title FROM shards", _SHARDED))
def q_sharded_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-08: rounds of a sharded pack, read by its manifest."""
    manifest, _, _ = _write_sharded(spark, sf_dir)
    return packs.read_shards(spark, manifest).select("id", "shard", "product.title")


@query(with_views("rounds", "SELECT row_number() OVER (ORDER BY pos DESC) - 1 AS pos, id, shard, title FROM shards WHERE pos % 3 = 0", _SHARDED))
def q_shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-09, JN-13: every third round, last one first, found through an index table that is partitioned by a hash of the id."""
    manifest = packs.read_manifest(spark, _write_sharded(spark, sf_dir)[0])
    table = folder(spark, "index")
    packs.write_index(manifest, table)
    wanted = placed(views.rounds(spark, sf_dir).filter("pos % 3 = 0").select("id", F.col("pos").alias("at")), F.desc("at"), F.col("id")).select(F.col("place").alias("pos"), "id")
    return packs.lookup(spark, manifest, wanted, table).select("pos", "id", "shard", "product.title")


@query(with_views("rounds", f"""SELECT shard AS id, 'shards/rounds-' || shard || '.json' AS path, count(*) AS round_count,
 sha256('{{"dataset_signature":"' || (SELECT printf('%x', {q.fnv("string_agg(id, '|' ORDER BY id)")}) FROM rounds) || '","format":"shard","rounds":[' || string_agg('{{"id":"' || id || '","product":{{"title":"' || title || '"}}}}', ',' ORDER BY place)
 || '],"shard":{{"count":' || (SELECT count(DISTINCT shard) FROM shards) || ',"id":"' || shard || '","index":' || shard::INT || '}}}}') AS sha256 FROM shards GROUP BY shard""", _SHARDED))
def q_canonical_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-02, SCL-29: shards as canonical JSON, told by the digests of their bytes."""
    return _write_sharded(spark, sf_dir)[1]


@query(with_views("rounds", "SELECT 'round_count differs' AS error, min(shard) AS id FROM shards UNION ALL SELECT 'sha256 differs', max(shard) FROM shards UNION ALL SELECT 'missing file', 'zz' UNION ALL SELECT 'signature', printf('%x', " + q.fnv("(SELECT string_agg(id, '|' ORDER BY id) FROM rounds)") + ")", _SHARDED))
def q_shard_files_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18, VAL-02: listed shards against what their files hold, with planted faults; the signature is computed anew from the files."""
    manifest, listed, _ = _write_sharded(spark, sf_dir)
    root = manifest.rpartition("/")[0]
    rounds = packs.read_shards(spark, manifest)
    files = spark.read.format("binaryFile").load(f"{root}/shards").select(F.sha2("content", 256).alias("sha256"), F.regexp_extract("path", r"-([0-9]+)\.json$", 1).alias("id"))
    none = F.lit(None).cast("map<string,bigint>").alias("categories")
    actual = rounds.groupBy(F.col("shard").alias("id")).agg(F.count("*").alias("round_count")).join(files, "id").select("id", "round_count", "sha256", none)
    ends = listed.agg(F.min("id").alias("first"), F.max("id").alias("last"))
    faulty = listed.join(F.broadcast(ends)).select("id", "path", (F.col("round_count") + (F.col("id") == F.col("first")).cast("long")).alias("round_count"), F.when(F.col("id") == F.col("last"), "0").otherwise(F.col("sha256")).alias("sha256"), none)
    lost = spark.createDataFrame([("zz", "shards/rounds-zz.json", 1, "0", None)], faulty.schema)
    signature = signatures(rounds, "id").select(F.lit("signature").alias("error"), F.col("signature").alias("id"))
    return sharding.shard_errors(faulty.union(lost), actual).union(signature)


@query("SELECT 'a round has no id' AS error UNION ALL SELECT 'ids are not unique'")
def q_shard_preconditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-03: rounds with a blank id, and rounds that repeat."""
    r = views.rounds(spark, sf_dir).select("id", "pos")
    blank = r.withColumn("id", F.when(F.col("pos") % 100 == 0, "").otherwise(F.col("id")))
    return sharding.check_rounds(blank, 250).union(sharding.check_rounds(r.union(r.filter("pos = 7")), 250)).union(sharding.check_rounds(r, 250))


# --- assets ------------------------------------------------------------------------------------


def _write_images(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    """A file for each supplier, every tenth in a folder below: path (relative) and length."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")

    def run(batches):
        for b in batches:
            out = []
            for k, name in zip(b["s_suppkey"], b["s_name"], strict=True):
                path = f"deep/{k}.jpg" if k % 10 == 0 else f"{k}.jpg"
                writers.replace_file(f"{at}/{path}", name.encode())
                out.append((path, len(name)))
            yield pd.DataFrame(out, columns=["path", "length"])

    return checkpointed(rows.mapInPandas(run, "path string, length long"))


@query("SELECT s_suppkey::VARCHAR || '.jpg' AS url, substr(sha256(s_name), 1, 24) || '.jpg' AS name, sha256(s_name) AS sha256, length(s_name)::BIGINT AS bytes_first, 0::BIGINT AS bytes_again, 'image/jpeg' AS content_type FROM supplier WHERE s_suppkey % 10 <> 0 UNION ALL SELECT '../' || s_suppkey || '.jpg', NULL, NULL, NULL, NULL, 'outside of the root' FROM supplier WHERE s_suppkey % 10 = 0")
def q_image_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12, SNK-03: files fetched below a root, stored under their digests, and stored again; paths that leave the root are errors."""
    at = folder(spark, "images")
    _write_images(spark, sf_dir, at)
    k = F.col("s_suppkey").cast("string")
    rounds = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 10 == 0, F.concat(F.lit("../"), k, F.lit(".jpg"))).otherwise(F.concat(k, F.lit(".jpg"))).alias("review_image"))
    got = checkpointed(images.fetch(rounds, at))
    found = got.filter("error is null").withColumn("extension", assets.extension(F.col("content"), F.col("content_type"), F.col("url")))
    first = checkpointed(writers.write_assets(found, f"{at}-cache"))
    again = checkpointed(writers.write_assets(found, f"{at}-cache"))
    both = first.withColumnRenamed("bytes_written", "bytes_first").join(again.select("url", F.col("bytes_written").alias("bytes_again")), "url")
    out = got.select("url", F.coalesce("error", "content_type").alias("content_type")).join(both, "url", "left")
    return out.select("url", "name", "sha256", "bytes_first", "bytes_again", "content_type")


_CACHED = """f AS (SELECT s_suppkey AS pos, 'i' || s_suppkey AS id, s_suppkey % 10 = 0 AS gone, 'picture of nation ' || s_nationkey AS content, s_suppkey || '.jpg' AS url FROM supplier),
k AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY pos) AS n FROM f WHERE NOT gone)"""


@query(f"WITH {_CACHED} SELECT id, url AS original, 'pics/' || substr(sha256(content), 1, 24) || '.jpg' AS image, sha256(content) AS sha256 FROM k WHERE n = 1 UNION ALL SELECT id, NULL, url, NULL FROM f WHERE gone")
def q_cache_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12, SNK-03, JN-06, WIN-08: rounds whose images are cached, equal ones once, with those that failed."""
    return _cached(spark, sf_dir)[0].select("id", F.col("review_image_original").alias("original"), F.col("review_image").alias("image"), F.col("review_image_sha256").alias("sha256"))


@query(f"WITH {_CACHED} SELECT (SELECT count(*) FROM f) AS source_images, (SELECT count(*) FROM f) AS rounds_before, (SELECT count(*) FROM k WHERE n = 1) + (SELECT count(*) FROM f WHERE gone) AS rounds_after, (SELECT count(*) FROM f WHERE gone) AS failed, (SELECT count(*) FROM k WHERE n > 1) AS exact_duplicates, 0::BIGINT AS perceptual_duplicates, (SELECT count(*) FROM k WHERE n = 1) AS unique_files")
def q_cache_images_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12: what caching did, in counts."""
    return _cached(spark, sf_dir)[1].drop("bytes_written")  # equal images that are stored at the same time count twice


def _cached(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    at = folder(spark, "originals")
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("picture of nation "), F.col("s_nationkey").cast("string")).alias("content")).filter(k % 10 != 0)

    def run(batches):
        for b in batches:
            for key, content in zip(b["s_suppkey"], b["content"], strict=True):
                writers.replace_file(f"{at}/{key}.jpg", content.encode())
            yield pd.DataFrame({"n": [len(b)]})

    rows.mapInPandas(run, "n long").collect()
    rounds = table(spark, sf_dir, "supplier").select(k.cast("long").alias("pos"), F.concat(F.lit("i"), k.cast("string")).alias("id"), F.concat(k.cast("string"), F.lit(".jpg")).alias("review_image"))
    return assets.cache_rounds(rounds, at, f"{at}-cache", "pics", keep_failed=True)


@query("SELECT CASE WHEN s_suppkey % 10 = 0 THEN 'deep/' ELSE '' END || s_suppkey || '.jpg' AS path, length(s_name)::BIGINT AS length FROM supplier")
def q_cache_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-13: files of a cache and of its folders, without links."""
    at = folder(spark, "cache")
    _write_images(spark, sf_dir, at)
    if at.startswith("file://"):
        os.symlink("/etc/hostname", f"{at.removeprefix('file://')}/link.jpg")
    return packs.read_files(spark, at).select("path", "length")


@query("SELECT 'told' AS run, count(*) AS files, sum(length(s_name))::BIGINT AS bytes, (SELECT count(*) FROM supplier) AS files_after FROM supplier WHERE s_suppkey % 10 = 0 UNION ALL SELECT 'deleted', count(*), sum(length(s_name))::BIGINT, (SELECT count(*) FROM supplier WHERE s_suppkey % 10 <> 0) FROM supplier WHERE s_suppkey % 10 = 0")
def q_prune_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-09: orphans told of, then deleted."""
    at = folder(spark, "prune")
    files = _write_images(spark, sf_dir, at)
    orphans = assets.reconcile(files.filter("path not like 'deep/%'"), files).filter("state = 'orphaned'")
    out = []
    for run in ("told", "deleted"):
        done = writers.prune(orphans, at, delete=run == "deleted")
        out.append((run, done["files"], done["bytes"], packs.read_files(spark, at).count()))
    return spark.createDataFrame(out, "run string, files long, bytes long, files_after long")


@query("SELECT s_suppkey::BIGINT AS id, CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 1 THEN 'image_not_local:low:image' WHEN s_suppkey % 4 = 2 THEN 'image_missing:high:image' ELSE '' END AS flags FROM supplier")
def q_image_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-14: images that are no files, and files that are missing."""
    k = F.col("s_suppkey")
    path = F.when(k % 4 != 0, F.concat(F.lit("assets/"), k.cast("string")))
    flags = screening.image_state_flags(path, F.when(k % 4 == 2, False).when(k % 4 == 3, True))
    told = F.array_join(F.transform(flags, lambda f: F.concat_ws(":", f["name"], f["severity"], f["source"])), ",")
    return table(spark, sf_dir, "supplier").select(k.cast("long").alias("id"), F.when(path.isNotNull(), told).alias("flags"))


def _png(width: int, height: int, rows: bytes = b"", more: bytes = b"") -> bytes:
    """A PNG file of grey values; more: chunks before those."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + (chunk(b"eXIf", more) if more else b"") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def _jpeg(width: int, height: int, exif: bytes = b"") -> bytes:
    """The headers of a JPEG file."""
    part = lambda mark, body: struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body
    return b"\xff\xd8" + part(0xE0, b"JFIF\0" + bytes(9)) + (part(0xE1, b"Exif\0\0" + exif) if exif else b"") + part(0xC4, bytes(20)) + part(0xC0, struct.pack(">BHHB", 8, height, width, 1) + bytes(3)) + part(0xDA, bytes(6)) + b"\xff\xd9"


def _exif(order: str, artist: bool, comment: bool, gps: bool) -> bytes:
    """Tables of tags: the artist in the main one, a comment in that of EXIF, a latitude's letter in that of GPS."""
    entry = lambda tag, kind, count, value: struct.pack(order + "HHI", tag, kind, count) + value
    table = lambda entries: struct.pack(order + "H", len(entries)) + b"".join(entries) + bytes(4)
    number = lambda x: struct.pack(order + "I", x)
    size = 8 + 2 + 12 * (artist + comment + gps) + 4
    main, rest = [], b""
    if artist:
        main.append(entry(315, 2, 8, number(size + len(rest))))
        rest += b"Ann Lee\0"
    if comment:
        main.append(entry(0x8769, 4, 1, number(size + len(rest))))
        rest += table([entry(37510, 7, 4, b"note")])
    if gps:
        main.append(entry(0x8825, 4, 1, number(size + len(rest))))
        rest += table([entry(1, 2, 2, b"N\0\0\0")])
    return (b"II*\0" if order == "<" else b"MM\0*") + number(8) + table(main) + rest


@query("""SELECT p_partkey::BIGINT AS id, CASE WHEN p_partkey % 11 = 0 THEN 'image_unreadable:medium:image' ELSE concat_ws(',', CASE WHEN p_partkey % 5 = 0 THEN 'exif_gps_location:high:image_metadata' END, CASE WHEN p_partkey % 3 = 0 THEN 'exif_artist:medium:image_metadata' END,
 CASE WHEN p_partkey % 4 = 0 THEN 'exif_user_comment:medium:image_metadata' END, CASE WHEN least(w, h) < 160 THEN 'very_small_image:low:image' END, CASE WHEN greatest(w, h) >= 5 * least(w, h) THEN 'extreme_aspect_ratio:low:image' END) END AS flags
 FROM (SELECT p_partkey, 40 * (p_partkey % 7 + 1) AS w, 40 * (p_partkey % 23 + 1) AS h FROM part)""")
def q_image_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-12: flags of pictures' metadata and sizes; a picture is drawn for each part, JPEG or PNG, its tags in either byte order, some of them broken."""
    k = F.col("p_partkey").cast("long")

    def run(batches):
        for b in batches:
            out = []
            for i in b["k"]:
                exif = _exif("<>"[i % 13 % 2], i % 3 == 0, i % 4 == 0, i % 5 == 0) if not (i % 3 and i % 4 and i % 5) else b""
                w, h = 40 * (i % 7 + 1), 40 * (i % 23 + 1)
                data = _png(w, h, more=exif) if i % 2 else _jpeg(w, h, exif)
                out.append((str(i), data if i % 11 else data[3:]))
            yield pd.DataFrame(out, columns=["path", "content"])

    drawn = table(spark, sf_dir, "part").select(k.alias("k")).mapInPandas(run, "path string, content binary")
    told = F.array_join(F.transform("flags", lambda f: F.concat_ws(":", f["name"], f["severity"], f["source"])), ",")
    return screening.image_flags(drawn).select(F.col("path").cast("long").alias("id"), told.alias("flags"))


@query(f"WITH {_BITS} SELECT id, format('{{:016x}}', h::UBIGINT) AS dhash FROM h")
def q_dhash_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-20: difference hashes of pictures, one drawn for each vector, whose signs are its bits."""

    def run(batches):
        for b in batches:
            out = []
            for i, v in zip(b["vec_id"], b["embedding"], strict=True):
                steps = (np.asarray(v)[:64].reshape(8, 8) > 0).astype(int)
                grey = np.concatenate([np.full((8, 1), 200), 200 - np.cumsum(steps, axis=1)], axis=1).astype(np.uint8)
                lines = b""
                for y, line in enumerate(grey):  # rows as they are, as differences from the left, and from above
                    before = [np.zeros(9, np.uint8), np.concatenate([[0], line[:-1]]).astype(np.uint8), grey[y - 1] if y else np.zeros(9, np.uint8)][y % 3]
                    lines += bytes([y % 3]) + (line - before).astype(np.uint8).tobytes()
                out.append((str(i), _png(9, 8, lines)))
            yield pd.DataFrame(out, columns=["path", "content"])

    drawn = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "path string, content binary")
    return assets.dhash(drawn).select(F.col("path").cast("long").alias("id"), hashing.dhash_hex(F.col("dhash")).alias("dhash"))


def _toy_model():
    """A classifier for tests: its score is the last digit of the file's number."""
    return lambda content: [{"label": "NSFW_content", "score": (int(bytes(content)[-1:] or b"0") % 10 + 0.5) / 10}, {"label": "safe", "score": 0.99}]


@query("SELECT s_suppkey::BIGINT AS id, CASE WHEN s_suppkey % 10 = 9 THEN 'high' WHEN s_suppkey % 10 IN (6, 7, 8) THEN 'medium' END AS severity FROM supplier")
def q_model_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-16, SCL-17: a model loaded once by each worker, and the flags of its scores."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.cast("string").alias("path"), k.cast("string").cast("binary").alias("content"))
    scores = screening.classify(rows.union(rows), _toy_model)
    flags = screening.score_flags(F.col("scores"), ["nsfw content"])
    return scores.select(F.col("path").cast("long").alias("id"), F.get(flags, F.lit(0))["severity"].alias("severity"))


@query("SELECT n_name AS name, n_nationkey % 3 = 0 AS live FROM nation")
def q_live_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-03: images that an address serves; texts and missing files aren't."""
    at = folder(spark, "live")
    rows = table(spark, sf_dir, "nation").collect()  # 25 rows
    for r in rows:
        if r["n_nationkey"] % 3 != 2:
            writers.replace_file(f"{at}/{r['n_nationkey']}.{'jpg' if r['n_nationkey'] % 3 == 0 else 'txt'}", b"data")
    suffix = {0: "jpg", 1: "txt", 2: "jpg"}
    with Served(at) as base:
        rounds = spark.createDataFrame([(r["n_name"], f"{base}/{r['n_nationkey']}.{suffix[r['n_nationkey'] % 3]}") for r in rows], "name string, review_image string")
        live = saved(images.live(rounds).select("name"))
    return rounds.select("name").join(live.withColumn("live", F.lit(True)), "name", "left").select("name", F.coalesce("live", F.lit(False)).alias("live"))


class _FileClient:
    """Takes uploads like an object store, into files that say what came."""

    def __init__(self, at: str) -> None:
        self.at = at

    def upload_file(self, path: str, bucket: str, key: str, ExtraArgs: dict) -> None:  # noqa: N803
        told = {"key": key, "bucket": bucket, "size": stores.size(*stores.opened(path)), "content_type": ExtraArgs["ContentType"], "cache_control": ExtraArgs["CacheControl"]}
        writers.replace_file(f"{self.at}/{uuid.uuid4().hex}.json", json.dumps(told).encode())


@query("SELECT 'img/' || CASE WHEN s_suppkey % 10 = 0 THEN 'deep/' ELSE '' END || s_suppkey || '.jpg' AS key, 'bucket' AS bucket, length(s_name)::BIGINT AS size, 'image/jpeg' AS content_type, 'public, max-age=31536000, immutable' AS cache_control FROM supplier")
def q_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-06, SRC-14: files that a scan finds, uploaded under their keys, to be cached for ever."""
    at = folder(spark, "publish")
    _write_images(spark, sf_dir, at)
    files = packs.read_files(spark, at).withColumn("path", F.concat(F.lit(at + "/"), "path"))
    log = folder(spark, "uploaded")
    writers.upload(assets.upload_plan(files, at, "img"), partial(_FileClient, log), "bucket")
    return spark.read.schema("key string, bucket string, size long, content_type string, cache_control string").json(log)


@query("SELECT 'assets/reviews/' AS path_prefix, 'https://cdn/x/' AS base_url, count(*) AS rounds FROM part")
def q_patch_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-07: a manifest that is told where its images are."""
    at = folder(spark, "manifest") + "/manifest.json"
    writers.replace_file(at, writers.canonical_json({"round_count": table(spark, sf_dir, "part").count()}))
    writers.patch_manifest(at, "assets/reviews", "https://cdn/x")
    got = spark.read.schema("round_count long, asset_delivery struct<review_images:struct<path_prefix:string,base_url:string>>").json(at)
    return got.select("asset_delivery.review_images.path_prefix", "asset_delivery.review_images.base_url", F.col("round_count").alias("rounds"))


@query(with_views("rounds", "SELECT flag, n, false AS truncated FROM (SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM scored) GROUP BY flag)", _SCORED))
def q_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-04: a report as JSON."""
    at = folder(spark, "report") + "/report.json"
    writers.write_report(quality.flag_counts(_scored(spark, sf_dir)), at, sample=100)
    got = spark.read.schema("rows array<struct<flag:string,n:long>>, truncated boolean").json(at, multiLine=True)
    return got.select(F.explode("rows").alias("r"), "truncated").select("r.flag", "r.n", "truncated")


@query(with_views("rounds", "SELECT 'Flags' || chr(10) || '=====' || chr(10) || chr(10) || 'flag' || chr(10) || string_agg('  ' || flag || ': ' || n, chr(10) ORDER BY n DESC, flag) AS report FROM (SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM scored) GROUP BY flag)", _SCORED))
def q_audit_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-05: an audit as text."""
    rows = quality.audit(_scored(spark, sf_dir)).filter("facet = 'flag'").collect()  # a bounded vocabulary
    return spark.createDataFrame([(quality.render(rows, "Flags"),)], "report string")


# --- curation, workspaces ----------------------------------------------------------------------


@query(with_views("rounds", "SELECT id, CASE WHEN pos % 5 = 0 THEN 'keep' ELSE 'reject' END AS decision FROM rounds WHERE pos % 5 = 0 OR pos % 7 = 0"))
def q_decisions_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-16, SNK-10: a decisions file of version 1, written and read."""
    at = folder(spark, "decisions") + "/decisions.json"
    r = views.rounds(spark, sf_dir)
    own = r.filter("pos % 5 = 0 or pos % 7 = 0").select("id", F.when(F.col("pos") % 5 == 0, "keep").otherwise("reject").alias("decision"))
    writers.write_decisions(own, "s", at)
    return packs.read_decisions(spark, at, "s")


@query(with_views("rounds", """SELECT 2 AS version, 'sig' AS dataset_signature, (SELECT string_agg(id || '=keep', ',' ORDER BY id) FROM rounds WHERE pos % 5 = 0) AS decisions,
 (SELECT string_agg(id || '=note ' || pos || '#' || leaf_category, ',' ORDER BY id) FROM rounds WHERE pos % 9 = 0) AS annotations, (SELECT string_agg(n_name, ',' ORDER BY lower(n_name)) FROM nation) AS presets"""))
def q_workspace_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-10: a whole workspace, version 2."""
    r = views.rounds(spark, sf_dir)
    decisions = r.filter("pos % 5 = 0").select("id", F.lit("keep").alias("decision"))
    notes = r.filter("pos % 9 = 0").select("id", F.concat(F.lit("note "), F.col("pos").cast("string")).alias("note"), F.array("leaf_category").alias("tags"))
    presets = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("all").alias("category"))
    e = curation.export_workspace(decisions, notes, presets, "sig")
    pairs = lambda c, f: F.array_join(F.transform(F.map_entries(c), f), ",")
    return e.select("version", "dataset_signature", pairs("decisions", lambda x: F.concat_ws("=", x["key"], x["value"])).alias("decisions"), pairs("annotations", lambda x: F.concat(x["key"], F.lit("="), x["value"]["note"], F.lit("#"), F.array_join(x["value"]["tags"], "+"))).alias("annotations"), F.array_join(F.transform("queue_presets", lambda p: p["name"]), ",").alias("presets"))


_ALL = """w AS (SELECT string_agg(n_name || '=keep', ',' ORDER BY n_name) FILTER (n_nationkey % 2 = 0) AS even, string_agg(n_name || CASE WHEN n_nationkey % 2 = 0 THEN '=keep' ELSE '=reject' END, ',' ORDER BY n_name) AS mixed,
 string_agg(n_name || '=keep', ',' ORDER BY n_name) AS kept, string_agg(n_name || '=keep', ',' ORDER BY n_name) FILTER (n_nationkey % 2 = 1) AS odd FROM nation)"""


@query(f"""WITH {_ALL} SELECT step, ok, changed, revision, CASE decisions WHEN 'even' THEN even WHEN 'both' THEN mixed WHEN 'kept' THEN kept ELSE odd END AS decisions FROM w, (VALUES ('first', true, true, 1, 'even'), ('same again', true, false, 1, 'even'), ('older base, other keys', true, true, 2, 'both'),
 ('conflict', false, NULL, 2, 'both'), ('conflict, local side', true, true, 3, 'kept'), ('deletion', true, true, 4, 'odd')) AS t(step, ok, changed, revision, decisions)""")
def q_workspace_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-02, SNK-08, SRC-15: saves of a workspace of all nations upon an older or the newest revision."""
    store = workspace.Store(spark, folder(spark, "revisions"))
    rows = table(spark, sf_dir, "nation").collect()  # 25 rows
    even, odd = ([r["n_name"] for r in rows if r["n_nationkey"] % 2 == k] for k in (0, 1))
    all_of = lambda names, d: dict.fromkeys(names, d)
    every = all_of(even + odd, "keep")
    steps = [("first", 0, all_of(even, "keep"), "reject"), ("same again", 1, all_of(even, "keep"), "reject"), ("older base, other keys", 0, all_of(odd, "reject"), "reject"), ("conflict", 1, every, "reject"), ("conflict, local side", 1, every, "prefer_local"), ("deletion", 3, all_of(odd, "keep"), "reject")]
    out = []
    for name, base, decisions, strategy in steps:
        got = store.save("sig", base, {"decisions": decisions}, "me", strategy)
        now = ",".join(f"{k}={v}" for k, v in sorted(got["workspace"].get("decisions", {}).items()))
        out.append((name, got["ok"], got.get("changed"), int(got["revision"]), now))
    return spark.createDataFrame(out, "step string, ok boolean, changed boolean, revision int, decisions string")


_EDITS = """edits AS (SELECT 'u' || user_id::VARCHAR AS k, event_type, dense_rank() OVER (ORDER BY event_type) AS writer, arg_max(event_id, (ts, event_id)) % 3 AS d FROM events GROUP BY user_id, event_type),
last AS (SELECT k, arg_max(d, writer) AS d, max(writer) AS writer FROM edits GROUP BY k)"""


@query(f"WITH {_EDITS} SELECT k AS key, CASE d WHEN 0 THEN 'keep' WHEN 1 THEN 'reject' ELSE 'later' END AS decision, (SELECT max(writer) FROM edits) AS revision FROM last")
def q_workspace_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-02, SNK-08, SRC-15: all events as edits of one workspace. A writer for each type of event saves the last decision of each user that it saw, all of
    them at once and each upon an empty workspace; of writers that meet, the one that comes later reads what is there and merges, its own side first. They are let
    in by order here, so that the result is one and the same."""
    e = table(spark, sf_dir, "events").groupBy("event_type", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key")).agg(F.max_by(F.col("event_id") % 3, F.struct("ts", "event_id")).alias("d"))
    e = e.withColumn("decision", F.when(F.col("d") == 0, "keep").when(F.col("d") == 1, "reject").otherwise("later"))
    # a workspace is one document that a browser holds: a key for each user
    rows = e.select("event_type", "key", "decision").collect()
    at = folder(spark, "edits")
    for kind in sorted({r["event_type"] for r in rows}):
        workspace.Store(spark, at).save("sig", 0, {"decisions": {r["key"]: r["decision"] for r in rows if r["event_type"] == kind}}, kind, "prefer_local")
    now = workspace.head(workspace.Store(spark, at).read())
    held = F.from_json("workspace_json", "decisions map<string,string>")
    return now.select("revision", F.explode(held["decisions"]).alias("key", "decision")).select("key", "decision", "revision")


@query("SELECT p_partkey::BIGINT AS id, regexp_full_match(CASE WHEN p_partkey % 2 = 0 THEN p_brand WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', '-') ELSE repeat('x', (p_partkey % 140)::INT) END, '[A-Za-z0-9._-]{1,128}') AS valid FROM part")
def q_valid_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-17: texts that can name a dataset."""
    p = F.col("p_partkey")
    x = F.when(p % 2 == 0, F.col("p_brand")).when(p % 3 == 0, F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise(F.repeat(F.lit("x"), (p % 140).cast("int")))
    return table(spark, sf_dir, "part").select(p.cast("long").alias("id"), workspace.valid_signature(x).alias("valid"))


@query("""SELECT user_id, date_key, list_reduce(list_prepend('', list_slice(list_concat(outcomes, ['skipped', 'skipped', 'skipped', 'skipped', 'skipped']), 1, 5)), lambda a, b: a || CASE WHEN a = '' THEN '' ELSE ',' END || b) AS outcomes, score FROM
 (SELECT user_id, strftime(ts, '%Y-%m-%d') AS date_key, arg_max(outcomes, (ts, event_id)) AS outcomes, arg_max(score, (ts, event_id)) AS score FROM
 (SELECT *, CASE event_id % 3 WHEN 0 THEN ['correct'] WHEN 1 THEN ['wrong', 'correct', 'skipped', 'wrong', 'wrong', 'correct'] ELSE ['correct', 'wrong'] END AS outcomes, CASE WHEN event_id % 5 <> 0 THEN event_id % 100 ELSE 0 END AS score FROM events) GROUP BY 1, 2)""")
def q_daily_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-07: results of a day, the last save of each holds; restored with five outcomes. Users stand for datasets."""
    e = F.col("event_id")
    outcomes = F.when(e % 3 == 0, F.array(F.lit("correct"))).when(e % 3 == 1, F.array(*map(F.lit, ["wrong", "correct", "skipped", "wrong", "wrong", "correct"]))).otherwise(F.array(F.lit("correct"), F.lit("wrong")))
    rows = table(spark, sf_dir, "events").select(F.lit("sig").alias("dataset_signature"), F.concat_ws("|", F.col("user_id").cast("string"), text.date_key(F.col("ts"))).alias("date_key"), F.struct("ts", "event_id").alias("pos"), outcomes.alias("outcomes"), F.when(e % 5 != 0, e % 100).alias("score"), F.lit(0).cast("long").alias("correct"), F.lit(0).cast("long").alias("skipped"))
    got = game.restore_daily(game.save_daily(rows.filter("pos.event_id % 2 = 0"), rows.filter("pos.event_id % 2 = 1")), "sig")
    return got.select(F.substring_index("date_key", "|", 1).cast("long").alias("user_id"), F.substring_index("date_key", "|", -1).alias("date_key"), F.array_join("outcomes", ",").alias("outcomes"), "score")


@query("""SELECT o_orderkey::BIGINT AS id, l::BIGINT AS "limit", CASE WHEN l > 0 THEN least(greatest(8 * l, l + 300), 60000) END::BIGINT AS reviews, CASE WHEN l > 0 THEN least(greatest(6 * l, 3000), 30000) END::BIGINT AS pool, CASE WHEN l > 0 THEN (l + 6) // 7 END::BIGINT AS per_category,
 CASE WHEN l > 0 THEN greatest(l + 20, (135 * l + 99) // 100) END::BIGINT AS oversample, CASE WHEN l < 1 THEN 'limit must be at least 1' END AS error FROM (SELECT o_orderkey, o_orderkey % 9001 - 3 AS l FROM orders)""")
def q_capacities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-34, VAL-05: sizes that follow from a limit, and limits that can't be; a limit is made of each order."""
    n = (F.col("o_orderkey") % 9001 - 3).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), n.alias("limit"), *[c.alias(k) for k, c in build.capacities(n, 7).items()])


# --- ranks -------------------------------------------------------------------------------------


@query(with_views("products", f"SELECT a.parent_asin, round(3 + 2.0 * least({q.jaccard('a.t', 'b.t')}, 0.45) + 0.35 * (('0x' || substr(sha256('{SEED}|' || a.parent_asin), 1, 8))::BIGINT / 4294967296.0::DOUBLE), 6)::DOUBLE AS rank FROM t a JOIN t b ON b.pos = a.pos + 1", f"t AS (SELECT pos, parent_asin, {q.build_tokens('title')} AS t FROM products)"))
def q_build_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-06: how plausible the next product's title is, with a chance drawn by digest."""
    t = views.products(spark, sf_dir).select("pos", "parent_asin", text.tokens(F.col("title"), text.BUILD_STOP).alias("t"))
    n = t.select((F.col("pos") - 1).alias("pos"), F.col("t").alias("u"))
    rank = build.build_rank(F.lit(3), text.jaccard(F.col("t"), F.col("u")), build.chance(SEED, F.col("parent_asin")))
    return t.join(n, "pos").select("parent_asin", r6(rank).alias("rank"))


_SHORT = f"""rounds1 AS (SELECT * REPLACE (CASE WHEN pos % 100 = 0 THEN 'only ' || pos ELSE source_category END AS source_category, CASE WHEN pos % 100 = 0 THEN [title] ELSE choices END AS choices) FROM rounds),
{_BANK.replace("FROM rounds)", "FROM rounds1)")},
everywhere AS (SELECT lower(trim(raw)) AS key, arg_min(trim(raw), (category, round_pos, place)) AS title FROM offered GROUP BY 1),
titles AS (SELECT key, title, {q.tokens('title')} AS other FROM everywhere),
own AS (SELECT id, lower(trim(title)) AS own_key, {q.tokens('title')} AS own FROM rounds1 WHERE pos % 100 = 0),
pairs AS (SELECT id, t.title, {q.jaccard('own', 'other')} AS j, {q.cosine('own', 'other')} AS c, {q.shared('own', 'other')} AS s FROM own, titles t WHERE key <> own_key),
ranked AS (SELECT id, title, row_number() OVER (PARTITION BY id ORDER BY round(14.0 * j + 4.0 * c + 0.2 * least(s, 4), 6) DESC, title) AS rank FROM pairs WHERE j < 0.62)"""


@query(with_views("rounds", "SELECT id, rank::INT AS rank, title FROM ranked WHERE rank <= 3", _SHORT))
def q_short_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-05: rounds whose category has no other title choose anew among all titles."""
    alone = F.col("pos") % 100 == 0
    r = views.rounds(spark, sf_dir)
    r = r.withColumn("source_category", F.when(alone, F.concat(F.lit("only "), F.col("pos").cast("string"))).otherwise(F.col("source_category"))).withColumn("choices", F.when(alone, F.array("title")).otherwise(F.col("choices")))
    bank = rerank.candidate_bank(r)
    found = rerank.fallback(r, bank, rerank.top_distractors(r, bank))
    return found.join(r.filter(alone).select("id"), "id", "left_semi").select("id", "rank", "title")


@query(with_views("rounds", "SELECT id, 'A game Daily 2026-09-18' || chr(10) || '1/2 · ' || pos || ' pts' || chr(10) || '🟩🟥⬜' || CASE WHEN source_url IS NULL THEN '' ELSE chr(10) || source_url END AS share FROM rounds"))
def q_share_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-20: what a player shares of a day."""
    squares = F.array(F.lit("correct"), F.lit("wrong"), F.lit("skipped"))
    return views.rounds(spark, sf_dir).select("id", text.share_text("A game", F.lit("2026-09-18"), F.lit(1), F.lit(2), F.col("pos"), squares, F.coalesce("source_url", F.lit(""))).alias("share"))


@query(with_views("texts", "SELECT measure, key, n FROM (SELECT 'total' AS measure, CASE WHEN high_risk THEN 'excluded' ELSE 'written' END AS key, count(*) AS n FROM screened GROUP BY 2)", _SCREENED))
def q_screen_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07: rounds of high risk that are left out, and those that are written."""
    return screening.roll_up(screening.screen(views.texts(spark, sf_dir)), excluding=True).filter("measure = 'total' and key in ('excluded', 'written')")
