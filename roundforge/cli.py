"""Command line: python -m roundforge.cli COMMAND ..., over packs in JSON files and raw files in JSON lines."""

from __future__ import annotations

import argparse
import json
import sys
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundforge.functions import hashing, text
from roundforge.operators import assets, build, curation, quality, rerank, screening, sharding, validate
from roundforge.operators.signature import signatures
from roundforge.session import checkpointed, session
from roundforge.sinks import writers
from roundforge.sources import jsonl, packs


def _flat(rounds: DataFrame) -> DataFrame:
    """Rounds with the product's fields beside them."""
    return rounds.withColumns({c: F.col(f"product.{c}") for c in ("title", "category", "source_url")})


def _as_round(rounds: DataFrame) -> DataFrame:
    return rounds.drop("title", "category", "source_url")


def build_pack(spark: SparkSession, a: argparse.Namespace) -> int:
    """All categories in one plan: sample, join, choose distractors, keep one round a parent, rerank, write."""
    build.check_limits(a.limit, a.categories)
    wanted = build.per_category(a.limit, len(a.categories))
    parts, pools = [], []
    for c in a.categories:
        r, m = jsonl.category_sources(c, a.raw)
        own = build.image_reviews(jsonl.reviews(jsonl.decode(jsonl.capped(jsonl.read_lines(spark, r), a.max_reviews))))
        parts.append(build.sample(own, build.review_capacity(build.oversample(wanted)), a.seed, "parent_asin", "review_image", "pos").withColumn("source_category", F.lit(c)))
        pools.append(jsonl.products(jsonl.decode(jsonl.capped(jsonl.read_lines(spark, m), a.max_products))).withColumn("source_category", F.lit(c)))
    reviews, products = build.union_all(parts), build.union_all(pools)
    matched = build.with_products(reviews.drop("pos"), build.wanted_products(products, reviews).drop("source_category"))
    order = hashing.keyed(a.seed, F.col("parent_asin"), F.col("review_image"))
    matched = matched.withColumn("pos", F.conv(F.substring(order, 1, 15), 16, 10).cast("long")).dropDuplicates(["pos"])
    unique = build.greedy_two_key(matched, "review_image", "parent_asin", "pos")
    pool = build.eligible_products(products)
    if {"source_category", "pos"} <= set(pool.columns):  # each category's titles to choose from are a bounded sample
        pool = build.per_group_limit(pool, "source_category", build.pool_capacity(build.oversample(wanted)), [hashing.keyed(a.seed, F.col("parent_asin"), F.col("pos").cast("string")), "pos"])
    found = build.theta_distractors(unique, pool)
    chosen = found.groupBy("parent_asin").agg(F.collect_list("distractor").alias("choices")).filter(F.size("choices") == 3)
    rounds = build.assemble(unique).join(chosen.withColumnRenamed("parent_asin", "p"), F.col("product.parent_asin") == F.col("p")).drop("p")
    rounds = rounds.withColumn("choices", F.concat("choices", F.array("product.title"))).withColumn("pos", F.conv(F.substring(hashing.keyed(a.seed, F.col("id")), 1, 15), 16, 10).cast("long"))
    rounds = build.per_group_limit(rounds, "source_category", wanted, ["pos"]).orderBy("pos").limit(a.limit)
    rounds = checkpointed(rounds)
    flat = _flat(rounds)
    picked = rerank.top_distractors(flat, rerank.candidate_bank(flat))
    rounds = build.shuffled_choices(_as_round(rerank.rewrite_choices(flat, picked)), a.seed)
    writers.write_pack(rounds, {"version": 2, "name": a.name, "seed": a.seed, "categories": a.categories}, a.output)
    return 0


def check(spark: SparkSession, a: argparse.Namespace) -> int:
    errors = validate.pack_errors(packs.read_inline(spark, a.pack)).limit(1000).collect()
    for e in errors:
        print(f"rounds[{e['pos']}]: {e['error']}")
    return int(bool(errors))


def score(spark: SparkSession, a: argparse.Namespace) -> int:
    writers.write_pack(_as_round(quality.analyze(_flat(packs.read_inline(spark, a.pack)))), {"version": 2, "analysis_version": 1}, a.output)
    return 0


def audit(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = quality.audit(quality.analyze(_flat(packs.read_inline(spark, a.pack)))).collect()
    print(quality.render(rows, a.pack))
    if a.output:
        writers.replace_file(a.output, json.dumps([r.asDict() for r in rows], indent=2).encode())
    return 0


def screen(spark: SparkSession, a: argparse.Namespace) -> int:
    screened = screening.screen(packs.read_inline(spark, a.pack))
    for r in screening.roll_up(screened).orderBy("measure", F.desc("n")).collect():
        print(f"{r['measure']} {r['key']}: {r['n']}")
    writers.write_pack(screening.exclude_high(screened) if a.exclude_high else screened, {"version": 2}, a.output)
    return 0


def curate(spark: SparkSession, a: argparse.Namespace) -> int:
    rounds = packs.read_inline(spark, a.pack)
    signature = None if a.any_signature else signatures(rounds, "id").first()["signature"]
    decisions = packs.read_decisions(spark, a.decisions, signature)
    print(curation.summary(rounds, decisions, a.only_kept).first().asDict())
    writers.write_pack(curation.apply(rounds, decisions, a.only_kept), {"version": 2}, a.output)
    return 0


def shard(spark: SparkSession, a: argparse.Namespace) -> int:
    rounds = packs.read_inline(spark, a.pack)
    errors = sharding.check_rounds(rounds, a.size).collect()
    if errors:
        print(*[e["error"] for e in errors], sep="\n")
        return 1
    own = [c for c in rounds.columns if c != "pos"]
    placed = sharding.assign(rounds.withColumn("category", F.col("product.category")), a.size, a.seed).withColumn("json", F.to_json(F.struct(*own)))
    placed = checkpointed(placed)
    signature = signatures(rounds, "id").first()["signature"]
    header = {"version": 2, "format": "roundforge-shard", "seed": a.seed, "dataset_signature": signature}
    listed = writers.write_shards(placed, a.output, header).join(sharding.category_counts(placed, "shard").select(F.col("shard").alias("id"), "categories"), "id")
    manifest = {"version": 1, "format": "roundforge-sharded-pack", "seed": a.seed, "dataset_signature": signature, "shard_size": a.size, "round_count": rounds.count()}
    manifest["shards"] = listed.withColumn("pos", F.col("id"))
    manifest["index"] = sharding.index(placed).join(placed.select("id", F.col("place").alias("pos")), "id")
    writers.write_json(manifest, f"{a.output}/manifest.json")
    return 0


def check_shards(spark: SparkSession, a: argparse.Namespace) -> int:
    manifest = packs.read_manifest(spark, a.manifest)
    listed = manifest.shards
    rounds = packs.read_shards(spark, manifest).withColumn("category", F.col("product.category"))
    files = packs.read_texts(listed.select("id", "path"), manifest.root).select("id", F.sha2("content", 256).alias("sha256"))
    actual = sharding.category_counts(rounds, "shard").withColumnRenamed("shard", "id").join(files, "id")
    own = rounds.select("id", text.round_category(F.col("source_category"), F.col("category")).alias("category"), "shard")
    errors = sharding.shard_errors(listed, actual).union(sharding.index_errors(manifest.index, own, listed)).limit(1000).collect()
    signature = signatures(rounds, "id").first()["signature"]
    found = [f"{e['error']}: {e['id']}" for e in errors] + ["signature differs"] * (signature != manifest.signature)
    print(*found, sep="\n")
    return int(bool(found))


def prune(spark: SparkSession, a: argparse.Namespace) -> int:
    refs = assets.references(*[packs.read_inline(spark, p) for p in a.packs], prefix=a.prefix)
    files = packs.read_files(spark, a.folder).withColumn("path", F.concat(F.lit(a.prefix.strip("/") + "/"), "path"))
    state = assets.reconcile(refs, files).cache()
    for r in assets.totals(state).collect():
        print(f"{r['state']}: {r['files']} files, {r['bytes']} bytes")
    orphans = state.filter("state = 'orphaned'").withColumn("path", F.substr(F.col("path"), F.lit(len(a.prefix.strip("/")) + 2)))
    print(writers.prune(orphans, a.folder, a.delete))
    return 0


def cache_images(spark: SparkSession, a: argparse.Namespace) -> int:
    threshold = None if a.perceptual_threshold is None else int(a.perceptual_threshold)
    rounds, stats = assets.cache_rounds(packs.read_inline(spark, a.pack), a.root, str(Path(a.folder).resolve()), a.prefix, keep_failed=a.keep_failed, keep_exact=a.keep_exact_duplicates, threshold=threshold, max_bytes=a.max_mb * 1_000_000, workers=a.workers)
    told = stats.first().asDict() | {"perceptual_threshold": threshold, "asset_prefix": a.prefix}
    print(told)
    writers.write_pack(rounds, {"version": 2, "image_cache": told}, a.output)
    return 0


def _s3_client(endpoint: str | None):
    import boto3

    return boto3.client("s3", endpoint_url=endpoint)


def upload(spark: SparkSession, a: argparse.Namespace, client=None) -> int:
    """Puts a folder's files into a bucket and then tells the manifest where they are. client: makes one for each task, boto3's by default."""
    root = str(Path(a.folder).resolve())
    plan = checkpointed(assets.upload_plan(packs.read_files(spark, root).withColumn("path", F.concat(F.lit(f"{root}/"), "path")), root, a.key_prefix))
    if plan.isEmpty():
        raise SystemExit("there are no files to upload")
    writers.upload(plan, client or partial(_s3_client, a.endpoint), a.bucket)
    if a.manifest:
        writers.patch_manifest(a.manifest, a.prefix, a.base_url)
    print(plan.agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).first().asDict())
    return 0


def publish(spark: SparkSession, a: argparse.Namespace) -> int:
    plan = assets.upload_plan(packs.read_files(spark, a.folder).withColumn("path", F.concat(F.lit(f"{Path(a.folder).resolve()}/"), "path")), str(Path(a.folder).resolve()), a.prefix)
    print(plan.agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).first().asDict())
    if a.report:
        writers.write_report(plan, a.report, 100)
    return 0


COMMANDS = {
    "build-pack": (build_pack, ["raw", "output", "categories+", "--limit=2000", "--seed=1337", "--name=pack", "--max-reviews=", "--max-products="]),
    "validate": (check, ["pack"]),
    "score": (score, ["pack", "output"]),
    "audit": (audit, ["pack", "--output="]),
    "screen": (screen, ["pack", "output", "--exclude-high"]),
    "apply-curation": (curate, ["pack", "decisions", "output", "--only-kept", "--any-signature"]),
    "shard": (shard, ["pack", "output", "--size=250", "--seed=0"]),
    "validate-shards": (check_shards, ["manifest"]),
    "prune": (prune, ["folder", "packs+", "--prefix=assets/reviews", "--delete"]),
    "cache-images": (cache_images, ["pack", "folder", "output", "--prefix=assets/review-cache", "--root=.", "--workers=12", "--max-mb=20", "--keep-failed", "--keep-exact-duplicates", "--perceptual-threshold="]),
    "upload": (upload, ["folder", "bucket", "--key-prefix=", "--endpoint=", "--manifest=", "--prefix=assets/reviews", "--base-url="]),
    "publish-plan": (publish, ["folder", "prefix", "--report="]),
}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="roundforge")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        own = sub.add_parser(name)
        for o in options:
            key, eq, default = o.partition("=")
            if eq:
                number = default.isdigit() or key.startswith("--max")
                own.add_argument(key, default=int(default) if default.isdigit() else default or None, type=int if number else str)
            elif key.startswith("--"):
                own.add_argument(key, action="store_true")
            else:
                own.add_argument(key.rstrip("+"), nargs="+" if key.endswith("+") else None)
    a = parser.parse_args(args)
    return COMMANDS[a.command][0](spark or session(), a)


if __name__ == "__main__":
    sys.exit(main())
