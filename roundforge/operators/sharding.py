"""Deterministic shards, the manifest's index, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundforge.functions import hashing, text

BUCKETS = 4096  # of the first three hex digits of a digest


def check_rounds(rounds: DataFrame, shard_size: int) -> DataFrame:
    """Errors before sharding: no rounds, missing or repeated ids."""
    if shard_size < 1:
        raise ValueError("shard_size must be at least 1")
    blank = F.coalesce("id", F.lit("")) == ""
    facts = rounds.agg(F.count("*").alias("n"), F.count_if(blank).alias("blank"), F.countDistinct("id").alias("ids"))
    errors = F.array_compact(F.array(F.when(F.col("n") == 0, "no rounds"), F.when(F.col("blank") > 0, "a round has no id"), F.when((F.col("blank") == 0) & (F.col("ids") != F.col("n")), "ids are not unique")))
    return facts.select(F.explode(errors).alias("error"))


def ordered(rounds: DataFrame, seed: int) -> DataFrame:
    """Rounds with place, from 0: their rank by digest of seed and id, then id.

    The digest's first digits deal rounds into buckets, whose sizes, 4096 numbers at most, are summed up; rounds are ranked within
    buckets. So no task sorts all rounds."""
    keyed = rounds.withColumn("__digest", hashing.keyed(seed, F.col("id"))).withColumn("__bucket", F.substring("__digest", 1, 3))
    sizes = keyed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__bucket", before.alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__bucket").orderBy("__digest", "id")) - 1
    return keyed.withColumn("__rank", rank).join(F.broadcast(sizes), "__bucket").withColumn("place", (F.col("__before") + F.col("__rank")).cast("long")).drop("__digest", "__bucket", "__rank", "__before")


def assign(rounds: DataFrame, shard_size: int, seed: int) -> DataFrame:
    """Rounds with place and shard; shard ids have four digits, or as many as their number needs."""
    placed = ordered(rounds, seed)
    total = rounds.agg(F.ceil(F.count("*") / shard_size).alias("__total"))
    number = F.floor(F.col("place") / shard_size) + 1
    width = F.greatest(F.lit(4), F.length(F.col("__total").cast("string")))
    return placed.join(F.broadcast(total)).withColumn("shard", F.lpad(number.cast("string"), width, "0")).drop("__total")


def category_counts(rounds: DataFrame, *group: str) -> DataFrame:
    """Counts of the categories as a map with sorted keys, for each group."""
    counts = rounds.groupBy(*group, text.round_category(F.col("source_category"), F.col("category")).alias("__c")).agg(F.count("*").alias("__n"))
    return counts.groupBy(*group).agg(F.sum("__n").cast("long").alias("round_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("__c", "__n")))).alias("categories"))


def compact_flags(flags: Column) -> Column:
    """name and severity of the named flags, distinct and sorted; other severities than the three are left out."""
    named = F.filter(flags, lambda f: F.trim(F.coalesce(f["name"], F.lit(""))) != "")
    own = F.transform(named, lambda f: F.struct(F.trim(f["name"]).alias("name"), F.when(f["severity"].isin("low", "medium", "high"), f["severity"]).alias("severity")))
    keyed = F.array_sort(F.array_distinct(F.transform(own, lambda f: F.struct(f["name"].alias("name"), F.coalesce(f["severity"], F.lit("")).alias("k")))))
    return F.transform(keyed, lambda f: F.struct(f["name"].alias("name"), F.nullif(f["k"], F.lit("")).alias("severity")))


def index(sharded: DataFrame) -> DataFrame:
    """The manifest's small rows: id, category, shard, analysis and screening without what isn't finite or valid."""
    numbers = F.struct(*[text.finite(F.col(f"analysis.{n}").cast("double")).alias(n) for n in ("curation_priority", "difficulty_score")])
    counts = F.map_filter("screening.severity_counts", lambda k, n: k.isin("low", "medium", "high") & (n >= 0))
    screening = F.struct(text.finite(F.col("screening.risk_score").cast("double")).alias("risk_score"), F.col("screening.needs_review"), F.col("screening.high_risk"), counts.alias("severity_counts"), compact_flags(F.col("screening.flags")).alias("flags"))
    return sharded.select("id", text.round_category(F.col("source_category"), F.col("category")).alias("category"), "shard", F.when(F.col("analysis").isNotNull(), numbers).alias("analysis"), F.when(F.col("screening").isNotNull(), screening).alias("screening"))


def index_errors(manifest_index: DataFrame, rounds: DataFrame, shards: DataFrame) -> DataFrame:
    """error, id: the index against the shards' rounds (id, category, shard), both ways, and against the shard list (id)."""
    i = manifest_index.select("id", F.col("category").alias("ic"), F.col("shard").alias("is"), F.lit(True).alias("in_index"))
    r = rounds.select("id", F.col("category").alias("rc"), F.col("shard").alias("rs"), F.lit(True).alias("in_rounds"))
    both = i.join(r, "id", "full")
    here = F.col("in_index") & F.col("in_rounds")
    found = F.array_compact(F.array(F.when(F.col("in_rounds").isNull(), "not in any shard"), F.when(F.col("in_index").isNull(), "not in the index"), F.when(here & (F.col("is") != F.col("rs")), "shard differs"), F.when(here & (F.col("ic") != F.col("rc")), "category differs")))
    stray = manifest_index.join(shards.select(F.col("id").alias("shard")), "shard", "left_anti").select(F.lit("unknown shard").alias("error"), "id")
    return both.select(F.explode(found).alias("error"), "id").union(stray)


def shard_errors(listed: DataFrame, actual: DataFrame) -> DataFrame:
    """error, id: listed shards (id, path, round_count, sha256, categories) against what their files hold."""
    a = actual.select("id", *[F.col(c).alias(f"a_{c}") for c in ("round_count", "sha256", "categories")], F.lit(True).alias("there"))
    text_of = lambda c: F.to_json(F.array_sort(F.map_entries(c)))
    j = listed.join(a, "id", "left")
    there = F.col("there")
    found = F.array_compact(
        F.array(
            F.when(~text.safe_path(F.col("path")), "unsafe path"),
            F.when(there.isNull(), "missing file"),
            F.when(there & (F.col("sha256") != F.col("a_sha256")), "sha256 differs"),
            F.when(there & (F.col("round_count") != F.col("a_round_count")), "round_count differs"),
            F.when(there & (text_of(F.col("categories")) != text_of(F.col("a_categories"))), "categories differ"),
        )
    )
    twice = listed.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("repeated shard").alias("error"), "id")
    return j.select(F.explode(found).alias("error"), "id").union(twice)


def lookup(requested: DataFrame, manifest_index: DataFrame, rounds: DataFrame) -> DataFrame:
    """Requested ids (pos, id) with their rounds, in order; a missing one is an error. Only shards that hold them are read:
    rounds are partitioned by shard, and the index's shards prune them."""
    wanted = requested.join(manifest_index.select("id", "shard"), "id")
    out = requested.join(rounds.join(wanted.select("id", "shard"), ["id", "shard"], "left_semi"), "id", "left")
    missing = F.assert_true(F.col("shard").isNotNull(), F.concat(F.lit("no round "), F.col("id")))
    return out.withColumn("__ok", missing).drop("__ok").orderBy("pos")
