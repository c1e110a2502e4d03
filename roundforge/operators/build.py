"""Building rounds: sampling, joins with products, distractors, greedy distinct, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundforge.functions import hashing, text
from roundforge.session import checkpointed

# How many rows the two samples of a category hold for a limit of rounds.
def review_capacity(limit: int) -> int:
    return min(max(8 * limit, limit + 300), 60_000)


def pool_capacity(limit: int) -> int:
    return min(max(6 * limit, 3_000), 30_000)


def per_category(limit: int, categories: int) -> int:
    return -(-limit // categories)


def oversample(wanted: int) -> int:
    return max(wanted + 20, -(-135 * wanted // 100))


def check_limits(limit: int, categories: list[str] | None = None) -> None:
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if categories is not None and not categories:
        raise ValueError("at least one category is needed")


def capacities(limit: Column, categories: int) -> dict[str, Column]:
    """The sizes above for a column of limits, and what is wrong with a limit; sizes of wrong limits are null."""
    n = limit.cast("long")
    ok = n >= 1
    error = F.when(~F.coalesce(ok, F.lit(False)), "limit must be at least 1")
    sizes = {
        "reviews": F.least(F.greatest(8 * n, n + 300), F.lit(60_000)),
        "pool": F.least(F.greatest(6 * n, F.lit(3_000)), F.lit(30_000)),
        "per_category": F.ceil(n / categories),
        "oversample": F.greatest(n + 20, F.ceil(135 * n / 100)),
    }
    return {k: F.when(ok, v.cast("long")) for k, v in sizes.items()} | {"error": error}


def union_all(parts: list[DataFrame]) -> DataFrame:
    """The parts' rows, one part after the other, columns by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def image_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews with an image and a parent."""
    return reviews.filter(F.col("review_image").isNotNull() & (F.coalesce("parent_asin", F.lit("")) != ""))


def eligible_products(products: DataFrame) -> DataFrame:
    return products.filter((F.length("title") >= 3) & (F.coalesce("parent_asin", F.lit("")) != ""))


def sample(df: DataFrame, capacity: int, seed: int | str, *key: str) -> DataFrame:
    """A uniform sample without replacement, the same for a seed: the least keyed digests. Runs as a top-k of every partition."""
    return df.orderBy(hashing.keyed(seed, *[F.col(k).cast("string") for k in key]), *key).limit(capacity)


def per_group_limit(df: DataFrame, group: str, limit: int, order: list[Column | str]) -> DataFrame:
    """The first ``limit`` rows of each group; partitions are cut down before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= limit).drop("__rank")


def first_by(df: DataFrame, key: Column, pos: str = "pos") -> DataFrame:
    """The first row of each key in source order."""
    return df.withColumn("__key", key).withColumn("__rank", F.row_number().over(Window.partitionBy("__key").orderBy(pos))).filter("__rank = 1").drop("__key", "__rank")


def last_by(df: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """The last row of each key in source order, by an aggregation that combines before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), pos).alias("__row")).select(key, "__row.*").select(*df.columns)


def wanted_products(products: DataFrame, reviews: DataFrame) -> DataFrame:
    return products.join(reviews.select("parent_asin").distinct(), "parent_asin", "left_semi")


def without_reviews(products: DataFrame, reviews: DataFrame) -> DataFrame:
    return products.join(reviews.select("parent_asin").distinct(), "parent_asin", "left_anti")


def with_products(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """Reviews joined with the last product row of their parent."""
    return reviews.join(last_by(products, "parent_asin"), "parent_asin")


def build_rank(taxonomy: Column, similarity: Column, chance: Column | None = None) -> Column:
    """How plausible a title is: taxonomy, a little title overlap, and chance (from 0 to 1), which breaks ties."""
    rank = taxonomy + 2.0 * F.least(similarity, F.lit(0.45))
    return rank if chance is None else rank + 0.35 * chance


def chance(seed: int | str, *key: Column) -> Column:
    """A number from 0 to 1 that is drawn by digest, the same for a seed."""
    return F.conv(F.substring(hashing.keyed(seed, *key), 1, 8), 16, 10).cast("double") / float(1 << 32)


#: A token in more titles of a group may be common; at most so many of a group's tokens are, those in most titles.
COMMON_TITLES, COMMON_TOKENS = 64, 6


def theta_distractors(products: DataFrame, pool: DataFrame, k: int = 3, cutoff: float = 0.72) -> DataFrame:
    """For each product the k most plausible titles of its category in the pool: taxonomy, then a little title overlap; titles as
    similar as ``cutoff`` are left out. Fewer are returned where the category has fewer.

    A title of the same category path and leaf beats every other one, whatever the overlap: taxonomy counts in whole numbers and
    overlap adds 0.9 at most. So a title looks within its path first, and within its category only if it found fewer than k there; either is a
    rank join (see _best), in which the pairs that are formed grow with the titles. Products with the same title and path are ranked once.

    products, pool: parent_asin, title, category, category_path, leaf_category."""
    # texts are folded once, not for each pair
    path = lambda c, leaf: F.concat_ws("\u001f", F.transform(c, text.fold), text.fold(leaf))
    place = F.struct(F.transform("category_path", text.fold).alias("parts"), text.fold(F.coalesce("leaf_category", F.lit(""))).alias("leaf"), text.fold(F.coalesce("category", F.lit(""))).alias("kind"))
    here, key = path(F.col("category_path"), F.col("leaf_category")), ["title", "category", "path"]
    titles = lambda df: df.select("title", "category", here.alias("path"), place.alias("place"), text.fold(F.col("title")).alias("key"), text.tokens(F.col("title"), text.BUILD_STOP).alias("tokens"))
    own = checkpointed(titles(products.dropDuplicates(["title", "category", "category_path", "leaf_category"])).dropDuplicates(key))
    other = checkpointed(titles(pool.dropDuplicates(["category", "title"])))
    grouped = lambda df, *group: df.withColumn("g", F.struct(*group))
    near = checkpointed(_best(grouped(own, "category", "path"), grouped(other, "category", "path"), k, cutoff))
    enough = near.filter(F.col("rank") == k).select(*key)
    few, found = checkpointed(own.join(enough, key, "left_anti")), near
    if not few.isEmpty():
        there = other.join(few.select("category").distinct(), "category", "left_semi")
        found = near.join(enough, key, "left_semi").unionByName(_best(grouped(few, "category"), grouped(there, "category"), k, cutoff))
    back = products.select("parent_asin", "title", "category", here.alias("path"))
    return back.join(found, key).select("parent_asin", "rank", "distractor", "rank_score")


def _score(a_place: Column, b_place: Column, similarity: Column) -> Column:
    taxonomy = text.taxonomy_score(a_place["parts"], a_place["leaf"], a_place["kind"], b_place["parts"], b_place["leaf"], b_place["kind"], folded=True)
    return F.round(build_rank(taxonomy, similarity), 6)


def _union(shared: Column, a: Column, b: Column) -> Column:
    """Jaccard from the number of shared tokens and both sizes."""
    return F.when((a > 0) & (b > 0), shared / (a + b - shared)).otherwise(0.0)


def _best(own: DataFrame, other: DataFrame, k: int, cutoff: float) -> DataFrame:
    """The k best of ``other`` in the same group g for each row of ``own``, by score and then title: title, category, path, rank, distractor, rank_score.

    A rank join with upper bounds. A group's commonest tokens and the number of tokens put its titles into classes. What two titles share in common
    tokens follows from their classes, and what they share at all is no less; so a class is a list in order of title whose score is a lower bound of its members'. A
    title reads the lists of all classes merged, best first, until k of what it read are valid, that is, neither itself nor as similar as the
    cutoff: whatever comes later and shares common tokens only can't beat these. The k-th of them is the score to beat: titles that share
    other tokens are found through postings of these, rarest first, which a title stops reading where the tokens that are left can't make up that score."""
    use = other.select("g", F.explode("tokens").alias("token")).groupBy("g", "token").agg(F.count("*").alias("uses"))
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("uses"), "token"))
    common = use.filter(F.col("uses") > COMMON_TITLES).withColumn("n", place).filter(F.col("n") <= COMMON_TOKENS).groupBy("g").agg(F.collect_list("token").alias("often"))

    def classed(df: DataFrame) -> DataFrame:
        often = F.coalesce("often", F.array().cast("array<string>"))
        kind = F.struct(F.col("place"), F.array_sort(F.array_intersect("tokens", often)).alias("common"), F.size("tokens").alias("size"))
        return df.join(common, "g", "left").withColumn("rare", F.array_except("tokens", often)).withColumn("kind", kind).drop("often", "place")

    own, other = checkpointed(classed(own)), checkpointed(classed(other))
    listed = other.select("g", F.col("kind").alias("o_kind"), "title", F.row_number().over(Window.partitionBy("g", "kind").orderBy("title")).alias("at"))
    a, b = F.col("kind"), F.col("o_kind")
    shared = F.size(F.array_intersect(a["common"], b["common"]))
    classes = own.select("g", "kind").distinct().join(other.select("g", F.col("kind").alias("o_kind")).distinct(), "g")
    classes = classes.withColumn("s", _union(shared, a["size"], b["size"])).filter(F.col("s") < cutoff)
    classes = checkpointed(classes.select("g", "kind", "o_kind", _score(a["place"], b["place"], F.col("s")).alias("least")))
    key = ["g", "title", "category", "path"]
    mine = own.select(*key, F.col("key").alias("own_key"), "kind", F.col("tokens").alias("own_tokens"))
    theirs = other.select("g", F.col("title").alias("distractor"), F.col("key").alias("o_key"), F.col("tokens").alias("o_tokens"), F.col("kind").alias("o_kind"))

    def scored(pairs: DataFrame) -> DataFrame:
        """Pairs (key, distractor) that are valid, with their scores."""
        full = pairs.join(mine, key).join(theirs, ["g", "distractor"]).filter(F.col("own_key") != F.col("o_key"))
        full = full.withColumn("s", _union(F.size(F.array_intersect("own_tokens", "o_tokens")), a["size"], b["size"])).filter(F.col("s") < cutoff)
        return full.select(*key, "distractor", _score(a["place"], b["place"], F.col("s")).alias("rank_score"))

    read, left, length = None, own.select(*key, "kind"), k + 5
    while True:
        heads = classes.join(left.select("g", "kind").distinct(), ["g", "kind"], "left_semi").join(listed.filter(F.col("at") <= length).withColumnRenamed("title", "distractor"), ["g", "o_kind"])
        best = F.row_number().over(Window.partitionBy("g", "kind").orderBy(F.desc("least"), "distractor"))
        heads = heads.withColumn("n", best).filter(F.col("n") <= length).select("g", "kind", "distractor", "n")
        got = checkpointed(scored(left.join(heads, ["g", "kind"]).select(*key, "distractor")))
        read = got if read is None else read.unionByName(got)
        ended = heads.groupBy("g", "kind").agg(F.max("n").alias("n")).filter(F.col("n") == length)
        valid = got.groupBy(*key).agg(F.count("*").alias("valid"))
        left = checkpointed(left.join(ended.select("g", "kind"), ["g", "kind"], "left_semi").join(valid, key, "left").filter(F.coalesce("valid", F.lit(0)) < k).select(*key, "kind"))
        if left.isEmpty():
            break
        length *= 8
    # what has to be beaten, where k were read
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("rank_score"), "distractor"))
    beat = read.dropDuplicates([*key, "distractor"]).withColumn("n", rank).filter(F.col("n") == k).select(*key, F.col("rank_score").alias("beat"))
    order = F.array_sort(F.collect_list(F.struct("uses", "token")))
    probes = own.select(*key, "kind", F.explode("rare").alias("token")).join(use, ["g", "token"]).groupBy(*key, "kind").agg(order.alias("rare"))
    probes = probes.select(*key, "kind", F.size("rare").alias("many"), F.posexplode("rare").alias("at", "r")).join(beat, key, "left")
    most = (F.col("many") - F.col("at") + F.size(a["common"])) / a["size"]
    probes = probes.filter(F.col("beat").isNull() | (_score(a["place"], a["place"], most) >= F.col("beat"))).select(*key, F.col("r.token").alias("token"))
    postings = other.select("g", F.col("title").alias("distractor"), F.explode("rare").alias("token"))
    met = probes.join(postings, ["g", "token"]).select(*key, "distractor").distinct()
    found = read.unionByName(scored(met)).dropDuplicates([*key, "distractor"]).withColumn("rank", rank).filter(F.col("rank") <= k)
    return found.select("title", "category", "path", "rank", "distractor", "rank_score")


def greedy_two_key(df: DataFrame, first: str, second: str, order: str, limit: int | None = None) -> DataFrame:
    """Rows in order, each kept if neither of its keys was kept before: only kept rows mark their keys. ``limit`` takes the first kept rows.

    A row that is the first one left of both its keys is kept whatever the others do, and then all rows with one of its keys are
    settled. So each round keeps such rows and drops what they settle, until no row is left: for an order that isn't made up for it, about
    as many rounds as the logarithm of the rows. Each round aggregates by either key and is checkpointed; no task holds a key's rows."""
    rows = checkpointed(df.withColumn("__at", F.struct(F.col(order), F.monotonically_increasing_id().alias("id"))))
    kept, left = None, rows.select("__at", first, second)
    while not left.isEmpty():
        one = left.groupBy(first).agg(F.min("__at").alias("__at"))
        two = left.groupBy(second).agg(F.min("__at").alias("__at"))
        now = checkpointed(one.join(two, "__at"))
        kept = now if kept is None else kept.unionByName(now)
        left = checkpointed(left.join(now.select(first), first, "left_anti").join(now.select(second), second, "left_anti"))
    if kept is None:
        return df.limit(0)
    out = rows.join(kept.select("__at"), "__at", "left_semi").drop("__at").select(*df.columns)
    return out.orderBy(order).limit(limit) if limit else out


def distinct_rounds(rounds: DataFrame, pos: str = "pos") -> DataFrame:
    """One round for each parent, the first; rounds without a parent are distinct by id."""
    return first_by(rounds, F.coalesce(F.nullif("parent_asin", F.lit("")), F.concat(F.lit("id:"), F.col("id"))), pos)


def assemble(joined: DataFrame) -> DataFrame:
    """Rounds: id, review columns, the public product and its source address."""
    address = F.when(F.coalesce("asin", F.lit("")) != "", F.concat(F.lit("https://www.amazon.com/dp/"), "asin"))
    product = F.struct("title", "category", "category_path", "leaf_category", "price", "product_image", "store", "asin", "parent_asin", address.alias("source_url"))
    return joined.select(hashing.round_id(F.col("parent_asin"), F.col("review_image")).alias("id"), text.round_category(F.col("source_category"), F.col("category")).alias("source_category"), "review_image", "rating", "review_title", "review_text", "helpful_vote", "verified_purchase", "timestamp", product.alias("product"))


def shuffled_choices(rounds: DataFrame, seed: int) -> DataFrame:
    """Each round's choices in an order drawn by digest."""
    order = F.array_sort(F.transform("choices", lambda c: F.struct(hashing.keyed(seed, F.col("id"), c).alias("k"), c.alias("c"))))
    return rounds.withColumn("choices", F.transform(order, lambda x: x["c"]))


def build_stats(reviews: DataFrame, sampled: DataFrame, matched: DataFrame, pool: DataFrame, written: DataFrame) -> DataFrame:
    count = lambda df, name: df.agg(F.count("*").alias(name))
    out = count(reviews.filter("review_image is not null"), "eligible_seen")
    for df, name in ((sampled, "sampled"), (matched, "matched"), (pool, "pool"), (written, "written")):
        out = out.join(count(df, name))  # one row each
    return out
