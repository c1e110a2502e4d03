"""Banks of titles by category, and the choice of the most similar titles as distractors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roundforge.functions import text
from roundforge.session import checkpointed

CUTOFF, COUNT = 0.62, 3
COMMON_TITLES, COMMON_SHARE = 20, 0.05  # a token in more titles of a category is common


def candidate_bank(rounds: DataFrame) -> DataFrame:
    """Distinct titles of each source category, spelled as first seen: category, key, title, pos.

    rounds: pos, source_category, title, choices. A round's choices come before its own title."""
    offered = F.concat(F.coalesce("choices", F.array().cast("array<string>")), F.array("title"))
    rows = rounds.select(F.coalesce(F.nullif("source_category", F.lit("")), F.lit("Other")).alias("category"), F.col("pos").alias("round_pos"), F.posexplode(offered).alias("at", "raw"))
    rows = rows.withColumn("title", text.collapse(F.col("raw"))).filter(F.coalesce("title", F.lit("")) != "")
    order = F.struct("round_pos", "at")
    return rows.groupBy("category", text.fold(F.col("title")).alias("key")).agg(F.min_by("title", order).alias("title"), F.min(order).alias("first")).select("category", "key", "title", F.col("first.round_pos").alias("pos"), F.col("first.at").alias("at"))


def top_distractors(rounds: DataFrame, bank: DataFrame, count: int = COUNT, cutoff: float = CUTOFF) -> DataFrame:
    """For each round the best titles of its category: id, rank, title, score, jaccard. Ties go by title. Scores depend on
    a title's tokens alone, so each set of tokens is ranked once for a category, with one title to spare for a round's own.

    Not all pairs of a category are formed. A pair either shares a rare token, and is found through an index of rare tokens; or it shares
    common tokens only. Then its score follows from the round's title, the other's common tokens and its size, so that the
    first titles of each such class stand for it. Where too few of them are below the cutoff and the class has
    more, the round's title is held against its whole category."""
    keyed = rounds.select("id", F.coalesce(F.nullif("source_category", F.lit("")), F.lit("Other")).alias("category"), text.fold(text.collapse(F.col("title"))).alias("own_key"))
    keyed = keyed.withColumn("set_key", F.array_join(F.array_sort(text.tokens(F.col("own_key"))), " "))
    k = count + 1
    titles = checkpointed(bank.select("category", "key", "title", text.tokens(F.col("title")).alias("other")))
    sizes = titles.groupBy("category").agg(F.count("*").alias("titles"))
    use = titles.select("category", F.explode("other").alias("token")).groupBy("category", "token").agg(F.count("*").alias("n")).join(sizes, "category")
    often = use.filter((F.col("n") > COMMON_TITLES) & (F.col("n") > F.col("titles") * COMMON_SHARE)).groupBy("category").agg(F.collect_list("token").alias("often"))

    def parted(df: DataFrame, tokens: str, name: str) -> DataFrame:
        known = F.coalesce("often", F.array().cast("array<string>"))
        out = df.join(often, "category", "left").withColumn(f"{name}_common", F.array_sort(F.array_intersect(tokens, known))).withColumn(f"{name}_rare", F.array_except(tokens, known))
        return out.withColumn(f"{name}_size", F.size(tokens)).drop("often", tokens)

    own = parted(keyed.select("category", "set_key").distinct().withColumn("own", text.tokens(F.col("set_key"))), "own", "own")
    other = parted(titles, "other", "other")
    own, other = checkpointed(own), checkpointed(other)  # each is used several times
    a, b = F.col("own_size"), F.col("other_size")
    both = lambda x: F.size(F.array_intersect(f"own_{x}", f"other_{x}"))

    def scored(pairs: DataFrame) -> DataFrame:
        """pairs with shared and jaccard; the score is computed for those below the cutoff."""
        shared = F.col("shared")
        pairs = pairs.withColumn("jaccard", F.when((a > 0) & (b > 0), shared / (a + b - shared)).otherwise(0.0)).filter(F.col("jaccard") < cutoff)
        cosine = F.when((a > 0) & (b > 0), shared / F.sqrt(a * b)).otherwise(0.0)
        score = 14.0 * F.col("jaccard") + 4.0 * cosine + 0.2 * F.least(shared, F.lit(4))
        return pairs.select("category", "set_key", "title", F.round(score, 6).alias("score"), F.round("jaccard", 6).alias("jaccard"))

    spelled = lambda df, key, name: df.select("category", key, F.explode(f"{name}_rare").alias("token"))
    rare = spelled(own, "set_key", "own").join(spelled(other, "key", "other"), ["category", "token"]).groupBy("category", "set_key", "key").agg(F.count("*").cast("int").alias("n_rare"))
    by_rare = scored(rare.join(own.drop("own_rare"), ["category", "set_key"]).join(other.drop("other_rare"), ["category", "key"]).withColumn("shared", F.col("n_rare") + both("common")))

    group = Window.partitionBy("category", "other_common", "other_size")
    first = 4 * k
    spare = other.withColumn("at", F.row_number().over(group.orderBy("title"))).filter(F.col("at") <= first + 1)
    near = own.join(spare, "category").withColumn("n_rare", both("rare")).withColumn("n_common", both("common"))
    union = lambda n: F.when((a > 0) & (b > 0), n / (a + b - n)).otherwise(0.0)
    ok = (F.col("at") <= first) & (union(F.col("n_common") + F.col("n_rare")) < cutoff)
    open_ = (F.count_if(ok) < k) & (F.max("at") > first) & (F.min(union(F.col("n_common"))) < cutoff)
    short = near.groupBy("category", "set_key", "other_common", "other_size").agg(open_.alias("open")).filter("open").select("category", "set_key").distinct()
    by_class = scored(near.filter((F.col("n_rare") == 0) & (F.col("at") <= first)).withColumn("shared", F.col("n_common")))
    whole = scored(own.join(short, ["category", "set_key"], "left_semi").join(other, "category").withColumn("shared", both("rare") + both("common")))
    found = by_rare.union(by_class).join(short, ["category", "set_key"], "left_anti").union(whole)
    rank = F.row_number().over(Window.partitionBy("category", "set_key").orderBy(F.desc("score"), "title"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    others = keyed.join(best, ["category", "set_key"]).filter(text.fold(F.col("title")) != F.col("own_key"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("rank"))
    return others.withColumn("rank", place).filter(F.col("rank") <= count).select("id", "rank", "title", "score", "jaccard")


def fallback(rounds: DataFrame, bank: DataFrame, found: DataFrame, count: int = COUNT) -> DataFrame:
    """Rounds whose category gave too few titles choose anew among all titles: a whole new selection, for those rounds only."""
    few = rounds.join(found.groupBy("id").agg(F.count("*").alias("n")), "id", "left").filter(F.coalesce("n", F.lit(0)) < count).drop("n")
    everywhere = bank.groupBy("key").agg(F.min_by("title", F.struct("category", "pos", "at")).alias("title")).withColumn("category", F.lit("*")).withColumn("pos", F.lit(0)).withColumn("at", F.lit(0))
    again = top_distractors(few.withColumn("source_category", F.lit("*")), everywhere, count)
    return found.join(few.select("id"), "id", "left_anti").unionByName(again)


def rewrite_choices(rounds: DataFrame, found: DataFrame, count: int = COUNT) -> DataFrame:
    """Rounds with the found titles and their own as choices, sorted by title; rounds with too few keep their choices."""
    picked = found.groupBy("id").agg(F.collect_list("title").alias("picked"))
    made = F.sort_array(F.concat("picked", F.array("title")))
    return rounds.join(picked, "id", "left").withColumn("choices", F.when(F.size("picked") == count, made).otherwise(F.col("choices"))).drop("picked")
