"""Scores of rounds and audits of packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundforge.functions import text


def similarities(own: Column, others: Column) -> Column:
    """Of a title's tokens and the tokens of each other title."""
    return F.transform(others, lambda t: text.jaccard(own, t))


def analyze(rounds: DataFrame) -> DataFrame:
    """``rounds`` (title, choices, review_title, review_text, rating, source_url, review_image) with the struct analysis.

    Tokens are columns, as they are used several times: a text is folded and cut into tokens once."""
    title = F.coalesce("title", F.lit(""))
    others = F.coalesce(F.filter("choices", lambda c: c.isNotNull() & (c != F.col("title"))), F.array().cast("array<string>"))
    out = rounds.withColumns({"__own": text.tokens(F.col("title")), "__others": F.transform(others, lambda c: text.tokens(c)), "__said": text.tokens(F.concat_ws(" ", F.coalesce("review_title", F.lit("")), F.coalesce("review_text", F.lit(""))))})
    out = out.withColumn("__s", similarities(F.col("__own"), F.col("__others")))
    out = out.withColumn("__max", F.coalesce(F.array_max("__s"), F.lit(0.0)))
    out = out.withColumn("__mean", F.when(F.size("__s") > 0, F.aggregate("__s", F.lit(0.0), lambda a, x: a + x) / F.size("__s")).otherwise(0.0))
    out = out.withColumn("__leak", text.leak_of(F.col("__own"), F.col("__said"))).withColumn("__host", text.image_host(F.col("review_image")))
    said = F.length(F.regexp_replace(F.coalesce("review_text", F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    size, high, leak = F.length(title), F.col("__max"), F.col("__leak")
    telling = F.size("__own") >= 2
    choices = F.filter(F.coalesce("choices", F.array().cast("array<string>")), lambda c: c.isNotNull())
    distinct = F.size(F.array_distinct(F.transform(choices, lambda c: F.trim(F.lower(c)))))
    # Flags with their conditions and weights; of a group, the first that holds
    groups = [
        [("missing_review_text", said == 0, 8), ("very_short_review_text", said < 35, 4)],
        [("very_long_product_title", size > 170, 10), ("long_product_title", size > 120, 5)],
        [("near_duplicate_answer_title", high >= 0.65, 30), ("high_answer_title_similarity", high >= 0.45, 14)],
        [("very_dissimilar_answer_titles", (F.size("__s") > 0) & (high <= 0.03), 8)],
        [("review_strongly_reveals_product_title", (leak >= 0.75) & telling, 28), ("review_may_reveal_product_title", (leak >= 0.5) & telling, 14)],
        [("missing_rating", F.col("rating").isNull(), 2)],
        [("missing_product_source", F.coalesce("source_url", F.lit("")) == "", 2)],
        [("unusual_image_reference", F.col("__host").isin("missing", "unknown"), 18)],
        [("wrong_choice_count", F.size(choices) != 4, 40), ("duplicate_choices", distinct != 4, 45)],
    ]
    raised = []
    for group in groups:
        flag = F.lit(None).cast("struct<name:string,weight:int>")
        for name, condition, weight in reversed(group):
            flag = F.when(condition, F.struct(F.lit(name).alias("name"), F.lit(weight).alias("weight"))).otherwise(flag)
        raised.append(flag)
    out = out.withColumn("__flags", F.array_compact(F.array(*raised)))
    analysis = F.struct(
        F.bround(100 * F.least(F.lit(1.0), 0.78 * F.col("__max") + 0.22 * F.col("__mean"))).cast("int").alias("difficulty_score"),
        F.least(F.lit(100), F.aggregate("__flags", F.lit(0), lambda a, f: a + f["weight"])).alias("curation_priority"),
        F.transform("__flags", lambda f: f["name"]).alias("flags"),
        F.bround("__max", 4).alias("choice_similarity_max"),
        F.bround("__mean", 4).alias("choice_similarity_mean"),
        F.bround("__leak", 4).alias("review_title_leak_ratio"),
        F.col("__host").alias("image_host"),
    )
    return out.withColumn("analysis", analysis).drop("__own", "__others", "__said", "__s", "__max", "__mean", "__leak", "__host", "__flags")


def counts(df: DataFrame, key: Column, name: str, pos: str = "pos") -> DataFrame:
    """name, n: most frequent first, then first seen."""
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n"), F.min(pos).alias("__first")).orderBy(F.desc("n"), "__first").drop("__first")


def flag_counts(scored: DataFrame) -> DataFrame:
    # outer, as for a plain explode Spark makes a filter of its own, which scores each round a second time below the scores
    flags = scored.select("pos", F.explode_outer("analysis.flags").alias("flag")).filter("flag is not null")
    return counts(flags, F.col("flag"), "flag")


def rating_key(rating: Column) -> Column:
    return F.coalesce(rating.cast("int").cast("string"), F.lit("missing"))


def difficulty_bucket(score: Column) -> Column:
    return F.when(score < 20, "very easy").when(score < 40, "easy").when(score < 60, "medium").when(score < 80, "hard").otherwise("very hard")


def priority_bucket(score: Column) -> Column:
    return F.when(score >= 40, "high").when(score >= 15, "medium").otherwise("low")


def averages(scored: DataFrame) -> DataFrame:
    """One row: rounds, mean difficulty and priority to one decimal (0 without rounds), verified and helpful counts."""
    mean = lambda c: F.coalesce(F.bround(F.avg(c), 1), F.lit(0.0))
    return scored.agg(
        F.count("*").alias("rounds"),
        mean("analysis.difficulty_score").alias("mean_difficulty"),
        mean("analysis.curation_priority").alias("mean_priority"),
        F.count_if(F.coalesce("verified_purchase", F.lit(False))).alias("verified"),
        F.count_if(F.coalesce("helpful_vote", F.lit(0)) > 0).alias("helpful"),
    )


def audit(scored: DataFrame) -> DataFrame:
    """All facets in one table (facet, key, n): one pass over the rounds and one shuffle."""
    a = "analysis."
    facets = [
        ("category", F.coalesce(F.nullif("source_category", F.lit("")), F.lit("Other"))),
        ("rating", rating_key(F.col("rating"))),
        ("host", F.col(a + "image_host")),
        ("difficulty", difficulty_bucket(F.col(a + "difficulty_score"))),
        ("priority", priority_bucket(F.col(a + "curation_priority"))),
    ]
    one = F.array(*[F.struct(F.lit(f).alias("facet"), k.alias("key")) for f, k in facets])
    many = F.transform(a + "flags", lambda x: F.struct(F.lit("flag").alias("facet"), x.alias("key")))
    return scored.select(F.explode(F.concat(one, many)).alias("x")).groupBy("x.facet", "x.key").agg(F.count("*").alias("n"))


def render(audit_rows: list, title: str) -> str:
    """The audit as text: a bounded report."""
    out = [title, "=" * len(title)]
    for facet in dict.fromkeys(r["facet"] for r in audit_rows):
        out.append(f"\n{facet}")
        out += [f"  {r['key']}: {r['n']}" for r in sorted((r for r in audit_rows if r["facet"] == facet), key=lambda r: (-r["n"], r["key"]))]
    return "\n".join(out)
