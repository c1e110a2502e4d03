"""Rules that a pack's rounds must meet, as rows of errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roundforge.functions import text


def round_errors(rounds: DataFrame) -> DataFrame:
    """error, pos. rounds: pos, id, review_image, product (a struct with title, parent_asin; null where it is no object), choices, rating.
    Of rows that share an id or a parent the first is clean. Without a product the row's later rules don't apply."""
    title, choices, rating = F.col("product.title"), F.col("choices"), F.col("rating")
    has = F.col("product").isNotNull()
    repeat = lambda c, ok: ok & (F.row_number().over(Window.partitionBy(c).orderBy("pos")) > 1)
    known_id, parent = F.coalesce("id", F.lit("")) != "", F.col("product.parent_asin")
    four = F.coalesce(F.size(choices) == 4, F.lit(False))
    spelled = F.filter(choices, lambda c: c.isNotNull())
    rules = [
        ("id is empty", ~known_id),
        ("id is repeated", F.col("__id_again")),
        ("image is no address or asset path", ~text.valid_image(F.col("review_image"))),
        ("product is no object", ~has),
        ("title is empty", has & (F.trim(F.coalesce(title, F.lit(""))) == "")),
        ("choices are not four", has & ~four),
        ("a choice is empty", has & four & F.exists(choices, lambda c: F.trim(F.coalesce(c, F.lit(""))) == "")),
        ("choices repeat", has & four & (F.size(F.array_distinct(F.transform(spelled, text.fold))) != F.size(choices))),
        ("the title is not a choice", has & four & title.isNotNull() & ~F.coalesce(F.array_contains(spelled, title), F.lit(False))),
        ("parent is repeated", F.col("__parent_again")),
        ("rating is not from 1 to 5", has & rating.isNotNull() & ~F.coalesce(rating.between(1, 5), F.lit(False))),
    ]
    marked = rounds.withColumn("__id_again", repeat("id", known_id)).withColumn("__parent_again", repeat(parent, has & (F.coalesce(parent, F.lit("")) != "")))
    found = F.array_compact(F.array(*[F.when(condition, name) for name, condition in rules]))
    return marked.select(F.explode(found).alias("error"), "pos")


def pack_errors(rounds: DataFrame) -> DataFrame:
    """round_errors, or one row for a pack without rounds."""
    none = rounds.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("no rounds").alias("error"), F.lit(None).cast("long").alias("pos"))
    return round_errors(rounds).unionByName(none)
