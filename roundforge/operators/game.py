"""Queries of the game: stable ranks, daily rounds, samples, playable rounds, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundforge.functions import hashing

SIZES = ("5", "10", "20", "50", "all")


def rank_key(seed: str | Column, key: Column) -> Column:
    return hashing.fnv1a(F.concat(seed if isinstance(seed, Column) else F.lit(seed), F.lit("|"), key))


def stable_rank(rows: DataFrame, seed: str, key: str, limit: int | None = None) -> DataFrame:
    """Rows by the hash of seed and key, then source order; with a limit, a top-k of every partition."""
    out = rows.withColumn("rank", rank_key(seed, F.col(key))).orderBy("rank", "pos")
    return out.limit(limit) if limit is not None else out


def daily_rounds(rounds: DataFrame, date_key: str, count: int = 5) -> DataFrame:
    return stable_rank(rounds, f"daily:{date_key}", "id", max(0, count))


def daily_choices(choices: Column, date_key: str, round_id: Column) -> Column:
    """The day's order of a round's choices."""
    # the choices' hashes go on from that of the seed, which they share
    seed = F.array(hashing.fnv1a(F.concat(F.lit(f"choices:{date_key}:"), round_id, F.lit("|"))))
    ranked = F.flatten(F.transform(seed, lambda h: F.array_sort(F.transform(choices, lambda c, i: F.struct(hashing.fnv1a(c, h).alias("rank"), i.alias("i"), c.alias("c"))))))
    return F.transform(ranked, lambda x: x["c"])


def playable(rounds: DataFrame) -> DataFrame:
    """Rounds with id, image, title and two choices at least, the title among them."""
    present = [F.trim(F.coalesce(c, F.lit(""))) != "" for c in ("id", "review_image", "title")]
    return rounds.filter(present[0] & present[1] & present[2] & (F.size("choices") >= 2) & F.array_contains("choices", F.col("title")))


def game_size(text: str, available: int) -> int:
    return available if text == "all" else min(available, int(text) if text in SIZES else 10)


def random_game(rounds: DataFrame, size: str, seed: int, category: str = "all") -> DataFrame:
    """A drawn sample, or for 'all' every round in source order."""
    rows = rounds if category == "all" else rounds.filter(F.col("category") == category)
    if size == "all":
        return rows.orderBy("pos")
    return rows.orderBy(hashing.keyed(seed, F.col("id")), "id").limit(int(size) if size in SIZES else 10)


def streak_scores(answers: DataFrame, player: str = "user_id", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Answers (outcome) with streak, points and running score. A wrong or skipped answer resets the streak; the n-th correct one in
    a row has 100 points and 20 more for each before it, five at most."""
    w = Window.partitionBy(player).orderBy(*order)
    correct = F.col("outcome") == "correct"
    out = answers.withColumn("island", F.sum(F.when(correct, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.sum(F.when(correct, 1).otherwise(0)).over(Window.partitionBy(player, "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("streak", F.when(correct, before).otherwise(0).cast("long"))
    out = out.withColumn("points", F.when(correct, 100 + F.least(F.col("streak") - 1, F.lit(5)) * 20).otherwise(0).cast("long"))
    return out.withColumn("score", F.sum("points").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("island")


def results(scored: DataFrame, player: str = "user_id") -> DataFrame:
    """A row for each player: counts, score, best streak and the tier."""
    from roundforge.functions.text import headline

    n, c = F.count("*"), F.count_if(F.col("outcome") == "correct")
    return scored.groupBy(player).agg(n.alias("answers"), c.alias("correct"), F.sum("points").cast("long").alias("score"), F.max("streak").alias("best_streak")).withColumn("headline", headline(F.col("correct"), F.col("answers")))


def save_daily(saved: DataFrame, results: DataFrame) -> DataFrame:
    """Saved results with those of finished games: the last one of a dataset and a day holds. Both: dataset_signature, date_key, pos, outcomes, score, correct, skipped."""
    rows = saved.unionByName(results)
    rest = [c for c in rows.columns if c not in ("dataset_signature", "date_key")]
    return rows.groupBy("dataset_signature", "date_key").agg(F.max_by(F.struct(*rest), "pos").alias("r")).select("dataset_signature", "date_key", "r.*").select(*rows.columns)


def restore_daily(saved: DataFrame, signature: str, count: int = 5) -> DataFrame:
    """The results of a dataset, each with ``count`` outcomes: more are cut, missing ones count as skipped. Rows without outcomes are no results."""
    own = saved.filter((F.col("dataset_signature") == signature) & F.col("outcomes").isNotNull())
    padded = F.slice(F.concat("outcomes", F.array_repeat(F.lit("skipped"), count)), 1, count)
    numbers = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("score", "correct", "skipped")}
    return own.withColumns({"outcomes": padded} | numbers)
