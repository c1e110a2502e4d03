"""Event windows, sessions, deduplication and running streaks, on batch tables and streams alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"


def debounced(changes: DataFrame, key: str, value: str, delay: str = "700 milliseconds", late: str = LATE) -> DataFrame:
    """The change that is saved of each run of a key's changes (ts, value) without a pause of ``delay``: the last one, when the pause is over."""
    s = F.session_window("ts", delay)
    return changes.withWatermark("ts", late).groupBy(s.alias("s"), key).agg(F.max_by(value, F.struct("ts", value)).alias(value), F.count("*").alias("changes")).select(key, F.col("s.end").alias("saved_at"), value, "changes")


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """New Parquet files of a folder as a stream; event times without a zone are UTC, the session's zone."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """Events and values by window and type; state older than the watermark is dropped on a stream."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = LATE) -> DataFrame:
    w = F.window("ts", width, step)
    return events.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count("*").alias("events")).select(F.col("w.start").alias("window_start"), "events")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """A row for each run of a user's events without a gap."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(s.alias("s"), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("s.start").alias("session_start"), "events")


def distinct_events(events: DataFrame, late: str = LATE) -> DataFrame:
    """A stream's events without repeats that arrive within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def outcomes(events: DataFrame) -> DataFrame:
    """Events as answers: a purchase is correct, an error is a skip, all else is wrong."""
    return events.select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", "correct").when(F.col("event_type") == "error", "skipped").otherwise("wrong").alias("outcome"))


def running_streaks(answers: DataFrame) -> DataFrame:
    """user_id, streak and score after each batch of a stream of answers; the state of a user is two numbers."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, score = state.get if state.exists else (0, 0)
        for b in batches:
            for outcome in b.sort_values("ts")["outcome"]:
                streak = streak + 1 if outcome == "correct" else 0
                score += 100 + min(streak - 1, 5) * 20 if streak else 0
        state.update((streak, score))
        yield pd.DataFrame({"user_id": [key[0]], "streak": [streak], "score": [score]})

    return answers.groupBy("user_id").applyInPandasWithState(run, "user_id long, streak long, score long", "streak long, score long", "update", GroupStateTimeout.NoTimeout)


def new_revisions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The revision log as a stream: what a client that polls would see."""
    return spark.readStream.schema(schema).parquet(path)
