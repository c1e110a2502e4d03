"""Filter interaction audit: what each of five filters takes away, alone, after others and in every order.

Each document gets five failure flags. They are counted by part and flags, at most 32 rows a part, and one SQL CUBE over the flags and the part
sums these rows up for every subset of the filters: the row of a grouping set whose selected flags are all false has the survivors of that
subset. Every step of every order is then the pair of two subsets, the filters before it and these with its own, joined to
their survivors. So documents are read for the flags and for the copies, and never once for an order.

Filters (failure): A under ``min_words`` words; B too few different words; C too many letters A-Z; D a sign of ``signs``; E a copy: the text is identical to that of a smaller
doc_id, whatever the other filters do. Words are maximal runs without white space, case-sensitive.

Copies are told without gathering them: the least doc_id of each text (a digest of 256 bits) is a sum made before the shuffle, and documents are joined to these by
digest and doc_id together, so that a text with a third of all documents is no hot key. Rows without a doc_id take no part in that join.

Defined cases: a null text is the empty text, a null lang the part ''; a null doc_id is neither smaller nor larger than another, so such a row is no copy and
makes none, and has no labels; repeated rows with one doc_id are no copies of each other; documents with several rows in ``labels`` are good (toxic) if any
of these says so, those without any are neither; texts of any length are read whole; an empty table has no parts, so no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundforge.llm.common import as_text, written

FILTERS = "ABCDE"
_WORDS = r"[^\x20\x09-\x0D]+"
_ALL = (1 << len(FILTERS)) - 1

_STEPS = f"""
WITH cubed AS (
  SELECT part, A, B, C, D, E, {" + ".join(f"{1 << i} * (1 - grouping({f}))" for i, f in enumerate(FILTERS))} AS subset, sum(n) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM {{counts}} GROUP BY CUBE (A, B, C, D, E, part) HAVING grouping(part) = 0
), survivors AS (
  SELECT part, subset, n, good, toxic FROM cubed WHERE NOT ({" OR ".join(f"coalesce({f}, false)" for f in FILTERS)})
), parts AS (
  SELECT part, n AS total, explode(sequence(0, {_ALL})) AS subset FROM cubed WHERE subset = 0
), kept AS (
  SELECT part, subset, total, coalesce(n, 0) AS n, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM parts LEFT JOIN survivors USING (part, subset)
), alone AS (
  SELECT part, max(total) AS total, map_from_entries(collect_list(struct(subset, n))) AS of FROM kept GROUP BY part
), steps AS (
  SELECT b.part, s.filter_order, s.step, s.bit, a.n AS kept, b.n - a.n AS removed, b.good - a.good AS good_lost, b.toxic - a.toxic AS toxic_lost
  FROM {{orders}} s JOIN kept b ON b.subset = s.before JOIN kept a ON a.part = b.part AND a.subset = s.before + s.bit
)
SELECT part, filter_order, step, kept, removed, total - of[bit] - removed AS redundant, of[{_ALL} - bit] - of[{_ALL}] AS unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, bit) AS shapley
FROM steps JOIN alone USING (part)
"""


@dataclass(frozen=True)
class Limits:
    """min_words: A. distinct: least share of different words in a hundred, B. upper: largest share of capitals in a hundred code points, C. signs: D, none of them is special in a character class."""

    min_words: int = 100
    distinct: int = 80
    upper: int = 10
    signs: str = "#$%&*|"


def _read(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), as_text().alias("t")).withColumn("digest", F.unhex(F.sha2("t", 256)))


def flags(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, part and the five flags of every row."""
    rows = _read(docs)
    words = rows.withColumn("w", F.regexp_extract_all("t", F.lit(_WORDS), F.lit(0)))
    n, distinct = F.size("w"), F.size(F.array_distinct("w"))
    capitals = F.length("t") - F.length(F.regexp_replace("t", "[A-Z]+", ""))
    judged = words.select(
        "doc_id", "part", "digest", (n < limits.min_words).alias("A"), (100 * distinct < limits.distinct * n).alias("B"), (100 * capitals > limits.upper * F.length("t")).alias("C"), F.col("t").rlike(f"[{limits.signs}]").alias("D")
    )
    known, first = F.col("doc_id").isNotNull(), rows.filter(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copies = judged.filter(known).join(first, ["digest", "doc_id"], "left").withColumn("E", F.col("first").isNull()).drop("first")
    return copies.unionByName(judged.filter(~known).withColumn("E", F.lit(False))).drop("digest")


def counts(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good and toxic ones, by part and flags."""
    says = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(f"__{c}") for c in ("quality", "toxic")))
    known = flagged.filter(F.col("doc_id").isNotNull()).join(says, "doc_id", "left")
    rows = known.unionByName(flagged.filter(F.col("doc_id").isNull()), allowMissingColumns=True)
    total = [F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(n) for c, n in (("__quality", "good"), ("__toxic", "toxic"))]
    return rows.groupBy("part", *FILTERS).agg(F.count("*").alias("n"), *total)


def orders(spark: SparkSession) -> DataFrame:
    """A row for each step of each order of the filters: its filter's bit, and the bits of the filters before it."""
    rows = [("".join(p), k + 1, 1 << FILTERS.index(p[k]), sum(1 << FILTERS.index(f) for f in p[:k])) for p in permutations(FILTERS) for k in range(len(p))]
    return spark.createDataFrame(rows, "filter_order string, step int, bit int, before int")


def audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A row for each part, order and step, zeros included."""
    spark = docs.sparkSession
    table = written(counts(flags(docs, limits), labels), "audit-counts")
    # as many rows as there are steps, whatever the input
    return spark.sql(_STEPS, counts=table, orders=F.broadcast(orders(spark)))
