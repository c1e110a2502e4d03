"""The training-data pipeline: each stage works on all documents that the one before kept.

run(spark, sf_dir) applies the stages to ``documents``; between two stages the documents are a Parquet table in the
shared folder.

Every stage decides row by row: null texts count as empty ones, texts of any length are read whole, rows that repeat or share an id, or have none, are
rows of their own, and columns that an operator would make stay as they came. Empty tables give empty tables. Of texts that tie, as copies do, the row with the
least doc_id stays, null after all others.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from roundforge.llm import langid, ngram_join, packing, pii, quality_rules
from roundforge.llm.common import drop_tables, tables, written
from roundforge.llm.entry import LANG_FOLD, held_out, tokenizer_path

#: By stage, the tables that it made for itself.
_MADE: dict[str, set[str]] = {}


def _stage(apply):
    """A stage that, once it has its input, drops the tables which other stages made for themselves: their outputs are written by then. They
    stay if its input reads them, and a stage that is called again keeps its own."""

    @wraps(apply)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for other in [k for k in _MADE if k != apply.__name__]:
            drop_tables(_MADE[other], docs)
            _MADE[other] &= tables()
        before = tables()
        out = apply(spark, docs, sf_dir)
        _MADE.setdefault(apply.__name__, set()).update(tables() - before)
        return out

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or are depleted of lines of their own, go."""
    return quality_rules.quality_filter(docs)


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents that came in, without the held-out fold; texts in no learned language go."""
    return langid.language_filter(docs, langid.fit(docs.filter(~held_out(LANG_FOLD))))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents, the one with the least doc_id stays."""
    return ngram_join.deduplicate(docs)


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All found spans are replaced by their kinds."""
    return pii.redact(docs, pii.fit(spark))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence."""
    return packing.pack(docs, packing.PackConfig(tokenizer_path()))


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("packing", packed),
]

#: Language ID by byte context trees can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{i}")
    _MADE.clear()  # the result reads what the last stage made
    return docs
