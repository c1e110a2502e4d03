"""Quality rules: text statistics of every document and the cross-document frequency of its lines.

Lines are normalised (trimmed, lower case, white space runs as one space, digits as 0) and hashed.
For each host the number of distinct documents with a line is counted. Lines above the host's limit
are cut from the texts; a document that keeps too few words of its own is depleted and rejected.

Exact copies count as one document: a line isn't boilerplate because one text was copied. Texts that differ in anything, be it a
number in a template, are documents of their own. A line in every document of a host is counted in two steps, by line
and document first, so no task gets all its rows.

Defined cases: a null text has no words; a null host is the host ''; rows that repeat, or have the same or no doc_id, are judged row by
row; texts of any length are read whole; a line with just as many documents as the limit stays, and so does a document with just as
many words as it needs; columns that clash with a result column are ignored on input; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundforge.llm.common import ROW, as_text, by_ids, checkpointed, in_arrow, map_texts, numbered, slices, without, written

WINDOW = 5
CUT = "__cut"
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
_SPACE_RUN = re.compile(r"[ \t\x0b\x0c\r]+")
_DIGIT = re.compile(r"[0-9]")

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, identity string, lines array<struct<hash:string,words:int>>"
STAT_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "identity", "lines"]


@dataclass(frozen=True)
class QualityLimits:
    """min_words and max_repeat_pct: the base rules. A line is removed if more than
    max(min_line_docs, line_share x the host's documents) distinct documents of its host have it.
    A document is depleted if fewer than min_words words or less than min_left of its words stay."""

    min_words: int = 10
    max_repeat_pct: int = 20
    min_line_docs: int = 10
    line_share: float = 0.02
    min_left: float = 0.1


def normal_line(line: str) -> str:
    return _DIGIT.sub("0", _SPACE_RUN.sub(" ", line).strip(SPACES).lower())


def _md5(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def line_hash(line: str) -> str:
    return _md5(normal_line(line))


def cut_lines(text: str, hashes: set[str]) -> str:
    """``text`` without its lines with these hashes; the other lines stay as they are."""
    return "\n".join(line for line in text.split("\n") if line_hash(line) not in hashes)


def text_stats(text: str) -> tuple[int, int, int, int, int, str, list[dict]]:
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at the six ASCII spaces only
    grams = [b" ".join(g) for g in zip(*(words[i:] for i in range(WINDOW)))]
    distinct, repeated = set(grams), 0
    if len(distinct) < len(grams):
        counts: dict[bytes, int] = {}
        for g in grams:
            counts[g] = counts.get(g, 0) + 1
        end = 0  # words before it are counted
        for i, g in enumerate(grams):
            if counts[g] > 1:
                repeated += i + WINDOW - max(i, end)
                end = i + WINDOW
    seen: set[str] = set()
    dup_lines, lines = 0, {}
    for line in text.split("\n"):
        n = len(line.encode("utf-8", "surrogatepass").split())
        if not n:
            continue
        if line in seen:
            dup_lines += 1
        seen.add(line)
        normal = normal_line(line)
        lines[normal] = lines.get(normal, 0) + n
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup_lines, repeated, _md5(text), [{"hash": _md5(x), "words": n} for x, n in lines.items()]


def _stats(texts: list[str]) -> dict[str, list]:
    return dict(zip(STAT_NAMES, zip(*map(text_stats, texts), strict=True), strict=True)) if texts else {n: [] for n in STAT_NAMES}


def _judged(docs: DataFrame, limits: QualityLimits, host: str, row_id) -> DataFrame:
    """judge() with the row's id and the hashes of its removed lines."""
    rows = docs.select(row_id.alias(ROW), "doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), as_text().alias("_text"))
    stats = written(map_texts(rows, _stats, STATS), "quality")
    lines = stats.select(ROW, "host", "identity", F.explode("lines").alias("line")).select(ROW, "host", "identity", "line.hash", "line.words")
    frequent = lines.groupBy("host", "hash").agg(F.countDistinct("identity").alias("n_docs")).filter(F.col("n_docs") > limits.min_line_docs)
    hosts = stats.groupBy("host").agg(F.countDistinct("identity").alias("host_docs"))
    frequent = frequent.join(hosts, "host").filter(F.col("n_docs") > F.col("host_docs") * limits.line_share).select("host", "hash")
    removed = lines.join(frequent, ["host", "hash"]).groupBy(ROW).agg(F.sum("words").alias("removed_words"), F.collect_list("hash").alias(CUT))
    left = F.col("n_words") - F.col("removed_words")
    return (
        stats.drop("lines", "identity")
        .join(removed, ROW, "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_pct * F.col("n_words")))
        .withColumn("depleted", (left < limits.min_words) | (left < limits.min_left * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    )


def judge(docs: DataFrame, limits: QualityLimits = QualityLimits(), host: str = "source") -> DataFrame:
    """One row per row of ``docs``: its statistics, words in removed lines, base_failed, depleted and kept."""
    return _judged(docs, limits, host, F.monotonically_increasing_id()).drop(ROW, CUT)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (x for batch in batches for x in slices(batch, "text")):
        at = b.schema.get_field_index("text")
        texts = [cut_lines(t, set(h)) for t, h in zip(b.column("text").to_pylist(), b.column(CUT).to_pylist(), strict=True)]
        b = b.set_column(at, b.schema.field(at), pa.array(texts, type=b.schema.field(at).type))
        yield b.drop_columns([CUT])


def quality_filter(docs: DataFrame, limits: QualityLimits = QualityLimits(), host: str = "source") -> DataFrame:
    """``docs`` without the rejected rows, the frequent lines of their host cut from the texts of the others and ``n_chars``, if
    there, counted again where lines were cut. Rows are judged one by one, whatever their doc_id."""
    rows = numbered(docs, "quality-rows")
    judged = _judged(rows, limits, host, F.col(ROW))
    decided = checkpointed(judged.filter(~F.col("kept") | (F.col("removed_words") > 0)).select(ROW, "kept", CUT))
    whole = without(rows, decided, ROW)
    cut = decided.filter("kept").select(ROW, CUT)
    touched = by_ids(rows, cut, "left_semi", ROW).join(cut, ROW)
    touched = in_arrow(touched, _cut, touched.drop(CUT).schema)
    if "n_chars" in docs.columns:
        touched = touched.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return whole.select(*docs.columns).unionByName(touched.select(*docs.columns))
