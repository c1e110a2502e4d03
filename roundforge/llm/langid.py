"""Language identification by prediction by partial matching.

For each language a byte context tree of order 0 to 3 is counted; then its statistics are frozen.
A byte that was seen in a context of n bytes with q distinct ones costs -log2(count / (n + q)) bits;
else the escape costs -log2(q / (n + q)) and the next shorter context is asked (escape method C).
Below order 0, all bytes are equally likely. A text's code length under every tree is summed
exactly over the whole text, and the shortest one names the language.

Since the statistics are frozen, a byte's cost depends on the four last bytes alone. The costs are
laid out in tables, and whole batches are scored by look-up.

Texts are lower case, with runs of anything but letters and their marks as one space; digits and signs go, the letters beside them
stay. The trees are fitted on a bounded sample: about ``sample_docs`` whole documents of each language, chosen by a hash of
doc_id and text.

Defined cases: a null text or one without a letter is 'und' with score 0; with nothing to learn from,
all are 'und'; rows with a null lang or text are not learned from; ties go to the first language by name; repeated rows, and rows
with a null or repeated doc_id, are predicted one by one; texts of any length are scored whole, in time linear in their
length, a slice of the batch at a time; an empty table gives an empty table; extra columns are ignored, and those named like a
result are replaced, while language_filter() returns all columns as they came.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundforge.llm.common import as_text, held, in_arrow, map_texts, slices

ORDER = 3
SCORE_BYTES = 64  # the score is the posterior over so many average bytes
CHUNK = 1 << 19
DENSE = 1 << 25  # entries of a direct index of four-byte strings; beyond it, binary search
#: Letters, and letters with their marks.
_LETTER, _OTHER = r"\pL", r"[^\pL\pM]+"


def normalised(texts: list[str]) -> list[bytes]:
    """The letters of each text in lower case, with one space between runs of them."""
    # a lone surrogate is no letter
    raw = pa.array([t.encode("utf-8", "replace") for t in texts], pa.binary()).cast(pa.large_string())
    low = pc.utf8_lower(raw)
    words = pc.ascii_trim(pc.replace_substring_regex(low, _OTHER, " "), " ")
    return pc.if_else(pc.match_substring_regex(low, _LETTER), words, "").cast(pa.large_binary()).to_pylist()


def normal_bytes(text: str) -> bytes:
    return normalised([text])[0]


@dataclass
class Model:
    """counts[lang]: the four-byte strings as integers, ascending, and how often each was seen."""

    key: str
    langs: list[str]
    counts: list[tuple[np.ndarray, np.ndarray]] = field(repr=False)


class Tables:
    """Costs in bits, by symbol; symbol 0 stands for all bytes that no tree has seen."""

    def __init__(self, model: Model) -> None:
        seen = np.unique(np.concatenate([k & 255 for k, _ in model.counts] + [np.array([32])]))
        self.symbol = np.zeros(256, np.int64)
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        a = self.a = len(seen) + 1
        n = len(model.langs)
        self.v3, self.e3 = np.empty((a**3, n), np.float32), np.zeros((a**3, n), np.float32)
        codes, values = [], []
        for j, (keys, count) in enumerate(model.counts):
            s = [self.symbol[(keys >> shift) & 255] for shift in (24, 16, 8, 0)]
            below = np.full(a, 8.0)  # order -1: one of 256 bytes
            for order in range(ORDER):
                gram = sum(s[3 - i] * a**i for i in range(order + 1))
                c = np.bincount(gram, weights=count, minlength=a ** (order + 1)).reshape(-1, a)
                total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
                with np.errstate(divide="ignore", invalid="ignore"):
                    escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                    cost = np.where(c > 0, -np.log2(c / (total + kinds)), escape + np.tile(below.reshape(-1, a), (a if order else 1, 1)))
                below = cost.reshape(-1)
            self.v3[:, j] = below
            gram, context = ((s[0] * a + s[1]) * a + s[2]) * a + s[3], (s[0] * a + s[1]) * a + s[2]
            total = np.bincount(context, weights=count, minlength=a**3)
            kinds = np.bincount(context, minlength=a**3)
            with np.errstate(divide="ignore", invalid="ignore"):
                self.e3[:, j] = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            codes.append(gram)
            values.append(-np.log2(count / (total + kinds)[context]))
        self.keys = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
        context, last = self.keys // a, self.keys % a**3
        self.v4 = self.e3[context] + self.v3[last]
        for j, (gram, value) in enumerate(zip(codes, values, strict=True)):
            self.v4[np.searchsorted(self.keys, gram), j] = value
        self.row = None
        if a**4 <= DENSE:
            self.row = np.full(a**4, -1, np.int32)
            self.row[self.keys] = np.arange(len(self.keys))

    def rows_of(self, gram: np.ndarray) -> np.ndarray:
        if self.row is not None:
            return self.row[gram]
        at = np.minimum(np.searchsorted(self.keys, gram), len(self.keys) - 1)
        return np.where(self.keys[at] == gram, at, -1)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths: a row for each text, a column for each language."""
        out = np.zeros((len(texts), self.v3.shape[1]))
        a, pad = self.a, b"   "
        flat = self.symbol[np.frombuffer(b"".join(pad + t for t in texts), np.uint8)]
        sizes = np.array([len(t) for t in texts], np.int64)
        doc = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(doc)) + 3 * (doc + 1)  # of each byte that counts
        for i in range(0, len(doc), CHUNK):
            p, d = place[i : i + CHUNK], doc[i : i + CHUNK]
            tail = (flat[p - 2] * a + flat[p - 1]) * a + flat[p]
            gram = flat[p - 3] * a**3 + tail
            row = self.rows_of(gram)
            cost = self.v4[row]
            miss = np.flatnonzero(row < 0)
            if len(miss):
                cost[miss] = self.e3[gram[miss] // a] + self.v3[tail[miss]]
            first = np.flatnonzero(np.diff(d, prepend=-1))
            out[d[first]] += np.add.reduceat(cost.astype(np.float64), first, axis=0)
        return out


def tables(model: Model) -> Tables:
    return held(("langid", model.key), lambda: Tables(model))


def _gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for lang, part in b.groupby("lang"):
            texts = normalised(part["text"].tolist())
            flat = np.frombuffer(b"".join(b"   " + t for t in texts), np.uint8).astype(np.int64)
            sizes = np.array([len(t) for t in texts], np.int64)
            doc = np.repeat(np.arange(len(texts)), sizes)
            p = np.arange(len(doc)) + 3 * (doc + 1)
            gram, n = np.unique(((flat[p - 3] * 256 + flat[p - 2]) * 256 + flat[p - 1]) * 256 + flat[p], return_counts=True)
            yield pd.DataFrame({"lang": lang, "gram": gram, "n": n})


def fit(docs: DataFrame, sample_docs: int = 600) -> Model:
    """Learns from the rows of ``docs`` (doc_id, text, lang) with a text and a lang.

    sample_docs bounds the classifier's sample: about so many whole documents of each language."""
    labelled = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    per_lang = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(per_lang)
    if not langs:
        return Model("none", [], [])
    share = F.create_map(*[F.lit(x) for k, n in per_lang.items() for x in (k, min(1.0, sample_docs / n))])
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1_000_000)) / 1_000_000
    sample = labelled.filter(draw < share[F.col("lang")]).select("lang", "text")
    counted = sample.mapInPandas(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = []
    for lang in langs:
        own = counted[counted["lang"] == lang].sort_values("gram")
        counts.append((own["gram"].to_numpy(np.int64), own["n"].to_numpy(np.float64)))
    return Model(uuid.uuid4().hex, langs, counts)


def scored(m: Model, raw: list[str]) -> dict[str, np.ndarray]:
    texts = normalised(raw)
    size = np.array([len(t) for t in texts], float)
    pred, top, rate = np.full(len(raw), "und", object), np.zeros(len(raw)), np.zeros(len(raw))
    at = np.flatnonzero(size > 0)
    if m.langs and len(at):
        bits = tables(m).bits([texts[i] for i in at]) / size[at, None]
        pred[at] = np.array(m.langs, object)[bits.argmin(1)]
        rate[at] = bits.min(1)
        top[at] = 1 / np.exp2(-SCORE_BYTES * (bits - rate[at, None])).sum(1)
    return {"lang_pred": pred, "score": top, "bits_per_byte": rate}


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (doc_id) with lang_pred, score and bits_per_byte; only the text is an input."""
    keep = keep or ["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs.select(*keep, as_text().alias("_text")), lambda raw: scored(sent.value, raw), "lang_pred string, score double, bits_per_byte double", state="langid")


def language_filter(docs: DataFrame, model: Model, max_bits_per_byte: float = 7.0) -> DataFrame:
    """``docs`` without texts that have no letter or that no tree can code in max_bits_per_byte, decided row by row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices(batch, "text")):
            found = scored(sent.value, [t or "" for t in b.column("text").to_pylist()])
            yield b.filter(pa.array((found["lang_pred"] != "und") & (found["bits_per_byte"] <= max_bits_per_byte)))

    return in_arrow(docs, run, docs.schema, "langid")
