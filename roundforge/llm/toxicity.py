"""Toxicity: a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

Folding: compatibility forms and look-alike letters of other scripts become Latin letters, digits and signs
that stand for letters inside words become those letters, invisible characters vanish, letters that are
spaced out by dots or dashes join, long runs of a letter shrink, and i and l are one letter.

Entries are whole words or beginnings of words; each has a weight, its log-odds between toxic and clean documents. Where
several match at a place, the heaviest counts. Accents count, but whole words without accents are also
looked for in a copy of the text without accents. Exception phrases cancel the entries inside them. Hits are
summed, normalised by length, and turned into a probability by a logistic curve.

The lexicon, the exceptions and the curve are fitted on a bounded sample of labelled documents; near copies of a
document count once. A small general lexicon and some exceptions are given.

Defined cases: null and empty texts score like a text without hits; without labels of both kinds the general lexicon
decides alone; of several labels of a document the highest holds, and rows that share a doc_id share its label; rows with a null
doc_id are not learned from; repeated rows are scored row by row; entries with the same odds are all taken, and of entries at one
place the heaviest counts; texts of any length are scored whole, in time linear in their length and hits; extra columns, also those
named like a result, are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundforge.llm.common import as_text, map_texts, written

#: Cyrillic, Greek and other letters, and the Latin ones that they look like.
HOMOGLYPHS = str.maketrans(
    {
        "а": "a", "в": "b", "е": "e", "з": "e", "і": "i", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h",
        "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
        "ɡ": "g", "ɑ": "a", "ı": "i", "ɩ": "l", "ǀ": "l", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t",
    }
)
#: Digits and signs that stand for letters inside words.
LEET = str.maketrans("0134578@$!|+", "oieastbasiit")
_LEET_WORD = re.compile(r"(?<![\w@$!|+])(?=[\w@$!|+]*[^\W\d_])[@$]?\w*[^\W_](?:[@$!|+]+[^\W_]+)*(?![^\W_])")
_HAS_LEET = re.compile(r"[^\W\d_][0134578@$!|+]|[0134578@$][^\W\d_]")
#: Accented Latin letters, and the letter without its accents.
ACCENTS = {c: unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x250)}
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\u180e\ufe00-\ufe0f\ufeff]")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][.\-_*]){2,}[^\W\d_](?!\w)")
_RUN = re.compile(r"([^\W\d_])\1{2,}")
_BREAK = re.compile(r"[\W\d_]+")

#: General entries and exceptions, before folding.
GENERAL = "idiot moron stupid scum trash worthless pathetic disgusting loser clown imbecile dumbass bastard bitch asshole fuck fucking shit cunt whore slut retard retarded filth vermin subhuman".split()
EXCEPTIONS = ["trash can", "trash bin", "clown fish", "trash compactor", "bitch and moan", "loser bracket"]
SHORTEST, LONGEST = 4, 8  # letters of a word's beginning that may be an entry


def folded(text: str) -> str:
    """Folded words with one space before and after each."""
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii():
        text = text.translate(HOMOGLYPHS)
    if _HAS_LEET.search(text):
        text = _LEET_WORD.sub(lambda m: m[0].translate(LEET), text)
    text = _SPACED.sub(lambda m: re.sub(r"[.\-_*]", "", m[0]), text)
    text = _RUN.sub(r"\1", text).replace("l", "i")
    return " " + _BREAK.sub(" ", text).strip() + " "


@dataclass(frozen=True)
class Training:
    """Bounds of the labelled sample: about so many toxic and so many clean documents. An entry needs
    min_docs toxic documents, or min_share of them if that is more, and log-odds of min_odds; all that qualify are taken."""

    toxic_docs: int = 3000
    clean_docs: int = 5000
    min_docs: int = 4
    min_share: float = 0.008
    min_odds: float = 3.0


@dataclass(frozen=True)
class Model:
    key: str
    weights: dict[str, float] = field(repr=False)  # " word " or " beginning"
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]  # of 1, log(1 + weight), log(1 + weight in 100 words)


_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def automaton(model: Model) -> ahocorasick.Automaton:
    if model.key not in _AUTOMATA:
        if len(_AUTOMATA) > 3:
            _AUTOMATA.clear()
        a = ahocorasick.Automaton()
        for entry, w in model.weights.items():
            a.add_word(entry, (len(entry), w))
        for phrase in model.exceptions:
            a.add_word(phrase, (len(phrase), None))
        a.make_automaton()
        _AUTOMATA[model.key] = a
    return _AUTOMATA[model.key]


_PLAIN: dict[str, Model] = {}


def _plain(model: Model) -> Model:
    """The whole words without accents; made once for a model."""
    if model.key not in _PLAIN:
        if len(_PLAIN) > 3:
            _PLAIN.clear()
        _PLAIN[model.key] = _without_accents(model)
    return _PLAIN[model.key]


def _without_accents(model: Model) -> Model:
    words = {e: w for e, w in model.weights.items() if e.isascii() and e.endswith(" ")}
    return Model(model.key + " plain", words, model.exceptions, model.curve)


def hits(text: str, model: Model) -> dict[int, float]:
    """The weight at each place of folded text where an entry matches outside of exceptions."""
    found: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, w) in automaton(model).iter(text) if model.weights else ():
        start = end - size + 1
        if w is None:
            spared.append((start, end))
        else:
            found[start] = max(w, found.get(start, 0.0))
    if not text.isascii() and not model.key.endswith(" plain"):
        # one character for each, so places stay
        for start, w in hits(text.translate(ACCENTS), _plain(model)).items():
            found[start] = max(w, found.get(start, 0.0))
    if spared and found:
        starts = sorted(found)
        for lo, hi in spared:
            for start in starts[bisect_left(starts, lo) : bisect_left(starts, hi)]:
                found.pop(start, None)
    return found


def measures(text: str, model: Model) -> tuple[int, float, float]:
    """Number of hits, log(1 + weight), log(1 + weight in 100 words)."""
    text = folded(text)
    found = hits(text, model)
    total = math.fsum(found.values())
    words = max(1, text.count(" ") - 1)
    return len(found), math.log1p(total), math.log1p(100 * total / words)


def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The entries that each document could support."""
    for b in batches:
        rows: dict[tuple[str, int], int] = {}
        for text, toxic in zip(b["folded"], b["toxic"], strict=True):
            terms = set()
            for w in set(text.split()):
                terms.add(f" {w} ")
                terms.update(" " + w[:k] for k in range(SHORTEST, min(LONGEST, len(w)) + 1))
            for t in terms:
                rows[t, toxic] = rows.get((t, toxic), 0) + 1
        yield pd.DataFrame([(t, k, n) for (t, k), n in rows.items()], columns=["term", "toxic", "n"])


def _around(batches: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    """The phrases of two words around each hit."""
    for b in batches:
        rows: dict[tuple[str, int], int] = {}
        for text, toxic in zip(b["folded"], b["toxic"], strict=True):
            phrases = set()
            for start in hits(text, model):
                end = text.index(" ", start + 1)
                after = text.find(" ", end + 1)
                before = text.rfind(" ", 0, start) if start else -1
                if after > 0:
                    phrases.add(text[start : after + 1])
                if before >= 0:
                    phrases.add(text[before : end + 1])
            for p in phrases:
                rows[p, toxic] = rows.get((p, toxic), 0) + 1
        yield pd.DataFrame([(t, k, n) for (t, k), n in rows.items()], columns=["term", "toxic", "n"])


def _general() -> dict[str, float]:
    return {f" {folded(w).strip()} ": 5.0 for w in GENERAL}


def fit(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> Model:
    """Learns from the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) marks."""
    exceptions = tuple(folded(p) for p in EXCEPTIONS)
    unfitted = Model(uuid.uuid4().hex, _general(), exceptions, (-3.0, 1.5, 1.0))
    marked = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = marked.join(docs.select("doc_id"), "doc_id", "left_semi")
    size = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return unfitted
    share = {1: min(1.0, training.toxic_docs / size[1]), 0: min(1.0, training.clean_docs / size[0])}
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1_000_000)) / 1_000_000
    # bounded by the two parameters, whatever the input
    drawn = F.broadcast(known.filter(draw < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])))
    rows = docs.select("doc_id", as_text().alias("_text")).join(drawn, "doc_id").select("toxic", "_text")

    def prepare(texts: list[str]) -> dict[str, list]:
        fold = [folded(t) for t in texts]
        words = [f.split() for f in fold]
        alike = [int(pd.util.hash_array(np.array([" ".join(g) for g in zip(w, w[1:], w[2:], strict=False)] or [" ".join(w)], dtype=object), categorize=False).view(np.int64).min()) for w in words]
        return {"folded": fold, "alike": alike}

    sample = written(map_texts(rows, prepare, "folded string, alike long").groupBy("alike", "toxic").agg(F.min("folded").alias("folded")).select("toxic", "folded"), "toxic-sample")
    kinds = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        return unfitted
    counts = sample.mapInPandas(_terms, "term string, toxic int, n long").groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (kinds[1] + 1.0)) - F.log((F.col("c") + 0.5) / (kinds[0] + 1.0))
    least = max(training.min_docs, training.min_share * kinds[1])
    chosen = counts.withColumn("odds", odds).filter((F.col("t") >= least) & (F.col("odds") >= training.min_odds)).collect()
    weights = _general() | {r["term"]: float(r["odds"]) for r in chosen}
    model = Model(uuid.uuid4().hex, weights, exceptions, unfitted.curve)
    around = sample.mapInPandas(lambda b: _around(b, model), "term string, toxic int, n long").groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    spare = around.filter((F.col("c") >= training.min_docs) & (F.col("t") * 4 <= F.col("c"))).orderBy("term").collect()
    model = Model(uuid.uuid4().hex, weights, exceptions + tuple(r["term"] for r in spare), unfitted.curve)
    fold = model

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["folded"]:
                total = math.fsum(hits(t, fold).values())
                out.append((math.log1p(total), math.log1p(100 * total / max(1, t.count(" ") - 1))))
            yield pd.DataFrame({"toxic": b["toxic"], "a": [x[0] for x in out], "b": [x[1] for x in out]})

    got = sample.mapInPandas(measure, "toxic int, a double, b double").toPandas()
    y = got["toxic"].to_numpy(float)
    curve = _logistic(got[["a", "b"]].to_numpy(), y, np.where(y > 0, 1 / share[1], 1 / share[0]))
    return Model(uuid.uuid4().hex, weights, model.exceptions, curve)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float, float]:
    """Weighted logistic regression by Newton steps, slightly regularised, with slopes of at least 0."""
    x = np.column_stack([np.ones(len(x)), x])
    use = [0, 1, 2]
    while True:
        beta = np.zeros(3)
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x[:, use] @ beta[use], -30, 30)))
            h = (x[:, use] * (w * p * (1 - p))[:, None]).T @ x[:, use] + 0.5 * np.eye(len(use))
            step = np.linalg.solve(h, x[:, use].T @ (w * (y - p)) - 0.5 * beta[use])
            beta[use] += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-8:
                break
        bad = [i for i in use if i and beta[i] < 0]
        if not bad:
            return tuple(float(b) for b in beta)
        use = [i for i in use if i not in bad]


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (doc_id) with score, predicted and n_hits; only the text is an input."""
    c0, c1, c2 = model.curve

    def run(texts: list[str]) -> dict[str, list]:
        n, p = [], []
        for t in texts:
            k, a, b = measures(t, model)
            n.append(k)
            p.append(1 / (1 + math.exp(-max(-30.0, min(30.0, c0 + c1 * a + c2 * b)))))
        return {"score": p, "predicted": [int(x >= 0.5) for x in p], "n_hits": n}

    return map_texts(docs.select(*(keep or ["doc_id"]), as_text().alias("_text")), run, "score double, predicted int, n_hits int")
