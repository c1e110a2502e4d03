"""Cross-tokenizer alignment: which tokens of one tokenizer (A) cover which tokens of another one (B).

Every byte of a text is labelled: ``.`` no token ends there, ``a`` one of A, ``b`` one of B, ``x`` one of both. A regular expression scans
the label string for spans up to each ``x``; the labels of a span count the tokens of its group. Read one after the other, the labels of a group also spell its
links, the pairs of tokens whose bytes overlap: it begins with the first token of each side, and each label before the ``x`` moves its side on.

A byte-level BPE file (tokenizers) is A, and is given a space and the text; a sentencepiece model is B, which adds the space. Where no
piece of B crosses from a letter to a space, both libraries end a token before a single space between two visible characters, so texts are cut there, and each different segment is
encoded, labelled and scanned once while it stays in a bounded cache. Else whole texts are encoded.

How many documents hold a pair linked is counted in a second pass over the documents' different pairs, summed up in each task before the shuffle. A third
pass looks the counts up: they are broadcast in blocks of at most ``pairs_at_once`` pairs, and rows pass all blocks, so the vocabularies may be of any size. The
documents' pairs are a table in the shared folder, texts are encoded once.

Defined cases: null and empty texts, and texts whose bytes either side doesn't give back (a sentencepiece marker in the text, say), have no tokens: zeros and ''; special tokens in a
text are plain text; repeated rows, and rows with a null or repeated doc_id, are documents of their own; texts of any length are read whole; counts that tie are all the
highest; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundforge.llm.common import as_text, held, in_arrow, slices, written
from roundforge.llm.sentencepiece_codec import BYTE, MARKER, NORMAL, USER, parse_model
from roundforge.llm.tokens import _BYTES, _Codes, _Pool

#: Pairs of ids whose counts are broadcast at a time (17 bytes each).
PAIRS_AT_ONCE = 1_000_000
_GROUP = re.compile(rb"[.ab]*x")
_SIGNS = (",", "|", ";", "")
_LABELS = np.frombuffer(b".abx", np.uint8)
#: First bytes of characters among which there are white space and the marker.
_UNSURE = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_VISIBLE = (np.arange(256) > 0x20) & (np.arange(256) != 0x7F)


def cuts(raw: np.ndarray) -> np.ndarray:
    """Places of single spaces between two visible characters."""
    at = np.flatnonzero(raw[3:-1] == 0x20) + 3
    before, after = raw[at - 1], raw[at + 1]
    sure = _VISIBLE[before] & _VISIBLE[after] & ~_UNSURE[after]
    wide = before >= 0x80
    sure &= ~(wide & ((raw[at - 2] == 0xC2) | (_UNSURE[raw[at - 3]] & (raw[at - 3] != 0xC2))))
    return at[sure]


def aligned(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the byte lengths of both sides' tokens over the same bytes: the A and the B token of each link, and how many tokens of A and of B each group has."""
    a_end, b_end = np.cumsum(a_sizes) - 1, np.cumsum(b_sizes) - 1
    label = np.zeros(int(a_end[-1]) + 1 if len(a_end) else 0, np.uint8)
    label[a_end] |= 1
    label[b_end] |= 2
    event = label[label > 0]
    a_of, b_of = np.cumsum(event & 1) - (event & 1), np.cumsum(event >> 1) - (event >> 1)
    ends = np.cumsum(np.fromiter(map(len, _GROUP.findall(_LABELS[label].tobytes())), np.int64))
    a_in, b_in = (np.diff(np.searchsorted(x, ends, "left"), prepend=0) for x in (a_end, b_end))
    return a_of, b_of, a_in, b_in


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, one list after the other, and the length of each list."""
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(size.sum())), size


def _spread(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... of each range, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(lo - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Aligner:
    """Both tokenizers of a worker, with what is known of segments. max_segments bounds the cache."""

    def __init__(self, a_path: str, b_path: str, max_segments: int = 300_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        with open(b_path, "rb") as f:
            data = f.read()
        self.b, m = sentencepiece.SentencePieceProcessor(model_proto=data), parse_model(data)
        crossing = any(re.search(f"[^{MARKER}]{MARKER}", p) for p, _, t in m.pieces if t in (NORMAL, USER))
        self.by_segment = m.dummy_prefix and not (m.charsmap or m.squeeze or crossing or any(t == USER for _, _, t in m.pieces))
        shown = {c: i for i, c in enumerate(_BYTES)} | {chr(256 + 10): 10}
        vocabulary = sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        self.a_bytes = [bytes(shown.get(c, 63) for c in w) for w, _ in vocabulary]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARKER, " ").encode("utf-8") for p, _, t in m.pieces]
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        self.a_raw, self.b_raw = (np.frombuffer(b"".join(x), np.uint8) for x in (self.a_bytes, self.b_bytes))
        self.a_at, self.b_at = (np.cumsum(x) - x for x in (self.a_size, self.b_size))
        # every id with each sign that can follow it
        spelled = [f"{i}{sign}".encode() for i in range(max(len(self.a_size), len(self.b_size))) for sign in _SIGNS]
        self.id_size = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.id_raw, self.id_at = np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(self.id_size) - self.id_size
        self.max_segments = max_segments
        self._empty()

    def _empty(self) -> None:
        self.codes, self.pairs = _Codes(), _Codes()
        self.links, self.groups, self.known = _Pool(), [], np.zeros((0, 4), np.int64)  # tokens of A and of B, groups, whether it is bad

    def _a_ids(self, spaced: list[str]) -> list[list[int]]:
        """A's ids. A space and letters of Latin alphabets are one word to the file's splitting, so the model is asked for it at once."""
        word = [t.isalpha() and (t.isascii() or max(t) < "\u0250") for t in (t[1:] for t in spaced)]
        ids = [e.ids for e in self.a.encode_batch_fast([t for t, x in zip(spaced, word, strict=True) if not x], add_special_tokens=False)]
        shown = codecs.charmap_decode("\n".join(t for t, x in zip(spaced, word, strict=True) if x).encode("utf-8"), "strict", _BYTES)[0].split("\n")
        rest, words, tokenize = iter(ids), iter(shown), self.a.model.tokenize
        return [[x.id for x in tokenize(next(words))] if w else next(rest) for w in word]

    def _learn(self, spaced: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """The groups, numbers of tokens and groups, and links (numbers of pairs, one text after the other, and how many each has) of texts that begin with
        the added space; a text that does not come back is bad."""
        n = len(spaced)
        raw = [t.encode("utf-8") for t in spaced]
        (a, a_count), (b, b_count) = _flat(self._a_ids(spaced)), _flat(self.b.encode([t[1:] for t in spaced], num_threads=1))
        size = np.fromiter(map(len, raw), np.int64, n)
        a_of, b_of = np.repeat(np.arange(n), a_count), np.repeat(np.arange(n), b_count)
        total = lambda of, sizes: np.bincount(of, sizes, minlength=n).astype(np.int64)
        bad = (total(a_of, self.a_size[a]) != size) | (total(b_of, self.b_size[b]) != size)
        for side, of, sizes, at, store in ((a, a_of, self.a_size, self.a_at, self.a_raw), (b, b_of, self.b_size, self.b_at, self.b_raw)):
            # texts of another length are bad already
            own = side[~bad[of]]
            back = store[_spread(at[own], sizes[own])]
            came = np.frombuffer(b"".join([r for r, x in zip(raw, bad.tolist(), strict=True) if not x]), np.uint8)
            if not np.array_equal(back, came):
                good = np.flatnonzero(~bad)
                bad[good[np.unique(np.searchsorted(np.cumsum(size[good]), np.flatnonzero(back != came), "right"))]] = True
        a, b, a_of, b_of = a[~bad[a_of]], b[~bad[b_of]], a_of[~bad[a_of]], b_of[~bad[b_of]]
        x, y, a_in, b_in = aligned(self.a_size[a], self.b_size[b])
        group_of = a_of[np.cumsum(a_in) - 1]
        numbers = np.stack([np.bincount(a_of, minlength=n), np.bincount(b_of, minlength=n), np.bincount(group_of, minlength=n), bad.astype(np.int64)], axis=1)
        # the ids of a group, those of A first, each with the sign that follows it
        begin = np.cumsum(a_in + b_in) - a_in - b_in
        a_place, b_place = _spread(begin, a_in), _spread(begin + a_in, b_in)
        ids, sign = np.zeros(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int64)
        ids[a_place], ids[b_place] = a, b
        sign[begin + a_in - 1] = 1
        sign[begin + a_in + b_in - 1] = np.where(np.append(group_of[1:] == group_of[:-1], [False] * (len(group_of) > 0)), 2, 3)
        code = ids * len(_SIGNS) + sign
        text = self.id_raw[_spread(self.id_at[code], self.id_size[code])].tobytes()
        ends = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(group_of, a_in + b_in), self.id_size[code], minlength=n))]).astype(np.int64).tolist()
        groups = [text[lo:hi] for lo, hi in zip(ends, ends[1:], strict=False)]
        pair, which = np.unique(a[x] << 32 | b[y], return_inverse=True)
        link = np.fromiter(map(self.pairs.__getitem__, pair.tolist()), np.int64, len(pair))[which]
        return groups, numbers, link, np.bincount(a_of[x], minlength=n)

    def __call__(self, texts: pa.Array) -> dict[str, object]:
        """Of each text: n_a, n_b, n_groups, n_links, groups_sha256, its different pairs (A id << 32 | B id) and how often each is linked."""
        if len(self.codes) > self.max_segments:
            self._empty()
        n = len(texts)
        spaced = [" " + t if t else "" for t in texts.to_pylist()]
        numbers, sha, rows = np.zeros((n, 4), np.int64), [""] * n, [np.zeros(0, np.int64)] * n
        flat, count = self._segments(spaced) if self.by_segment else (pa.array([t for t in spaced if t], pa.large_string()), np.array([int(bool(t)) for t in spaced], np.int64))
        if len(flat):
            coded = flat.dictionary_encode()
            code = np.fromiter(map(self.codes.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))[coded.indices.to_numpy(zero_copy_only=False)]
            new, self.codes.new = self.codes.new, []
            if new:
                groups, known, *links = self._learn(new)
                self.groups += groups
                self.known = np.concatenate([self.known, known])
                self.links.extend(*links)
            ends = np.concatenate([[0], np.cumsum(count)])
            sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.known[code], axis=0)])
            numbers = sums[ends[1:]] - sums[ends[:-1]]
            link, size = self.links.take(code)
            at = np.concatenate([[0], np.cumsum(size)])[ends]
            names = list(map(self.groups.__getitem__, code.tolist()))
            for i in np.flatnonzero(count).tolist():
                if numbers[i, 3]:
                    # segments that don't come back alone: the whole text decides
                    (whole,), (own,), pairs, _ = self._learn([spaced[i]])
                    numbers[i] = own
                    sha[i] = "" if own[3] else hashlib.sha256(whole).hexdigest()
                    rows[i] = pairs
                else:
                    sha[i] = hashlib.sha256(b";".join(names[ends[i] : ends[i + 1]])).hexdigest()
                    rows[i] = link[at[i] : at[i + 1]]
        numbers[numbers[:, 3] > 0] = 0
        return {"n_a": numbers[:, 0], "n_b": numbers[:, 1], "n_groups": numbers[:, 2], "n_links": np.fromiter(map(len, rows), np.int64, n), "groups_sha256": sha} | self._counted(rows)

    def _segments(self, spaced: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The segments of all texts, one after the other, and how many each has."""
        whole = pa.array(spaced, pa.large_string())
        offsets = np.frombuffer(whole.buffers()[1], np.int64)
        raw = np.frombuffer(whole.buffers()[2] or b"", np.uint8)
        begin = offsets[:-1][np.diff(offsets) > 0]
        at = cuts(raw) if len(raw) > 4 else np.zeros(0, np.int64)
        # the byte before a text is another text's: a text's own first space is a border anyway
        at = np.union1d(at, begin)
        bounds = np.append(at, len(raw)).astype(np.int64)
        count = np.diff(np.searchsorted(at, offsets))
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(bounds), whole.buffers()[2]]), count

    def _counted(self, rows: list[np.ndarray]) -> dict[str, pa.Array]:
        """Lists of different pairs with their numbers."""
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        pair, times = np.unique(np.repeat(np.arange(len(rows)), size) << 32 | flat.astype(np.int64), return_counts=True)
        offsets = pa.array(np.searchsorted(pair >> 32, np.arange(len(rows) + 1)).astype(np.int32))
        ids = np.fromiter(self.pairs, np.int64, len(self.pairs))
        return {"pairs": pa.ListArray.from_arrays(offsets, pa.array(ids[pair & 0xFFFFFFFF])), "times": pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))}


_FOUND = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def align(docs: DataFrame, a_path: str, b_path: str, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (doc_id) of each row with its numbers of tokens, groups and links, the digest of its groups, its different pairs and how often each is linked."""
    rows = docs.select(*(keep or ["doc_id"]), as_text().alias("__text"))
    kept = [f for f in rows.schema if f.name != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = held(("alignment", a_path, b_path), lambda: Aligner(a_path, b_path))
        for b in (x for batch in batches for x in slices(batch, "__text")):
            made = aligner(b.column("__text"))
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in kept] + [x if isinstance(x, pa.Array) else pa.array(x) for x in made.values()], names=[f.name for f in kept] + list(made))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", " + _FOUND
    return in_arrow(rows, run, schema, state="alignment")


def pair_counts(found: DataFrame, at_once: int = 4_000_000) -> DataFrame:
    """a_id, pair, n (documents that hold it linked) and best (n is the highest of its A id). at_once: pairs that a task gathers before it sums them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held_back: list[np.ndarray] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, which = np.unique(np.concatenate([pair, *held_back]), return_inverse=True)
            return keys, np.bincount(which, np.concatenate([n, np.ones(len(which) - len(n), np.int64)]), minlength=len(keys)).astype(np.int64)

        for b in batches:
            held_back.append(b.column("pairs").flatten().to_numpy(zero_copy_only=False))
            if sum(map(len, held_back)) > at_once:
                (pair, n), held_back = summed(), []
                if len(pair) > at_once:
                    yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])
                    pair = n = np.zeros(0, np.int64)
        pair, n = summed()
        for i in range(0, len(pair), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(pair[i : i + 100_000]), pa.array(n[i : i + 100_000])], names=["pair", "n"])

    counts = in_arrow(found.select("pairs"), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = written(counts.withColumn("a_id", F.shiftright("pair", 32)), "pair-counts")
    best = counts.groupBy("a_id").agg(F.max("n").alias("__best"))
    return counts.join(best, "a_id").select("a_id", "pair", "n", (F.col("n") == F.col("__best")).alias("best"))


def _look_up(df: DataFrame, block) -> DataFrame:
    """Adds what a block of counts (a broadcast) says to n_best and count_sum."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = block.value
        for b in batches:
            lists = b.column("pairs")
            own, times = lists.flatten().to_numpy(zero_copy_only=False), b.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            at = np.minimum(np.searchsorted(pair, own), max(0, len(pair) - 1))
            here = pair[at] == own if len(pair) else np.zeros(len(own), bool)
            at, row, times = at[here], row[here], times[here]
            more = {}
            for name, value in (("n_best", best[at] * times), ("count_sum", n[at] * times)):
                # sums of integers: bincount's doubles would round beyond 53 bits
                total = np.zeros(b.num_rows, np.int64)
                np.add.at(total, row, value)
                more[name] = pa.array(b.column(name).to_numpy(zero_copy_only=False) + total)
            yield pa.RecordBatch.from_arrays([more.get(x, b.column(x)) for x in names], names=names)

    return in_arrow(df, run, df.schema)


def digests(docs: DataFrame, a_path: str, b_path: str, pairs_at_once: int = PAIRS_AT_ONCE) -> DataFrame:
    """doc_id with the numbers of tokens, groups and links, n_best (links whose pair is in as many documents as the commonest of its A id), count_sum (over
    links) and groups_sha256."""
    spark = docs.sparkSession
    found = written(align(docs, a_path, b_path), "aligned")
    counts = written(pair_counts(found), "pairs")
    blocks = max(1, -(-counts.count() // pairs_at_once))
    rows = found.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for k in range(blocks):
        part = counts if blocks == 1 else counts.filter(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == k)
        t = part.select("pair", "n", "best").toArrow().sort_by("pair")
        block = tuple(t.column(c).to_numpy().astype(np.int64) for c in t.column_names)
        rows = _look_up(written(rows, "aligned") if k else rows, spark.sparkContext.broadcast(block))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
