"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here: pieces with scores and types, trainer and normaliser settings. From it a
tokenizers backend is rebuilt: the normaliser (precompiled map, white-space rules, dummy prefix, the
metaspace marker), a unigram model with its scores or a BPE model whose merges follow the scores, and
byte fallback. Batches are encoded multithreaded. The ids are this backend's. Parity with the sentencepiece library is verified for
every distinct segment that is encoded; a difference is counted and never replaced, and ``encode`` with ``strict`` fails on it.

If no piece crosses from a letter to a marker, a text's ids are those of its segments, marker and word, one after
the other; so each segment is encoded once while it stays in a bounded cache. Else, or if the normaliser changes texts, whole
texts are encoded.

Defined cases: null is the empty text, which has no ids; repeated rows, and rows with a null or repeated doc_id, are encoded row by row;
texts of any length are encoded whole, a slice of the batch at a time; an empty table gives an empty table; extra columns, also those named
like a result, are ignored. The marker itself in a text decodes to a space, as in sentencepiece.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from roundforge.llm.common import as_text, held, map_texts
from roundforge.llm.tokens import _Codes, _Pool

MARKER = "▁"
#: Fixed values of the format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_SEGMENT = re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protobuf message: number, and an integer or bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind, 0)
            if kind == 2:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass(frozen=True)
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(repr=False)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True  # extra white space is removed


def parse_model(data: bytes) -> PieceModel:
    pieces, set_ = [], {}
    for number, value in wire(data):
        if number == 1:
            f = dict(wire(value))
            pieces.append((f[1].decode("utf-8"), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif number == 2:
            f = dict(wire(value))
            set_ |= {"kind": f.get(3, UNIGRAM), "byte_fallback": bool(f.get(35, 0)), "unk_id": f.get(40, 0)}
        elif number == 3:
            f = dict(wire(value))
            set_ |= {"charsmap": f.get(2, b""), "dummy_prefix": bool(f.get(3, 1)), "squeeze": bool(f.get(4, 1))}
    return PieceModel(pieces, **set_)


def merges(model: PieceModel) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score of the whole first."""
    usable = {p: i for i, (p, _, t) in enumerate(model.pieces) if t in (NORMAL, USER)}
    out = []
    for whole, i in usable.items():
        for k in range(1, len(whole)):
            left, right = whole[:k], whole[k:]
            if left in usable and right in usable:
                out.append((-model.pieces[i][1], i, usable[left], usable[right], left, right))
    return [(left, right) for *_, left, right in sorted(out)]


def backend(model: PieceModel, normalise: bool = True):
    """A tokenizers.Tokenizer; without its normaliser it takes text whose spaces are markers already."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if model.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        t = Tokenizer(models.BPE(vocab, merges(model), unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback))
    elif model.kind == UNIGRAM:
        t = Tokenizer(models.Unigram([(p, s) for p, s, _ in model.pieces], model.unk_id, model.byte_fallback))
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    if normalise:
        steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
        if model.squeeze:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if model.dummy_prefix:
            steps.append(normalizers.Prepend(MARKER))
        t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARKER)])
    t.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return t


class Codec:
    """threads: of either library. max_segments bounds the cache."""

    def __init__(self, path: str, threads: int = 2, verify: bool = True, max_segments: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        with open(path, "rb") as f:
            data = f.read()
        self.model, self.threads, self.max_segments = parse_model(data), threads, max_segments
        m = self.model
        crossing = any(re.search(f"[^{MARKER}]{MARKER}", p) for p, _, t in m.pieces if t in (NORMAL, USER))
        user = any(t == USER for _, _, t in m.pieces)
        self.by_segment = m.dummy_prefix and not (m.charsmap or m.squeeze or crossing or user)
        self.tokenizer = backend(m, normalise=not self.by_segment)
        self.judge = None
        if verify:
            import sentencepiece

            self.judge = sentencepiece.SentencePieceProcessor(model_proto=data)
        self._empty()
        # what each id decodes to
        self.bytes = _Pool()
        self.bytes.add([list(self._decoded(p, t)) for p, _, t in m.pieces])

    @staticmethod
    def _decoded(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return {UNKNOWN: " ⁇ ".encode(), CONTROL: b""}.get(kind, piece.replace(MARKER, " ").encode("utf-8"))

    def _empty(self) -> None:
        self.segments, self.ids, self.differs = _Codes(), _Pool(), []

    def _both(self, marked: list[str], plain: list[str]) -> tuple[list[list[int]], list[int]]:
        """The ids of texts, and for each text whether sentencepiece has others."""
        ours = [e.ids for e in self.tokenizer.encode_batch_fast(marked, add_special_tokens=False)]
        if self.judge is None:
            return ours, [0] * len(ours)
        theirs = self.judge.encode(plain, num_threads=self.threads)
        # a marker alone can't be asked for: the library gives the empty text no prefix
        return ours, [int(a != b and bool(p)) for p, a, b in zip(plain, ours, theirs, strict=True)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other; of each text the number of ids, and of segments that the libraries encode differently."""
        if not self.by_segment:
            lists, differs = self._both(texts, texts)
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            return np.fromiter((i for x in lists for i in x), np.uint32, int(sizes.sum())), sizes, np.array(differs, np.int64)
        if len(self.segments) > self.max_segments:
            self._empty()
        flat: list[str] = []  # segments without their first marker
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            t = t.replace(" ", MARKER)
            if not t:
                continue
            if MARKER * 2 in t or t[0] == MARKER or t[-1] == MARKER:
                own = [s[1:] for s in _SEGMENT.findall(MARKER + t)]
            else:
                own = t.split(MARKER)
            flat += own
            counts[i] = len(own)
        codes = np.fromiter(map(self.segments.__getitem__, flat), np.int64, len(flat))
        new, self.segments.new = self.segments.new, []
        if new:
            lists, differs = self._both([MARKER + s for s in new], [s.replace(MARKER, " ") for s in new])
            self.ids.add(lists)
            self.differs += differs
        ids, size = self.ids.take(codes)
        ends = np.cumsum(counts)
        total = np.concatenate([[0], np.cumsum(size)])[ends]
        differ = np.concatenate([[0], np.cumsum(np.array(self.differs, np.int64)[codes])])[ends] if len(codes) else np.zeros(len(texts), np.int64)
        return ids, np.diff(total, prepend=0), np.diff(differ, prepend=0)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The texts of lists of ids, one after the other, as UTF-8."""
        raw, size = self.bytes.take(ids.astype(np.int64))
        raw = raw.astype(np.uint8).tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(sizes)].tolist()
        skip = self.model.dummy_prefix
        out, at = [], 0
        for end in ends:
            text = raw[at:end]
            out.append(text[1:] if skip and text[:1] == b" " else text)
            at = end
        return out


def codec(path: str, threads: int = 2) -> Codec:
    return held(("pieces", path, threads), lambda: Codec(path, threads))


def encode(docs: DataFrame, path: str, keep: list[str] | None = None, threads: int = 2, strict: bool = False) -> DataFrame:
    """``keep`` (doc_id) of each row with ids (array of int)."""

    def run(texts: list[str]) -> dict[str, list]:
        ids, sizes, differ = codec(path, threads).encode(texts)
        if strict and differ.any():
            raise ValueError(f"{int(differ.sum())} segments have other ids in sentencepiece")
        return {"ids": np.split(ids.astype(np.int32), np.cumsum(sizes)[:-1])}

    return map_texts(docs.select(*(keep or ["doc_id"]), as_text().alias("_text")), run, "ids array<int>", state="pieces")


def digests(docs: DataFrame, path: str, threads: int = 2) -> DataFrame:
    """doc_id with n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), n_differ (segments in which the two libraries differ), and
    round_trip: whether decoding gives the text back."""

    def run(texts: list[str]) -> dict[str, list]:
        c = codec(path, threads)
        ids, sizes, differ = c.encode(texts)
        back = c.decode(ids, sizes)
        cuts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        ids = ids.astype("<u4")
        return {
            "n_tokens": sizes,
            "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)],
            "n_differ": differ,
            "round_trip": [b == t.encode("utf-8") for b, t in zip(back, texts, strict=True)],
        }

    return map_texts(docs.select("doc_id", as_text().alias("_text")), run, "n_tokens long, ids_crc32 long, n_differ long, round_trip boolean", state="pieces")
