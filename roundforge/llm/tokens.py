"""Batch encoding with a word cache, for tokenizers that never join what white space separates."""

from __future__ import annotations

import codecs
import os
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from roundforge.llm.common import held

#: Texts that are encoded whole: characters that the split takes for white space and the tokenizers' \s does not, letters beyond
#: Latin-1, where lowering depends on what is around, and special tokens, which are looked for before letters are lowered.
_WHOLE = "[\x1c-\x1f]|[^\x00-\u00ff]|<\\|"
#: A full stop or comma that belongs to a run of signs.
_SIGNS = r"[^\pL\pN\s][.,]"


class _Codes(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        code = self[key] = len(self)
        self.new.append(key)
        return code


class _Pool:
    """The ids of each code, one after the other."""

    def __init__(self) -> None:
        self.start, self.size, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        self.codes = self.used = 0

    def add(self, lists: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.extend(np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes)

    def extend(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """ids: of all new codes, one after the other."""
        total = len(ids)
        while self.codes + len(sizes) > len(self.start):
            self.start, self.size = np.concatenate([self.start, self.start]), np.concatenate([self.size, self.size])
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.ids[self.used : self.used + total] = ids
        at = slice(self.codes, self.codes + len(sizes))
        self.size[at] = sizes
        self.start[at] = self.used + np.cumsum(sizes) - sizes
        self.codes += len(sizes)
        self.used += total

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[codes]
        end = np.cumsum(size)
        # places fit 32 bits: the cache is bounded, and so is a slice
        at = np.repeat((self.start[codes] - end + size).astype(np.int32), size)
        at += np.arange(len(at), dtype=np.int32)
        return self.ids[at], size


class WordEncoder:
    """Encodes texts word by word; every word is encoded once while it stays in the cache.

    Arrow kernels lower, split and number the words of a batch; only its different words become Python objects.
    encode: ids of each of a list of strings, as the tokenizer gives them. word: ids of a run of letters written as the model's bytes, which is
    quicker. Texts are lowered first, and full stops and commas are words, as far as that changes nothing, so that there are fewer
    different words. end: an id to end each text with. max_words bounds the cache; beyond it, the words seen most often stay, half as many at most."""

    def __init__(self, encode: Callable[[list[str]], Iterable[list[int]]], word: Callable[[str], list[int]], end: int | None = None, max_words: int = 300_000) -> None:
        self.encode, self.word, self.end, self.max_words = encode, word, end, max_words
        self.words, self.ids, self.seen = _Codes(), _Pool(), np.zeros(0, np.int64)
        if end is not None:
            self._keep({"": [end]})  # no word is empty

    def _keep(self, known: dict[str, list[int]]) -> None:
        self.words, self.ids = _Codes(), _Pool()
        for w in known:
            self.words[w] = len(self.words)
        self.ids.add(list(known.values()))
        self.seen = np.ones(len(known), np.int64)

    def _forget(self) -> None:
        names, seen = list(self.words), self.seen
        often = np.sort(np.argsort(-seen, kind="stable")[: self.max_words // 2])
        often = often[(seen[often] > 1) | (often == 0)]
        ids, size = self.ids.take(often)
        self._keep({names[c]: x.tolist() for c, x in zip(often.tolist(), np.split(ids, np.cumsum(size)[:-1]), strict=True)})

    def _split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts, and how many each has."""
        whole = pc.match_substring_regex(texts, _WHOLE)
        low = pc.utf8_lower(texts)
        apart = pc.replace_substring(pc.replace_substring(low, ".", " ."), ",", " ,")
        words = pc.utf8_split_whitespace(pc.if_else(pc.match_substring_regex(low, _SIGNS), low, apart))
        count = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = words.flatten()
        # empty strings at the ends of texts that begin or end with white space
        real = pc.not_equal(flat, "")
        if not pc.all(real).as_py():
            doc = np.repeat(np.arange(len(count)), count)[real.to_numpy(zero_copy_only=False)]
            flat, count = flat.filter(real), np.bincount(doc, minlength=len(count))
        if pc.any(whole).as_py():
            at = np.concatenate([[0], np.cumsum(count)])
            whole = whole.to_numpy(zero_copy_only=False)
            pieces = [texts.slice(i, 1) if whole[i] else flat.slice(at[i], count[i]) for i in range(len(count))]
            flat, count = pa.concat_arrays([p.cast(pa.string()) for p in pieces]), np.where(whole, 1, count)
        return flat, count

    def _learn(self) -> None:
        new, self.words.new = self.words.new, []
        if not new:
            return
        names = pa.array(new, pa.string())
        letters = pc.and_(pc.and_(pc.utf8_is_alpha(names), pc.utf8_is_lower(names)), pc.invert(pc.match_substring_regex(names, _WHOLE))).to_numpy(zero_copy_only=False)
        # the words of letters as the model writes their bytes, all at once
        spelled = iter(codecs.charmap_decode("\n".join(w for w, x in zip(new, letters, strict=True) if x).encode("utf-8"), "strict", _BYTES)[0].split("\n"))
        rest = iter(self.encode([w for w, x in zip(new, letters, strict=True) if not x]))
        self.ids.add([self.word(next(spelled)) if x else next(rest) for x in letters.tolist()])

    def __call__(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        if len(self.words) > self.max_words:
            self._forget()
        flat, counts = self._split(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        coded = flat.dictionary_encode()
        code = np.fromiter(map(self.words.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        self._learn()
        index = coded.indices.to_numpy(zero_copy_only=False)
        self.seen = np.concatenate([self.seen, np.zeros(len(self.words) - len(self.seen), np.int64)])
        self.seen[code] += np.bincount(index, minlength=len(code))
        codes = code.astype(np.int32)[index]
        if self.end is not None:
            codes, counts = np.insert(codes, np.cumsum(counts), 0), counts + 1
        ids, size = self.ids.take(codes)
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(counts)]
        return ids, np.diff(ends, prepend=0)


def _byte_table() -> str:
    """How byte-level models write each byte: a visible Latin-1 character as it is, the others from 256 on. The new line stays, which parts words here."""
    hidden = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
    table = {b: chr(256 + i) for i, b in enumerate(hidden)} | {10: "\n"}
    return "".join(table.get(b, chr(b)) for b in range(256))


_BYTES = _byte_table()


def word_encoder(path: str, end: int | None = None) -> WordEncoder:
    """The encoder of a byte-level tokenizers file whose normaliser lowers and whose pre-tokenizer drops white space and takes
    runs of letters, and runs of signs, as pieces of their own; one for each process."""

    def make() -> WordEncoder:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        model = t.model

        def word(w: str) -> list[int]:
            return [x.id for x in model.tokenize(w)]

        return WordEncoder(lambda words: (e.ids for e in t.encode_batch_fast(words, add_special_tokens=False)), word, end)

    return held(("words", path, end), make)
