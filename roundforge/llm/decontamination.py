"""Benchmark decontamination by suffix arrays over the training texts.

Documents are cut into shards of bounded size. A task numbers a shard's words, sorts the shard's suffixes (prefix doubling: first by the words that fit 62 bits, then by
ranks, twice as deep each time) and binary-searches every suffix of the benchmark in the sorted array, all at once, a few words deeper each time. The range of
the array in which a test suffix ends gives its longest verbatim match and all its locations. A match of a whole window (``window`` words, or all words of a
shorter item) marks its words as hit and gives the document the items that have this window. Affected documents are then removed.

Words are numbered by the benchmark's vocabulary. A word that no item has is 0 and matches nothing, so only runs of known words that are as long as the shortest
window have their suffixes in the array; and as no test suffix is longer than the longest item, suffixes are sorted only as deep. A text is sorted once in a
shard, however many copies of it the shard has.

Words: letters A-Z are lowered, and a word is a run of ASCII letters and digits and of any characters beyond ASCII.

The benchmark is broadcast in blocks of at most ``block_bytes`` of text, which are measured first. Documents pass all blocks one after the other, and
where there is more than one, the rows between two blocks are a table in the shared folder. Nothing is shuffled, and no task holds more than a shard and a block.

Defined cases: null has no words; neither have texts of signs only, which have 0 hits; a text of any length is a shard of its own if need be; repeated rows, and rows with a null or
repeated doc_id, are searched row by row; items without words are never found, items with equal texts are found together, an item_id with several rows is
one item; a null item_id counts as the empty one; an empty table gives an empty table, an empty benchmark no hits; columns of documents named like a result are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from roundforge.llm.common import as_text, in_arrow, trim, written

#: Text of a shard, and of a block of the benchmark.
SHARD_BYTES, BLOCK_BYTES = 8_000_000, 16_000_000


def _table() -> np.ndarray:
    """What each byte is read as: letters lowered, what is no part of a word a space."""
    b = np.arange(256)
    word = (b >= 0x80) | ((b >= 0x30) & (b <= 0x39)) | ((b >= 0x41) & (b <= 0x5A)) | ((b >= 0x61) & (b <= 0x7A))
    return np.where(word, np.where((b >= 0x41) & (b <= 0x5A), b + 32, b), 32).astype(np.uint8)


_READ_AS = _table()


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, and how many each has. Null has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    plain = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(_READ_AS[raw])])
    lists = pc.ascii_split_whitespace(plain)
    count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    # empty strings stand where a text begins or ends with a space
    real = pc.not_equal(flat, "")
    if not pc.all(real, min_count=0).as_py():
        doc = np.repeat(np.arange(len(count)), count)[real.to_numpy(zero_copy_only=False)]
        flat, count = flat.filter(real), np.bincount(doc, minlength=len(count))
    return flat, count


def _spread(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... of each range, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(lo - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


@dataclass
class Block:
    """A part of the benchmark: its vocabulary, and its words as numbers from 1, a 0 after each item."""

    vocabulary: pa.Array
    text: np.ndarray
    starts: np.ndarray  # of suffixes, one for each word
    whole: np.ndarray  # words of the window that begins there; 0 where too few follow
    item: np.ndarray  # of each suffix
    names: list[str]
    longest: int
    bits: int = field(init=False)

    def __post_init__(self) -> None:
        self.bits = max(1, len(self.vocabulary).bit_length())

    @property
    def step(self) -> int:
        """Words that fit one number; one more than the greatest fits too."""
        return 62 // self.bits

    @property
    def least(self) -> int:
        return int(self.whole[self.whole > 0].min()) if len(self.whole) else 0


def block_of(items: pa.Table, window: int) -> Block:
    """A block of the items of a table (item_id as string, text)."""
    flat, count = words(items.column("text").combine_chunks())
    vocabulary = flat.unique()
    ids = pc.index_in(flat, vocabulary).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    size = count[count > 0]
    first = np.cumsum(size + 1) - size - 1
    starts = _spread(first, size)
    text = np.zeros(int((size + 1).sum()) + 64, np.int64)
    text[starts] = ids
    left = np.repeat(first + size, size) - starts
    whole = np.where(left >= np.repeat(np.minimum(size, window), size), np.repeat(np.minimum(size, window), size), 0)
    names = items.column("item_id").to_pylist()
    named = [n for n, c in zip(names, count.tolist(), strict=True) if c]
    return Block(vocabulary, text, starts, whole, np.repeat(np.arange(len(size)), size), named, int(size.max(initial=0)))


def packed(text: np.ndarray, at: np.ndarray, step: int, bits: int) -> np.ndarray:
    """The ``step`` words from each place as one number; from a 0 on, nothing counts."""
    out = np.zeros(len(at), np.int64)
    on = np.ones(len(at), bool)
    for k in range(step):
        w = text[at + k]
        on &= w > 0
        out = (out << bits) | np.where(on, w, 0)
    return out


def suffix_array(text: np.ndarray, at: np.ndarray, step: int, bits: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The places ``at`` in the order of the suffixes there, compared ``depth`` words deep at least (a 0 ends a suffix); and their first numbers, sorted.

    text: ends with ``depth`` zeros and more."""
    keys = packed(text, at, step, bits)
    order = np.argsort(keys, kind="quicksort")
    at, first = at[order], keys[order]
    # rank[p]: the place of p's group in the array from 1; 0 where no suffix begins
    new = np.concatenate([[True], first[1:] != first[:-1]]) if len(at) else np.zeros(0, bool)
    group = np.flatnonzero(new)[np.cumsum(new) - 1] if len(at) else np.zeros(0, np.int64)
    rank = np.zeros(len(text), np.int64)
    rank[at] = group + 1
    low = (np.int64(1) << bits) - 1
    # a suffix whose first number ends in a 0 ended within it: it is told from no other one any more
    same = np.zeros(len(at), bool)
    same[:-1] |= ~new[1:]
    same[1:] |= ~new[1:]
    open_ = np.flatnonzero(same & (first & low > 0))
    deep = step
    while deep < depth and len(open_):
        places = at[open_]
        further = rank[places + deep]
        # the groups of open places lie one after the other, so they are sorted together
        key = rank[places] << 32 | further
        order = np.argsort(key, kind="quicksort")
        key, places = key[order], places[order]
        at[open_] = places
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[places] = open_[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] + 1
        same = np.zeros(len(key), bool)
        same[:-1] |= ~fresh[1:]
        same[1:] |= ~fresh[1:]
        open_ = open_[same & (key & 0xFFFFFFFF > 0)]
        deep *= 2
    return at, first


@dataclass
class Shard:
    """Texts as one row of numbered words, a 0 after each text, and the array of their suffixes."""

    block: Block
    text: np.ndarray
    start: np.ndarray  # of each text
    at: np.ndarray
    first: np.ndarray

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, places, "right") - 1

    def _below(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """In each range of suffixes that agree in their first ``depth`` words, the first place whose next words are ``bound`` or more."""
        lo, hi = lo.copy(), hi.copy()
        busy = np.flatnonzero(lo < hi)
        while len(busy):
            mid = (lo[busy] + hi[busy]) >> 1
            less = packed(self.text, self.at[mid] + depth[busy], self.block.step, self.block.bits) < bound[busy]
            lo[busy[less]] = mid[less] + 1
            hi[busy[~less]] = mid[~less]
            busy = busy[lo[busy] < hi[busy]]
        return lo

    def narrow(self, suffix: np.ndarray, depth: np.ndarray, more: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of each range whose next ``more`` words (at most as many as fit one number) are those of the test suffix."""
        b = self.block
        free = b.bits * (b.step - more)
        least = packed(b.text, suffix + depth, b.step, b.bits) >> free << free
        beyond = least + (np.int64(1) << free)
        if not depth.any():
            # at the beginning of suffixes their first numbers are at hand
            return np.searchsorted(self.first, least, "left"), np.searchsorted(self.first, beyond, "left")
        lo = self._below(lo, hi, depth, least)
        return lo, self._below(lo, hi, depth, beyond)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the test suffixes whose window occurs: their numbers, and the range of places."""
        b = self.block
        s = np.flatnonzero(b.whole)
        depth, lo, hi = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64), np.full(len(s), len(self.at))
        while True:
            more = np.minimum(b.step, b.whole[s] - depth)
            go = np.flatnonzero(more)
            if not len(go):
                return s, lo, hi
            lo[go], hi[go] = self.narrow(b.starts[s[go]], depth[go], more[go], lo[go], hi[go])
            depth[go] += more[go]
            on = lo < hi
            s, depth, lo, hi = s[on], depth[on], lo[on], hi[on]

    def longest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the test suffixes whose window occurs: their numbers, the words of their longest match, and the range of its places."""
        b = self.block
        s, lo, hi = self.windows()
        depth = b.whole[s].copy()
        ends = np.concatenate([b.starts[1:], [0]]) != b.starts + 1  # the last suffix of an item
        left = np.flatnonzero(ends)
        end = b.starts[left[np.searchsorted(left, s)]] + 1 if len(s) else s
        for more in (b.step, *(1 << k for k in reversed(range(b.step.bit_length())))):
            if more > b.step:
                continue
            busy = np.arange(len(s))
            while len(busy):
                busy = busy[b.starts[s[busy]] + depth[busy] + more <= end[busy]]
                if not len(busy):
                    break
                x, y = self.narrow(b.starts[s[busy]], depth[busy], np.full(len(busy), more), lo[busy], hi[busy])
                found = x < y
                busy, x, y = busy[found], x[found], y[found]
                lo[busy], hi[busy] = x, y
                depth[busy] += more
                if more < b.step:
                    break
        return s, depth, lo, hi


def shard_of(block: Block, flat: pa.Array, count: np.ndarray) -> Shard:
    """The shard of texts with these words."""
    ids = pc.fill_null(pc.index_in(flat, block.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    start = np.cumsum(count + 1) - count - 1
    text = np.zeros(int((count + 1).sum()) + block.longest + 64, np.int64)
    text[_spread(start, count)] = ids
    known = np.flatnonzero(np.diff((text > 0).astype(np.int8)))
    runs = known[1::2] - known[::2] if text[0] == 0 else np.diff(np.concatenate([[-1], known]))[::2]
    begin = known[::2] + 1 if text[0] == 0 else np.concatenate([[0], known[1::2] + 1])
    long = runs >= max(1, block.least)
    at, first = suffix_array(text, _spread(begin[long], runs[long]), block.step, block.bits, block.longest)
    return Shard(block, text, start, at, first)


@dataclass
class Found:
    """What a shard's texts have in common with a block: runs of hit words, by text, and pairs of a text and a name of an item."""

    text: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    pair_text: np.ndarray
    pair_name: np.ndarray


def found(shard: Shard, pairs_at_once: int = 2_000_000) -> Found:
    b = shard.block
    s, lo, hi = shard.windows()
    # windows with the same words have the same range
    ranges, which = np.unique(np.stack([lo, hi, b.whole[s]]), axis=1, return_inverse=True)
    lo, hi, size = ranges
    places = shard.at[_spread(lo, hi - lo)]
    rise = np.bincount(places, minlength=len(shard.text)) - np.bincount(places + np.repeat(size, hi - lo), minlength=len(shard.text))
    hit = np.diff(np.concatenate([[0], (np.cumsum(rise) > 0).astype(np.int8), [0]]))
    begin, end = np.flatnonzero(hit > 0), np.flatnonzero(hit < 0)
    of = shard.text_of(begin)
    # each window's texts and each window's items
    n = len(shard.start) + 1
    texts = np.unique(np.repeat(np.arange(len(lo)), hi - lo) * n + shard.text_of(places))
    items = np.unique(which.reshape(-1) * (len(b.names) + 1) + b.item[s])
    window, text = texts // n, texts % n
    of_window, item = items // (len(b.names) + 1), items % (len(b.names) + 1)
    first, many = np.searchsorted(of_window, window, "left"), np.searchsorted(of_window, window, "right")
    many -= first
    rank = {name: k for k, name in enumerate(sorted(set(b.names)))}
    of_item = np.array([rank[name] for name in b.names], np.int64)
    got, at, total = np.zeros(0, np.int64), 0, np.cumsum(many)
    while at < len(window):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + pairs_at_once, "right")))
        names = of_item[item[_spread(first[at:to], many[at:to])]]
        got = np.union1d(got, np.repeat(text[at:to], many[at:to]) * len(rank) + names)
        at = to
    return Found(of, begin - shard.start[of], end - shard.start[of], got // max(1, len(rank)), got % max(1, len(rank)))


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(a + b):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _shards(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.Table]:
    held, total = [], 0
    for b in batches:
        held.append(b)
        total += b.column(column).nbytes
        if total >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, total = [], 0
            trim()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _distinct(table: pa.Table, column: str) -> tuple[pa.Array, np.ndarray]:
    """The different texts, and the number of each row's text."""
    coded = pc.fill_null(table.column(column).combine_chunks(), "").dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[Block]:
    """The benchmark in blocks of about ``block_bytes`` of text; whose block an item is follows from its id and text."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), as_text().alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield block_of(part.toArrow(), window)


#: What spans() adds.
_ADDED = "n_words long, hit_starts array<int>, hit_ends array<int>, items array<string>"
_NAMES = ("n_words", "hit_starts", "hit_ends", "items")


def _pass(df: DataFrame, block, shard_bytes: int) -> DataFrame:
    """Adds a block's hits to those that the rows have. block: a broadcast."""
    kept = [f for f in df.schema if f.name not in _NAMES]
    schema = StructType(kept + list(StructType.fromDDL(_ADDED)))
    lists = {"hit_starts": pa.list_(pa.int32()), "hit_ends": pa.list_(pa.int32()), "items": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        names = sorted(set(b.names))
        for t in _shards(batches, "__text", shard_bytes):
            texts, row_text = _distinct(t, "__text")
            flat, count = words(texts)
            f = found(shard_of(b, flat, count))
            spans: dict[int, list[tuple[int, int]]] = {}
            for k, lo, hi in zip(f.text.tolist(), f.begin.tolist(), f.end.tolist(), strict=True):
                spans.setdefault(k, []).append((lo, hi))
            items: dict[int, list[str]] = {}
            for k, name in zip(f.pair_text.tolist(), f.pair_name.tolist(), strict=True):
                items.setdefault(k, []).append(names[name])
            before = {n: t.column(n).to_pylist() for n in lists}
            made: dict[str, list] = {n: [] for n in lists}
            for i, k in enumerate(row_text.tolist()):
                runs = _merged(list(zip(before["hit_starts"][i], before["hit_ends"][i], strict=True)), spans.get(k, []))
                made["hit_starts"].append([x for x, _ in runs])
                made["hit_ends"].append([x for _, x in runs])
                made["items"].append(sorted({*before["items"][i], *items.get(k, [])}))
            columns = [t.column(x.name) for x in kept] + [pa.array(count[row_text], pa.int64())] + [pa.array(made[n], kind) for n, kind in lists.items()]
            yield from pa.Table.from_arrays(columns, names=[x.name for x in schema]).to_batches(max_chunksize=4096)

    return in_arrow(df, run, schema)


def spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of every row with n_words, runs of hit words (hit_starts, hit_ends: places of words, end exclusive) and items, sorted as strings."""
    rows = docs.select(*(keep if keep is not None else [c for c in docs.columns if c not in _NAMES]), as_text().alias("__text"))
    rows = rows.withColumns({"n_words": F.lit(0).cast("long"), "hit_starts": F.array().cast("array<int>"), "hit_ends": F.array().cast("array<int>"), "items": F.array().cast("array<string>")})
    for k, block in enumerate(blocks(benchmark, window, block_bytes)):
        rows = _pass(written(rows, "decontamination") if k else rows, docs.sparkSession.sparkContext.broadcast(block), shard_bytes)
    return rows.drop("__text")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows, as they came, without those that have a window of the benchmark."""
    return spans(docs.withColumn("__row", F.struct(*docs.columns)), benchmark, window, keep=["__row"]).filter(F.size("items") == 0).select("__row.*")


def digests(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y)
    hit = total("hit_ends") - total("hit_starts")
    sha = F.sha2(F.array_join("items", ","), 256)
    return spans(docs, benchmark, window, keep=["doc_id"]).select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256"), (hit > 0).alias("contaminated"))


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every test suffix (item_id, item_start: its first word) whose window occurs, the words of its longest verbatim match in all documents
    (n_matched) and every place of it: doc_id and doc_start. Copies are places of their own."""
    schema = "item_id string, item_start int, n_matched int, doc_id long, doc_start int"
    rows, context = docs.select("doc_id", as_text().alias("__text")), docs.sparkSession.sparkContext

    def task(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b: Block = block.value
            item_first = np.searchsorted(b.item, b.item)
            for t in _shards(batches, "__text", shard_bytes):
                texts, row_text = _distinct(t, "__text")
                shard = shard_of(b, *words(texts))
                s, depth, lo, hi = shard.longest()
                by_text = np.argsort(row_text, kind="stable")
                for i in range(0, len(s), 1000):
                    part = slice(i, i + 1000)
                    size = hi[part] - lo[part]
                    places = shard.at[_spread(lo[part], size)]
                    of = shard.text_of(places)
                    # a row for each copy of the text
                    first, many = np.searchsorted(row_text[by_text], of, "left"), np.searchsorted(row_text[by_text], of, "right")
                    row = by_text[_spread(first, many - first)]
                    test = np.repeat(np.repeat(s[part], size), many - first)
                    place = np.repeat(places - shard.start[of], many - first)
                    columns = [pa.array(b.names).take(pa.array(b.item[test])), pa.array((test - item_first[test]).astype(np.int32)), pa.array(np.repeat(np.repeat(depth[part], size), many - first).astype(np.int32)), t.column("doc_id").combine_chunks().take(pa.array(row)), pa.array(place.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["item_id", "item_start", "n_matched", "doc_id", "doc_start"])

        return run

    parts = [in_arrow(rows, task(context.broadcast(b)), schema) for b in blocks(benchmark, window, block_bytes)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = written(out, "matches")
    best = out.groupBy("item_id", "item_start").agg(F.max("n_matched").alias("n_matched"))
    return out.join(best, ["item_id", "item_start", "n_matched"], "left_semi")
