"""Mixture-controlled packing of tokenised documents into sequences.

Deficit round-robin over source queues: in every window of ``window_sequences`` sequences each source is
credited its target share of the window's tokens, and its queue is served up to its credit; the unserved
fraction of a token is its deficit and is carried to the next window, also from one partition to the
next. When a queue runs dry, its share goes to the others in proportion. Served documents are cut at the end
of their credit and where a sequence ends, so sequences have no gaps and only the last is padded.

Targets are weights by source, or the sources' token counts to the power ``flatten``: at 1 the mixture is that of the table, at
0 all sources are alike, and between them large sources wait for small ones. Each piece tells its window, and how many tokens
the window is off its targets in the source that is furthest off: under a token while no queue has run dry.

After w windows a source has been credited a whole number of tokens that follows from w and the queues' lengths
alone. So each partition works out the place of every token in its documents by itself: it
needs the tokens of its sources in the partitions before, one small row for each partition and source,
and no document is moved. Token ids are written once to a table in the shared folder, whose rows name their partition.

Defined cases: a null text is empty and has the end id only; a null source is the source ''; rows with a null or repeated
doc_id are packed one by one, as often as they occur; a document of any length is encoded whole, by itself in a slice, and
cut into as many pieces as it fills; equal weights are served in the order of the sources' names; an empty table gives no
pieces; extra columns, also those named like a result, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roundforge.llm.common import BROADCAST_IDS, as_text, in_arrow, slices, trim, written
from roundforge.llm.tokens import word_encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, window long, deviation double"
BATCH = 20_000
#: Text that is encoded at a time: more of it has fewer different words in proportion.
SLICE = 4_000_000


@dataclass(frozen=True)
class PackConfig:
    """weights: the target token shares of sources; sources that weights lacks have weight 1. None: their shares of all
    tokens to the power flatten."""

    tokenizer: str
    sequence: int = 2048
    end_id: int = 1
    window_sequences: int = 16
    weights: Mapping[str, float] | None = None
    flatten: float = 1.0

    def targets(self, sources: list[str], queues: list[int]) -> list[int]:
        """Weights in whole numbers."""
        if self.weights is not None:
            return [max(1, round(1_000_000 * self.weights.get(s, 1.0))) for s in sources]
        if self.flatten == 1.0:
            return queues
        return [max(1, round(1_000_000 * q**self.flatten)) for q in queues]


def encode(docs: DataFrame, config: PackConfig) -> DataFrame:
    """The token ids (little-endian, 16 or 32 bits) of each document with the end id, written to a table.

    part: the partition that encoded the row; before: its source's tokens earlier in that partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(config.tokenizer, config.end_id)
        part, queued = TaskContext.get().partitionId(), {}
        for b in (x for batch in batches for x in slices(batch, "_text", SLICE)):
            ids, sizes = encoder(b.column("_text"))
            ends = np.cumsum(sizes)
            before = []
            sources = b.column("source").to_pylist()
            for s, n in zip(sources, sizes.tolist(), strict=True):
                before.append(queued.get(s, 0))
                queued[s] = before[-1] + n
            width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
            raw = np.ascontiguousarray(ids.astype(f"<u{width}"))
            cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(width * np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
            same = lambda x: pa.array(np.full(len(ends), x, np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), same(part), pa.array(before, pa.int64()), pa.array(sizes), same(width), cells], names=["doc_id", "source", "part", "before", "n", "width", "ids"])

    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), as_text().alias("_text"))
    return written(in_arrow(rows, run, "doc_id long, source string, part int, before long, n long, width int, ids binary", "words"), "tokens")


class Credits:
    """Tokens credited to each source after so many windows, in whole numbers; at last all that its queue holds."""

    def __init__(self, queues: list[int], weights: list[int], window: int) -> None:
        self.queues, self.weights, self.window, self.seen = queues, weights, window, {}
        self.phases: list[tuple[int, list[int], list[int]]] = []  # from which token on, credited so far, weights
        credited, at = [0] * len(queues), 0
        while any(c < q for c, q in zip(credited, queues, strict=True)):
            active = [w if c < q else 0 for c, q, w in zip(credited, queues, weights, strict=True)]
            total = sum(active)
            self.phases.append((at, list(credited), active))
            left = [(-(-(q - c) * total // w)) for c, q, w in zip(credited, queues, active, strict=True) if w]
            at += min(left)
            credited = self._credited(at)
        self.windows = -(-at // window)
        self.end = at

    def _credited(self, at: int) -> list[int]:
        start, so_far, active = next(p for p in reversed(self.phases) if p[0] <= at)
        total = sum(active)
        return [min(q, c + (at - start) * w // total) for q, c, w in zip(self.queues, so_far, active, strict=True)]

    def after(self, windows: int) -> list[int]:
        if windows not in self.seen:
            if len(self.seen) > 4096:
                self.seen.clear()
            at = windows * self.window
            self.seen[windows] = self._credited(at) if at < self.end else self.queues
        return self.seen[windows]

    def deviation(self, windows: int) -> float:
        """By how many tokens the next window is off the target of the source that is furthest off."""
        total = sum(self.weights)
        now, then = self.after(windows), self.after(windows + 1)
        return max(abs(b - a - self.window * w / total) for a, b, w in zip(now, then, self.weights, strict=True))

    def window_of(self, source: int, token: int) -> int:
        """The window in which a token of a queue is served."""
        lo, hi = 0, max(1, self.windows)
        while lo + 1 < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self._one(source, mid) <= token else (lo, mid)
        return lo

    def _one(self, source: int, windows: int) -> int:
        at = windows * self.window
        if at >= self.end:
            return self.queues[source]
        start, so_far, active = next(p for p in reversed(self.phases) if p[0] <= at)
        return min(self.queues[source], so_far[source] + (at - start) * active[source] // sum(active))


def served(credits: Credits, source: int, first: int, n: int, sequence: int) -> Iterator[tuple[int, int, int, int]]:
    """The pieces (start, length, place among all tokens, window) of the n tokens of a queue from ``first`` on."""
    done, w = 0, credits.window_of(source, first)
    while done < n:
        now, then = credits.after(w), credits.after(w + 1)
        token = first + done
        if then[source] <= token:
            w += 1
            continue
        place = sum(now) + sum(then[:source]) - sum(now[:source]) + token - now[source]
        length = min(n - done, then[source] - token, sequence - place % sequence)
        yield done, length, place, w
        done += length


def cuts(credits: Credits, source: int, first: int, n: int, sequence: int) -> Iterator[tuple[int, int, int]]:
    """The pieces without their windows."""
    return (x[:3] for x in served(credits, source, first, n, sequence))


def pack(docs: DataFrame, config: PackConfig) -> DataFrame:
    """The pieces of all documents, each id in exactly one, with PIECES as columns."""
    tokens = encode(docs, config)
    parts = tokens.groupBy("part", "source").agg(F.sum("n").alias("tokens"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = written(parts.withColumn("earlier", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).cast("long")), "parts")
    totals = {r["source"]: r["n"] for r in parts.groupBy("source").agg(F.sum("tokens").cast("long").alias("n")).collect()}
    sources = sorted(totals)
    queues = [totals[s] for s in sources]
    weights = config.targets(sources, queues)
    number, window, sequence = {s: i for i, s in enumerate(sources)}, config.window_sequences * config.sequence, config.sequence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        credits = Credits(queues, weights, window)
        rows: list[tuple] = []
        off: dict[int, float] = {}

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            types = [*[pa.int64()] * 7, pa.string(), pa.int64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("doc_id", "source", "before", "earlier", "n", "width")]
            for doc, source, before, earlier, n, width, raw in zip(*columns, b.column("ids"), strict=True):
                ids = np.frombuffer(raw.as_buffer(), f"<u{width}").astype("<u4")
                for start, length, place, w in served(credits, number[source], earlier + before, n, sequence):
                    if w not in off:
                        off[w] = credits.deviation(w)
                    rows.append((doc, start, length, zlib.crc32(ids[start : start + length]), n, place // sequence, place % sequence, source, w, off[w]))
                if len(rows) >= BATCH:
                    yield out()
                    rows = []
                    off.clear()
            trim()
        if rows:
            yield out()

    small = parts.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    earlier = parts.select("part", "source", "earlier")
    return in_arrow(tokens.join(F.broadcast(earlier) if small else earlier, ["part", "source"]), run, PIECES)
