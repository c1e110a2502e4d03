"""N-gram Jaccard self-join with a MinHash LSH forest and exact verification.

1. Rows get numbers of their own, as doc_id may repeat or be null. Every text becomes its set of word n-grams (64-bit hashes). Texts with
   equal sets are one class, told by a digest of the set; from here on only the first row stands for a class.
2. The forest: ``trees`` prefix tries over MinHash signatures of ``max_depth`` one-byte values. A trie is its signatures in sorted
   order: all tries are one table, dealt out by range and sorted, where rows with a long common prefix are neighbours.
3. Matched prefixes start max_depth values long and are shortened until the target recall. The recall is that of links just at the threshold, the
   hardest there are: two sets have a MinHash value in common with the probability of their similarity, so a prefix of d values with threshold^d, and
   that gives the probability that a pair has it in fewer than ``min_trees``. No documents are drawn for it, as pairs of drawn ones may be easier than a link of
   others: edited copies of short texts are never just at the threshold.
4. Walking the sorted tries, the rows below one prefix are a node. A small node gives all its pairs, which count if they meet in
   ``min_trees`` trees; a large node, or one that a partition's end cuts, gives an edge from each row to its first. So nothing
   grows with the square of a node, and no node must lie in one task. The components of this graph hold every candidate pair.
5. Exact verification: a component is dealt into blocks of bounded size by a hash, each pair of
   blocks is one unit of work, and the n-gram overlaps of all its pairs are counted by matrix products. The units of a component go
   to partitions in turn. A unit returns a row for each document: its verified links, and its least verified companion.
6. Verified links make the classes; links between different texts are all counted, none is sampled.

Words are what white space separates, as written. Texts of fewer words than n have one n-gram, the
whole text. Defined cases: null is the empty text; all texts without a word are copies of each other;
repeated rows, and rows with the same or no doc_id, are rows of their own and may be copies or near copies of each other; the class
id is null if no row of the class has a doc_id; texts of any length are hashed whole; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundforge.llm.common import BROADCAST_IDS, ROW, as_text, checkpointed, in_arrow, map_texts, numbered, trim, without, written

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_CHUNK = 1 << 16
#: Words of the longest text that measured_depth() takes.
SAMPLE_WORDS = 5000
_CELLS = 1 << 22  # of a dense piece of the document by n-gram matrix


@dataclass(frozen=True)
class JoinConfig:
    """block_grams, block_docs: n-grams and documents of a block in verification. small_bucket: rows of a
    node up to which all its pairs are candidates; larger ones are linked through their first row."""

    words: int = 5
    threshold: float = 0.8
    trees: int = 64
    max_depth: int = 8
    min_trees: int = 2
    target_recall: float = 0.999999
    small_bucket: int = 24
    block_grams: int = 300_000
    block_docs: int = 128

    def recall(self, rate: float) -> float:
        """The probability that a pair meets in min_trees trees, each of which it meets in at this rate."""
        return 1 - sum(_choose(self.trees, k) * rate**k * (1 - rate) ** (self.trees - k) for k in range(self.min_trees))

    def shortened(self, rates: list[float]) -> int:
        """The longest prefix with the target recall; rates: the share of trees that have a common prefix of 1, 2, ... values."""
        depth = self.max_depth
        while depth > 1 and self.recall(rates[depth - 1]) < self.target_recall:
            depth -= 1
        return depth

    @property
    def depth(self) -> int:
        """The length of matched prefixes: links at the threshold have the target recall, whatever the documents."""
        return self.shortened([self.threshold**d for d in range(1, self.max_depth + 1)])


def _choose(n: int, k: int) -> float:
    out = 1.0
    for i in range(k):
        out = out * (n - i) / (i + 1)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def gram_hashes(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all n-grams, text by text, and how many each text has (one at least)."""
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    flat = np.array([w for ws in split for w in ws], dtype=object)
    h = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)
    grams = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        grams = grams * _MUL + h[i : i + len(grams)]
    start = np.concatenate([[0], np.cumsum(sizes)])
    counts = np.maximum(1, sizes - n + 1)
    out = np.empty(int(counts.sum()), np.uint64)
    to = np.concatenate([[0], np.cumsum(counts)])
    full = np.flatnonzero(sizes >= n)
    if len(full):
        at = np.repeat(start[full] - to[full], counts[full]) + np.concatenate([np.arange(to[i], to[i + 1]) for i in full])
        out[at - np.repeat(start[full] - to[full], counts[full])] = grams[at]
    for i in np.flatnonzero(sizes < n):
        x = np.uint64(sizes[i] + 1)
        for y in h[start[i] : start[i + 1]]:
            with np.errstate(over="ignore"):
                x = x * _MUL + y
        out[to[i]] = x
    return _mixed(out), counts


def signatures(grams: np.ndarray, counts: np.ndarray, config: JoinConfig) -> np.ndarray:
    """For each set of n-grams its key in each tree: max_depth MinHash values of a byte each, the first one on top."""
    k = config.trees * config.max_depth
    rng = np.random.default_rng(17)
    flip, mul = rng.integers(0, 2**63, k, dtype=np.uint64), rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    to = np.concatenate([[0], np.cumsum(counts)])
    least = np.empty((len(counts), k), np.uint64)
    i = 0
    while i < len(counts):
        j = max(i + 1, int(np.searchsorted(to, to[i] + _CHUNK, "right")) - 1)
        part, starts = grams[to[i] : to[j]], to[i:j] - to[i]
        for c in range(k):
            least[i:j, c] = np.minimum.reduceat((part ^ flip[c]) * mul[c], starts)
        i = j
    byte = (_mixed(least * _MUL) >> np.uint64(56)).reshape(len(counts), config.trees, config.max_depth)
    key = np.zeros((len(counts), config.trees), np.uint64)
    for d in range(config.max_depth):
        key |= byte[:, :, d] << np.uint64(56 - 8 * d)
    return key


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes two keys share."""
    differ = a ^ b
    return sum((differ >> np.uint64(56 - 8 * d) == 0).astype(np.int64) for d in range(8))


def signed_texts(texts: list[str], config: JoinConfig) -> dict[str, list]:
    """For each text: the digest of its set of n-grams, the set's size, and its key in each tree."""
    grams, counts = gram_hashes(texts, config.words)
    to = np.concatenate([[0], np.cumsum(counts)])
    digest, size = [], []
    for i in range(len(texts)):
        own = np.unique(grams[to[i] : to[i + 1]])
        digest.append(hashlib.md5(own.tobytes()).digest())
        size.append(len(own))
    return {"digest": digest, "size": size, "keys": list(signatures(grams, counts, config).view(np.int64))}


def edited(text: str, config: JoinConfig, rng: random.Random) -> str | None:
    """The text with words replaced, as many as leave it similar enough for a link; None if one is too many."""
    words, n = text.split(), config.words
    own = set(zip(*(words[i:] for i in range(n)), strict=False))
    order = list(range(len(words)))
    rng.shuffle(order)

    def replaced(k: int) -> list[str]:
        out = list(words)
        for i in range(k):
            out[order[i]] = f"\u0001{i}"
        return out

    lo, hi = 0, len(words)
    while lo + 1 < hi:
        mid = (lo + hi) // 2
        now = replaced(mid)
        grams = set(zip(*(now[i:] for i in range(n)), strict=False))
        common = len(own & grams)
        lo, hi = (mid, hi) if common >= config.threshold * (len(own) + len(grams) - common) else (lo, mid)
    return " ".join(replaced(lo)) if lo else None


def measured_depth(texts: list[str], config: JoinConfig) -> int:
    """The length to which prefixes would be shortened for pairs of these texts and edited copies: a check of JoinConfig.depth by tests, which no join uses."""
    rng = random.Random(3)
    pairs = [(t, e) for t in texts if 4 * config.words <= len(t.split()) <= SAMPLE_WORDS and (e := edited(t, config, rng))]
    if len(pairs) < 8:
        return config.depth
    keys = signatures(*gram_hashes([t for pair in pairs for t in pair], config.words), config)
    shared = common_prefix(keys[::2], keys[1::2])
    return config.shortened([float((shared >= d).mean()) for d in range(1, config.max_depth + 1)])


def hooked(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: each node a hangs on the least of its smaller neighbours b, and so do the others of them."""
    hung = edges.filter("a > b").groupBy("a").agg(F.min("b").alias("least"), F.collect_set("b").alias("others"))
    hung = checkpointed(hung)
    rest = hung.select(F.explode("others").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
    return hung.select("a", F.col("least").alias("b")).union(rest)


def components(edges: DataFrame) -> DataFrame:
    """The connected components of ``edges`` (a, b), a row (node, root) for each node; root is the least node.

    Least labels spread along edges and by pointer jumping until nothing changes. Each round is
    checkpointed in the shared folder; nothing but a count comes to the driver."""
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        spread = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        spread = checkpointed(spread)
        up = spread.select(F.col("node").alias("at"), F.col("root").alias("up"))
        jumped = checkpointed(spread.join(up, spread["root"] == up["at"]).select("node", "was", F.least("root", "up").alias("root")))
        labels = jumped.select("node", "root")
        if jumped.filter(F.col("was") != F.col("root")).isEmpty():
            return labels


PAIR, STAR, OPEN = 0, 1, 2


def walk(tries: DataFrame, depth: int, config: JoinConfig) -> DataFrame:
    """Rows (kind, a, b) of the nodes ``depth`` values deep. tries: tree, key, doc, each partition sorted by tree and key.

    PAIR: two rows of a small node. STAR: a row of another node, and the first row of that node in this partition. OPEN: the first or
    last node of a partition, told by a hash, and its first row there; the node may go on in another partition."""
    shift = np.uint64(64 - 8 * depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # the node at the end of what was read, or its first row if it is large
        large, first = False, True

        def closed(node: np.ndarray, doc: np.ndarray, large: bool, first: bool, last: bool) -> list[tuple]:
            """What whole nodes, one after the other, give; large and first tell of the first one, last of the last one."""
            starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
            size = np.diff(np.append(starts, len(node)))
            star = size > config.small_bucket
            out = []
            if len(size):
                star[0] |= large or first
                star[-1] |= last
                ends = np.array([k for k, x in ((0, first), (len(size) - 1, last)) if x], np.int64)
                out.append((OPEN, node[starts[ends]].view(np.int64), doc[starts[ends]]))
            centre, starred = np.repeat(doc[starts] if len(size) else doc, size), np.repeat(star, size)
            own = starred & (centre != doc)
            out.append((STAR, doc[own], centre[own]))
            node, doc = node[~starred], doc[~starred]
            for k in range(1, config.small_bucket):
                same = node[k:] == node[:-k]
                if not same.any():
                    break
                out.append((PAIR, np.maximum(doc[k:], doc[:-k])[same], np.minimum(doc[k:], doc[:-k])[same]))
            return out

        def rows(parts: list[tuple]) -> pa.RecordBatch:
            kind = np.concatenate([np.full(len(a), k, np.int32) for k, a, _ in parts])
            return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([a for _, a, _ in parts])), pa.array(np.concatenate([b for _, _, b in parts]))], names=["kind", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, tree = batch.column("key").to_numpy().view(np.uint64), batch.column("tree").to_numpy().astype(np.uint64)
            node = np.concatenate([kept[0], _mixed(((key >> shift) + np.uint64(1)) * _MUL + tree * _MIX)])
            doc = np.concatenate([kept[1], batch.column("doc").to_numpy()])
            tail = int(np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))[-1])
            if tail:
                yield rows(closed(node[:tail], doc[:tail], large, first, False))
                large = first = False
            kept = node[tail:], doc[tail:]
            if len(kept[0]) > config.small_bucket:  # its first row stands for those that are linked to it
                yield rows([(STAR, kept[1][1:], np.full(len(kept[1]) - 1, kept[1][0]))])
                kept, large = (kept[0][:1], kept[1][:1]), True
        if len(kept[0]):
            yield rows(closed(*kept, large, first, True))

    return in_arrow(tries, run, "kind int, a long, b long")


def candidate_edges(reps: DataFrame, depth: int, config: JoinConfig) -> DataFrame:
    """Edges (a, b), a > b, between representatives that share prefixes of this length."""
    rows = reps.select(F.posexplode("keys").alias("tree", "key"), "doc")
    # a document is in every trie once, so all rows differ and any node can be cut
    tries = rows.repartitionByRange("tree", "key", "doc").sortWithinPartitions("tree", "key", "doc")
    found = written(walk(tries, depth, config).groupBy("kind", "a", "b").agg(F.count("*").alias("met")), "nodes")
    linked = found.filter((F.col("kind") == STAR) | ((F.col("kind") == PAIR) & (F.col("met") >= config.min_trees)))
    # a pair that meets in one small node and in one large one is linked by the large one
    opened = found.filter(F.col("kind") == OPEN)
    whole = opened.groupBy("a").agg(F.min("b").alias("least"), F.collect_set("b").alias("others"))  # a row for each partition at most
    across = whole.select(F.explode("others").alias("b"), F.col("least").alias("a"))
    edges = linked.select("a", "b").union(across.select("a", "b"))
    return hooked(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))


def _overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """How many n-grams the sets have in common: left by right, or left by left."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets])
    doc = np.repeat(np.arange(len(sets)), sizes)
    _, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[gram] > 1
    doc, gram = doc[shared], (np.cumsum(count > 1) - 1)[gram[shared]]
    order = np.argsort(gram, kind="stable")
    doc, gram = doc[order], gram[order]
    n, m = len(left), len(right) if right is not None else len(left)
    out = np.zeros((n, m), np.float32)
    width = max(1, _CELLS // len(sets))
    total = int(gram[-1]) + 1 if len(gram) else 0
    for lo in range(0, total, width):
        a, b = np.searchsorted(gram, [lo, lo + width])
        cells = np.zeros((len(sets), min(width, total - lo)), np.float32)
        cells[doc[a:b], gram[a:b] - lo] = 1
        out += cells[:n] @ (cells[n:] if right is not None else cells).T
    return out


def verified(docs: np.ndarray, copies: np.ndarray, first: np.ndarray, texts: list[str], config: JoinConfig) -> tuple[np.ndarray, np.ndarray]:
    """For each document of a pair of blocks: its links, counted with copies, and its least companion.

    first: whether a document is of the first block; if all are, it's a block with itself."""
    grams, counts = gram_hashes(texts, config.words)
    to = np.concatenate([[0], np.cumsum(counts)])
    sets = [np.unique(grams[to[i] : to[i + 1]]) for i in range(len(texts))]
    order = np.argsort(~first, kind="stable")
    n = int(first.sum())
    left, right = order[:n], order[n:]
    alone = not len(right)
    other = left if alone else right
    size = np.array([len(s) for s in sets], np.float64)
    common = _overlaps([sets[i] for i in left], None if alone else [sets[i] for i in right]).astype(np.float64)
    union = size[left][:, None] + size[other][None, :] - common
    # in units of a millionth, so that a similarity of just the threshold counts
    linked = common * 1_000_000 >= union * round(config.threshold * 1_000_000)
    if alone:
        np.fill_diagonal(linked, False)
    links, least = np.zeros(len(docs), np.int64), docs.copy()
    links[left] = linked @ copies[other]
    if not alone:
        links[right] = linked.T @ copies[left]
    high = np.iinfo(np.int64).max
    while True:
        before = least.copy()
        least[left] = np.minimum(least[left], np.where(linked, least[other][None, :], high).min(1, initial=high))
        least[other] = np.minimum(least[other], np.where(linked, least[left][:, None], high).min(0, initial=high))
        if (before == least).all():
            return links, least


def verify_units(units: DataFrame, config: JoinConfig) -> DataFrame:
    """units: component, i, j, block, doc, copies, text; sorted so that a unit's rows come together."""

    def done(unit: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(unit)
        docs = t["doc"].to_numpy()
        links, least = verified(docs, t["copies"].to_numpy(), t["block"].to_numpy() == t["i"].to_numpy(), t["text"].to_pylist(), config)
        return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(links), pa.array(least)], names=["doc", "links", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            key = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("component", "i", "j")], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), len(key)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if unit and tuple(key[lo]) != last:
                    yield done(unit)
                    unit = []
                unit.append(b.slice(lo, hi - lo))
                last = tuple(key[lo])
            trim()
        if unit:
            yield done(unit)

    return in_arrow(units, run, "doc long, links long, least long")


def _classes(rows: DataFrame, config: JoinConfig) -> tuple[DataFrame, DataFrame]:
    """ROW, doc_id and digest of each row of ``rows`` (ROW, doc_id, text, a table); digest, root (the number of the class), least_id and n_links of each different set of n-grams."""
    spark = rows.sparkSession
    texts = rows.select(ROW, "doc_id", as_text().alias("_text"))
    signed = written(map_texts(texts, lambda t: signed_texts(t, config), "digest binary, size int, keys array<long>"), "signed")
    reps = signed.groupBy("digest").agg(F.min(ROW).alias("doc"), F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    reps = written(reps, "reps")
    grouped = components(candidate_edges(reps, config.depth, config)).select(F.col("node").alias("doc"), F.col("root").alias("component"))
    members = checkpointed(reps.select("doc", "copies", "size").join(grouped, "doc"))
    blocks = members.groupBy("component").agg(F.ceil(F.greatest(F.sum("size") / config.block_grams, F.count("*") / config.block_docs)).cast("int").alias("blocks"))
    members = checkpointed(members.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("doc"), "blocks").cast("int")))
    small = members.limit(BROADCAST_IDS).count() < BROADCAST_IDS // 4  # its rows are wider than an id
    own = texts.select(F.col(ROW).alias("doc"), F.col("_text").alias("text")).join(F.broadcast(members) if small else members, "doc")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    units = own.select("component", "blocks", "block", "doc", "copies", "text", other)
    units = units.select("component", "blocks", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc", "copies", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.pmod(F.pmod(F.xxhash64("component"), F.lit(parts)) + F.col("i").cast("long") * F.col("blocks") + F.col("j"), F.lit(parts)).cast("int")
    units = units.repartitionById(parts, place).drop("blocks").sortWithinPartitions("component", "i", "j")
    found = written(verify_units(units, config), "verified")
    links = found.groupBy("doc").agg(F.sum("links").alias("links"))
    classes = components(hooked(found.select(F.col("doc").alias("a"), F.col("least").alias("b"))))
    result = (
        reps.select("digest", "doc", "copies", "least_id")
        .join(links, "doc", "left")
        .join(classes.select(F.col("node").alias("doc"), "root"), "doc", "left")
        .select("digest", F.coalesce("root", "doc").alias("root"), "least_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    return signed.select(ROW, "doc_id", "digest"), written(result, "classes")


def join(docs: DataFrame, config: JoinConfig = JoinConfig()) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, class_id (the least doc_id that links of
    similarity >= threshold connect), n_links (other rows as similar, copies included)."""
    rows, classes = _classes(numbered(docs.select("doc_id", "text"), "join-rows"), config)
    # a table, so that the join can split a large class
    ids = written(classes.groupBy("root").agg(F.min("least_id").alias("class_id")), "ids")
    return rows.join(classes.join(ids, "root"), "digest").select("doc_id", "class_id", "n_links")


def deduplicate(docs: DataFrame, config: JoinConfig = JoinConfig()) -> DataFrame:
    """``docs`` with one row of each class, one with the least doc_id; null comes last. Rows with the same doc_id, or none, are rows of their own."""
    rows = numbered(docs, "dedupe-rows")
    own, classes = _classes(rows, config)
    linked = written(own.join(classes.filter("n_links > 0"), "digest").select(ROW, "doc_id", "root"), "linked")
    first = linked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", ROW)).alias("first")).select(f"first.{ROW}")
    return without(rows, linked.join(first, ROW, "left_anti"), ROW).select(*docs.columns)
