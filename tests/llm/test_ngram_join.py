from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from roundforge.llm import ngram_join
from roundforge.llm.ngram_join import JoinConfig


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        sets[i] = frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)])
    root = {i: i for i in sets}
    links = defaultdict(int)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            o = len(sets[a] & sets[b])
            if 10 * o >= 8 * (len(sets[a]) + len(sets[b]) - o):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


def planted(seed, groups=12, size=9, extra=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows, i = [], 0
    passage = " ".join(word() for _ in range(60))
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([8, 30, 200]))]
        for _ in range(rng.randint(1, size)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = word()
            rows.append((i, " ".join(own)))
            i += 1
    for _ in range(extra):
        rows.append((i, " ".join(word() for _ in range(rng.randint(0, 40))) + " " + passage))
        i += 1
    return rows


@pytest.mark.parametrize("config", [JoinConfig(), JoinConfig(small_bucket=2, block_grams=600)])
def test_equals_brute_force(spark, config):
    rows = planted(5)
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), config).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == brute(rows)


def test_a_large_group_in_blocks(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        own[rng.randrange(120)] = f"v{i}"
        rows.append((i, " ".join(own)))
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), JoinConfig(block_grams=2000)).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == brute(rows)


def test_odd_rows(odd, none):
    got = ngram_join.join(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["class_id"] == by[2]["class_id"] == by[3]["class_id"] == 1 and by[1]["n_links"] == 2
    assert by[4]["class_id"] == by[5]["class_id"] == by[6]["class_id"] == by[10]["class_id"] == 4 and by[8]["n_links"] == 1
    assert ngram_join.join(none).count() == 0
    kept = ngram_join.deduplicate(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} >= {1, 4, 7, 8, 9}


def rows_brute(texts):
    """Links of each row to all other rows, whatever their ids."""
    sets = [brute_set(t) for t in texts]
    return [sum(i != j and 10 * len(a & b) >= 8 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]


def brute_set(t):
    w = (t or "").split()
    return frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)])


def test_repeated_and_null_ids(spark):
    t = " ".join(f"word{i}" for i in range(30))
    other = " ".join(f"other{i}" for i in range(30))
    rows = [(1, t), (1, t), (2, t + " extra"), (3, other), (3, other + " more"), (None, t + " x"), (None, "a lone text of six words")]
    got = sorted(tuple(r) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).fillna(-1).collect())
    want = rows_brute([x for _, x in rows])
    assert want == [3, 3, 3, 1, 1, 3, 0]
    assert got == sorted(zip([1, 1, 2, 3, 3, -1, -1], [1, 1, 1, 3, 3, 1, -1], want, strict=True))
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in ngram_join.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [k[0] for k in kept] == [0, 1, 3]


def test_a_table_with_repeated_ids_equals_brute_force(spark):
    rows = [(i // 3, t) for i, t in planted(11)]
    got = sorted((r["doc_id"], r["n_links"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(zip([i for i, _ in rows], rows_brute([t for _, t in rows]), strict=True))


def plain_nodes(rows, depth):
    nodes = defaultdict(list)
    for tree, key, doc in rows:
        nodes[tree, (key % 2**64) >> (64 - 8 * depth)].append(doc)
    return [n for n in nodes.values() if len(n) > 1]


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_nodes_of_the_sorted_tries(spark, parts):
    """Every node is linked, small whole ones pair by pair, however partitions and batches cut the tries."""
    rng = random.Random(parts)
    rows = [(tree, rng.choice([1, 2, 300, rng.randrange(2**24)]) << 40 | rng.randrange(2**40), doc) for tree in range(5) for doc in range(400)]
    rows = [(t, k - 2**64 if k >= 2**63 else k, d) for t, k, d in rows]
    config = JoinConfig(small_bucket=6)
    tries = spark.createDataFrame(rows, "tree int, key long, doc long").repartitionByRange(parts, "tree", "key", "doc").sortWithinPartitions("tree", "key", "doc")
    got = [tuple(r) for r in ngram_join.walk(tries, 3, config).collect()]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for kind, a, b in got:
        if kind == ngram_join.STAR:
            root[find(a)] = find(b)
        elif kind == ngram_join.OPEN:
            root[find(("node", a))] = find(b)
    pairs = {(a, b) for kind, a, b in got if kind == ngram_join.PAIR}
    assert all(a > b for a, b in pairs)
    for node in plain_nodes(rows, 3):
        if len(node) > config.small_bucket:
            assert len({find(x) for x in node}) == 1
        else:
            assert all((max(a, b), min(a, b)) in pairs or find(a) == find(b) for a in node for b in node if a != b)
    assert len(got) < 40 * len(rows)


def test_shortening_is_measured():
    config = JoinConfig()
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(40)]
    for t in texts[:3]:
        a, b = brute_set(t), brute_set(ngram_join.edited(t, config, rng))
        assert 0.8 <= len(a & b) / len(a | b) < 0.87
    depth = ngram_join.measured_depth(texts, config)
    assert depth in (config.depth - 1, config.depth, config.depth + 1) and ngram_join.measured_depth([], config) == config.depth
    keys = ngram_join.signatures(*ngram_join.gram_hashes([texts[0], texts[0], texts[1]], 5), config)
    assert (ngram_join.common_prefix(keys[0], keys[1]) == 8).all() and ngram_join.common_prefix(keys[0], keys[2]).mean() < 0.2


def test_depth_has_the_recall():
    c = JoinConfig()
    rng = np.random.default_rng(1)
    hit = (rng.random((4000, c.trees, c.depth)) < c.threshold).all(2).sum(1) >= c.min_trees
    assert hit.mean() > 0.999 and JoinConfig(target_recall=0.9).depth > c.depth


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100)], "a long, b long")
    got = {r["node"]: r["root"] for r in ngram_join.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_no_documents_decide_the_depth(spark, monkeypatch):
    """Edited copies of short texts are well above the threshold, and longer prefixes would do for them; links at the threshold need the shorter ones."""
    config, used = JoinConfig(), []
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(21)) for _ in range(60)]
    assert ngram_join.measured_depth(texts, config) > config.depth
    edges = ngram_join.candidate_edges
    monkeypatch.setattr(ngram_join, "candidate_edges", lambda reps, depth, c: used.append(depth) or edges(reps, depth, c))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert ngram_join.join(docs, config).count() == len(texts) and used == [config.depth]
