"""The rank join of distractors against all pairs."""

from __future__ import annotations

import random
import re

from roundforge.functions import text
from roundforge.operators import build

SCHEMA = "parent_asin string, title string, category string, category_path array<string>, leaf_category string"


def by_force(products, pool, k=3, cutoff=0.72):
    def tokens(title):
        return {w for w in re.findall("[a-z0-9]+", title.casefold()) if len(w) > 2 and w not in text.BUILD_STOP}

    out = set()
    for asin, title, category, path, leaf in products:
        best = {}
        for _, other, kind, o_path, o_leaf in pool:
            if kind != category or other.casefold() == title.casefold():
                continue
            a, b = tokens(title), tokens(other)
            s = len(a & b) / len(a | b) if a and b else 0.0
            if s >= cutoff:
                continue
            common = next((i for i, (x, y) in enumerate(zip(path, o_path, strict=False)) if x.casefold() != y.casefold()), min(len(path), len(o_path)))
            best[other] = round(common + (4 if leaf.casefold() == o_leaf.casefold() else 2) + 2.0 * min(s, 0.45), 6)
        for rank, (other, score) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.add((asin, rank, other, score))
    return out


def rows(seed, n, vocabulary, alike):
    rng = random.Random(seed)
    title = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 7)))
    out, seen = [], set()
    for i in range(n):
        t = title()
        if i < alike:  # as similar as the cutoff: the same words, in another order
            words = "alpha beta gamma delta".split()
            rng.shuffle(words)
            t = " ".join(words) + f" {'x' * (i % 2)}{i % 10}"  # short words are no tokens
        if t in seen:
            continue
        seen.add(t)
        deep = rng.choice(["one", "two", "Two", "lone"]) if i % 40 else f"rare {i}"
        out.append((f"P{i}", t, "kind", ["kind", deep], deep))
    return out


def check(spark, made):
    df = spark.createDataFrame(made, SCHEMA).repartition(3)
    got = [(r["parent_asin"], r["rank"], r["distractor"], r["rank_score"]) for r in build.theta_distractors(df, df).collect()]
    assert len(got) == len(set(got)) and set(got) == by_force(made, made)


def test_common_words_and_titles_alike(spark):
    """Words in most titles, and so many titles as similar as the cutoff that the first lists hold nothing else."""
    check(spark, rows(1, 420, ["alpha", "beta", "gamma", "delta", *(f"word{i}" for i in range(30))], 200))


def test_rare_words_and_small_groups(spark):
    check(spark, rows(2, 150, [f"word{i}" for i in range(120)] + ["the", "of"], 5) + [("Q1", "only of its kind", "other", ["other"], "other"), ("Q2", "", "third", [], ""), ("Q3", "pair one", "third", [], "")])
