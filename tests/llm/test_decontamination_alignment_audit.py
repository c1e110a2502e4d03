"""Operators 11 to 13 against brute force."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from roundforge.llm import alignment, decontamination, filter_audit
from roundforge.llm.entry import tokenizer_path

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BENCH = "item_id long, text string, score double"


def split(text):
    return WORD.findall((text or "").translate(LOW))


# --- decontamination ---------------------------------------------------------------------------


def test_words_by_brute_force():
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "B", "7", " ", "\x00", "-", "é", "İ", "\xa0", "_", "{", "漢"]) for _ in range(rng.randint(0, 12))) for _ in range(500)] + [None, "", "   "]
    flat, count = decontamination.words(pa.array(texts, pa.string()).slice(3))
    assert flat.to_pylist() == [w for t in texts[3:] for w in split(t)] and count.tolist() == [len(split(t)) for t in texts[3:]]


@pytest.mark.parametrize(("step", "depth"), [(1, 40), (3, 40), (5, 7)])
def test_suffix_array_is_sorted(step, depth):
    rng = np.random.default_rng(step)
    text = rng.integers(0, 3, 400)
    text[100:200] = text[200:300]
    text = np.concatenate([text, np.zeros(100, np.int64)])
    places = np.flatnonzero(text)
    at, first = decontamination.suffix_array(text, places, step, 2, depth)

    def suffix(p):
        end = p + int(np.argmax(text[p:] == 0))
        return tuple(text[p:end][:depth].tolist())

    order = [suffix(p) for p in at.tolist()]
    assert sorted(at.tolist()) == places.tolist() and order == sorted(order)
    assert np.all(np.diff(first) >= 0) and np.array_equal(first, decontamination.packed(text, at, step, 2))


def hits(docs, bench, window):
    """Of each document: n_words, hit words, items."""
    wins = defaultdict(set)
    for item, text in bench:
        w = split(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            wins[tuple(w[i : i + k])].add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, items = split(text), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wins:
                    hit |= set(range(i, i + k))
                    items |= wins[tuple(w[i : i + k])]
        out.append((doc, len(w), hit, sorted(items)))
    return out


def sample(seed, docs=60, items=25):
    rng = random.Random(seed)
    words = ["A", "b", "cé", "d1", "x"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", " - "]) for _ in range(n))
    bench = [(i, text(rng.choice([0, 1, 3, 6, 15, 40]))) for i in range(items)] + [(3, text(12)), (None, text(8)), (90, None), (91, "--")]
    rows = [(i, text(rng.randint(0, 90))) for i in range(docs)]
    rows += [(7, rows[5][1]), (None, bench[4][1]), (None, None), (200, bench[items - 3][1] + " q " + bench[items - 2][1]), (201, " ".join(b for _, b in bench if b))]
    return rows, bench


@pytest.mark.parametrize(("shard", "block"), [(1, 10**6), (500, 60), (10**6, 10**6)])
def test_hits_by_brute_force(spark, shard, block):
    rows, bench = sample(block)
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, items string").repartition(3)
    got = decontamination.spans(docs, spark.createDataFrame([(*b, 0.5) for b in bench], BENCH), 6, shard, block).collect()
    made = sorted((str(r["doc_id"]), r["n_words"], sorted(p for a, b in zip(r["hit_starts"], r["hit_ends"], strict=True) for p in range(a, b)), r["items"]) for r in got)
    assert made == sorted((str(d), n, sorted(h), i) for d, n, h, i in hits(rows, bench, 6))
    assert all(a < b for r in got for a, b in zip(r["hit_ends"], r["hit_starts"][1:], strict=False))


@pytest.mark.parametrize("shard", [1, 10**6])
def test_longest_matches_by_brute_force(spark, shard):
    rows, bench = sample(3, 25, 10)
    bench = [b for b in bench if b[0] not in (None, 3)]
    got = decontamination.longest_matches(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame([(*b, 0.5) for b in bench], BENCH), 6, shard).collect()
    want = []
    for item, text in bench:
        w = split(text)
        k = min(6, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            found = []
            for doc, body in rows:
                d = split(body)
                for p in range(len(d)):
                    n = 0
                    while i + n < len(w) and p + n < len(d) and w[i + n] == d[p + n]:
                        n += 1
                    found.append((n, doc, p))
            most = max(n for n, *_ in found)
            want += [(str(item), i, n, str(doc), p) for n, doc, p in found if n == most >= k]
    assert sorted((r["item_id"], r["item_start"], r["n_matched"], str(r["doc_id"]), r["doc_start"]) for r in got) == sorted(want)


def test_decontamination_of_odd_and_empty_tables(spark, odd, none):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "漢字"), (3, None), (4, "A row without an id but with enough words to count")], "item_id long, text string")
    got = {(r["doc_id"], r["n_hit"], r["n_items"]) for r in decontamination.digests(odd, bench).collect()}
    assert {(4, 10, 1), (5, 10, 1), (6, 10, 1), (10, 80, 1), (9, 1, 1), (None, 11, 1), (1, 0, 0), (2, 0, 0), (7, 0, 0), (8, 0, 0)} <= got
    rest = decontamination.decontaminate(odd, bench)
    assert rest.columns == odd.columns and sorted(r["doc_id"] for r in rest.collect()) == [1, 2, 3, 7, 8, 8]
    assert decontamination.digests(none, bench).count() == 0
    clean = decontamination.digests(odd, bench.limit(0)).collect()
    assert len(clean) == odd.count() and not any(r["contaminated"] for r in clean) and {r["items_sha256"] for r in clean} == {hashlib.sha256(b"").hexdigest()}


# --- alignment ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def paths():
    return tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both(paths):
    """Of a text: the tokens of each side, as id and bytes."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {int(i): base64.b64decode(t) for t, i in map(bytes.split, f)}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    return lambda text: ([(i, ranks[i]) for i in a.encode(" " + text, add_special_tokens=False).ids], [(i, piece(i)) for i in b.encode(text)])


def plain(text, both):
    """The links, and the groups as text; None without tokens."""
    if not text:
        return None
    a, b = both(text)
    raw = (" " + text).encode()
    if b"".join(t for _, t in a) != raw or b"".join(t for _, t in b) != raw:
        return None

    def ranges(tokens):
        at, out = 0, []
        for i, t in tokens:
            out.append((i, at, at + len(t)))
            at += len(t)
        return out

    a, b = ranges(a), ranges(b)
    links, first = [], 0
    for i, lo, hi in a:
        while first < len(b) and b[first][2] <= lo:
            first += 1
        k = first
        while k < len(b) and b[k][1] < hi:
            links.append((i, b[k][0]))
            k += 1
    ends = sorted({hi for *_, hi in a} & {hi for *_, hi in b})
    groups, lo = [], 0
    for hi in ends:
        groups.append(",".join(str(i) for i, x, y in a if lo <= x and y <= hi) + "|" + ",".join(str(i) for i, x, y in b if lo <= x and y <= hi))
        lo = hi
    return len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


def alignment_by_force(rows, both):
    made = [plain(t, both) for _, t in rows]
    count = Counter(link for m in made if m for link in set(m[3]))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    for (doc, _), m in zip(rows, made, strict=True):
        yield (str(doc), 0, 0, 0, 0, 0, 0, "") if m is None else (str(doc), *m[:3], len(m[3]), sum(count[x] == best[x[0]] for x in m[3]), sum(count[x] for x in m[3]), m[4])


ROWS = ["", None, " ", "\n", "a", " a", "a ", "a  b", "a b c", "naïve café über straße", "漢字 かな a　b", "<|endoftext|> and <s> or <unk>", "a ▁ marker ▁b", "it's we'll don't 12345 3.14", "tab\tnew\nline\r\n x", " thin   line", "𝄞 clef 👩‍👩‍👧", "x\x00y \x1c z", "\u0085 next", "  two  three   four", "é combining ﻿ bom", "a b c d e f", "ﬁ ligature ① ", "\x7f del \x7f"]


@pytest.mark.parametrize("at_once", [50, 10**6])
def test_alignment_by_brute_force(spark, paths, both, at_once):
    rng = random.Random(at_once)
    letters = ["a", "e", "n", "th", "ing", " ", " ", "  ", "\n", ".", ",", "é", "漢", "1", "'s", " ", "Wo", "_"]
    rows = [(i, t) for i, t in enumerate(ROWS)] + [(100 + i, "".join(rng.choice(letters) for _ in range(rng.randint(1, 80)))) for i in range(150)]
    rows += [(None, "a row without an id"), (5, "a"), (5, "another row"), (100, rows[-1][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_a int").repartition(3)
    got = [(str(r["doc_id"]), r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in alignment.digests(docs, *paths, pairs_at_once=at_once).collect()]
    assert sorted(got) == sorted(alignment_by_force(rows, both))


def test_alignment_of_odd_and_empty_tables(odd, none, paths, both):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect() if len(r["text"] or "") < 10_000]
    got = {(str(r["doc_id"]), r["n_a"], r["n_b"], r["n_groups"], r["groups_sha256"]) for r in alignment.digests(odd, *paths).collect()}
    assert {(x[0], x[1], x[2], x[3], x[7]) for x in alignment_by_force(rows, both)} <= got
    assert any(d == "7" and n > 100_000 for d, n, *_ in got) and alignment.digests(none, *paths).count() == 0


def test_segments_and_whole_texts_agree(paths):
    """Also with a small cache, and where texts are never cut."""
    cut, whole, small = alignment.Aligner(*paths), alignment.Aligner(*paths), alignment.Aligner(*paths, max_segments=5)
    assert cut.by_segment
    whole.by_segment = False
    texts = [t for t in ROWS if t is not None] + ["word " * 300, "A line.\n\nAnother  line, with 2 spaces and some more"]
    for _ in range(2):
        a, b, c = (x(pa.array(texts, pa.string())) for x in (cut, whole, small))
        assert a["groups_sha256"] == b["groups_sha256"] == c["groups_sha256"] and np.array_equal(a["n_links"], b["n_links"]) and np.array_equal(a["n_b"], c["n_b"])
        assert [dict(zip(p, n, strict=True)) for p, n in zip(a["pairs"].to_pylist(), a["times"].to_pylist(), strict=True)] == [dict(zip(p, n, strict=True)) for p, n in zip(b["pairs"].to_pylist(), b["times"].to_pylist(), strict=True)]


def test_labels_of_a_group():
    a_of, b_of, a_in, b_in = alignment.aligned(np.array([2, 3, 1, 2]), np.array([4, 1, 1, 1, 1]))  # .a.bx, x, bx
    assert (a_in.tolist(), b_in.tolist()) == ([2, 1, 1], [2, 1, 2]) and list(zip(a_of.tolist(), b_of.tolist(), strict=True)) == [(0, 0), (1, 0), (1, 1), (2, 2), (3, 3), (3, 4)]


# --- filter audit ------------------------------------------------------------------------------


def audit_by_force(docs, labels):
    """docs: doc_id, text, lang; labels: doc_id, quality, toxic."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in docs]
    fails, parts, says = [], [lang or "" for *_, lang in docs], []
    for (doc, text, _), w in zip(docs, words, strict=True):
        t = text or ""
        copy = doc is not None and any(d is not None and d < doc and (x or "") == t for d, x, _ in docs)
        fails.append({f for f, bad in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), copy), strict=True) if bad})
        says.append(tuple(any(x[0] == doc is not None and x[k] == 1 for x in labels) for k in (1, 2)))
    out = {}
    for part in set(parts):
        own = [i for i, p in enumerate(parts) if p == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in fails[i]]
                before, left = left, [i for i in left if f not in fails[i]]
                shapley[f] += len(gone)
                late = [i for i in own if i not in before and f in fails[i]]
                out[part, order, step] = [len(left), len(gone), len(late), sum(fails[i] == {f} for i in own), sum(says[i][0] for i in gone), sum(says[i][1] for i in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_by_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgHIJ") for _ in range(rng.randint(1, 7)))
    texts = [" ".join(word() for _ in range(rng.choice([99, 100, 101, 140]))) for _ in range(25)] + ["A " * 120, "a#b " * 100, None, "", " \n", "ab " * 100]
    texts += [t.lower() for t in texts[:15]] + [t.lower() + " 5%" for t in texts[:5]]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(220)] + [(None, texts[0], "en"), (None, texts[0], "xx"), (3, texts[1], "en"), (3, texts[1], "en"), (-5, "", "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in rng.sample(range(260), 150)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    got = filter_audit.audit(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, lang string, A int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    made = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in got}
    assert len(got) == len(made) == 600 * len({x[2] or "" for x in docs}) and made == audit_by_force(docs, labels)


def test_audit_of_odd_and_empty_tables(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in odd.select("doc_id", "text", "lang").collect()]
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in filter_audit.audit(odd, labels).collect()}
    assert got == audit_by_force(docs, [(4, 1, 0)])
    assert filter_audit.audit(none, labels).count() == 0 and filter_audit.audit(odd, labels.limit(0)).filter("good_lost > 0").count() == 0
