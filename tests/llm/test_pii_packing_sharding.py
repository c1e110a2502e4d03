from __future__ import annotations

import math
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from roundforge.llm import entry, packing, pii, sharding, tokens

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def accepted(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in hit.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text) if accepted(k, m[0])]


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark)


def spans(df, model):
    found = pii.find(df, model)
    return {r["doc_id"]: ([x for x in r["b"].split(",") if x], [x for x in r["s"].split(",") if x]) for r in found.select("doc_id", pii.digest(pii.base_only()).alias("b"), pii.digest(pii.all_spans()).alias("s")).collect()}


def test_base_spans_by_brute_force(spark, model):
    rng = random.Random(7)
    atoms = ["a", "é", "𝄞", "@", ".", "-", " ", "+", "4539 1488 0343 6467", "4111111111111111", "12", "255", "1.2.3.4", "+1 (243) 555-5526", "x.y@b.c", "_d", "\n", "(", ")", "%", "007.08.9.1", "300.1.1.1"]
    rows = [(i, "".join(rng.choice(atoms) for _ in range(rng.randint(0, 40)))) for i in range(1500)]
    got = spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), model)
    for i, t in rows:
        assert got[i][0] == base(t), repr(t)
        assert set(got[i][0]) <= set(got[i][1])


@pytest.mark.parametrize(("said", "kind"), [('key token = "3fdf5a35c7b8d733c0b5c7d364eda8ac88d929d1" end', "secret"), ("write to ann.lee (at) mail dot example dot com today", "email"), ("social security number 078-05-1120 was", "ssn"), ("IBAN DE89 3704 0044 0532 0130 00 please", "iban"), ("call (415) 555-0132 now", "phone"), ("host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 up", "ip")])
def test_added_spans(spark, model, said, kind):
    got = spans(spark.createDataFrame([(1, said)], "doc_id long, text string"), model)[1][1]
    assert [s.split(":")[0] for s in got] == [kind]


@pytest.mark.parametrize("said", ["It was there at home. The end", "on 2026-09-18 and 18.09.2026", "Thisisaverylongwordwithoutanydigits indeed", "card 9807915762804490 is none", "version 1.2.3"])
def test_clean_texts_stay(spark, model, said):
    assert spans(spark.createDataFrame([(1, said)], "doc_id long, text string"), model)[1][1] == []


def test_long_runs_are_linear(spark, model):
    rows = [(1, "a" * 300_000), (2, "a@" + "a." * 50_000), (3, "1" * 200_000), (4, "1-" * 100_000), (5, "+1" + " " * 100_000), (6, "a at " * 50_000)]
    assert len(spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), model)) == 6


def test_long_texts_and_long_spans(spark, model):
    """Nothing is capped, and thousands of spans take seconds."""
    token, phones = "".join(random.Random(1).choice("0123456789abcdefABCDEFGH") for _ in range(2000)), 20_000
    rows = [(1, f'token = "{token}" end'), (2, "call (415) 555-0132 now. " * phones), (3, "write to ann.lee at mail dot example dot com today. " * 2000), (4, "x" * 1_000_000), (5, "+1 (415) 555-0132, " * 20_000)]
    began = time.time()
    got = spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), model)
    took = time.time() - began
    assert got[1][1] == [f"secret:9:{9 + len(token)}"] and got[4][1] == []
    assert got[2][1] == [f"phone:{25 * i + 5}:{25 * i + 19}" for i in range(phones)]
    assert len(got[3][1]) == 2000 and {s.split(":")[0] for s in got[3][1]} == {"email"}
    assert got[5][0] == got[5][1] == [f"phone:{19 * i}:{19 * i + 17}" for i in range(20_000)]
    assert took < 60
    began = time.time()
    cut = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), model).collect()}
    assert cut[1] == 'token = "<SECRET>" end' and cut[2] == "call <PHONE> now. " * phones and cut[5] == "<PHONE>, " * 20_000
    assert time.time() - began < 60


def test_overlaps_are_settled_by_score(spark):
    """As a plain loop does it: best score first, a span goes only if one that stays overlaps it."""
    rng = random.Random(3)
    rows = []
    for i in range(200):
        own = []
        for _ in range(rng.randint(0, 30)):
            start = rng.randint(0, 150)
            base = rng.random() < 0.2
            own.append((start, start + rng.randint(1, 12), -1 if base else rng.randrange(6), 2.0 if base else rng.randint(1, 9) / 10))
        rows.append((i, sorted(set(own))))
    got = spark.createDataFrame(rows, f"i long, s array<{pii.CANDIDATE}>").select("i", pii.settled(F.col("s")).alias("s")).collect()
    for r in got:
        kept = []
        for c in sorted(rows[r["i"]][1], key=lambda c: (-c[3], c[0], c[2], c[1])):
            if c[2] < 0 or not any(k[0] < c[1] and c[0] < k[1] for k in kept):
                kept.append(c)
        assert sorted(map(tuple, r["s"])) == sorted(kept)


def test_thresholds_are_calibrated(model):
    assert len({round(t, 6) for t in model.thresholds}) == len(pii.GENERATORS) and all(t != 0.5 for t in model.thresholds)
    p, y = np.array([0.9, 0.8, 0.7, 0.6, 0.5]), np.array([1, 1, 0, 1, 0])
    assert pii._threshold(p, y, 0.98) == 0.75 and pii._threshold(p, y, 0.7) == 0.55 and pii._threshold(p[2:3], y[2:3], 0.9) == 1.1


def test_counts_of_added_spans(spark):
    """The planted tokens of the test tables are found, and nothing else is added."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = entry.op4_pii(spark, "/root/testdata/sf0.01").collect()
    for r in got:
        own = [s.split(":")[0] for s in r["spans"].split(",") if s]
        assert len(own) == r["n_added"] + sum(r[f"n_{k}"] for k in pii.BASE_KINDS)
        assert all(own.count(k) == r[f"n_added_{k}"] + (r[f"n_{k}"] if k in pii.BASE_KINDS else 0) for k in pii.KINDS if k != "card")
    assert {r["doc_id"] for r in got if r["n_added"]} == {r["doc_id"] for r in docs.filter("text rlike 'token = \"[0-9a-f]{40}\"'").collect()}


def test_redaction(spark, odd, none, model):
    rows = spark.createDataFrame([(1, "é x.y@b.co and +1 (243) 555-5526, 1.2.3.4!", 40), (2, "none", 4), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redact(rows, model).collect()}
    assert got[1] == ("é <EMAIL> and <PHONE>, <IP>!", 28) and got[2] == ("none", 4) and got[3] == (None, None)
    out = pii.redact(odd, model)
    assert out.columns == odd.columns and out.count() == odd.count() and pii.redact(none, model).count() == 0
    assert "<EMAIL>" in out.filter("doc_id = 4").first()["text"]


def test_no_python_in_the_plan(spark, small):
    plan = entry.op4_pii(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- packing -----------------------------------------------------------------------------------


def test_word_cache_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = entry.tokenizer_path()
    t, enc = Tokenizer.from_file(path), tokens.word_encoder(path, 1)
    texts = ["", " ", "Hello, World. It's 3.14!!", "Größe É. ÑANDÚ, İstanbul ΟΔΟΣ ſ", "a\x1cb \x85 c\xa0d\u2003e", "<|endoftext|> x <|startoftext|>.", "don't we'll I'M", "e\u0301 \u0301x 漢字 🙂👍🏽 𝄞", "x.,. .,", "ﬁne Ⅳ ½"]
    rng = random.Random(1)
    texts += ["".join(rng.choice("ab.,'é1 \n-İΣ\u0301") for _ in range(50)) for _ in range(300)]
    for _ in range(2):
        ids, sizes = enc(texts)
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for text, got in zip(texts, parts, strict=True):
            assert got.tolist() == t.encode(text, add_special_tokens=False).ids + [1], repr(text)


def check_pieces(rows, docs, sequence=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(entry.tokenizer_path())
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in docs}
    at, seqs = {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert r["start"] == at.get(r["doc_id"], 0) and r["length"] > 0 and r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4"))
        at[r["doc_id"]] = r["start"] + r["length"]
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert at == {i: len(x) for i, x in ids.items()}
    sizes = {}
    for s, parts in seqs.items():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        sizes[s] = end
    assert sorted(sizes) == list(range(len(sizes)))
    assert all(n == sequence for s, n in sizes.items() if s != max(sizes)) and max(sizes.values(), default=0) <= sequence
    return ids


def test_packing_places_every_id_once(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.pack(docs.repartition(5), packing.PackConfig(entry.tokenizer_path(), window_sequences=2)).collect()
    ids = check_pieces(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    total, n, window = {}, 0, 2 * 2048
    for i, x in ids.items():
        total[source[i]] = total.get(source[i], 0) + len(x)
        n += len(x)
    mix = {}
    for r in rows:
        place = r["sequence_id"] * 2048 + r["offset"]
        mix.setdefault(place // window, {}).setdefault(r["source"], []).append(r["length"])
    for w, got in mix.items():
        if w < n // window - 1:
            for s, t in total.items():
                assert abs(sum(got.get(s, [0])) - window * t / n) <= 2050, (w, s)


def test_packing_with_weights_and_odd_rows(spark, odd, none):
    config = packing.PackConfig(entry.tokenizer_path(), weights={"a": 3.0, "b": 1.0})
    rows = packing.pack(odd.filter("doc_id is not null").dropDuplicates(["doc_id"]), config).collect()
    docs = [(r["doc_id"], r["text"]) for r in odd.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    check_pieces(rows, docs)
    assert packing.pack(none, config).count() == 0 and packing.pack(odd, config).count() >= odd.count()


@pytest.mark.parametrize("queues", [[10, 20, 30], [1], [1000, 1], [7, 0, 7], [5] * 9])
@pytest.mark.parametrize("weights", [None, [1, 2, 3, 1, 1, 1, 1, 1, 1]])
def test_credits(queues, weights):
    c = packing.Credits(queues, (weights or queues)[: len(queues)], 8)
    last = [0] * len(queues)
    for w in range(c.windows + 1):
        now = c.after(w)
        assert all(a <= b for a, b in zip(last, now, strict=True))
        last = now
    assert last == queues
    places = sorted(p + k for s, q in enumerate(queues) if q for _, n, p in packing.cuts(c, s, 0, q, 4) for k in range(n))
    assert places == list(range(sum(queues)))


def round_robin(queues, weights, window):
    """Which source is served at each place, window by window, with exact fractions."""
    out, served, credit, left = [], [0] * len(queues), [Fraction(0)] * len(queues), window
    while sum(served) < sum(queues):
        # the next moment at which a window ends or a queue runs dry
        live = [i for i, q in enumerate(queues) if credit[i] < q]
        total = sum(weights[i] for i in live)
        step = min([Fraction(left)] + [Fraction((queues[i] - credit[i]) * total, weights[i]) for i in live])
        step = Fraction(left) if not live else min(Fraction(left), Fraction(math.ceil(step)))
        for i in live:
            credit[i] = min(Fraction(queues[i]), credit[i] + step * weights[i] / total)
        left -= step
        if any(credit[i] >= queues[i] for i in live):  # the shares change, whole tokens are carried on
            credit = [Fraction(math.floor(c)) for c in credit]
        if not left or all(c >= q for c, q in zip(credit, queues, strict=True)):
            for i, c in enumerate(credit):
                out += [i] * (math.floor(c) - served[i])
                served[i] = math.floor(c)
            left = window
    return out


@pytest.mark.parametrize(("queues", "weights"), [([40, 20, 30], [1, 1, 1]), ([100, 7, 3], [2, 3, 5]), ([64, 64], [3, 1]), ([500, 20, 20, 20], [22, 4, 4, 4])])
def test_pieces_equal_a_plain_round_robin(queues, weights):
    c = packing.Credits(queues, weights, 16)
    got = {}
    for s, q in enumerate(queues):
        for start, n, place in packing.cuts(c, s, 0, q, 8):
            got |= {place + k: (s, start + k) for k in range(n)}
    seen, want = [0] * len(queues), {}
    for place, s in enumerate(round_robin(queues, weights, 16)):
        want[place] = (s, seen[s])
        seen[s] += 1
    assert got == want
    # until a queue runs dry, no source is a token off its target
    assert all(c.deviation(w) < 1 for w in range(c.phases[1][0] // 16 if len(c.phases) > 1 else c.windows))


def test_windows_follow_the_targets(spark, small):
    config = packing.PackConfig(entry.tokenizer_path(), window_sequences=1, flatten=0.5)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.pack(docs, config).collect()
    total = {}
    for r in rows:
        total[r["source"]] = total.get(r["source"], 0) + r["length"]
    share = {s: n**0.5 / sum(m**0.5 for m in total.values()) for s, n in total.items()}
    mix = {}
    for r in rows:
        at = mix.setdefault(r["window"], {"off": r["deviation"]})
        at[r["source"]] = at.get(r["source"], 0) + r["length"]
    for at in mix.values():
        off = at.pop("off")
        assert off == pytest.approx(max(abs(at.get(s, 0) - 2048 * x) for s, x in share.items()), abs=0.01)
    assert sum(max(abs(at.get(s, 0) - 2048 * x) for s, x in share.items()) < 1 for at in mix.values()) > 3


# --- sharding ----------------------------------------------------------------------------------


def test_sharding_is_near_equal_and_gapless(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard(docs, 8).toPandas()
    size = rows.groupby("shard")["size"].sum()
    assert sorted(size.index) == list(range(8)) and size.max() - size.min() <= 0.02 * size.mean()
    for _, g in rows.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r.size_ == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows.rename(columns={"size": "size_"}).itertuples())


def test_a_group_of_equal_texts_is_spread(spark):
    """A third of the rows have one text, and a tenth no id: shards stay near equal, and every text of the group counts in full."""
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, words) for i in range(4000)] + [(10_000 + i, f"{i} " * (20 + i % 60)) for i in range(7000)] + [(None, f"n{i} " * 50) for i in range(1000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(got) == len(rows) and size.max() - size.min() <= 0.02 * size.mean()
    group = got[got.text_crc32 == zlib.crc32(words.encode())].groupby("shard").size()
    assert len(group) == 8 and group.min() > 300
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_map_versions_and_rebalancing(spark, tmp_path):
    rng = random.Random(2)
    sizes = [rng.randrange(1, 1000) for _ in range(512)]
    first = sharding.first_map(sizes, 4)
    grown = sharding.rebalanced(first, sizes, 5)
    load = [sum(b for b, k in zip(sizes, grown.shard_of, strict=True) if k == s) for s in range(5)]
    assert grown.version == 2 and max(load) - min(load) <= 1000
    moved = [s for s in range(512) if first.shard_of[s] != grown.shard_of[s]]
    assert len(moved) < 512 * 0.3 and sum(grown.shard_of[s] == 4 for s in moved) > 0.9 * len(moved)
    first.store(spark, str(tmp_path / "m"))
    grown.store(spark, str(tmp_path / "m"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "m")) == grown and sharding.SlotMap.load(spark, str(tmp_path / "m"), 1) == first


def test_sharding_odd_rows(odd, none):
    got = sharding.shard(odd, 3).collect()
    assert len(got) == odd.count() and {r["size"] for r in got if r["doc_id"] in (1, 2)} == {16}
    assert sharding.shard(none, 3).count() == 0



def test_sharding_by_a_plain_loop(spark, odd, small):
    """The first map, the places of slots in shards and of rows in slots, on the whole odd table twice over and on documents."""
    twice = odd.unionByName(odd).select("doc_id", "text").unionByName(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"))
    slots, shards = 97, 5
    rows = [(r["virtual_slot"], r["doc_id"], r["text_crc32"], r["size"]) for r in sharding.sized(twice, slots).collect()]
    texts = Counter((r["doc_id"], zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 16) for r in twice.collect())
    assert Counter(r[1:] for r in rows) == texts
    total = [sum(r[3] for r in rows if r[0] == s) for s in range(slots)]
    load, of = [0] * shards, {}
    for s in sorted(range(slots), key=lambda s: (-total[s], s)):
        of[s] = load.index(min(load))
        load[of[s]] += total[s]
    want, used = [], [0] * shards
    for s in range(slots):
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            want.append((*r, of[s], used[of[s]]))
            used[of[s]] += 1
    got = [(r["virtual_slot"], r["doc_id"], r["text_crc32"], r["size"], r["shard"], r["slot"]) for r in sharding.shard(twice, shards, slots).collect()]
    assert Counter(got) == Counter(want)


def test_packing_the_whole_odd_table(odd):
    """Null and repeated ids are rows of their own: every id of every row lies in one piece, and sequences have no gaps."""
    from tokenizers import Tokenizer

    twice = odd.unionByName(odd)
    t = Tokenizer.from_file(entry.tokenizer_path())
    sizes = Counter()
    for r in twice.select("doc_id", "text").collect():
        sizes[r["doc_id"]] += len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    rows = packing.pack(twice, packing.PackConfig(entry.tokenizer_path())).collect()
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["length"]
    assert got == sizes
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    for (s, o, n), (s2, o2, _) in zip(places, places[1:], strict=False):
        assert (s2, o2) == ((s, o + n) if o + n < 2048 else (s + 1, 0))
