from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from roundforge.llm import entry, langid, quality_rules, toxicity


def stats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = {g for g, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, g in enumerate(windows) if g in many for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_text_stats_by_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", " ", "\n", "é#", "\x0b", "a b a b a ", "\xa0"]) for _ in range(rng.randint(0, 60)))
        assert quality_rules.text_stats(text)[:5] == stats(text), repr(text)


def test_quality_on_odd_rows(odd, none):
    got = quality_rules.judge(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_words"] == 0 and by[1]["base_failed"] and not by[2]["kept"]
    assert by[4]["kept"] and by[10]["base_failed"] and by[10]["n_dup_lines"] == 14
    assert quality_rules.judge(none).count() == 0
    kept = quality_rules.quality_filter(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} >= {4, 5, 6, 7}


def test_frequent_lines_and_copies(spark):
    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    own = [(i, "Menu 12 Home About the people and the place and more\n" + words(40), "h") for i in range(40)]
    bare = [(100 + i, f"Menu {10 + i} Home About the people and the place and more\n{words(3)}", "h") for i in range(5)]
    copy = words(60) + "\n" + words(30)
    same = [(200 + i, copy, "h") for i in range(60)]
    near = [(300 + i, copy.rsplit(" ", 1)[0] + f" {words(1)}", "h") for i in range(60)]
    judged = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(own + bare + same + near, "doc_id long, text string, source string")).collect()}
    assert all(judged[i]["kept"] and judged[i]["removed_words"] == 11 for i in range(40))
    assert not any(judged[100 + i]["kept"] for i in range(5))
    assert all(judged[200 + i]["kept"] for i in range(60)) and all(judged[300 + i]["kept"] for i in range(60))


@pytest.mark.parametrize("bare", [11, 50])
def test_documents_of_boilerplate_alone_go(spark, bare):
    """Half of a host's documents are one shared line and three words of their own; the line in all of them is counted once for each."""
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    line = words(60)
    rows = [(i, f"{line}\n{words(3)}", "h") for i in range(bare)] + [(100 + i, words(60), "h") for i in range(50)]
    rows += [(200 + i, words(20) + "\n" + line, "h") for i in range(5)] + [(300 + i, f"{line}\n{words(3)}", "other") for i in range(10)]
    judged = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(judged[i]["kept"] for i in range(bare)) and all(judged[i]["removed_words"] == 60 for i in range(bare))
    assert all(judged[100 + i]["kept"] for i in range(50)) and all(judged[200 + i]["kept"] for i in range(5))
    assert all(judged[300 + i]["kept"] for i in range(10))  # ten documents are the limit


def test_copies_count_once_and_null_ids_apart(spark):
    line = "the same long line of this host with its ten words here"
    same = [(1, f"{line}\nand a second line of 2 parts", "h")] * 15 + [(2, f"  {line.upper()} \n\nand a second  line of 7 parts", "h")] * 5
    got = quality_rules.judge(spark.createDataFrame(same, "doc_id long, text string, source string"))
    assert got.count() == 20 and got.filter("kept and removed_words = 0").count() == 20
    apart = [(None, f"{line}\n{' '.join(f'{c}{k}' for k in 'abcdefghijkl')}", None) for c in "abcdefghijk"]
    got = quality_rules.judge(spark.createDataFrame(apart, "doc_id long, text string, source string"))
    assert got.count() == 11 and got.filter("kept and removed_words = 12").count() == 11


def test_templates_that_differ_in_numbers_go(spark):
    text = "Your ticket number {} has been closed by our team of agents\nIt was opened on day {} and needs no answer from you at all"
    rows = [(i, text.format(10_010 + i, 10 + i), "h") for i in range(50)] + [(100 + i, text.format(1, 1), "other") for i in range(50)]
    judged = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(judged[i]["kept"] for i in range(50)) and all(judged[100 + i]["kept"] for i in range(50))  # the others are copies of one text


def test_frequent_lines_are_cut_from_the_texts(spark):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    line = "Menu {} Home About the people and the place and more"
    own = {i: (words(20), words(20) + " \u00fc\U0001d11e ") for i in range(40)}
    rows = [(i, f"{a}\n  {line.format(i)} \n\n{b}\n{line.format(7).upper()}", "h", 0) for i, (a, b) in own.items()]
    rows += [(7, words(30), "h", 5), (50, line.format(1) + "\n" + words(30), "other", 5), (60, line.format(1), "h", 5)]
    got = quality_rules.quality_filter(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int"))
    assert got.schema.simpleString() == "struct<doc_id:bigint,text:string,source:string,n_chars:int>"
    want = [(i, f"{a}\n\n{b}", "h", len(f"{a}\n\n{b}")) for i, (a, b) in own.items()] + rows[40:42]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def ppm_bits(counts, text):
    """Code length by the definition, byte by byte."""
    data, total = b"   " + text, 0.0
    for i in range(3, len(data)):
        p = 1.0
        for order in (3, 2, 1, 0):
            seen = counts[order][data[i - order : i]]
            if not seen:
                continue
            n, kinds = sum(seen.values()), len(seen)
            if seen[data[i]]:
                p *= seen[data[i]] / (n + kinds)
                break
            p *= kinds / (n + kinds)
        else:
            p /= 256
        total -= math.log2(p)
    return total


def test_code_lengths_are_exact(spark):
    train = [(1, "the cat sat on the mat", "en"), (2, "a hat on a cat that sat", "en"), (3, "der hund und die katze", "de"), (4, "und der hut", "de")]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    counts = {lang: [defaultdict(Counter) for _ in range(4)] for lang in ("de", "en")}
    for _, t, lang in train:
        data = b"   " + langid.normal_bytes(t)
        for i in range(3, len(data)):
            for order in range(4):
                counts[lang][order][data[i - order : i]][data[i]] += 1
    tests = [b"the hat", b"der hut und", b"zq\xc3\xa4", b"x", b"cat katze"]
    bits = langid.tables(model).bits(tests)
    for i, t in enumerate(tests):
        for j, lang in enumerate(model.langs):
            assert bits[i, j] == pytest.approx(ppm_bits(counts[lang], t), rel=1e-5), (t, lang)


def test_language_on_odd_rows(odd, none, small, spark):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == "und" and got[1]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.predict(none, model).count() == 0
    assert langid.predict(odd, langid.fit(none)).filter("lang_pred <> 'und'").count() == 0
    assert langid.language_filter(odd, model).columns == odd.columns


def test_letters_beside_digits_count():
    assert langid.normal_bytes("h3llo w0rld_x") == b"h llo w rld x" and langid.normal_bytes("  12 34 -- ² \u0301 ") == b""
    assert langid.normal_bytes("2024年9月東京で会議がありました") == "年 月東京で会議がありました".encode()
    assert langid.normal_bytes("हिन्दी") == "हिन्दी".encode()  # vowel signs stay with their letters


def test_long_texts_are_linear(spark, small):
    import time

    texts = ["a" * 1_000_000, "東" * 300_000 + "1", "ab1 " * 250_000]
    began = time.time()
    assert [len(b) > 500_000 for b in langid.normalised(texts)] == [True] * 3
    assert time.time() - began < 2
    rows = [(1, texts[0], 9.0), (1, "h3llo w0rld abc1", 9.0), (None, texts[2], 9.0), (None, "h3llo", 9.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = langid.predict(docs, langid.fit(spark.read.parquet(f"{small}/documents.parquet"))).collect()
    assert len(got) == 4 and all(r["lang_pred"] != "und" and 0 < r["score"] <= 1 for r in got)


def test_language_held_out(spark, small):
    got = entry.op5_language_id(spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    out = got[got.held_out]
    assert len(out) > 20 and (out.lang_pred == out.lang).mean() > 0.95


@pytest.mark.parametrize("text", ["What an idiot!", "what an 1d10t", "IDIOT", "i.d.i.o.t", "ѕtuріd", "stuuuupid", "st\u00adupid", "ｉｄｉｏｔ", "ídiot", "worth1ess"])
def test_folding_finds_disguises(text):
    model = toxicity.Model("t", toxicity._general(), tuple(map(toxicity.folded, toxicity.EXCEPTIONS)), (0, 1, 1))
    assert toxicity.measures(text, model)[0] == 1


@pytest.mark.parametrize("text", ["", "an idiotic1 idea", "the trash can is full", "clown fish swim", "5000 10 331"])
def test_clean_texts_have_no_hits(text):
    model = toxicity.Model("t", toxicity._general(), tuple(map(toxicity.folded, toxicity.EXCEPTIONS)), (0, 1, 1))
    assert toxicity.measures(text, model)[0] == 0


def naive_hits(text, model):
    """Every entry at every place, exceptions afterwards."""
    plain = text if text.isascii() else text.translate(toxicity.ACCENTS)
    found = {}
    for entry_, w in model.weights.items():
        for at in range(len(text)):
            whole = entry_.isascii() and entry_.endswith(" ")
            if text.startswith(entry_, at) or (whole and plain.startswith(entry_, at)):
                found[at] = max(w, found.get(at, 0.0))
    for phrase in model.exceptions:
        for at in range(len(text)):
            if text.startswith(phrase, at) or plain.startswith(phrase, at):
                for k in list(found):
                    if at <= k < at + len(phrase) - 1 and (text.startswith(phrase, at) or not _accented(text, k, model)):
                        del found[k]
    return found


def _accented(text, at, model):
    return any(text.startswith(e, at) for e in model.weights)


def test_matching_equals_a_naive_matcher():
    rng = random.Random(12)
    weights = {" ab ": 2.0, " ab": 1.0, " abba ": 3.0, " c ": 0.5, " ca": 1.5, " bab ": 2.5}
    model = toxicity.Model("naive", weights, (" ab c ", " ca c ", " c ab ab "), (0.0, 1.0, 1.0))
    for _ in range(500):
        text = toxicity.folded(" ".join("".join(rng.choice("aabbcx") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 25))))
        assert toxicity.hits(text, model) == naive_hits(text, model), text
    for _ in range(200):
        text = toxicity.folded(" ".join(rng.choice(["ab", "äb", "abba", "äbba", "c", "x", "bäb"]) for _ in range(rng.randint(0, 12))))
        found = {at: w for at, w in naive_hits(text, toxicity.Model("n", weights, (), (0, 1, 1))).items()}
        assert toxicity.hits(text, toxicity.Model("accents", weights, (), (0, 1, 1))) == found, text


def test_many_exceptions_are_linear():
    import time

    model = toxicity.Model("many", toxicity._general(), tuple(map(toxicity.folded, toxicity.EXCEPTIONS)), (0, 1, 1))
    began = time.time()
    assert toxicity.measures("trash can " * 100_000, model)[0] == 0 and toxicity.measures("trash bag " * 100_000, model)[0] == 100_000
    assert time.time() - began < 10


def test_toxicity_fit_and_odd_rows(spark, odd, none, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(none, model).count() == 0
    assert toxicity.score(odd, toxicity.fit(docs, labels.limit(0))).filter("predicted = 1").count() == 0
    rude = spark.createDataFrame([(1, "you stupid idiot, pathetic loser, worthless scum")], "doc_id long, text string")
    assert toxicity.score(rude, model).first()["predicted"] == 1


def test_toxicity_held_out(spark):
    at = "/root/testdata/sf0.01"
    got = entry.op10_toxicity(spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").toPandas()
    out = got[got.held_out]
    assert (out.predicted == out.toxic).mean() > 0.9


def test_learned_lexicon_ignores_copies(spark):
    rng = random.Random(4)
    clean = [(i, " ".join(rng.choice(["sun", "moon", "tree", "river", "stone", "cloud"]) + str(rng.randint(0, 5)) for _ in range(30))) for i in range(200)]
    bad = [(1000 + i, t + " grobnik") for i, (_, t) in enumerate(clean[:40])]
    copied = [(2000 + i, "rareword nothing else here at all but these words") for i in range(40)]
    docs = spark.createDataFrame(clean + bad + copied, "doc_id long, text string")
    labels = docs.select("doc_id", F.col("doc_id").between(1000, 2999).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels)
    assert toxicity.folded("grobnik") in model.weights and toxicity.folded("rareword") not in model.weights
