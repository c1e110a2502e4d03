from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from roundforge.functions import hashing, text
from roundforge.operators import assets, build, game, screening


def one(spark, column, **values):
    names = list(values)
    types = {str: "string", int: "long", float: "double", bool: "boolean", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{n} {types[type(values[n])]}" for n in names)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def fnv(s):
    h = 2166136261
    raw = s.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * 16777619) % 2**32
    return h


@pytest.mark.parametrize("s", ["", "a", "daily:2026-09-18|alpha", "naïve 𝄞 ü"])
def test_fnv_over_utf16(spark, s):
    assert one(spark, hashing.fnv1a(F.col("s")), s=s) == fnv(s)


def test_signature_ignores_order(spark):
    a = one(spark, hashing.signature_of(F.col("i")), i=["b", "a", "c"])
    assert a == one(spark, hashing.signature_of(F.col("i")), i=["c", "b", "a"]) == format(fnv("a|b|c"), "x")


@pytest.mark.parametrize(("given", "price"), [("$1,299.50", 1299.5), ("12.50", 12.5), ("None", None), ("", None), ("-3", None), ("0", None), ("1_000", 1000.0), ("1.0d", None), ("inf", float("inf")), (".5", 0.5)])
def test_parse_price(spark, given, price):
    assert one(spark, text.parse_price(F.col("s")), s=given) == price


def test_titles_and_tags(spark):
    assert one(spark, text.normalize_title(F.col("s")), s=" a  b\x1cc ") == "a b c"
    assert one(spark, text.normalize_title(F.col("s")), s=" ab ") is None
    assert len(one(spark, text.normalize_title(F.col("s")), s="x" * 500)) == 220
    assert one(spark, text.normalize_tags(F.col("t")), t=["A  b", "a B", "", "c"]) == ["A b", "c"]
    assert one(spark, text.normalize_categories(F.col("t")), t=["Home", "home", " Pet  Food "]) == ["Home", "Pet Food"]


def test_presets(spark):
    p = one(spark, text.normalize_preset(F.col("n"), {"tag": F.lit("  x ")}, F.lit("20.5")), n=" My  preset ")
    assert (p["name"], p["tag"], p["sort"], p["max_priority"]) == ("My preset", "x", "priority", 20)
    assert one(spark, text.normalize_preset(F.col("n"), {}, F.lit("x")), n="  ") is None
    assert one(spark, text.normalize_preset(F.col("n"), {}, F.lit("999"))["max_priority"], n="a") == 100


@pytest.mark.parametrize(("url", "host"), [("https://U:p@Ex.com:80/x", "u:p@ex.com:80"), ("assets/a.jpg", "local"), ("odd", "unknown"), (None, "missing"), ("//cdn.x/y", "cdn.x")])
def test_image_host(spark, url, host):
    assert one(spark, text.image_host(F.col("u")), u=url) == host


@pytest.mark.parametrize(("path", "ok"), [("a/b.jpg", True), ("../a", False), ("/a", False), ("a\\b", False), ("a//b", False), ("", False)])
def test_safe_path(spark, path, ok):
    assert one(spark, text.safe_path(F.col("p")), p=path) is ok


@pytest.mark.parametrize(("key", "ok"), [("2026-02-28", True), ("2026-02-30", False), ("2026-2-3", False), ("x", False)])
def test_date_keys(spark, key, ok):
    assert one(spark, text.valid_date_key(F.col("k")), k=key) is ok


def test_presentation(spark):
    assert one(spark, text.star_string(F.col("r")), r=3.6) == "★★★★☆"
    assert one(spark, text.meta_line(F.col("a"), F.lit(""), F.lit("b")), a="x") == "x · b"
    assert one(spark, text.result_squares(F.col("o")), o=["correct", "wrong", "skipped"]) == "🟩🟥⬜"
    assert one(spark, text.source_label(F.col("s")), s="x/meta_Pet.jsonl.gz/") == "Pet"
    assert one(spark, text.humanize(F.col("s")), s="Home_and_Kitchen_x") == "Home & Kitchen x"


@pytest.mark.parametrize(("said", "flags"), [("mail me at a.b@c.org or (415) 555-0132", ["contact_email", "contact_phone"]), ("see www.x.org by @some_one at 48.85, 2.35", ["external_url", "social_handle", "possible_coordinates"]), ("a fine thing", [])])
def test_text_flags(spark, said, flags):
    got = one(spark, screening.text_flags(F.lit("t"), F.col("s")), s=said)
    assert [f["name"] for f in got] == flags


def test_model_flags(spark):
    rows = spark.createDataFrame([([("NSFW", 0.97)],), ([("ns_fw", 0.7), ("nsfw", 0.65)],), ([("safe", 0.99)],)], "s array<struct<label:string,score:double>>")
    got = [r["f"] for r in rows.select(screening.score_flags(F.col("s"), ["nsfw"]).alias("f")).collect()]
    assert [[f["severity"] for f in g] for g in got] == [["high"], ["medium"], []]
    with pytest.raises(ValueError):
        screening.check_thresholds(0.9, 0.5)


def test_segments_cover_all_bits():
    for t in range(17):
        bounds = hashing.segment_bounds(t)
        assert sum(w for _, w in bounds) == 64 and len(bounds) == t + 1


def test_multi_index_misses_no_pair():
    """Were all parts further apart than their radius, the values would be beyond the threshold."""
    for t in range(17):
        parts = hashing.multi_index(t)
        assert sum(w for _, w, _ in parts) == 64 and sum(r + 1 for _, _, r in parts) > t and all(r >= 0 for _, _, r in parts)


@pytest.mark.parametrize("threshold", [0, 5, 9, 16])
def test_hamming_pairs_and_what_meets(spark, threshold):
    rng = random.Random(threshold)
    base = [rng.getrandbits(64) for _ in range(500)] + [0, 2**64 - 1]
    for b in base[:200]:
        for bit in rng.sample(range(64), rng.randint(0, 18)):
            b ^= 1 << bit
        base.append(b)
    values = base + base[:5]
    df = spark.createDataFrame([(i, v - 2**64 if v >> 63 else v) for i, v in enumerate(values)], "id long, dhash long")
    want = {(a, b, d) for a in range(len(values)) for b in range(a + 1, len(values)) if (d := (values[a] ^ values[b]).bit_count()) <= threshold}
    assert {(r["a"], r["b"], r["distance"]) for r in assets.hamming_pairs(df, threshold).collect()} == want
    hashes = df.select("dhash").distinct()
    assert assets.hamming_candidates(hashes, hashes, threshold).count() < len(values) ** 2 / 10
    two = assets.hamming_pairs(df.filter("id < 300"), threshold, df.filter("id >= 300")).collect()
    assert {(r["a"], r["b"], r["distance"]) for r in two} == {(a, b, d) for a, b, d in want if a < 300 <= b}


def test_hamming_join_and_greedy_dedupe(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = base + [b ^ (1 << rng.randrange(64)) for b in base[:15]] + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base[:10]] + base[:3]
    rng.shuffle(values)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    df = spark.createDataFrame([(i, i, v) for i, v in enumerate(signed)], "id long, pos long, dhash long")
    near = {(a, b): bin(values[a] ^ values[b]).count("1") for a in range(len(values)) for b in range(a + 1, len(values))}
    want = {(a, b, d) for (a, b), d in near.items() if d <= 2}
    assert {(r["a"], r["b"], r["distance"]) for r in assets.hamming_pairs(df.select("id", "dhash"), 2).collect()} == want
    kept: list[int] = []
    for i in range(len(values)):
        if all(near[k, i] > 2 for k in kept):
            kept.append(i)
    assert sorted(r["id"] for r in assets.greedy_perceptual(df, 2).collect()) == kept


def test_sizes_and_limits():
    assert build.review_capacity(10) == 310 and build.review_capacity(10**6) == 60_000
    assert build.pool_capacity(10) == 3000 and build.per_category(10, 3) == 4 and build.oversample(100) == 135
    with pytest.raises(ValueError):
        build.check_limits(0)
    assert game.game_size("x", 100) == 10 and game.game_size("all", 7) == 7


def test_choices_and_rounds(spark):
    r = spark.createDataFrame([("i1", ["a", "b", "c", "d"])], "id string, choices array<string>")
    got = build.shuffled_choices(r, 1).first()["choices"]
    assert sorted(got) == ["a", "b", "c", "d"] and got == build.shuffled_choices(r, 1).first()["choices"]


def test_case_folding(spark):
    from roundforge.functions import text

    words = ["Straße Lampe", "STRASSE lampe", "ΟΔΟΣ οδος", "ﬁne ﬂow ſo", "İstanbul", "Größe", "plain", "K \u212a", "ẞ ŉ ǰ", "", None, "Ǆ ǆ ᾳ ΐ Ꮿ ꮿ"]
    rows = spark.createDataFrame([(w,) for w in words], "x string").select("x", text.fold(F.col("x")).alias("f"), text.tokens(F.col("x")).alias("t")).collect()
    assert [r["f"] for r in rows] == [None if w is None else w.casefold() for w in words]
    assert rows[0]["t"] == rows[1]["t"] == ["strasse", "lampe"] and rows[3]["t"] == ["fine", "flow"]
    everything = "".join(chr(c) for c in range(0x20, 0x3000) if not 0xD800 <= c < 0xE000)
    got = spark.createDataFrame([(c,) for c in everything], "x string").select("x", text.fold(F.col("x")).alias("f")).collect()
    # Java and Python may know different versions of Unicode: new letters apart, all agree
    assert sum(r["f"] != r["x"].casefold() for r in got) <= 20


def test_fnv_beyond_the_first_characters(spark):
    from roundforge.functions import hashing

    def fnv(text):
        h = 2166136261
        raw = text.encode("utf-16-le")
        for i in range(0, len(raw), 2):
            h = (h ^ int.from_bytes(raw[i : i + 2], "little")) * 16777619 & 0xFFFFFFFF
        return h

    words = ["", "a", "daily:2026|x", "é漢字", "🙂👍🏽x", "\U0010ffff"]
    got = spark.createDataFrame([(w,) for w in words], "x string").select(hashing.fnv1a(F.col("x")).alias("h"), hashing.fnv1a(F.col("x"), hashing.fnv1a(F.lit("seed|"))).alias("s")).collect()
    assert [(r["h"], r["s"]) for r in got] == [(fnv(w), fnv("seed|" + w)) for w in words]


def test_places_without_a_global_sort(spark):
    from roundforge.session import placed

    rows = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 101).alias("k")).repartition(7)
    got = [(r["place"], r["id"]) for r in placed(rows, F.col("k").desc(), F.col("id").asc()).collect()]
    want = sorted(range(5000), key=lambda i: (-(i * 7919 % 101), i))
    assert sorted(got) == list(enumerate(want))


def test_all_pairs_go_by_blocks(spark, monkeypatch):
    """Where an index isn't selective no candidates are joined, and several blocks give what one gives."""
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(150)]
    values = base + [b ^ sum(1 << bit for bit in rng.sample(range(64), rng.randint(0, 20))) for b in base] + base[:4]
    df = spark.createDataFrame([(i, v - 2**64 if v >> 63 else v) for i, v in enumerate(values)], "id long, dhash long")
    want = {(a, b, d) for a in range(len(values)) for b in range(a + 1, len(values)) if (d := (values[a] ^ values[b]).bit_count()) <= 16}
    monkeypatch.setattr(assets, "BLOCK", 70, raising=False)
    monkeypatch.setattr(assets, "hamming_candidates", None)
    assert [tuple(r) for r in assets.hamming_pairs(df, 16).orderBy("a", "b").collect()] == sorted(want)
    two = assets.hamming_pairs(df.filter("id < 160"), 16, df.filter("id >= 160")).collect()
    assert sorted(map(tuple, two)) == sorted((a, b, d) for a, b, d in want if a < 160 <= b)


def test_copies_are_settled_once(spark, monkeypatch):
    """Equal hashes don't meet in pairs: of 1500 copies the first one stays, unless one near it is kept before."""
    sizes, cut = [], assets.checkpointed
    monkeypatch.setattr(assets, "checkpointed", lambda df: sizes.append((out := cut(df)).count()) or out)
    rows = [(i, i, 5) for i in range(1, 1500)] + [(0, 0, 4), (1500, 1500, -1), (1501, 1501, None), (1502, 1502, None)]
    df = spark.createDataFrame(rows, "id long, pos long, dhash long").repartition(3)
    assert sorted(r["id"] for r in assets.greedy_perceptual(df, 16).collect()) == [0, 1500, 1501, 1502]
    assert max(sizes) <= len(rows)
