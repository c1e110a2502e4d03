"""Personal data: candidate spans scored by gradient-boosted trees, in DataFrame functions alone.

Base spans (e-mail, IP, card and phone numbers of the plain formats) always count. High-recall
generators propose further, overlapping spans: written-out e-mail addresses, IPv6 addresses, local
phone numbers, IBANs, social security numbers and secrets. Each gets format and context features. Trees unfolded into one CASE
expression score them. They are fitted on what the generators propose in generated texts, planted data and everything else alike, so
the generators' own false alarms are seen. For each generator the threshold is the least one with the target precision on held-out
texts, halfway to the score below. Overlapping spans are settled in their order of score, base spans first: a span goes only
if one that stays overlaps it.

Positions are code points, ends exclusive. A pattern's matches and the gaps between them come from
the same matcher, so positions are sums of lengths, and a span's context is what the gaps beside it hold. Patterns take runs
possessively, of any length, and start at their first character or where the last match ended. Spans are summed up, and overlaps
found, in order and in blocks, so the time grows with the text, not with the square of its spans.

Defined cases: a null text is the empty text and has no spans; texts of any length are searched whole; repeated rows, and rows with a
null or repeated doc_id, are handled row by row; of spans with the same score the first one stays, then the generator listed first;
an empty table gives an empty table; extra columns stay out of the way, and only those named like a result are replaced.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roundforge.llm import gbt
from roundforge.llm.common import as_text

#: Kinds in the order of the result.
BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "iban", "secret", "ssn"]

BASE_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to match: quick to look for.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}

#: kind, pattern, and what a text must contain for it to match.
GENERATORS = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?[\[({] ?(?i:at) ?[\])}] ?| (?i:at) | @ ?)[A-Za-z0-9-]++(?:(?: ?[\[({] ?(?i:dot) ?[\])}] ?| (?i:dot) |\.)[A-Za-z0-9-]++)++", r"(?i) @|[\[({] ?at ?[\])}]| at [A-Za-z0-9-]+(?: ?[\[({.]| dot )"),
    ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}+(?::?[0-9A-Fa-f]{1,4}){1,7}+(?![0-9A-Za-z:])", r":[0-9A-Fa-f]{1,4}:"),
    ("phone", r"(?<![0-9A-Za-z+.(-])\(?[0-9]{2,5}+\)?(?:[ ./-]{1,2}+[0-9]{2,5}+)++(?![0-9A-Za-z])", r"[0-9]{2}"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]"),
    ("secret", r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}+(?![A-Za-z0-9_+/-])", r"[0-9]"),
]
CONTEXT = 24

#: Elements of an array that are gone through before what they gave is put aside.
BLOCK = 128
MATCH = "struct<start:int,end:int,hit:string,left:string,right:string>"


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scan(xs: Column, carry: Column, made: str, step) -> Column:
    """Goes through an array in order: step(carry, x) is a struct of the next carry and an array of what x gives, of type ``made``.

    Returns a struct of the last carry and ``made``, an array of arrays. An array that grows by an element at a time is copied each
    time; in blocks, the copies grow with the number of elements times BLOCK."""
    return _bound(xs, lambda bound: _scan(bound, carry, made, step))


def _scan(xs: Column, carry: Column, made: str, step) -> Column:
    """xs: bound, as each block reads it."""
    empty = F.array().cast(f"array<{made}>")

    def inside(acc: Column, x: Column) -> Column:
        return _bound(step(acc["carry"], x), lambda r: F.struct(r["carry"].alias("carry"), F.when(F.size(r["made"]) > 0, F.concat(acc["made"], r["made"])).otherwise(acc["made"]).alias("made")))

    def block(acc: Column, first: Column) -> Column:
        got = F.aggregate(F.slice(xs, first, F.lit(BLOCK)), F.struct(acc["carry"].alias("carry"), empty.alias("made")), inside)
        return _bound(got, lambda r: F.struct(r["carry"].alias("carry"), F.concat(acc["made"], F.array(r["made"])).alias("made")))

    firsts = F.when(F.size(xs) > 0, F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(firsts, F.struct(carry.alias("carry"), F.array().cast(f"array<array<{made}>>").alias("made")), block)


def matches(text: Column, pattern: str, accept=None, needs: str | None = None) -> Column:
    """The spans of a pattern's matches, those only that ``accept`` (of the matched string) holds for, with the characters beside them."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast(f"array<{MATCH}>")

    def located(gaps: Column, hits: Column) -> Column:
        # each match with the gap before it, and what comes next
        after = lambda i: F.substring(F.concat(F.coalesce(F.get(gaps, i + 1), F.lit("")), F.coalesce(F.get(hits, i + 1), F.lit(""))), 1, 6)
        pairs = F.transform(hits, lambda hit, i: F.struct(F.get(gaps, i).alias("gap"), hit.alias("hit"), after(i).alias("right")))

        def step(carry: Column, x: Column) -> Column:
            start = carry["at"] + F.length(x["gap"])
            end = start + F.length(x["hit"])
            left = F.right(F.concat(carry["last"], x["gap"]), F.lit(CONTEXT))
            one = F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), x["hit"].alias("hit"), left.alias("left"), x["right"].alias("right")))
            take = F.lit(True) if accept is None else F.coalesce(accept(x["hit"]), F.lit(False))
            return F.struct(F.struct(end.cast("int").alias("at"), F.right(x["hit"], F.lit(CONTEXT)).alias("last")).alias("carry"), F.when(take, one).otherwise(empty).alias("made"))

        return F.flatten(scan(pairs, F.struct(F.lit(0).alias("at"), F.lit("").alias("last")), MATCH, step)["made"])

    found = _bound(F.struct(gaps.alias("gaps"), hits.alias("hits")), lambda m: F.when(F.size(m["hits"]) > 0, located(m["gaps"], m["hits"])).otherwise(empty))
    return F.when(text.rlike(needs), found).otherwise(empty) if needs else found


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _accept(kind: str):
    octet = "^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
    return {
        "email": None,
        "ip": lambda hit: F.forall(F.split(hit, r"\."), lambda part: part.rlike(octet)),
        "card": lambda hit: F.when(F.length(_digits(hit)).between(16, 19), F.call_function("luhn_check", _digits(hit))).otherwise(False),
        "phone": lambda hit: F.length(_digits(hit)).between(8, 15),
    }[kind]


def base_spans(text: Column) -> dict[str, Column]:
    return {k: matches(text, BASE_PATTERNS[k], _accept(k), NEEDS.get(k)) for k in BASE_KINDS}


# --- features and trees ------------------------------------------------------------------------

#: Words before a span that hint at a kind, and common top-level domains.
HINTS = ["phone|tel|call|mobile|fax|cell|whatsapp|ring", "token|key|secret|passw|auth|api|bearer|credential", "ssn|social|security|tax", "iban|account|bank|transfer|konto|cuenta|compte", "mail|contact|write|reach|address", r"version|isbn|order|invoice|total|page|year|date|serial|\bid\b|ref"]
DOMAINS = "com|org|net|edu|gov|info|io|co|uk|de|fr|es|eu|us"


def _flag(x: Column) -> Column:
    return F.coalesce(x.cast("double"), F.lit(0.0))


def _iban_valid(hit: Column) -> Column:
    """The remainder of an IBAN by 97 is 1, letters counted as 10 to 35."""
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(turned, F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(F.pmod(acc * F.when(value(c) > 9, 100).otherwise(10) + value(c), F.lit(97))).cast("int"))
    return (F.length(plain) >= 12) & (rest == 1)


def features(generator: Column, hit: Column, left: Column, right: Column) -> Column:
    digits, letters = F.length(_digits(hit)), F.length(F.regexp_replace(hit, "[^A-Za-z]", ""))
    low = F.lower(left)
    parts = [F.length(hit), digits, letters, F.length(hit) - digits - letters]
    parts += [_flag(generator == i) for i in range(len(GENERATORS))]
    parts += [_flag(low.rlike(h)) for h in HINTS]
    parts += [
        F.size(F.array_distinct(F.split(hit, ""))),
        F.length(F.regexp_replace(F.regexp_replace(hit, "[0-9][A-Za-z]|[A-Za-z][0-9]", "\u0001"), "[^\u0001]", "")),
        F.length(F.regexp_replace(hit, "[^A-Z]", "")),
        _flag(hit.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        _flag(hit.rlike("(?i)[a-z0-9] dot |[\\[({] ?dot ?[\\])}]")),
        _flag(hit.rlike("(?i)[\\[({] ?at ?[\\])}]|@")),
        _flag(hit.rlike(f"(?i)(?:{DOMAINS})$")),
        _flag(hit.rlike(r"^(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}(?:[-./ ][0-9]{1,2})?$|^[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:19|20)?[0-9]{2}$")),
        _flag(hit.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$")),
        _flag(hit.rlike(r"^\(?0[0-9]{1,4}\)?[ ./-][0-9]")),
        F.length(F.regexp_replace(hit, "[^:]", "")),
        F.when(generator == 3, _flag(_iban_valid(hit))).otherwise(0.0),
        _flag(left.rlike("[\"'=:] ?$")),
        _flag(right.rlike("^[A-Za-z0-9]")),
    ]
    return F.array(*[x.cast("double") for x in parts])


@dataclass(frozen=True)
class Training:
    """texts: generated texts to fit on; as many more are held out for the thresholds. Both are bounded."""

    texts: int = 1500
    seed: int = 11
    precision: float = 0.98
    trees: int = 40
    depth: int = 3


def _example(rng: random.Random) -> tuple[int, str, str, str, int]:
    """generator, left, hit, right, label."""
    word = lambda a=2, b=9: "".join(rng.choice("aeiounrstlhdcm") for _ in range(rng.randint(a, b)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    mixed = lambda n, s: "".join(rng.choice(s) for _ in range(n))
    g, yes = rng.randrange(len(GENERATORS)), rng.random() < 0.5
    hints = [["email: ", "contact ", "write to ", "mail me at "], ["address ", "host ", "from "], ["phone ", "call ", "tel: ", "mobile "], ["IBAN ", "bank account ", "transfer to "], ["SSN ", "social security number "], ['token = "', "api_key=", "secret: ", "password: "]]
    other = ["version ", "order ", "invoice no. ", "total ", "page ", "ref ", "serial "]
    plain = word() + rng.choice([" ", ". ", ", ", " (", ": "])
    left = word() + " " + (rng.choice(hints[g]) if rng.random() < 0.5 else plain)
    if g == 0:
        at = rng.choice([" (at) ", " [at] ", "(at)", " at ", "[at]", "{at}", " @ ", " AT "])
        dot = rng.choice([" (dot) ", " [dot] ", "[dot]", " dot ", ".", "(dot)", " DOT "])
        tld = rng.choice(DOMAINS.split("|"))
        if at.strip().lower() in ("at", "@") and dot == ".":
            dot = " dot " if at.strip() != "@" else "."
        hit = word() + rng.choice([".", "_", "", "-"]) + rng.choice([word(), num(2)]) + at + word() + dot + tld
        if not yes:
            hit = word() + " at " + word() + rng.choice([".", " dot "]) + rng.choice([word(), word().title()])
            left = plain
    elif g == 1:
        hit = ":".join(mixed(rng.randint(1, 4), "0123456789abcdef") for _ in range(8)) if rng.random() < 0.6 else "fe80::" + ":".join(mixed(4, "0123456789abcdef") for _ in range(rng.randint(3, 4)))
        if not yes:
            hit = ":".join(num(2) for _ in range(rng.choice([3, 3, 4])))
            left = plain
    elif g == 2:
        form = rng.choice(["(ddd) ddd-dddd", "ddd-ddd-dddd", "ddd.ddd.dddd", "ddd ddd dddd", "0dd dddd dddd", "0ddd ddddd", "0dd/ddddddd"])
        if not yes:
            form = rng.choice(["20dd-dd-dd", "dd.dd.20dd", "dd/dd/dd", "dd ddd", "dd-ddd", "ddd ddd", "d.dd.dd", "dddd-dddd-dddd", "ddd-dd-ddddd", "dd.dd", "ddddd ddddd ddddd ddddd", "ddd-dd-dddd", "ddd-dd-dddd"])
            left = word() + " " + (rng.choice(other) if rng.random() < 0.5 else plain)
            if form == "ddd-dd-dddd" and rng.random() < 0.5:  # another kind's
                g, yes, left = 4, True, word() + " " + rng.choice(hints[4])
        hit = "".join(num(1) if c == "d" else c for c in form)
    elif g == 3:
        country, body = rng.choice(["DE", "FR", "ES", "GB", "NL"]), num(18)
        turned = "".join(str(int(c, 36)) for c in body + country) + "00"
        hit = country + f"{98 - int(turned) % 97:02d}" + body
        if rng.random() < 0.5:
            hit = " ".join(hit[i : i + 4] for i in range(0, len(hit), 4))
        if not yes:
            hit = mixed(2, "ABCDEFGHKLMNPRSTUVW") + num(2) + " " + " ".join(mixed(4, "ABCDEFGHJKLMN0123456789") for _ in range(rng.randint(2, 6)))
            left = word() + " " + (rng.choice(other) if rng.random() < 0.5 else plain)
    elif g == 4:
        hit = num(3) + "-" + num(2) + "-" + num(4)
        left = word() + " " + rng.choice(hints[4])
        if not yes:
            left = word() + " " + rng.choice([*other, plain])
    else:
        hit = rng.choice([mixed(40, "0123456789abcdef"), mixed(32, "0123456789abcdef"), "ghp_" + mixed(36, "abcdefghjkmnpqrstuvwxyzABCDEFGHJKMNP0123456789"), "AKIA" + mixed(16, "ABCDEFGHJKLMNPQRSTUVWXYZ0123456789"), "sk-" + mixed(44, "abcdefghjkmnpqrstuvwxyzABCDEFGHJKMNP0123456789")])
        if not yes:
            hit = rng.choice([word(16, 30), word(8, 12) + "-" + word(8, 12), word(6, 8) + "/" + word(6, 8) + "/" + word(5, 9), num(16), num(20), word(16, 22).upper(), word(8, 10) + "_" + word(8, 10) + num(1)])
            left = plain
    right = rng.choice(['"', " ", ".", ", ", "\n"]) + word()
    return g, left, hit, right, int(yes)


def _other(rng: random.Random) -> str:
    """What generators may take for personal data and isn't, some of it just like secrets or numbers but for the words before."""
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    name = lambda: "".join(rng.choice("aeiounrstlhdcm") for _ in range(rng.randint(3, 9)))
    return rng.choice([
        lambda: f"commit {hexa(40)} fixed it", lambda: f"the checksum {hexa(32)} of the file", lambda: f"id {hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}",
        lambda: f"src/{name()}/{name()}_{num(2)}/{name()}", lambda: f"https://{name()}.com/{name()}-{name()}-{num(5)}/{name()}", lambda: f"{name()}_{name()}_{name()}_{num(3)}",
        lambda: f"ISBN 978-{num(1)}-{num(3)}-{num(5)}-{num(1)}", lambda: f"at {num(2)}:{num(2)}:{num(2)} and {num(2)}:{num(2)}:{num(2)}", lambda: f"order {num(3)}-{num(2)}-{num(4)} came", lambda: f"part no. {num(3)}-{num(3)}-{num(4)}",
        lambda: f"from {num(4)}-{num(4)} to {num(4)}", lambda: f"{num(2)} {num(3)} {num(3)} people", lambda: f"score {num(2)}-{num(2)}, {num(2)}/{num(2)}", lambda: f"we met at {name()} dot {name()}", lambda: f"look at home. The {name()}", lambda: f"{name()} {num(rng.randint(16, 24))} {name()}", lambda: f"{name()} {num(16)}", lambda: f"model {name().upper()[:2]}{num(2)} {num(4)} {num(4)} {num(4)}",
    ])()


def _training_text(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A text, and the planted data in it: generator, start, end."""
    text, gold = "", []
    for _ in range(rng.randint(1, 6)):
        if rng.random() < 0.35:
            text += _other(rng) + rng.choice([". ", ", ", "\n", " "])
            continue
        g, left, hit, right, yes = _example(rng)
        text += left
        if yes:
            gold.append((g, len(text), len(text) + len(hit)))
        text += hit + right + " "
    return text, gold


@dataclass(frozen=True)
class Model:
    boosted: gbt.Boosted = field(repr=False)
    thresholds: tuple[float, ...]

    def margin(self, x: str) -> str:
        """The sum of the trees for an array of features, as SQL: thousands of nodes are one text to parse, not a call each."""

        def node(t: gbt.Tree, i: int) -> str:
            if t.feature[i] < 0:
                return f"{float(t.value[i])!r}D"
            return f"CASE WHEN {x}[{int(t.feature[i])}] < {float(t.cut[i])!r}D THEN {node(t, 2 * i + 1)} ELSE {node(t, 2 * i + 2)} END"

        return " + ".join([f"{float(self.boosted.base)!r}D", *[node(t, 0) for t in self.boosted.trees]])


def _label(generator: int, start: int, end: int, gold: list[tuple[int, int, int]]) -> int:
    """Whether a proposal is mostly what this generator should find."""
    return int(any(g == generator and 2 * (min(end, b) - max(start, a)) > max(end, b) - min(start, a) for g, a, b in gold))


_FITTED: dict[Training, Model] = {}


def fit(spark: SparkSession, training: Training = Training()) -> Model:
    """Fits the trees on the driver, on proposals that the expressions which search texts make of generated texts. The model follows from
    ``training`` alone, so it is fitted once."""
    if training not in _FITTED:
        _FITTED[training] = _fit(spark, training)
    return _FITTED[training]


def _fit(spark: SparkSession, training: Training) -> Model:
    rng = random.Random(training.seed)
    made = [_training_text(rng) for _ in range(2 * training.texts)]
    rows = spark.createDataFrame(pd.DataFrame({"i": range(len(made)), "text": [t for t, _ in made]}))
    found = rows.select("i", F.explode(proposals(F.col("text"))).alias("c")).select("i", "c.generator", "c.start", "c.end", features(F.col("c.generator"), F.col("c.hit"), F.col("c.left"), F.col("c.right")).alias("x"))
    got = found.toPandas().sort_values(["i", "start", "generator"], kind="stable")
    x, g, i = np.stack(got["x"].to_numpy()), got["generator"].to_numpy(), got["i"].to_numpy()
    y = np.array([_label(*r, made[k][1]) for k, *r in zip(i, g, got["start"], got["end"], strict=True)])
    old = i < training.texts
    boosted = gbt.fit(x[old], y[old], training.trees, training.depth)
    p = boosted.probability(x[~old])
    return Model(boosted, tuple(_threshold(p[g[~old] == k], y[~old][g[~old] == k], training.precision) for k in range(len(GENERATORS))))


def _threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least score that keeps the precision, halfway to the next lower one; over 1 if there is none."""
    scores = np.unique(p)[::-1]
    good = [k for k, c in enumerate(scores) if y[p >= c].mean() >= precision]
    if not good:
        return 1.1
    low = scores[good[-1]]
    return float((low + (scores[good[-1] + 1] if good[-1] + 1 < len(scores) else 0.0)) / 2)


# --- spans of texts ----------------------------------------------------------------------------


def _tagged(spans: Column, **tags: Column | None) -> Column:
    """The spans' start and end with further fields: a constant each, or None for the span's own field."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), *[(s[k] if v is None else v).alias(k) for k, v in tags.items()]))


def proposals(text: Column) -> Column:
    """What the generators find: generator, start, end, hit, left and right."""
    return F.concat(*[_tagged(matches(text, pattern, None, needs), generator=F.lit(i), hit=None, left=None, right=None) for i, (_, pattern, needs) in enumerate(GENERATORS)])


CANDIDATE = "struct<start:int,end:int,generator:int,score:double>"


def settled(spans: Column) -> Column:
    """Of overlapping CANDIDATEs those that stay, best score first; base spans, of generator -1, all stay. In groups that no span links."""
    empty = F.array().cast(f"array<array<{CANDIDATE}>>")
    none = F.array().cast(f"array<{CANDIDATE}>")

    def step(carry: Column, x: Column) -> Column:
        one, near = F.array(x), x["start"] < carry["end"]
        return F.struct(
            F.struct(F.when(near, F.greatest(carry["end"], x["end"])).otherwise(x["end"]).alias("end"), F.when(near, F.concat(carry["group"], one)).otherwise(one).alias("group")).alias("carry"),
            F.when(near | (F.size(carry["group"]) == 0), empty).otherwise(F.array(carry["group"])).alias("made"),
        )

    def best(group: Column) -> Column:
        ranked = F.array_sort(F.transform(group, lambda c: F.struct((-c["score"]).alias("order"), c["start"].alias("start"), c["generator"].alias("generator"), c["end"].alias("end"))))
        one = lambda c: F.array(F.struct(c["start"].alias("start"), c["end"].alias("end"), c["generator"].alias("generator"), (-c["order"]).alias("score")))
        clash = lambda kept, c: F.exists(kept, lambda k: (k["start"] < c["end"]) & (c["start"] < k["end"]))
        return F.aggregate(ranked, none, lambda kept, c: F.when((c["generator"] >= 0) & clash(kept, c), kept).otherwise(F.concat(kept, one(c))))

    done = scan(F.array_sort(spans), F.struct(F.lit(0).alias("end"), none.alias("group")), f"array<{CANDIDATE}>", step)
    groups = _bound(done, lambda d: F.concat(F.flatten(d["made"]), F.array(d["carry"]["group"])))
    return F.flatten(F.transform(groups, lambda g: F.when(F.size(g) > 1, best(g)).otherwise(g)))


def find(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """``docs`` with base_email, base_ip, base_card, base_phone and added: arrays of spans. A span of
    ``added`` has kind, start, end and score. Columns of these names are replaced."""
    text = F.col("__text")
    out = docs.withColumn("__text", as_text(column))
    base = base_spans(text)
    out = out.withColumns({f"base_{k}": _tagged(s) for k, s in base.items()})
    out = out.withColumn("__proposed", proposals(text))
    out = out.withColumn("__proposed", F.transform("__proposed", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["generator"].alias("generator"), features(c["generator"], c["hit"], c["left"], c["right"]).alias("x"))))
    out = out.withColumn("__scored", F.expr(f"transform(__proposed, c -> named_struct('start', c.start, 'end', c.end, 'generator', c.generator, 'score', 1 / (1 + exp(-({model.margin('c.x')})))))"))
    limits = F.array(*[F.lit(t) for t in model.thresholds])
    out = out.withColumn("__scored", F.filter("__scored", lambda c: c["score"] >= limits[c["generator"]]))
    known = F.transform(F.concat(*[F.col(f"base_{k}") for k in BASE_KINDS]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(-1).alias("generator"), F.lit(2.0).alias("score")))
    kept = F.when(F.size("__scored") > 0, F.filter(settled(F.concat(known, F.col("__scored"))), lambda c: c["generator"] >= 0)).otherwise(F.array().cast(f"array<{CANDIDATE}>"))
    kinds = F.array(*[F.lit(k) for k, _, _ in GENERATORS])
    added = F.transform(kept, lambda c: F.struct(kinds[c["generator"]].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["score"].alias("score")))
    return out.withColumn("added", added).drop("__text", "__proposed", "__scored")


def all_spans() -> Column:
    """All spans of a row of ``find``, by kind as in KINDS, then start: rank, kind, start, end."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    base = [_tagged(F.col(f"base_{k}"), rank=F.lit(i), kind=F.lit(k)) for i, k in enumerate(BASE_KINDS)]
    more = F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), rank[s["kind"]].alias("rank"), s["kind"].alias("kind")))
    order = lambda a: F.array_sort(F.transform(a, lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return order(F.concat(*base, more))


def base_only() -> Column:
    """The base spans of a row of ``find``, ordered likewise."""
    return F.concat(*[_tagged(F.col(f"base_{k}"), kind=F.lit(k)) for k in BASE_KINDS])


def digest(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """``docs`` with each span of ``column`` replaced by its kind in angle brackets; overlapping spans become one, named after
    the first. n_chars, if there, is the new length. Rows without spans, and null texts, stay as they are."""
    text = as_text(column)
    found = find(docs, model, column)
    found = found.withColumn("__spans", F.array_sort(F.transform(all_spans(), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))))
    spans = F.col("__spans")
    none = F.array().cast(f"array<{PLACE}>")

    def step(carry: Column, s: Column) -> Column:
        inside = s["start"] < carry["end"]
        return F.struct(
            F.struct(F.when(inside, carry["start"]).otherwise(s["start"]).alias("start"), F.when(inside, F.greatest(carry["end"], s["end"])).otherwise(s["end"]).alias("end"), F.when(inside, carry["kind"]).otherwise(s["kind"]).alias("kind")).alias("carry"),
            F.when(inside | (carry["kind"] == ""), none).otherwise(F.array(carry)).alias("made"),
        )

    done = scan(spans, F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("kind")), PLACE, step)
    merged = _bound(done, lambda d: F.concat(F.flatten(d["made"]), F.array(d["carry"])))
    out = found.withColumn("__spans", F.when(F.size(spans) > 0, merged).otherwise(none)).withColumn("__whole", text)
    some = F.size("__spans") > 0
    out = out.withColumn(column, F.when(some, _cut(F.col("__whole"), F.col("__spans"))).otherwise(F.col(column)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.length(column).cast("long")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


PLACE = "struct<start:int,end:int,kind:string>"
#: Characters of the pieces, large and small, that a text is cut into first, as a character's place is found by counting from the first one.
PAGES = (1 << 18, 1 << 12)


def _cut(text: Column, spans: Column, sizes: tuple[int, ...] = PAGES) -> Column:
    """The text with each of the spans, in order and apart, replaced by its kind in angle brackets.

    A piece of the text keeps the characters outside of the spans that touch it, and a span's kind where it starts."""
    if not sizes:

        def pieces(own: Column) -> Column:
            before = lambda i: F.when(i > 0, F.get(own, i - 1)["end"]).otherwise(0)
            kept = F.transform(own, lambda s, i: F.concat(F.substring(text, before(i) + 1, F.greatest(s["start"] - before(i), F.lit(0))), F.when(s["start"] >= 0, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")))
            tail = F.when(F.size(own) > 0, F.substring(text, F.try_element_at(own, F.lit(-1))["end"] + 1, F.length(text))).otherwise(text)
            return F.concat(F.array_join(kept, ""), tail)

        return _bound(spans, pieces)
    pages = F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{sizes[0]}}}"), F.lit(0)), lambda page, k: F.struct(page.alias("page"), (k * sizes[0]).alias("at")))

    def keep(p: Column) -> Column:
        own = F.filter(spans, lambda s: (s["start"] < p["at"] + F.length(p["page"])) & (s["end"] > p["at"]))
        shifted = F.transform(own, lambda s: F.struct((s["start"] - p["at"]).alias("start"), (s["end"] - p["at"]).alias("end"), s["kind"].alias("kind")))
        return _cut(p["page"], shifted, sizes[1:])

    return F.array_join(F.transform(pages, keep), "")
