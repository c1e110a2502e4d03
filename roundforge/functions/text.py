"""Text: white space, titles, prices, tokens, similarity, labels."""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's split() has it.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Stop words of the choice builder, and of scoring and reranking.
BUILD_STOP = "a an and for from in of on or the to with pack set new size inch inches black white".split()
SCORE_STOP = [*BUILD_STOP, *"are as at be by is it this your you my our small large".split()]

TITLE_CUT, TEXT_CUT, CATEGORY_CUT, CATEGORY_DEPTH = 220, 900, 120, 12


@lru_cache
def _special() -> dict[str, str]:
    """Characters whose case folding isn't what lowering gives, by Unicode's rules: sharp s, ligatures, final sigma and so on."""
    return {c: c.casefold() for c in map(chr, chain(range(0x80, 0x2200), range(0xA640, 0xAC00), range(0xFB00, 0xFB18))) if c.casefold() != c.lower() or c == "\u03a3"}


def fold(x: Column) -> Column:
    """Case folding: what is equal but for case becomes equal. Sharp s and plain letters are quick; only texts with characters that may be
    special otherwise are gone through one by one."""
    # one literal, as a map of literals would weigh on every plan
    table = F.str_to_map(F.lit("\u0001".join(f"{c}\u0002{f}" for c, f in _special().items())), F.lit("\u0001"), F.lit("\u0002"))
    each = F.transform(F.split(x, ""), lambda c: F.coalesce(F.try_element_at(table, c), F.lower(c)))
    plain = F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))
    return F.when(plain.rlike(r"[^\x00-\xb4\xb6-\u0148]"), F.array_join(each, "")).otherwise(plain)


def collapse(x: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(x, SPACE, " "))


def clean(x: Column, limit: int) -> Column:
    return F.substring(collapse(F.coalesce(x, F.lit(""))), 1, limit)


def normalize_title(x: Column) -> Column:
    """Collapsed and cut to 220 code points; null below 3."""
    title = collapse(x)
    return F.when(F.length(title) >= 3, F.substring(title, 1, TITLE_CUT))


def parse_price(x: Column) -> Column:
    """A positive amount; '$' and ',' are dropped. Python's float syntax: underscores between digits, inf and nan."""
    text = F.regexp_replace(collapse(x), r"[$,]", "")
    plain = F.when(text.rlike(r"^[+-]?(\d(_?\d)*\.?(\d(_?\d)*)?|\.\d(_?\d)*)([eE][+-]?\d(_?\d)*)?$"), F.replace(text, F.lit("_"), F.lit("")))
    number = plain.try_cast("double")
    number = F.when(text.rlike("(?i)^[+]?inf(inity)?$"), F.lit(float("inf"))).otherwise(number)
    return F.when(number > 0, number)


def normalize_categories(x: Column) -> Column:
    """Items collapsed, the first of each spelling kept whatever its case, cut to 120, at most 12. An item
    is compared uncut with the cut ones kept so far."""
    cleaned = F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), collapse), lambda s: s.isNotNull() & (s != ""))

    def add(acc: Column, s: Column) -> Column:
        known = F.exists(acc, lambda k: fold(k) == fold(s))
        return F.when(known, acc).otherwise(F.concat(acc, F.array(F.substring(s, 1, CATEGORY_CUT))))

    return F.slice(F.aggregate(cleaned, F.array().cast("array<string>"), add), 1, CATEGORY_DEPTH)


def tokens(x: Column, stop: list[str] = SCORE_STOP) -> Column:
    """Distinct runs of a-z and 0-9, of three characters at least, that are no stop words; none for null."""
    words = F.regexp_extract_all(fold(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_except(F.filter(words, lambda w: F.length(w) > 2), F.array(*map(F.lit, stop)))


def jaccard(a: Column, b: Column) -> Column:
    """Of token arrays; 0 if either is empty."""
    shared, both = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / both).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / F.sqrt(F.size(a) * F.size(b))).otherwise(0.0)


def shared_tokens(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def rerank_score(a: Column, b: Column) -> Column:
    """Of token arrays: Jaccard, cosine and a small bonus for shared tokens."""
    return 14.0 * jaccard(a, b) + 4.0 * cosine(a, b) + 0.2 * F.least(shared_tokens(a, b), F.lit(4))


def taxonomy_score(path_a: Column, leaf_a: Column, category_a: Column, path_b: Column, leaf_b: Column, category_b: Column, folded: bool = False) -> Column:
    """Length of the common beginning of two category paths, and 4 for the same leaf, else 2 for the same category. folded: the texts are
    case-folded already, which is cheaper where each meets many."""
    key = (lambda c: c) if folded else fold
    same = F.zip_with(path_a, path_b, lambda a, b: F.coalesce(key(a) == key(b), F.lit(False)))
    first_other = F.array_position(same, False)
    common = F.when(first_other > 0, first_other - 1).otherwise(F.size(same)).cast("int")
    low = lambda c: key(F.coalesce(c, F.lit("")))
    return common + F.when(low(leaf_a) == low(leaf_b), 4).when(low(category_a) == low(category_b), 2).otherwise(0)


def leak_of(own: Column, said: Column) -> Column:
    """The share of a title's tokens that a review's tokens have."""
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, said)) / F.size(own)).otherwise(0.0)


def leak_ratio(title: Column, review_title: Column, review_text: Column) -> Column:
    """leak_of() for texts."""
    return leak_of(tokens(title), tokens(F.concat_ws(" ", F.coalesce(review_title, F.lit("")), F.coalesce(review_text, F.lit("")))))


def humanize(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("_and_"), F.lit(" & ")), F.lit("_"), F.lit(" "))


def source_label(x: Column) -> Column:
    """The file's name without its suffix and any 'meta_'."""
    name = F.regexp_extract(F.regexp_replace(x, "/+$", ""), r"([^/]*)$", 1)
    return F.replace(F.regexp_replace(name, r"(\.jsonl\.gz|\.jsonl|\.gz)$", ""), F.lit("meta_"), F.lit(""))


def round_category(source: Column, product: Column) -> Column:
    blank = lambda c: F.nullif(F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), F.lit(""))
    return F.coalesce(blank(source), blank(product), F.lit("Other"))


def image_host(url: Column) -> Column:
    """The lower-case authority of a URL; 'local' for asset paths, 'missing' for null, else 'unknown'."""
    authority = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    return F.when(url.isNull(), "missing").when(authority != "", authority).when(url.rlike(r"^(assets/|\./|\.\./)"), "local").otherwise("unknown")


def valid_image(url: Column) -> Column:
    http = url.rlike(r"^(?i:https?)://[^/?#]+")
    return F.coalesce(http | url.rlike(r"^(assets/|\./|\.\./)"), F.lit(False))


def safe_path(path: Column) -> Column:
    """A relative path without empty, '.' or '..' parts and without backslashes."""
    parts = F.split(path, "/")
    return F.coalesce((path != "") & ~path.rlike(r"^/|\\|^[A-Za-z]:") & F.forall(parts, lambda p: ~p.isin("", ".", "..")), F.lit(False))


def valid_date_key(x: Column) -> Column:
    """YYYY-MM-DD that names a day."""
    day = F.try_to_date(x, "yyyy-MM-dd")
    return F.coalesce(x.rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.date_format(day, "yyyy-MM-dd") == x), F.lit(False))


def date_key(ts: Column) -> Column:
    """The UTC day of a timestamp (in a session whose time zone is UTC)."""
    return F.date_format(ts, "yyyy-MM-dd")


def normalize_tags(x: Column) -> Column:
    """Tags cut to 48, the first of each spelling, at most 16."""
    cleaned = F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda s: clean(s, 48)), lambda s: s != "")
    known = lambda acc, s: F.exists(acc, lambda k: fold(k) == fold(s))
    kept = F.aggregate(cleaned, F.array().cast("array<string>"), lambda acc, s: F.when(known(acc, s), acc).otherwise(F.concat(acc, F.array(s))))
    return F.slice(kept, 1, 16)


def normalize_annotation(note: Column, tags: Column) -> Column:
    """struct(note, tags); null if both are empty."""
    text = F.substring(F.regexp_replace(F.coalesce(note, F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), 1, 4000)
    own = normalize_tags(tags)
    return F.when((text != "") | (F.size(own) > 0), F.struct(text.alias("note"), own.alias("tags")))


#: A queue preset's fields, their lengths and defaults.
PRESET = {"category": (128, "all"), "status": (32, "undecided"), "screening": (32, "all"), "signal": (128, "all"), "tag": (64, "all"), "sort": (32, "priority")}


def normalize_preset(name: Column, fields: dict[str, Column], max_priority: Column) -> Column:
    """A preset as a struct; null without a name. Priorities round half to even and lie in 0 to 100, 20 by default."""
    label = clean(name, 60)
    own = [F.coalesce(F.nullif(clean(fields.get(k, F.lit("")), n), F.lit("")), F.lit(d)).alias(k) for k, (n, d) in PRESET.items()]
    number = F.coalesce(F.bround(max_priority.try_cast("double")), F.lit(20.0))
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(100.0), number)).cast("int")
    return F.when(label != "", F.struct(label.alias("name"), *own, bounded.alias("max_priority")))


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def star_string(rating: Column) -> Column:
    """Five stars, as many filled as the rating says, halves up."""
    full = F.greatest(F.lit(0), F.least(F.lit(5), F.floor(F.coalesce(rating, F.lit(0.0)) + 0.5))).cast("int")
    return F.concat(F.repeat(F.lit("★"), full), F.repeat(F.lit("☆"), 5 - full))


def meta_line(*parts: Column) -> Column:
    """The non-empty parts joined by a middle dot."""
    return F.concat_ws(" · ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def result_squares(outcomes: Column) -> Column:
    return F.array_join(F.transform(outcomes, lambda o: F.when(o == "correct", "🟩").when(o == "wrong", "🟥").otherwise("⬜")), "")


def share_text(game: str, date: Column, correct: Column, total: Column, score: Column, outcomes: Column, url: Column) -> Column:
    """What a player shares of a day: the game and the day, the result, squares, and an address if there is one. game: its title."""
    first = F.concat(F.lit(f"{game} Daily "), date)
    second = F.concat(correct.cast("string"), F.lit("/"), total.cast("string"), F.lit(" · "), score.cast("string"), F.lit(" pts"))
    return F.concat_ws("\n", first, second, result_squares(outcomes), F.nullif(url, F.lit("")))


def headline(correct: Column, total: Column) -> Column:
    """The tier of a finished game."""
    ratio = F.when(total > 0, correct / total).otherwise(0.0)
    return F.when((total > 0) & (ratio == 1), "perfect").when(ratio >= 0.75, "great").when(ratio >= 0.5, "solid").otherwise("weird")
