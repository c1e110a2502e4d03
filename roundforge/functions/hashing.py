"""Hashes and bits: digests, FNV-1a over UTF-16, dataset signatures, Hamming distance, pigeonhole segments, fingerprints."""

from __future__ import annotations

from functools import lru_cache
from math import comb

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of FNV-1a with 32 bits.
FNV_START, FNV_PRIME, FNV_MASK = 2166136261, 16777619, 4294967295


def _fold(start: Column, text: Column) -> Column:
    """Goes on from a state with the UTF-16 code units of a text: one for each character, two beyond the first 65536."""
    unit = lambda h, u: (h.bitwiseXOR(u) * FNV_PRIME).bitwiseAND(F.lit(FNV_MASK).cast("long"))

    def step(h: Column, c: Column) -> Column:
        code = F.ascii(c).cast("long")  # the first character's code point
        high, low = F.lit(0xD7C0) + F.shiftright(code, 10), F.lit(0xDC00) + code.bitwiseAND(F.lit(0x3FF).cast("long"))
        return F.when(c == "", h).when(code < 0x10000, unit(h, code)).otherwise(unit(unit(h, high), low))

    return F.aggregate(F.split(text, ""), start, step)


def fnv1a(text: Column, start: Column | None = None) -> Column:
    """start: the hash of what comes before the text."""
    return _fold(F.lit(FNV_START).cast("long") if start is None else start, text)


def folded(ids: Column, state: Column | None) -> Column:
    """Goes on from a state, None at the beginning, with an array of ids in order; '|' stands between ids. The fold goes id by id, so it is linear in the text."""
    first = F.lit(FNV_START).cast("long") if state is None else state
    parts = F.transform(ids, lambda x, i: F.concat(F.when(i > 0, "|").otherwise("" if state is None else "|"), x))
    return F.aggregate(parts, first, _fold)


def signature_of(ids: Column) -> Column:
    """The signature of a set of ids, an array: FNV-1a of the sorted ids joined by '|', in lower-case hex. For ids in rows see operators.signature."""
    return F.lower(F.hex(folded(F.array_sort(ids), None)))


def round_id(parent: Column, image: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", parent, image)), 1, 14)


def asset_id(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 24)


def keyed(seed: int | str, *key: Column) -> Column:
    """A digest that orders rows at random, the same for a seed; both engines can compute it."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *key), 256)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def segment_bounds(threshold: int, bits: int = 64) -> list[tuple[int, int]]:
    """(lowest bit, width) of threshold + 1 parts; the first parts take the remainder."""
    n = threshold + 1
    out, at = [], 0
    for i in range(n):
        width = bits // n + (i < bits % n)
        out.append((at, width))
        at += width
    return out


def ball(width: int, radius: int) -> int:
    """Values of ``width`` bits within ``radius`` bits of one."""
    return sum(comb(width, k) for k in range(radius + 1))


@lru_cache
def multi_index(threshold: int, bits: int = 64, share: float = 0.02, most: int = 8192) -> tuple[tuple[int, int, int], ...]:
    """(lowest bit, width, radius) of parts such that two values within the threshold differ by at most the radius in one of them: their radii
    and one for each part beyond the first add up to the threshold, so were all parts further apart, the values would be too.

    Few wide parts mean many neighbours to look up, many narrow ones many chance meetings. Of the cuts by which at most ``share`` of all pairs
    of random values meet, with at most ``most`` neighbours a value, the one with the fewest neighbours is taken; if there is none, that with the fewest meetings."""
    found = []
    for n in range(1, threshold + 2):
        base, more = divmod(threshold - n + 1, n)
        parts = [(lo, w, base + (i < more)) for i, (lo, w) in enumerate(segment_bounds(n - 1, bits))]
        looked_up, met = sum(ball(w, r) for _, w, r in parts), sum(ball(w, r) / 2**w for _, w, r in parts)
        if looked_up <= most:
            found.append((met > share, looked_up if met <= share else met, tuple(parts)))
    return min(found)[2]


def segments(x: Column, threshold: int) -> Column:
    """The parts of a 64-bit value as structs (part, value): two values within the threshold share one."""
    return F.array(*[F.struct(F.lit(i).alias("part"), F.shiftrightunsigned(x, lo).bitwiseAND(F.lit((1 << w) - 1).cast("long")).alias("value")) for i, (lo, w) in enumerate(segment_bounds(threshold))])


def dhash_hex(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x)), 16, "0")


def fingerprint(json: Column) -> Column:
    """A hash of a JSON object that doesn't depend on the order of its keys."""
    return F.lower(F.hex(fnv1a(F.to_json(F.parse_json(json)))))
