"""SQL snippets for the oracles."""

from __future__ import annotations

from roundforge.functions.text import BUILD_STOP, SCORE_STOP


#: The letters whose case folding has a plain Latin letter that lowering doesn't give.
FOLDED = {"ß": "ss", "ẞ": "ss", "ſ": "s", "ŉ": "ʼn", "ǰ": "j\u030c", "ẖ": "h\u0331", "ẗ": "t\u0308", "ẘ": "w\u030a", "ẙ": "y\u030a", "ẚ": "aʾ", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def folded(x: str) -> str:
    """Case folding, as far as words of a-z go."""
    out = f"lower({x})"
    for c, plain in FOLDED.items():
        out = f"replace({out}, '{c}', '{plain}')"
    return out


def tokens(x: str, stop: list[str] = SCORE_STOP) -> str:
    words = ", ".join(f"'{w}'" for w in stop)
    return f"list_distinct(list_filter(regexp_extract_all({folded(f"coalesce({x}, '')")}, '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains([{words}], w)))"


def build_tokens(x: str) -> str:
    return tokens(x, BUILD_STOP)


def shared(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN {shared(a, b)}::DOUBLE / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0::DOUBLE END"


def cosine(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN {shared(a, b)}::DOUBLE / sqrt((len({a}) * len({b}))::DOUBLE) ELSE 0.0::DOUBLE END"


def fnv(x: str) -> str:
    """FNV-1a of ASCII text."""
    return f"list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split({x}, ''), lambda c: ascii(c)::BIGINT)), lambda h, u: (xor(h, u) * 16777619) & 4294967295)"


def digest(seed: str, x: str) -> str:
    return f"sha256('{seed}|' || {x})"
