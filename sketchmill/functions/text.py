"""Column functions for text: white space, lines, regex dialect.

Patterns here are Java regexes that behave as Unicode-aware patterns whose only line end is \\n: M (multi-line, any case),
S (dot matches all, any case), C (multi-line), W (plain).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

M, S, C, W = "(?imdU)", "(?isdU)", "(?mdU)", "(?dU)"
#: White space in the sense of the corpus tools: Unicode white space and the separators 1C to 1F.
WS = r"\s\x1c-\x1f"
NON_BLANK = rf"(?U)[^{WS}]"
#: The same as single characters.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, f) -> Column:
    """f(value), with value computed once a row however often f uses it: a Column function can't name an intermediate result otherwise."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    return ~c.rlike(NON_BLANK)


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def universal_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def nonempty_lines(c: Column) -> Column:
    """How many lines hold anything but white space: each match runs from a line's first such character to its end."""
    return F.regexp_count(c, F.lit(rf"{NON_BLANK}[^\n]*+"))


def line_count(c: Column) -> Column:
    return F.size(lines(c))


def remove(c: Column, *patterns: str) -> Column:
    for p in patterns:
        c = F.regexp_replace(c, p, "")
    return c


def fields(c: Column, n: int) -> Column:
    """At most n fields at ';'; the last keeps further separators."""
    return F.split(c, ";", n)


def words(c: Column) -> Column:
    return let(strip(c), lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, rf"(?U)[{WS}]+", -1)))


def decode_base64(c: Column) -> Column:
    """Bytes; characters outside the alphabet are ignored, bad padding gives null."""
    clean = F.regexp_replace(c, "[^A-Za-z0-9+/=]", "")
    return let(clean, lambda x: F.when(F.length(x) % 4 == 0, F.try_to_binary(x, F.lit("base64"))))


def utf8(c: Column, errors: str = "ignore") -> Column:
    """Bytes as text: 'replace' keeps U+FFFD for bad bytes, 'ignore' drops them, 'strict' makes them an error."""
    if errors == "strict":
        return F.validate_utf8(c.cast("string"))
    if errors != "ignore":
        return F.make_valid_utf8(c.cast("string"))
    return let(c.cast("string"), _without_bad_bytes)


def _without_bad_bytes(raw: Column) -> Column:
    """Bad bytes become U+FFFD and go; where the text holds that character itself, it is written otherwise meanwhile (escaped reversibly)."""
    bad, mark, own, twice = (F.lit(x) for x in ("\ufffd", "\ue000", "\ue000\ue001", "\ue000\ue002"))
    dropped = lambda x: F.replace(F.make_valid_utf8(x), bad, F.lit(""))
    hidden = F.replace(F.replace(raw, mark, twice), bad, own)
    kept = F.replace(F.replace(dropped(hidden), own, bad), twice, mark)
    return F.when(F.contains(raw, bad), kept).when(F.is_valid_utf8(raw), raw).otherwise(dropped(raw))


def encode_base64(c: Column) -> Column:
    """One line, whatever the length."""
    return F.regexp_replace(F.base64(c.cast("binary")), r"[\r\n]", "")
