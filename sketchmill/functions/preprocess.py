"""Cleaning of diagram text. Each step is a Column function; their order in `preprocess` matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import C, M, S, lines, remove

BLOCK_COMMENT = r"(?s)/'.*?'/"
_INNER = r"(?<=[ \t])'(?=[ \t])"
_LAST = r"(?<=[ \t])'(?=[ \t]|\z)"

#: What each step removes, in this order (fixed values: styling, sprites, directives, notes, frames).
STYLING = (S + r"skinparam\s+\w+\s*\{[^}]*\}", M + r"^\s*skinparam\s+.*$", M + r"^\s*(hide|show)\s+.*$", S + r"style\s+\w+\s*\{[^}]*\}")
SPRITES = (S + r"sprite\s+\$?[\w-]+\s*\[[^\]]+\]\s*\{[^}]*\}", S + r"sprite\s+\$?[\w-]+\s*<svg[^>]*>.*?</svg>")
DIRECTIVES = (
    C + r"^\s*!define\s+.*$",
    C + r"^\s*!include\s+.*$",
    S + r"!procedure\b.*?!endprocedure",
    S + r"!function\b.*?!endfunction",
    C + r"^\s*!\$\w+\s*=.*$",
    C + r"^\s*!unquoted\s+.*$",
)
NOTES = (
    M + r"^\s*note\s+(?:left|right|top|bottom|over)(?:\s+of\s+\w+)?\s*:.*$",
    S + r"\bnote\s+(?:left|right|top|bottom|over)?(?:\s+of\s+\w+)?\s*\n.*?\bend\s+note\b",
    M + r'^\s*note\s+"[^"]*"(?:\s+as\s+\w+)?.*$',
)
FRAMES = (
    S + r"\b(left|right|center)?\s*header\b.*?\bendheader\b",
    S + r"\b(left|right|center)?\s*footer\b.*?\bendfooter\b",
    M + r"^\s*(left|right|center)?\s*(header|footer)\s+.*$",
    M + r"^\s*title\s+.*$",
    S + r"\blegend\b.*?\bendlegend\b",
    M + r"^\s*caption\s+.*$",
)


def strip_inline_comment(line: Column) -> Column:
    """Cuts a line at the first ' outside quotes that begins the line, or stands after a blank and before a blank or the line's end.

    The line is split at double quotes: even pieces are code. So no pattern ever walks over a whole long line by alternation.
    """
    pieces = F.split(line, '"', -1)
    n = F.size(pieces)

    def place(x: Column, i: Column) -> Column:
        lead = (i == 0) & x.startswith("'")
        at = F.when(i == n - 1, F.regexp_instr(x, F.lit(_LAST))).otherwise(F.regexp_instr(x, F.lit(_INNER)))
        return F.struct(i.alias("i"), F.when(i % 2 == 1, 0).when(lead, 1).otherwise(at).alias("p"))

    hits = F.filter(F.transform(pieces, place), lambda s: s["p"] > 0)
    first = F.get(hits, 0)
    kept = F.concat(F.slice(pieces, 1, first["i"]), F.array(F.substring(F.get(pieces, first["i"]), F.lit(1), first["p"] - 1)))
    return F.when(F.size(hits) == 0, line).otherwise(F.regexp_replace(F.array_join(kept, '"'), r"[ \t]+\z", ""))


def is_comment_line(line: Column) -> Column:
    return line.rlike(r"(?U)\A\s*'")


def strip_comments(c: Column) -> Column:
    """Block comments go; comment lines become empty; inline comments are cut. Line ends stay."""
    body = F.regexp_replace(c, BLOCK_COMMENT, "")
    return F.array_join(F.transform(lines(body), lambda x: F.when(is_comment_line(x), "").otherwise(strip_inline_comment(x))), "\n")


def strip_styling(c: Column) -> Column:
    return remove(c, *STYLING)


def strip_sprites(c: Column) -> Column:
    return remove(c, *SPRITES)


def strip_directives(c: Column) -> Column:
    return remove(c, *DIRECTIVES)


def strip_notes(c: Column) -> Column:
    return remove(c, *NOTES)


def strip_frames(c: Column) -> Column:
    """Headers, footers, titles, legends and captions."""
    return remove(c, *FRAMES)


def preprocess(c: Column) -> Column:
    for step in (strip_comments, strip_styling, strip_sprites, strip_directives, strip_notes, strip_frames):
        c = step(c)
    return c
